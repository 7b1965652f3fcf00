"""Decisions from materialised statistics: pure and dominant profiles, pure buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import K, SearchParams
from .predicates import fraud_amount_allowed

#: Statistics have one row a key: 2**22 profiles and 4096 buckets at most, which bounds what is broadcast.


def last_rule(only_no_last: bool) -> Column:
    return F.col("d5") < 0 if only_no_last else F.lit(True)


def profile_decision(p: SearchParams) -> Column:
    """0, 5 or null from columns n, frauds, mask of the query's profile."""
    n, frauds = F.col("n"), F.col("n_frauds")
    legit = n - frauds
    pure_legit = (F.col("mask") == 1) & (n >= p.legit_min)
    pure_fraud = (F.col("mask") == 2) & (n >= p.fraud_min) & fraud_amount_allowed(p) & last_rule(p.no_last_only)
    by_fraud = F.lit(p.dominant_fraud) & (frauds >= p.dominant_min) & (legit <= p.dominant_max_opposite) & fraud_amount_allowed(p)
    by_legit = F.lit(p.dominant_legit) & (legit >= p.dominant_min) & (frauds <= p.dominant_max_opposite)
    pure = F.when(pure_legit, 0).when(pure_fraud, K) if p.profile_fast else F.lit(None).cast("int")
    dominant = F.when(by_fraud, K).when(by_legit, 0) if p.dominant_fast else F.lit(None).cast("int")
    if not p.native_fallthrough:  # a pure mask that fell short decides nothing
        dominant = F.when(F.col("mask").isin(1, 2) & F.lit(p.profile_fast), F.lit(None)).otherwise(dominant)
    return F.coalesce(pure, dominant).cast("int")


def bucket_decision(p: SearchParams) -> Column:
    n, frauds = F.col("bucket_n"), F.col("bucket_frauds")
    if not p.bucket_fast:
        return F.lit(None).cast("int")
    return F.when((frauds == 0) & (n >= p.bucket_legit_min), 0).when((frauds == n) & (n >= p.bucket_fraud_min) & last_rule(p.bucket_no_last_only), K).cast("int")


def shortcut(queries: DataFrame, profiles: DataFrame, buckets: DataFrame, p: SearchParams) -> DataFrame:
    """queries with by_profile, by_bucket (0, 5 or null)."""
    profiles = profiles.withColumnRenamed("frauds", "n_frauds")
    buckets = buckets.select("bucket_key", F.col("n").alias("bucket_n"), F.col("frauds").alias("bucket_frauds"))
    # Profiles may be many, so they don't go through the driver.
    joined = queries.join(profiles.hint("merge"), "profile_key", "left").join(F.broadcast(buckets), "bucket_key", "left")
    return joined.withColumn("by_profile", profile_decision(p)).withColumn("by_bucket", bucket_decision(p)).drop("n", "n_frauds", "mask", "bucket_n", "bucket_frauds")
