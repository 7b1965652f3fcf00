"""Scoring plans: which access path answers, and the decision."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_BODY_BYTES, SearchParams
from ..functions import keys
from ..functions.features import parse_payload, vectorize
from ..operators import ann, knn, shortcuts, stats
from ..storage import written


def nearest(queries: DataFrame, refs: DataFrame, p: SearchParams, own: str | None = None) -> DataFrame:
    """id, frauds, path, searched (partitions), scanned (references) for each row of queries: flat if asked for (or on a profile miss), partitions, else buckets."""
    if p.flat or p.exact_fallback == "profile_miss":
        return knn.count_frauds(queries, refs, pruned=False, own=own).withColumn("path", F.lit("full_flat_fallback"))
    if p.kd:
        return knn.count_frauds(queries, refs, most=p.max_partitions, own=own).withColumn("path", F.lit("native_kdtree"))
    rows = knn.numbered(queries)
    found = ann.with_fallback(rows, refs, p, own).groupBy("id").agg(F.sum("label").cast("int").alias("frauds"), F.min("path").alias("path"), F.max("candidates").alias("scanned"))
    # Where there is no neighbour at all, all paths but the last have been tried.
    return rows.join(found, "id", "left").select(F.col("own_id").alias("id"), F.coalesce("frauds", F.lit(0)).alias("frauds"), F.coalesce("path", F.lit("full_flat_fallback")).alias("path"), F.lit(None).cast("long").alias("searched"), "scanned")


def score(queries: DataFrame, refs: DataFrame, p: SearchParams = SearchParams(kd=True), own: str | None = None) -> DataFrame:
    """id, frauds, path, searched, scanned, fraud_score, approved for each row of queries: profile, then bucket shortcuts, then a search
    for the rest.  Null and repeated ids are rows like others."""
    if not (p.profile_fast or p.dominant_fast or p.bucket_fast):
        return knn.decide(nearest(queries, refs, p, own))
    # Written, as both what is decided and what is searched read it.
    marked = knn.keep(shortcuts.shortcut(queries, stats.profile_stats(refs), stats.bucket_stats(refs), p))
    quick = F.coalesce("by_profile", "by_bucket")
    path = F.when(F.col("by_profile").isNotNull(), "profile_fast_path").otherwise("bucket_fast_path")
    done = marked.where(quick.isNotNull()).select("id", quick.alias("frauds"), path.alias("path"), *(F.lit(0).cast("long").alias(c) for c in ("searched", "scanned")))
    rest = marked.where(quick.isNull()).select(queries.columns)
    return knn.decide(done.unionByName(nearest(rest, refs, p, own)))


def score_bodies(bodies: DataFrame, refs: DataFrame, p: SearchParams = SearchParams(kd=True), limit_bytes: bool = True, own: str | None = None) -> DataFrame:
    """Decisions for rows of id, body (JSON).  No row is lost: what can't be parsed, or is too long, is approved with
    score 0 and parse_error set."""
    parsed = parse_payload(bodies)
    bad = F.col("parse_error") | (F.lit(limit_bytes) & (F.coalesce(F.octet_length("body"), F.lit(0)) > MAX_BODY_BYTES))
    parsed = parsed.withColumn("parse_error", bad)
    name = f"bodies {uuid.uuid4().hex}"  # every call and micro-batch has its own
    good = written(bodies.sparkSession, name, lambda: vectorize(parsed.where("not parse_error")).drop("p", "body", "parse_error"), large=True)
    queries = good.withColumns({"bucket_key": keys.bucket_key(), "fine_key": keys.fine_key(), "profile_key": keys.profile_key(), "kd_key": keys.kd_key()})
    scored = score(queries, refs, p, own).withColumn("parse_error", F.lit(False))
    failed = parsed.where("parse_error").select("id", F.lit(0).alias("frauds"), F.lit("parse_error").alias("path"), *(F.lit(0).cast("long").alias(c) for c in ("searched", "scanned")), F.lit(0.0).alias("fraud_score"), F.lit(True).alias("approved"), F.lit(True).alias("parse_error"))
    return scored.unionByName(failed)
