"""Evaluation: confusion counts, weighted scores, percentiles, grouped diagnostics and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import vector_key
from .knn import keep


def confusion(scored: DataFrame) -> DataFrame:
    """total, correct, fp, fn, parse_errors, and the rates made of them.  fp: expected approved but denied."""
    n, error = F.count("*"), F.coalesce(F.col("parse_error"), F.lit(False)) if "parse_error" in scored.columns else F.lit(False)
    approved, expected = F.col("approved"), F.col("expected_approved")
    counted = scored.agg(
        n.alias("total"), F.count_if(approved == expected).alias("correct"), F.count_if(expected & ~approved).alias("fp"),
        F.count_if(~expected & approved).alias("fn"), F.count_if(error).alias("parse_errors"),
    )
    weighted = F.col("fp") + 3 * F.col("fn")
    return counted.withColumns({"weighted_errors": weighted, "failure_rate": (F.col("fp") + F.col("fn") + F.col("parse_errors")) / F.col("total"), "epsilon": weighted / F.col("total"), "accuracy": F.col("correct") / F.col("total")})


def detection_score(weighted: Column, failure_rate: Column, epsilon: Column) -> Column:
    score = 1000 * F.log10(1 / F.greatest(epsilon, F.lit(0.001))) - 300 * F.log10(1 + weighted)
    return F.round(F.when(failure_rate > 0.15, -3000.0).otherwise(score), 6)


def weighted_errors(fp: Column, fn: Column, http_errors: Column | int = 0) -> Column:
    return fp + 3 * fn + 5 * (F.lit(http_errors) if isinstance(http_errors, int) else http_errors)


def p99_score(p99_ms: Column) -> Column:
    return F.when(p99_ms <= 0, 0.0).when(p99_ms > 2000, -3000.0).otherwise(1000 * F.log10(1000 / F.greatest(p99_ms, F.lit(1.0))))


def final_score(p99_ms: Column, detection: Column) -> Column:
    return p99_score(p99_ms) + detection


def nearest_rank(df: DataFrame, value: str, p: float, *groups: str) -> DataFrame:
    """The value at position round-half-even((n - 1) p) of each group in order.

    Equal values are counted first, so a group moves as many rows as it has different values."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*groups)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_at", F.bround((F.sum("_n").over(w) - 1) * F.lit(p), 0))
    return placed.where((F.col("_upto") - F.col("_n") <= F.col("_at")) & (F.col("_at") < F.col("_upto"))).select(*groups, F.col(value).alias(f"p{round(p * 100)}"))


def fraud_histogram(scored: DataFrame) -> DataFrame:
    """Rows for 0 to 5 frauds; unparsed rows count as 0."""
    n = scored.groupBy(F.coalesce("frauds", F.lit(0)).alias("frauds")).agg(F.count("*").alias("n"))
    every = scored.sparkSession.range(6).select(F.col("id").cast("int").alias("frauds"))
    return every.join(F.broadcast(n), "frauds", "left").select("frauds", F.coalesce("n", F.lit(0)).alias("n"))


def path_stats(scored: DataFrame) -> DataFrame:
    """Count, share, frauds, errors, and of searched partitions and scanned references the average and nearest-rank
    percentiles by the path that decided, most frequent first."""
    # Read five times, and the search behind it should run once.
    scored = keep(scored.select("path", "frauds", "approved", "expected_approved", "searched", "scanned"))
    total = scored.agg(F.count("*").alias("total"))
    by = scored.groupBy("path").agg(
        F.count("*").alias("n"), F.sum("frauds").alias("frauds"), F.count_if(F.col("approved") != F.col("expected_approved")).alias("errors"),
        F.avg("searched").alias("avg_searched"), F.avg("scanned").alias("avg_scanned"),
    )
    by = by.crossJoin(F.broadcast(total)).withColumn("pct", 100.0 * F.col("n") / F.col("total"))
    for p in (0.5, 0.95, 0.99):
        name = f"p{round(p * 100)}"
        ranks = nearest_rank(scored.select("path", "scanned"), "scanned", p, "path").withColumnRenamed(name, f"{name}_scanned")
        by = by.join(F.broadcast(ranks), "path", "left")  # a row a path
    return by.select("path", "n", "pct", "frauds", "errors", "avg_searched", "avg_scanned", "p50_scanned", "p95_scanned", "p99_scanned").orderBy(F.desc("n"), "path")


def error_groups(scored: DataFrame) -> DataFrame:
    """Wrong decisions by profile, frauds, bucket, path and vector."""
    wrong = scored.where(F.col("approved") != F.col("expected_approved")).withColumn("vector", vector_key())
    by = wrong.groupBy("profile_key", "frauds", "bucket_key", "path", "vector")
    return by.agg(F.count_if("expected_approved").alias("fp"), F.count_if(~F.col("expected_approved")).alias("fn")).withColumn("total", F.col("fp") + F.col("fn"))


def top_error_groups(scored: DataFrame, n: int = 20) -> DataFrame:
    """The report's top list; the limit is the feature."""
    return error_groups(scored).orderBy(F.desc("total"), F.desc("fn"), F.desc("fp"), "profile_key", "vector").limit(n)


def compare(fast: DataFrame, safe: DataFrame) -> DataFrame:
    """Rows of two results whose decisions differ, with both; the safe one is the one to use."""
    a = fast.select("id", F.col("frauds").alias("fast_frauds"))
    b = safe.select("id", F.col("frauds").alias("safe_frauds"))
    return a.join(b, "id").where("fast_frauds <> safe_frauds")


def report(scored: DataFrame) -> DataFrame:
    """One row of figures: the confusion counts with their rates and the detection score."""
    return confusion(scored).withColumn("score_det", detection_score(F.col("weighted_errors"), F.col("failure_rate"), F.col("epsilon")))


def write_report(scored: DataFrame, path: str, requests: DataFrame | None = None) -> None:
    """Dumps as JSON lines: parsed rows, wrong rows (with the request, where requests has id and request), the figures,
    path statistics and error groups."""
    parsed = scored.where(~F.coalesce("parse_error", F.lit(False))) if "parse_error" in scored.columns else scored
    wrong = scored.where(F.col("approved") != F.col("expected_approved"))
    if requests is not None:
        wrong = wrong.join(requests.select("id", "request"), "id", "left")
    tables = [("rows", parsed), ("errors", wrong), ("figures", report(scored)), ("path_stats", path_stats(scored)), ("error_groups", error_groups(parsed))]
    for name, df in tables:
        df.write.mode("overwrite").json(f"{path}/{name}")
