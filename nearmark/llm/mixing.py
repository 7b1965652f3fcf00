"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / quality, u uniform from a hash of its doc_id, so better documents come
early more often.  A source's target in words is met by complete epochs (every document once) and then by the
documents of smallest key until the rest is used up.  Prefix sums run in two levels: sums per source and key
range, then in order within the single range where the target falls.  Ranges are cut at quantiles of all keys, and
evenly within, so no range holds more than a small share of all rows, whatever the qualities; no task holds a whole
source.  Targets are worked out in one task over a row for each source.

Defined results: null and blank texts have size 0 and are never taken; a null source is a source of its own,
last in order; a null doc_id is drawn by its text; rows that repeat one another are drawn next to each other,
each as a row of its own, and rows alike in doc_id and text but not in source each in their own source; equal keys
go by doc_id, then text; a very long text is one row like any other; an empty table gives an empty result; further
columns are carried through, but columns size, source_size, target, copies and taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Key ranges: between QUANTILES cuts of all keys, each divided evenly in PARTS.
QUANTILES, PARTS = 128, 512
#: Sources up to this number are joined by broadcast; more go through a shuffle.
FEW_SOURCES = 10_000
OWN_COLUMNS = ["copies", "size", "source_size", "target", "taken"]


def quality(text: Column) -> Column:
    """A document weight in [0.1, 1]: symbols typical of markup and junk lower it."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return F.greatest(F.lit(0.1), 1.0 - 4.0 * symbols / F.greatest(F.length(text), F.lit(1)))


def draw_key(doc_id: Column, text: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from 52 bits of a hash: the same in every run."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 13), 16, 10).cast("long")
    return -F.log((digits.cast("double") + 0.5) / 4503599627370496.0) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for rows of source, source_size: one row a source.

    Sources by code point, null last, weigh WEIGHTS in turn and share SHARE of all words.  A target stops at
    MOST_EPOCHS times its source; what is over goes to the others by weight until none is above.  With sources
    in order of cap per weight, those that stop are a beginning of that order, found by prefix sums."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1)
    rows = sizes.withColumn("w", weight).withColumn("cap", F.lit(MOST_EPOCHS) * F.col("source_size"))
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("words", F.sum("source_size").over(every))
        .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("rest", F.lit(SHARE) * F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("stops", F.col("cap") * F.col("rest_w") <= F.col("w") * F.col("rest"))
    )
    stopped = F.max(F.when(F.col("stops"), F.struct("at", "cap_sum", "w_sum"))).over(every)
    rows = (
        rows.withColumn("at", F.row_number().over(upto))
        .withColumn("cap_sum", F.sum("cap").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("w_sum", F.sum("w").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("last", stopped)
    )
    share = F.col("w") * (F.lit(SHARE) * F.col("words") - F.coalesce("last.cap_sum", F.lit(0))) / (F.col("all_w") - F.coalesce("last.w_sum", F.lit(0)))
    capped = F.coalesce(F.col("at") <= F.col("last.at"), F.lit(False))
    return rows.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def range_of(rows: DataFrame, quantiles: int = QUANTILES, parts: int = PARTS) -> Column:
    """The key range of a row's key; ranges grow with the key."""
    found = rows.agg(F.percentile_approx("key", [k / quantiles for k in range(1, quantiles)], 10_000).alias("cuts"), F.max("key").alias("last")).first()
    if found["last"] is None:
        return F.lit(0)
    ends = sorted({*found["cuts"], found["last"]})
    at = F.size(F.filter(F.array(*map(F.lit, ends)), lambda c: c < F.col("key")))
    low = F.coalesce(F.get(F.array(*map(F.lit, ends)), at - 1), F.lit(0.0))
    high = F.get(F.array(*map(F.lit, ends)), at)
    within = F.floor((F.col("key") - low) / (high - low) * parts)
    return (at * parts + F.coalesce(F.least(F.greatest(within, F.lit(0)), F.lit(parts - 1)), F.lit(0))).cast("int")


def edges(sums: DataFrame) -> DataFrame:
    """Of rows _source, part, words, rest and from: the part of each source where from and the words so far reach
    rest, with the words before it as ahead; none for a source whose rest is 0."""
    before = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("ahead", F.col("from") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    return placed.where("ahead < rest and ahead + words >= rest")  # a row a source at most


def mix(spark: SparkSession, docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, row (a hash of the text), source, size, source_size, target, copies and taken (words, repeats counted)
    for each row of docs; carry adds the row itself as _doc."""
    space = Workspace(spark, "mix")
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        *([F.struct(*docs.columns).alias("_doc")] if carry else []),
        F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_row"), F.col("source").alias("_source"), word_count(F.col("text")).alias("size"),
        draw_key(F.col("doc_id"), text, quality(text)).alias("key"),
    )
    rows = space.keep(measured, "rows")
    rows = rows.withColumn("part", range_of(rows))
    parts = space.keep(rows.groupBy("_source", "part").agg(F.sum("size").alias("words")), "parts")
    goals = targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")))
    goals = space.keep(goals.withColumnRenamed("source", "_source"), "targets")
    few = goals.count() <= FEW_SOURCES
    small = F.broadcast if few else (lambda df: df)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # First among the quantiles, then among the parts of the one where the target falls: a few hundred rows a source.
    wide = parts.groupBy("_source", F.floor(F.col("part") / PARTS).alias("part")).agg(F.sum("words").alias("words"))
    wide = edges(wide.join(small(goals.select(F.col("_source").alias("_of"), "rest", F.lit(0).alias("from"))), F.col("_source").eqNullSafe(F.col("_of"))))
    inner = wide.select(F.col("_source").alias("_of"), F.col("part").alias("_wide"), "rest", F.col("ahead").alias("from"))
    edge = edges(parts.join(small(inner), parts["_source"].eqNullSafe(F.col("_of")) & (F.floor(F.col("part") / PARTS) == F.col("_wide"))))
    edge = edge.select(F.col("_source").alias("_edge_source"), F.col("part").alias("edge"), "ahead")
    goals = goals.join(edge, goals["_source"].eqNullSafe(edge["_edge_source"]), "left").drop("_edge_source").withColumnRenamed("_source", "_goal")
    goals = space.keep(goals, "goals")
    joined = rows.join(small(goals), rows["_source"].eqNullSafe(goals["_goal"])).drop("_goal")
    within = Window.partitionBy("_source").orderBy("key", "_id", "_row", "size")
    at_edge = joined.where("part = edge").withColumn("_sum", F.col("ahead") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    nearer = (F.col("_sum") <= F.col("rest")) | (F.col("_sum") - F.col("rest") < F.col("rest") - (F.col("_sum") - F.col("size")))
    at_edge = at_edge.withColumn("more", nearer).drop("_sum")
    other = joined.where("edge is null or part <> edge").withColumn("more", F.coalesce(F.col("part") < F.col("edge"), F.lit(False)))
    chosen = at_edge.unionByName(other).withColumn("copies", F.col("epochs") + F.col("more").cast("long"))
    return chosen.select(
        *(["_doc"] if carry else []), F.col("_id").alias("doc_id"), F.col("_row").alias("row"), F.col("_source").alias("source"), "size", "source_size", "target",
        "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with copies, size, source_size, target and taken.

    Rows are written once with their sizes and keys, so only those of the ranges where targets fall are shuffled."""
    docs = docs.drop(*OWN_COLUMNS)
    found = mix(spark, docs, carry=True).where("taken > 0")
    return found.select("_doc.*", *OWN_COLUMNS)
