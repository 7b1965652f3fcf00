"""Statistics that access paths and shortcuts read: histograms, boxes, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIM, DIMS, SCALE

BUCKETS = 4096
#: Fixed: where a bucket key's fields begin and their masks, in the order in which neighbours are visited.
FIELDS = ((0, 7), (3, 7), (6, 7), (9, 3), (11, 1))


def bucket_histogram(refs: DataFrame) -> DataFrame:
    """n and the number of references before, for each bucket that has any."""
    n = refs.groupBy("bucket_key").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("bucket_key").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def positions(rows: DataFrame, column: str, block: int = 1_000_000) -> DataFrame:
    """rows with their position (from 1) in order of an integer column without nulls.

    Blocks of values are counted and numbered each for itself, so all rows meet in no task."""
    piece = F.floor(F.col(column) / block)
    ahead = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(piece.alias("piece")).agg(F.count("*").alias("n"))
    pieces = pieces.select("piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("piece").orderBy(column))
    placed = rows.withColumn("piece", piece).withColumn("own", own).join(pieces, "piece")
    return placed.withColumn("position", F.col("ahead") + F.col("own")).drop("piece", "own", "ahead")


def bucket_stats(refs: DataFrame) -> DataFrame:
    return refs.groupBy("bucket_key").agg(F.count("*").alias("n"), F.sum("label").alias("frauds"))


def profile_stats(refs: DataFrame) -> DataFrame:
    """Counts saturate at 65535; mask is 1 for legit and 2 for fraud, or both."""
    full = F.lit(65535)
    return refs.groupBy("profile_key").agg(
        F.least(F.count("*"), full).alias("n"), F.least(F.sum("label"), full).alias("frauds"), F.bit_or(F.when(F.col("label") == 1, 2).otherwise(1)).alias("mask")
    )


def centre(b: Column, n: int) -> Column:
    low, high = bucket_range(b, n)
    return F.floor((low + high) / 2).cast("int")


def bucket_range(b: Column, n: int) -> tuple[Column, Column]:
    low = F.when(b == 0, 0).otherwise(F.ceil(b * (SCALE + 1) / n))
    high = F.when(b == n - 1, SCALE).otherwise(F.floor(((b + 1) * (SCALE + 1) - 1) / n))
    return low, high


def part_of(key: Column, at: int, mask: int) -> Column:
    return F.shiftright(key, at).bitwiseAND(F.lit(mask))


def centroids(refs: DataFrame) -> DataFrame:
    """c0..c13 of each of the 4096 buckets: means rounded half away, or the bucket's own centre where empty."""
    spark, key = refs.sparkSession, F.col("bucket_key")
    means = refs.groupBy("bucket_key").agg(*(F.sum(d).alias(f"s{i}") for i, d in enumerate(DIMS)), F.count("*").alias("n"))
    half = F.lit(SCALE // 2)
    empty = {0: centre(part_of(key, 0, 7), 8), 2: centre(part_of(key, 3, 7), 8), 7: centre(part_of(key, 6, 7), 8), 3: centre(part_of(key, 9, 3), 4)}
    empty |= {5: F.when(part_of(key, 11, 1) == 0, half).otherwise(-SCALE), **{i: half for i in (1, 4, 6, 8, 12, 13)}}
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket_key")).join(means, "bucket_key", "left")
    value = lambda i: F.when(F.col("n").isNull(), empty.get(i, F.lit(0))).otherwise(F.round(F.col(f"s{i}") / F.col("n"), 0)).cast("int")
    return every.select("bucket_key", F.coalesce("n", F.lit(0)).alias("n"), *(value(i).alias(f"c{i}") for i in range(DIM)))


def partition_boxes(refs: DataFrame) -> DataFrame:
    """n and the bounding box of each partition; 256 rows at most."""
    return refs.groupBy("kd_key").agg(F.count("*").alias("n"), *(f(d).alias(f"{name}{i}") for i, d in enumerate(DIMS) for f, name in ((F.min, "lo"), (F.max, "hi"))))


def risky_histogram(refs: DataFrame) -> DataFrame:
    return refs.where("is_risky").groupBy("bucket_key").agg(F.count("*").alias("n"), F.countDistinct("fine_key").alias("fine_keys"))


def neighbour_order(sources: DataFrame) -> DataFrame:
    """rank (from 0) of all 4096 buckets around each source bucket: growing rings, then the nested loops' order."""
    spark = sources.sparkSession
    keys = spark.range(BUCKETS).select(F.col("id").cast("int").alias("key"))
    pairs = sources.select("bucket_key").distinct().crossJoin(F.broadcast(keys))
    s, k = F.col("bucket_key"), F.col("key")
    gap = lambda at, mask: F.abs(part_of(s, at, mask) - part_of(k, at, mask))
    ring = F.greatest(*(gap(at, mask) for at, mask in FIELDS[:-1]), 2 * gap(*FIELDS[-1]))
    order = [part_of(k, at, mask) for at, mask in FIELDS]
    w = Window.partitionBy("bucket_key").orderBy("ring", *order)
    return pairs.withColumn("ring", ring).select("bucket_key", "key", "ring", (F.row_number().over(w) - 1).alias("rank"))


def centroid_order(sources: DataFrame, centres: DataFrame) -> DataFrame:
    """rank of all buckets around each source bucket by distance of centroids, then key."""
    mine = sources.select("bucket_key").distinct().join(F.broadcast(centres), "bucket_key").select("bucket_key", *(F.col(f"c{i}").alias(f"s{i}") for i in range(DIM)))
    other = centres.select(F.col("bucket_key").alias("key"), *(f"c{i}" for i in range(DIM)))
    distance = sum(((F.col(f"s{i}") - F.col(f"c{i}")).cast("long") * (F.col(f"s{i}") - F.col(f"c{i}")) for i in range(DIM)), F.lit(0))
    pairs = mine.crossJoin(F.broadcast(other)).select("bucket_key", "key", distance.alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("bucket_key").orderBy("distance", "key")) - 1)
