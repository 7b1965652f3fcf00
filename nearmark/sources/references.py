"""The labelled reference table: JSON source, keys and ordinals, and the persisted index."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DIMS, K, SCALE, RiskyFilter
from ..functions import keys
from ..functions.features import quantize_reference
from ..operators.predicates import risky
from ..schema import EVALUATION, REFERENCE

ORDINALS_A_BLOCK = 1_000_000


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Ordinal, label and d0..d13 of JSON arrays of references (gzip too); an unknown label or no row is an error.

    Ordinals count from 0 in order of file names, then of places in the file, however files are dealt to tasks."""
    raw = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    if raw.isEmpty():
        raise ValueError("no reference vectors found")
    number = F.when(F.col("label") == "fraud", 1).when(F.col("label") == "legit", 0).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null")))))
    # A file is read by one task, so its rows' ids follow their places.
    placed = raw.select("vector", number.cast("int").alias("label"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    within = placed.withColumn("own", F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = within.join(files, "file").withColumn("ordinal", F.col("ahead") + F.col("own"))
    return quantize_reference(numbered).select("ordinal", "label", *DIMS)


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of what each file holds, unpacked if it is a gzip file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for raw in batch.column(1):
                stream = raw.as_py()
                packed = stream[:2] == b"\x1f\x8b"
                digests.append(hashlib.sha256(gzip.decompress(stream) if packed else stream).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sha256 string")


def read_evaluation(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """id, request (a payload), body (its JSON) and expected_approved of an evaluation corpus; limit is a row limit."""
    rows = spark.read.schema(EVALUATION).option("multiLine", True).json(path).select(F.posexplode("entries"))
    rows = rows.select(F.col("pos").cast("long").alias("id"), "col.request", F.to_json("col.request", {"ignoreNullFields": "false"}).alias("body"), "col.expected_approved")
    return rows if limit is None else rows.where(F.col("id") < limit)


def with_keys(rows: DataFrame, kd_profile: int = 0) -> DataFrame:
    """Adds the keys, is_risky and ref_id: the position in order of (bucket_key, ordinal), from 0.

    Positions come from counts per key and block of ordinals and a rank within each such piece, so neither one
    key nor all rows meet in a task."""
    rows = rows.withColumns({"bucket_key": keys.bucket_key(), "fine_key": keys.fine_key(), "profile_key": keys.profile_key(), "kd_key": keys.kd_key(kd_profile), "is_risky": risky(RiskyFilter())})
    rows = rows.withColumn("piece", F.floor(F.col("ordinal") / ORDINALS_A_BLOCK))
    pieces = rows.groupBy("bucket_key", "piece").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("bucket_key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("bucket_key", "piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("bucket_key", "piece").orderBy("ordinal")
    placed = rows.withColumn("rank", F.row_number().over(within)).join(pieces, ["bucket_key", "piece"])
    return placed.withColumn("ref_id", F.col("ahead") + F.col("rank") - 1).drop("piece", "rank", "ahead")


def write_index(refs: DataFrame, path: str, info: dict[str, str]) -> None:
    """One Parquet table a section; references clustered by bucket so that scans can skip."""
    from ..operators import stats

    spark = refs.sparkSession
    refs.repartitionByRange("bucket_key").sortWithinPartitions("ref_id").write.mode("overwrite").parquet(f"{path}/refs")
    saved = spark.read.parquet(f"{path}/refs")
    for name, df in (
        ("bucket_stats", stats.bucket_stats(saved)), ("profile_stats", stats.profile_stats(saved)), ("centroids", stats.centroids(saved)),
        ("partitions", stats.partition_boxes(saved)), ("risky_stats", stats.risky_histogram(saved)), ("build_info", build_info(spark, info)),
    ):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def build_info(spark: SparkSession, info: dict[str, str]) -> DataFrame:
    """key, value: unprintable characters become '?', blank values are left out."""
    rows = [(k, "".join(c if " " <= c <= "~" else "?" for c in str(v))) for k, v in info.items() if str(v).strip()]
    return spark.createDataFrame(rows, "key string, value string")


#: Bytes of build info that a reader accepts.
MOST_INFO_BYTES = 4096


def index_info(spark: SparkSession, path: str) -> DataFrame:
    """key, value of an index's build info, by key."""
    return spark.read.parquet(f"{path}/build_info").orderBy("key")


def read_index(spark: SparkSession, path: str, allowed_hashes: str = "") -> dict[str, DataFrame]:
    """The sections of an index; its shape is checked, and its reference hash against a comma list if given."""
    names = ("refs", "bucket_stats", "profile_stats", "centroids", "partitions", "risky_stats", "build_info")
    index = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    missing = {*DIMS, "ref_id", "label", "bucket_key", "kd_key", "profile_key"} - set(index["refs"].columns)
    if missing:
        raise ValueError(f"the index lacks {sorted(missing)}")
    size = index["build_info"].agg(F.sum(F.octet_length("key") + F.octet_length("value") + 2)).first()[0] or 0
    if size > MOST_INFO_BYTES:
        raise ValueError(f"the index has {size} bytes of build info")
    found = {r["key"]: r["value"] for r in index["build_info"].where(F.col("key").isin("reference_sha256", "dim", "scale", "k")).collect()}
    if found.get("dim", str(len(DIMS))) != str(len(DIMS)) or found.get("scale", str(SCALE)) != str(SCALE) or found.get("k", str(K)) != str(K):
        raise ValueError("the index has another shape")
    allowed = {h.strip().lower() for h in allowed_hashes.split(",") if h.strip()}
    if allowed and found.get("reference_sha256", "").lower() not in allowed:
        raise ValueError("the index was built from other references")
    return index


def fast_paths_allowed(found_hash: str | None, allow_list: str) -> bool:
    """Shortcuts stay on only for indexes whose reference hash is on the list."""
    return bool(found_hash) and found_hash.lower() in {h.strip().lower() for h in allow_list.split(",")}
