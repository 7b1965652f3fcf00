"""Shared pieces: tables, words, intermediate tables in the shared folder, skew-proof lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, remove

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = "[ \\t\\n\\x0B\\f\\r]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else.  Pure ASCII strings take the fast built-in lower()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    """The runs of non-blank characters, as an array; no words for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """How many words, without keeping them: pieces between blanks, less the empty one at either end."""
    text = F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, BLANK_CLASS + "+"))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also when body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Workspace:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors.

    Shuffle files of a finished step are removed with it, so a long operator holds one step's at a time.  The
    folder goes when the session's JVM ends, or earlier by drop() or by whoever collects spaces (see collected)."""

    _collector: ContextVar[list[Workspace] | None] = ContextVar("spaces", default=None)

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, new_folder(spark, label)
        self.tables: list[str] = []
        if (mine := Workspace._collector.get()) is not None:
            mine.append(self)

    @classmethod
    @contextmanager
    def collected(cls) -> Iterator[list[Workspace]]:
        """The spaces that are opened inside, and no others, for their owner to remove once its result is written."""
        spaces: list[Workspace] = []
        token = cls._collector.set(spaces)
        try:
            yield spaces
        finally:
            cls._collector.reset(token)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def keep_bucketed(self, df: DataFrame, name: str, buckets: int, *key: str) -> DataFrame:
        """As keep, bucketed and sorted by key: joins and aggregates by key read it without an exchange."""
        table = self.table_name(name)
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            out = df.write.bucketBy(buckets, *key).sortBy(*key).option("compression", "zstd").option("path", f"{self.path}/{name}")
            out.format("parquet").mode("overwrite").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def table_name(self, name: str) -> str:
        return f"nearmark_{self.path.rpartition('-')[2]}_{name.replace('-', '_')}"

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read again; '' removes all."""
        for name in names:
            for table in [t for t in self.tables if not name or t == self.table_name(name)]:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self.tables.remove(table)
            remove(self.spark, f"{self.path}/{name}" if name else self.path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting while the block runs; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores added until no frame has such a column (letter case aside)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join many to one (a row for each key, none null; how: inner, left or left_semi) so that AQE can split a hot key.

    Spark splits a skewed partition only where both sides come straight from exchanges of the join itself.  A grouped
    table is partitioned by its key already and gets none, so the key is compared as a struct."""
    name = free_name("_key", many, one)
    as_struct = F.struct(F.col(key)).alias(name)
    left = many.select(as_struct, *(c for c in many.columns if c != key))
    right = one.select(as_struct, *(c for c in one.columns if c != key))
    out = left.join(right, name, how)
    return out.select(F.col(name)[key].alias(key), *(c for c in out.columns if c != name))


#: At most this many keys count as heavy, so this many rows at most are broadcast.
HEAVY_KEYS = 2048


def lookup(many: DataFrame, one: DataFrame, key: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join many to one (a row for each key) without a hot key meeting in one task.

    weight: column of one with the number of rows of many that have the key; total: their sum.  Keys with
    more than total / HEAVY_KEYS rows are fewer than HEAVY_KEYS, so those rows of one are broadcast; the rest
    goes through a shuffle in which no key is larger than that.  Null keys find nothing."""
    limit = max(total // HEAVY_KEYS, 1)
    heavy = one.where(F.col(weight) > limit).drop(weight).withColumn("_heavy", F.lit(True))
    light = one.where(F.col(weight) <= limit).drop(weight)
    marked = many.join(F.broadcast(heavy), key, "left")
    value = [c for c in light.columns if c not in key]
    by_heavy = marked.where("_heavy").drop("_heavy")
    rest = marked.where("_heavy is null").drop("_heavy", *value).join(light, key, how)
    return by_heavy.unionByName(rest)
