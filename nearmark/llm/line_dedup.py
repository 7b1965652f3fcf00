"""Line deduplication over levelled sorted runs of line hashes.

Line hashes live in sorted runs: Parquet tables bucketed and sorted by key.  A new batch of documents is
merge-joined to the runs that are there, which reads them in order without an exchange or a sort: keys the runs
lack (the anti-joined part) enter with their keeper, the batch's largest doc_id; keys they have only add to the
count.  The batch's own run goes to level 0; whenever a level holds ``fanout`` runs they are compacted into one
run of the next level, bucket by bucket.  The list of runs is written with them, so that LineRuns.load() goes on
where another session stopped.  Batches come by falling doc_id, cut at quantiles of the ids, so the first keeper
of a key is its largest doc_id.  Everything is DataFrame code; what moves between executors is hashes, and the
texts once.

Defined results: null and empty text is one empty line, which no rule drops; documents with a null doc_id
count nowhere and keep all lines; rows that repeat a doc_id count as one document, and rows alike in doc_id and
text lose the same lines each; any doc_id of 64 bits will do; a very long text is one row like any other, its
lines one array; an empty table gives an empty result; columns n_lines, n_dropped and kept_text of the input are
replaced, further ones are carried through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Workspace, ascii_lower, free_name, lookup, setting

MIN_CHARS = 40
MIN_DOCS = 5
N_BATCHES = 6
FANOUT = 3
#: A run has a bucket for each so many of all line hashes, and so many buckets at least and at most.
ROWS_A_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 1_000_000, 8, 50_000
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def row_id(text: Column) -> Column:
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, pos and 128-bit key hash of each line whose key has min_chars code points."""
    hashed = F.transform(
        split_lines(F.col("text")),
        lambda line, pos: F.transform(
            F.array(line_key(line)),
            lambda key: F.when(
                F.length(key) >= min_chars,
                F.struct(pos.alias("pos"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")),
            ),
        ),
    )
    lines = F.filter(F.flatten(hashed), lambda x: x.isNotNull())
    return docs.where("doc_id is not null").select("doc_id", row_id(F.col("text")).alias("row"), F.inline(lines))


def batch_of(docs: DataFrame, n_batches: int) -> Column:
    """The batch of a row, 0 for the largest ids: about equal parts, cut at quantiles of doc_id."""
    shares = [k / n_batches for k in range(1, n_batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts")).first()["cuts"] if shares else None
    return sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))


class LineRuns:
    """The levels of runs: h1, h2, n_docs (of one batch or several), keeper (null where an older run has it)."""

    def __init__(self, space: Workspace, fanout: int = FANOUT, buckets: int = MIN_BUCKETS):
        self.space, self.fanout, self.buckets = space, fanout, buckets
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.made = 0

    def _runs(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def _write(self, run: DataFrame, level: int) -> None:
        name, self.made = f"run-{self.made}", self.made + 1
        while len(self.levels) <= level:
            self.levels.append([])
        # No more tasks than buckets write a run, so that it has few files whatever the shuffle's width.
        self.levels[level].append((name, self.space.keep_bucketed(run.coalesce(self.buckets), name, self.buckets, *KEY)))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join one batch (doc_id, h1, h2) to the runs, then add its own run."""
        own = batch.groupBy(*KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        own = own.repartition(self.buckets, *KEY)
        with in_order(self.space.spark):
            for k, run in enumerate(self._runs()):
                held = run.where("keeper is not null").select(*KEY, F.lit(True).alias(f"in_{k}"))
                own = own.hint("merge").join(held, KEY, "left")
            found = [F.col(f"in_{k}").isNotNull() for k in range(len(self._runs()))]
            new = ~sum((f.cast("int") for f in found), F.lit(0)).cast("boolean")
            self._write(own.select(*KEY, "n_docs", F.when(new, F.col("keeper")).alias("keeper")), 0)
            level = 0
            while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                self._compact(level)
                level += 1

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._merge(old, level + 1)

    def _merge(self, old: list[tuple[str, DataFrame]], level: int) -> None:
        with by_rows(self.space.spark):
            self._write(merge_runs([df for _, df in old]), level)
        self.space.drop(*(name for name, _ in old))

    def close(self) -> DataFrame:
        """One run of all batches so far, on a level above the others."""
        old = [x for level in self.levels for x in level]
        if len(old) > 1:
            self.levels = [[] for _ in self.levels]
            self._merge(old, len(self.levels))
        return self._runs()[0]

    def save(self) -> str:
        """Write the list of runs beside them; returns the folder that load() takes."""
        rows = [(level, name, self.fanout, self.buckets, self.made) for level, runs in enumerate(self.levels) for name, _ in runs]
        self.space.keep(self.space.spark.createDataFrame(rows, "level int, name string, fanout int, buckets int, made int").coalesce(1), "list")
        return self.space.path

    @staticmethod
    def load(spark: SparkSession, path: str) -> LineRuns:
        """The runs that save() left in a folder, as they lie there."""
        rows = spark.read.parquet(f"{path}/list").orderBy("level", "name").collect()  # a few rows a level
        out = LineRuns(Workspace(spark, "lines"), rows[0]["fanout"], rows[0]["buckets"])
        for r in rows:
            while len(out.levels) <= r["level"]:
                out.levels.append([])
            table = out.space.table_name(f"old-{r['name']}")
            columns = "h1 BIGINT, h2 BIGINT, n_docs BIGINT, keeper BIGINT"
            cut = f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {r['buckets']} BUCKETS"
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {cut} LOCATION '{path}/{r['name']}'")
            out.space.tables.append(table)
            out.levels[r["level"]].append((f"old-{r['name']}", spark.table(table)))
        out.made = rows[0]["made"]
        return out


def in_order(spark: SparkSession):
    """While it holds, a run with one file a bucket counts as sorted, as it was written."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def by_rows(spark: SparkSession):
    """While it holds, runs are read as rows: over columnar scans Spark 4.1's union takes equal buckets for aligned
    but lays the partitions end to end, so that an aggregate without an exchange would be wrong."""
    return setting(spark, "spark.sql.parquet.enableVectorizedReader", "false")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """The runs' counts and keepers by key, bucket by bucket; to be planned and run under by_rows()."""
    all_rows = runs[0]
    for run in runs[1:]:
        all_rows = all_rows.unionByName(run)
    return all_rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def dedup_lines(
    spark: SparkSession,
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    n_batches: int = N_BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Drop lines whose key is in min_docs documents or more, but for those of the largest doc_id.

    Returns docs' own columns with the new text as kept_text, and n_lines (before) and n_dropped."""
    space = Workspace(spark, "lines")
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    batched = line_hashes(slim, min_chars).withColumn("batch", batch_of(slim, n_batches))
    # One table, in order of batches: a batch's scan skips the pages of the others.
    hashes = space.keep(batched.sortWithinPartitions("batch"), "hashes")
    buckets = min(max(-(-hashes.count() // ROWS_A_BUCKET), MIN_BUCKETS), MAX_BUCKETS)
    runs = LineRuns(space, fanout, buckets)
    for k in range(n_batches):
        runs.add(hashes.where(F.col("batch") == k).select("doc_id", *KEY))
    common = space.keep(runs.close().where(F.col("n_docs") >= min_docs), "common")
    runs.save()
    total = common.agg(F.sum("n_docs")).first()[0] or 0
    out = lookup(hashes.select("doc_id", "row", "pos", *KEY), common, KEY, "n_docs", total)
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    doc, row, drop = (free_name(n, docs) for n in ("_doc", "_row", "_drop"))
    drops = out.where("doc_id < keeper").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("pos").alias(drop))
    joined = docs.join(drops, (F.col("doc_id").cast("long") == F.col(doc)) & (row_id(F.col("text")) == F.col(row)), "left")
    lines = split_lines(F.col("text"))
    kept = F.when(F.col(drop).isNull(), F.coalesce("text", F.lit(""))).otherwise(let_lines(lines, F.col(drop)))
    return joined.withColumns({
        "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long"), "kept_text": kept,
    }).drop(doc, row, drop)


def let_lines(lines: Column, gone: Column) -> Column:
    """The lines at the positions that are not in gone, joined; set difference keeps the order."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    picked = F.transform(F.array(lines), lambda a: F.concat_ws("\n", F.transform(stay, lambda i: F.get(a, i))))
    return F.element_at(picked, 1)
