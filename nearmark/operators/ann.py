"""Bucketed approximate search with its stop rules, and its exact fallbacks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIMS, K, SearchParams
from ..storage import written
from . import knn, stats
from .predicates import needs_exact, needs_full_tiebreak


#: Queries of one bucket that meet its references in one task, about.
QUERY_CHUNK = 20_000


def visits(sources: DataFrame, refs: DataFrame, p: SearchParams, order: DataFrame | None = None) -> DataFrame:
    """bucket_key, key, turn, start, take: the non-empty buckets that queries of a bucket may visit, in order, and rows to
    take of each."""
    filled = stats.bucket_histogram(refs)
    order = (order if order is not None else stats.neighbour_order(sources)).select("bucket_key", "key", "rank")
    known = order.join(F.broadcast(filled.withColumnRenamed("bucket_key", "key")), "key")
    ahead = Window.partitionBy("bucket_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    known = known.where((F.col("ahead") < p.min_candidates) & (F.col("ahead") < p.max_candidates))
    known = known.withColumn("take", F.least(F.col("n"), F.lit(p.max_candidates) - F.col("ahead")))
    return known.select("bucket_key", "key", F.col("rank").alias("turn"), "start", "take")


def strong(found: knn.Neighbours, at: np.ndarray, p: SearchParams) -> np.ndarray:
    """Whether the queries numbered at may stop early, by the labels met so far."""
    k = found.dist.shape[1]
    frauds = np.where(found.dist[at] < knn.FAR, found.label[at], 0).sum(1)
    return (frauds == 0) | (frauds == k) | (p.edge_fallback & ((frauds == 1) | (frauds == k - 1)))


class Buckets:
    """References as arrays by bucket, searched bucket after bucket with the stop rules."""

    def __init__(self, refs: knn.References, p: SearchParams):
        self.refs, self.p = refs, p

    def order(self, source: int) -> np.ndarray:
        """The filled buckets in the order in which queries of a bucket visit them."""
        key = self.refs.keys
        fields = [((key >> at) & mask, (source >> at) & mask) for at, mask in stats.FIELDS]
        gaps = [abs(k - s) for k, s in fields]
        ring = np.maximum.reduce([*gaps[:-1], 2 * gaps[-1]])
        return np.lexsort([k for k, _ in fields[::-1]] + [ring])

    def search(self, ids: np.ndarray, source: np.ndarray, q: np.ndarray, k: int = K) -> tuple[knn.Neighbours, np.ndarray]:
        """The nearest among the candidates, ties by scan position, and the number of candidates of each query."""
        out, scanned = knn.Neighbours.none(len(q), k), np.zeros(len(q), np.int64)
        own = self.refs._self(ids)
        for s in np.unique(source):
            at, seen, layout = np.flatnonzero(source == s), 0, []
            for b in self.order(int(s)):
                begin, end = int(self.refs.cuts[b]), int(self.refs.cuts[b + 1])
                take = min(end - begin, self.p.max_candidates - seen)
                if not len(at) or take <= 0:
                    break
                self.refs._compare(out, at, q, own, begin, begin + take, seen)
                layout.append((seen, begin))
                seen += take
                scanned[at] = seen
                if seen >= self.p.min_candidates:
                    break
                if seen >= self.p.early_candidates:
                    at = at[~strong(out, at, self.p)]
            if layout:  # scan positions back to references
                mine = np.flatnonzero(source == s)
                first, begin = np.array(layout).T
                there = out.dist[mine] < knn.FAR
                place = np.where(there, out.ref[mine], 0)
                piece = np.searchsorted(first, place, side="right") - 1
                out.ref[mine] = np.where(there, self.refs.ref[begin[piece] + place - first[piece]], out.ref[mine])
        return out, scanned


def search(queries: DataFrame, refs: DataFrame, p: SearchParams, order: DataFrame | None = None, own: str | None = None) -> DataFrame:
    """The top five among the candidates visited, ties by scan position; with candidates, the number scanned.

    Few references are broadcast by bucket and queries stream by; many, or an order of another kind, go through joins."""
    sent = None if order is not None else knn.send(refs.withColumn("kd_key", F.col("bucket_key")), own, knn.References)
    if sent is None:
        return search_by_joins(queries, refs, p, order, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(sent.value, p)
        for batch in batches:
            if batch.num_rows:
                ids, source, q = knn.arrays(batch)
                found, scanned = buckets.search(ids, source, q)
                rows = knn.as_rows(batch.column(0), found)
                candidates = pa.array(np.repeat(scanned, (found.dist < knn.FAR).sum(1)))
                yield pa.RecordBatch.from_arrays([*rows.columns, candidates], [*knn.RESULT, "candidates"])

    return knn.dealt(queries, len(sent.value.ref), "bucket_key").mapInArrow(run, knn.ROWS_SCHEMA + ", candidates long")


def search_by_joins(queries: DataFrame, refs: DataFrame, p: SearchParams, order: DataFrame | None = None, own: str | None = None) -> DataFrame:
    """search() for many references: queries of one bucket visit the same ones, so these meet each chunk of its queries.

    A bucket's queries meet max_candidates references at most, whatever the number of references."""
    spark = refs.sparkSession
    mine = F.col(own).cast("long") if own else F.lit(None).cast("long")
    q = queries.select("bucket_key", F.col("id").cast("long").alias("id"), knn.own_id(queries), *(F.col(d).cast("int").alias(d) for d in DIMS))
    counted = q.groupBy("bucket_key").agg(F.count("*").alias("n"))
    chunks = counted.select("bucket_key", F.ceil(F.col("n") / QUERY_CHUNK).cast("int").alias("chunks"))
    sizes = chunks.collect()  # 4096 rows at most
    chunks = F.broadcast(spark.createDataFrame(sizes, chunks.schema))
    way = F.broadcast(visits(queries.select("bucket_key").distinct(), refs, p, order))
    slim = refs.select(F.col("bucket_key").alias("key"), F.col("ref_id").cast("long").alias("id"), mine.alias("own"), F.col("label").cast("int").alias("label"), *(F.col(d).cast("int").alias(d) for d in DIMS))
    held = slim.join(way, "key").where(F.col("id") - F.col("start") < F.col("take")).join(chunks, "bucket_key").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sent = q.join(chunks, "bucket_key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    cell = ["bucket_key", "chunk", "none"]
    left = held.select("bucket_key", "chunk", F.lit(0).alias("none"), F.lit(0).alias("side"), "turn", "id", "own", "label", *DIMS)
    right = sent.select("bucket_key", "chunk", F.lit(0).alias("none"), F.lit(1).alias("side"), F.lit(0).alias("turn"), "id", F.col("own_id").alias("own"), F.lit(0).alias("label"), *DIMS)
    tasks = max(2 * sum(x["chunks"] for x in sizes), 2 * spark.sparkContext.defaultParallelism)
    both = left.unionByName(right).repartition(tasks, *cell).sortWithinPartitions(*cell, "side", "turn", F.when(F.col("side") == 0, F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for visited, part in knn.cells_with_queries(batches, lambda t: Visited(t, own is not None, p)):
            for a in range(0, part.num_rows, knn.BATCH):
                some = part.slice(a, knn.BATCH)
                q = np.stack([np.asarray(some.column(d)) for d in DIMS], 1)
                found, scanned = visited.search(np.asarray(some.column("own").fill_null(np.iinfo(np.int64).min + 1)), q)
                rows = knn.as_rows(some.column("id"), found)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.repeat(scanned, (found.dist < knn.FAR).sum(1)))], [*knn.RESULT, "candidates"])

    return both.mapInArrow(run, knn.ROWS_SCHEMA + ", candidates long")


class Visited:
    """The references that queries of one bucket may visit, in order of turn and ref_id."""

    def __init__(self, t: pa.Table, with_own: bool, p: SearchParams):
        own = np.asarray(t.column("own").fill_null(np.iinfo(np.int64).min)) if with_own else None
        vectors = np.stack([np.asarray(t.column(d)) for d in DIMS], 1).astype(np.int16)
        # Numbered as they come, which is the order that ties go by.
        self.refs = knn.References(np.arange(t.num_rows), np.asarray(t.column("label")), vectors, np.zeros(t.num_rows, np.int64), own)
        self.ids, self.p = np.asarray(t.column("id")), p
        self.turns = np.unique(np.asarray(t.column("turn")), return_index=True)[1]

    def search(self, ids: np.ndarray, q: np.ndarray, k: int = K) -> tuple[knn.Neighbours, np.ndarray]:
        out, scanned, at, own = knn.Neighbours.none(len(q), k), np.zeros(len(q), np.int64), np.arange(len(q)), self.refs._self(ids)
        for begin, end in zip(self.turns.tolist(), [*self.turns[1:].tolist(), len(self.ids)], strict=True):
            if not len(at):
                break
            self.refs._compare(out, at, q, own, begin, end)
            scanned[at] = end
            if end >= self.p.early_candidates:
                at = at[~strong(out, at, self.p)]
        there = out.dist < knn.FAR
        out.ref[there] = self.ids[out.ref[there]]
        return out, scanned


def risky_search(queries: DataFrame, refs: DataFrame, own: str | None = None) -> DataFrame:
    """The risky subset's top five; flagged queries are searched again over all references, as are all if the
    subset has fewer than five rows."""
    subset = refs.where("is_risky")
    if subset.limit(K).count() < K:
        return knn.flat(queries, refs, own=own)
    near = written(refs.sparkSession, f"risky {uuid.uuid4().hex}", lambda: knn.flat(queries, subset, own=own))
    counts = knn.fraud_counts(queries, near).join(queries, "id")
    again = counts.where(needs_full_tiebreak(F.col("frauds"))).select(queries.columns)
    full = knn.flat(again, refs, own=own)
    return near.join(again.select("id"), "id", "left_anti").unionByName(full)


def with_fallback(queries: DataFrame, refs: DataFrame, p: SearchParams, own: str | None = None) -> DataFrame:
    """search(); queries with fewer than five candidates, or that the fallback mode flags, are searched exactly.

    Adds path: ann_buckets, risky_flat_fallback or full_flat_fallback.  Ids have to differ (see knn.numbered)."""
    near = written(refs.sparkSession, f"near {uuid.uuid4().hex}", lambda: search(queries, refs, p, own=own))
    n = near.groupBy("id").agg(F.sum("label").cast("int").alias("frauds"), F.max("candidates").alias("candidates"))
    joined = queries.join(n, "id", "left").withColumns({"frauds": F.coalesce("frauds", F.lit(0)), "candidates": F.coalesce("candidates", F.lit(0))})
    few = F.col("candidates") < K
    flagged = ~few & needs_exact(F.col("frauds"), p)
    to_flat = joined.where(few | (flagged & F.lit(p.exact_fallback != "risky"))).select(queries.columns)
    to_risky = joined.where(flagged & F.lit(p.exact_fallback == "risky")).select(queries.columns)
    none = F.lit(None).cast("long").alias("candidates")
    exact = knn.flat(to_flat, refs, own=own).select(*knn.RESULT, F.lit("full_flat_fallback").alias("path"), none)
    if p.exact_fallback == "risky":
        exact = exact.unionByName(risky_search(to_risky, refs, own).select(*knn.RESULT, F.lit("risky_flat_fallback").alias("path"), none))
    kept = joined.where(~(few | flagged)).select("id")
    return near.select(*knn.RESULT, F.lit("ann_buckets").alias("path"), "candidates").join(kept, "id", "left_semi").unionByName(exact)
