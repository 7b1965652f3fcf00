"""Benchmark decontamination: SimHash fingerprints of item-sized windows, verified on weighted shingles.

Each benchmark item of m words has a 64-bit SimHash of its weighted five-word shingles (a shingle weighs as
often as it occurs).  A document's windows of m words are fingerprinted alike and looked up in a multi-index:
fingerprints are cut into blocks, items are filed by the value of each block, and a window looks up all values near
its own: within RADIUS // BLOCKS bits in the first RADIUS % BLOCKS + 1 blocks and one bit less in the others.  Were
an item within RADIUS bits further off in every block, its distance would exceed RADIUS; so none is missed.  About a
fifth of all items share a block entry with any one window, and about one in 1000 is within the radius.
Candidates within the radius are verified by the exact weighted similarity sum(min) / sum(max) >= 0.8; texts that
similar are about 10 bits apart, more than 18 in one of about 1000 cases (the test measures it).  Windows are
fingerprinted only where enough of their shingles occur in the benchmark at all for that similarity, which loses
nothing.

The benchmark is read in blocks of bounded bytes; each block's index is broadcast and documents are scanned
once a block, without a shuffle, whatever the block's number.

Defined results: null, empty and blank texts and items match nothing; items of fewer than five words are one
shingle, so an item of one or two words is found in every text that holds them (min_words leaves short items out, 1
by default: none); a document shorter than an item is compared as a whole; a very long text is searched window by
window like any other; of an item's windows in a text the most similar counts, on ties the first; rows that repeat a
doc_id are each searched, and items that repeat an item_id each reported; empty tables give no hits; further columns
play no part (find_leaks) or are carried through (drop_leaks).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import WordHashes, sequence_hashes

WORDS = 5
PERCENT = 80
BLOCKS, RADIUS = 5, 18
#: Bytes of benchmark text in one broadcast index.
INDEX_BYTES = 8_000_000
HIT_SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"

_BITS = np.arange(64, dtype=np.uint64)


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 values +1 / -1 for each shingle."""
    return ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """The SimHash bits of rows of 64 sums."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


class MultiIndex:
    """Items' fingerprints by block value; finds all items within RADIUS."""

    def __init__(self, prints: np.ndarray, blocks: int = BLOCKS, radius: int = RADIUS):
        self.prints, self.radius, self.blocks = prints, radius, []
        ends = [64 * (b + 1) // blocks for b in range(blocks)]
        for b, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
            n, most = high - low, radius // blocks - (b > radius % blocks)
            near = np.array([m for m in range(1 << n) if m.bit_count() <= most], np.int64)
            value = ((prints >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.blocks.append((low, (1 << n) - 1, near, order, np.searchsorted(value[order], np.arange((1 << n) + 1))))

    def candidates(self, fp: int) -> np.ndarray:
        """The items that share a block entry with the fingerprint."""
        found = []
        for low, mask, near, order, starts in self.blocks:
            values = near ^ ((fp >> low) & mask)
            first, size = starts[values], starts[values + 1] - starts[values]
            first, size = first[size > 0], size[size > 0]
            found.append(order[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())])
        return np.unique(np.concatenate(found))

    def near(self, fp: int) -> list[tuple[int, int]]:
        items = self.candidates(fp)
        distance = np.bitwise_count(self.prints[items] ^ np.uint64(fp))
        return [(int(i), int(d)) for i, d in zip(items, distance, strict=True) if d <= self.radius]


def weighted_similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """sum(min), sum(max) of two bags of shingles."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common, sum(a.values()) + sum(b.values()) - common


class BenchmarkIndex:
    """The items of one block: shingle bags and multi-indexes by item size."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 1):
        cache = WordHashes()
        by_size: dict[int, list[tuple[int, Counter, np.uint64]]] = {}
        for item_id, text in items:
            w = cache.of(text)
            if len(w) >= max(min_words, 1):
                s = sequence_hashes(w, WORDS)
                by_size.setdefault(len(w), []).append((item_id, Counter(s.tolist()), fingerprint(signs(s).sum(0)[None])[0]))
        self.sizes, known = {}, {}
        for m, v in sorted(by_size.items()):
            own = {s for _, bag, _ in v for s in bag}
            known.setdefault(min(WORDS, m), set()).update(own)
            self.sizes[m] = (MultiIndex(np.array([x[2] for x in v], np.uint64)), v, np.array(sorted(own), np.uint64))
        self.anchors = {k: np.array(sorted(v), np.uint64) for k, v in known.items()}

    def hits(self, w: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """item_id, similarity, start, words, distance of the best window for each item found in the words w."""
        best: list[tuple] = []
        shingles, shared = {}, {}
        for k, anchors in self.anchors.items():
            if len(w) >= k:
                shingles[k] = sequence_hashes(w, k)
                shared[k] = np.flatnonzero(_is_in(shingles[k], anchors))
        if not any(map(len, shared.values())):
            return []
        for m, (index, items, own) in self.sizes.items():
            k = min(WORDS, m)
            at = shared.get(k, ())
            if not len(at) or not len(at := at[_is_in(shingles[k][at], own)]):
                continue
            s = shingles[k]
            width = min(m - k + 1, len(s))  # shingles in a window
            upto = np.zeros(len(s) + 1, np.int64)
            upto[at + 1] = 1
            upto = np.cumsum(upto)
            known = upto[width:] - upto[:-width]
            best_of: dict[int, tuple] = {}
            starts = np.flatnonzero((100 + PERCENT) * known >= PERCENT * (width + m - k + 1))
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1) if len(starts) else ():
                lo, hi = run[0], run[-1] + width
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(s[lo:hi]), 0, dtype=np.int32)])
                prints = fingerprint(sums[run - lo + width] - sums[run - lo])
                for start, fp in zip(run.tolist(), prints.tolist(), strict=True):
                    for i, distance in index.near(int(fp)):
                        item_id, bag, _ = items[i]
                        common, union = weighted_similarity(Counter(s[start : start + width].tolist()), bag)
                        if 100 * common >= PERCENT * union and (i not in best_of or common / union > best_of[i][1]):
                            best_of[i] = (item_id, common / union, start, min(m, len(w)), distance)
            best += best_of.values()
        return best


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded bytes; only one list is held at a time."""
    block, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].encode("utf-8", "surrogatepass"))
        if size >= INDEX_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = 1) -> DataFrame:
    """A row for each document and benchmark item of which it holds a near copy."""
    out = spark.createDataFrame([], HIT_SCHEMA)
    for block in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(BenchmarkIndex(block, min_words))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            names = ["doc_id", "item_id", "similarity", "start_word", "n_words", "distance"]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
            for batch in batches:
                rows = [(batch.column(0)[i].as_py(), *hit) for i, text in enumerate(batch.column(1)) for hit in index.value.hits(cache.of(text.as_py()))]
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HIT_SCHEMA))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = 1) -> DataFrame:
    """The rows of docs that hold no near copy of a benchmark item."""
    text_at = docs.columns.index("text")
    for block in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(BenchmarkIndex(block, min_words))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                clean = [not index.value.hits(cache.of(text.as_py())) for text in batch.column(text_at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
