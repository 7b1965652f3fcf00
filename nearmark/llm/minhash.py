"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1. One pass gives each text its shingle set's size, a 128-bit digest of the set (its class: equal sets are one
   class) and band hashes.  Every permutation yields two signature values, its minimum and its maximum, so 64
   permutations make 128 values in 32 bands of 4, each band's values being of four different permutations.
   A pair at similarity 0.8 shares no band with probability 5e-8.
2. Classes that share a band form groups, named after the band's smallest class.  Large groups are cut into
   blocks of bounded rows and bytes that all hold the group's first class.
3. Within a block an inverted index gives exact intersections; a breadth-first walk emits a spanning forest of
   the true links, never the pairs.  Groups of several blocks whose members did not end up in one component
   have the members outside their largest one compared with every other block.
4. Components of the links, then the smallest doc_id of each.

Rows are numbered when their signatures are written, so texts are looked up by a number of their own, whatever
repeats or is null among the ids.

Defined results: null, empty and blank texts have n_shingles 0, link with nothing and are their own component;
rows repeating a doc_id are documents of their own that share it; a null doc_id takes part, but names a
component only where no member has a doc_id (component null, kept false); a very long text is one set like any other,
and a block by itself beyond BLOCK_BYTES; an empty table gives an empty result; further columns play no part in
near_duplicates.  one_of_each() keeps one row of each component, of the smallest doc_id, then text hash, nulls last,
so rows that repeat one another leave one; rows without words all stay; all columns are carried through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Workspace, split_join
from .graph import components
from .shingles import MIX_1, WordHashes, mix, shingle_set

PERMUTATIONS = 64
BANDS = 32
WORDS = 5
PERCENT = 80
BLOCK_ROWS = 1000
BLOCK_BYTES = 16_000_000
SIGNATURE_SCHEMA = "doc_id long, text string, n_shingles long, node binary, hi long, n_bytes long, bands array<long>"


class MinMax:
    """Minimum and maximum of a set under each of n affine permutations of 64-bit values, banded."""

    def __init__(self, n: int = PERMUTATIONS, bands: int = BANDS):
        assert 2 * n == 4 * bands
        self.bands, self.n = bands, n
        seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * MIX_1)
        self.times, self.plus = seeds[:n] | np.uint64(1), seeds[n:]
        at = np.arange(bands)
        #: Rows of a band: two minima and two maxima, of four permutations.
        self.low = np.stack([at, at + bands], 1)
        self.high = np.stack([(at + 1) % n, (at + bands + 1) % n], 1)

    def signature(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(self.n, ~np.uint64(0)), np.zeros(self.n, np.uint64)
        for i in range(0, len(s), 4096):
            h = np.multiply.outer(self.times, s[i : i + 4096])
            h += self.plus[:, None]
            np.minimum(low, h.min(1), out=low)
            np.maximum(high, h.max(1), out=high)
        return low, high

    def band_hashes(self, s: np.ndarray) -> np.ndarray:
        low, high = self.signature(s)
        rows = np.concatenate([low[self.low], high[self.high], np.arange(self.bands, dtype=np.uint64)[:, None]], 1)
        return _row_hashes(rows)


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = mix(h ^ column) + MIX_1
    return h.view(np.int64)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, carry: bool = False) -> DataFrame:
    """A row for each row of docs: its number, doc_id, text and signature; carry adds the other columns as _rest."""
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("_rest")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([rest] if carry else []))
    schema = StructType([*(f for f in _parse_datatype_string(SIGNATURE_SCHEMA).fields), *slim.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, minmax = WordHashes(), MinMax()
        for batch in batches:
            sizes, nodes, his, lengths, bands = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                s = shingle_set(cache.of(text), k)
                sizes.append(len(s))
                lengths.append(len(text or ""))
                node = set_digest(s) if len(s) else None
                nodes.append(node)
                his.append(node and int.from_bytes(node[:8], "little", signed=True))
                bands.append(minmax.band_hashes(s) if len(s) else [])
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(his, pa.int64()), pa.array(lengths, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], schema.names)

    return slim.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id())


def linked(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets that span every component of the exact similarity graph."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if linked(sizes[0], sizes[1], both, percent) else []
    index = Postings(sets)
    new, out = np.ones(m, bool), []
    for first in range(m):
        if not new[first]:
            continue
        new[first], todo = False, [first]
        while todo:
            x = todo.pop()
            common = index.common(x)
            near = np.flatnonzero(new & (100 * common >= percent * (sizes[x] + sizes - common)))
            new[near] = False
            out += [(x, int(y)) for y in near]
            todo += near.tolist()
    return out


class Postings:
    """An inverted index from shingles to sets, for exact intersection sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.m, self.ends = len(sets), np.cumsum([len(s) for s in sets])
        _, self.terms = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(self.m), [len(s) for s in sets])
        self.owners = owner[np.argsort(self.terms, kind="stable")]
        self.sizes = np.bincount(self.terms)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def common(self, x: int) -> np.ndarray:
        terms = self.terms[self.ends[x - 1] if x else 0 : self.ends[x]]
        sizes, starts = self.sizes[terms], self.starts[terms]
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.owners[at], minlength=self.m)


def link_blocks(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links within blocks.  rows: p, block, probe (0/1), node, text, sorted so within partitions.

    A block's members (probe 0) are compared with each other; its probes, where it has any, with its members
    only, in chunks, so memory holds one block and one chunk."""

    def links(members: dict, probes: dict) -> list[tuple[bytes, bytes]]:
        nodes = [*members, *probes]
        if len(nodes) < 2 or not members:
            return []
        found = forest([members.get(n, probes.get(n)) for n in nodes], percent)
        return [(nodes[i], nodes[j]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        key, members, probes, probed = None, {}, {}, False

        def give(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

        for batch in batches:
            found = []
            p, block, probe, node, text = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                now = (p[i].as_py(), block[i].as_py())
                if now != key:
                    if probes or not probed:
                        found += links(members, probes)
                    key, members, probes, probed = now, {}, {}, False
                name, s = node[i].as_py(), shingle_set(cache.of(text[i].as_py()), k)
                if probe[i].as_py():
                    probes[name], probed = s, True
                    if len(probes) >= BLOCK_ROWS:
                        found += links(members, probes)
                        probes = {}
                else:
                    members[name] = s
            yield give(found)
        if probes or not probed:
            yield give(links(members, probes))

    dealt = rows.select("p", "block", "probe", "node", "text").repartition("p", "block").sortWithinPartitions("p", "block", "probe", "node")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    space = Workspace(spark, "near")
    rows = space.keep(signatures(docs, k), "signatures")
    named = classes(space, rows, k, percent)
    out = rows.select("doc_id", "n_shingles", "node").join(named.select("node", "component"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that another row of their component stands for."""
    space = Workspace(spark, "near")
    rows = space.keep(signatures(docs, k, carry=True), "signatures")
    named = classes(space, rows, k, percent)
    slim = rows.where("node is not null").select("node", "rid", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), "rid").alias("turn"))
    # Classes first, where copies are, then components; both are sums that each task begins by itself.
    first = slim.groupBy("node").agg(F.min("turn").alias("turn"))
    stays = first.join(named.select("node", "root"), "node").groupBy("root").agg(F.min("turn").alias("turn")).select("turn.rid")
    kept = rows.where("node is null").unionByName(rows.where("node is not null").join(stays, "rid", "left_semi"))
    return kept.select("_rest.*", "text").select(docs.columns)


def classes(space: Workspace, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root (of its component) and component (its smallest doc_id) of each class; rows as signatures() makes them."""
    spark = space.spark
    first = rows.where("node is not null").groupBy("node")
    nodes = first.agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid"), F.first("hi").alias("hi"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"))
    nodes = space.keep(nodes, "nodes")
    banded = nodes.select("node", "hi", "n_bytes", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("hi").alias("p"), F.max("hi").alias("q")).where("p <> q").select("band", "p")
    members = space.keep(split_join(banded, shared, "band").select("p", "node", "hi", "n_bytes").distinct(), "members")
    per = members.groupBy("p").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    cut = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = split_join(members, per.select("p", cut.alias("n_blocks")), "p")
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    everywhere = F.when((F.col("hi") == F.col("p")) & (F.col("n_blocks") > 1), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array(own))
    blocks = space.keep(dealt.select("p", "node", "n_blocks", own.alias("own"), F.explode(everywhere).alias("block")), "blocks")
    texts = rows.select("rid", "text")

    def with_text(placed: DataFrame) -> DataFrame:
        return placed.join(nodes.select("node", "rid"), "node").join(texts, "rid")

    links = space.keep(link_blocks(with_text(blocks.withColumn("probe", F.lit(0))), k, percent), "links")
    roots = components(links, space)
    several = blocks.where("n_blocks > 1")
    if not several.isEmpty():
        placed = several.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = space.keep(placed, "placed")
        sizes = placed.groupBy("p", "root").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("p").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        apart = split_join(placed, largest, "p").where("root <> largest and block = own")
        probes = apart.select("p", "node", F.col("own"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")).where("block <> own")
        base = split_join(placed, largest.select("p"), "p", "left_semi").where("block = own")
        again = base.select("p", "node", "block", F.lit(0).alias("probe")).unionByName(probes.select("p", "node", "block", F.lit(1).alias("probe")))
        more = space.keep(link_blocks(with_text(again), k, percent), "more")
        if not more.isEmpty():
            roots = components(links.unionByName(more), space, "cc2")
    roots = space.keep(roots, "roots")
    placed = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = roots.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    return split_join(placed, smallest, "root", "left").select("node", "root", F.coalesce("least", "rep").alias("component"))
