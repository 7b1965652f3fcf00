"""Substring deduplication by sliding runs of consecutive sentences.

From every sentence a run reaches over following ones, and up to every sentence one over those before it, until
it has MIN_SENTENCES sentences and MIN_WORDS words; besides, one sentence of LONE_WORDS words is a run by itself.
Every longer run is a union of such shortest ones, so a passage shared by two documents is covered from its first
sentence to its last.  Runs are hashed to 128 bits; of equal runs the one with the smallest (doc_id, position)
stays and sentences covered by any other are removed.

Each batch of documents settles its own repeats: all but the first of equal runs in it are known to be non-first,
so a run is passed on once a batch, however common it is.  What is passed on is packed by hash range into binary
columns and written; by its number the ranges are cut further, so that each has about RANGE_RUNS runs, and met in one
shuffle.  Each range is resolved over sorted arrays.

Defined results: null and empty texts have no sentence and lose nothing; a null doc_id comes before all others;
rows alike in doc_id and text count as one document; an empty table gives an empty result; further columns are
carried through by remove_repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

MIN_SENTENCES = 2
MIN_WORDS = 20
LONE_WORDS = 40
#: Hash ranges of a batch, and how many runs (of 40 bytes) a range has that is resolved in one task step.
RANGES = 1024
RANGE_RUNS = 1_000_000
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
COVER_SCHEMA = "doc_id long, row long, first int, last int"
_NONE = -(1 << 63)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans that tile the text: a sentence ends after '.', '!' or '?' before white space, or at a line feed;
    the white space after it belongs to it."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    starts = [0, *ends[:-1]]
    return [(a, b) for a, b in zip(starts, ends, strict=True) if b > a]


def runs(text: str, least: int = MIN_SENTENCES, words: int = MIN_WORDS, lone: int = LONE_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, last sentence, digest) of the shortest runs from and up to each sentence, by position."""
    parts = [text[a:b].lower().split() for a, b in sentences(text)]
    upto = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    n = len(parts)
    at = np.arange(n)
    filled = upto[1:] > upto[:-1]
    ends = np.maximum(at + least - 1, np.searchsorted(upto, upto[:-1] + words) - 1)
    starts = np.minimum(at - least + 1, np.searchsorted(upto, upto[1:] - words, "right") - 1)
    found = {(i, int(ends[i])) for i in np.flatnonzero(filled & (ends < n)).tolist()}
    for j in np.flatnonzero(filled & (starts >= 0)).tolist():
        if filled[starts[j]]:
            found.add((int(starts[j]), j))
    found.update((i, i) for i in np.flatnonzero(np.diff(upto) >= lone).tolist())
    raw = ["\x1f".join(p).encode("utf-8", "surrogatepass") for p in parts]
    return [(i, j, xxhash.xxh3_128_digest(b"\x1f".join(raw[i : j + 1]))) for i, j in sorted(found)]


def _covers(rows: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(rows["doc"], mask=rows["doc"] == _NONE)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(rows[c]) for c in ("row", "first", "last"))], ["doc_id", "row", "first", "last"])


RUN = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("first", "<i4"), ("last", "<i4")])


def split_first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal runs by (doc, row, position), and all the others.

    Rows alike in doc and row are one document, so their equal entries count once, from whatever batches they come."""
    rows = rows[np.lexsort((rows["first"], rows["row"], rows["doc"], rows["h2"], rows["h1"]))]
    again = np.zeros(len(rows), bool)
    again[1:] = np.all([rows[c][1:] == rows[c][:-1] for c in ("h1", "h2", "doc", "row", "first")], axis=0)
    rows = rows[~again]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
    return rows[new], rows[~new]


def batch_runs(batch: pa.RecordBatch) -> np.ndarray:
    found, seen = [], set()
    for i in range(batch.num_rows):
        doc, row, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or ""
        if (doc, row) in seen:
            continue  # the same document again
        seen.add((doc, row))
        made = runs(text)
        if made:
            block = np.empty(len(made), RUN)
            digests = np.frombuffer(b"".join(d for _, _, d in made), "<u8").reshape(-1, 2)
            block["h1"], block["h2"] = digests.T
            block["doc"], block["row"] = _NONE if doc is None else doc, row
            block["first"], block["last"] = [a for a, _, _ in made], [b for _, b, _ in made]
            found.append(block)
    return np.concatenate(found) if found else np.empty(0, RUN)


def pack(rows: np.ndarray) -> bytes:
    """Columns one after the other, doc and row by runs of equal values, as they repeat."""
    cut = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["row"][1:] != rows["row"][:-1])]))
    head = np.array([len(rows), len(cut)], "<i8").tobytes()
    lengths = np.diff(np.append(cut, len(rows))).astype("<i4")
    span = (rows["last"] - rows["first"]).astype("<i4")
    return b"".join([head, *(rows[c].tobytes() for c in ("h1", "h2", "first")), span.tobytes(), lengths.tobytes(), rows["doc"][cut].tobytes(), rows["row"][cut].tobytes()])


def unpack(raw: bytes) -> np.ndarray:
    n, k = np.frombuffer(raw, "<i8", 2)
    out, at = np.empty(n, RUN), 16
    for name, kind, size in (("h1", "<u8", n), ("h2", "<u8", n), ("first", "<i4", n), ("last", "<i4", n)):
        out[name] = np.frombuffer(raw, kind, size, at)
        at += size * np.dtype(kind).itemsize
    out["last"] += out["first"]
    lengths = np.frombuffer(raw, "<i4", k, at)
    at += 4 * k
    out["doc"] = np.repeat(np.frombuffer(raw, "<i8", k, at), lengths)
    out["row"] = np.repeat(np.frombuffer(raw, "<i8", k, at + 8 * k), lengths)
    return out


def by_range(rows: np.ndarray, ranges: int) -> tuple[list[int], list[bytes]]:
    """rows packed by hash range; ranges: 2**23 at most."""
    part = (rows["h1"] >> np.uint64(24)).astype(np.int64) * ranges >> 40
    rows = rows[np.lexsort((rows["first"], rows["row"], rows["doc"], part))]
    part = np.sort(part, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    return [int(part[c]) for c in cut], [pack(r) for r in np.split(rows, cut[1:])] if len(cut) else []


def _packs(parts: list[int], packs: list[bytes]) -> pa.RecordBatch:
    sizes = [int(np.frombuffer(p, "<i8", 1)[0]) for p in packs]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(packs, pa.binary())], ["part", "n", "runs"])


PACKS = "part int, n long, runs binary"


def covered_runs(spark: SparkSession, docs: DataFrame, space: Workspace, ranges: int = RANGES) -> DataFrame:
    """doc_id, row, first, last of every non-first run of sentences."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, others = split_first(batch_runs(batch))
            parts, packs = by_range(first, ranges)
            if len(others):
                parts, packs = [*parts, -1], [*packs, pack(others)]
            yield _packs(parts, packs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held:
                    yield _covers(split_first(np.concatenate(held))[1])
                    held = []
                now = part
                held.append(unpack(raw.as_py()))
        if held:
            yield _covers(split_first(np.concatenate(held))[1])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                yield _covers(unpack(raw.as_py()))

    row = F.xxhash64(F.coalesce("text", F.lit("")))
    packed = space.keep(docs.select(F.col("doc_id").cast("long"), row.alias("row"), "text").mapInArrow(local, PACKS), "runs")
    firsts, total = packed.where("part >= 0"), packed.where("part >= 0").agg(F.sum("n")).first()[0] or 0
    finer = min(-(-total // RANGE_RUNS), 1 << 23)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(2):
                yield _packs(*by_range(unpack(raw.as_py()), finer))

    if finer > ranges:
        firsts = firsts.mapInArrow(cut, PACKS)
    met = firsts.select("part", "runs").repartition("part").sortWithinPartitions("part").mapInArrow(meet, COVER_SCHEMA)
    return packed.where("part < 0").select("part", "runs").mapInArrow(unpacked, COVER_SCHEMA).unionByName(met)


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with n_sentences, n_removed, removed (sentence numbers) and kept_text."""
    docs = docs.drop("n_sentences", "n_removed", "removed", "kept_text")  # such columns are replaced
    space = Workspace(spark, "sentences")
    covers = covered_runs(spark, docs, space)
    per = covers.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    per = space.keep(per.withColumnsRenamed({"doc_id": "_doc", "row": "_row"}), "covers")
    row = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(per, docs["doc_id"].cast("long").eqNullSafe(per["_doc"]) & (row == per["_row"]), "left").drop("_doc", "_row")
    text_at, schema = docs.columns.index("text"), docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py() or ""
                parts = sentences(text)
                out = sorted({k for s in spans.as_py() or () for k in range(s["first"], s["last"] + 1)})
                gone = set(out)
                totals.append(len(parts))
                removed.append(out)
                kept.append("".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in gone))
            columns = [*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array(list(map(len, removed)), pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_sentences", "n_removed", "removed", "kept_text"])

    out = T.StructType([*schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(cut, out)
