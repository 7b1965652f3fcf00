"""Token counts by section: whole documents are encoded once and token spans are joined to section spans.

Sections tile the text: each line with its line feed is one.  Byte-level tokens tile the text's bytes, so the
running sum of token lengths gives every token's span, and an interval join over two sorted arrays attributes
tokens to sections.  A token that crosses a boundary goes by an explicit rule: 'start' (the section of its first
byte), 'end' (of its last byte), 'most' (the section with most of its bytes, the earlier one on a tie) or
'share' (to each by its bytes; fractional counts).  Under the first three, counts add up to the document's.

The vocabulary file is read by the driver, checked to be small, and broadcast.

Long runs of white space are cut out before encoding, just where the split pattern cuts them (all of a run but its
last character is one piece, or all of it at the end of the text), as the pattern's matcher fails on them.

Defined results: null and empty texts are one empty section without tokens; null doc_ids are carried; rows that
repeat a doc_id are counted each; a very long text, or one long run of any character, is encoded like any other; on
ties 'most' takes the earlier section; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The fixed pattern that splits text before merges of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed: white space as the pattern means it; runs of so many characters are cut out beforehand.
LONG_BLANK = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
MOST_BYTES = 64_000_000
RULES = ("start", "end", "most", "share")
SCHEMA = "doc_id long, section int, n_bytes long, n_tokens double, n_crossing long"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes; such a vocabulary isn't broadcast")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("sections", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for m in LONG_BLANK.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def ends(self, text: str) -> np.ndarray:
        """The end of each token in bytes; a token starts where the one before ends."""
        return np.cumsum(self.sizes[np.array(self.encode(text), np.int64)])


def section_ends(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([np.flatnonzero(raw == 10) + 1, [len(raw)]]).astype(np.int64)


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross a boundary; both given by ends."""
    assert rule in RULES
    starts = np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens
    m = len(sections)
    first = np.minimum(np.searchsorted(sections, starts, side="right"), m - 1)
    last = np.minimum(np.searchsorted(sections, tokens - 1, side="right"), m - 1)
    counts = np.zeros(m)
    crossing = np.flatnonzero(first < last)
    whole = np.ones(len(tokens), bool)
    whole[crossing] = rule in ("start", "end")
    np.add.at(counts, (last if rule == "end" else first)[whole], 1)
    touched = np.zeros(m, np.int64)
    for t in crossing:
        here = np.arange(first[t], last[t] + 1)
        touched[here] += 1
        begins = np.concatenate([[0], sections])[here]
        parts = np.minimum(sections[here], tokens[t]) - np.maximum(begins, starts[t])
        if rule == "most":
            counts[here[parts.argmax()]] += 1
        elif rule == "share":
            counts[here] += parts / parts.sum()
    return counts, touched


def count_sections(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """doc_id, section (from 0), n_bytes, n_tokens and n_crossing for each line of each document."""
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            ids, lengths, sizes, counts, crossing = batch.column(0), [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ends = section_ends(text)
                n, touched = attribute(encoder.ends(text), ends, rule)
                lengths.append(len(ends))
                sizes.append(np.diff(ends, prepend=0))
                counts.append(n)
                crossing.append(touched)
            if not lengths:
                continue
            lengths = np.array(lengths)
            section = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [
                ids.take(pa.array(np.repeat(np.arange(len(lengths)), lengths))), pa.array(section.astype(np.int32)),
                pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(crossing)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "n_bytes", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
