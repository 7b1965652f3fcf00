r"""Secret scanning behind a trigram index.

Each rule's regular expression is parsed into a Boolean query: the trigrams that any match must contain, as a
conjunction of disjunctions over its alternatives.  Documents are indexed in segments of bounded size: one
pass over a segment's bytes finds the postings (trigram -> documents) of the trigrams that some query needs, queries
intersect and unite them, and only the candidates are searched by the expression itself.  Rules without a
mandatory trigram (such as runs of hex digits) scan the whole segment.  Segments need no shuffle and keep
memory at one segment.  Matching is on code points of whole texts.

Base rules, leftmost and non-overlapping per kind, too short ones dropped after matching: assign, access, hex.
Further rules add spans of other well-known credential formats.

Defined results: null and empty texts have no spans; rows that repeat a doc_id are scanned each; null doc_ids
are carried; an empty table gives an empty result; further columns play no part; a very long text is one segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    fold: bool = False

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


#: Fixed patterns of the base rules, in the order in which spans at one start are listed.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
]
EXTRA = [
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live", r"[rs]k_live_[A-Za-z0-9]{16,}"),
]
RULES = BASE + EXTRA

#: Sets of strings longer than this are cut off: they no longer narrow a query.
MOST_STRINGS = 16


def trigrams_of(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


def exact_strings(items, fold: bool) -> list[set[str]]:
    """Cut a parsed sequence into stretches with few possible strings; what lies between may be anything.

    Returns one set of possible strings for each stretch; a match contains one of each set."""
    stretches: list[set[str]] = []
    now: set[str] = {""}

    def end() -> None:
        nonlocal now
        if now != {""}:
            stretches.append(now)
        now = {""}

    def add(options: set[str] | None) -> None:
        nonlocal now
        if options is None or len(now) * len(options) > MOST_STRINGS:
            end()
            now = options if options and len(options) <= MOST_STRINGS else {""}
        else:
            now = {a + b for a in now for b in options}

    for op, arg in items:
        if op is C.LITERAL:
            add({chr(arg).lower() if fold else chr(arg)})
        elif op is C.SUBPATTERN:
            inner = exact_strings(arg[3], fold)
            for k, options in enumerate(inner):
                if k or not _whole(arg[3]):
                    end()
                add(options)
            if not inner or not _whole(arg[3]):
                end()
        elif op is C.BRANCH:
            parts = [exact_strings(branch, fold) for branch in arg[1]]
            if all(len(p) == 1 and _whole(b) for p, b in zip(parts, arg[1], strict=True)):
                add(set().union(*(p[0] for p in parts)))
            else:
                end()
        elif op is C.IN:
            chars = {chr(a).lower() if fold else chr(a) for kind, a in arg if kind is C.LITERAL}
            add(chars if all(kind is C.LITERAL for kind, _ in arg) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            one = exact_strings(inner, fold)
            if low == 0 and high == 1 and len(one) == 1 and _whole(inner):
                add({""} | one[0])
            elif low >= 1 and len(one) == 1 and _whole(inner):
                add(one[0])
                end()
            else:
                end()
        else:
            end()
    end()
    return stretches


def _whole(items) -> bool:
    """Whether all of the sequence is literal characters, small sets and optional ones of these."""
    for op, arg in items:
        if op is C.LITERAL:
            continue
        if op is C.IN and all(kind is C.LITERAL for kind, _ in arg):
            continue
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and _whole(arg[2]):
            continue
        if op is C.SUBPATTERN and _whole(arg[3]):
            continue
        if op is C.BRANCH and all(_whole(b) for b in arg[1]):
            continue
        return False
    return True


def trigram_query(rule: Rule) -> list[list[set[str]]]:
    """AND over stretches of OR over strings of AND over trigrams (lower-cased); [] means: scan everything."""
    query = []
    for options in exact_strings(_parser.parse(rule.pattern), rule.fold):
        grams = [trigrams_of(s.lower()) for s in options]
        if all(grams):  # a string without a trigram says nothing
            query.append(grams)
    return query


class TrigramSegment:
    """Postings of the wanted trigrams over the texts of one segment, letters folded.

    Trigrams are read in pieces that overlap, so besides the bytes themselves memory holds one piece and the
    postings, also for one very long text."""

    PIECE = 1 << 20

    def __init__(self, texts: list[str], wanted: list[str], table: np.ndarray):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(texts)
        ends = np.cumsum([len(r) + 1 for r in raw])
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        found = [np.empty(0, np.int64)]
        for first in range(0, len(data) - 2, self.PIECE):
            piece = data[first : first + self.PIECE + 2].astype(np.int32)
            which = table[(piece[:-2] << 16) | (piece[1:-1] << 8) | piece[2:]]
            at = np.flatnonzero(which >= 0)
            doc = np.searchsorted(ends, at + first, side="right")
            found.append(np.unique(which[at].astype(np.int64) * self.n + doc))
        gram, doc = np.divmod(np.unique(np.concatenate(found)), self.n)
        cut = np.searchsorted(gram, np.arange(len(wanted) + 1))
        self.postings = {t: doc[cut[k] : cut[k + 1]] for k, t in enumerate(wanted)}

    def candidates(self, query: list[list[set[str]]]) -> np.ndarray:
        """Intersections of postings within an alternative, their union, and the intersection of stretches."""
        out = np.arange(self.n)
        for options in query:
            found = [np.empty(0, np.int64)]
            for grams in options:
                docs = None
                for g in grams:
                    docs = self.postings[g] if docs is None else np.intersect1d(docs, self.postings[g], assume_unique=True)
                found.append(docs)
            out = np.intersect1d(out, np.unique(np.concatenate(found)), assume_unique=True)
        return out


def spans_of(rule: Rule, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Scanner:
    """Rules with their queries; texts are indexed and searched in segments of bounded bytes."""

    SEGMENT_CHARS = 4_000_000

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, trigram_query(r), r.compiled) for r in rules]
        self.wanted = sorted({g for _, q, _ in self.rules for options in q for grams in options for g in grams})
        self.table = np.full(1 << 24, -1, np.int16)
        self.table[[int.from_bytes(t.encode(), "big") for t in self.wanted]] = np.arange(len(self.wanted))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str, int]]]:
        """For each text its (start, order of kind, kind, end), sorted."""
        out, segment, size = [], [], 0
        for text in texts:
            if segment and size + len(text) > self.SEGMENT_CHARS:
                out += self._segment(segment)
                segment, size = [], 0
            segment.append(text)
            size += len(text)
        return out + (self._segment(segment) if segment else [])

    def _segment(self, texts: list[str]) -> list[list]:
        out: list[list] = [[] for _ in texts]
        index = TrigramSegment(texts, self.wanted, self.table)
        for k, (rule, query, compiled) in enumerate(self.rules):
            for i in index.candidates(query):
                out[i] += [(start, k, rule.kind, end) for start, end in spans_of(rule, texts[i], compiled)]
        return [sorted(x) for x in out]


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_documents(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""
    rules = rules or RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, scanner = [r.kind for r in BASE], Scanner(rules)
        for batch in batches:
            found = scanner.scan([t.as_py() or "" for t in batch.column(1)])
            base = [[s for s in x if s[2] in kinds] for x in found]
            counts = [pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64()) for kind in kinds]
            digest = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digest, pa.array([joined(x) for x in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
