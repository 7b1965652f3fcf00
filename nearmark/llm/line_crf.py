"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad.  Its features are statistics of the line itself, of the lines before and after it,
and whether it repeats an earlier line; a transition matrix couples neighbours.  A document's score is the mean
of its lines' forward-backward marginals of 'good', weighted by line length.

Training maximises the conditional log-likelihood of the line labels (each line takes its document's label), a
document's weighted by 1 / its lines so that each document counts once, with a quadratic penalty.  It learns from a
sample of labelled rows, whole texts in order of a hash of doc_id: FIT_DOCS documents at most, and no further ones
once FIT_LINES lines are reached; both bounds are parameters.  Only statistics of those lines reach the driver.
Scoring covers whole texts in one pass without a shuffle.

Defined results: null and empty texts are one empty line and get that line's marginal; a very long text is one chain
like any other; without labels every score is 0.5; of two labels of a doc_id the lower counts, of several texts under
a sampled doc_id the least by code point; a null doc_id counts as held out; rows repeating a doc_id are scored each;
an empty table gives an empty result; labels, lang, source, doc_id and further columns never enter a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIT_DOCS = 4000
FIT_LINES = 400_000
ROUNDS = 120
RATE = 0.1
SHRINK = 1e-3
CUT = 0.3
LINES_AT_ONCE = 4000
FOLDS = 5

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
#: Statistics of a line by itself; the rest of the features are derived from these rows.
OWN = 11


def line_statistics(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of OWN statistics for each line, and the lines' lengths in code points."""
    lines = (text or "").split("\n")
    rows, seen, before = np.zeros((len(lines), OWN), np.float32), set(), None
    for i, line in enumerate(lines):
        b = line.encode("utf-8", "surrogatepass")
        key = xxhash.xxh3_64_intdigest(b)
        n = max(len(b), 1)
        w = b.split()
        k = max(len(w), 1)
        pairs = max(len(w) - 1, 1)
        letters = max(n - len(b.translate(None, _LETTERS)), 1)
        rows[i] = (
            np.log1p(len(w)),
            (n - len(b.translate(None, b"#*$%&|<>"))) / n * 10,
            (n - len(b.translate(None, _UPPER))) / letters,
            (n - len(b.translate(None, _DIGITS))) / n,
            (n - len(b.translate(None, b"!?"))) / n * 10,
            min(sum(map(len, w)) / k, 20) / 5,
            len(set(w)) / k,
            len(set(zip(w, w[1:], strict=False))) / pairs,
            key in seen if w else 0.0,
            line == before if w else 0.0,
            not w,
        )
        seen.add(key)
        before = line
    return rows, np.array([len(x) for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """own, previous line, next line, first, last, 1."""
    edge = np.zeros((1, own.shape[1]), own.dtype)
    flags = np.zeros((len(own), 3), own.dtype)
    flags[0, 0] = flags[-1, 1] = 1
    flags[:, 2] = 1
    return np.concatenate([own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge]), flags], 1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, shares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected moves (of each sequence times its share), for sequences laid end to end.

    scores: log-odds of good by line; moves: 2x2 log weights from state to next state.  All sequences advance
    together; those that ended drop out, so the work is one array step for each line of the longest."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # sequences longer than t
    e = np.stack([np.zeros_like(scores), scores], 1)
    e = np.exp(e - e.max(1, keepdims=True))
    step = np.exp(moves)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(longest):
        at = starts[: active[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ step) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    shares = (np.ones(len(lengths)) if shares is None else shares)[order]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = e[at + 1] * beta[at + 1]
        pair = alpha[at][:, :, None] * step * ahead[:, None, :]
        expected += (pair * (shares[: active[t + 1]] / pair.sum((1, 2)))[:, None, None]).sum(0)
        b = ahead @ step.T
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), expected


@dataclass
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def document_scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts; their chains advance together, LINES_AT_ONCE lines or one text at a time."""
        out: list[float] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for k, text in enumerate(texts):
            held.append(line_statistics(text))
            if k == len(texts) - 1 or sum(len(s) for _, s in held) >= LINES_AT_ONCE:
                lengths = np.array([len(s) for _, s in held])
                x = np.concatenate([with_neighbours((own - self.mean) / self.scale) for own, _ in held])
                good, _ = forward_backward(x @ self.weights, lengths, self.moves)
                for (_, sizes), p in zip(held, np.split(good, np.cumsum(lengths)[:-1]), strict=True):
                    weight = sizes if sizes.sum() else np.ones(len(sizes))
                    out.append(float(min(max((p * weight).sum() / weight.sum(), 0.0), 1.0)))
                held = []
        return out


def gradient(theta: np.ndarray, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of the mean over documents of log P(line labels | lines) / lines, less SHRINK / 2 times theta squared.

    theta: weights of x's columns, then the four moves; labels: one a document, which all its lines have."""
    weights, moves, shares = theta[:-4], theta[-4:].reshape(2, 2), 1.0 / lengths
    good, expected = forward_backward(x @ weights, lengths, moves, shares)
    off = (np.repeat(labels, lengths) - good) * np.repeat(shares, lengths)
    seen = np.diag([((lengths - 1) * shares)[labels == v].sum() for v in (0, 1)])
    return np.concatenate([x.T @ off, (seen - expected).ravel()]) / len(lengths) - SHRINK * theta


def fit(sequences: list[np.ndarray], labels: np.ndarray) -> LineCrf:
    """Gradient ascent (Adam) on the conditional log-likelihood of the line labels."""
    if not sequences:
        return LineCrf(np.zeros(OWN), np.ones(OWN), np.zeros(3 * OWN + 3), np.zeros((2, 2)))
    own = np.concatenate(sequences).astype(np.float64)
    mean, scale = own.mean(0), own.std(0) + 1e-3
    lengths = np.array([len(s) for s in sequences])
    x = np.concatenate([with_neighbours((s - mean) / scale) for s in sequences])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        grad = gradient(theta, x, lengths, labels)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return LineCrf(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> LineCrf:
    """Fit on a sample of labelled rows that are not held out, bounded as above."""
    usable = labels.where("quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [line_statistics(t.as_py())[0].tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), batch.column(2)], ["doc_id", "own", "quality"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # fit_docs rows at most: one text an id, whatever repeats.
    texts = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    texts = texts.withColumn("before", F.coalesce(F.sum(lines).over(before), F.lit(0))).where(F.col("before") < fit_lines)
    rows = texts.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))
    found = sorted(rows.mapInArrow(run, "doc_id long, own binary, quality int").collect())
    return fit([np.frombuffer(r["own"], np.float32).reshape(-1, OWN) for r in found], np.array([r["quality"] for r in found]))


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores = model.document_scores(batch.column(1).to_pylist())
            held = [i is None or zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
            predicted = [int(x >= CUT) for x in scores]
            columns = [batch.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
