"""Quality classifier by Bradley-Terry pairwise ranking.

Labels become preference pairs (a good document over a bad one); the logistic loss on feature differences gives a
linear score whose sigmoid is the chance of being preferred. The threshold is the quantile of the training scores
at the share of bad labels; scores are shifted so that it lies at 0.5.

Scale: the fit uses at most ``max_labels`` labelled rows (a bound, drawn by hash of doc_id); scoring is one pass over
all whole texts without a shuffle, with a weight vector of a few kilobytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.columns import plain
from ledgerfold.session import lean

HASHED = 128
_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _END, _HIGH = range(7)


def _classes() -> np.ndarray:
    """Class of each byte: upper case, lower case, digit, white space, other marks, sentence marks, non-ASCII."""
    table = np.full(256, _MARK)
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[[9, 10, 11, 12, 13, 32]] = _SPACE
    table[[ord(c) for c in ".,;:'\"-()?"]] = _END
    table[128:] = _HIGH
    return table


CLASSES = _classes()
NAMES = 15


def features(text: str | None) -> np.ndarray:
    """Shape, repetition and hashed class-trigram features of a whole text; all zero for a text without bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(NAMES + HASHED)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    kinds = CLASSES[b]
    share = np.bincount(kinds, minlength=7) / len(b)
    words = raw.split()
    n = len(words)
    lines = raw.split(b"\n")
    counts = Counter(words)
    top = counts.most_common(1)[0][1] / n if n else 0
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1)
    letters = share[_UPPER] + share[_LOWER] + share[_HIGH]
    out[:NAMES] = [
        *share, share[_UPPER] / max(letters, 1e-3), len(counts) / max(1, n), top, again,
        len(b) / max(1, n) / 10, np.log1p(n) / 5, len(set(lines)) / len(lines), len(lines) / max(1, n),
    ]
    if len(b) > 2:
        code = (kinds[:-2] * 7 + kinds[1:-1]) * 7 + kinds[2:]
        out[NAMES:] = np.sqrt(np.bincount(code * 37 % HASHED, minlength=HASHED) / len(code))
    return out


@dataclass(frozen=True)
class Ranker:
    """A linear score over standardised features; ``threshold`` is the raw score that maps to 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


def fit_ranker(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, penalty: float = 1e-3, rounds: int = 300, seed: int = 5) -> Ranker:
    """Bradley-Terry by gradient steps on preference pairs of a good and a bad row.

    Without both labels there is no pair: weights are zero and every score is 0.5 or more (predicted 1).
    """
    dims = x.shape[1] if x.ndim == 2 and len(x) else NAMES + HASHED
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(dims), np.ones(dims), np.zeros(dims), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = max(pairs, len(bad), len(good))
    # every row takes part: each list is walked in shuffled order as often as needed
    left = np.concatenate([rng.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    right = np.concatenate([rng.permutation(bad) for _ in range(-(-n // len(bad)))])[:n]
    diff = (z[left] - z[right]).astype(np.float32)
    w = np.zeros(dims, np.float64)
    first, second = np.zeros(dims), np.zeros(dims)
    for t in range(1, rounds + 1):
        margin = diff @ w.astype(np.float32)
        grad = -(diff.T @ (1 / (1 + np.exp(np.clip(margin, -30, 30))))) / n + penalty * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    raw = z @ w
    low, high = np.sort(raw)[[max(0, len(bad) - 1), min(len(raw) - 1, len(bad))]]
    return Ranker(mean, scale, w, float((low + high) / 2))


def held_out(doc_id):
    """Whether a document's labels are kept from the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _arrow_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 12_000) -> Ranker:
    """Fit on at most ``max_labels`` labelled documents that are not held out, those with the lowest id hashes.

    Labels other than 0 and 1 are left out; an id labelled twice counts by its smaller label; of rows that repeat an id the one with the
    least features counts, so that no more rows than labels reach the driver.
    """
    lean(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)  # the documented bound, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    found = found.mapInArrow(_arrow_features, "doc_id long, quality int, x array<double>")
    pdf = found.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row")).select("doc_id", "row.*").toPandas()  # max_labels rows at most
    x = np.array(pdf["x"].tolist()).reshape(len(pdf), NAMES + HASHED)
    order = np.lexsort((*x.T[:3], pdf["doc_id"])) if len(pdf) else np.zeros(0, np.int64)
    return fit_ranker(x[order], pdf["quality"].to_numpy()[order])


def score_documents(docs: DataFrame, labels: DataFrame, max_labels: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Only labels of documents that are not held out are learnt from, and a score depends on the text alone. Null and
    empty texts share one score; repeated texts score alike; extra columns are ignored; an empty table gives an empty
    result, and without both labels every document is predicted 1. The order of ties in the fit is fixed by doc_id.
    """
    ranker = train(docs, labels, max_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                score = ranker.score(np.array([features(t) for t in b["text"].to_pylist()]).reshape(b.num_rows, NAMES + HASHED))
                cols = [b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out"))
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, max_labels: int = 12_000) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier predicts 1; texts are scored in place, without a join."""
    names, docs = docs.columns, plain(docs)
    ranker = train(docs, labels, max_labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(b.num_rows, NAMES + HASHED)
                yield b.filter(pa.array(ranker.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
