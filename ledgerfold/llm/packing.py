"""Packing along a space-filling curve.

Every document becomes token ids and a hashed, signed count vector, which a fixed Gaussian matrix projects to
three dimensions. Documents are range-sorted by the Hilbert key of their projection, so neighbours share
vocabulary, and packed along the curve: sequences are filled to the brim and documents cut where one is full.

Scale: one pass encodes (ids kept as two bytes each, written to the shared folder), one range shuffle orders them by
(key, doc_id), so any number of equal keys spreads over tasks, and each task packs its own stretch of the curve as
a stream. The tail of a stretch is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.tokens import SPAN, encoder
from ledgerfold.session import lean, materialize

END = 1
HASHED = 256
ORDER_BITS = 10


@lru_cache(maxsize=1)
def projection(vocabulary: int = 1 << 16, dims: int = 3, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Signed bucket of each id (buckets from HASHED on count negatively), and the (HASHED, dims) Gaussian matrix; fixed by the seed."""
    rng = np.random.default_rng(seed)
    bucket = rng.integers(0, HASHED, vocabulary)
    return bucket + HASHED * rng.integers(0, 2, vocabulary), rng.standard_normal((HASHED, dims))


def project(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three coordinates per document, each about standard normal: the direction of its square-root-damped hashed counts.

    ``ids`` holds all documents' ids in a row; the last one of each is the end id, which does not count.
    """
    bucket, matrix = projection()
    points = np.zeros((len(sizes), matrix.shape[1]))
    stops = np.cumsum(sizes)
    for i in range(0, len(sizes), 256):
        n = sizes[i : i + 256]
        begin = int(stops[i] - n[0])
        counts = np.zeros(len(n) * 2 * HASHED, np.int64)
        for a in range(begin, int(stops[i + len(n) - 1]), SPAN):  # a span at a time, so that a long text needs no more
            part = ids[a : min(a + SPAN, int(stops[i + len(n) - 1]))]
            row = np.searchsorted(stops[i : i + len(n)], np.arange(a, a + len(part)), side="right") if len(n) > 1 else 0
            counts += np.bincount(bucket[part] + 2 * HASHED * row, minlength=len(counts))
        counts = counts.reshape(len(n), 2 * HASHED)
        counts[:, bucket[END]] -= 1
        v = (counts[:, :HASHED] - counts[:, HASHED:]).astype(float)
        v = np.sign(v) * np.sqrt(np.abs(v))
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        points[i : i + 256] = (v / np.where(norm > 0, norm, 1)) @ matrix
    return points


def hilbert_key(cells: np.ndarray, bits: int = ORDER_BITS) -> np.ndarray:
    """Hilbert index of integer cells (n, dims) with ``bits`` bits each, by Skilling's transform, for all rows at once."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def cells_of(points: np.ndarray, bits: int = ORDER_BITS) -> np.ndarray:
    """Normal coordinates to grid cells of equal weight, by the logistic approximation of the normal distribution."""
    share = 1 / (1 + np.exp(-1.702 * np.clip(points, -8, 8)))
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def with_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, key, n, ids): Hilbert key, number of ids with the end id, and the ids as little-endian uint16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary_path)
        for b in batches:
            ids, sizes = words.encode(b["text"], END)
            keys = hilbert_key(cells_of(project(ids, sizes)))
            edges = np.r_[0, 2 * np.cumsum(sizes)].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(keys), pa.array(sizes), packed], ["doc_id", "key", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, ids binary")


def cut_lengths(left: int, length: int) -> Iterator[int]:
    """Sequence lengths for the ids that remain at the end of a stretch: the powers of two they are the sum of."""
    for bit in range(length.bit_length(), -1, -1):
        if left >> bit & 1:
            yield 1 << bit


def crc_of(ids: bytes) -> int:
    """CRC-32 of uint16 ids as little-endian uint32."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def pack(docs: DataFrame, vocabulary_path: str, length: int = 2048, digests: bool = False, stretch_bytes: int = 32 << 20) -> DataFrame:
    """Pieces of all documents: (doc_id, start, doc_tokens, sequence_id, offset, ids binary of uint16).

    ``stretch_bytes`` of ids are a task's stretch of the curve. With ``digests``, length and ids_crc32 (of the ids as little-endian uint32) stand in place of the ids.

    Each document's ids (with the end id) lie in consecutive pieces, each id in exactly one; sequences are gapless from
    offset 0 and hold ``length`` ids, but for the tail of each task's stretch of the curve, whose sequences
    hold powers of two. Null and empty texts are the end id alone, which sorts at the curve's middle. Repeated rows are
    packed each on its own; a null doc_id sorts first and stays null. Texts of any length are cut as needed. An empty
    table gives an empty result; extra columns are ignored.
    """
    lean(docs.sparkSession)
    tokens = materialize(with_tokens(docs, vocabulary_path))
    names = ["doc_id", "start", "doc_tokens", "sequence_id", "offset", *(["length", "ids_crc32"] if digests else ["ids"])]
    kinds = [pa.int64()] * 5 + ([pa.int64()] * 2 if digests else [pa.binary()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[list] = []  # pieces [doc_id, start, doc_tokens, ids] of the sequence that isn't full yet
        filled = 0
        out: list[tuple] = []

        def close(size: int) -> None:
            """Send the first ``size`` waiting ids as one sequence."""
            nonlocal sequence, filled
            at = 0
            while at < size:
                doc, start, total, ids = waiting[0]
                take = min(len(ids) // 2, size - at)
                part = ids[: 2 * take]
                out.append((doc, start, total, sequence, at, *((take, crc_of(part)) if digests else (part,))))
                at += take
                if 2 * take == len(ids):
                    waiting.pop(0)
                else:
                    waiting[0] = [doc, start + take, total, ids[2 * take :]]
            sequence += 1
            filled -= size

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for b in batches:
            for doc, n, ids in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["ids"].to_pylist(), strict=True):
                done = 0
                while n - done >= length - filled:
                    take = length - filled
                    waiting.append([doc, done, n, ids[2 * done : 2 * (done + take)]])
                    filled, done = length, done + take
                    close(length)
                if done < n:
                    waiting.append([doc, done, n, ids[2 * done :]])
                    filled += n - done
                if len(out) >= 4096:
                    yield flush()
        for size in list(cut_lengths(filled, length)):
            close(size)
        if out:
            yield flush()

    total = tokens.agg(F.sum("n")).first()[0] or 0
    ordered = tokens.repartitionByRange(max(1, -(-2 * total // stretch_bytes)), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.select("doc_id", "n", "ids").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))
