"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of each whole text and cuts where its low bits are zero, so chunks depend
on nearby bytes only and resist shifts. Chunks are deduplicated by a 64-bit digest; runs of repeated chunks
are the repeated passages, and a chance collision is no run of the least length.

Scale: the hash is a few numpy passes over a text. A narrow row per chunk is shuffled by digest and counted with
map-side aggregation; the first place of each repeated digest is joined back on the digest, with the places of very
frequent digests salted over tasks. Runs are built per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.skew import hot_keys, salted_join
from ledgerfold.session import lean, materialize

#: The gear table: 256 fixed pseudo-random 32-bit values, one per byte.
GEAR = np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(raw: bytes, mean: int = 56, least: int = 24, most: int = 192) -> np.ndarray:
    """Chunk ends of a text's bytes, the last one its length. Cuts fall on character borders.

    The gear hash h = 2h + GEAR[byte] over 32 bits depends on the last 32 bytes only, so it is summed by doubling.
    A border is a byte after which the hash's top bits are zero (one in ``mean - least`` bytes or so); chunks
    are at least ``least`` bytes and, without a border, ``most``.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8)
    h = GEAR[b]
    for shift in (1, 2, 4, 8, 16):
        step = h.copy()
        step[shift:] += h[:-shift] << np.uint32(shift) if n > shift else 0
        h = step
    bits = max(1, int(np.log2(max(2, mean - least))))
    borders = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    cuts, last = [], 0
    for c in borders.tolist():
        while c - last > most:
            last += most
            cuts.append(last)
        if c - last >= least:
            last = c
            cuts.append(c)
    while n - last > most:
        last += most
        cuts.append(last)
    cuts.append(n)
    whole = []
    for c in cuts:
        while c < n and raw[c] & 0xC0 == 0x80:
            c += 1
        if not whole or c > whole[-1]:
            whole.append(c)
    return np.array(whole, np.int64)


def _ends() -> np.ndarray:
    """How many half word ends each byte is: blanks and line feeds two, the first byte of a character of unspaced scripts (above U+0E00, but for marks of the U+2000 block) one."""
    table = np.zeros(256, np.int64)
    table[[10, 32]] = 2
    table[[0xE0, 0xE1, *range(0xE3, 0xEE), *range(0xF0, 0xF5)]] = 1
    return table


ENDS = _ends()


def word_ends(raw: bytes) -> int:
    """Word ends in bytes: blanks and line feeds, and every second character of scripts that put no spaces."""
    return int(ENDS[np.frombuffer(raw, np.uint8)].sum()) // 2


def _chunk_rows(docs: DataFrame, mean: int, least: int, most: int) -> DataFrame:
    """(doc_id, start, stop, half_ends, digest) of every chunk, places in bytes; the digest is a long."""
    names = ["doc_id", "start", "stop", "half_ends", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                ids, starts, stops, words, digests = [], [], [], [], []
                for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    cuts = cut_points(raw, mean, least, most)
                    if not len(cuts):
                        continue
                    begins = np.r_[0, cuts[:-1]]
                    words.append(np.add.reduceat(ENDS[np.frombuffer(raw, np.uint8)], begins))
                    starts.append(begins)
                    stops.append(cuts)
                    ids.append(np.full(len(cuts), doc, np.int64))
                    digests += [xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(begins.tolist(), cuts.tolist(), strict=True)]
                cols = zip((ids, starts, stops, words), (np.int64, np.int32, np.int32, np.int32), strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(k) if c else np.zeros(0, k)) for c, k in cols), pa.array(np.array(digests, np.uint64).view(np.int64))], names)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start int, stop int, half_ends int, digest long")


def repeated_passages(docs: DataFrame, min_words: int = 20, min_bytes: int = 240, mean: int = 56, least: int = 24, most: int = 192) -> DataFrame:
    """Passages that other documents have too: (doc_id, start, stop, n_words, n_chunks, first_doc_id, kept).

    A run is neighbouring chunks, each of whose digests occurs in two documents or more, with at least ``min_words``
    word ends or ``min_bytes`` bytes in it (a repeated passage loses up to a chunk at either end, so one of 50 words keeps 20). In
    scripts without spaces every second character is a word end. A run
    is cut into passages wherever its chunks change between first place here and first place elsewhere. ``kept`` says that all
    chunks of the passage have their first place here, so that a dedup keeps it; the others may be cut, however
    short, and each repeated chunk survives in the first document that has it. Pieces of a mixed run that stay and fall
    short of both are no rows. ``first_doc_id`` is the smallest document that holds any of the passage's
    chunks first. Places are bytes.
    Repeats inside one document don't count. Null and empty texts have no passage; rows with a null doc_id are left out; rows that
    repeat a doc_id are one document; extra columns are ignored; an empty table gives an empty result.
    """
    lean(docs.sparkSession)
    chunks = materialize(_chunk_rows(docs, mean, least, most))
    firsts = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.where("first_doc_id < last_doc_id").select("digest", "first_doc_id", "n"))
    hot = hot_keys(firsts, "digest", chunks.count())
    found = salted_join(chunks, firsts.select("digest", "first_doc_id"), "digest", hot).select("doc_id", "start", "stop", "half_ends", "first_doc_id")
    names = ["doc_id", "start", "stop", "n_words", "n_chunks", "first_doc_id", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[list] = []
        out: list[list] = []

        def large(parts: list[list]) -> bool:
            return sum(p[3] for p in parts) >= 2 * min_words or parts[-1][2] - parts[0][1] >= min_bytes

        def end() -> None:
            if now and large(now):
                out.extend([*p[:3], p[3] // 2, *p[4:]] for p in now if not p[6] or large([p]))

        for b in batches:
            for doc, start, stop, words, first in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "stop", "half_ends", "first_doc_id")), strict=True):
                if now and now[-1][0] == doc and start <= now[-1][2]:
                    last = now[-1]
                    if stop > last[2] and last[6] == (first == doc):
                        last[2:6] = stop, last[3] + words, last[4] + 1, min(last[5], first)
                    elif stop > last[2]:
                        now.append([doc, start, stop, words, 1, first, first == doc])
                    continue
                end()
                now = [[doc, start, stop, words, 1, first, first == doc]]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out.clear()
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ordered = found.repartition("doc_id").sortWithinPartitions("doc_id", "start", "stop", F.desc("first_doc_id"))
    return ordered.mapInArrow(runs, "doc_id long, start long, stop long, n_words long, n_chunks long, first_doc_id long, kept boolean")
