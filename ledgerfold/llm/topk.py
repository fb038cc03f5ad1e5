"""Exact top-k inner products by a bit-sliced index.

Quantised vectors are stored as bit slices: bitmap j of attribute d holds bit j of every row's component d. A
query's scores are added up without touching rows: each non-zero digit of a query component adds the attribute's
slices, shifted, into a carry-save accumulator of bitmaps. The top rows are read off the score slices from the
most significant one downward; rows tied at the boundary are resolved exactly by vec_id. Depth and width of the slices come
from the data, and scores are integers of any size, so nothing is clamped.

Scale: the index is cut into blocks by hash of the row, bounded by rows and by bytes, and each block's slices are built
once and written to the shared folder. Queries are the small side, so they are repeated per block and stream through the
block that a task holds; the index itself is shuffled once, or once per lane where blocks are fewer than tasks. A task holds one
block's bitmaps and one batch of queries. Every block answers every query (the stated query set against all rows) with k rows
at most, and only those are shuffled and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import lean, materialize

#: Integers up to this many bits are kept as 64-bit ones.
PLAIN_BITS = 62


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form of an integer, the shortest sum of signed powers of two."""
    out, shift = [], 0
    while value:
        if value & 1:
            d = 2 - (value & 3)
            out.append((shift, d))
            value -= d
        value >>= 1
        shift += 1
    return out


class BitSlices:
    """The bit-sliced index of one block: two's-complement slices of each attribute as bitmaps over the rows."""

    def __init__(self, slices: np.ndarray, n: int):
        self.slices, self.n = slices, n
        self.dims, self.depth, self.words = slices.shape
        self.all = np.packbits(np.r_[np.ones(n, np.uint8), np.zeros(self.words * 64 - n, np.uint8)], bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, rows: np.ndarray) -> BitSlices:
        """The index of integer rows (n, dims)."""
        n, dims = rows.shape
        words = -(-n // 64)
        depth = max((int(rows.max()), -int(rows.min())), default=0).bit_length() + 1 if rows.size else 1
        slices = np.zeros((dims, depth, words), np.uint64)
        for j in range(depth):
            bits = np.zeros((dims, words * 64), np.uint8)
            bits[:, :n] = (rows.T >> j) & 1
            slices[:, j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        return cls(slices, n)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Slices of every row's inner product with the query, least significant first, two's complement."""
        reach = sum(abs(int(q)) for q in query) << (self.depth - 1)
        width = max(2, reach.bit_length() + 1)
        columns: list[list[np.ndarray]] = [[] for _ in range(width)]
        constant = 0
        for d, q in enumerate(query):
            for shift, sign in signed_digits(int(q)):
                s = self.slices[d]
                # The sign slice weighs -2^(depth-1); as its complement it weighs +2^(depth-1), less a constant.
                # A negative digit adds the complement of every slice, less a constant.
                for j in range(self.depth):
                    at = shift + j
                    negative = (sign < 0) != (j == self.depth - 1)
                    if at < width:
                        columns[at].append(~s[j] if negative else s[j])
                    if negative:
                        constant -= 1 << at
        out = np.zeros((width, self.words), np.uint64)
        for at in range(width):
            if constant >> at & 1:
                columns[at].append(self.all)
            column = columns[at]
            while len(column) > 2:
                # carry-save: three bitmaps of one weight become one of it and one of the next
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.insert(0, x ^ c)
                if at + 1 < width:
                    columns[at + 1].append((a & b) | (x & c))
            if len(column) == 2:
                a, b = column
                out[at] = a ^ b
                if at + 1 < width:
                    columns[at + 1].append(a & b)
            elif column:
                out[at] = column[0]
        return out

    def top(self, query: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, list[int]]:
        """(positions, scores) of the k best rows but row ``without``; ties at the boundary go to smaller positions."""
        s = self.scores(query)
        s[-1] = ~s[-1]  # the sign slice turned round: larger is better in every slice
        sure, maybe = np.zeros(self.words, np.uint64), self.all.copy()
        if without is not None:
            maybe[without // 64] &= ~np.uint64(1 << without % 64)
        for j in range(len(s) - 1, -1, -1):
            both = sure | (maybe & s[j])
            n = int(np.bitwise_count(both).sum())
            if n > k:
                maybe &= s[j]
            else:
                sure = both
                maybe &= ~s[j]
                if n == k:
                    maybe[:] = 0
                    break
        rows = self._rows(sure)
        rows = np.r_[rows, self._rows(maybe)[: k - len(rows)]]
        s[-1] = ~s[-1]
        bits = ((s[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).T.tolist()
        top = len(s) - 1
        return rows, [sum(b << j for j, b in enumerate(bit)) - (bit[top] << top + 1) for bit in bits]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantised(vectors: list[np.ndarray], width: int, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of all components as exact integers, shorter vectors padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    if np.abs(out).max(initial=0) * scale < 1 << PLAIN_BITS:
        return np.floor(out * scale).astype(np.int64)
    whole = lambda x: int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale))
    return np.array([[whole(float(x)) for x in row] for row in out], object)


def order_key(score: int) -> bytes:
    """Bytes that sort as the scores do, whatever their size."""
    size = -(-abs(score).bit_length() // 8)
    raw = abs(score).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + raw if score >= 0 else (0x8000 - size).to_bytes(2, "big") + bytes(255 - b for b in raw)


def usable(vectors: DataFrame) -> DataFrame:
    """(row_id, vec_id, x): vectors as doubles; rows with a null id or vector, a null or a non-finite component are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def build_index(rows: DataFrame, blocks: int, width: int) -> DataFrame:
    """(block, n, depth, vec_ids, row_ids, slices): one row per block, its rows in order of (vec_id, row_id), all as bytes."""
    schema = "block int, n int, depth int, vec_ids binary, row_ids binary, slices binary"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row_id"])
        made = BitSlices.of(quantised(pdf["x"].tolist(), width))
        cells = [pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row_id")]
        return pd.DataFrame([[int(key[0]), made.n, made.depth, *cells, made.slices.tobytes()]], columns=[f.split()[0] for f in schema.split(", ")])

    return rows.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(run, schema)


def dealt(index: DataFrame, queries: DataFrame, blocks: int, lanes: int) -> DataFrame:
    """Each block of the index once per lane, followed by the lane's queries: every query meets every block once.

    The number of partitions is stated, so that none is merged or split at run time.
    """
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = index.select("block", upto(lanes).alias("lane"), "depth", "vec_ids", "row_ids", "slices")
    lane = F.pmod(F.xxhash64("row_id", F.lit(2)), F.lit(lanes)).cast("int")
    asked = queries.select(upto(blocks).alias("block"), lane.alias("lane"), "row_id", "vec_id", "x")
    both = held.unionByName(asked, allowMissingColumns=True)
    return both.repartition(blocks * lanes, "block", "lane").sortWithinPartitions("block", "lane", F.asc_nulls_first("row_id"))


def top_inner(vectors: DataFrame, every: int = 50, k: int = 5, block_rows: int = 65_536, chunk_rows: int = 64, cell_bytes: int = 16 << 20) -> DataFrame:
    """The k best other rows of each query row (vec_id divisible by ``every``): (query_id, rank, vec_id, score).

    Every row is a candidate of every query but for the query's own row: rows that repeat an id or a whole row are
    candidates of their own and, as queries, have results of their own. Ties go to the smaller vec_id. Shorter vectors count as
    padded with zeros. Components and scores of any size are ranked exactly; a score beyond the range of a long is null. Fewer
    than k other rows give fewer results, one row or an empty table none; extra columns are ignored.
    ``cell_bytes`` bounds the bytes of a block's vectors or slices. Where there are fewer blocks than shuffle partitions, queries are
    dealt to lanes of about ``chunk_rows`` queries or more, each with a copy of the block.
    """
    spark = vectors.sparkSession
    lean(spark)
    rows = materialize(usable(vectors))
    at = F.array_max(F.transform("x", F.abs))
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(at)).first()
    width = max(1, width or 0)
    depth = int(most or 0).bit_length() + 10
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-n // max(1, min(block_rows, 8 * cell_bytes // (width * max(64, depth))))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, min(queries.count() // chunk_rows, -(-tasks // blocks)))
    index = materialize(build_index(rows, blocks, width))
    stream = dealt(index, queries, blocks, lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in batches:
            out: list[tuple] = []
            for r, (key, row, vec) in enumerate(zip(zip(batch["block"].to_pylist(), batch["lane"].to_pylist(), strict=True), batch["row_id"].to_pylist(), batch["vec_id"].to_pylist(), strict=True)):
                read = lambda name, kind: np.frombuffer(batch[name][r].as_buffer(), kind)  # noqa: B023, E731
                if row is None:
                    ids, keys = read("vec_ids", np.int64), read("row_ids", np.int64)
                    bits = BitSlices(read("slices", np.uint64).reshape(width, batch["depth"][r].as_py(), -1), len(ids))
                    loaded, place = key, {x: i for i, x in enumerate(keys.tolist())}
                elif key == loaded:  # a block to which no row was dealt has no index
                    best, scores = bits.top(quantised([batch["x"][r].as_py()], width)[0], k, place.get(row))
                    out += [(row, vec, int(ids[i]), int(keys[i]), order_key(s), s if -(2**63) <= s < 2**63 else None) for i, s in zip(best.tolist(), scores, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_row", "query_id", "vec_id", "row_id", "key", "score"])

    found = stream.mapInArrow(run, "query_row long, query_id long, vec_id long, row_id long, key binary, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("key"), "vec_id", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
