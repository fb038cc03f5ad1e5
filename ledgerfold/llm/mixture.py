"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target size; a document of it is taken floor(target / size) times and once more with the
fractional probability that is left. The cube method draws that last copy: probabilities move through the null
space of the balancing constraints (document count and word total), so both totals are met until only one or two
undecided documents of a source remain, the landing problem.

Scale: words are counted by a built-in function in one pass; everything after it is a narrow row per document.
Every row has a key of its own from the first pass on. A source is split into blocks by hash, each block flies on its own, and what it leaves (two documents at most)
flies again with the leftovers of other blocks, so a source with a third of all rows is spread over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.columns import plain
from ledgerfold.operators.ordering import numbered
from ledgerfold.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9
_FLIGHT = "row_id long, doc_id long, size long, source_key string, block long, p double"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of all sources: ``sizes`` has (source, source_key, source_size), one row per source.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all sizes; a target over ``most``
    times its source's size stops there and the excess is shared again by weight among the rest. Each
    round of sharing is one aggregate over the source table; only its two sums reach the driver.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = numbered(sizes, [F.col("source").asc_nulls_last()], "at").withColumn("at", F.col("at") - 1)
    t = materialize(t.select("source", "source_key", "source_size", F.element_at(w, (F.col("at") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * most).alias("cap")))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # every source gets the smaller of its cap and its weight times the level
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        held, free = t.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        now = max(level, (total - (held or 0)) / free) if free else level
        if now <= level * (1 + 1e-12):
            break
        level = now
    return t.select("source_key", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight over one block, balanced on count and total size; at most two probabilities stay fractional.

    Three documents are held at a time. The vector that keeps their count and size is moved along until one
    of them reaches 0 or 1; which way is drawn so that probabilities keep their means.
    """
    p = p.astype(float).copy()
    open_ = [i for i in range(len(p)) if EDGE < p[i] < 1 - EDGE]
    draws = iter(rng.random(len(open_) + 1))
    held: list[int] = []
    for i in open_:
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (float(size[j]) for j in held)
        u = (c - b, a - c, b - a)
        if a == b == c:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[j]) / x if x > 0 else p[j] / -x for j, x in zip(held, u, strict=True) if x)
        down = min(p[j] / x if x > 0 else (1 - p[j]) / -x for j, x in zip(held, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for j, x in zip(held, u, strict=True):
            p[j] += step * x
        held = [j for j in held if EDGE < p[j] < 1 - EDGE]
    return np.where(p < EDGE, 0.0, np.where(p > 1 - EDGE, 1.0, p))


def land(size: np.ndarray, p: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Decide what the last flight left open, and settle the word total within its block.

    The few open documents take the choice whose total is nearest the expected one. If a long document was among
    them, the rest of the gap is closed by exchanging one drawn document for one not drawn, or else by
    one more or one fewer, as long as that brings the total nearer. ``start`` has the probabilities before the flight;
    documents that were never in doubt stay as they are.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    want = float((size[open_] * p[open_]).sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(float(size[j]) for k, j in enumerate(open_) if m >> k & 1) - want), m.bit_count(), m))
    for k, j in enumerate(open_):
        out[j] = best >> k & 1
    gap = float((size * (p - out)).sum())
    doubt = (start > EDGE) & (start < 1 - EDGE)
    for _ in range(4):
        spare = np.flatnonzero(doubt & (out == 0))
        spare = spare[np.argsort(size[spare], kind="stable")]
        drawn = np.flatnonzero(doubt & (out == 1))
        moves: list[tuple[float, int, int]] = [(abs(gap), -1, -1)]
        if len(spare) and len(drawn):
            near = np.searchsorted(size[spare], size[drawn] + gap)
            for at in (np.clip(near, 0, len(spare) - 1), np.clip(near - 1, 0, len(spare) - 1)):
                left = np.abs(gap - (size[spare[at]] - size[drawn]))
                i = int(left.argmin())
                moves.append((float(left[i]), int(spare[at[i]]), int(drawn[i])))
        if len(spare):
            i = int(np.abs(gap - size[spare]).argmin())
            moves.append((abs(gap - float(size[spare[i]])), int(spare[i]), -1))
        if len(drawn):
            i = int(np.abs(gap + size[drawn]).argmin())
            moves.append((abs(gap + float(size[drawn[i]])), -1, int(drawn[i])))
        left, add, drop = min(moves, key=lambda x: x[0])
        if left >= abs(gap):
            break
        for j, to in ((add, 1.0), (drop, 0.0)):
            if j >= 0:
                out[j] = to
        gap = float((size * (p - out)).sum())
    return out


def _fly(last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "p", "row_id"], kind="stable", na_position="first").reset_index(drop=True)
        seed = hashlib.blake2b(repr(key).encode(), digest_size=8).digest()
        order = np.random.default_rng(int.from_bytes(seed, "little"))
        pdf = pdf.iloc[order.permutation(len(pdf))]
        size, start = pdf["size"].to_numpy(), pdf["p"].to_numpy()
        p = flight(size, start, order)
        return pdf.assign(p=land(size, p, start) if last else p)

    return run


def draw(units: DataFrame, block_rows: int = 1000) -> DataFrame:
    """Decide every unit of (row_id, doc_id, size, source_key, p): returns (row_id, p) with p 0 or 1.

    Blocks are rounds of a tree: ``block_rows`` units fly together, their leftovers join those of other blocks of
    the source, until one block per source is left, which lands. Units are dealt to blocks by a hash of their row_id, at every size of the
    table; for draws that agree between layouts of the same rows, number rows by what is in them (``_counts``).
    """
    sizes = units.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    now = units.join(F.broadcast(sizes) if sizes.count() <= 20_000 else sizes, "source_key")
    block = F.pmod(F.xxhash64("row_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("long"))
    now = now.select("row_id", "doc_id", "size", "source_key", block.alias("block"), "p")
    done = None
    while True:
        last = now.select(F.max("block")).first()[0] in (None, 0)
        flown = materialize(now.groupBy("source_key", "block").applyInPandas(_fly(last), _FLIGHT))
        settled = (flown if last else flown.where("p = 0 or p = 1")).select("row_id", "p")
        done = settled if done is None else done.union(settled)
        if last:
            return done
        left = flown.where("p > 0 and p < 1")
        # two leftovers a block at most: half a block's worth of blocks meets again
        now = materialize(left.select("row_id", "doc_id", "size", "source_key", F.floor(F.col("block") / (block_rows // 2)).cast("long").alias("block"), "p"))


def _sized(docs: DataFrame, *more) -> DataFrame:
    """(row_id, doc_id, source, source_key, size, said, ...) of every row, written once so that row_id stays; ``said`` is a hash of the text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("source_key"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("said"), *more))


def _counts(rows: DataFrame, weights: tuple[float, ...], most: float, block_rows: int) -> DataFrame:
    """(row_id, doc_id, size, source_size, target, copies) of sized rows.

    Units are numbered in the order of (source, doc_id, size, text hash) by range partitions. Rows equal in all of them have neighbouring
    numbers and are alike to the draw, so it doesn't depend on how the table is laid out.
    """
    per = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = materialize(source_targets(per, weights, most))
    few = F.broadcast(targets) if targets.count() <= 20_000 else targets
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    unit = numbered(rows.select("row_id", "doc_id", "size", "source_key", "said"), [F.col(c).asc_nulls_first() for c in ("source_key", "doc_id", "size", "said")], "unit")
    share = unit.join(few, "source_key").withColumn("ratio", F.least(ratio, F.lit(float(most))))
    base = F.floor(F.col("ratio") + EDGE).cast("long")
    drawn = draw(share.select(F.col("unit").alias("row_id"), "doc_id", "size", "source_key", F.greatest(F.lit(0.0), F.col("ratio") - base).alias("p")), block_rows)
    drawn = drawn.withColumnRenamed("row_id", "unit")
    return share.join(drawn, "unit").select("row_id", "doc_id", "size", "source_size", "target", (base + F.round("p").cast("long")).alias("copies"))


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block_rows: int = 1000) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source_size, target, copies, taken).

    ``size`` counts runs of characters other than white space; ``taken`` is copies times size. Null texts have size 0
    and are drawn like others of their source; a null source is a source of its own, last in order. A source
    of size 0 has target 0 and takes nothing. Repeated rows, also those with a null doc_id, are drawn each on its own, ties break
    by doc_id, extra columns are ignored, reruns agree, and an empty table gives an empty result. No count exceeds ``most``.
    """
    drawn = _counts(_sized(docs), weights, most, block_rows)
    return drawn.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block_rows: int = 1000) -> DataFrame:
    """``docs`` as the mix takes it: every row as often as it was drawn, all columns kept, whatever their names.

    Each row is drawn on its own, so rows that repeat an id and rows without one take part like all others.
    """
    names, docs = docs.columns, plain(docs)
    rows = _sized(docs, F.struct(*docs.columns).alias("row"))
    counts = _counts(rows, weights, most, block_rows).where("copies > 0").select("row_id", "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.select("row_id", "row").join(counts.hint("merge"), "row_id").select("row", times.alias("time")).select("row.*").toDF(*names)
