"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most k of 64 bits and are cut into k + p blocks agree on at least p whole
blocks. Every fingerprint is keyed by each choice of p blocks; fingerprints that share a key meet in one bucket
and their Hamming distance is verified there.

Scale: equal fingerprints are collapsed first, so a group of exact copies is one row whatever its size.
Keys and fingerprints are two longs per row. Buckets over ``max_bucket`` are keyed again on the bits that are
still free, level by level, until none is larger: with 14 free bits no bucket can be, so a bucket that reaches a task is
bounded. Buckets emit a spanning forest of their links, never all pairs of a group, and components are found by star
contraction in written rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.columns import plain
from ledgerfold.operators.graph import apply_links, connected_components
from ledgerfold.operators.skew import hot_keys, salted_join
from ledgerfold.session import discard, lean, materialize

SEED = 42
BITS = 64
#: Keyed rows a task writes, about: fingerprints are a small table, which comes in few partitions, their keys are a large one.
KEYED_ROWS = 500_000
#: Links or pairs of hashes, two longs each, that one task settles or lists, so that the many small steps of the near-dedup aren't a full set of tasks each.
FEW = 50_000


def _hashes(text: str | None, shingle_words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in portions; a shorter text is one shingle, no words have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(shingle_words, len(words))
    spans = zip(*(words[i:] for i in range(k)), strict=False)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    while part := [digest(join(s), SEED) for _, s in zip(range(65536), spans, strict=False)]:
        yield np.array(part, np.uint64)


def _other(h: np.ndarray, print_: int) -> np.ndarray:
    """The hashes of another print: the same for print 0, else as good as independent of them."""
    if not print_:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(print_) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def fingerprints(text: str | None, shingle_words: int = 5, prints: int = 1) -> list[int]:
    """Fingerprints of 64 bits of one text; no words: 0. A bit is set if it is set in over half the shingle hashes."""
    total, counts = 0, np.zeros((prints, BITS), np.int64)
    for part in _hashes(text, shingle_words):
        for i in range(prints):
            bits = np.unpackbits(_other(part, i).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[i] += bits.sum(0, dtype=np.int64)
        total += len(part)
    return [int(np.packbits(2 * c > total, bitorder="little").view("<u8")[0]) for c in counts]


def fingerprint(text: str | None, shingle_words: int = 5) -> int:
    """The first of ``fingerprints``."""
    return fingerprints(text, shingle_words)[0]


def shingle_set(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; a text without words has the set {0}, so all such texts are alike."""
    parts = [np.unique(h) for h in _hashes(text, shingle_words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _fingerprints_of(rows: DataFrame, first: str, shingle_words: int, prints: int = 1) -> DataFrame:
    """(first column, fp, fp1, ...) of (first column, text); ``first`` is the first column's name and type."""
    names = ["fp", *(f"fp{i}" for i in range(1, prints))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprints(t, shingle_words, prints) for t in b["text"].to_pylist()], np.uint64).view(np.int64).reshape(-1, prints)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in fps.T.copy())], [b.schema.names[0], *names])

    return rows.mapInArrow(run, ", ".join([first, *(f"{n} long" for n in names)]))


def with_fingerprints(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a signed long."""
    return _fingerprints_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long", shingle_words)


def block_masks(free: np.uint64 | int, distance: int, intact: int) -> list[int]:
    """Masks of every choice of ``intact`` among ``distance + intact`` nearly equal blocks of the bits in ``free``."""
    bits = [i for i in range(BITS) if int(free) >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(bits, distance + intact) if len(part)]
    return [sum(c) for c in combinations(blocks, max(1, len(blocks) - distance))] if len(blocks) > distance else [0]


def choose_intact(n: int, distance: int, most_keys: int = 400) -> int:
    """The fewest intact blocks that leave about one of ``n`` random fingerprints in a bucket; exact for any choice."""
    p = 1
    while n > 2 ** (p * BITS // (distance + p)) and len(list(combinations(range(distance + p + 1), p + 1))) <= most_keys:
        p += 1
    return p


def _mix(fp: np.ndarray, masks: list[int], salt: np.ndarray) -> np.ndarray:
    """One 64-bit key per fingerprint and mask. A collision of keys only adds a pair that verification rejects."""
    m = np.array(masks, np.uint64)
    with np.errstate(over="ignore"):
        x = (fp[:, None] & m[None, :]) + (m * np.uint64(0x9E3779B97F4A7C15))[None, :] + salt[:, None]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _keyed(rows: DataFrame, distance: int, intact: int) -> DataFrame:
    """(bucket, used, fp) for each fingerprint and choice of blocks among the bits outside ``used``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for used, g in pdf.groupby("used", sort=False):
                taken = np.array([used], np.int64).view(np.uint64)[0]
                masks = block_masks(~taken & np.uint64(2**64 - 1), distance, intact)
                step = max(1, 100_000 // len(masks))
                for i in range(0, len(g), step):
                    part = g.iloc[i : i + step]
                    fp = part["fp"].to_numpy(np.int64).view(np.uint64)
                    key = _mix(fp, masks, part["bucket"].to_numpy(np.int64).view(np.uint64))
                    now = np.array([m | int(taken) for m in masks], np.uint64).view(np.int64)
                    yield pd.DataFrame({"bucket": key.view(np.int64).ravel(), "used": np.tile(now, len(fp)), "fp": np.repeat(fp.view(np.int64), len(masks))})

    return rows.mapInPandas(run, "bucket long, used long, fp long")


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search over what is still unseen."""
    rest, out = fps, []
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        queue = [seed]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(at), int(x)) for x in found]
                queue += list(found)
    return out


def earlier_bucket(diff: np.ndarray, used: np.ndarray, masks: list[int]) -> np.ndarray:
    """Whether two fingerprints that differ in ``diff`` and met under the mask ``used`` agree under a mask before it in ``masks`` too.

    A ``used`` that isn't one of ``masks`` (a bucket keyed again) has none before it.
    """
    place = {m: i for i, m in enumerate(masks)}
    at = np.array([place.get(int(m), 0) for m in used], np.int64)
    out = np.zeros(len(diff), bool)
    for i in range(int(at.max(initial=0))):
        open_ = np.flatnonzero(~out & (at > i))
        out[open_[(diff[open_] & np.uint64(masks[i])) == 0]] = True
    return out


def _bucket_links(rows: DataFrame, distance: int, masks: list[int]) -> DataFrame:
    """Links of every bucket; rows of a bucket stand together, in one task.

    A link whose ends agree under an earlier mask is left to that mask's bucket, whose links connect them: over all buckets, by the order of masks, the same
    fingerprints are connected, and a large group's forest isn't sent once per mask.
    """
    empty = np.zeros(0, np.uint64)

    def links(keys: np.ndarray, fps: np.ndarray, used: np.ndarray) -> np.ndarray:
        """(u, v) of whole buckets: pairs of two by one comparison, larger buckets one by one."""
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[edge, len(keys)])
        two = edge[size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        found, under = [np.stack([fps[near], fps[near + 1]], 1)], [used[near]]
        for i in np.flatnonzero(size > 2):
            tree = spanning_links(np.unique(fps[edge[i] : edge[i] + size[i]]), distance)
            if tree:
                found.append(np.array(tree, np.uint64))
                under.append(np.full(len(tree), used[edge[i]], np.uint64))
        both, mask = np.concatenate(found), np.concatenate(under)
        return both[~earlier_bucket(both[:, 0] ^ both[:, 1], mask, masks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, used = np.zeros(0, np.int64), empty, empty

        def send(found: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(found), 65536):
                two = found[i : i + 65536].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["u", "v"])

        for b in batches:
            keys = np.r_[keys, b["bucket"].to_numpy()]
            fps = np.r_[fps, b["fp"].to_numpy().view(np.uint64)]
            used = np.r_[used, b["used"].to_numpy().view(np.uint64)]
            if not len(keys) or keys[0] == keys[-1]:
                continue
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield from send(links(keys[:cut], fps[:cut], used[:cut]))
            keys, fps, used = keys[cut:], fps[cut:], used[cut:]
        if len(keys):
            yield from send(links(keys, fps, used))

    return rows.select("bucket", "used", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def near_links(fps: DataFrame, distance: int = 4, max_bucket: int = 20_000, intact: int | None = None) -> DataFrame:
    """Links (u, v) among distinct fingerprints that connect exactly what all pairs within ``distance`` connect.

    ``fps`` has one row per distinct fp. ``max_bucket`` only decides when a bucket is keyed again on its free
    bits; no fingerprint is dropped and what is connected does not depend on it.
    """
    n = fps.count()
    p = intact or choose_intact(n, distance)
    masks = block_masks(2**BITS - 1, distance, p)
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, n * len(masks) // KEYED_ROWS)
    first = fps.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("used"), "fp").repartition(tasks, "fp")
    rows = materialize(_keyed(first, distance, p))
    links = None
    while True:
        hot = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket).select("bucket"))
        more = not hot.isEmpty()
        now = materialize(_bucket_links(rows.join(hot, "bucket", "left_anti") if more else rows, distance, masks))
        links = now if links is None else links.union(now)
        last = rows
        if more:
            rows = materialize(_keyed(rows.join(hot, "bucket", "left_semi"), distance, p).distinct())
        discard(last)
        if not more:
            return links.distinct()


def _named(marked: DataFrame, distance: int) -> DataFrame:
    """(fp, component, low): each fingerprint's class, named by one of its fingerprints, and the least ``place`` of the fp."""
    groups = materialize(marked.groupBy("fp").agg(F.min("place").alias("low")))
    parts = connected_components(materialize(near_links(groups.select("fp"), distance))).withColumnRenamed("vertex", "fp")
    return materialize(groups.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "low"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, distance: int = 7) -> DataFrame:
    """Near-duplicate classes of whole texts: (doc_id, fp, component_id).

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance`` differing bits, the
    document itself included. Null and blank texts have fingerprint 0 and are linked like any other; texts shorter than a
    shingle hash their whole word sequence. Repeated rows stay, rows with a null doc_id belong to a class but never
    name it. An empty table gives an empty result. Extra columns are ignored. The defaults (five words, 7 bits) stand for
    a cosine of about 0.94 between shingle counts, well over a similarity of 0.8.
    """
    lean(docs.sparkSession)
    marked = materialize(with_fingerprints(docs, shingle_words))
    named = _named(marked.select("fp", F.col("doc_id").alias("place")), distance)
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return marked.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """Sixteen lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _joined(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``big`` (a written table) joined to ``small`` (unique in ``key``), the rows of very frequent keys spread over tasks."""
    return salted_join(big, small, key, hot_keys(big.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, big.count()))


def _candidates(nodes: DataFrame, prints: list[str], distance: int) -> DataFrame:
    """(a, b): pairs of text hashes, a < b, that the links of any print stand for; texts of one fingerprint hang on the least of them."""
    found = None
    for fp in prints:
        one = materialize(nodes.select(F.col(fp).alias("fp"), "hash"))
        least = materialize(one.groupBy("fp").agg(F.min("hash").alias("rep")))
        links = materialize(near_links(least.select("fp"), distance))
        us = materialize(_joined(links, least.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u"))
        ends = _joined(us, least.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v").select("a", "b")
        stars = _joined(one, least, "fp").where("hash != rep").select(F.col("rep").alias("a"), F.col("hash").alias("b"))
        now = ends.union(stars)
        found = now if found is None else found.union(now)
    return materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def cells(tokens: np.ndarray) -> np.ndarray:
    """How many of a set's tokens lie in each of 128 ranges of hashes."""
    return np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=128).astype(np.uint32)


def most_similar(a: np.ndarray, b: np.ndarray) -> float:
    """The most that the similarity of two sets with such ``cells`` can be."""
    both = int(np.minimum(a, b).sum())
    return both / (int(a.sum()) + int(b.sum()) - both)


def _compared(pairs: DataFrame, texts: DataFrame, made: Callable[[str | None], np.ndarray], kind: str, passes: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The ``pairs`` (a, b), a written table, whose texts' ``made`` arrays (of type ``kind``) pass. ``texts``: hash, text."""
    total = pairs.count()
    listed = pairs.coalesce(1) if total <= FEW else pairs
    ends = materialize(listed.select(F.explode(F.array("a", "b")).alias("hash")).distinct())

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [made(t).astype(kind).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["hash"], pa.array(found, pa.binary())], ["hash", "made"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([np.frombuffer(x, kind) for x in b[c].to_pylist()] for c in ("left", "right"))
            good = pa.array([passes(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(good)

    known = materialize(texts.join(ends, "hash", "left_semi").mapInArrow(arrays, "hash long, made binary").groupBy("hash").agg(F.first("made").alias("made")))
    hot = {c: hot_keys(listed.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, total) for c in ("a", "b")}
    left = materialize(salted_join(pairs, known.select(F.col("hash").alias("a"), F.col("made").alias("left")), "a", hot["a"]))
    both = salted_join(left, known.select(F.col("hash").alias("b"), F.col("made").alias("right")), "b", hot["b"])
    out = materialize(both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long"))
    discard(ends, known, left)
    return out


def _similar(pairs: DataFrame, texts: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """(u, v): the ``pairs`` (a, b) whose texts' shingle sets have a Jaccard similarity of ``least`` or more. ``texts``: hash, text.

    Most candidates are told apart by counts of hashes in ranges, which bound the similarity, so that few sets are shuffled.
    """
    possible = _compared(pairs, texts, lambda t: cells(shingle_set(t, shingle_words)), "<u4", lambda x, y: most_similar(x, y) >= least)
    return _compared(possible, texts, lambda t: shingle_set(t, shingle_words), "<u8", lambda x, y: similarity(x, y) >= least).toDF("u", "v")


def _frequent(texts: DataFrame, shingle_words: int, over: int = 64, most: int = 200_000, portion: int = 1 << 22) -> np.ndarray:
    """Up to ``most`` shingles that more than ``over`` texts have, the rarest first. Prefixes take them last, which only saves work: any one order finds all pairs.

    A task counts by portions of its shingles and sends on those it met twice in one, so that the many that stand in one text aren't shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n > 1].view(np.int64), n[n > 1]
            for i in range(0, len(found), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 65536]), pa.array(n[i : i + 65536], pa.int64())], ["token", "n"])

        held, size = [], 0
        for b in batches:
            for t in b["text"].to_pylist():
                held.append(shingle_set(t, shingle_words))
                size += len(held[-1])
                if size >= portion:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    counted = texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > over)
    rows = counted.orderBy(F.col("n").desc(), "token").limit(most).collect()  # ``most`` at most
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefix(tokens: np.ndarray, last: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first of a sorted set's tokens, so many that two sets alike by ``least`` share one: in rising order, but those in ``last`` (sorted) after all others, by ``rank``."""
    n = len(tokens) - int(np.ceil(least * len(tokens) - 1e-9)) + 1
    if not len(last):
        return tokens[:n]
    at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
    late = last[at] == tokens
    first = tokens[~late][:n]
    return np.concatenate([first, tokens[late][np.argsort(rank[at[late]])][: n - len(first)]])


def _prefixes(texts: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """(token, hash, size, pos): the prefix of each text's shingles, with the set's size and the token's place."""
    late = _frequent(texts, shingle_words)
    order = np.argsort(late)
    shared = texts.sparkSession.sparkContext.broadcast((late[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = shared.value
        for b in batches:
            sets = [shingle_set(t, shingle_words) for t in b["text"].to_pylist()]
            heads = [prefix(x, last, rank, least) for x in sets]
            n = np.array([len(x) for x in heads], np.int64)
            tokens = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
            size = np.repeat(np.array([len(x) for x in sets], np.int32), n)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if heads else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(b["hash"].to_numpy(), n)), pa.array(size), pa.array(pos)], ["token", "hash", "size", "pos"])

    return texts.mapInArrow(run, "token long, hash long, size int, pos int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, cut so that a token's rows are in one portion."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        tokens = t["token"].to_numpy()
        cut = int(np.searchsorted(tokens, tokens[-1])) if len(tokens) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _several(rows: DataFrame, column: str) -> DataFrame:
    """The ``rows`` of tokens with more than one value of ``column``; a token's rows are in one task, by token."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            tokens, values = t["token"].to_numpy(), t[column].to_numpy()
            edge = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            mixed = np.maximum.reduceat(values, edge) != np.minimum.reduceat(values, edge)
            yield from t.filter(pa.array(np.repeat(mixed, np.diff(np.r_[edge, len(tokens)])))).select(names).to_batches(max_chunksize=65536)

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, rows.schema)


def meeting(hashes: np.ndarray, groups: np.ndarray, size: np.ndarray, pos: np.ndarray, least: float, every: bool, step: int = 512) -> Iterator[np.ndarray]:
    """Pairs of places, of one token's rows, whose groups differ and whose sizes and what follows the token allow a similarity of ``least``.

    Either all of them or only those with the row of middle size.
    """
    order = np.lexsort((hashes, size))
    for i in range(0, len(order), step) if every else (len(order) // 2,):
        left = order[i : i + (step if every else 1)]
        right = order[i:] if every else order
        a, b = left[:, None], right[None, :]
        ok = (groups[a] != groups[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)
        ok &= np.minimum(size[a] - pos[a], size[b] - pos[b]) >= least / (1 + least) * (size[a] + size[b]) - 1e-9
        if every:
            ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        x, y = np.nonzero(ok)
        yield np.stack([left[x], right[y]], 1)


def _meetings(rows: DataFrame, labels: DataFrame, least: float, every: bool) -> DataFrame:
    """(a, b): pairs of text hashes, a < b, of different classes that share a token of their prefixes: candidates of any similarity of ``least``."""
    marked = rows.join(labels.select(F.col("vertex").alias("hash"), "component").hint("merge"), "hash", "left")
    marked = marked.select("token", "hash", F.coalesce("component", "hash").alias("component"), "size", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], ["a", "b"])

        for t in _runs(batches):
            tokens, hashes, groups, size, pos = (t[c].to_numpy() for c in ("token", "hash", "component", "size", "pos"))
            edge = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            ends = np.r_[edge[1:], len(tokens)]
            mixed = np.maximum.reduceat(groups, edge) != np.minimum.reduceat(groups, edge)
            waiting, held = [], 0
            for a, z in zip(edge[mixed], ends[mixed]):
                for found in meeting(hashes[a:z], groups[a:z], size[a:z], pos[a:z], least, every):
                    waiting.append(hashes[a:z][found])
                    held += len(found)
                    if held > 65536:
                        yield send(np.concatenate(waiting))
                        waiting, held = [], 0
            if held:
                yield send(np.concatenate(waiting))

    return materialize(marked.repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long").distinct())


def _within(links: DataFrame, nodes: DataFrame, prints: list[str], distance: int) -> DataFrame:
    """The ``links`` (u, v) within ``distance`` bits in any of ``prints``."""
    us = materialize(_joined(links, nodes.select(F.col("hash").alias("u"), *[F.col(p).alias(f"u_{p}") for p in prints]), "u"))
    both = _joined(us, nodes.select(F.col("hash").alias("v"), *[F.col(p).alias(f"v_{p}") for p in prints]), "v")
    bits = [F.bit_count(F.col(f"u_{p}").bitwiseXOR(F.col(f"v_{p}"))) for p in prints]
    return both.where(F.least(*bits, F.lit(BITS)) <= distance).select("u", "v")


def _all_similar(texts: DataFrame, labels: DataFrame, shingle_words: int, least: float, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The labels (vertex, component) after every link of ``least`` or more among ``texts`` (hash, text) that ``only`` leaves, given those of some of the links.

    Sets that alike share a token of their prefixes; only pairs of different classes are compared. A first look compares each with one other
    per token, which joins most of a large group, so that the second, at all pairs that are still apart, is no square of it.
    """
    rows = materialize(_several(_prefixes(texts, shingle_words, least), "hash"))
    for every in (False, True):
        links = _similar(_meetings(rows, labels, least, every), texts, shingle_words, least)
        labels = materialize(apply_links(labels, only(links), FEW))
    discard(rows)
    return labels


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, distance: int = 7, prints: int = 2, least: float = 0.8, every_pair: bool = False) -> DataFrame:
    """``docs`` with one row per class, the one with the smallest (doc_id, text hash), all columns kept.

    Two texts are of one class if links with a shingle similarity of ``least`` or more lead from one to the other; only those of at most ``distance``
    bits in any of ``prints`` fingerprints, or with ``every_pair`` all. Links found by fingerprints come first; then all pairs of different classes
    whose sets can be so alike are looked at, by prefixes of the sets, so that none is missed. A row's key is its doc_id and text, so rows that share an id
    with different texts are documents of their own; of rows equal in both the one stays whose columns, as JSON, come first. Null ids come after all others: such a row
    stays if no row of its class has an id and no other null one a smaller hash. Null and blank texts are one class. An empty table
    gives an empty result; extra columns pass through, whatever their names.
    """
    lean(docs.sparkSession)
    names_given, docs = docs.columns, plain(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    text = F.col("text").cast("string").alias("text")
    marked = materialize(_fingerprints_of(docs.select(key.alias("place"), text), "place struct<none:boolean,id:long,hash:long>", shingle_words, prints))
    names = marked.columns[1:]
    nodes = materialize(marked.groupBy(F.col("place.hash").alias("hash")).agg(F.min("place").alias("low"), *[F.min(n).alias(n) for n in names]))
    texts = docs.select(key["hash"].alias("hash"), text)
    links = _similar(_candidates(nodes, names, distance), texts, shingle_words, least)
    labels = materialize(connected_components(links, few=FEW))
    only = lambda found: found if every_pair else _within(found, nodes, names, distance)
    parts = _all_similar(texts, labels, shingle_words, least, only).withColumnRenamed("vertex", "hash")
    named = nodes.select("hash", "low").join(parts, "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    keep = named.groupBy("component").agg(F.min("low").alias("place")).select("place")
    same = marked.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    keep = materialize(same.join(keep, "place", "left_semi"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), key.alias("place"))
    alone = whole.join(keep.where("n = 1").select("place").hint("merge"), "place").select("row")
    # rows equal in id and text are few, so their side may be broadcast where its size allows; which one stays is settled by all its columns
    several = whole.join(keep.where("n > 1").select("place"), "place").groupBy("place").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.union(several.select("row")).select("row.*").toDF(*names_given)
