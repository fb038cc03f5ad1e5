"""Alignment of two tokenizers' ids over the same bytes.

Both tokenizers cut the bytes of a blank and a text into tokens; where a token of A and one of B end at the same byte, a group closes.
Within a group the ids of A stand against those of B, and the two tokens that end it are linked.

Fragments of a document form a monoid: a byte range gives an open prefix (the tokens up to its first common end), closed groups and
an open suffix (the tokens after its last common end). Joining two fragments closes one group out of the left one's suffix and the
right one's prefix, so any bracketing of a document's ranges gives the same groups.

Scale: texts are cut into ranges of ``CHUNK`` characters and more, before a blank that follows a letter, digit or mark: no token of either
vocabulary crosses such a place. Short texts are one range and never shuffled; the ranges of long ones are dealt over tasks and their fragments
composed in a tree, ``FAN`` neighbours a step. Counts of linked pairs are summed map-side; a pair's tokens end together, so one is a suffix of the
other, and the number of such pairs in two vocabularies bounds the table of counts before it is broadcast (``suffix_pairs``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerfold.llm.tokens import _byte_letters
from ledgerfold.session import lean, materialize

CHUNK = 1 << 15
FAN = 16
#: Distinct stretches a worker remembers before it starts anew, and how many bytes of text it aligns at a time.
KEPT = 300_000
STEP = 1 << 20
#: Longer words go through the vocabulary's own tokenizer, which finds merges in better than quadratic time.
LONG = 400
#: Fixed value: how byte-level vocabularies of this kind part a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest table of pair counts that is broadcast.
BROADCAST_PAIRS = 2_000_000
_B_BITS = 15
BLANK = "▁"

FRAGMENTS = "key long, doc_id long, chunk int, chunks int, ok boolean, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>"


def token_bytes_a(path: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    back = _byte_letters()
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    return {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocabulary.items()}


def token_bytes_b(path: str) -> dict[int, bytes]:
    """Bytes of each id of a piece vocabulary: the blank's sign as a blank, byte pieces as their byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in pieces}


@lru_cache(maxsize=2)
def suffix_pairs(path_a: str, path_b: str) -> int:
    """How many pairs of tokens could ever be linked: those of which one is a suffix of the other."""
    a, b = list(token_bytes_a(path_a).values()), list(token_bytes_b(path_b).values())
    count_a, count_b = {}, {}
    for t in a:
        count_a[t] = count_a.get(t, 0) + 1
    for t in b:
        count_b[t] = count_b.get(t, 0) + 1
    longer_a = sum(count_b.get(t[i:], 0) for t in a for i in range(len(t)))
    return longer_a + sum(count_a.get(t[i:], 0) for t in b for i in range(1, len(t)))


@lru_cache(maxsize=2)
def may_cut(path_b: str) -> bool:
    """Whether every blank of a piece stands at its start, so that a text may be cut before a blank that follows something else."""
    return not any(b" " in t.lstrip(b" ") for t in token_bytes_b(path_b).values())


class Aligner:
    """Alignments of stretches of text, each a blank and what follows it, remembered by their text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        found_a, found_b = token_bytes_a(path_a), token_bytes_b(path_b)
        ranks = {t: i for i, t in found_a.items() if not self.a.id_to_token(i).startswith("<|")}
        self.joined = tiktoken.Encoding("joined", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [found_a.get(i, b"") for i in range(max(found_a) + 1)]
        self.bytes_b = [found_b.get(i, b"") for i in range(max(found_b) + 1)]
        self.len_a, self.len_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.numbers = pa.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))])
        self.lone = [self.b.piece_to_id(BLANK)]
        self.cuts = may_cut(path_b)
        if len(self.bytes_b) > 1 << _B_BITS or len(self.bytes_a) > 1 << 31 - _B_BITS:
            raise ValueError("a pair of ids must fit into 31 bits")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, tokens of B, groups, whether the bytes are kept
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Align the stretches " " + word of new words and remember them."""
        if len(self.place) + len(words) > KEPT:
            self._forget()
        new = [w for w in words if w not in self.place]
        if not new:
            return
        plain = [w for w in new if w and len(w) <= LONG and not w[-1].isspace()]
        new = plain + [w for w in new if not w or len(w) > LONG or w[-1].isspace()]
        whole = [b" " + w.encode() for w in new]
        sizes = np.fromiter(map(len, whole), np.int64, len(new))
        flat_a, n_a = self._ids_a(new, len(plain), sizes)
        ids_b = [found if w else self.lone for w, found in zip(new, self.b.encode(new, num_threads=1))]
        n_b = np.fromiter(map(len, ids_b), np.int64, len(new))
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        kept = self._kept(flat_a, n_a, self.bytes_a, self.len_a, whole, sizes) & self._kept(flat_b, n_b, self.bytes_b, self.len_b, whole, sizes)
        if not kept.all():
            flat_a, flat_b = flat_a[np.repeat(kept, n_a)], flat_b[np.repeat(kept, n_b)]
            n_a, n_b = n_a * kept, n_b * kept
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto_a, upto_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        stops = np.concatenate([[0], np.searchsorted(upto_a, np.cumsum(n_a))])  # groups closed up to each word's last token of A
        groups = pc.binary_join_element_wise(self._joined(flat_a, upto_a), self._joined(flat_b, upto_b), "|")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), groups), ";").to_pylist()
        base = len(self.place)
        self.place.update(zip(new, range(base, base + len(new))))
        self.text += texts
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, np.diff(stops), kept], 1)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + stops[1:]])
        self.pairs = np.concatenate([self.pairs, ((flat_a[upto_a] << _B_BITS) + flat_b[upto_b]).astype(np.int32)])

    def _ids_a(self, words: list[str], plain: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of all stretches in a row, and how many each has: the first ``plain`` ones are encoded in one text."""
        ids = self.joined.encode_to_numpy("".join([" " + w for w in words[:plain]]), disallowed_special=()).astype(np.int64)
        ends, stops = np.cumsum(self.len_a[ids]), np.cumsum(sizes[:plain])
        upto = np.searchsorted(ends, stops, side="right")
        rest = [e.ids for e in self.a.encode_batch([" " + w for w in words[plain:]], add_special_tokens=False)]
        n = np.concatenate([np.diff(np.concatenate([[0], upto])), np.fromiter(map(len, rest), np.int64, len(rest))])
        return np.concatenate([ids, np.fromiter(chain.from_iterable(rest), np.int64)]), n

    @staticmethod
    def _kept(flat: np.ndarray, n: np.ndarray, known: list[bytes], lengths: np.ndarray, whole: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each stretch spell its bytes: all at once, and one by one where they don't."""
        begins = np.concatenate([[0], np.cumsum(n)])
        covered = np.concatenate([[0], np.cumsum(lengths[flat])])
        if (np.diff(covered[begins]) == sizes).all() and b"".join([known[t] for t in flat.tolist()]) == b"".join(whole):
            return np.ones(len(n), bool)
        ids = flat.tolist()
        return np.array([b"".join([known[t] for t in ids[begins[i] : begins[i + 1]]]) == w for i, w in enumerate(whole)], bool)

    def _joined(self, ids: np.ndarray, last: np.ndarray) -> pa.Array:
        """The ids of each group, the last of which stands at ``last``, as text."""
        offsets = pa.array(np.concatenate([[0], last + 1]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.numbers.take(pa.array(ids))), ",")


def stretches(bodies: pa.Array, cuts: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches of all bodies, the number of each in a row, and where each body's begin.

    A body stands for a blank and its characters. A stretch begins at a blank that follows no white space.
    """
    parts = pc.split_pattern(bodies, " ") if cuts else pa.array([None if x is None else [x] for x in bodies.to_pylist()], pa.list_(pa.string()))
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    glued = np.array([not w or w[-1].isspace() for w in words], bool)[codes] if len(words) else np.zeros(0, bool)
    glued[begins[1:][sizes > 0] - 1] = False
    if not glued.any():
        return words, codes, begins
    first = np.flatnonzero(np.concatenate([[True], ~glued[:-1]]))
    lengths = np.diff(np.concatenate([first, [len(codes)]]))
    out = codes[first]
    known: dict[str, int] = {}
    for i in np.flatnonzero(lengths > 1):
        whole = " ".join([words[c] for c in codes[first[i] : first[i] + lengths[i]]])
        out[i] = known.setdefault(whole, len(words) + len(known))
    return words + list(known), out, np.searchsorted(first, begins)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align_batch(made: Aligner, bodies: pa.Array) -> dict[str, pa.Array]:
    """Columns of ``FRAGMENTS`` for ranges given as text without the blank before them; null stands for a text without tokens."""
    words, codes, begins = stretches(bodies, made.cuts)
    made.learn(words)
    places = np.array([made.place[w] for w in words], np.int64)
    at = places[codes] if len(words) else codes
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(made.sizes[at], 0)])
    n = sums[begins[1:]] - sums[begins[:-1]]
    groups = pa.array([made.text[p] for p in places], pa.string()).take(pa.array(codes)) if len(words) else pa.array([], pa.string())
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), groups), ";")
    held = made.sizes[at, 2]
    total = int(held.sum())
    ahead = np.cumsum(held) - held
    flat = made.pairs[np.repeat(made.starts[at] - ahead, held) + np.arange(total)].astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(begins) - 1), np.diff(begins)), held)
    keys, times = np.unique((row << 32) | flat, return_counts=True)
    stops = pa.array(np.searchsorted(keys, np.arange(len(begins)) << 32), pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(stops, pa.array(x.astype(np.int32)))
    return {
        "ok": pa.array(n[:, 3] == np.diff(begins)), "n_a": pa.array(n[:, 0]), "n_b": pa.array(n[:, 1]), "n_groups": pa.array(n[:, 2]),
        "groups": text, "pairs": listed(keys & 0xFFFFFFFF), "times": listed(times),
    }


def _steps(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about ``STEP`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b["body"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        yield b.slice(at, stop - at)
        at = stop


def ranges(docs: DataFrame, chunk: int = CHUNK, cuts: bool = True) -> DataFrame:
    """(key, doc_id, chunk, chunks, body) of each text: one row for short texts, more for long ones, which are dealt over tasks.

    Without ``cuts`` (a vocabulary whose tokens cross blanks) each text is one range.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.monotonically_increasing_id())
    long = F.coalesce(F.length("text") > chunk, F.lit(False)) & F.lit(cuts)
    short = rows.where(~long).select("key", "doc_id", F.lit(0).alias("chunk"), F.lit(1).alias("chunks"), F.expr("nullif(text, '')").alias("body"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{{chunk}}}.*?[\p{{L}}\p{{N}}\p{{P}}](?= )|.+"), F.lit(0))
    cut = rows.where(long).select("key", "doc_id", pieces.alias("pieces"))
    cut = cut.select("key", "doc_id", F.size("pieces").alias("chunks"), F.posexplode("pieces").alias("chunk", "piece"))
    body = F.when(F.col("chunk") == 0, F.col("piece")).otherwise(F.expr("substring(piece, 2)"))
    dealt = cut.select("key", "doc_id", "chunk", "chunks", body.alias("body")).repartition("key", "chunk")
    return short.unionByName(dealt)


def fragments(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """The fragment of each range, written to the shared folder: sizes, closed groups, and how often each linked pair occurs."""
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(path_a, path_b)
        for b in (part for whole in batches for part in _steps(whole)):
            got = align_batch(made, b["body"])
            yield pa.RecordBatch.from_arrays([b["key"], b["doc_id"], b["chunk"], b["chunks"], *got.values()], ["key", "doc_id", "chunk", "chunks", *got])

    return materialize(ranges(docs, chunk, may_cut(path_b)).mapInArrow(run, FRAGMENTS))


PARTS = ("head_a", "head_b", "closed", "tail_a", "tail_b")


def opened(groups: Column) -> Column:
    """A range's groups as a fragment: its first group is the open prefix, as a range doesn't know what came before it."""
    head = F.substring_index(groups, ";", 1)
    rest = F.when(F.contains(groups, F.lit(";")), F.substring(groups, F.length(head) + 2, F.length(groups))).otherwise("")
    fields = (F.substring_index(head, "|", 1), F.substring_index(head, "|", -1), rest, F.lit(""), F.lit(""))
    return F.struct((groups != "").alias("cut"), *(f.alias(name) for f, name in zip(fields, PARTS)))


def _listed(*parts: Column, by: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), by)


def compose(left: Column, right: Column) -> Column:
    """The fragment of two neighbouring ranges. A fragment without a common end (``cut`` false) is all suffix."""
    a, b = _listed(left["tail_a"], right["head_a"], by=","), _listed(left["tail_b"], right["head_b"], by=",")
    tail = (_listed(left["tail_a"], right["tail_a"], by=","), _listed(left["tail_b"], right["tail_b"], by=","))
    closed = _listed(left["closed"], F.concat(a, F.lit("|"), b), right["closed"], by=";")
    shape = lambda cut, *fields: F.struct(cut.alias("cut"), *(f.alias(name) for f, name in zip(fields, PARTS)))
    yes, no = F.lit(True), F.lit(False)
    joined = shape(yes, left["head_a"], left["head_b"], closed, right["tail_a"], right["tail_b"])
    grown = shape(yes, a, b, right["closed"], right["tail_a"], right["tail_b"])
    held = shape(yes, left["head_a"], left["head_b"], left["closed"], *tail)
    open_ = shape(no, F.lit(""), F.lit(""), F.lit(""), *tail)
    return F.when(left["cut"] & right["cut"], joined).when(right["cut"], grown).when(left["cut"], held).otherwise(open_)


def reduced(frags: DataFrame, chunks: int, fan: int = FAN) -> DataFrame:
    """(key, fragment) of each key, its (key, chunk, fragment) rows composed in a tree: ``fan`` neighbours become one until one is left."""
    nothing = F.struct(F.lit(False).alias("cut"), *(F.lit("").alias(name) for name in PARTS))
    while chunks > 1:
        row = F.sort_array(F.collect_list(F.struct("chunk", "fragment")))
        whole = F.aggregate(row, nothing, lambda acc, x: compose(acc, x["fragment"]))
        frags = materialize(frags.groupBy("key", (F.col("chunk") / fan).cast("int").alias("chunk")).agg(whole.alias("fragment")))
        chunks = -(-chunks // fan)
    return frags.select("key", "fragment")


def grouped(fragment: Column) -> Column:
    """The groups of a whole document's fragment: its prefix has nothing before it, and its last byte ends a group."""
    return F.when(fragment["cut"], _listed(F.concat(fragment["head_a"], F.lit("|"), fragment["head_b"]), fragment["closed"], by=";")).otherwise("")


def align_documents(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, fan: int = FAN, digests: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and B of each group in order. ``n_links`` counts linked token pairs, ``count_sum``
    sums over them how often the pair is linked in all rows, ``n_best`` counts those whose pair is its B id's most frequent one, ties included.
    With ``digests`` a column ``groups_sha256`` stands in place of ``groups`` (empty where they are), so that they needn't be shuffled.

    Null and empty texts, and texts that a tokenizer doesn't keep byte for byte, have no tokens: zeros and empty ``groups``, and they add
    to no count. Rows that repeat a doc_id or a text are aligned and counted each, a null doc_id stays null, other columns are left out, an empty
    table gives an empty result. A stretch without a blank is encoded whole, however long it is.
    """
    frags = fragments(docs, path_a, path_b, chunk)
    single, many = frags.where((F.col("chunks") == 1) & F.col("ok")), frags.where(F.col("chunks") > 1)
    kept = many.groupBy("key", "doc_id").agg(F.bool_and("ok").alias("ok"), *(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")), F.max("chunks").alias("chunks"))
    whole = materialize(kept.where("ok"))
    parts = many.join(whole.select("key"), "key", "left_semi")
    deepest = whole.agg(F.max("chunks")).first()[0] or 0
    text = grouped(F.col("fragment"))
    tree = reduced(parts.select("key", "chunk", opened(F.col("groups")).alias("fragment")), deepest, fan).select("key", text.alias("groups"))
    sizes = ("key", "doc_id", "n_a", "n_b", "n_groups")
    zero = [F.lit(0).cast("long").alias(c) for c in sizes[2:]]
    lost = frags.where((F.col("chunks") == 1) & ~F.col("ok")).select("key", "doc_id", *zero, F.lit("").alias("groups"))
    lost = lost.unionByName(kept.where(~F.col("ok")).select("key", "doc_id", *zero, F.lit("").alias("groups")))
    rows = single.select(*sizes, "groups").unionByName(whole.select(*sizes).join(tree, "key")).unionByName(lost)
    if digests:
        rows = rows.select(*sizes, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))

    linked = single.select("key", "pairs", "times").unionByName(parts.select("key", "pairs", "times"))
    linked = linked.select("key", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair", "times": "n"})
    counts = materialize(linked.groupBy("pair").agg(F.sum("n").cast("long").alias("links")))
    to_b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    best = counts.groupBy(to_b.alias("b")).agg(F.max("links").alias("most"))
    stats = counts.join(best, to_b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).cast("long").alias("best"))
    stats = F.broadcast(stats) if suffix_pairs(path_a, path_b) <= BROADCAST_PAIRS else stats.hint("shuffle_hash")
    sums = linked.join(stats, "pair").groupBy("key").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    out = rows.join(sums, "key", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), none("n_best"), none("count_sum"), rows.columns[-1])
