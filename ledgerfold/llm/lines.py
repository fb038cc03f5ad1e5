"""Line dedup by content-defined line chunks.

A text's lines are hashed and a rolling hash over the last ``window`` line hashes chooses chunk borders, so an
inserted line moves the borders near it only. A chunk of at least two lines that some document had before is
removed wherever its bytes equal those of the first occurrence; that one stays. ``every_pair`` takes each two neighbouring
lines as a chunk instead, so that no repeated run of two lines or more escapes, whatever stands around it.

Scale: one pass emits a narrow row per multi-line chunk (digest and place, no text); digests are counted with
map-side aggregation. Only documents that hold a repeated digest send text on: the bytes of those chunks are
compared by grouping on the text itself, again pre-aggregated, so a passage in a third of all documents is one row
per task. Whole texts are shuffled twice, compressed. A document's own list of chunks is the largest thing gathered in
one place. Joins are merge joins at every size, and the places of digests that very many chunks have are salted over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ledgerfold.llm.columns import plain
from ledgerfold.operators.skew import hot_keys, salted_join
from ledgerfold.session import lean, materialize


def line_chunks(text: str, window: int = 2, one_in: int = 3, most: int = 16, least: int = 2) -> list[tuple[int, int, int]]:
    """(first character, end, number of lines that aren't blank) of each chunk; chunks cover the text with its line ends.

    A border falls after a line if the rolling hash of the last ``window`` lines that aren't blank is 0 modulo
    ``one_in`` and the chunk has ``least`` such lines, and after ``most`` at the latest. A shorter rest of the text
    joins the chunk before it.
    """
    out, begin, at, lines = [], 0, 0, 0
    recent = [0] * window
    for line in text.split("\n"):
        at += len(line) + 1
        if not line.strip():
            continue
        lines += 1
        recent = [*recent[1:], xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))]
        mixed = 0
        for h in recent:
            mixed = (mixed * 0x9E3779B97F4A7C15 + h) & (2**64 - 1)
        if lines >= least and (mixed >> 17) % one_in == 0 or lines >= most:
            out.append((begin, min(at, len(text)), lines))
            begin, lines = at, 0
    if begin < len(text):
        if out and lines < least:
            begin, _, n = out.pop()
            lines += n
        out.append((begin, len(text), lines))
    return out


def line_pairs(text: str) -> list[tuple[int, int, int]]:
    """(first character, end, 2) of every two neighbouring lines that aren't blank; pairs overlap by a line."""
    places, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            places.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    return [(a, z, 2) for (a, _), (_, z) in zip(places, places[1:], strict=False)]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` as compressed bytes ``z``, for a shuffle; nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = [None if t is None else press(t.encode("utf-8", "surrogatepass")) for t in b["text"].to_pylist()]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "z", pa.array(z, pa.binary()))

    fields = [StructField("z", BinaryType()) if f.name == "text" else f for f in rows.schema]
    return rows.mapInArrow(run, StructType(fields))


def _unpacked(z: list[bytes | None]) -> list[str | None]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [None if x is None else open_(x).decode("utf-8", "surrogatepass") for x in z]


def _chunk_rows(rows: DataFrame, window: int, one_in: int, most: int, every_pair: bool, digits: int) -> DataFrame:
    """(doc_id, text_hash, start, stop, digest) of all chunks of two lines or more; the last line end isn't digested."""
    names = ["doc_id", "text_hash", "start", "stop", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, key, text in zip(*(b[c].to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                for a, z, n in line_pairs(text or "") if every_pair else line_chunks(text or "", window, one_in, most):
                    if n >= 2:
                        digest = xxhash.xxh3_128_hexdigest(text[a:z].rstrip("\n").encode("utf-8", "surrogatepass"))
                        out.append((doc, key, a, z, digest[:digits]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, text_hash long, start long, stop long, digest string")


def _pieces(held: DataFrame) -> DataFrame:
    """(digest, piece, at) of the listed chunks of each text; ``at`` is the chunk's place (doc_id, text_hash, start)."""
    place = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, pieces, at = [], [], []
            for doc, key, text, spans in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), _unpacked(b["z"].to_pylist()), b["spans"].to_pylist(), strict=True):
                for s in spans:
                    digests.append(s["digest"])
                    pieces.append(text[s["start"] : s["stop"]].rstrip("\n"))
                    at.append({"doc_id": doc, "text_hash": key, "start": s["start"]})
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(pieces, pa.string()), pa.array(at, place)], ["digest", "piece", "at"])

    return held.mapInArrow(run, "digest string, piece string, at struct<doc_id:long,text_hash:long,start:long>")


def repeated_chunks(docs: DataFrame, window: int = 2, one_in: int = 3, most: int = 16, every_pair: bool = False, digits: int = 32) -> DataFrame:
    """Chunks to remove: (doc_id, text_hash, start, stop, first_doc_id). Of each repeated chunk the first place stays.

    Texts decide: where one digest (``digits`` hex digits) stands for several texts, each text has a first place of its own.
    """
    lean(docs.sparkSession)
    rows = _rows(docs)
    chunks = materialize(_chunk_rows(rows, window, one_in, most, every_pair, digits).distinct())
    again = materialize(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = hot_keys(again, "digest", chunks.count())
    found = materialize(salted_join(chunks, again.select("digest"), "digest", hot))
    held = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("digest", "start", "stop")).alias("spans"))
    # a repeated row's pieces come twice, at one place: they change neither the texts nor the first place
    pieces = _pieces(_packed(rows.where("doc_id is not null")).join(held.hint("merge"), ["doc_id", "text_hash"]))
    equal = pieces.groupBy("digest", "piece").agg(F.min("at").alias("first_at"))
    first = materialize(equal.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("first_at").alias("first_at")))
    place = F.struct("doc_id", "text_hash", "start")
    sure = first.where("texts = 1").select("digest", "first_at")
    away = salted_join(found, sure, "digest", hot).where(~place.eqNullSafe(F.col("first_at"))).select("doc_id", "text_hash", "start", "stop", F.col("first_at.doc_id").alias("first_doc_id"))
    shared = first.where("texts > 1").select("digest")
    if not shared.isEmpty():
        mixed = pieces.join(shared.hint("merge"), "digest")
        own = mixed.groupBy("digest", "piece").agg(F.min("at").alias("first_at"))
        told = mixed.join(own.hint("merge"), ["digest", "piece"]).where(~F.col("at").eqNullSafe(F.col("first_at"))).select("at.*", F.col("first_at.doc_id").alias("first_doc_id")).distinct()
        away = away.unionByName(found.select("doc_id", "text_hash", "start", "stop").join(told.hint("merge"), ["doc_id", "text_hash", "start"]))
    return materialize(away)


def dedup_lines(docs: DataFrame, window: int = 2, one_in: int = 3, most: int = 16, every_pair: bool = False, digits: int = 32, counts: tuple[str, str] = ("n_removed", "removed_chars")) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut from ``text``, and two more columns, named by ``counts``: n_removed, removed_chars.

    A chunk has two lines or more that aren't blank. The first place of a repeated chunk (smallest doc_id, then first in the text) keeps
    it. By content-defined borders a passage that starts or ends inside a chunk stays there; with ``every_pair`` all lines of every
    run of two lines or more that came before are cut, the first place of each line stays, and n_removed counts pairs. Null, empty and one-line texts never change; rows with a null doc_id are left as they are and count for nobody;
    rows that repeat a doc_id and text count once and change alike. Line ends inside what stays are kept as they were.
    Other columns pass through, also ones named like the helpers here; columns that have the names in ``counts`` are replaced. An empty
    table gives an empty result.
    """
    names = [c for c in docs.columns if c not in counts]
    docs = plain(docs).select(*[p for p, c in zip(plain(docs).columns, docs.columns) if c not in counts])
    cols = docs.columns
    away = repeated_chunks(docs, window, one_in, most, every_pair, digits)
    spans = away.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    row = F.struct(*[F.lit(None).cast("string").alias(c) if c == "text" else F.col(c) for c in cols]).alias("row")
    text = F.col("text").cast("string")
    whole = _packed(docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")))
    joined = whole.join(spans.hint("merge"), ["doc_id", "text_hash"], "left")
    shape = StructType([docs.select(row).schema["row"], StructField("text", StringType()), StructField("n_removed", LongType()), StructField("removed_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed, gone = [], [], []
            for text, cuts in zip(_unpacked(b["z"].to_pylist()), b["spans"].to_pylist(), strict=True):
                if cuts:
                    at, kept = 0, []
                    for c in cuts:
                        kept.append(text[at : c["start"]])
                        at = c["stop"]
                    kept.append(text[at:])
                    left = "".join(kept)
                    left = left if left.strip() else ""
                    removed.append(len(cuts))
                    gone.append(len(text) - len(left))
                    text = left
                else:
                    removed.append(0)
                    gone.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_removed", "removed_chars"])

    cut = joined.select("row", "z", "spans").mapInArrow(run, shape)
    out = cut.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in cols], "n_removed", "removed_chars")
    return out.toDF(*names, *counts)
