import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from ledgerfold.llm import packing, queries
from ledgerfold.llm.tokens import encoder
from tests.llm.helpers import AWKWARD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts, length=2048):
    """Every id in exactly one piece, sequences gapless, full or a power of two."""
    for (doc,), g in pieces.groupby(["doc_id"]):
        ids = ids_of(texts[doc])
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() == len(ids) and (g["doc_tokens"] == len(ids)).all()
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = g["length"].sum()
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and n <= length and n & (n - 1) == 0


def test_query(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    got = queries.op5_curve_packing(spark, data).toPandas()
    assert set(got["doc_id"]) == set(d["doc_id"])
    check(got, dict(zip(d["doc_id"], d["text"], strict=True)))


def test_ids_equal_the_tokenizers():
    for text in ("", "Don't STOP!!  it's 42nd é ŒUVRE 'LL", "<|endoftext|> a<|startoftext|>b", "İstanbul Σας ſ", "e\u0301 a\x1cb\x85c\u3000d", "日本語 😀 x", "x" * 500, "a\u00a0b², ½!"):
        assert encoder(PATH).encode(pa.array([text]))[0].tolist() == ids_of(text)[:-1], text


def test_ids_of_a_batch_equal_the_tokenizers():
    texts = ["", None, "Don't it''s 'tis x'll'", "a\x1cb c'd", "日本語 x 日本語", "y" * 300 + " z", "<|startoftext|> İ don't 5²", "plain, words. (only) 1234 Only", " \n\t", "'"]
    for rows in (texts, texts[:1], texts[::-1], texts * 3, []):
        ids, sizes = encoder(PATH).encode(pa.array(rows, pa.string()), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[: len(rows)]] == [ids_of(t) for t in rows] and len(ids) == sizes.sum()


def test_pieces_lie_in_hilbert_order(spark, data):
    """Brute force: keys from each text's own counts; the sequences, in order, walk the curve."""
    d = spark.read.parquet(f"{data}/documents.parquet")
    bucket, matrix = packing.projection()
    keys = {}
    for r in d.select("doc_id", "text").toLocalIterator():
        v = np.zeros(packing.HASHED)
        for x in ids_of(r["text"])[:-1]:
            v[bucket[x] % packing.HASHED] += 1 if bucket[x] < packing.HASHED else -1
        v = np.sign(v) * np.sqrt(np.abs(v))
        v = v / max(1e-300, np.sqrt((v * v).sum())) @ matrix
        keys[r["doc_id"]] = int(packing.hilbert_key(packing.cells_of(v[None, :]))[0])
    got = packing.pack(d, PATH, stretch_bytes=1 << 16).toPandas().sort_values(["sequence_id", "offset"])
    order = [(keys[i], i, s) for i, s in zip(got["doc_id"], got["start"], strict=True)]
    assert order == sorted(order) and got["sequence_id"].max() >> 40 > 0


def test_awkward_rows(spark):
    rows = [t for t in AWKWARD if not isinstance(t, tuple)]
    got = packing.pack(docs(spark, rows), PATH, 64, digests=True).toPandas()
    check(got, dict(enumerate(rows)), 64)
    twice = packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (None, "c")]), PATH, digests=True).toPandas()
    assert len(twice) == 3 and twice["length"].sum() == 3 + 3 + 2
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_hilbert_neighbours_touch():
    n = 8
    cells = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = packing.hilbert_key(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(n**3)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
