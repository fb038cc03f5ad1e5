"""Tokenizer alignment against whole-text encodings aligned pair by pair."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.llm.helpers import AWKWARD, docs
from tokenizers import Tokenizer

from ledgerfold.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat's  own\n   indented code();\r\n\tx = 1  ", " leading blank", "two  blanks", "tail ", " ", "  ", "\n", "\n\n x", "<|endoftext|> </s> <s> <0x41> <unk>", "sign ▁ of a blank",
    "emoji 🙂🙂 and 中文没有空格的文字 日本語", "é é ﬁ ２   nbsp", "a b   c", "\x00 zero", "don't we'll 1234567 ---- ((x))", "word " * 700 + "end", "中文" * 3000,
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), align.token_bytes_a(A), align.token_bytes_b(B)


def plain(text, tools):
    """Ids and byte ends of both sides, from encodings of the whole text; None without tokens."""
    a, b, bytes_a, bytes_b = tools
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(bytes_b[i] for i in ids_b) != whole:
        return None
    ends = []
    for ids, known in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, out = 0, []
        for i in ids:
            at += len(known[i])
            out.append((i, at))
        ends.append(out)
    return ends


def brute(texts, tools):
    held, counts = [], Counter()
    for text in texts:
        ends = plain(text, tools)
        if ends is None:
            held.append((0, 0, [], ""))
            continue
        common = {e for _, e in ends[0]} & {e for _, e in ends[1]}
        sides = [[], []]
        for side, listed in zip(sides, ends):
            group = []
            for i, e in listed:
                group.append(i)
                if e in common:
                    side.append(group)
                    group = []
        links = [(x[-1], y[-1]) for x, y in zip(*sides)]
        counts.update(links)
        groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*sides))
        held.append((len(ends[0]), len(ends[1]), links, groups))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(a, b, len(ln), len(ln), sum(counts[p] == most[p[1]] for p in ln), sum(counts[p] for p in ln), g) for a, b, ln, g in held]


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("chunk", [align.CHUNK, 40])
def test_whole_texts(spark, tools, chunk):
    texts = [t[1] if isinstance(t, tuple) else t for t in AWKWARD] + TEXTS + TEXTS[:3]
    table = docs(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in align.align_documents(table, A, B, chunk=chunk, fan=3).collect()}
    want = brute(texts, tools)
    assert len(got) == len(texts)
    for i, row in enumerate(want):
        assert got[i] == row, (i, texts[i])


def test_real_texts_and_digest(spark, tools, data):
    from ledgerfold.llm.queries import QUERIES

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r["text"] for r in rows], tools)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    got = {r["doc_id"]: (*(r[c] for c in COLS[:-1]), r["groups_sha256"]) for r in QUERIES["op13_tokenizer_alignment"](spark, data).collect()}
    assert got == {r["doc_id"]: (*w[:-1], digest(w[-1])) for r, w in zip(rows, want)}


def test_empty_and_nulls(spark):
    assert align.align_documents(docs(spark, []), A, B).collect() == []
    got = align.align_documents(docs(spark, [(None, "a b"), (None, None), (None, "a b")]), A, B).orderBy("n_a").collect()
    assert [(r["doc_id"], r["n_a"], r["groups"] != "") for r in got] == [(None, 0, False), (None, 2, True), (None, 2, True)]
    assert got[1]["count_sum"] == 4


def test_any_bracketing_of_byte_ranges(spark, tools):
    """Ranges that end anywhere, also inside tokens of either side or without any common end, compose to the whole text's groups."""
    rng = random.Random(3)
    rows, want = [], {}
    for key in range(12):
        text = "".join(rng.choice(["the ", "indivisible", "中文", "\n", " 12", "Ünïcode", "()", "  "]) for _ in range(rng.randint(1, 25)))
        ends = plain(text, tools)
        common = {e for _, e in ends[0]} & {e for _, e in ends[1]}
        want[key] = brute([text], tools)[0][-1]
        borders = sorted(rng.sample(range(1, len((" " + text).encode())), k=min(6, len(text.encode()) - 1))) + [1 << 30]
        start = 0
        for n, stop in enumerate(borders):
            sides = [[(i, e) for i, e in side if start < e <= stop] for side in ends]
            cuts = sorted(c for c in common if start < c <= stop)
            part = lambda lo, hi: [",".join(str(i) for i, e in side if lo < e <= hi) for side in sides]  # noqa: B023, E731
            closed = ";".join("|".join(part(lo, hi)) for lo, hi in zip(cuts, cuts[1:]))
            head, tail = (part(start, cuts[0]), part(cuts[-1], stop)) if cuts else (["", ""], part(start, stop))
            rows.append((key, n, (bool(cuts), *head, closed, *tail)))
            start = stop
    schema = "key long, chunk int, fragment struct<cut boolean, head_a string, head_b string, closed string, tail_a string, tail_b string>"
    table = spark.createDataFrame(rows, schema)
    for fan in (2, 3, 16):
        got = align.reduced(table, 7, fan).select("key", align.grouped(F.col("fragment")).alias("g")).collect()
        assert {r["key"]: r["g"] for r in got} == want


def test_bound_of_pairs():
    """Every linked pair is a suffix pair, so their number is bounded by the vocabularies."""
    assert 50_000 < align.suffix_pairs(A, B) <= align.BROADCAST_PAIRS
