from collections import defaultdict

import numpy as np
import xxhash

from ledgerfold.llm import lines, queries, substring
from tests.llm.helpers import AWKWARD, docs


def brute_lines(rows):
    """(doc, text) in order of doc -> cleaned texts, by keeping the first of each multi-line chunk's bytes."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0], 0)):
        kept = []
        for a, z, n in lines.line_chunks(text or ""):
            piece = text[a:z].rstrip("\n")
            if n < 2 or seen.setdefault(piece, (doc, a)) == (doc, a):
                kept.append(text[a:z])
        left = "".join(kept)
        out[doc] = text if left == (text or "") else left if left.strip() else ""
    return out


def test_line_query(spark, data):
    import hashlib

    d = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    want = brute_lines(list(zip(d["doc_id"].tolist(), d["text"], strict=True)))
    got = {r["doc_id"]: r["kept_md5"] for r in queries.op10_line_dedup(spark, data).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()} and any(want[i] != t for i, t in zip(d["doc_id"], d["text"], strict=True))


def test_line_chunks_cover_and_resist_shifts():
    text = "\n".join(f"line number {i}" for i in range(200))
    parts = lines.line_chunks(text)
    assert "".join(text[a:z] for a, z, _ in parts) == text
    more = "an inserted line\n" + text
    one, two = {text[a:z] for a, z, _ in parts}, {more[a:z] for a, z, _ in lines.line_chunks(more)}
    assert len(one & two) >= len(one) - 3


def test_awkward_lines(spark):
    d = docs(spark, AWKWARD)
    out = lines.dedup_lines(d)
    assert out.columns == [*d.columns, "n_removed", "removed_chars"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(AWKWARD)
    by = dict(got)
    assert by[5] == AWKWARD[5] and len(by[6]) < len(AWKWARD[6]) and by[0] is None and by[7] == AWKWARD[7] and by[None] == "no id"
    same = lines.dedup_lines(docs(spark, [(1, AWKWARD[5]), (1, AWKWARD[5])])).collect()
    assert [r["text"] for r in same] == [AWKWARD[5]] * 2
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def long_runs(texts, k):
    seen = defaultdict(set)
    for i, t in texts.items():
        w = (t or "").split()
        for j in range(len(w) - k + 1):
            seen[" ".join(w[j : j + k])].add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s}


def test_substring_query_finds_passages(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    texts = dict(zip(d["doc_id"].tolist(), d["text"], strict=True))
    got = {r["doc_id"] for r in queries.op2_substring_dedup(spark, sf).collect()}
    assert long_runs(texts, 51) <= got <= long_runs(texts, 18)


def test_cuts_resist_insertions():
    rng = np.random.default_rng(0)
    raw = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    chunks = lambda b: {b[a:z] for a, z in zip([0, *substring.cut_points(b)], substring.cut_points(b).tolist(), strict=False)}
    a, b = chunks(raw), chunks(raw[:5000] + b"inserted" + raw[5000:])
    assert len(a & b) > 0.97 * len(a)
    h = 0
    for x in raw[-32:]:
        h = (2 * h + int(substring.GEAR[x])) & 0xFFFFFFFF
    tail = substring.GEAR[np.frombuffer(raw, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        nxt = tail.copy()
        nxt[s:] += tail[:-s] << np.uint32(s)
        tail = nxt
    assert int(tail[-1]) == h


def test_awkward_passages(spark):
    passage = " ".join(f"w{xxhash.xxh32_intdigest(str(i)) % 9999}" for i in range(80))
    rows = [*AWKWARD, f"début {passage} fin", f"other start {passage}", passage]
    got = substring.repeated_passages(docs(spark, rows)).collect()
    n = len(AWKWARD)
    assert {r["doc_id"] for r in got} == {n, n + 1, n + 2} and {r["first_doc_id"] for r in got} == {n}
    assert {r["doc_id"] for r in got if r["kept"]} == {n}
    assert substring.repeated_passages(docs(spark, [])).count() == 0


def test_every_repeated_chunk_survives_once(spark):
    word = lambda i: f"w{xxhash.xxh32_intdigest(str(i)) % 99_999}"
    text = lambda *spans: " ".join(word(i) for a, z in spans for i in range(a, z))
    rows = [text((0, 120)), text((0, 240)), text((0, 240), (300, 420)), text((300, 420), (900, 905)), text((120, 240), (300, 420), (0, 120))]
    cut, where = defaultdict(list), defaultdict(set)
    for r in substring.repeated_passages(docs(spark, rows)).collect():
        if not r["kept"]:
            cut[r["doc_id"]].append((r["start"], r["stop"]))
    for doc, t in enumerate(rows):
        raw, at = t.encode(), 0
        for z in substring.cut_points(raw).tolist():
            where[raw[at:z]].add((doc, any(a <= at and z <= b for a, b in cut.get(doc, []))))
            at = z
    shared = [s for s in where.values() if len({d for d, _ in s}) > 1]
    assert len(shared) > 30 and cut.keys() == {1, 2, 3, 4}
    for s in shared:
        assert [d for d, gone in sorted(s) if not gone][:1] == [min(d for d, _ in s)] and sum(not gone for _, gone in s) == 1


def test_line_chunks_have_two_lines():
    text = "\n".join(f"line number {i}" for i in range(201))
    assert min(n for _, _, n in lines.line_chunks(text)) >= 2 and lines.line_chunks("one") == [(0, 3, 1)]


def test_every_repeated_run_of_lines_is_cut(spark):
    line = lambda i: f"this is line {xxhash.xxh32_intdigest(str(i))}"
    text = lambda *ids: "\n".join(map(line, ids))
    rows = [text(*range(60)), *(text(1000 + k, *range(k, k + 2 + k % 3), 2000 + k) for k in range(1, 50)), text(*range(60)), text(7, 3000, 9), text(5000, 5000, 5000)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows), every_pair=True).collect()}
    assert got[0] == rows[0] and got[50] == "" and got[51] == rows[51] and got[52] == line(5000) + "\n"
    for k in range(1, 50):
        assert got[k].split("\n") == [line(1000 + k), line(2000 + k)]


def test_line_columns_may_have_any_name(spark):
    rows = ["one line\nand two", "one line\nand two", None]
    d = docs(spark, rows).withColumnsRenamed({"fp": "n_removed", "key": "removed_chars", "spans": "row", "lang": "z"})
    got = lines.dedup_lines(d)
    assert got.columns == [c for c in d.columns if c not in ("n_removed", "removed_chars")] + ["n_removed", "removed_chars"]
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == {0: (rows[0], 0), 1: ("", 1), 2: (None, 0)}
    kept = lines.dedup_lines(d, counts=("a", "b")).where("doc_id = 0").first()
    assert (kept["n_removed"], kept["removed_chars"], kept["row"], kept["a"]) == ("x", 1, "y", 0)


def test_texts_decide_where_digests_collide(spark):
    rng = np.random.default_rng(7)
    rows = ["\n".join(f"line {rng.integers(0, 12)}" for _ in range(8)) for _ in range(40)]
    for pairs in (False, True):
        want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows), every_pair=pairs).collect()}
        assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows), every_pair=pairs, digits=1).collect()} == want
        assert any(want[i] != t for i, t in enumerate(rows))


def test_a_very_common_line_pair(spark):
    rows = [f"head {i}\nthe same line\nand the next\ntail {i}" for i in range(400)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows), every_pair=True).collect()}
    assert got[0] == rows[0] and all(got[i] == f"head {i}\ntail {i}" for i in range(1, 400))


def brute_passages(rows, min_words=20, min_bytes=240):
    """Spans by plain loops over (doc_id, text): chunks by digest of their bytes, runs of shared chunks, cut where the first place changes."""
    where, chunks = defaultdict(set), {}
    for doc, text in rows:
        raw, at, own = (text or "").encode(), 0, []
        for z in substring.cut_points(raw).tolist():
            own.append((at, z))
            where[raw[at:z]].add(doc)
            at = z
        chunks[doc] = raw, own
    out = set()
    for doc, (raw, own) in chunks.items():
        run = []
        for a, z in [*own, (None, None)]:
            docs_ = where[raw[a:z]] if a is not None else ()
            if len(docs_) > 1:
                run.append((a, z, min(docs_)))
                continue
            big = lambda parts: sum(substring.word_ends(raw[p[0] : p[1]]) for p in parts) >= min_words or parts[-1][1] - parts[0][0] >= min_bytes
            if run and big(run):
                parts = [[run[0]]]
                for c in run[1:]:
                    if (c[2] == doc) == (parts[-1][-1][2] == doc):
                        parts[-1].append(c)
                    else:
                        parts.append([c])
                for part in parts:
                    kept = part[0][2] == doc
                    if not kept or big(part):
                        out.add((doc, part[0][0], part[-1][1], len(part), min(c[2] for c in part), kept))
            run = []
    return out


def spans_of(df):
    return {(r["doc_id"], r["start"], r["stop"], r["n_chunks"], r["first_doc_id"], r["kept"]) for r in df.collect()}


def test_passages_against_brute_force(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    assert spans_of(queries.op2_substring_dedup(spark, data)) == brute_passages([(r["doc_id"], r["text"]) for r in d.collect()]) != set()


def test_passages_without_spaces(spark):
    rng = np.random.default_rng(5)
    han = lambda n: "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 5000, n))
    shared, base = han(3000), "".join(chr(97 + int(i)) for i in rng.integers(0, 26, 2000))
    short = han(120)
    rows = [han(50) + shared, shared + han(70), "x" + base, base + "yy", han(200), han(90) + short + han(90), han(80) + short + han(60)]
    got = substring.repeated_passages(docs(spark, rows))
    assert {r["doc_id"] for r in got.collect()} == {0, 1, 2, 3, 5, 6}
    assert spans_of(got) == brute_passages(list(enumerate(rows)))
