import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerfold.llm import queries, simhash
from ledgerfold.operators import graph
from tests.llm.helpers import AWKWARD, docs


def brute(text, k):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, d):
    """Smallest id reachable, by comparing all pairs."""
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in rows:
            for b, y in rows:
                if (x ^ y).bit_count() <= d and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("k", [4, 5])
def test_fingerprints(k):
    rng = random.Random(k)
    for n in (0, 1, 3, 4, 5, 60):
        text = " ".join(rng.choice(["a", "B", "é", "of"]) for _ in range(n))
        assert simhash.fingerprint(text, k) == brute(text, k)


def test_query_against_all_pairs(spark, data):
    got = queries.op7_simhash_near_dedup(spark, data).toPandas()
    texts = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    fps = [(d, brute(t, 4)) for d, t in zip(texts["doc_id"], texts["text"], strict=True)]
    want = classes(fps, 4)
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == want
    assert dict(zip(got["doc_id"], got["fingerprint"], strict=True)) == {d: f"{f:016x}" for d, f in fps}


@pytest.mark.parametrize("max_bucket", [20_000, 70])
@pytest.mark.parametrize("distance", [4, 7])
def test_links_connect_what_all_pairs_connect(spark, max_bucket, distance):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for f in list(fps)[:20]:
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 1))))
    core = rng.getrandbits(64)
    fps |= {core ^ (1 << a) ^ (1 << b) for a in range(9) for b in range(9) if a < b}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, max_bucket).collect()
    assert all((np.uint64(r["u"] & (2**64 - 1)) ^ np.uint64(r["v"] & (2**64 - 1))).item().bit_count() <= distance for r in links)
    label = {f: f for f in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        a, b = root(r["u"]), root(r["v"])
        label[max(a, b)] = min(a, b)
    want = classes([(f, f & (2**64 - 1)) for f in signed], distance)
    assert {f: root(f) for f in signed} == want
    assert len(links) < 40 * len(fps)


def test_awkward_rows(spark):
    got = simhash.near_duplicates(docs(spark, AWKWARD), 4, 4).toPandas()
    assert len(got) == len(AWKWARD)
    by = {d: c for d, c in zip(got["doc_id"], got["component_id"], strict=True) if d == d}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == 5
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def runs_of(text, k=5):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def second(h):
    x = (h + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    return x ^ (x >> 27)


def kept_rows(rows, d=7, least=0.8):
    """Brute force over all pairs: (doc_id, text) of the least row of each class, null ids last.

    Two rows are linked if either of two fingerprints is within ``d`` bits and their sets of shingles are alike enough.
    """
    sets, prints = [], []
    for _, t in rows:
        h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs_of(t)]
        prints.append([sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in g) > len(g)) for g in (h, [second(x) for x in h])])
        sets.append(set(runs_of(t)))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = any((a ^ b).bit_count() <= d for a, b in zip(prints[i], prints[j], strict=True))
            if near and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    best = {}
    for i, (doc, text) in enumerate(rows):
        key = (doc is None, doc or 0, int(np.int64(np.uint64(xxhash.xxh64((text or "").encode(), seed=42).intdigest()))))
        best[root(i)] = min(best.get(root(i), (key, i)), (key, i))
    return sorted(((rows[i][0], rows[i][1] or "") for _, i in best.values()), key=str)


def test_links_are_verified(spark):
    """Texts that share one run of words many times over have near fingerprints, but few shingles in common."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 99999)}"
    chant = "la la la la la " * 200
    rows = [(i, chant + " ".join(word() for _ in range(12))) for i in range(6)]
    base = [word() for _ in range(400)]
    rows += [(10 + i, " ".join(base[:-1] + [word()])) for i in range(6)]
    assert len({simhash.fingerprint(t) for i, t in rows if i < 6}) < 6
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect())
    assert got == [0, 1, 2, 3, 4, 5, 10]


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(300))
    a, b, c = text(), text(), text()
    cases = [
        [(1, a), (1, b)], [(0, b), (1, a), (1, b)], [(5, a), (5, a), (4, a), (None, a)], [(None, a), (None, a), (None, b)], [(7, None), (6, ""), (8, " ")],
        [(3, a), (9, a.replace("w1", "w2", 1)), (2, c), (2, c + " end"), (None, None)], [],
    ]
    for rows in cases:
        df = docs(spark, rows).withColumnsRenamed({"fp": "place", "key": "n", "spans": "row"})
        out = simhash.drop_near_duplicates(df)
        assert out.columns == df.columns
        assert sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=str) == kept_rows(rows), rows


def test_dropping_against_all_pairs(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["text"] or "") for r in simhash.drop_near_duplicates(d).collect()), key=str) == kept_rows(rows)


def test_links_left_to_earlier_masks():
    """By hand: under which masks two fingerprints agree, and a mask of a bucket keyed again counts as the first."""
    rng = np.random.default_rng(8)
    masks = simhash.block_masks(2**64 - 1, 4, 2)
    diff = rng.integers(0, 2**63, 300, dtype=np.uint64) & rng.integers(0, 2**63, 300, dtype=np.uint64) & rng.integers(0, 2**63, 300, dtype=np.uint64)
    used = np.array([masks[i] for i in rng.integers(0, len(masks), 300)], np.uint64)
    got = simhash.earlier_bucket(diff, used, masks)
    assert got.tolist() == [any(int(d) & m == 0 for m in masks[: masks.index(int(u))]) for d, u in zip(diff, used)]
    assert not simhash.earlier_bucket(diff, np.full(300, 3, np.uint64), masks).any()


def all_pairs_kept(rows, least=0.8):
    """Brute force over all pairs: ids (distinct, not null) of the least row of each class of texts that are alike enough, whatever their fingerprints."""
    sets, label = [set(runs_of(t)) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[:k]:
            if len(sets[j]) >= least * len(sets[i]) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), doc), doc)
    return sorted(best.values())


def edited(rng, words, share):
    """``words`` with changes at places spread so that about ``share`` of the five-word shingles stay alike."""
    out = list(words)
    n = round(len(words) * (1 - share) / (1 + share) / 5 * 2 / 2)
    for k in range(n):
        out[int((k + 0.5) * len(words) / max(1, n))] = f"x{rng.randint(0, 10**9)}"
    return out


def test_every_similar_pair_is_linked(spark, monkeypatch):
    """Pairs about the threshold, many of which are beyond the bits in both fingerprints, among texts that share frequent passages."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        base = [f"w{rng.randint(0, 99999)}" for _ in range(rng.choice([6, 20, 90, 300]))] + passage[: rng.choice([0, 0, 30, 60])]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(edited(rng, base, rng.uniform(0.75, 0.9)))), (3 * i + 2, " ".join(edited(rng, base, rng.uniform(0.75, 0.9))))]
    frequent = simhash._frequent
    monkeypatch.setattr(simhash, "_frequent", lambda texts, k: frequent(texts, k, 4, 1000))
    df = docs(spark, rows)
    want = all_pairs_kept(rows)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df, every_pair=True).collect()) == want
    near = kept_rows(rows)
    assert len(near) > len(want)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()), key=str) == near


def test_prefixes_of_similar_sets_meet():
    """By hand: in any one order, two sets alike by 0.8 share a token of their prefixes, also where frequent tokens come last."""
    rng = np.random.default_rng(4)
    last = np.sort(rng.integers(0, 400, 60).astype(np.uint64))
    last = np.unique(last)
    rank = rng.permutation(len(last))
    for _ in range(3000):
        pool = rng.permutation(400).astype(np.uint64)
        n = int(rng.integers(1, 40))
        a = np.sort(pool[:n])
        b = np.sort(np.r_[pool[: n - int(rng.integers(0, n // 5 + 1))], pool[n : n + int(rng.integers(0, n // 5 + 1))]])
        if simhash.similarity(a, b) >= 0.8:
            for late, order in ((last, rank), (last[:0], rank[:0])):
                x, y = simhash.prefix(a, late, order, 0.8), simhash.prefix(b, late, order, 0.8)
                assert set(x.tolist()) & set(y.tolist())


def test_few_links_take_no_rounds(spark, monkeypatch):
    """The near-dedup's few links are settled without rounds, each of which is a full set of tasks where partitions aren't merged."""
    rounds, star = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda *a: rounds.append(1) or star(*a))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "other words")]
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows), every_pair=True).collect()) == [1, 3] and not rounds
