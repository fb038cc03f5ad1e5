"""Embeddings and explanations against plain sums over each text's features."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import semantic as S

TEXTS = ["failing build on release", "the failing builds, the fixed tests", "", "!!", "a", "é ß", "bug bug bug a/b.c x-1 word" * 40, "Resolved the database errors"]


def test_vectors_equal_plain_ones(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None, TEXTS[0]]], "text string")
    got = {r["text"]: np.array(r["vector"]) for r in S.embed(df).collect()}
    assert set(got) == set(TEXTS)
    for t in TEXTS:
        assert np.allclose(got[t], S.embed_text(t), atol=1e-9), t
        assert abs(np.linalg.norm(got[t]) - bool(S.text_features(t))) < 1e-9
    assert "Python" not in S.embed(df)._jdf.queryExecution().toString()


def plain(query, text):
    wanted, own = S.text_features(query), S.text_features(text or "")
    q, v = np.zeros(S.DIMS), np.zeros(S.DIMS)
    for target, found in ((q, wanted), (v, own)):
        for f, w in found.items():
            at, sign = S.bucket_of(f)
            target[at] += sign * w
    scale = (np.linalg.norm(q) or 1) * (np.linalg.norm(v) or 1)
    return {f: (S.bucket_of(f)[1] * w * v[S.bucket_of(f)[0]] / scale, w * own.get(f, 0) / scale) for f, w in wanted.items()}


@pytest.mark.parametrize("query", ["failing build on release", "fix the error in tests", "zzz"])
def test_cosines_are_split_by_feature(spark, query):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "id long, text string")
    got = {}
    for r in S.explain_similarity(query, docs).collect():
        got.setdefault(int(r["id"]), {})[r["feature"]] = (r["cosine"], r["signal"])
        assert abs(r["cosine"] - r["signal"] - r["noise"]) < 1e-12
    for i, t in enumerate([*TEXTS, None]):
        want = plain(query, t)
        assert set(got[i]) == set(want)
        assert all(np.allclose(got[i][f], want[f], atol=1e-9) for f in want), (query, t)
        assert abs(sum(c for c, _ in got[i].values()) - S.embed_text(query) @ S.embed_text(t or "")) < 1e-9
    assert S.explain_similarity("", docs).count() == 0


def test_fields_share_the_signal(spark):
    rows = [("d", "title", "failing build"), ("d", "body", "the release failed"), ("d", "note", None), ("e", "title", "unrelated")]
    docs = spark.createDataFrame(rows, "id string, field string, text string")
    query = "failing build on release"
    got = {(r["id"], r["field"]): r["signal"] for r in S.explain_fields(query, docs).collect()}
    whole = S.explain_similarity(query, docs).groupBy("id").agg(F.sum("signal").alias("s")).collect()
    for r in whole:
        assert abs(sum(v for (i, _), v in got.items() if i == r["id"]) - r["s"]) < 1e-9
    assert got["d", "title"] > got["d", "body"] > 0 and ("d", "note") not in got


def exchanges(df):
    """The lines of a plan where rows are shuffled."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


def test_vectors_shuffle_texts_and_no_features(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert all(re.search(r"hashpartitioning\(_k1#\d+L, _k2#\d+L, \d+\)", line) for line in exchanges(S.embed(df)))


@pytest.mark.parametrize("explained", [S.explain_similarity, S.explain_fields])
def test_explanations_shuffle_texts_and_no_features(spark, explained):
    docs = spark.createDataFrame([("d", "title", t) for t in TEXTS], "id string, field string, text string")
    assert all("hashpartitioning(id#" in line for line in exchanges(explained("failing build", docs)))
    assert len([line for line in exchanges(explained("failing build", docs)) if "text" in line or "REPARTITION_BY_COL" in line]) == 1


def test_explanations_of_many_rows_sum_up(spark):
    """Queries with more features than a lane has slots, fields without the query's words, several texts of an id and field."""
    rows = [(i % 5, f"f{i % 3}", f"{t} {'errors in workspace' if i % 2 else 'nothing'} {i}") for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "id long, field string, text string")
    query = "resolve the failing builds of conversation errors"
    whole = {r["id"]: r["s"] for r in S.explain_similarity(query, docs).groupBy("id").agg(F.sum("signal").alias("s")).collect()}
    got = {}
    for r in S.explain_fields(query, docs).collect():
        got[r["id"]] = got.get(r["id"], 0.0) + r["signal"]
    assert set(got) == set(whole) and all(abs(got[i] - whole[i]) < 1e-12 for i in got)
    wanted, length = S.text_features(query), np.linalg.norm([sum(S.bucket_of(f)[1] * w for f, w in S.text_features(query).items() if S.bucket_of(f)[0] == b) for b in range(S.DIMS)])
    for i in range(5):
        own: dict = {}
        for _, _, t in (r for r in rows if r[0] == i):
            for f, w in S.text_features(t).items():
                own[f] = own.get(f, 0.0) + w
        v = np.zeros(S.DIMS)
        for f, w in own.items():
            v[S.bucket_of(f)[0]] += S.bucket_of(f)[1] * w
        assert abs(whole[str(i)] - sum(w * own.get(f, 0.0) for f, w in wanted.items()) / length / np.linalg.norm(v)) < 1e-9


def test_features_are_counted_where_their_texts_lie(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, "failing again")], "id long, text string")
    found = S.features(docs, ["id"])
    assert [line for line in exchanges(found) if "feature" in line] == []
    got = {(r["id"], r["feature"]): r["weight"] for r in found.collect()}
    want: dict = {}
    for i, t in [*enumerate(TEXTS), (0, "failing again")]:
        for f, w in S.text_features(t).items():
            want[i, f] = want.get((i, f), 0.0) + w
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
