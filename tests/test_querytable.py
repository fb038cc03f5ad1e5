import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import querytable as qt

FIELDS = qt.fields_of(qt.FieldSpec("id", "text"), qt.FieldSpec("name", "text"), qt.FieldSpec("status", "enum"), qt.FieldSpec("count", "number"), qt.FieldSpec("tags", "textarray"), qt.FieldSpec("hidden", "text", filterable=False))
C = qt.Clause


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", "Alpha", "done", 2.0, ["go"]), ("b", "Beta", "open", 7.0, ["ui", "go"]), ("c", "Gamma", "open", 5.0, ["ui"])], "id string, name string, status string, count double, tags array<string>")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_or_group_sort_and_page(rows):
    q = qt.Query(terms=((C("name", "contains", "bet"), C("name", "contains", "gam")), (C("tags", "includes", "ui"),)), sorts=(qt.Sort("count", descending=True),), limit=1, offset=1)
    page, total = qt.run(rows, q, FIELDS)
    assert ids(page) == ["c"] and total.first()["total"] == 2


@pytest.mark.parametrize("op", ["=", "!=", ">"])
def test_blank_value_is_pending(rows, op):
    assert len(ids(qt.where(rows, [[C("count", op, " ")]], FIELDS))) == 3


def test_json_text_arrays(spark):
    f = qt.fields_of(qt.FieldSpec("id", "text"), qt.FieldSpec("tags", "textarray", json_array=True), qt.FieldSpec("strict", "textarray", json_array=True, case_sensitive=True))
    df = spark.createDataFrame([("a", '["Bug","ui"]'), ("b", '["bug"]'), ("c", None), ("d", ""), ("e", "[]"), ("f", "not json")], "id string, tags string").withColumn("strict", F.col("tags"))
    keep = lambda c: sorted(ids(qt.where(df, [[c]], f)))
    assert keep(C("tags", "includes", "BUG")) == ["a", "b"]
    assert keep(C("strict", "includes", "Bug")) == ["a"]
    assert keep(C("strict", "includes", "Bug", negated=True)) == ["b", "f"]
    assert keep(C("tags", "is_null")) == ["c", "d", "e"]


@pytest.mark.parametrize("q", [qt.Query(limit=10_001), qt.Query(terms=((C("nope", "=", 1),),)), qt.Query(terms=((C("count", "contains", "1"),),)), qt.Query(terms=((C("count", ">", "x"),),)), qt.Query(terms=((C("hidden", "=", "x"),),)), qt.Query(sorts=(qt.Sort("nope"),))])
def test_bad_queries_are_rejected(q):
    with pytest.raises(qt.QueryError):
        qt.validate(q, FIELDS)


def test_stats_ignore_empty_values(spark):
    df = spark.createDataFrame([("Alpha", 2.0, ["go"]), ("Alpha", 10.0, []), ("", None, None)], "name string, count double, tags array<string>")
    got = {r["field"]: r for r in qt.field_stats(df, ["name", "count", "tags"], FIELDS).collect()}
    assert got["name"]["n_distinct"] == 1 and got["tags"]["n_distinct"] == 1
    assert (got["count"]["n_distinct"], got["count"]["min"], got["count"]["max"]) == (2, "2.0", "10.0")


def test_sort_agrees_with_a_comparison_of_pairs(spark):
    rng = random.Random(3)
    values = [rng.choice([None, "", "a", "b", "C", "10", "9"]) for _ in range(60)]
    df = spark.createDataFrame([(str(i).zfill(3), v) for i, v in enumerate(values)], "id string, name string")
    for descending in (False, True):
        got = ids(df.orderBy(*qt.order(df, [qt.Sort("name", descending=descending)], "id")))
        want = sorted((v, str(i).zfill(3)) for i, v in enumerate(values) if v)
        want = sorted(want, key=lambda x: x[0], reverse=descending) if descending else want
        assert got == [i for _, i in want] + [str(i).zfill(3) for i, v in enumerate(values) if not v]
