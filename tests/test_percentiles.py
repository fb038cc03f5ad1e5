"""Exact percentiles against the built-in aggregate, whatever the brackets say."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import percentiles as P

PS = (0.0, 0.25, 0.5, 0.9, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [("hot", None, rng.choice([rng.random(), 0.5, float(rng.randint(0, 9))])) for _ in range(9000)] + [("one", 1, 4.0), ("two", 1, 1.0), ("two", 1, 2.0), (None, 2, 3.0), (None, 2, 9.0), ("none", 3, None)]
    return spark.createDataFrame(rows, "a string, b int, x double")


@pytest.mark.parametrize("reach,fine", [(P.REACH, None), (0.0, None), (0.3, 0)])
def test_equal_to_the_aggregate(table, reach, fine):
    want = {(r["a"], r["b"]): r["x"] for r in table.where("x is not null").groupBy("a", "b").agg(F.percentile("x", list(PS)).alias("x")).collect()}
    got = {}
    for r in P.exact_percentiles(table, ["a", "b"], "x", PS, reach, fine).collect():
        got.setdefault((r["a"], r["b"]), {})[r["p"]] = r["value"]
    assert got == {k: dict(zip(PS, v)) for k, v in want.items()}


def test_only_brackets_are_ordered(spark, monkeypatch):
    seen = []
    real = P.numbered
    monkeypatch.setattr(P, "numbered", lambda df, *a: seen.append(df.count()) or real(df, *a))
    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.col("id") * 7 % 40_000).cast("double").alias("x"))
    got = P.exact_percentiles(df, ["g"], "x", [0.5]).first()
    assert got["value"] == 19_999.5 and seen[0] < 2_000


def test_empty(spark):
    assert P.exact_percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).count() == 0
