import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerfold.llm import mixture, queries
from tests.llm.helpers import AWKWARD, docs


def targets(sizes, most=3.0):
    """Sharing by rounds, in plain Python; ``sizes`` is in source order."""
    w = [1 + i % 3 for i in range(len(sizes))]
    t, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = [i for i in open_ if unit * w[i] > most * sizes[i]]
        if not over:
            for i in open_:
                t[i] = unit * w[i]
            break
        for i in over:
            t[i] = most * sizes[i]
            left -= t[i]
            open_.remove(i)
    return t


def test_query_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_source_mix(spark, sf).toPandas()
    again = queries.op3_source_mix(spark, sf).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    m = got.merge(d, on="doc_id")
    assert len(m) == len(d) and (m["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in m["text"]]).all()
    per = m.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert np.allclose(per["target"], targets(per["size"].tolist()))
    assert (abs(per["taken"] - per["target"]) <= 0.01 * per["target"] + 1).all()
    assert (m["taken"] <= 3 * m["size"]).all() and abs(per["target"].sum() - per["size"].sum()) < 1e-6


def test_caps_and_excess(spark):
    d = docs(spark, ["w " * 10, "w " * 1000, "w " * 500, "w " * 3, "", None], ["a", "b", None, "c", "e", "d"])
    got = {r["doc_id"]: r for r in mixture.mix_counts(d).collect()}
    want = targets([10, 1000, 3, 0, 0, 500])
    assert [round(got[i]["target"], 6) for i in (0, 1, 3, 5, 4, 2)] == [round(x, 6) for x in want]
    assert got[0]["taken"] == 30 and got[3]["taken"] == 9 and got[4]["taken"] == got[5]["taken"] == 0


def test_many_blocks_of_one_source(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i), int(s), "a", 0.3) for i, s in enumerate(rng.pareto(1.2, 3000) * 50 + 1)]
    units = spark.createDataFrame(rows, "row_id long, doc_id long, size long, source_key string, p double")
    got = mixture.draw(units, block_rows=20).collect()
    assert len(got) == 3000 and {r["p"] for r in got} == {0.0, 1.0}
    want = 0.3 * sum(r[2] for r in rows)
    # what no exchange can close is less than the longest document
    assert abs(sum(rows[r["row_id"]][2] * r["p"] for r in got) - want) < max(0.01 * want, max(r[2] for r in rows) / 2)
    assert abs(sum(r["p"] for r in got) - 900) < 30


def test_flight_keeps_count_and_size():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 90, 200), np.full(200, 0.4)
    q = mixture.flight(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - 80) < 1e-6 and abs((q * size).sum() - 0.4 * size.sum()) < 1e-6


def test_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    assert mixture.mix_counts(d).count() == len(AWKWARD)
    assert mixture.mix_counts(docs(spark, [])).count() == 0 and mixture.mix(docs(spark, [])).count() == 0
    out = mixture.mix(d)
    assert out.columns == d.columns and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6


def test_mix_takes_each_row_as_drawn(spark):
    """Brute force: the mix holds every row ``copies`` times, repeated and null ids, clashing columns and all."""
    rows = [(1, "a b c"), (1, "d e"), (1, "d e"), (None, "f g h"), (None, "i"), (2, None), (3, "j k l m"), (4, "n " * 50)]
    d = docs(spark, rows, ["a", "b", "b", "b", "a", None, None, "c"]).withColumnsRenamed({"fp": "mix_copies", "key": "row_id", "spans": "row"})
    got = mixture.mix(d)
    assert got.columns == d.columns
    taken, want = Counter((r["doc_id"], len((r["text"] or "").split())) for r in got.collect()), Counter()
    for r in mixture.mix_counts(d).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    assert taken == +want and sum(want.values()) > 4


def test_rows_that_repeat_without_end_are_spread(spark):
    d = docs(spark, [(7, "a b c")] * 900 + [(None, "d e")] * 900 + [(i, "x " * (i % 9 + 1)) for i in range(600)], ["a"] * 1800 + ["b"] * 600)
    got = mixture.mix_counts(d, block_rows=50).toPandas()
    assert len(got) == 2400
    for _, g in got.groupby("target"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.01 * g["target"].iloc[0] + 3
    again = mixture.mix_counts(d, block_rows=50).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))


def test_layouts_of_the_same_rows_agree(spark):
    """However the table is cut into files, also with many rows equal in id and size, the same copies are drawn."""
    rows = [(i % 40, "w " * (i % 3)) for i in range(1500)] + [(7, "a b c")] * 400 + [(None, "d e")] * 300
    d = docs(spark, rows, [f"s{i % 4}" for i in range(1500)] + ["s0"] * 700)
    seen = []
    for table in (d, d.repartition(1), d.repartition(9), d.orderBy("text").repartition(3)):
        got = mixture.mix_counts(table, block_rows=60).select("doc_id", "size", "source_size", "copies").collect()
        seen.append(Counter(map(tuple, got)))
    assert all(s == seen[0] for s in seen)
