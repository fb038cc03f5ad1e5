import zlib

import numpy as np

from ledgerfold.llm import quality, queries
from tests.llm.helpers import AWKWARD, docs


def test_held_out_accuracy_and_repeats(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    m = got.merge(labels, on="doc_id")
    m = m[m["held_out"]]
    assert (m["predicted"] == m["quality"]).mean() > 0.97
    good, bad = m[m["quality"] == 1]["score"].to_numpy(), m[m["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98


def test_only_texts_and_unheld_labels_matter(spark):
    texts = [f"plain words number {i} here" if i % 2 else f"###!! {i} $$$ %%%" for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    run = lambda ls: {r["doc_id"]: r["score"] for r in quality.score_documents(docs(spark, texts), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect()}
    a, b = run(labels), run(flipped)
    assert a == b and all((a[i] >= 0.5) == bool(i % 2) for i in a)


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, AWKWARD)
    got = quality.score_documents(d, none).collect()
    assert len(got) == len(AWKWARD) and all(r["predicted"] == 1 for r in got)
    few = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 1, 0), (6, 0, None), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(d, few).collect()
    assert len(got) == len(AWKWARD) and len({r["score"] for r in got if r["doc_id"] in (0, 1)}) == 1
    assert quality.score_documents(docs(spark, []), few).count() == 0
    kept = quality.keep_good(d, none)
    assert kept.columns == d.columns and kept.count() == len(AWKWARD)


def test_threshold_is_the_share_of_bad_labels():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(1, 1, (80, 3)), rng.normal(-1, 1, (20, 3))]
    y = np.r_[np.ones(80), np.zeros(20)]
    assert abs((quality.fit_ranker(x, y).score(x) < 0.5).sum() - 20) <= 1
