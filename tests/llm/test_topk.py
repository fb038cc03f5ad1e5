import numpy as np

from ledgerfold.llm import queries, topk


def whole(x):
    return int(x) * 256 if abs(x) >= 2**53 else int(np.floor(256 * float(x)))


def brute(rows, every, k):
    """(query_id, rank, vec_id, score) as sorted rows; every other row is a candidate."""
    q = [(i, [whole(x) for x in v]) for i, v in rows]
    out = []
    for a, (i, x) in enumerate(q):
        if i % every == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), j) for b, (j, y) in enumerate(q) if b != a)[:k]
            out += [(i, n + 1, j, -s if abs(s) < 2**63 else None) for n, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def test_query(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    assert result(queries.op6_bit_sliced_topk(spark, data)) == brute(list(zip(e["vec_id"], e["embedding"], strict=True)), 50, 5)


def test_ties_signs_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 256]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size, cell in ((16, 1 << 20), (1000, 1 << 20), (1000, 256)):
        assert result(topk.top_inner(df, 10, 7, block_rows=size, chunk_rows=5, cell_bytes=cell)) == brute(rows, 10, 7)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    for top in (70_000.0, 1e9, 1e15, 1e25):
        rows = [(i, [float(x) for x in rng.uniform(-top, top, 3)]) for i in range(40)] + [(40, [top, -top, 0.001])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert result(topk.top_inner(df, 10, 4, block_rows=16)) == brute(rows, 10, 4)
    rows = [(i, [x]) for i, x in enumerate((1.0, 65_536.0, 100_000.0, 200_000.0))]
    assert [r[3] for r in result(topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))] == [256 * 51_200_000, 256 * 25_600_000, 256 * 16_777_216]


def test_every_row_is_a_candidate(spark):
    rows = [(7, [float(x), 1.0]) for x in range(1, 7)] + [(8, [0.5, 0.5]), (9, [0.5, 0.5]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (100, [2.0, 0.0]), (7, [6.0, 1.0])]
    for size in (4, 1000):
        got = topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=size)
        assert result(got) == brute(rows, 50, 5)


def test_order_key():
    values = [-(1 << 90), -(1 << 64), -257, -256, -255, -1, 0, 1, 255, 256, 1 << 63, 1 << 1000]
    assert [topk.order_key(v) for v in values] == sorted(map(topk.order_key, values))


def test_digits_and_slices():
    for v in range(-300, 301):
        assert sum(d << s for s, d in topk.signed_digits(v)) == v
    rng = np.random.default_rng(3)
    m = rng.integers(-500, 500, (200, 6))
    b = topk.BitSlices.of(m)
    q = rng.integers(-500, 500, 6)
    at, score = b.top(q, 200, None)
    assert sorted(at) == list(range(200)) and (score == (m @ q)[at]).all()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, []), (7, [1e30, -1e30])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x string, block int, row_id int")
    fine = [(i, v) for i, v in rows if i in (0, 5, 6, 7)]
    assert result(topk.top_inner(df, 50, 5)) == brute(fine, 50, 5)
    assert topk.top_inner(df.limit(0)).count() == 0 and topk.top_inner(df.where("vec_id = 0").limit(1)).count() == 0


def test_the_index_is_sent_once_per_lane(spark):
    for n in (200, 2000):
        rows = topk.usable(spark.range(n).selectExpr("id AS vec_id", "array(double(id), 1D) AS embedding"))
        blocks, queries = n // 50, rows.where("vec_id % 50 = 0")
        for lanes in (1, 3):
            sent = topk.dealt(topk.build_index(rows, blocks, 2), queries, blocks, lanes)
            got = sent.selectExpr("spark_partition_id() AS part", "block", "lane", "slices IS NULL AS query", "row_id").collect()
            assert sum(not r["query"] for r in got) == blocks * lanes and sum(r["query"] for r in got) == blocks * n // 50
            held = {(r["part"], r["block"], r["lane"]) for r in got if not r["query"]}
            assert len(held) == blocks * lanes and all((r["part"], r["block"], r["lane"]) in held for r in got)
