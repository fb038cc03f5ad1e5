import random

from pyspark.sql import functions as F

from ledgerfold import session
from ledgerfold.operators import graph, joins, ordering, skew
from ledgerfold.session import materialize


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_of_random_graphs_stars_and_paths(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)]
    pairs += [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5)]
    df = spark.createDataFrame([*pairs, pairs[0], (None, 3)], "a long, b long").repartition(7)
    got = {r["vertex"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {k: v for k, v in union_find([p for p in pairs if p[0] != p[1]]).items()}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_roots_are_cycle_safe(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (7, 100)]
    got = {r["node"]: (r["root"], r["depth"]) for r in graph.pointer_jump(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 8: (8, 0), 9: (9, 0), 7: (100, 1)}


def test_mirrors_do_not_depend_on_order(spark):
    works = [("w1", "conductor", "2026-01-02"), ("w2", "codex", "2026-01-01"), ("w3", "codex", "2026-01-01"), ("w4", "workflow", "2020-01-01"), ("w5", "other", "2026-01-01")]
    links = [("w1", "w2"), ("w3", "w4")]
    want = {"w1": "w2", "w2": "w2", "w3": "w4", "w4": "w4", "w5": "w5"}
    for seed in (0, 1):
        random.Random(seed).shuffle(works)
        df = spark.createDataFrame(works, "workspace_id string, source_kind string, t string").selectExpr("workspace_id", "source_kind", "timestamp(t) activity_at")
        out = joins.suppress_mirrors(df, spark.createDataFrame(links, "left_id string, right_id string"))
        assert {r["workspace_id"]: r["representative"] for r in out.collect()} == want


def test_copies_merge(spark):
    s = "conversation_id string, native_id string, content_hash string"
    stored = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("b", "2", "y")], s)
    copy = spark.createDataFrame([("a", "1", "x"), ("a", "2", "z"), ("b", "1", "x"), ("b", "3", "q")], s)
    got = sorted(tuple(r) for r in joins.merge_copies(stored, copy).collect())
    assert got == [("a", "1", "x"), ("a", "2", "z"), ("b", "1", "x"), ("b", "2", "y"), ("b", "3", "q")]


def test_pointer_jump_takes_chains_of_any_length_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2002), (3000, 3000), (3001, 9999)]
    got = {r["node"]: (r["root"], r["depth"]) for r in graph.pointer_jump(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert all(got[i] == (0, i) for i in range(1000))
    assert all(got[i] == (i, 0) for i in (2000, 2001, 2002, 2003, 3000)) and got[3001] == (9999, 1)
    assert graph.pointer_jump(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_components_with_a_hub(spark):
    edges = [(7, i) for i in range(1000, 1600)] + [(1600 + i, 1601 + i) for i in range(5)] + [(1599, 3)]
    got = {r["vertex"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (7, *range(1000, 1600))} == {3} and {got[i] for i in range(1600, 1606)} == {1600}


def test_salted_join_equals_a_join(spark):
    big = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(600)], "k long, x long")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, y string")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).collect()))
        assert sorted(map(str, skew.salted_join(big, small, "k", [9, 1], how).collect())) == want


def test_scratch_tables_are_removed(spark):
    import os

    t = session.materialize(spark.range(5))
    assert t.count() == 5 and os.path.isdir(t.scratch_path)
    session.discard(t)
    assert not os.path.isdir(t.scratch_path)


def test_numbered_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([((i * 7919) % 1000, i) for i in range(1000)], "x long, y long").repartition(7)
    got = ordering.numbered(df, [F.desc("x"), F.col("y")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001)) and [(-r["x"], r["y"]) for r in got] == sorted((-r["x"], r["y"]) for r in got)
    assert ordering.numbered(df.limit(0), [F.col("x")]).count() == 0


def test_changes_are_attributed_as_by_all_pairs(spark):
    rng = random.Random(3)
    items = [None, "i", "j", "k"]
    convs = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(items), rng.choice([None, *range(20)]), rng.choice([None, *range(5, 30)])) for i in range(30)] + [(40, 7, "i", 0, 3)]
    changes = [(100 + i, rng.choice([1, 1, 2, 3, 7, 8, None]), rng.choice([None, "i", "j", "k", "z"]), rng.choice([None, *range(40)])) for i in range(200)]
    want = {}
    for cid, work, item, at in changes:
        mine = [c for c in convs if work is not None and c[1] == work]
        same = [c[0] for c in mine if item is not None and c[2] == item]
        inside = [c[0] for c in mine if None not in (at, c[3], c[4]) and c[3] <= at <= c[4]]
        found = [(one[0], how) for one, how in (([c[0] for c in mine], "sole"), (same, "work_item"), (inside, "time")) if len(one) == 1]
        want[cid] = found[0] if found else (None, "workspace")
    c = spark.createDataFrame(changes, "change_id long, workspace_id long, work_item string, at int")
    v = spark.createDataFrame(convs, "conversation_id long, workspace_id long, work_item string, started_at int, ended_at int")
    got = {r["change_id"]: (r["conversation_id"], r["scope"]) for r in joins.attribute_changes(c, v).collect()}
    assert got == want and {h for _, h in got.values()} == {"sole", "work_item", "time", "workspace"}


def test_links_in_batches_equal_all_links(spark):
    """Whatever the order of batches, labels equal those of a full run, and only touched groups change."""
    import random

    from ledgerfold.operators.graph import apply_links, connected_components, merge_links

    rng = random.Random(6)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(1, 1), (None, 2), (3, 4), (3, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    flat = lambda df: sorted((r["vertex"], r["component"]) for r in df.collect())
    want = flat(connected_components(frame(links)))
    for order in (links, links[::-1]):
        labels = None
        for i in range(0, len(order), 17):
            labels = materialize(apply_links(labels, frame(order[i : i + 17])))
        assert flat(labels) == want
    changes, fresh = merge_links(labels, frame([(100, 101), (5, 5)]))
    assert changes.count() == 0 and flat(fresh) == [(100, 100), (101, 100)]
    changes, fresh = merge_links(labels, frame([(0, 100)]))
    assert changes.count() == 0 and len(flat(fresh)) == 1


def test_few_links_are_settled_without_rounds(spark, monkeypatch):
    """Labels of a bounded edge list take no round, in one go or in batches, and equal those of rounds; other types than integers and longer lists take rounds."""
    rng = random.Random(9)
    links = [(rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(80)] + [(2**62 + i + 1, 2**62 + i) for i in range(40)] + [(1, 1), (None, 2), (3, 4), (4, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    flat = lambda df: sorted((r["vertex"], r["component"]) for r in df.collect())
    words = spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string")
    want = flat(graph.connected_components(frame(links)))
    assert flat(graph.connected_components(words, few=1000)) == [("a", "a"), ("b", "a"), ("c", "a")]
    star, rounds = graph._star, []
    monkeypatch.setattr(graph, "_star", lambda *a: rounds.append(1) or star(*a))
    assert flat(graph.connected_components(frame(links), few=1000)) == want == sorted(union_find([p for p in links if None not in p and p[0] != p[1]]).items())
    labels = None
    for i in range(0, len(links), 50):
        labels = materialize(graph.apply_links(labels, frame(links[i : i + 50]), few=1000))
    assert flat(labels) == want and graph.connected_components(frame([]), few=1000).collect() == [] and not rounds
    assert flat(graph.connected_components(frame(links), few=20)) == want and rounds


def test_parts_and_suppliers_of_one_number_both_stay(spark, tmp_path):
    from ledgerfold.plans import table_queries

    spark.range(100_000, 100_004).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 3).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, table_queries.union_first(spark, str(tmp_path)).collect()))
    assert got == [(100_000, "stored"), (100_001, "fresh"), (100_001, "fresh"), (100_002, "fresh"), (100_002, "stored"), (100_003, "fresh")]
