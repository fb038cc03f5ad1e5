from collections import Counter

import corpus_pipeline

from ledgerfold.llm import lines, mixture, quality
from tests.llm.helpers import AWKWARD, docs
from tests.llm.test_packing import check
from tests.llm.test_simhash import kept_rows


def test_stages_in_order_and_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, before = docs.columns, docs.count()
    from ledgerfold.session import materialize

    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        kept.append((name, docs.count()))
        if name != "curve_packing":
            assert docs.columns == cols
    assert [n for n, _ in kept] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mix", "curve_packing"]
    assert before > kept[0][1] > kept[1][1] > kept[2][1] > 0
    assert "sequence_id" in docs.columns


def test_quality_stage_agrees_with_the_scores(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = {r["doc_id"] for r in quality.score_documents(d, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, d, sf).collect()} == want


def test_line_stage_drops_emptied_texts_only(spark):
    text = "\n".join(f"a whole line {i}" for i in range(40))
    d = docs(spark, [text, text, "", None, "short"]).select("doc_id", "text", "lang", "source", "n_chars")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, d, "").collect()}
    assert {0, 2, 3, 4} <= set(got) and got[0] == (text, len(text))
    assert 1 not in got or len(got[1][0]) == got[1][1] < len(text)


def test_stages_take_empty_tables(spark):
    d = docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, "/root/testdata/sf0.001").count() == 0, name


def test_line_stage_leaves_no_repeated_run_of_lines(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen, first = {}, d.toPandas().sort_values("doc_id")
    for doc, text in zip(first["doc_id"], first["text"], strict=True):
        for a, z, _ in lines.line_pairs(text):
            seen.setdefault(text[a:z].rstrip("\n"), (doc, a))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, d, "").collect()}
    for doc, text in zip(first["doc_id"], first["text"], strict=True):
        spans, at, kept = [(a, z) for a, z, _ in lines.line_pairs(text) if seen[text[a:z].rstrip("\n")] != (doc, a)], 0, ""
        for a, z in spans:
            kept, at = kept + text[at:a], z
        kept += text[at:]
        assert left.get(doc, "") == (kept if kept.strip() else ""), doc


def test_stages_take_awkward_rows_and_names(spark):
    """Nulls, repeats, ties, clashing columns: each stage keeps its columns, and what it says of such rows holds."""
    d = docs(spark, AWKWARD).withColumnsRenamed({"fp": "n_removed", "key": "copies", "spans": "row"})
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, d, sf).columns == d.columns, name
    got = corpus_pipeline.line_stage(spark, d, sf).collect()
    assert len(got) == len(AWKWARD) - 1 and {r["n_removed"] for r in got} == {"x"} and 6 not in {r["doc_id"] for r in got}
    assert corpus_pipeline.line_stage(spark, d.drop("n_chars"), sf).columns == d.drop("n_chars").columns
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert sorted(((r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_stage(spark, d, sf).collect()), key=str) == kept_rows(rows)
    assert corpus_pipeline.pack_stage(spark, d, sf).where("start = 0").count() == len(AWKWARD)


def test_stages_take_any_column_name(spark):
    """Blanks, colons, dots, backticks, names that differ in case only, and names with nested fields."""
    names = ["my col", "a:b", "a.b", "c`d", "Text", "DOC_ID", "n_Chars", "row.text", ""]
    rows = [(1, "good words here\nand a second line", "s", 37), (2, "good words here\nand a second line", "s", 37), (None, None, None, None), (3, "other", "t", 5)]
    d = spark.createDataFrame([(*r, *[f"{i}{r[0]}" for i in range(len(names))]) for r in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"x{i} string" for i in range(len(names))))
    nested = d.selectExpr("*", "named_struct('in ner', x0, 'a.b', x1) AS s").toDF("doc_id", "text", "source", "n_chars", *names, "st:ruct")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, nested, sf)
        assert out.columns == nested.columns, name
        for r in out.collect():
            assert r[4:13] == tuple(f"{i}{r[0]}" for i in range(len(names))), name
            assert r[13]["in ner"] == r[4]
    cut = lines.dedup_lines(nested).collect()
    assert sorted(r["n_removed"] for r in cut) == [0, 0, 0, 1]


def test_pipeline_against_brute_force(spark):
    """Each stage over what the one before it kept, held to plain Python over all rows."""
    sf = "/root/testdata/sf0.001"
    from ledgerfold.session import materialize

    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    ranker = quality.train(d, labels)
    good = {i: t for i, t in table(d).items() if ranker.score(quality.features(t)[None, :])[0] >= 0.5}
    one = materialize(corpus_pipeline.quality_stage(spark, d, sf))
    assert table(one) == good
    seen, left = {}, {}
    for doc, text in sorted(good.items()):
        kept, at = "", 0
        for a, z, _ in lines.line_pairs(text or ""):
            if seen.setdefault(text[a:z].rstrip("\n"), (doc, a)) != (doc, a):
                kept, at = kept + text[at:a], z
        kept += (text or "")[at:]
        if kept == (text or ""):
            left[doc] = text
        elif kept.strip():
            left[doc] = kept
    two = materialize(corpus_pipeline.line_stage(spark, one, sf))
    assert table(two) == left
    three = materialize(corpus_pipeline.near_stage(spark, two, sf))
    assert sorted(((i, t or "") for i, t in table(three).items()), key=str) == kept_rows(list(left.items()))
    four = materialize(corpus_pipeline.mix_stage(spark, three, sf))
    counts = {r["doc_id"]: r["copies"] for r in mixture.mix_counts(three).collect()}
    assert Counter(r["doc_id"] for r in four.collect()) == +Counter(counts)
    for (_, target), g in mixture.mix_counts(three).toPandas().groupby(["source_size", "target"]):
        assert abs(g["taken"].sum() - target) <= max(0.05 * target, g["size"].max())
    five = corpus_pipeline.pack_stage(spark, four.dropDuplicates(["doc_id"]), sf).toPandas()
    check(five, table(four))
    assert spark.createDataFrame(five).agg({"length": "sum"}).first()[0] == sum(five.groupby("doc_id")["doc_tokens"].first())
