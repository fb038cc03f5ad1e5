"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes the documents its predecessor kept, written as Parquet and read again. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import lines, mixture, packing, quality, simhash
from ledgerfold.llm.columns import plain
from ledgerfold.session import materialize

#: No SQL: the classifier, fingerprints and token ids can't be stated in it; tests/llm/test_pipeline.py holds the stages to brute-force versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier, learnt from ``labels``, predicts to be good.

    Null and empty texts share one score, equal texts are judged alike, repeated rows and rows with nulls are judged like
    others, other columns pass through, an empty table gives an empty one.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of two lines or more that came before; a text that loses all it had is dropped.

    The first place of a run (smallest doc_id) keeps it. Null, empty and one-line texts and rows with a null doc_id stay as they are;
    rows that repeat a doc_id and text change alike; ``n_chars``, where there is one, is set anew for changed texts; other columns
    pass through, an empty table gives an empty one.
    """
    plainly = plain(docs, ("doc_id", "text", "n_chars"))
    cut = lines.dedup_lines(plainly, every_pair=True, counts=("cuts", "chars")).where("cuts = 0 or text <> ''")
    if "n_chars" in plainly.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("cuts") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(plainly.schema["n_chars"].dataType))
    return cut.select(plainly.columns).toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: all links of a five-word shingle similarity of 0.8 or more, those by fingerprints within seven bits first.

    The row with the smallest (doc_id, text hash) stays, null ids come last, null and blank texts are one class, of rows equal in id and text
    one stays; other columns pass through, an empty table gives an empty one.
    """
    return simhash.drop_near_duplicates(docs, every_pair=True)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the sources' target shares.

    Every row is drawn on its own, also repeated ones and those with a null doc_id; null texts have size 0 and a null source is a source of
    its own; other columns pass through, an empty table gives an empty one.
    """
    return mixture.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a document the mix repeats is packed as often.

    Null and empty texts are the end id alone, a null doc_id stays null, texts of any length are cut as needed, other columns are
    left out, an empty table gives an empty one.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("curve_packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
