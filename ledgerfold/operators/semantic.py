"""Feature-hash embeddings: signed, weighted word, trigram and pair features in 384 buckets, and what a cosine is made of.

Features are exploded by built-in expressions and summed per (document, feature) before they are shuffled; bucket and sign are taken from
``xxhash64``. A vector is a sparse aggregate, laid out once. The features of a query are bounded by its text, so they are
literals in the plan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import text as T

DIMS = 384
WORD, TRIGRAM, PAIR = 1.0, 0.18, 0.55
_WORDS = r"[a-z0-9_./-]+"
SEED = 42  # of Spark's xxhash64
LANE_BITS = 3
LANES = 1 << LANE_BITS


def normal_word(word: str) -> str:
    """A word's concept, else the word without its plain endings."""
    return T.CONCEPTS.get(word) or word.removesuffix("ing").removesuffix("ed").removesuffix("s")


def text_features(text: str) -> dict[str, float]:
    """The features of a query: normal words of two letters or more, letter trigrams with word ends, word pairs."""
    words = [normal_word(w) for w in re.findall(_WORDS, text.lower())]
    listed = [(f"w:{w}", WORD) for w in words if len(w) > 1] + [(f"b:{a}:{b}", PAIR) for a, b in zip(words, words[1:])]
    for w in words:
        ends = f"^{w}$"
        listed += [(f"c:{ends[i : i + 3]}", TRIGRAM) for i in range(len(ends) - 2)]
    out: dict[str, float] = {}
    for feature, weight in listed:
        out[feature] = out.get(feature, 0.0) + weight
    return out


def bucket_of(feature: str) -> tuple[int, float]:
    """Bucket and sign of a feature, as the columns below take them."""
    h = xxhash.xxh64_intdigest(feature.encode(), SEED)
    signed = h - (1 << 64) if h >> 63 else h
    return signed % DIMS, 1.0 if signed >= 0 else -1.0


def embed_text(text: str) -> np.ndarray:
    """The unit vector of a query; zero for a text without words."""
    v = np.zeros(DIMS)
    for feature, weight in text_features(text or "").items():
        at, sign = bucket_of(feature)
        v[at] += sign * weight
    n = np.sqrt(v @ v)
    return v / n if n else v


def _normal_words(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, _word, _after): the normal words of each text in turn, each with the next one, null for the last."""
    listed = df.where(F.col(text).isNotNull()).select(*keys, F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORDS), F.lit(0)).alias("_ws"))
    after = F.slice("_ws", F.lit(2), F.greatest(F.size("_ws"), F.lit(1)))
    each = listed.select(*keys, F.inline(F.arrays_zip(F.col("_ws").alias("_word"), after.alias("_after"))))
    concepts = F.create_map(*[F.lit(x) for kv in T.CONCEPTS.items() for x in kv])
    for name in ("_word", "_after"):
        each = each.withColumn("_bare", F.col(name))
        for ending in ("ing", "ed", "s"):  # a column for each step, so that none is computed twice
            each = each.withColumn("_bare", F.when(F.col("_bare").endswith(ending), F.substring("_bare", F.lit(1), F.length("_bare") - len(ending))).otherwise(F.col("_bare")))
        each = each.withColumn(name, F.when(F.col(name).isin(list(T.CONCEPTS)), F.element_at(concepts, F.col(name))).otherwise(F.col("_bare")))
    return each.select(*keys, "_word", "_after")


def listed_features(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, feature): the features of each text, repeats included; their first letters tell their weights. Null texts have none."""
    words = _normal_words(df, keys, text).withColumn("_ends", F.concat(F.lit("^"), "_word", F.lit("$")))
    places = words.select(*keys, "_word", "_after", "_ends", F.explode(F.sequence(F.lit(-1), F.length("_word"))).alias("_at"))
    places = places.where("(_at <> -1 or length(_word) > 1) and (_at <> 0 or _after is not null)")
    gram = F.concat(F.lit("c:"), F.substring("_ends", F.col("_at"), F.lit(3)))
    return places.select(*keys, F.when(F.col("_at") > 0, gram).when(F.col("_at") == 0, F.concat(F.lit("b:"), "_word", F.lit(":"), "_after")).otherwise(F.concat(F.lit("w:"), "_word")).alias("feature"))


def _percent(feature: Column) -> Column:
    """The weight of a feature in hundredths: whole numbers sum to the same in any order."""
    return F.when(feature.startswith("c"), round(TRIGRAM * 100)).when(feature.startswith("b"), round(PAIR * 100)).otherwise(round(WORD * 100)).cast("long")


def features(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, feature, weight): the features of each key's texts, weights summed. Null texts have none.

    The texts are shuffled by key, not their features.
    """
    counted = listed_features(df.select(*keys, text).repartition(*keys), keys, text).groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, "feature", (F.col("n") * _percent(F.col("feature")) / 100).alias("weight"))


def _lanes(df: DataFrame, keys: Sequence[str], asked: Sequence[str] = (), per_asked: Sequence[str] = (), text: str = "text") -> DataFrame:
    """(keys, per_asked, lane, sums): signed weights by slot, in hundredths, LANES slots in a row; ``df`` is partitioned by its keys.

    A feature's slot is its bucket, those of ``asked`` have slots of their own behind the buckets; ``per_asked`` is null but for those. So a
    document has few rows, and no row of a feature is shuffled.
    """
    h = F.xxhash64("feature")
    slot = F.pmod(h, F.lit(DIMS)).cast("int")
    if asked:
        numbers = F.create_map(*[F.lit(x) for i, f in enumerate(asked) for x in (f, DIMS + i)])
        near = slot.isin(sorted({bucket_of(f)[0] for f in asked}))  # whole numbers are compared first, texts for few features
        slot = F.when(near & F.col("feature").isin(list(asked)), F.element_at(numbers, F.col("feature"))).otherwise(slot)
    signed = _percent(F.col("feature")) * F.when(h >= 0, 1).otherwise(-1)
    each = listed_features(df, [*keys, *per_asked], text).select(*keys, *per_asked, slot.alias("slot"), signed.alias("value"))
    own = [F.when(F.col("slot") >= DIMS, F.col(c)).alias(c) for c in per_asked]
    each = each.select(*keys, *own, F.shiftright("slot", LANE_BITS).alias("lane"), F.col("slot").bitwiseAND(LANES - 1).alias("at"), "value")
    sums = [F.sum(F.when(F.col("at") == i, F.col("value")).otherwise(F.lit(0).cast("long"))).alias(f"v{i}") for i in range(LANES)]
    return each.groupBy(*keys, *per_asked, "lane").agg(*sums).select(*keys, *per_asked, "lane", F.array(*[f"v{i}" for i in range(LANES)]).alias("sums"))


def _slots(lanes: Column, n: int) -> Column:
    """The first ``n`` slots (a multiple of LANES) of a list of (lane, sums), zero where there is none."""
    by_lane = F.map_from_entries(lanes)
    none = F.array_repeat(F.lit(0).cast("long"), LANES)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n // LANES - 1)), lambda i: F.coalesce(F.element_at(by_lane, i), none)))


def _length(slots: Column) -> Column:
    return F.sqrt(F.aggregate(slots, F.lit(0.0), lambda s, x: s + x * x))


def embed(df: DataFrame, text: str = "text") -> DataFrame:
    """(text, vector): one unit vector per distinct text, zero for a text without words; null texts have none.

    The texts are shuffled once, by two hashes and each once per task; what follows stays in their partitions.
    """
    keys = ["_k1", "_k2"]
    keyed = df.select(F.col(text).alias("text")).where("text is not null").withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64("text", F.lit(1))})
    texts = keyed.groupBy(*keys).agg(F.first("text").alias("text"))
    per = _lanes(texts, keys).groupBy(*keys).agg(F.collect_list(F.struct("lane", "sums")).alias("lanes"))
    per = per.select(*keys, _slots(F.col("lanes"), DIMS).alias("slots")).select(*keys, "slots", _length(F.col("slots")).alias("norm"))
    unit = F.transform("slots", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), DIMS)
    return texts.join(per.hint("merge"), keys, "left").select("text", F.coalesce(unit, none).alias("vector"))


def _explained(query: str, docs: DataFrame, per_asked: Sequence[str] = ()) -> tuple[DataFrame, dict[str, float], float]:
    """(id, lanes) of documents shuffled by id, lanes with their ``per_asked``; the query's features and the length of its vector."""
    wanted = text_features(query)
    v = np.zeros(DIMS)
    for feature, weight in wanted.items():
        at, sign = bucket_of(feature)
        v[at] += sign * weight
    texts = docs.select(F.col("id").cast("string").alias("id"), *per_asked, "text").where("id is not null").repartition("id")
    lanes = _lanes(texts, ["id"], list(wanted), per_asked).groupBy("id").agg(F.collect_list(F.struct("lane", "sums", *per_asked)).alias("lanes"))
    return lanes, wanted, float(np.sqrt(v @ v)) or 1.0


def _whole(slots: Column, wanted: dict[str, float]) -> tuple[dict[int, Column], Column]:
    """The sums of the query's buckets, asked features included, and the vector's length, in hundredths."""
    asked: dict[int, list[int]] = {}
    for i, f in enumerate(wanted):
        asked.setdefault(bucket_of(f)[0], []).append(i)
    others = {at: slots[at].cast("double") for at in asked}
    whole = {at: sum((slots[DIMS + i] for i in found), others[at]) for at, found in asked.items()}
    squares = F.aggregate(F.slice(slots, 1, DIMS), F.lit(0.0), lambda s, x: s + x * x)
    return whole, F.sqrt(sum((whole[at] * whole[at] - others[at] * others[at] for at in asked), squares))


def explain_similarity(query: str, docs: DataFrame) -> DataFrame:
    """(id, feature, cosine, signal, noise): the cosine of the query with each document of (id, text), split by query feature.

    Signal is what the document's own use of the feature adds, noise what other features in its bucket add; a document's rows sum to its
    cosine. Several texts of an id are one document; documents without words have zeros.
    """
    lanes, wanted, length = _explained(query, docs)
    n = DIMS + -(-len(wanted) // LANES) * LANES
    rows = docs.select(F.col("id").cast("string").alias("id")).distinct().join(lanes.select("id", _slots(F.col("lanes"), n).alias("slots")), "id", "left")
    rows = rows.select("id", F.coalesce("slots", F.array_repeat(F.lit(0).cast("long"), n)).alias("slots"))
    whole, norm = _whole(F.col("slots"), wanted)
    signs = {f: bucket_of(f)[1] for f in wanted}
    parts = [F.struct(F.lit(f).alias("feature"), (whole[bucket_of(f)[0]] * signs[f] * w).alias("all"), (F.col("slots")[DIMS + i] * signs[f] * w).alias("own")) for i, (f, w) in enumerate(wanted.items())]
    asked = F.array(*parts) if parts else F.array().cast("array<struct<feature:string,all:double,own:double>>")
    each = rows.select("id", (F.lit(length) * F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))).alias("scale"), F.inline(asked))
    cosine, signal = F.col("all") / F.col("scale"), F.col("own") / F.col("scale")
    return each.select("id", "feature", cosine.alias("cosine"), signal.alias("signal"), (cosine - signal).alias("noise"))


def explain_fields(query: str, docs: DataFrame) -> DataFrame:
    """(id, field, signal): how much each field of documents (id, field, text) adds to their cosine by features it shares with the query.

    A document is its fields' features together; pairs do not cross fields. A document's signals sum to that of ``explain_similarity``.
    """
    lanes, wanted, length = _explained(query, docs, ["field"])
    n = -(-len(wanted) // LANES)
    weights = [w * bucket_of(f)[1] for f, w in wanted.items()] + [0.0] * (n * LANES - len(wanted))
    of_lane = F.array(*[F.array(*map(F.lit, weights[i * LANES : (i + 1) * LANES])) for i in range(n)]) if n else F.array(F.array().cast("array<double>"))
    lane, first = F.col("lanes"), DIMS // LANES
    own = F.filter(lane, lambda x: x["lane"] >= first)
    fields = [F.aggregate(F.filter(own, lambda x: x["lane"] == first + i), F.array_repeat(F.lit(0).cast("long"), LANES), lambda s, x: F.zip_with(s, x["sums"], lambda a, b: a + b)) for i in range(n)]  # noqa: B023
    others = F.transform(F.filter(lane, lambda x: x["lane"] < first), lambda x: F.struct(x["lane"].alias("lane"), x["sums"].alias("sums")))
    rows = lanes.select("id", own.alias("own"), F.concat(_slots(others, DIMS), *fields).alias("slots")).where(F.size("own") > 0)
    norm = _whole(F.col("slots"), wanted)[1]
    each = rows.select("id", (F.lit(length) * F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))).alias("scale"), F.inline("own"))
    dot = F.aggregate(F.zip_with("sums", of_lane[F.col("lane") - first], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return each.groupBy("id", "field").agg((F.sum(dot) / F.max("scale")).alias("signal"))
