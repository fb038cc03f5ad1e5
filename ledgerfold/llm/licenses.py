"""License scans by a positional rare-token index, with DataFrame functions only.

Template notices are a small index word -> (template, position). A file looks up, for every template whose mandatory words it
holds, its highest-IDF words of that template (IDF over all documents); every place of such a word votes for
(template, place - position), and templates whose rare words agree on one relative position are verified: each mandatory
key phrase must stand at its place.

Scale: one pass splits each text once, counts words and keeps the template words it holds, with their places only where some
template has all its mandatory words; a template without them could not be verified, so nothing is lost, however common
a notice is. Document counts are an aggregate of that narrow table. What is shuffled afterwards are the places of such
files. The template index and the IDF table are bounded by the templates given, so they may be broadcast or put into expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import materialize

#: Characters of a word once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that stand in no word.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


@dataclass(frozen=True)
class Template:
    """A notice's words, its label and the key phrases that must stand in it."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Phrases and labels of the base scan.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of well-known licences, in words as the scan sees them.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "associated documentation files")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "gnu general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: all other ASCII characters become blanks, at which the text is split."""
    return F.array_remove(F.split(F.translate(text, BETWEEN + UPPER, " " * len(BETWEEN) + LOWER), " "), "")


def phrase_starts(words: Column, phrase: list[str]) -> Column:
    """Places (from 0) where the words of a phrase stand consecutively."""

    def here(w: Column, i: Column) -> Column:
        ok = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(ok, i)

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def key_places(templates: tuple[Template, ...]) -> list[tuple[int, int, str]]:
    """(template, position, word) of all words of key phrases, each once."""
    out = set()
    for k, t in enumerate(templates):
        for phrase in (p.split() for p in t.keys):
            at = next(i for i in range(len(t.words)) if t.words[i : i + len(phrase)] == phrase)
            out |= {(k, at + j, w) for j, w in enumerate(phrase)}
    return sorted(out)


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _values(docs: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """A literal table; texts are plain words."""
    cells = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {cells} AS t({names})")


def _has_all(words: list[str], held: Column) -> Column:
    return F.size(F.array_intersect(F.array(*map(F.lit, words)), held)) == len(words)


def word_idf(held: DataFrame, vocabulary: list[str], total: int) -> dict[str, float]:
    """log((documents + 1) / (documents with the word + 1)) of each vocabulary word, from the words ``held`` by all documents."""
    met = held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in met.collect()}  # a row per vocabulary word
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, top_words: int = 8, agreement: float = 0.6) -> DataFrame:
    """Licences of every row: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    The base scan counts every place of ``phrases``. The method looks up, for each template, the ``top_words`` highest-IDF words
    of it that the file holds; a template holds at an offset if the looked-up words that agree on it carry at least
    ``agreement`` of the IDF of those words' places in the template, and all its key phrases stand at their places. No word is
    left out for being common. ``score`` is the largest share, by IDF, of a verified template's looked-up words found in
    place, 0.5 at least where the base scan found a phrase, else 0. Null and empty texts have no words, score 0 and empty
    label strings; repeated rows get equal results, one row each; ties of IDF go by word; extra columns are ignored; an
    empty table gives an empty result.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    vocabulary = sorted({w for t in templates for w in t.words})
    known = sorted({*vocabulary, *(w for p in phrases for w in p.split())})
    keys: dict[int, list[str]] = {}
    for k, _, w in key_places(templates):
        keys.setdefault(k, []).append(w)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text).alias("words"))
    split = split.select("doc_id", "words", F.array_intersect(F.array(*map(F.lit, known)), "words").alias("held"))
    asked = F.array_compact(F.array(*[F.when(_has_all(sorted(set(keys[k])), F.col("held")), F.lit(k)) for k in range(len(templates))]))
    split = split.withColumn("asked", asked)
    none = F.array().cast("array<struct<start:int,label:string>>")
    hits = F.concat(*[F.when(_has_all(sorted(set(p.split())), F.col("held")), _labelled(phrase_starts(F.col("words"), p.split()), v)).otherwise(none) for p, v in phrases.items()])
    listed = F.array(*map(F.lit, vocabulary))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.array_contains(listed, x["word"]))
    rows = materialize(split.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.size("words").cast("long").alias("n_words"), hits.alias("hits"), "held", "asked", F.when(F.size("asked") > 0, spots).alias("places")))

    idf = word_idf(rows, vocabulary, rows.count())
    ranked = sorted(vocabulary, key=lambda w: (-idf[w], w))
    files = rows.where(F.size("asked") > 0)
    order = F.array(*map(F.lit, ranked))
    own = F.element_at(F.array(*[F.array(*map(F.lit, sorted(set(t.words)))) for t in templates]), F.col("template") + 1)
    looked = files.select("row_id", F.array_intersect(order, "held").alias("held"), F.explode("asked").alias("template"))
    looked = materialize(looked.select("row_id", "template", F.explode(F.slice(F.array_intersect("held", own), 1, top_words)).alias("word")))
    spots = materialize(files.select("row_id", F.explode("places").alias("p")).select("row_id", F.col("p.pos").alias("pos"), F.col("p.word").alias("word")))
    postings = _values(docs, [(w, k, i, idf[w] + 1e-9) for k, t in enumerate(templates) for i, w in enumerate(t.words)], "word, template, at, idf")
    asked_at = looked.join(F.broadcast(postings), ["word", "template"])
    reach = asked_at.groupBy("row_id", "template").agg(F.sum("idf").alias("possible"))
    votes = spots.join(asked_at, ["row_id", "word"]).select("row_id", "template", (F.col("pos") - F.col("at")).alias("offset"), "idf")
    held = votes.groupBy("row_id", "template", "offset").agg(F.sum("idf").alias("weight"))
    good = held.join(reach, ["row_id", "template"]).where(F.col("weight") >= agreement * F.col("possible"))
    needed = _values(docs, key_places(templates), "template, at, word")
    wanted = needed.groupBy("template").agg(F.count(F.lit(1)).alias("n_needed"))
    must = good.join(F.broadcast(needed), "template").withColumn("pos", F.col("offset") + F.col("at"))
    there = must.join(spots, ["row_id", "pos", "word"]).groupBy("row_id", "template", "offset", "weight", "possible").agg(F.count(F.lit(1)).alias("n"))
    names = _values(docs, [(k, t.label) for k, t in enumerate(templates)], "template, label")
    sure = there.join(F.broadcast(wanted), "template").where("n = n_needed").join(F.broadcast(names), "template")
    found = sure.groupBy("row_id").agg(F.collect_set("label").alias("own"), F.max(F.least(F.lit(1.0), F.col("weight") / F.col("possible"))).alias("share"))

    blank = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["label"])))
    starts = F.transform("hits", lambda x: x["start"].cast("long"))
    n_base = F.size("hits").cast("long")
    return rows.join(found, "row_id", "left").select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("own", blank))), ",").alias("labels"),
        F.greatest(F.round(F.coalesce("share", F.lit(0.0)), 6), F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"),
    )
