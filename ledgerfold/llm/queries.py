"""The thin queries over the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import align, licenses, lines, media, mixture, packing, quality, repair, secrets, simhash, substring, topk, urls

#: The rules of the URL query.
URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_digests(media.media_columns(_table(spark, sf_dir, "documents")))


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner(_table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, distance=4)
    return out.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"), "n_removed", "removed_chars")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair.repair_conversations(repair.damaged(rows), rows)


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "net")
    return out.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align_documents(_table(spark, sf_dir, "documents"), *files, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_media_columns": op4_media_columns,
    "op5_curve_packing": op5_curve_packing,
    "op6_bit_sliced_topk": op6_bit_sliced_topk,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_license_scans": op8_license_scans,
    "op9_url_filters": op9_url_filters,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scans": op12_secret_scans,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

def _license_sql() -> str:
    """The licence scan over the same templates, phrase places by neighbouring words."""
    listed = ", ".join(f"({k}, '{t.label}', {i}, '{w}')" for k, t in enumerate(licenses.TEMPLATES) for i, w in enumerate(t.words))
    needed = ", ".join(f"({k}, {at}, '{w}')" for k, at, w in licenses.key_places(licenses.TEMPLATES))
    return rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS ws FROM documents),
spot AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM doc),
listed(template, label, place, word) AS (VALUES {listed}), needed(template, place, word) AS (VALUES {needed}),
total AS (SELECT count(*) AS n FROM documents), met AS (SELECT word, count(DISTINCT doc_id) AS df FROM spot WHERE word IN (SELECT word FROM listed) GROUP BY 1),
idf AS (SELECT v.word, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM (SELECT DISTINCT word FROM listed) v LEFT JOIN met ON met.word = v.word, total),
wanted AS (SELECT template, count(DISTINCT word) AS n FROM needed GROUP BY 1),
keyed AS (SELECT d.doc_id, d.template FROM (SELECT s.doc_id, n.template, count(DISTINCT n.word) AS n FROM spot s JOIN needed n ON n.word = s.word GROUP BY 1, 2) d JOIN wanted w ON w.template = d.template AND w.n = d.n),
looked AS (SELECT doc_id, template, word FROM (SELECT s.doc_id, s.template, s.word, row_number() OVER (PARTITION BY s.doc_id, s.template ORDER BY i.idf DESC, s.word) AS k
  FROM (SELECT DISTINCT s.doc_id, l.template, s.word FROM spot s JOIN listed l ON l.word = s.word JOIN keyed k ON k.doc_id = s.doc_id AND k.template = l.template) s JOIN idf i ON i.word = s.word) WHERE k <= 8),
held AS (SELECT s.doc_id, l.template, l.label, s.pos - l.place AS shift, sum(i.idf + 1e-9) AS weight FROM looked k JOIN spot s ON k.doc_id = s.doc_id AND k.word = s.word JOIN listed l ON l.word = s.word AND l.template = k.template JOIN idf i ON i.word = s.word GROUP BY 1, 2, 3, 4),
reach AS (SELECT k.doc_id, l.template, sum(i.idf + 1e-9) AS possible FROM looked k JOIN listed l ON l.word = k.word AND l.template = k.template JOIN idf i ON i.word = k.word GROUP BY 1, 2),
good AS (SELECT h.*, possible FROM held h JOIN reach r ON r.doc_id = h.doc_id AND r.template = h.template WHERE weight >= 0.6 * possible),
sure AS (SELECT g.doc_id, g.label, g.shift, g.weight, g.possible FROM good g JOIN needed n ON n.template = g.template JOIN spot s ON s.doc_id = g.doc_id AND s.pos = g.shift + n.place AND s.word = n.word
  GROUP BY g.doc_id, g.template, g.label, g.shift, g.weight, g.possible HAVING count(*) = (SELECT count(*) FROM needed m WHERE m.template = g.template)),
found AS (SELECT doc_id, max(least(1.0, weight / possible)) AS share FROM sure GROUP BY 1),
near AS (SELECT doc_id, pos, word, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM spot WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hit AS (SELECT doc_id, pos, CASE WHEN word = 'mit' AND b = 'license' THEN 'mit' WHEN word = 'apache' AND b = 'license' THEN 'apache' WHEN word = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM near),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hit WHERE label IS NOT NULL GROUP BY 1),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM sure UNION ALL SELECT doc_id, label FROM hit WHERE label IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(round(coalesce(share, 0), 6), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS score
FROM doc d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


def _url_sql() -> str:
    """The listed rules on host and path, and the method's globs as LIKE patterns on the canonical URL."""
    plain = lambda glob: glob.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%").replace("*", "%")
    globs = ", ".join(f"('{plain(h)}', '{plain(p)}')" for h, p in urls.BLOCK_GLOBS)
    read = "path"
    for c in urls.UNRESERVED:
        for code in sorted({f"%{ord(c):02x}", f"%{ord(c):02X}"}):
            read = f"replace({read}, '{code}', '{c}')"
    lower = f"translate({{}}, '{licenses.UPPER}', '{licenses.LOWER}')"
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
stem AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM cut),
parts AS (
  SELECT page_id, {lower.format("regexp_extract(rest, '^[^/]*')")} AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM stem),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts),
escaped AS (
  SELECT *, '.' || regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS chost, {lower.format(read)} AS cpath FROM ruled),
segments AS (
  SELECT *, string_split(regexp_replace(cpath, '/+', '/', 'g'), '/')[2:] AS segs FROM escaped),
walked AS (
  SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(segs, lambda x: [x])),
    lambda a, x: CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END) AS kept FROM segments),
canon AS (
  SELECT *, CASE WHEN strpos(cpath, '//') = 0 AND strpos(cpath, '/.') = 0 THEN cpath
    ELSE '/' || array_to_string(kept, '/') || CASE WHEN segs[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END END AS tidy FROM walked),
globs(h, p) AS (VALUES {globs}),
bad AS (SELECT DISTINCT chost, tidy FROM canon, globs WHERE chost LIKE h ESCAPE '' AND tidy LIKE p ESCAPE '')
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
    WHEN rule IS NOT NULL OR bad.chost IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM canon LEFT JOIN bad ON bad.chost = canon.chost AND bad.tidy = canon.tidy
"""


SQL: dict[str, str] = {
    "op8_license_scans": _license_sql(),
    "op6_bit_sliced_topk": """
WITH fine AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.row_id AS query_row, a.vec_id AS query_id, b.vec_id AS vec_id, b.row_id AS row_id,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: CAST(p[1] AS HUGEINT) * p[2])), 0) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.row_id <> b.row_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op9_url_filters": _url_sql(),
}
