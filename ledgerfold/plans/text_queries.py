"""Queries over texts and vectors: functions, index, search, authorship, embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerfold.functions import dates
from ledgerfold.functions import text as T
from ledgerfold.operators import authorship, search, semantic
from ledgerfold.operators.ordering import numbered
from ledgerfold.operators.textindex import TextIndex
from ledgerfold.plans.book import Book
from ledgerfold.plans.standins import messages, table
from ledgerfold.session import scratch_folder
from ledgerfold.sources import transcripts

BOOK = Book()


def corpus(spark, sf_dir):
    """Documents as messages of (id, created_at, conversation_id, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"), (F.col("doc_id") % 50).cast("string").alias("conversation_id"), "text")


W = "w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), ix AS (SELECT term, id, count(*) AS tf FROM w GROUP BY 1, 2), len AS (SELECT id, sum(tf) AS length FROM ix GROUP BY 1)"


@BOOK.add(f"WITH {W} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM ix GROUP BY 1")
def word_index(spark, sf_dir):
    return search.build_index(corpus(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@BOOK.add(f"""WITH {W}, st AS (SELECT count(*) AS nd, avg(length) AS al FROM len), h AS (SELECT * FROM ix WHERE term IN ('the', 'with')), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1), f AS (SELECT id FROM h GROUP BY 1 HAVING count(*) = 2),
s AS (SELECT h.id, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS score FROM h JOIN f ON f.id = h.id JOIN d ON d.term = h.term JOIN len ON len.id = h.id CROSS JOIN st GROUP BY 1) SELECT id, round(round(score, 6), 4) AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT 500""")
def bm25_search(spark, sf_dir):
    return search.search_text(search.build_index(corpus(spark, sf_dir)), ["with", "the"], recent=None).select("id", F.round("score", 4).alias("score"))


@BOOK.add("SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)')")
def phrase_search(spark, sf_dir):
    m = corpus(spark, sf_dir)
    return search.search_phrase(m, search.build_index(m), "of the").select("id")


@BOOK.add("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the ')")
def substring_search(spark, sf_dir):
    return search.search_substring(corpus(spark, sf_dir), ["TION", "the "]).select("id")


@BOOK.add(f"""WITH {W}, st AS (SELECT count(*) AS nd, avg(length) AS al FROM len), h AS (SELECT * FROM ix WHERE term IN ('the', 'with')), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1), f AS (SELECT id FROM h GROUP BY 1 HAVING count(*) = 2),
s AS (SELECT h.id, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS score FROM h JOIN f ON f.id = h.id JOIN d ON d.term = h.term JOIN len ON len.id = h.id CROSS JOIN st GROUP BY 1) SELECT id, round(round(score, 6), 4) AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT 500""")
def stored_bm25(spark, sf_dir):
    """The same ranking from an index in segments: a third of the messages with other texts first, then all in two deltas."""
    return _stored(spark, sf_dir).search(["with", "the"], best=search.BEST).select("id", F.round("score", 4).alias("score"))


def _stored(spark, sf_dir):
    m = corpus(spark, sf_dir)
    index = TextIndex(spark, scratch_folder(spark, "index"), buckets=8)
    index.add(m.where("id % 3 = 0").withColumn("text", F.concat(F.lit("with the stale of the "), "text")))
    index.add(m.where("id % 3 <> 1"))
    index.add(m.where("id % 3 = 1"))
    return index


@BOOK.add(r"""WITH d AS (SELECT doc_id AS id, text FROM documents), v AS (SELECT id, text, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])in[^\p{L}\p{N}]+the([^\p{L}\p{N}]|$)') AS words FROM d)
SELECT id, 'words' AS variant FROM v WHERE words UNION ALL SELECT id, 'case' FROM v WHERE words AND regexp_matches(text, 'In[^\p{L}\p{N}]+the')
UNION ALL SELECT id, 'separators' FROM v WHERE words AND contains(lower(text), 'in, the') UNION ALL SELECT id, 'both' FROM v WHERE words AND contains(text, 'in, the')""")
def phrase_variants(spark, sf_dir):
    m, index = corpus(spark, sf_dir), _stored(spark, sf_dir)
    variants = {"words": ("in the", False, False), "case": ("In the", False, True), "separators": ("In, the", True, False), "both": ("in, the", True, True)}
    parts = [index.search_phrase(m, *v).select("id", F.lit(name).alias("variant")) for name, v in variants.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@BOOK.add("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'ation') AND contains(lower(text), 'the ')")
def trigram_search(spark, sf_dir):
    return _stored(spark, sf_dir).search_substring(corpus(spark, sf_dir), ["ATION", "the ", "x"]).select("id")


@BOOK.add(f"""WITH {W}, v AS (SELECT DISTINCT term FROM ix), d AS (SELECT term, CASE WHEN CASE WHEN ends_with(term, 'ation') AND length(term) > 8 THEN left(term, length(term) - 5) WHEN ends_with(term, 'ments') AND length(term) > 8 THEN left(term, length(term) - 5) WHEN ends_with(term, 'ment') AND length(term) > 7 THEN left(term, length(term) - 4) WHEN ends_with(term, 'ingly') AND length(term) > 8 THEN left(term, length(term) - 5) WHEN ends_with(term, 'ing') AND length(term) > 6 THEN left(term, length(term) - 3) WHEN ends_with(term, 'edly') AND length(term) > 7 THEN left(term, length(term) - 4) WHEN ends_with(term, 'ed') AND length(term) > 5 THEN left(term, length(term) - 2) WHEN ends_with(term, 'ies') AND length(term) > 6 THEN left(term, length(term) - 3) WHEN ends_with(term, 'es') AND length(term) > 5 THEN left(term, length(term) - 2) WHEN ends_with(term, 's') AND length(term) > 4 THEN left(term, length(term) - 1) ELSE term END = 'ther' THEN 0 ELSE levenshtein(term, 'thering') END AS distance FROM v WHERE starts_with(term, 'th') AND length(term) BETWEEN 5 AND 9 AND term <> 'thering')
SELECT * FROM (SELECT term, distance FROM d WHERE distance <= 2 ORDER BY distance, term LIMIT 24) UNION ALL SELECT 'thering', 0""")
def fuzzy_terms(spark, sf_dir):
    v = search.build_index(corpus(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return search.expand_terms(v, "thering").select("term", F.col("distance").cast("long").alias("distance"))


@BOOK.add("SELECT CAST(doc_id % 50 AS VARCHAR) AS conversation_id, count(*) AS hits, min(doc_id) AS first_id FROM documents WHERE contains(lower(text), 'tion') GROUP BY 1")
def hits_by_conversation(spark, sf_dir):
    m = corpus(spark, sf_dir)
    hits = search.search_substring(m, ["tion"]).select("id", (-F.col("id")).alias("score"))
    return search.find_text(hits, m, "tion").select("conversation_id", "hits", F.col("id").alias("first_id"))


@BOOK.add("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3), c AS (SELECT vec_id AS id, (SELECT sum(CAST(a AS DOUBLE) * CAST(b AS DOUBLE)) FROM (SELECT unnest(embedding) AS a, unnest(q.e) AS b)) AS d, (SELECT sum(CAST(a AS DOUBLE) * CAST(a AS DOUBLE)) FROM (SELECT unnest(embedding) AS a)) AS n FROM embeddings, q),
s AS (SELECT c.id, d / (sqrt(n) * sqrt((SELECT n FROM c WHERE id = 3))) AS score FROM c) SELECT id, round(score, 4) AS score FROM s WHERE score >= 0.1 ORDER BY round(score, 6) DESC, id LIMIT 25""")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id = 3").first()["vector"]
    return search.vector_topk(v, q, 25, 0.1).select("id", F.round("score", 4).alias("score"))


@BOOK.add("""WITH a AS (SELECT o_custkey AS w, max(o_totalprice) / 1000000 AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_custkey AS w, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT coalesce(a.w, b.w) AS workspace_id, round(CASE WHEN c IS NOT NULL THEN c * 0.6 + coalesce(1.0 / r, 0) * 0.4 ELSE 1.0 / r END, 6) AS score FROM a FULL JOIN b ON a.w = b.w""")
def hybrid_score(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("workspace_id")).agg((F.max("o_totalprice") / 1000000).alias("cosine"))
    top = numbered(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], "rank").select(F.col("c_custkey").alias("workspace_id"), "rank")
    return search.hybrid_score(a, top)


@BOOK.add("""SELECT doc_id, length(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS key_chars, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 40), '…') ELSE text END AS clipped, contains(text, 'MIT License') AS has_license FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))).cast("long").alias("key_chars"), T.clip(t, 40).alias("clipped"), t.contains("MIT License").alias("has_license"))


@BOOK.add("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS parsed FROM events")
def date_functions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select("event_id", day(dates.local_day(ts)).alias("day"), day(dates.local_week(ts)).alias("week"), dates.local_month(ts).alias("month"), F.date_format(dates.parse_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss").alias("parsed"))


@BOOK.add("""WITH m AS (SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id, role, 1704067200 + conv_id * 3600 + turn * 60 AS secs, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM conversations),
r AS (SELECT id, role, secs, p, array_to_string(list_slice(ws, p + 1, p + 8), ' ') AS s FROM (SELECT *, unnest(range(len(ws) - 7)) AS p FROM m WHERE len(ws) >= 8))
SELECT u.id, CAST(u.p AS INTEGER) AS pos, max(a.secs) AS agent_secs FROM r u JOIN r a ON a.s = u.s AND a.role = 'assistant' AND a.secs < u.secs AND a.secs >= u.secs - 172800 WHERE u.role = 'user' GROUP BY 1, 2""")
def copied_shingles(spark, sf_dir):
    m = messages(spark, sf_dir)
    out = authorship.copied_shingles(m.where("role = 'user'"), m.where("role = 'assistant'"))
    return out.where("agent_ref is not null").select("id", "pos", F.col("agent_ref.secs").alias("agent_secs"))


@BOOK.add()
def authorship_rows(spark, sf_dir):
    m = messages(spark, sf_dir)
    return authorship.classify_authorship(m.where("role = 'user'"), m.where("role = 'assistant'")).select("id", "workspace_id", F.size("spans").alias("n_spans"), "typed_words", "typed_chars", "words", "chars")


_NORMAL = f"""CASE {" ".join(f"WHEN w = '{w}' THEN '{c}'" for w, c in T.CONCEPTS.items())} ELSE regexp_replace(regexp_replace(regexp_replace(w, 'ing$', ''), 'ed$', ''), 's$', '') END"""
_FEATURES = f"""t AS (SELECT doc_id AS id, list_transform(regexp_extract_all(lower(text), '[a-z0-9_./-]+'), lambda w: {_NORMAL}) AS ws FROM documents),
u AS (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t), v AS (SELECT id, ws[i] AS w, ws[i + 1] AS nxt FROM u),
fs AS (SELECT id, concat('w:', w) AS f, CAST(1.0 AS DOUBLE) AS x FROM v WHERE length(w) > 1 UNION ALL SELECT id, concat('b:', w, ':', nxt), 0.55 FROM v WHERE nxt IS NOT NULL
  UNION ALL SELECT id, concat('c:', substr(concat('^', w, '$'), j, 3)), 0.18 FROM (SELECT id, w, unnest(range(1, length(w) + 1)) AS j FROM v)),
fw AS (SELECT id, f, sum(x) AS weight FROM fs GROUP BY 1, 2)"""


@BOOK.add(f"WITH {_FEATURES} SELECT id, count(*) AS n_features, round(sum(weight), 4) AS weight, round(sqrt(sum(weight * weight)), 4) AS length, max(f) AS last_feature FROM fw GROUP BY 1")
def text_features(spark, sf_dir):
    """The features that embeddings hash, per document."""
    w = F.col("weight")
    return semantic.features(corpus(spark, sf_dir), ["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum(w), 4).alias("weight"), F.round(F.sqrt(F.sum(w * w)), 4).alias("length"), F.max("feature").alias("last_feature"))


@BOOK.add()
def embed_documents(spark, sf_dir):
    """Vectors of all distinct texts; SQL has no such hash, tests hold them to plain sums."""
    return semantic.embed(corpus(spark, sf_dir)).select(F.xxhash64("text").alias("text_key"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@BOOK.add()
def explain_similarity(spark, sf_dir):
    return semantic.explain_similarity("the with of", corpus(spark, sf_dir))


@BOOK.add()
def explain_fields(spark, sf_dir):
    """The split by field, of documents whose first line, rest and language are fields."""
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.create_map(F.lit("title"), F.substring_index("text", "\n", 1), F.lit("body"), F.regexp_replace("text", "^[^\n]*\n?", ""), F.lit("lang"), "lang")).alias("field", "text"))
    return semantic.explain_fields("the with of", m).select("id", "field", F.round("signal", 6).alias("signal"))


def _written(spark, sf_dir):
    """Orders as classified messages: a work per customer, words from the price."""
    o = table(spark, sf_dir, "orders")
    w = F.floor(F.col("o_totalprice") / 1000).cast("long")
    return o.select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderdate").cast("timestamp").alias("sent_at"), w.alias("words"), F.when(F.col("o_orderstatus") == "F", w).otherwise(F.lit(0)).cast("long").alias("typed_words"), w.alias("typed_chars"))


WRITTEN = "wr AS (SELECT o_custkey AS w, o_orderdate AS d, CAST(floor(o_totalprice / 1000) AS BIGINT) AS words, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 1000) AS BIGINT) ELSE 0 END AS typed FROM orders)"


@BOOK.add(f"""WITH {WRITTEN}, f AS (SELECT CASE WHEN w % 3 = 0 THEN w // 3 ELSE w END AS w, words, typed FROM wr), u AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 ELSE c_custkey END AS w, sum(CAST(c_custkey * 1000 + 1 AS BIGINT)) AS t FROM customer GROUP BY 1)
SELECT f.w AS workspace_id, CAST(sum(typed) AS BIGINT) AS typed_words, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (typed > 0) AS typed_turns, max(typed) AS longest_turn, round(100.0 * sum(typed) / nullif(sum(words), 0), 0) AS typed_share, CAST(max(t) AS BIGINT) AS total_tokens FROM f LEFT JOIN u ON u.w = f.w GROUP BY f.w""")
def writing_rows(spark, sf_dir):
    usage = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace_id"), (F.col("c_custkey") * 1000 + 1).alias("total_tokens"))
    roots = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("workspace_id"), F.floor(F.col("c_custkey") / 3).cast("long").alias("root"))
    out = authorship.writing_rows(_written(spark, sf_dir), usage, roots)
    share = F.round(100.0 * F.col("typed_words") / F.nullif(F.col("words"), F.lit(0)), 0)
    return out.select("workspace_id", "typed_words", "words", "typed_turns", "longest_turn", share.alias("typed_share"), "total_tokens")


@BOOK.add(f"WITH {WRITTEN} SELECT strftime(d, '%Y-%m-%d') AS day, CAST(sum(typed) AS BIGINT) AS typed_words, count(*) AS messages FROM wr WHERE w IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def writing_series(spark, sf_dir):
    works = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "workspace_id")
    return authorship.writing_series(_written(spark, sf_dir), works).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@BOOK.add(f"WITH {WRITTEN}, x AS (SELECT 'all' AS period, * FROM wr UNION ALL SELECT strftime(d, '%Y-%m-%d'), * FROM wr UNION ALL SELECT '30d', * FROM wr WHERE d >= DATE '2001-08-01' - 29) SELECT period, CAST(sum(typed) AS BIGINT) AS typed_words, CAST(sum(words) AS BIGINT) AS words, count(*) AS messages FROM x GROUP BY 1")
def authorship_stats(spark, sf_dir):
    return authorship.authorship_stats(_written(spark, sf_dir), "2001-08-01")


@BOOK.add(f"WITH {W}, h AS (SELECT id FROM ix WHERE term = 'the' AND id % 50 = 7) SELECT id FROM h")
def passages(spark, sf_dir):
    m = corpus(spark, sf_dir)
    return search.passages(search.build_index(m), m, "7", ["the"]).select("id")


@BOOK.add("""WITH h AS (SELECT c_custkey AS c, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_nationkey < 5), v AS (SELECT c_custkey AS c, c_acctbal / 9973 AS s FROM customer WHERE c_nationkey BETWEEN 3 AND 8), t AS (SELECT c_custkey AS c FROM customer WHERE c_name LIKE '%77%')
SELECT coalesce(h.c, v.c, t.c) AS conversation_id, round(coalesce(0.55 / r, 0) + 0.35 * coalesce(s, 0) + CASE WHEN t.c IS NULL THEN 0 ELSE 0.3 END, 6) AS score FROM h FULL JOIN v ON h.c = v.c FULL JOIN t ON t.c = coalesce(h.c, v.c)""")
def search_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "conversation_id")
    hits = numbered(c.where("c_nationkey < 5"), [F.desc("c_acctbal"), F.col("conversation_id")], "rank").select("conversation_id", "rank")
    vectors = c.where("c_nationkey between 3 and 8").select("conversation_id", (F.col("c_acctbal") / 9973).alias("cosine"))
    return search.search_conversations(hits, vectors, c.withColumnRenamed("c_name", "title"), "77")


@BOOK.add("SELECT DISTINCT p_partkey % 100 AS conversation_id, concat('src/', p_name) AS path FROM part WHERE contains(lower(p_name), 'ring')")
def find_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("conversation_id"), F.concat(F.lit("src/"), "p_name").alias("path"))
    return search.find_files(p, "RING")


@BOOK.add("SELECT DISTINCT page_id // 7 AS call_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE page_id % 5 <> 0 AND contains(lower(url), 'example.net/de/')")
def find_urls(spark, sf_dir):
    """Addresses of calls, each call's pages listed twice; every fifth page stands for a search result."""
    source = F.when(F.col("page_id") % 5 == 0, "search_result").otherwise("input")
    p = table(spark, sf_dir, "pages").select(F.expr("page_id div 7").alias("call_id"), "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), source.alias("source"))
    return search.find_urls(p.union(p), "Example.NET/de/")


@BOOK.add("SELECT c_custkey AS workspace_id, concat_ws(chr(10), c_name, nullif(c_mktsegment, ''), a) AS text FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY n) AS a FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n <= 3 GROUP BY 1) ON o_custkey = c_custkey")
def work_documents(spark, sf_dir):
    from ledgerfold.operators.library import documents

    none = F.lit(None).cast("string")
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("purpose"), F.lit("").alias("outcome"))
    ends = works.select("workspace_id", none.alias("first_request"), none.alias("last_reply"))
    failures = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("text"))
    return documents(works, ends, failures)


@BOOK.add("""WITH m AS (SELECT conv_id, turn, role, text, max(CASE WHEN turn % 3 = 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS named FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'system' ELSE role END AS role, 0 AS block, CASE WHEN turn % 5 = 4 THEN 'compaction' ELSE 'text' END AS kind, CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS said, named FROM m
  UNION ALL SELECT conv_id, turn, role, 1, 'tool_call', NULL, named FROM m WHERE turn % 5 = 1)
SELECT CASE WHEN conv_id % 4 = 3 THEN concat('s', CAST(conv_id // 4 AS VARCHAR)) ELSE CAST(conv_id AS VARCHAR) END AS conversation_id, CASE WHEN conv_id % 4 = 3 THEN concat('agent', CAST(conv_id AS VARCHAR)) END AS stream, (turn + 1) * 1000 + block AS source_order, role, kind, md5(said) AS said_md5,
CASE WHEN named IS NOT NULL THEN concat('m', CAST(named AS VARCHAR)) END AS model, CASE WHEN block = 1 THEN concat('t', CAST(turn AS VARCHAR)) END AS call_id FROM r""")
def claude_lines(spark, sf_dir):
    """Session lines built from the conversations: texts, lists of blocks, tool calls, compactions, sub-agents' files, models carried forward."""
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    number = lambda x: F.col(x).cast("string")
    blocks = F.array(F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), number("turn")).alias("id"), F.lit("Bash").alias("name"), F.struct(F.lit("ls").alias("command")).alias("input"))))
    content = F.when(turn % 5 == 1, F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))).otherwise(F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"))
    model = F.when(turn % 3 == 1, F.concat(F.lit(',"model":"m'), number("turn"), F.lit('"'))).otherwise("")
    said = F.concat(F.lit('{"type":"'), "role", F.lit('","uuid":"u'), number("turn"), F.lit('","message":{"role":"'), "role", F.lit('"'), model, F.lit(',"content":'), content, F.lit("}}"))
    compacted = F.concat(F.lit('{"type":"system","subtype":"compact_boundary","uuid":"u'), number("turn"), F.lit('"'), F.when(turn % 3 == 1, F.concat(F.lit(',"message":{"model":"m'), number("turn"), F.lit('"}'))).otherwise(""), F.lit("}"))
    file = F.when(F.col("conv_id") % 4 == 3, F.concat(F.lit("/x/s"), F.floor(F.col("conv_id") / 4).cast("string"), F.lit("/subagents/agent"), number("conv_id"), F.lit(".jsonl"))).otherwise(F.concat(F.lit("/x/"), number("conv_id"), F.lit(".jsonl")))
    lines = c.select(file.alias("file"), (turn + 1).cast("int").alias("line"), F.when(turn % 5 == 4, compacted).otherwise(said).alias("value"))
    up = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    m = transcripts.claude_messages(lines.withColumn("model", F.last(transcripts.claude_model(), ignorenulls=True).over(up)))
    text = F.when(F.col("kind") == "text", F.md5("text"))
    return m.select("conversation_id", F.col("parent_native_id").alias("stream"), F.col("source_order").cast("long").alias("source_order"), "role", "kind", text.alias("said_md5"), "model", "call_id")
