"""Queries through the query table: filters, sorts, pages, groups, distinct values, statistics; joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import graph, joins
from ledgerfold.operators import querytable as qt
from ledgerfold.plans.book import Book
from ledgerfold.plans.standins import table
from ledgerfold.session import materialize

BOOK = Book()
C = qt.Clause

CUSTOMERS = qt.fields_of(qt.FieldSpec("c_custkey", "number"), qt.FieldSpec("c_name", "text"), qt.FieldSpec("c_mktsegment", "enum"), qt.FieldSpec("c_acctbal", "number"), qt.FieldSpec("c_nationkey", "number"))
EVENTS = qt.fields_of(qt.FieldSpec("event_id", "number"), qt.FieldSpec("ts", "datetime"), qt.FieldSpec("event_type", "enum"), qt.FieldSpec("value", "number"), qt.FieldSpec("user_id", "number"), qt.FieldSpec("tags", "textarray"), qt.FieldSpec("note", "text"))


def events(spark, sf_dir):
    """Events with a text that is sometimes null or empty and an array that is sometimes null or empty."""
    k = F.get_json_object("props", "$.k").cast("int")
    note = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").otherwise(F.concat_ws("-", "event_type", k.cast("string")))
    tags = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.initcap("event_type"), (k % 3).cast("string")))
    return table(spark, sf_dir, "events").withColumns({"k": k, "note": note, "tags": tags})


EV = """ev AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '' ELSE concat(event_type, '-', CAST(k AS VARCHAR)) END AS note,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 0 ELSE 2 END AS n_tags FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""


@BOOK.add("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_name LIKE '%7') AND c_acctbal > 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10")
def filter_sort_page(spark, sf_dir):
    q = qt.Query(terms=((C("c_mktsegment", "=", "BUILDING"), C("c_name", "ends_with", "7")), (C("c_acctbal", ">", "1000"),)), sorts=(qt.Sort("c_acctbal", descending=True),), limit=50, offset=10, fields=("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))
    return qt.run(table(spark, sf_dir, "customer"), q, CUSTOMERS, tie="c_custkey")[0]


@BOOK.add(f"""WITH {EV} SELECT 'not_equal' AS rule, count(*) AS n FROM ev WHERE note IS DISTINCT FROM 'view-3' UNION ALL SELECT 'is_null', count(*) FROM ev WHERE note IS NULL OR note = '' UNION ALL
SELECT 'regex', count(*) FROM ev WHERE regexp_matches(note, '^(view|click)-[0-9]$') UNION ALL SELECT 'not_regex', count(*) FROM ev WHERE NOT regexp_matches(note, '^view') UNION ALL
SELECT 'negated', count(*) FROM ev WHERE note <> '' AND NOT lower(note) LIKE '%view%' UNION ALL SELECT 'pending', count(*) FROM ev UNION ALL SELECT 'bad_regex', 0 UNION ALL
SELECT 'includes', count(*) FROM ev WHERE n_tags = 2 AND event_type = 'view' UNION ALL SELECT 'array_null', count(*) FROM ev WHERE coalesce(n_tags, 0) = 0 UNION ALL SELECT 'since', count(*) FROM ev WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'""")
def clause_rules(spark, sf_dir):
    """How many rows each kind of clause keeps, in one scan."""
    rules = {
        "not_equal": C("note", "!=", "view-3"), "is_null": C("note", "is_null"), "regex": C("note", "matches_regex", "^(view|click)-[0-9]$"), "not_regex": C("note", "not_matches_regex", "^view"), "negated": C("note", "contains", "VIEW", negated=True),
        "pending": C("value", ">", " "), "bad_regex": C("note", "matches_regex", "("), "includes": C("tags", "includes", "VIEW"), "array_null": C("tags", "is_null"), "since": C("ts", ">=", "2024-01-15T12:00:00"),
    }
    counts = events(spark, sf_dir).agg(*[F.sum(qt.clause_column(c, EVENTS).cast("long")).alias(n) for n, c in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])))


@BOOK.add("SELECT event_id, user_id FROM events WHERE date_trunc('week', ts) = DATE '2024-01-08'")
def week_bucket(spark, sf_dir):
    return qt.bucket_filter(table(spark, sf_dir, "events"), "ts", "week", "2024-01-08").select("event_id", "user_id")


@BOOK.add("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS value FROM customer WHERE c_nationkey < 20 GROUP BY 1")
def sum_by_group(spark, sf_dir):
    kept = qt.where(table(spark, sf_dir, "customer"), [[C("c_nationkey", "<", 20)]], CUSTOMERS)
    return qt.aggregate(kept, qt.Metric("balance", "sum", "c_acctbal", ("c_mktsegment",)), CUSTOMERS).withColumn("value", F.round("value", 2))


@BOOK.add("""SELECT 'total' AS metric, '' AS "key", CAST(count(*) AS DOUBLE) AS value FROM customer UNION ALL SELECT 'largest', concat(c_mktsegment, '/', CAST(c_nationkey AS VARCHAR)), max(c_acctbal) FROM customer GROUP BY c_mktsegment, c_nationkey UNION ALL
SELECT 'nations', c_mktsegment, CAST(count(DISTINCT c_nationkey) AS DOUBLE) FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'mean', CAST(c_nationkey AS VARCHAR), round(avg(c_acctbal), 4) FROM customer GROUP BY c_nationkey""")
def many_group_bys(spark, sf_dir):
    m = [qt.Metric("total"), qt.Metric("largest", "max", "c_acctbal", ("c_mktsegment", "c_nationkey")), qt.Metric("nations", "count_distinct", "c_nationkey", ("c_mktsegment",)), qt.Metric("mean", "avg", "c_acctbal", ("c_nationkey",))]
    out = qt.aggregate_many(table(spark, sf_dir, "customer"), m, CUSTOMERS)
    key = F.concat_ws("/", F.col("keys")["c_mktsegment"], F.col("keys")["c_nationkey"])
    return out.select("metric", key.alias("key"), F.round("value", 4).alias("value"))


@BOOK.add(f"WITH {EV}, v AS (SELECT DISTINCT note AS value FROM ev WHERE note <> '' AND lower(note) LIKE '%click%') SELECT value, true AS has_null FROM v ORDER BY value LIMIT 20")
def distinct_search(spark, sf_dir):
    values, flags = qt.distinct_values(events(spark, sf_dir), "note", EVENTS, "CLICK", 20)
    return values.crossJoin(F.broadcast(flags.select("has_null")))  # 20 values, one row of flags


@BOOK.add(f"""WITH {EV} SELECT 'note' AS field, count(DISTINCT nullif(note, '')) AS n_distinct, NULL AS min, NULL AS max FROM ev UNION ALL SELECT 'event_type', count(DISTINCT event_type), NULL, NULL FROM ev UNION ALL
SELECT 'user_id', count(DISTINCT user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM ev""")
def field_stats(spark, sf_dir):
    return qt.field_stats(events(spark, sf_dir), ["note", "event_type", "user_id"], EVENTS)


@BOOK.add("SELECT c_custkey, c_name FROM customer ORDER BY regexp_extract(c_name, '([0-9]{2})$', 1) DESC, c_custkey LIMIT 40")
def sort_by_pattern(spark, sf_dir):
    q = qt.Query(sorts=(qt.Sort("c_name", descending=True, pattern="([0-9]{2})$"),), limit=40, fields=("c_custkey", "c_name"))
    return qt.run(table(spark, sf_dir, "customer"), q, CUSTOMERS, tie="c_custkey")[0]


@BOOK.add(f"WITH {EV} SELECT event_id, user_id FROM ev WHERE note IS NULL AND event_type = 'error'")
def drill_down(spark, sf_dir):
    return qt.drill(events(spark, sf_dir), {"note": None, "event_type": "error"}).select("event_id", "user_id")


@BOOK.add("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def timeline(spark, sf_dir):
    return qt.timeline_order(table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day")


@BOOK.add("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_and_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rich = joins.having(table(spark, sf_dir, "customer"), o, "c_custkey", F.col("o_totalprice") > 400000)
    return joins.without(rich, o.where("o_orderpriority = '1-URGENT'"), "c_custkey").select("c_custkey")


@BOOK.add("""WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), a AS (SELECT event_id AS e, user_id AS u, ts AS t FROM events WHERE event_type = 'click'),
j AS (SELECT f.event_id, max(t) AS t FROM f LEFT JOIN a ON a.u = f.user_id AND a.t <= f.ts GROUP BY 1) SELECT j.event_id, a.e AS event_click FROM j JOIN f ON f.event_id = j.event_id LEFT JOIN a ON a.t = j.t AND a.u = f.user_id""")
def asof_backward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    out = joins.asof_backward(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "at", ["click"])
    return out.select("event_id", "event_click")


@BOOK.add("""WITH c AS (SELECT o_orderkey AS change_id, o_custkey AS w, o_orderpriority AS item, o_orderdate AS d FROM orders WHERE o_orderkey % 3 = 0),
v AS (SELECT o_orderkey AS cid, o_custkey AS w, o_orderpriority AS item, o_orderdate AS a, o_orderdate + INTERVAL 200 DAY AS z FROM orders WHERE o_orderkey % 3 = 1),
g AS (SELECT change_id, c.w, count(cid) AS na, min(cid) AS ca, count(CASE WHEN c.item = v.item THEN cid END) AS ni, min(CASE WHEN c.item = v.item THEN cid END) AS ci, count(CASE WHEN d BETWEEN a AND z THEN cid END) AS nt, min(CASE WHEN d BETWEEN a AND z THEN cid END) AS ct FROM c LEFT JOIN v ON c.w = v.w GROUP BY 1, 2)
SELECT change_id, w AS workspace_id, CASE WHEN na = 1 THEN ca WHEN ni = 1 THEN ci WHEN nt = 1 THEN ct END AS conversation_id, CASE WHEN na = 1 THEN 'sole' WHEN ni = 1 THEN 'work_item' WHEN nt = 1 THEN 'time' ELSE 'workspace' END AS scope FROM g""")
def attribute_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    changes = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("workspace_id"), F.col("o_orderpriority").alias("work_item"), F.col("o_orderdate").alias("at"))
    convs = o.where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("workspace_id"), F.col("o_orderpriority").alias("work_item"), F.col("o_orderdate").alias("started_at"), F.expr("o_orderdate + interval 200 days").alias("ended_at"))
    return joins.attribute_changes(changes, convs)


def part_links(spark, sf_dir):
    """Parts are linked to the one a seventh of the way down, unless the key is divisible by 5."""
    p = table(spark, sf_dir, "part")
    return p.where("p_partkey % 5 <> 0 and p_partkey > 0").select(F.col("p_partkey").alias("left_id"), F.floor(F.col("p_partkey") / 7).cast("long").alias("right_id"))


ROOT = "up(k, r) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT k, r // 7 FROM up WHERE r % 5 <> 0 AND r > 0), root AS (SELECT k, min(r) AS root FROM up GROUP BY k)"


@BOOK.add(f"WITH RECURSIVE {ROOT} SELECT k AS p_partkey, root AS component FROM root WHERE k IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey > 0 UNION SELECT p_partkey // 7 FROM part WHERE p_partkey % 5 <> 0 AND p_partkey > 0)")
def components(spark, sf_dir):
    return graph.connected_components(part_links(spark, sf_dir)).select(F.col("vertex").alias("p_partkey"), "component")


@BOOK.add(f"WITH RECURSIVE {ROOT} SELECT k AS p_partkey, root AS component FROM root WHERE k IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey > 0 UNION SELECT p_partkey // 7 FROM part WHERE p_partkey % 5 <> 0 AND p_partkey > 0)")
def component_batches(spark, sf_dir):
    """The same labels, from links that come in three batches: each changes only the groups it touches."""
    links, labels = materialize(part_links(spark, sf_dir)), None
    for part in (2, 0, 1):
        labels = materialize(graph.apply_links(labels, links.where(F.pmod(F.xxhash64(*links.columns), F.lit(3)) == part)))
    return labels.select(F.col("vertex").alias("p_partkey"), "component")


@BOOK.add(f"WITH RECURSIVE {ROOT}, depth AS (SELECT k, count(*) - 1 AS depth FROM up GROUP BY k) SELECT root.k AS node, root, CAST(depth AS BIGINT) AS depth FROM root JOIN depth ON root.k = depth.k")
def roots(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when((F.col("p_partkey") % 5 != 0) & (F.col("p_partkey") > 0), F.floor(F.col("p_partkey") / 7).cast("long")).alias("parent"))
    return graph.pointer_jump(p).withColumn("depth", F.col("depth").cast("long"))


KIND = "CASE p_partkey % 4 WHEN 0 THEN 'workflow' WHEN 1 THEN 'codex' WHEN 2 THEN 'conductor' ELSE 'other' END"


@BOOK.add(f"""WITH RECURSIVE {ROOT}, w AS (SELECT p_partkey, root, {KIND} AS kind, p_size, CASE {KIND} WHEN 'workflow' THEN 0 WHEN 'codex' THEN 1 WHEN 'conductor' THEN 9 ELSE 5 END AS pr FROM part JOIN root ON k = p_partkey),
r AS (SELECT *, first_value(p_partkey) OVER (PARTITION BY root ORDER BY pr, p_size DESC, p_partkey) AS representative, count(*) OVER (PARTITION BY root) AS group_size FROM w)
SELECT p_partkey AS workspace_id, representative, representative <> p_partkey AS is_mirror, group_size FROM r""")
def mirrors(spark, sf_dir):
    k = F.col("p_partkey")
    works = table(spark, sf_dir, "part").select(k.alias("workspace_id"), F.when(k % 4 == 0, "workflow").when(k % 4 == 1, "codex").when(k % 4 == 2, "conductor").otherwise("other").alias("source_kind"), F.timestamp_seconds(F.col("p_size") * 86400).alias("activity_at"))
    return joins.suppress_mirrors(works, part_links(spark, sf_dir)).select("workspace_id", "representative", "is_mirror", "group_size")


@BOOK.add("SELECT least(a, b) AS left_id, greatest(a, b) AS right_id FROM (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey <> p_partkey // 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey <> p_partkey // 3) GROUP BY 1, 2")
def identity_links(spark, sf_dir):
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(F.lit("one").alias("account"), k.alias("conversation_id"), F.concat(F.lit("n"), k.cast("string")).alias("native_id"), F.array(*[F.concat(F.lit("n"), F.floor(k / d).cast("string")) for d in (2, 3)]).alias("aliases"))
    return joins.identity_links(c)


@BOOK.add("""WITH l AS (SELECT p_partkey AS a, p_partkey // 7 AS b FROM part WHERE p_partkey % 5 <> 0 AND p_partkey > 0), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), late AS (SELECT e.a, max(p_size) AS m FROM e JOIN part ON p_partkey = e.b GROUP BY e.a)
SELECT p_partkey AS workspace_id, CAST(CASE WHEN p_partkey % 4 = 0 THEN greatest(p_size, coalesce(m, p_size)) ELSE p_size END AS BIGINT) AS day FROM part LEFT JOIN late ON late.a = p_partkey""")
def propagate_activity(spark, sf_dir):
    k = F.col("p_partkey")
    works = table(spark, sf_dir, "part").select(k.alias("workspace_id"), F.when(k % 4 == 0, "workflow").otherwise("codex").alias("source_kind"), F.timestamp_seconds(F.col("p_size") * 86400).alias("activity_at"))
    return joins.propagate_activity(works, part_links(spark, sf_dir)).select("workspace_id", (F.unix_seconds("activity_at") / 86400).cast("long").alias("day"))


@BOOK.add("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS w, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey // 4 END AS p FROM orders), j AS (SELECT c.w, CASE WHEN q.w <> c.w THEN q.w END AS away FROM c LEFT JOIN c q ON q.id = c.p)
SELECT w AS workspace_id, min(away) AS parent FROM j GROUP BY w HAVING count(*) = count(away)""")
def spawned_works(spark, sf_dir):
    k = F.col("o_orderkey")
    return joins.subagent_parents(table(spark, sf_dir, "orders").select(k.alias("conversation_id"), F.col("o_custkey").alias("workspace_id"), F.when(k % 4 != 0, F.floor(k / 4).cast("long")).alias("parent_id")))


@BOOK.add("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'stored' ELSE 'fresh' END AS origin FROM part UNION ALL SELECT s_suppkey + 100000, 'fresh' FROM supplier")
def union_first(spark, sf_dir):
    """Parts and suppliers as one list; a supplier whose number is also a part's is another key."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("part").alias("kind"))
    fresh = p.union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 100000, F.lit("supplier"))).withColumn("origin", F.lit("fresh"))
    return joins.union_first([p.where("p_partkey % 2 = 0").withColumn("origin", F.lit("stored")), fresh], ["kind", "p_partkey"]).select("p_partkey", "origin")


@BOOK.add("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_keys(spark, sf_dir):
    return joins.except_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@BOOK.add("""WITH s AS (SELECT o_custkey AS c, o_orderkey AS n, o_orderstatus AS h FROM orders WHERE o_orderkey % 3 <> 0), y AS (SELECT o_custkey AS c, o_orderkey AS n, o_orderstatus AS h FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 3 = 0),
part_ AS (SELECT DISTINCT c FROM (SELECT * FROM s EXCEPT SELECT * FROM y)), whole AS (SELECT DISTINCT c FROM y WHERE c NOT IN (SELECT c FROM part_))
SELECT * FROM (SELECT * FROM s WHERE c NOT IN (SELECT c FROM whole) UNION ALL SELECT * FROM y WHERE c IN (SELECT c FROM whole) UNION ALL SELECT * FROM y WHERE c IN (SELECT c FROM part_) AND n NOT IN (SELECT n FROM s)) t(conversation_id, native_id, content_hash)""")
def merge_copies(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderkey").alias("native_id"), F.col("o_orderstatus").alias("content_hash"))
    return joins.merge_copies(o.where("native_id % 3 <> 0"), o.where("conversation_id % 2 = 0 or native_id % 3 = 0"))


@BOOK.add("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, sf_dir):
    return joins.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@BOOK.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, sf_dir):
    return joins.top_k(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey", "o_totalprice")


@BOOK.add("SELECT c_custkey, round(spent, 2) AS spent FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def rank_by_metric(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return joins.rank_by_metric(table(spark, sf_dir, "customer").select("c_custkey"), spent, "c_custkey", "spent")


@BOOK.add("SELECT user_id AS conversation_id, event_type AS host, 'o' AS origin, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, max_by(event_id, ts) AS messages FROM events GROUP BY 1, 2")
def sightings(spark, sf_dir):
    from ledgerfold.operators.library import sightings as op

    out = op(table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_type").alias("host"), F.lit("o").alias("origin"), F.col("ts").alias("seen_at"), F.col("event_id").alias("message_count")))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})
