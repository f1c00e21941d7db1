"""Lifecycle and history queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources.domain import COURSES_SQL, courses, table
from .registry import query

HASH_SQL = "left(sha256(concat_ws(chr(31), trim(source), trim(text))), 32)"


@query("content_hash_cdc", f"""WITH b AS (SELECT doc_id, source, {HASH_SQL} AS digest FROM documents WHERE doc_id % 10 <> 9),
s AS (SELECT doc_id, left(sha256(concat_ws(chr(31), trim(source), trim(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END))), 32) AS digest FROM documents WHERE doc_id % 5 <> 4)
SELECT b.doc_id, b.source, b.digest, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.digest = b.digest THEN 'unchanged' ELSE 'changed' END AS change FROM b LEFT JOIN s ON s.doc_id = b.doc_id""")
def cdc(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    batch = d.filter("doc_id % 10 <> 9").select("doc_id", "source", L.content_id(F.col("source"), F.col("text")).alias("digest"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    stored = d.filter("doc_id % 5 <> 4").select("doc_id", L.content_id(F.col("source"), text).alias("digest"))
    return L.detect_changes(batch, stored, "doc_id", "digest")


@query("batch_dedupe_keep_first", f"SELECT doc_id, digest FROM (SELECT doc_id, left(sha256(trim(text)), 32) AS digest FROM documents) QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1")
def dedupe(spark, sf_dir):
    return L.keep_first(table(spark, sf_dir, "documents").select("doc_id", L.content_id(F.col("text")).alias("digest")), ["digest"], [F.col("doc_id")])


@query("upsert_coalesce_policy", """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS salary, CAST(o_orderdate AS DATE) AS first_seen, 2 AS missed FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + 1 END AS salary, CAST(o_orderdate AS DATE) + 30 AS first_seen FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(n.salary, o.salary) AS salary, coalesce(o.first_seen, n.first_seen) AS first_seen,
  CASE WHEN n.id IS NOT NULL THEN 0 ELSE o.missed END AS missed FROM o FULL JOIN n ON o.id = n.id""")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("salary"), day.alias("first_seen"), F.lit(2).alias("missed"))
    new = o.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") + 1).alias("salary"), F.date_add(day, 30).alias("first_seen"),
    )
    return L.upsert(old, new, "id", ["status"], ["salary"], ["first_seen"], {"missed": F.lit(0)})


@query("upsert_observed_flag", f"""WITH {COURSES_SQL} SELECT course_id, CASE WHEN course_id % 3 = 0 THEN CASE WHEN course_id % 2 = 0 THEN NULL ELSE rating + 1 END ELSE rating END AS rating,
  CASE WHEN course_id % 3 = 0 THEN review_count + 5 ELSE review_count END AS review_count FROM courses""")
def observed(spark, sf_dir):
    c = courses(spark, sf_dir).select("course_id", "rating", "review_count")
    new = c.select("course_id", F.when(F.col("course_id") % 2 != 0, F.col("rating") + 1).alias("rating"), (F.col("review_count") + 5).alias("review_count"), (F.col("course_id") % 3 == 0).alias("seen"))
    return L.upsert_observed(c, new, "course_id", ["rating", "review_count"], "seen")


STATE = """st AS (SELECT o_orderkey AS posting_id, o_custkey % 10 AS source, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'stale' ELSE 'rejected' END AS status, CAST(o_orderkey % 4 AS INTEGER) AS missed_cycles,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS stale_since, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - 1 END AS duplicate_of FROM orders)"""
AGED = """j AS (SELECT *, posting_id % 3 = 0 AS seen, source < 7 AS censused FROM st),
k AS (SELECT *, CAST(CASE WHEN seen THEN 0 WHEN censused AND status = 'active' THEN missed_cycles + 1 ELSE missed_cycles END AS INTEGER) AS m FROM j),
aged AS (SELECT posting_id, source, CASE WHEN seen AND status = 'stale' THEN 'active' WHEN NOT seen AND status = 'active' AND m >= 3 THEN 'stale' ELSE status END AS status, m AS missed_cycles,
  CASE WHEN seen THEN NULL WHEN status = 'active' AND m >= 3 THEN coalesce(stale_since, DATE '2001-08-02') ELSE stale_since END AS stale_since, duplicate_of FROM k)"""


def aged(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "stale").otherwise("rejected")
    rows = o.select(
        F.col("o_orderkey").alias("posting_id"), (F.col("o_custkey") % 10).alias("source"), status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("missed_cycles"),
        F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("stale_since"), F.when(F.col("o_orderkey") % 17 == 0, F.col("o_orderkey") - 1).alias("duplicate_of"),
    )
    return L.age_and_touch(rows, rows.filter("posting_id % 3 = 0"), rows.filter("source < 7"), F.lit("2001-08-02").cast("date"))


@query("age_touch_stale", f"WITH {STATE}, {AGED} SELECT * FROM aged")
def age(spark, sf_dir):
    return aged(spark, sf_dir)


@query("age_touch_stale_prune", f"""WITH {STATE}, {AGED}, kept AS (SELECT * FROM aged WHERE NOT (status = 'stale' AND stale_since IS NOT NULL AND DATE '2001-08-02' - stale_since > 60))
SELECT posting_id, source, status, missed_cycles, stale_since, CASE WHEN duplicate_of IN (SELECT posting_id FROM kept) THEN duplicate_of END AS duplicate_of FROM kept""")
def age_prune(spark, sf_dir):
    return L.prune(aged(spark, sf_dir), F.lit("2001-08-02").cast("date"))


@query("window_replace_retention", """WITH s AS (SELECT last_day(o_orderdate) AS window_end, o_orderstatus AS status, count(*) AS n FROM orders WHERE NOT (last_day(o_orderdate) = DATE '2001-07-31' AND o_orderstatus = 'P') GROUP BY ALL),
w AS (SELECT DISTINCT window_end FROM s ORDER BY window_end DESC LIMIT 4)
SELECT * FROM s WHERE window_end >= (SELECT min(window_end) FROM w)""")
def retention(spark, sf_dir):
    """Stats written once with a status that a rerun of its window no longer has: the rerun replaces the whole window."""
    o = table(spark, sf_dir, "orders").select(F.last_day("o_orderdate").alias("window_end"), F.col("o_orderstatus").alias("status"))
    first = o.groupBy("window_end", "status").agg(F.count("*").alias("n"))
    again = first.filter("window_end = date'2001-07-31' and status <> 'P'")
    now = first.join(again.select("window_end").distinct(), "window_end", "left_anti").unionByName(again)
    return L.keep_windows(now, 4)


@query("source_health_fold", """WITH a AS (SELECT user_id % 30 AS source, ts, event_id, event_type NOT IN ('error', 'click') AS ok FROM events),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY source ORDER BY ts, event_id) AS island FROM a),
f AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY source, island ORDER BY ts, event_id) AS failures FROM i),
l AS (SELECT source, arg_max(failures, (ts, event_id)) AS failures, arg_max(island, (ts, event_id)) AS island, max(ts) FILTER (WHERE ok) AS last_success_at, max(ts) AS last_attempt_at, count(*) AS total_cycles FROM f GROUP BY source)
SELECT l.source, CAST(l.failures AS BIGINT) AS consecutive_failures, last_success_at, last_attempt_at, CASE WHEN l.failures >= 3 THEN t.ts END AS degraded_since, total_cycles
FROM l LEFT JOIN f t ON t.source = l.source AND t.island = l.island AND t.failures = 3""")
def health(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("source"), "ts", "event_id", (~F.col("event_type").isin("error", "click")).alias("ok"))
    return L.source_health(e)


def usage(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), "ts", "event_id")


def claims_sql(period):
    return f"""WITH e AS (SELECT user_id, event_type AS kind, ts, event_id, {period} AS period_start FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind, period_start ORDER BY ts, event_id) AS n FROM e)
SELECT user_id, kind, period_start, count(*) FILTER (WHERE n <= 2) AS used, count(*) FILTER (WHERE n > 2) AS refused FROM g GROUP BY ALL"""


@query("quota_claims", claims_sql("CAST(date_trunc('week', ts + INTERVAL 4 HOUR) AS DATE)"))
def quota(spark, sf_dir):
    """Weekly quotas; weeks begin on Monday in a zone four hours east of UTC."""
    return L.claims(usage(spark, sf_dir), F.to_date(F.date_trunc("week", F.col("ts") + F.expr("interval 4 hours"))), 2)


@query("hourly_throttle", claims_sql("date_trunc('hour', ts)"))
def throttle(spark, sf_dir):
    return L.claims(usage(spark, sf_dir), F.date_trunc("hour", "ts"), 2)


def feedback(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'view', 'error')")
    item = F.get_json_object("props", "$.k").cast("int")
    return e.select("user_id", item.alias("item_id"), F.when(F.col("event_type") == "error", "dislike").otherwise("like").alias("verdict"), "ts", "event_id")


LATEST = """e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id, CASE WHEN event_type = 'error' THEN 'dislike' ELSE 'like' END AS verdict, ts, event_id FROM events WHERE event_type IN ('click', 'view', 'error')),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) = 1)"""


def latest_rows(spark, sf_dir):
    return L.latest(feedback(spark, sf_dir), ["user_id", "item_id"], [F.desc("ts"), F.desc("event_id")])


@query("latest_feedback", f"WITH {LATEST} SELECT user_id, item_id, verdict, event_id FROM l")
def latest_feedback(spark, sf_dir):
    return latest_rows(spark, sf_dir).select("user_id", "item_id", "verdict", "event_id")


@query("disliked_items", f"WITH {LATEST} SELECT user_id, item_id FROM l WHERE verdict = 'dislike'")
def disliked(spark, sf_dir):
    return latest_rows(spark, sf_dir).filter("verdict = 'dislike'").select("user_id", "item_id")


@query("latest_run_per_user", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN NULL ELSE ts END DESC NULLS LAST, event_id) = 1")
def latest_run(spark, sf_dir):
    ended = F.when(F.col("event_type") != "view", F.col("ts"))
    return L.latest(table(spark, sf_dir, "events"), ["user_id"], [ended.desc_nulls_last(), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("history_last_n", "SELECT conv_id, turn, role, left(text, 500) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history(spark, sf_dir):
    return L.last_n(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", F.left("text", F.lit(500)).alias("text"))


@query("work_queue_nulls_first", f"""WITH {COURSES_SQL} SELECT course_id, price FROM courses WHERE status = 'active' AND duplicate_of IS NULL AND coalesce(rating, review_count, enrollment_count) IS NULL ORDER BY price NULLS FIRST, course_id LIMIT 150""")
def work_queue(spark, sf_dir):
    c = courses(spark, sf_dir).filter("status = 'active' and duplicate_of is null and rating is null and review_count is null and enrollment_count is null")
    return c.orderBy(F.col("price").asc_nulls_first(), "course_id").limit(150).select("course_id", "price")


@query("long_degraded_sources", """WITH a AS (SELECT user_id AS source, max(ts) FILTER (WHERE event_type <> 'error') AS ok_at, max(ts) AS last_at FROM events GROUP BY user_id) SELECT source, date_diff('day', CAST(ok_at AS DATE), DATE '2024-02-01') AS days FROM a WHERE date_diff('day', CAST(ok_at AS DATE), DATE '2024-02-01') > 2""")
def long_degraded(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("ok_at"))
    return a.select("source", F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ok_at")).cast("long").alias("days")).filter("days > 2")


@query("monotone_progress", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def progress(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.max("value").over(w).alias("progress"))
