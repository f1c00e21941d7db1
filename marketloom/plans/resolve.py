"""Resolution, routing and small-rule queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import resolution as X
from ..sources import domain as V
from .registry import query

ROWS_SQL = """b AS (SELECT o_orderkey AS posting_id, 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || (o_custkey % 300) END AS final_url, 'u' || (o_orderkey - o_orderkey % 7) AS link, o_orderkey % 11 = 0 AS is_split FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT o_orderkey AS posting_id, 'u' || o_orderkey AS url, 'f' || (o_custkey % 300) AS final_url FROM orders WHERE o_orderkey % 40 = 1),
d AS (SELECT b.*, nullif(coalesce(s2.id, f.id), b.posting_id) AS canonical_id FROM b LEFT JOIN (SELECT final_url, min(posting_id) AS id FROM b WHERE final_url IS NOT NULL GROUP BY 1) f ON f.final_url = b.final_url
  LEFT JOIN (SELECT final_url, min(posting_id) AS id FROM s GROUP BY 1) s2 ON s2.final_url = b.final_url)"""


def rows(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    k, u = F.col("o_orderkey"), lambda c: F.concat(F.lit("u"), c.cast("string"))
    to = F.concat(F.lit("f"), (F.col("o_custkey") % 300).cast("string"))
    b = o.filter(k % 2 == 0).select(k.alias("posting_id"), u(k).alias("url"), F.when(k % 3 == 0, to).alias("final_url"), F.array(u(k - k % 7)).alias("links"), (k % 11 == 0).alias("is_split"))
    return b, o.filter(k % 40 == 1).select(k.alias("posting_id"), u(k).alias("url"), to.alias("final_url"))


@query("destination_duplicates", f"WITH {ROWS_SQL} SELECT posting_id, final_url, canonical_id FROM d")
def destination(spark, sf_dir):
    return X.by_destination(*rows(spark, sf_dir))


@query("link_duplicates", f"""WITH {ROWS_SQL} SELECT d.posting_id, CASE WHEN d.is_split THEN d.canonical_id ELSE coalesce(nullif(coalesce(s.posting_id, o.posting_id), d.posting_id), d.canonical_id) END AS canonical_id
FROM d LEFT JOIN s ON s.url = d.link LEFT JOIN b o ON o.url = d.link""")
def link(spark, sf_dir):
    b, s = rows(spark, sf_dir)
    d = X.by_destination(b, s).select("posting_id", "canonical_id")
    return X.by_link(b.join(d, "posting_id"), s)


@query("title_row_match", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' ' || c_nationkey ELSE c_name END AS t FROM customer),
o AS (SELECT lower(trim(regexp_replace(t || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '  x' END, '\\s+', ' ', 'g'))) AS t, count(*) AS n, min(c_custkey) AS id FROM c GROUP BY 1),
n AS (SELECT c_custkey AS row, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS t FROM c)
SELECT n.row, CASE WHEN o.n = 1 THEN o.id END AS id, CASE WHEN o.n IS NULL THEN 'derived' WHEN o.n = 1 THEN 'title' ELSE 'ambiguous' END AS how FROM n LEFT JOIN o ON o.t = n.t""")
def title_match(spark, sf_dir):
    """Whole names, and for every third customer a title that others share."""
    shared = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, shared).otherwise(F.col("c_name")).alias("t"))
    old = c.select(F.col("c_custkey").alias("id"), F.concat("t", F.when(F.col("c_custkey") % 5 == 0, "").otherwise("  x")).alias("title"))
    return X.match_rows(c.select(F.col("c_custkey").alias("row"), F.col("t").alias("title")), old)


@query("insert_ignore", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def ignore(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return X.insert_ignore(o.filter("o_orderkey % 3 = 0").select("o_custkey"), o.filter("o_orderkey % 7 = 0"), ["o_custkey"])


@query("destination_states", """WITH s AS (SELECT o_orderkey AS posting_id, CASE WHEN o_orderkey % 11 = 0 THEN 'hub' WHEN o_orderkey % 5 = 0 THEN 'no_link' WHEN o_orderkey % 7 = 0 THEN 'unreachable' WHEN o_orderkey % 3 <> 1 THEN 'hub' WHEN o_orderkey % 2 = 0 THEN 'source_is_destination' ELSE 'resolved' END AS status FROM orders)
SELECT status, count(*) AS n, count(*) FILTER (WHERE posting_id % 4 = 0 AND status NOT IN ('resolved', 'source_is_destination')) AS prunable FROM s GROUP BY status""")
def states(spark, sf_dir):
    k = F.col("o_orderkey")
    o = V.table(spark, sf_dir, "orders").select(k, X.destination_status(k % 11 == 0, F.when(k % 5 != 0, "l"), k % 7 != 0, k % 3, k % 2 == 0).alias("status"))
    return o.groupBy("status").agg(F.count("*").alias("n"), F.count(F.when(X.prunable(F.when(k % 4 != 0, "u"), F.col("status")), 1)).alias("prunable"))


@query("status_routing", """WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'adjudicate' ELSE 'clean' END AS band, o_orderkey % 5 = 0 AS roundup, o_orderkey % 7 = 0 AS flagged FROM orders)
SELECT CASE WHEN band = 'reject' THEN 'rejected' WHEN band = 'adjudicate' OR roundup OR flagged THEN 'needs_review' ELSE 'active' END AS status,
  CASE WHEN band = 'reject' THEN 'risk' WHEN band = 'adjudicate' THEN 'adjudicate' WHEN roundup THEN 'roundup' WHEN flagged THEN 'near_duplicate' END AS reason, count(*) AS n FROM d GROUP BY ALL""")
def routing(spark, sf_dir):
    k = F.col("o_orderkey")
    status, reason = X.routed(F.when(k % 4 == 0, "reject").when(k % 4 == 1, "adjudicate").otherwise("clean"), k % 5 == 0, k % 7 == 0)
    return V.table(spark, sf_dir, "orders").groupBy(status.alias("status"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query("adjudication_effect", """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 2 THEN r WHEN event_id % 3 = 0 THEN greatest(r, 0.5::DOUBLE) ELSE least(r, 0.35::DOUBLE) END AS risk FROM (SELECT event_id, least(1.0::DOUBLE, value / 100) AS r FROM events)""")
def adjudication(spark, sf_dir):
    k = F.col("event_id")
    e = V.table(spark, sf_dir, "events").select(k, F.least(F.lit(1.0), F.col("value") / 100).alias("r"))
    return e.select(k, X.adjudicated(F.col("r"), F.when(k % 3 == 0, "scam").when(k % 3 == 1, "fine"), F.lit(0.5), k % 5 != 0).alias("risk"))


@query("token_consume", """WITH e AS (SELECT user_id AS token, event_id, ts, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events), f AS (SELECT *, ts > t0 AND ts < t0 + INTERVAL 48 HOUR AS in_time FROM e)
SELECT token, event_id, in_time AND row_number() OVER (PARTITION BY token, in_time ORDER BY ts, event_id) = 1 AS accepted FROM f""")
def consume(spark, sf_dir):
    return X.consumed(V.table(spark, sf_dir, "events").select(F.col("user_id").alias("token"), "event_id", "ts"), 48).select("token", "event_id", "accepted")


@query("chunk_sync", """WITH n AS (SELECT conv_id AS doc, turn AS ordinal, sha256(text) AS digest FROM conversations WHERE turn < 4), s AS (SELECT conv_id AS doc, turn AS ordinal, sha256(CASE WHEN conv_id % 3 = 0 THEN text || '.' ELSE text END) AS digest FROM conversations WHERE turn > 0)
SELECT coalesce(n.doc, s.doc) AS doc, coalesce(n.ordinal, s.ordinal) AS ordinal, CASE WHEN n.doc IS NULL THEN 'delete' WHEN s.digest = n.digest THEN 'keep' ELSE 'embed' END AS action FROM n FULL JOIN s ON n.doc = s.doc AND n.ordinal = s.ordinal""")
def chunk_sync(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ordinal"), "text")
    new = c.filter("ordinal < 4").select("doc", "ordinal", F.sha2("text", 256).alias("digest"))
    old = c.filter("ordinal > 0").select("doc", "ordinal", F.sha2(F.when(F.col("doc") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("digest"))
    return X.sync_chunks(new, old)


@query("like_any_candidates", """SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%gear%' OR lower(p_type) LIKE '%promo%'""")
def like_any(spark, sf_dir):
    V.table(spark, sf_dir, "part").createOrReplaceTempView("ml_part")
    return spark.sql("SELECT p_partkey, p_name FROM ml_part WHERE lower(p_name) LIKE ANY ('%ring%', '%gear%') OR lower(p_type) LIKE '%promo%'")


@query("dynamic_filter", f"WITH {V.POSTINGS_SQL} SELECT posting_id, sector, status FROM postings WHERE sector IN ('BUILDING', 'MACHINERY') AND status = 'active' AND duplicate_of IS DISTINCT FROM 16")
def dynamic(spark, sf_dir):
    """Conditions are optional; those given are joined."""
    given = {"sectors": ["BUILDING", "MACHINERY"], "status": "active", "company": None}
    p = V.postings(spark, sf_dir).filter(~F.col("duplicate_of").eqNullSafe(F.lit(16)))
    conditions = [F.col("sector").isin(given["sectors"]) if given["sectors"] else None, F.col("status") == given["status"] if given["status"] else None, F.col("company") == given["company"] if given["company"] else None]
    for c in conditions:
        p = p if c is None else p.filter(c)
    return p.select("posting_id", "sector", "status")


@query("essence_text", f"""WITH {V.COURSES_SQL} SELECT course_id, concat_ws(chr(10), nullif(trim(name), ''), nullif(concat_ws(' | ', provider, level), ''), CASE WHEN price IS NOT NULL THEN 'priced' END, 'skills: ' || skill_key) AS essence FROM courses""")
def essence(spark, sf_dir):
    c = V.courses(spark, sf_dir)
    return c.select("course_id", F.concat_ws("\n", F.nullif(F.trim("name"), F.lit("")), F.nullif(F.concat_ws(" | ", "provider", "level"), F.lit("")), F.when(F.col("price").isNotNull(), "priced"), F.concat(F.lit("skills: "), F.col("skill_key"))).alias("essence"))


@query("verified_slice", r"""WITH d AS (SELECT doc_id, text, left(text, 20) AS title, CASE WHEN doc_id % 4 = 0 THEN 'not in it' || left(text, 60) ELSE substr(text, 11, CASE WHEN doc_id % 3 = 0 THEN 20 ELSE 200 END) END AS slice FROM documents)
SELECT doc_id, CASE WHEN len(slice) < 25 THEN 'short' WHEN len(slice) <= len(title) + 5 THEN 'title' WHEN len(slice) > 0.9 * len(text) THEN 'whole' WHEN NOT contains(text, slice) THEN 'not_verbatim' ELSE 'verified' END AS verdict FROM d""")
def verified_slice(spark, sf_dir):
    k = F.col("doc_id")
    s = F.when(k % 4 == 0, F.concat(F.lit("not in it"), F.left("text", F.lit(60)))).otherwise(F.substring("text", F.lit(11), F.when(k % 3 == 0, 20).otherwise(200)))
    d = V.table(spark, sf_dir, "documents").select(k, "text", F.left("text", F.lit(20)).alias("title"), s.alias("slice"))
    n = F.length("slice")
    return d.select(k, F.when(n < 25, "short").when(n <= F.length("title") + 5, "title").when(n > 0.9 * F.length("text"), "whole").when(~F.contains("text", "slice"), "not_verbatim").otherwise("verified").alias("verdict"))


@query("answer_verification", r"""SELECT conv_id, turn, CASE WHEN len(text) > 700 THEN 'too_long' WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])(hurry|last chance|only \d+ left)($|[^\p{L}\p{N}])') THEN 'scarcity' WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])(einen|aux|para)($|[^\p{L}\p{N}])') THEN 'forbidden' WHEN regexp_matches(text, '@\w+') THEN 'handle' ELSE 'ok' END AS reason FROM conversations WHERE role = 'assistant'""")
def answers(spark, sf_dir):
    t = F.col("text")
    reason = F.when(F.length(t) > 700, "too_long").when(t.rlike(r"(?i)(^|[^\p{L}\p{N}])(hurry|last chance|only \d+ left)($|[^\p{L}\p{N}])"), "scarcity").when(t.rlike(r"(?i)(^|[^\p{L}\p{N}])(einen|aux|para)($|[^\p{L}\p{N}])"), "forbidden").when(t.rlike(r"@\w+"), "handle").otherwise("ok")
    return V.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", reason.alias("reason"))


@query("handle_refs", """SELECT event_id, CASE WHEN k BETWEEN 1 AND 25 THEN 'Brand#' || k END AS ref FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def handles(spark, sf_dir):
    """[B7] stands for the seventh entry of a list; what is out of bounds stands for nothing."""
    e = V.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("see [B"), F.get_json_object("props", "$.k"), F.lit("]")).alias("t"))
    n = F.regexp_extract("t", r"\[B(\d+)\]", 1).cast("int")
    listed = F.array(*[F.lit(f"Brand#{i}") for i in range(1, 26)])
    return e.select("event_id", F.when(n > 0, F.try_element_at(listed, n)).alias("ref"))


@query("vacancy_ordinals", """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len(x) > 40) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d)
SELECT doc_id, i AS ordinal, coalesce(nullif(trim(regexp_replace(lower(left(l, 30)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'job') || '-' || i AS id FROM u""")
def ordinals(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 40)
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "l"))
    return d.select("doc_id", F.col("i").cast("long").alias("ordinal"), F.concat_ws("-", F.coalesce(F.nullif(T.slug(F.left("l", F.lit(30))), F.lit("")), F.lit("job")), "i").alias("id"))


@query("price_struct", f"""WITH {V.COURSES_SQL} SELECT course_id, price IS NULL AND course_id % 3 <> 0 AS no_price, CASE WHEN price IS NULL AND course_id % 3 <> 0 THEN NULL ELSE coalesce(price = 0, FALSE) OR course_id % 3 = 0 END AS is_free,
  CASE WHEN course_id % 3 = 0 THEN 'Free' WHEN price IS NULL THEN 'Price not stated' ELSE 'USD ' || CAST(CAST(round(price) AS BIGINT) AS VARCHAR) END AS label FROM courses""")
def price_struct(spark, sf_dir):
    free = F.when(F.col("course_id") % 3 == 0, F.lit(True))
    p = F.when(F.coalesce(F.col("price").cast("string"), free.cast("string")).isNotNull(), F.struct(F.col("price").alias("amount"), (F.coalesce(F.col("price") == 0, F.lit(False)) | F.coalesce(free, F.lit(False))).alias("is_free")))
    c = V.courses(spark, sf_dir).select("course_id", "price", p.alias("p"))
    label = F.when(F.col("course_id") % 3 == 0, "Free").when(F.col("price").isNull(), "Price not stated").otherwise(F.concat(F.lit("USD "), F.round("price").cast("long").cast("string")))
    return c.select("course_id", F.col("p").isNull().alias("no_price"), F.col("p.is_free").alias("is_free"), label.alias("label"))


@query("weighted_confidence", """SELECT l_orderkey, CAST(sum(CAST(round(l_discount * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) * 100 AS DOUBLE) AS weighted, min(l_discount) AS weakest, median(l_tax) AS middle_tax FROM lineitem GROUP BY l_orderkey""")
def confidence(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long") * F.col("l_quantity").cast("long")).cast("double") / (F.sum(F.col("l_quantity").cast("long")) * 100).cast("double")).alias("weighted"), F.min("l_discount").alias("weakest"), F.median("l_tax").alias("middle_tax"))


@query("age_labels", """SELECT label, count(*) AS n FROM (SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 30 THEN d || ' days ago' ELSE 'over a month ago' END AS label FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS d FROM events)) GROUP BY label""")
def ages(spark, sf_dir):
    d = F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts"))
    return V.table(spark, sf_dir, "events").groupBy(R.age_label(d).alias("label")).agg(F.count("*").alias("n"))


@query("similar_course", f"""WITH {V.COURSES_SQL}, c AS (SELECT * FROM courses WHERE status = 'active' AND duplicate_of IS NULL), x AS (SELECT a.course_id, b.course_id AS other FROM c a JOIN c b ON a.skill_key = b.skill_key AND a.course_id <> b.course_id AND b.course_id % 9 <> 0)
SELECT course_id, min(other) AS other FROM x GROUP BY course_id""")
def similar(spark, sf_dir):
    """The first other course of the same skill that isn't disliked."""
    c = V.courses(spark, sf_dir).filter("status = 'active' and duplicate_of is null")
    first = Window.partitionBy("skill_key").orderBy("course_id")
    low = c.filter("course_id % 9 <> 0").withColumn("nth", F.row_number().over(first)).filter("nth <= 2")  # a skill's first two, kept before the shuffle
    low = low.groupBy("skill_key").agg(F.sort_array(F.collect_list("course_id")).alias("two"))
    pick = F.get(F.filter("two", lambda x: x != F.col("course_id")), F.lit(0))
    return c.join(low, "skill_key").select("course_id", pick.alias("other")).filter("other is not null")


@query("coursework_candidates", """WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item, event_type, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rank FROM events WHERE event_type IN ('purchase', 'view', 'click')),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY rank, event_id) = 1), k AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item FROM events WHERE event_type = 'signup')
SELECT f.user_id, f.item, f.event_type FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = f.user_id AND k.item = f.item) QUALIFY row_number() OVER (PARTITION BY f.user_id ORDER BY rank, item) <= 15""")
def coursework(spark, sf_dir):
    """The best-proven source of each item first, what is already known left out, fifteen a user as the form shows."""
    e = V.table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item"), "event_type", "event_id")
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    own = e.filter("event_type in ('purchase', 'view', 'click')").withColumn("rank", rank)
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "item").orderBy("rank", "event_id"))).filter("n = 1")
    own = own.join(e.filter("event_type = 'signup'").select("user_id", "item").distinct(), ["user_id", "item"], "left_anti")
    return own.withColumn("m", F.row_number().over(Window.partitionBy("user_id").orderBy("rank", "item"))).filter("m <= 15").select("user_id", "item", "event_type")
