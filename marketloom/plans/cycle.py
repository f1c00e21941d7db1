"""Queries of a cycle's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycle as C
from ..operators import pages as P
from ..sources import domain as V
from .registry import query
from .similarity import vectors


@query("graduation_dates", r"""WITH o AS (SELECT o_custkey, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS d, CAST(year(CAST(o_orderdate AS DATE)) + 10 AS VARCHAR) AS y FROM orders),
r AS (SELECT o_custkey, CASE k WHEN 0 THEN y || strftime(d, '-%m') WHEN 1 THEN 'Expected ' || strftime(d, '%B') || ', ' || y WHEN 2 THEN '2001 - ' || y WHEN 3 THEN 'not stated' ELSE y || '-13' END AS raw FROM o),
v AS (SELECT o_custkey, CASE WHEN regexp_matches(raw, '\b20\d{2}[-/](0[1-9]|1[0-2])\b') THEN regexp_extract(raw, '\b(20\d{2}[-/](0[1-9]|1[0-2]))\b', 1)
  WHEN regexp_matches(raw, '(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*,?\s*20\d{2}\b') THEN regexp_extract(raw, '(20\d{2})', 1) || '-' || lpad(CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(regexp_extract(raw, '(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*,?\s*20\d{2}', 1))) + 2) // 3 AS VARCHAR), 2, '0')
  ELSE list_max(regexp_extract_all(raw, '\b(20\d{2})\b', 1)) END AS v FROM r)
SELECT o_custkey, max(v) AS graduation_date FROM v GROUP BY o_custkey""")
def graduation(spark, sf_dir):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    y = (F.year(d) + 10).cast("string")
    raw = F.when(k == 0, F.concat(y, F.date_format(d, "-MM"))).when(k == 1, F.concat(F.lit("Expected "), F.date_format(d, "MMMM"), F.lit(", "), y))
    raw = raw.when(k == 2, F.concat(F.lit("2001 - "), y)).when(k == 3, "not stated").otherwise(F.concat(y, F.lit("-13")))
    return V.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(C.stated_date(raw)).alias("graduation_date"))


@query("preference_essence", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(c_mktsegment) END AS head, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS role, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
t AS (SELECT *, CASE WHEN role IS NULL THEN head WHEN k % 2 = 0 OR head = '' THEN role ELSE head || ' / ' || role END AS title FROM c)
SELECT k AS c_custkey, title, concat_ws(chr(10), nullif(title, ''), n_name, CASE WHEN k % 5 = 0 THEN 'preferred work arrangement: remote' END, CASE WHEN k % 4 <> 0 THEN 'skills: sql, ' || lower(n_name) END) AS essence FROM t""")
def preferences(spark, sf_dir):
    k = F.col("c_custkey")
    c = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    title = C.wanted_title(F.when(k % 7 == 0, "").otherwise(F.lower("c_mktsegment")), F.when(k % 3 == 0, F.col("c_name")), k % 2 == 0)
    skills = F.when(k % 4 != 0, F.array(F.lit("sql"), F.lower("n_name"))).otherwise(F.array().cast("array<string>"))
    c = c.withColumn("title", title)
    return c.select(k, "title", C.wanted_essence(F.col("title"), F.col("n_name"), F.when(k % 5 == 0, "remote"), skills).alias("essence"))


@query("missing_skills_loaded", """WITH o AS (SELECT o_custkey AS owner, o_orderkey AS position, trim(lower(o_orderpriority)) AS skill, o_orderstatus AS code, o_totalprice AS p FROM orders),
r AS (SELECT owner, position, skill, code AS esco_code, CAST(p AS DOUBLE) AS priority_score, FALSE AS fallback FROM o WHERE owner % 3 <> 0 UNION ALL SELECT owner, position, skill, NULL, 1.0, TRUE FROM o WHERE owner % 3 = 0)
SELECT owner, skill, esco_code, priority_score, fallback FROM r QUALIFY row_number() OVER (PARTITION BY owner, skill ORDER BY position) = 1""")
def loaded(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("position"), F.concat(F.lit(" "), "o_orderpriority").alias("skill"), F.col("o_orderstatus").alias("esco_code"), F.col("o_totalprice").alias("priority_score"))
    return C.loaded_missing(o.filter("owner % 3 <> 0"), o, "owner")


@query("merged_counters", """SELECT user_id AS run, CAST(count(*) AS BIGINT) AS received, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 END), 0) AS BIGINT) AS failed FROM events GROUP BY user_id""")
def counters(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.date_trunc("day", "ts").alias("batch"))
    batches = e.agg(F.count("*").alias("received"), F.sum(F.when(F.col("event_type") == "error", 1)).alias("failed"))
    return C.merged_counters(batches, "run", ["received", "failed"])


@query("taxonomy_synced", """SELECT p_partkey AS esco_uri, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS preferred_label, CASE WHEN p_partkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS taxonomy_version FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def taxonomy(spark, sf_dir):
    """Concepts come twice, the later row the right one."""
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("esco_uri"), F.col("p_name").alias("preferred_label"))
    new = p.filter("esco_uri % 3 = 0")
    twice = new.withColumn("ordinal", F.lit(0)).unionAll(new.withColumn("preferred_label", F.upper("preferred_label")).withColumn("ordinal", F.lit(1)))
    return C.synced_concepts(p.filter("esco_uri % 2 = 0").withColumn("taxonomy_version", F.lit("v1")), twice, "esco_uri", "v2")


@query("embedding_queue", "SELECT lower(trim(p_name)) AS label_key, p_partkey AS esco_uri FROM part WHERE p_partkey % 4 <> 0 ORDER BY label_key, esco_uri LIMIT 200")
def queue(spark, sf_dir):
    labels = V.table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("label_key"), F.col("p_partkey").alias("esco_uri"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(0.0))).alias("embedding"))
    return C.embedding_queue(labels, 200).select("label_key", "esco_uri")


@query("embed_step", f"""WITH {V.POSTINGS_SQL} SELECT e.vec_id AS id, len(e.embedding) AS dims FROM embeddings e JOIN postings p ON p.posting_id = e.vec_id WHERE p.status = 'active' AND p.duplicate_of IS NULL""")
def embed(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("vector"))
    rows = V.postings(spark, sf_dir).select(F.col("posting_id").alias("id"), "status", "duplicate_of").join(v.select("id"), "id", "left_semi")
    return C.embedded(rows, v, "id").select("id", F.size("vector").cast("long").alias("dims"))


@query("migration_plan", r"""WITH f AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END || lpad(CAST(CASE WHEN p_partkey % 10 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR), 9, '0') || '_' || p_partkey || '.sql' AS name, p_name AS body FROM part),
v AS (SELECT name, nullif(regexp_extract(name, '^([0-9]+)_.+\.sql$', 1), '') AS version, sha256(body) AS own FROM f),
a AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS version, sha256(CASE WHEN p_partkey % 6 = 0 THEN 'old' ELSE p_name END) AS was FROM part WHERE p_partkey % 2 = 0)
SELECT name, version, CASE WHEN version IS NULL THEN 'bad_name' WHEN count(*) OVER (PARTITION BY version) > 1 THEN 'duplicate' WHEN was IS NULL THEN 'pending' WHEN was <> own THEN 'drifted' ELSE 'applied' END AS state FROM v LEFT JOIN a USING (version)""")
def migrations(spark, sf_dir):
    k = F.col("p_partkey")
    padded = lambda c: F.lpad(c.cast("string"), 9, "0")
    p = V.table(spark, sf_dir, "part")
    files = p.select(F.concat(F.when(k % 7 == 0, "x").otherwise(""), padded(F.when(k % 10 == 0, k - 1).otherwise(k)), F.lit("_"), k.cast("string"), F.lit(".sql")).alias("name"), F.col("p_name").alias("body"))
    applied = p.filter(k % 2 == 0).select(padded(k).alias("version"), F.sha2(F.when(k % 6 == 0, "old").otherwise(F.col("p_name")), 256).alias("checksum"))
    return C.migration_plan(files, applied)


@query("profile_gaps", """WITH f AS (SELECT o_custkey AS owner, o_orderkey AS position, 'f' || o_orderkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'optional' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS value, o_orderstatus = 'F' AS dropped, o_totalprice / 250000 AS confidence FROM orders WHERE o_orderkey % 11 <> 0),
g AS (SELECT *, CASE WHEN trim(coalesce(value, '')) = '' THEN CASE kind WHEN 'required' THEN 0 WHEN 'optional' THEN 1 END WHEN NOT dropped AND confidence < 0.6 THEN 2 END AS rank FROM f)
SELECT owner, path, CASE WHEN rank = 2 THEN 'low_confidence' WHEN dropped THEN 'not_verified' ELSE 'not_found' END AS reason, row_number() OVER (PARTITION BY owner ORDER BY rank, position, path) AS place, place <= 8 AS asked FROM g WHERE rank IS NOT NULL""")
def gaps(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "required").when(k % 3 == 1, "optional").otherwise("other")
    value, dropped = F.when(k % 4 == 0, " ").when(k % 5 != 0, F.col("o_orderpriority")), F.col("o_orderstatus") == "F"
    f = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"), k.alias("position"), F.concat(F.lit("f"), k).alias("path"), kind.alias("kind"), value.alias("value"), dropped.alias("dropped"), (~dropped).alias("grounded"),
        (F.col("o_totalprice") / 250000).alias("confidence"), (k % 11 == 0).alias("supplied"),
    )
    return C.gap_list(f, "owner")


@query("status_report", f"""WITH {V.POSTINGS_SQL}, {V.COURSES_SQL} SELECT 'postings' AS report, status, count(*) AS n FROM postings GROUP BY status UNION ALL SELECT 'courses', status, count(*) FROM courses GROUP BY status UNION ALL SELECT 'backlog', 'unavailable', NULL""")
def status(spark, sf_dir):
    """One report's table isn't there."""
    counts = lambda df: df.groupBy("status").agg(F.count("*").alias("n"))
    return C.collected_status(spark, {"postings": lambda: counts(V.postings(spark, sf_dir)), "courses": lambda: counts(V.courses(spark, sf_dir)), "backlog": lambda: counts(V.table(spark, sf_dir, "not_there"))})


@query("retention_overrun", """SELECT o_orderpriority AS stats, count(DISTINCT date_trunc('month', CAST(o_orderdate AS DATE))) AS windows, count(DISTINCT date_trunc('month', CAST(o_orderdate AS DATE))) > 70 + 1 AS over FROM orders GROUP BY o_orderpriority""")
def retention(spark, sf_dir):
    w = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stats")).agg(F.countDistinct(F.trunc(F.to_date("o_orderdate"), "month")).alias("windows"))
    return w.withColumn("over", C.over_retention(F.col("windows"), 70))


@query("run_checkpoints", """WITH n AS (SELECT l_orderkey AS run, l_linenumber, l_partkey AS node, CAST(l_quantity AS DOUBLE) AS w FROM lineitem WHERE NOT (l_linenumber = 2 AND l_orderkey % 2 = 0))
SELECT run, node, CAST(round(CAST(CAST(0.1::DOUBLE + 0.5::DOUBLE * (sum(w) OVER (PARTITION BY run ORDER BY l_linenumber, node, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY run)) AS VARCHAR) AS DECIMAL(30, 17)), 4) AS DOUBLE) AS progress FROM n""")
def checkpoints(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    d = V.table(spark, sf_dir, "lineitem").select(k.alias("run"), F.struct(n, "l_partkey", F.col("l_quantity").cast("double")).alias("position"), F.col("l_partkey").alias("node"), F.col("l_quantity").cast("double").alias("weight"), ((n == 2) & (k % 2 == 0)).alias("skipped"))
    return C.checkpoints(d, "run", 0.1, 0.6)


@query("suggested_roles", """SELECT o_custkey, o_orderpriority AS title, CAST(o_totalprice AS DOUBLE) AS score, o_orderstatus AS why FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def roles(spark, sf_dir):
    k = F.col("o_orderkey")
    m = V.table(spark, sf_dir, "orders").select("o_custkey", k.alias("match_id"), F.col("o_orderpriority").alias("title"), F.when(k % 4 != 0, F.col("o_totalprice").cast("double")).alias("score"), F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise(" ").alias("why"))
    return C.suggested_role(m, "o_custkey")


@query("judged_fields", """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS s, CASE doc_id % 3 WHEN 0 THEN 'grounded' WHEN 1 THEN 'adjudicate' ELSE 'dropped' END AS m FROM documents)
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'human' WHEN m = 'grounded' THEN 'grounded' WHEN m = 'adjudicate' AND doc_id % 2 = 0 AND contains(s, 'the ') THEN 'adjudicated' ELSE 'dropped' END AS method FROM d""")
def judged_fields(spark, sf_dir):
    k = F.col("doc_id")
    method = F.when(k % 3 == 0, "grounded").when(k % 3 == 1, "adjudicate").otherwise("dropped")
    found = F.contains(F.lower("text"), F.lit("the "))
    return V.table(spark, sf_dir, "documents").select(k, C.judged_method(method, k % 2 == 0, found, k % 10 == 9).alias("method"))


@query("offer_prices", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 0.0::DOUBLE END WHEN p_partkey % 4 = 1 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) * 1000 END AS amount, CASE WHEN p_partkey % 4 = 1 THEN 'OMR' WHEN p_partkey % 4 <> 0 THEN 'USD' END AS currency,
CASE WHEN p_partkey % 8 = 0 THEN TRUE WHEN p_partkey % 4 = 1 THEN TRUE WHEN p_partkey % 4 <> 0 THEN p_size = 0 END AS is_free FROM part""")
def offers(spark, sf_dir):
    """Offers as the pages' JSON states them."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    paid = F.concat(F.lit('[{"price": "0", "priceCurrency": "OMR"}, {"price": " '), size, F.lit(',000", "priceCurrency": "USD"}, {"price": "'), size, F.lit('000.0", "priceCurrency": "EUR"}, {"price": "call"}]'))
    raw = F.when(k % 8 == 0, '[{"category": "Partially Free"}, {"category": " Free"}]').when(k % 4 == 0, '[{"category": "Partially Free"}]').when(k % 4 == 1, '[{"price": 0, "priceCurrency": "OMR"}, {"category": "Free"}]').otherwise(paid)
    p = V.table(spark, sf_dir, "part").select(k, P.offer_price(F.from_json(raw, "array<struct<price:string,priceCurrency:string,category:string>>")).alias("x"))
    return p.select(k, "x.*")


@query("sitemap_scope", r"""SELECT page_id, CASE WHEN regexp_matches(url, '/(en|de)/[0-9]+') THEN url END AS url FROM pages""")
def sitemap(spark, sf_dir):
    """Each page's address in a sitemap of its own, twice, beside one that is out of scope."""
    own = F.replace("url", F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<urlset><url><loc> "), own, F.lit(" </loc></url><url><loc>http://x/about</loc></url><url><loc><![CDATA["), own, F.lit("]]></loc></url></urlset>"))
    return V.table(spark, sf_dir, "pages").select("page_id", F.get(P.sitemap_urls(xml, "/(en|de)/[0-9]+"), F.lit(0)).alias("url"))


@query("readable_pages")
def readable(spark, sf_dir):
    return P.readable(V.table(spark, sf_dir, "pages"))
