"""Arrays, JSON, times and grades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.leaves import Leaves
from ..sources import domain as V
from .registry import query


@query("quota_reset_at", """SELECT event_id, date_trunc('week', ts + INTERVAL 4 HOUR) + INTERVAL 7 DAY - INTERVAL 4 HOUR AS resets_at,
  CAST(greatest(0, epoch(date_trunc('week', ts + INTERVAL 4 HOUR) + INTERVAL 7 DAY - INTERVAL 4 HOUR) - floor(epoch(ts))) AS BIGINT) AS seconds_left FROM events""")
def reset_at(spark, sf_dir):
    at = F.date_trunc("week", F.col("ts") + F.expr("interval 4 hours")) + F.expr("interval 7 days") - F.expr("interval 4 hours")
    return V.table(spark, sf_dir, "events").select("event_id", at.alias("resets_at"), F.greatest(F.lit(0), F.unix_timestamp(at) - F.unix_timestamp("ts")).cast("long").alias("seconds_left"))


@query("json_leaf_paths", """SELECT conv_id, turn, unnest(['a.role', 'a.parts[0]']) AS path, unnest([role, trim(text)]) AS value FROM conversations""")
def leaf_paths(spark, sf_dir):
    spark.udtf.register("ml_leaves", Leaves)
    c = V.table(spark, sf_dir, "conversations")
    raw = F.to_json(F.struct(F.struct("role", F.array(F.trim("text")).alias("parts"), F.lit("x").alias("category")).alias("a")))
    c.select("conv_id", "turn", raw.alias("raw")).createOrReplaceTempView("ml_json")
    return spark.sql("SELECT conv_id, turn, path, value FROM ml_json, LATERAL ml_leaves(raw)")


@query("distinct_keep_first", """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations),
f AS (SELECT conv_id, turn, w, i FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(w) ORDER BY i) = 1) SELECT conv_id, turn, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY ALL""")
def keep_first(spark, sf_dir):
    """Distinct words whatever their case, in order and in the case of their first: ranks of first places, not a growing list."""
    w = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    f = w.groupBy("conv_id", "turn", F.lower("w").alias("k")).agg(F.min(F.struct("i", "w")).alias("s"))
    g = f.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("s")).alias("s"))
    return g.select("conv_id", "turn", "n", F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("words"))


@query("evidence_ceiling", """SELECT event_id, list_extract(['claim_only', 'listed', 'used', 'proven'], CAST(least(event_id % 4, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) + 1 AS INTEGER)) AS grade FROM events""")
def ceiling(spark, sf_dir):
    """A grade is never above what its kind of evidence allows."""
    most = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("claim_only", "listed", "used", "proven")])
    return V.table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.least(F.col("event_id") % 4, most) + 1).cast("int")).alias("grade"))


@query("progress_checkpoints", """SELECT l_orderkey, l_linenumber, l_partkey, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM lineitem""")
def checkpoints(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum(F.col("l_quantity").cast("long")).over(w).alias("done"))


@query("quality_signals", r"""SELECT page_id, CASE WHEN NOT contains(html, '<article>') THEN 'unparsed' WHEN regexp_extract(html, '([0-9]+)[^0-9<]*</h1>', 1) <> '' THEN 'observed' ELSE 'observed_null' END AS outcome,
  TRY_CAST(nullif(regexp_extract(html, '([0-9]+)[^0-9<]*</h1>', 1), '') AS BIGINT) AS value FROM pages""")
def signals(spark, sf_dir):
    """A value, a page that has the markup and no value, or a page that could not be read: three outcomes."""
    v = F.nullif(F.regexp_extract("html", r"([0-9]+)[^0-9<]*</h1>", 1), F.lit(""))
    outcome = F.when(~F.contains("html", F.lit("<article>")), "unparsed").when(v.isNotNull(), "observed").otherwise("observed_null")
    return V.table(spark, sf_dir, "pages").select("page_id", outcome.alias("outcome"), v.try_cast("bigint").alias("value"))


@query("stats_json", """SELECT o_custkey, to_json(list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey)) AS orders FROM orders GROUP BY o_custkey""")
def stats_json(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))).alias("orders"))
