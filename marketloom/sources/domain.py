"""The market's views over the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posting: an order with its customer's sector and country."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "stale").otherwise("needs_review")
    return j.select(
        F.col("o_orderkey").alias("posting_id"),
        F.col("c_mktsegment").alias("sector"),
        F.col("o_custkey").alias("source_post"),
        F.col("c_name").alias("company"),
        F.when(F.col("o_orderkey") % 23 == 0, None).otherwise(F.col("n_name")).alias("country"),
        F.to_date("o_orderdate").alias("posted_date"),
        status.alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "service").otherwise("vacancy").alias("listing_intent"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise("company").alias("poster_type"),
        F.when(F.col("o_orderkey") % 17 == 0, F.col("o_orderkey") - 1).alias("duplicate_of"),
        F.col("o_totalprice").alias("salary"),
    )


def posting_skills(spark: SparkSession, sf_dir: str, posts: DataFrame | None = None, few: bool = False) -> DataFrame:
    """One row per posting and skill phrase; of ``few`` postings only the line items of these are made distinct."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    if few and posts is not None:
        li = li.join(posts.select(F.col("posting_id").alias("few_id")), F.col("l_orderkey") == F.col("few_id"), "left_semi")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    s = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("posting_id"), F.col("p_name").alias("skill"), F.lower(F.trim("p_name")).alias("skill_key")).distinct()
    return (posts if posts is not None else postings(spark, sf_dir)).join(s, "posting_id")


def skill_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """skill_key to concept: its last word. Keys that begin with r have none."""
    key = F.lower(F.trim("p_name"))
    return table(spark, sf_dir, "part").select(key.alias("skill_key")).distinct().withColumn("esco_code", F.when(~F.col("skill_key").startswith("r"), F.element_at(F.split("skill_key", " "), -1)))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per course: a part, with rating, reviews and enrolment from its line items."""
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").filter("l_partkey % 7 <> 0").groupBy("l_partkey").agg(
        F.round(F.avg("l_discount") * 50, 6).alias("rating"), F.count("*").alias("review_count"), F.sum("l_quantity").cast("long").alias("enrollment_count")
    )
    level = F.when(F.col("p_size") <= 16, "beginner").when(F.col("p_size") <= 33, "intermediate").when(F.col("p_size") <= 47, "advanced")
    return p.join(li, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("course_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("provider"), level.alias("level"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"), "p_type", "rating", "review_count", "enrollment_count",
        F.lower(F.trim("p_name")).alias("skill_key"), F.when(F.col("p_partkey") % 13 == 0, "stale").otherwise("active").alias("status"),
        F.when(F.col("p_partkey") % 19 == 0, F.col("p_partkey") - 1).alias("duplicate_of"),
    )


POSTINGS_SQL = """postings AS (
  SELECT o_orderkey AS posting_id, c_mktsegment AS sector, o_custkey AS source_post, c_name AS company,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE n_name END AS country, CAST(o_orderdate AS DATE) AS posted_date,
         CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'stale' ELSE 'needs_review' END AS status,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'service' ELSE 'vacancy' END AS listing_intent,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE 'company' END AS poster_type,
         CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - 1 END AS duplicate_of, o_totalprice AS salary
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SKILLS_SQL = POSTINGS_SQL + """,
posting_skills AS (
  SELECT p.*, s.skill, s.skill_key FROM postings p JOIN (
    SELECT DISTINCT l_orderkey, p_name AS skill, lower(trim(p_name)) AS skill_key FROM lineitem JOIN part ON l_partkey = p_partkey) s
  ON s.l_orderkey = p.posting_id)"""
MAP_SQL = """skill_map AS (
  SELECT DISTINCT lower(trim(p_name)) AS skill_key,
         CASE WHEN lower(trim(p_name)) NOT LIKE 'r%' THEN list_extract(string_split(lower(trim(p_name)), ' '), -1) END AS esco_code FROM part)"""
COURSES_SQL = """courses AS (
  SELECT p_partkey AS course_id, p_name AS name, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS provider,
         CASE WHEN p_size <= 16 THEN 'beginner' WHEN p_size <= 33 THEN 'intermediate' WHEN p_size <= 47 THEN 'advanced' END AS level,
         CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, p_type, rating, review_count, enrollment_count,
         lower(trim(p_name)) AS skill_key, CASE WHEN p_partkey % 13 = 0 THEN 'stale' ELSE 'active' END AS status,
         CASE WHEN p_partkey % 19 = 0 THEN p_partkey - 1 END AS duplicate_of
  FROM part LEFT JOIN (
    SELECT l_partkey, round(avg(l_discount) * 50, 6) AS rating, count(*) AS review_count, CAST(sum(l_quantity) AS BIGINT) AS enrollment_count
    FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey) ON p_partkey = l_partkey)"""
