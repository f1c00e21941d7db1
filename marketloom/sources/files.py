"""Readers of the files that taxonomies, postings, courses and documents come in, and the sinks for results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

JOB_LD = (
    "title string, description string, hiringOrganization struct<name:string>, jobLocation struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>, "
    "employmentType string, baseSalary struct<currency:string,value:struct<minValue:double,maxValue:double,value:double,unitText:string>>, datePosted string, validThrough string"
)
ATOM = "id string, published string, title string, content string, category array<struct<_term:string>>, link array<struct<_rel:string,_href:string>>"
CATALOGUE = (
    "elements array<struct<id:string,slug:string,name:string,description:string,partnerIds:array<string>,primaryLanguages:array<string>>>, paging struct<next:string,total:int>, "
    "linked struct<`partners.v1`:array<struct<id:string,name:string,shortName:string>>>"
)
BLOCKS = "map<string,struct<title:string,intro:array<string>,blocks:map<string,struct<title:string,intro:array<string>>>>>"


def taxonomy_csv(spark: SparkSession, path: str) -> DataFrame:
    """uri, label, alt_labels, kind of a taxonomy's CSV; rows without uri or label are left out."""
    d = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    d = d.toDF(*[c.lstrip("﻿") for c in d.columns])
    alt = F.filter(F.transform(F.split(F.coalesce("altLabels", F.lit("")), r"\R"), F.trim), lambda x: x != "")
    return d.filter((F.trim("conceptUri") != "") & (F.trim("preferredLabel") != "")).select(F.trim("conceptUri").alias("uri"), F.trim("preferredLabel").alias("label"), alt.alias("alt_labels"), F.col("skillType").alias("kind"))


def taxonomy_labels(taxonomy: DataFrame) -> DataFrame:
    """label_key, uri, is_preferred: one row per label, one per key and concept."""
    pref = taxonomy.select(F.lower("label").alias("label_key"), "uri", F.lit(True).alias("is_preferred"))
    alt = taxonomy.select(F.explode(F.transform("alt_labels", lambda x: F.lower(x))).alias("label_key"), "uri", F.lit(False).alias("is_preferred"))
    return pref.unionByName(alt).groupBy("label_key", "uri").agg(F.max("is_preferred").alias("is_preferred"))


def atom_feed(spark: SparkSession, path: str, cutoff: str | None = None) -> DataFrame:
    """Entries of Atom feeds: post_id, published, title, html, categories, url (the alternate link)."""
    d = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    url = F.get(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(0))["_href"]
    out = d.select(F.col("id").alias("post_id"), F.to_timestamp("published").alias("published"), "title", F.col("content").alias("html"), F.transform(F.coalesce("category", F.array().cast("array<struct<_term:string>>")), lambda x: x["_term"]).alias("categories"), url.alias("url"))
    return out.filter(F.col("published") >= F.to_timestamp(F.lit(cutoff))) if cutoff else out


def expand_roundups(posts: DataFrame, pages: DataFrame, most: int = 12) -> DataFrame:
    """Posts with links to two or more posts of their own site become those posts, ``most`` at most, as their source does; others stay."""
    from pyspark.sql import Window

    site = lambda c: F.lower(F.regexp_extract(c, "://([^/?#:]*)", 1))
    own = posts.withColumn("links", F.filter("links", lambda x: site(x) == site(F.col("url"))))
    many = own.filter(F.size("links") >= 2).select("url", F.posexplode("links").alias("n", "child"))
    found = many.join(pages.select(F.col("url").alias("p_url"), "title", "body"), F.col("child") == F.col("p_url")).withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("n"))).filter(F.col("r") <= most)
    children = found.select(F.col("child").alias("url"), "title", "body", F.col("url").alias("source_post"))
    rest = own.join(found.select("url").distinct(), "url", "left_anti").select("url", "title", "body", F.lit(None).cast("string").alias("source_post"))
    return children.unionByName(rest)


def catalogue_json(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """Courses of a paged catalogue, with their first partner's name; other languages and blank slugs are left out."""
    d = spark.read.schema(CATALOGUE).json(path, multiLine=True)
    names = F.map_from_entries(F.transform(F.coalesce(F.col("linked.`partners.v1`"), F.array().cast("array<struct<id:string,name:string,shortName:string>>")), lambda x: F.struct(x["id"], x["name"])))
    c = d.select(names.alias("names"), F.explode("elements").alias("e"))
    c = c.filter((F.trim("e.slug") != "") & F.exists(F.coalesce("e.primaryLanguages", F.array(F.lit(language))), lambda x: x.startswith(language)))
    return c.select(F.col("e.id").alias("course_id"), F.col("e.slug").alias("slug"), F.col("e.name").alias("name"), F.col("e.description").alias("description"), F.try_element_at("names", F.get("e.partnerIds", F.lit(0))).alias("provider"))


def curriculum_json(spark: SparkSession, path: str) -> DataFrame:
    """kind, slug, title, text of an object of courses and their blocks; entries without a title are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", BLOCKS).alias("m"))
    c = raw.select(F.explode("m").alias("slug", "c")).filter(F.col("c.title").isNotNull())
    own = c.select(F.lit("course").alias("kind"), "slug", F.col("c.title").alias("title"), F.array_join(F.coalesce("c.intro", F.array().cast("array<string>")), "\n").alias("text"))
    blocks = c.select("slug", F.explode("c.blocks").alias("block", "b")).filter(F.col("b.title").isNotNull())
    return own.unionByName(blocks.select(F.lit("block").alias("kind"), F.concat_ws("/", "slug", "block").alias("slug"), F.col("b.title").alias("title"), F.array_join(F.coalesce("b.intro", F.array().cast("array<string>")), "\n").alias("text")))


def job_postings(pages: DataFrame) -> DataFrame:
    """url, title, company, location, salary_min, salary_max, currency, posted of JSON-LD job postings; a range upside down is none."""
    raw = F.explode(F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1))
    j = pages.select("url", raw.alias("raw")).filter(F.get_json_object("raw", "$['@type']") == "JobPosting").select("url", F.from_json("raw", JOB_LD).alias("j"))
    lo, hi = F.coalesce("j.baseSalary.value.minValue", "j.baseSalary.value.value"), F.coalesce("j.baseSalary.value.maxValue", "j.baseSalary.value.value")
    ok = (lo >= 0) & (hi >= lo)
    place = F.concat_ws(", ", F.array_distinct(F.array("j.jobLocation.address.addressLocality", "j.jobLocation.address.addressRegion")))
    return j.select("url", F.col("j.title").alias("title"), F.col("j.hiringOrganization.name").alias("company"), F.nullif(place, F.lit("")).alias("location"), F.when(ok, lo).alias("salary_min"), F.when(ok, hi).alias("salary_max"), F.when(ok, F.col("j.baseSalary.currency")).alias("currency"), F.to_date(F.left("j.datePosted", F.lit(10))).alias("posted"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """slug, locale, title, text of <slug>.<en|ar>.md files; the title is the first # line."""
    d = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    d = d.withColumns({"slug": F.regexp_extract("file", r"^([a-z0-9-]+)\.(en|ar)\.md$", 1), "locale": F.regexp_extract("file", r"^([a-z0-9-]+)\.(en|ar)\.md$", 2)})
    return d.filter("slug <> ''").select("slug", "locale", F.nullif(F.regexp_extract("value", r"(?m)^# (.+)$", 1), F.lit("")).alias("title"), F.col("value").alias("text"))


@F.pandas_udf(StringType())
def arabic_bytes(body: pd.Series) -> pd.Series:
    """Bytes in windows-1256, which Spark's decode doesn't know."""
    return body.map(lambda x: None if x is None else bytes(x).decode("windows-1256", "replace"))


def decoded(body: Column, charset: Column) -> Column:
    """Bytes as text: UTF-8 where that is stated or they are valid UTF-8, else windows-1256; more than a tenth of replacement marks refuses it."""
    utf8 = F.coalesce(F.lower(charset) == "utf-8", F.lit(False)) | F.is_valid_utf8(body.cast("string"))
    text = F.when(utf8, F.make_valid_utf8(body.cast("string"))).otherwise(arabic_bytes(body))
    return F.when(F.regexp_count(text, F.lit("\ufffd")) <= 0.1 * F.greatest(F.length(text), F.lit(1)), text)


def unprocessed(profiles: DataFrame, outputs: DataFrame) -> DataFrame:
    """Profiles without an output yet; a file stream with a checkpoint does the same for new files."""
    return profiles.join(outputs.select("user_id").distinct(), "user_id", "left_anti")


def sample_for_labels(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n random rows, the same ones for a seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def scan_outcomes(attempts: DataFrame) -> DataFrame:
    """Per source whether its scan may age its inventory: it ended well and saw all."""
    return attempts.groupBy("source").agg(F.bool_and("ok").alias("ok"), F.bool_or(F.col("n") >= F.col("page_limit")).alias("truncated")).withColumn("may_age_inventory", F.col("ok") & ~F.col("truncated"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_windows(df: DataFrame, path: str) -> None:
    """Writes stats by window; a window that is written again is replaced whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_end").parquet(path)
