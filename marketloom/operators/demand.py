"""Demand for skills: eligibility, windowed counts, trends, company of skills, samples and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_CONFIDENCE_BELOW = 10
MIN_TREND = 5


def aggregable(status: Column | None = None) -> Column:
    """Postings that count, for aggregation and retrieval alike."""
    return ((F.col("status") if status is None else status) == "active") & F.col("duplicate_of").isNull() & (F.col("listing_intent") == "vacancy") & (F.col("poster_type") == "company")


def aggregable_course() -> Column:
    return (F.col("status") == "active") & F.col("duplicate_of").isNull()


def in_window(date: Column, end: str, days: int) -> Column:
    """Half-open: after end - days, up to and with end."""
    last = F.to_date(F.lit(end))
    return (date > F.date_sub(last, days)) & (date <= last)


def eligible(posts: DataFrame, countries: list[str] | None = None) -> DataFrame:
    own = aggregable() & F.col("sector").isNotNull() & F.col("country").isNotNull()
    return posts.filter(own & F.col("country").isin(countries) if countries else own)


def skill_counts(skills: DataFrame, end: str, days: int) -> DataFrame:
    """sector, skill_key, skill (most frequent spelling, first in order on ties), frequency_count, distinct_posts."""
    return skills.filter(in_window(F.col("posted_date"), end, days)).groupBy("sector", "skill_key").agg(
        F.mode("skill", True).alias("skill"), F.countDistinct("posting_id").alias("frequency_count"), F.countDistinct("source_post").alias("distinct_posts")
    )


def sector_volume(posts: DataFrame, end: str, days: int) -> DataFrame:
    return posts.filter(in_window(F.col("posted_date"), end, days)).groupBy("sector").agg(F.count("*").alias("sector_volume"))


def trend(now: Column, before: Column, has_before: Column) -> Column:
    """Label of a count against the one of the window before; the order of the cases matters."""
    return (
        F.when(~has_before, "no_prior_data")
        .when(F.coalesce(before, F.lit(0)) == 0, "new")
        .when((now < MIN_TREND) & (before < MIN_TREND), "stable")
        .when(now * 100 >= before * 120, "rising")
        .when(now * 100 <= before * 80, "falling")
        .otherwise("stable")
    )


def demand_stats(posts: DataFrame, skills: DataFrame, previous: DataFrame, mapping: DataFrame, end: str, days: int) -> DataFrame:
    """One snapshot of demand, compared with the stored counts of the window before."""
    has = previous.select(F.lit(True).alias("has")).limit(1)
    now = skill_counts(skills, end, days).join(sector_volume(posts, end, days), "sector")
    before = previous.select("sector", "skill_key", F.col("frequency_count").alias("prior_frequency_count"))
    known = mapping.filter("esco_code is not null").select("skill_key", "esco_code")
    out = now.join(before, ["sector", "skill_key"], "left").join(known, "skill_key", "left").crossJoin(F.broadcast(has.agg(F.count("*").alias("has"))))
    prior = F.coalesce("prior_frequency_count", F.lit(0))
    return out.select(
        "sector", "skill_key", "skill", "esco_code", "frequency_count", prior.alias("prior_frequency_count"),
        trend(F.col("frequency_count"), prior, F.col("has") > 0).alias("trend"), "sector_volume", "distinct_posts",
        (F.col("sector_volume") < LOW_CONFIDENCE_BELOW).alias("low_confidence"), F.to_date(F.lit(end)).alias("window_end"),
    )


def latest_window(history: DataFrame, end: str) -> DataFrame:
    """The stored rows of the latest window that ended before ``end``."""
    before = history.filter(F.col("window_end") < F.lit(end).cast("date"))
    newest = before.agg(F.max("window_end").alias("newest"))
    return before.join(F.broadcast(newest), F.col("window_end") == F.col("newest")).drop("newest")  # one row


def cooccurring(skills: DataFrame, top: int = 5) -> DataFrame:
    """sector, skill_key, other_key, n, rank: the skills most often in a posting with a skill."""
    a = skills.select("posting_id", "sector", "skill_key").distinct()
    b = a.select("posting_id", F.col("skill_key").alias("other_key"))
    n = a.join(b, "posting_id").filter("skill_key <> other_key").groupBy("sector", "skill_key", "other_key").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sector", "skill_key").orderBy(F.desc("n"), "other_key")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def samples(skills: DataFrame, top: int = 5) -> DataFrame:
    """The newest postings of each sector and skill."""
    w = Window.partitionBy("sector", "skill_key").orderBy(F.desc("posted_date"), "posting_id")
    return skills.select("sector", "skill_key", "posting_id", "posted_date").distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def zeroed_sectors(before: DataFrame, now: DataFrame) -> DataFrame:
    """Sectors with demand in the window before and none now."""
    return before.select("sector").distinct().join(now.select("sector").distinct(), "sector", "left_anti")


def null_country_audit(posts: DataFrame, end: str, days: int) -> DataFrame:
    """Postings that only their missing country keeps out."""
    return posts.filter(aggregable() & F.col("country").isNull() & in_window(F.col("posted_date"), end, days)).agg(
        F.count("*").alias("n_postings"), F.countDistinct(F.when(F.col("salary") > 200000, F.col("posting_id"))).alias("n_high_salary")
    )
