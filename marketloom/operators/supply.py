"""Supply of courses per skill and per concept, against demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THIN_BELOW = 3


def by_skill(courses: DataFrame) -> DataFrame:
    """One row per skill: courses, providers, levels by count, five samples; in one pass over narrow partial sums."""
    levels = courses.groupBy("skill_key", F.coalesce("level", F.lit("unstated")).alias("level")).agg(F.count("*").alias("n"))
    levels = levels.groupBy("skill_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "level", "n"))).alias("levels"))
    levels = levels.withColumn("levels", F.transform("levels", lambda x: F.struct(x["level"].alias("level"), x["n"].alias("n"))))
    w = Window.partitionBy("skill_key").orderBy("course_id")
    some = courses.select("skill_key", "course_id", F.row_number().over(w).alias("r")).filter("r <= 5").groupBy("skill_key").agg(F.sort_array(F.collect_list("course_id")).alias("sample_courses"))
    total = courses.agg(F.count("*").alias("total_courses"))
    out = courses.groupBy("skill_key").agg(
        F.mode("name", True).alias("skill"), F.countDistinct("course_id").alias("course_count"), F.countDistinct("provider").alias("provider_count"),
        F.countDistinct(F.when(F.col("provider").isNull(), F.col("course_id"))).alias("courses_without_provider"),
    )
    return out.join(levels, "skill_key").join(some, "skill_key").crossJoin(F.broadcast(total)).withColumn("low_confidence", F.col("course_count") < THIN_BELOW)


def by_concept(courses: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per concept; a course with several phrasings of one counts once."""
    j = courses.join(mapping.filter("esco_code is not null"), "skill_key")
    return j.groupBy("esco_code").agg(
        F.mode("skill_key", True).alias("label"), F.countDistinct("course_id").alias("course_count"), F.countDistinct("provider").alias("provider_count"),
        F.sort_array(F.collect_set("skill_key")).alias("variant_keys"),
    )


def concept_demand(skills: DataFrame, mapping: DataFrame) -> DataFrame:
    return skills.join(mapping.filter("esco_code is not null"), "skill_key").groupBy("esco_code").agg(F.countDistinct("posting_id").alias("demand"))


def against_demand(demand: DataFrame, supply: DataFrame) -> DataFrame:
    """Demand with the supply of its concept, none where nothing teaches it."""
    zero = F.lit(0).cast("long")
    j = demand.join(supply, "esco_code", "left")
    n = F.coalesce("course_count", zero)
    return j.select("esco_code", "demand", n.alias("course_count"), F.coalesce("provider_count", zero).alias("provider_count"), (n == 0).alias("uncovered"))


def fanout(demand: DataFrame, keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """What joining concepts to skill-grain supply would do to the demand's total."""
    fanned = demand.join(mapping, "esco_code").join(keys, "skill_key")
    a = demand.agg(F.count("*").alias("concepts"), F.sum("demand").alias("demand"))
    return a.crossJoin(fanned.agg(F.count("*").alias("fanned_rows"), F.sum("demand").alias("fanned_demand")))


def clustered(posts: DataFrame) -> DataFrame:
    """Source posts with several postings, and whether some of them share a body."""
    g = posts.groupBy("source_post").agg(F.count("*").alias("children"), F.countDistinct("posted_date").alias("distinct_dates"), F.min("company").alias("company"), F.sort_array(F.collect_list("posting_id")).alias("posting_ids"))
    return g.filter("children > 1").withColumn("shares_body", F.col("distinct_dates") < F.col("children"))
