"""Courses for missing skills: ranking with nulls last, thirds of priority, greedy weighted cover."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import shrunk_rating


def ranked(courses: DataFrame, prefer_free: bool = False) -> DataFrame:
    """All courses by shrunk rating, enrolment, reviews, price; nulls last in each, the id last of all.

    Ranks come from a range-sorted prefix count rather than one ordered partition.
    """
    mean = courses.agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("mean_rating"))
    c = courses.crossJoin(F.broadcast(mean)).withColumn("shrunk", F.round(shrunk_rating(F.col("rating"), F.col("review_count"), F.col("mean_rating")), 6))
    free = [F.when(F.col("price") == 0, 0).when(F.col("price").isNull(), 1).otherwise(2)] if prefer_free else []
    return rank_all(c, [*free, F.col("shrunk").desc_nulls_last(), F.col("enrollment_count").desc_nulls_last(), F.col("review_count").desc_nulls_last(), F.col("price").asc_nulls_last(), F.col("course_id").asc()])


def rank_all(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with ``rank`` in a total order, without a window over one partition."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    from ..functions.lineage import checkpointed

    s = checkpointed(s)
    before = s.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_p").alias("_q"), "_before")
    j = s.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return j.withColumn("rank", F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_q", "_i", "_before")


def thirds(df: DataFrame, value: str) -> DataFrame:
    """df with ``bucket``: high, moderate or low third of the span; no span: moderate."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    b = F.when(F.col("_hi") == F.col("_lo"), "moderate").when(share >= 2 / 3, "high").when(share >= 1 / 3, "moderate").otherwise("low")
    return df.crossJoin(F.broadcast(span)).withColumn("bucket", b).drop("_lo", "_hi")


def candidates(missing: DataFrame, courses: DataFrame, mapping: DataFrame, cap: int | None = None) -> DataFrame:
    """Courses that teach a missing skill: by concept where it has one, else by key; all of them, or the first ``cap`` ids of each skill."""
    c = courses.join(mapping, "skill_key", "left")
    code = missing.filter("esco_code is not null").join(c.filter("esco_code is not null").select("esco_code", "course_id"), "esco_code")
    key = missing.filter("esco_code is null").join(c.select("skill_key", "course_id"), "skill_key")
    both = code.select("user_id", "skill_key", "priority", "course_id").unionByName(key.select("user_id", "skill_key", "priority", "course_id"))
    if cap is None:
        return both.distinct()
    w = Window.partitionBy("user_id", "skill_key").orderBy("course_id")
    return both.distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def cover_candidates(missing: DataFrame, courses: DataFrame, mapping: DataFrame, quality: DataFrame, cap: int | None = None) -> DataFrame:
    """What ``greedy_cover`` can choose of ``candidates``, for a mapping with one concept a key at most.

    A skill's courses (the first ``cap``, if given) depend on its concept or key alone, so they are found once for all
    users. Of the courses that are candidates for the same concepts and keys only the best in rank can be chosen: the
    others teach any user the same skills, and nothing new after it.
    """
    own = lambda: F.when(F.col("esco_code").isNotNull(), F.struct(F.lit(True).alias("code"), F.col("esco_code").alias("of"))).otherwise(F.struct(F.lit(False).alias("code"), F.col("skill_key").alias("of")))
    groups = missing.select(own().alias("g")).distinct()
    c = courses.join(mapping, "skill_key", "left")
    code = c.filter("esco_code is not null").select(F.struct(F.lit(True).alias("code"), F.col("esco_code").alias("of")).alias("g"), "course_id")
    key = c.filter("skill_key is not null").select(F.struct(F.lit(False).alias("code"), F.col("skill_key").alias("of")).alias("g"), "course_id")
    taught = code.unionByName(key).join(groups, "g", "left_semi").distinct()
    if cap is not None:
        taught = taught.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("course_id"))).filter(F.col("n") <= cap)
    alike = taught.groupBy("course_id").agg(F.sort_array(F.collect_list("g")).alias("gs")).join(quality.select("course_id", "rank"), "course_id")
    best = alike.groupBy("gs").agg(F.min_by("course_id", F.struct("rank", "course_id")).alias("course_id"))
    return missing.withColumn("g", own()).join(best.select(F.explode("gs").alias("g"), "course_id"), "g").select("user_id", "skill_key", "priority", "course_id")


def greedy_cover(pairs: DataFrame, quality: DataFrame) -> DataFrame:
    """(user_id, skill_key, priority, course_id) to the chosen courses in order.

    Each step takes the course with the largest count x sum of priorities over skills not yet covered, ties by
    quality rank. Steps depend on one another within a user.
    """

    def cover(user: int, rows: list[dict]) -> list[tuple]:
        left = {r["skill_key"]: r["priority"] for r in rows}
        rank = {r["course_id"]: r["rank"] for r in rows}
        teaches: dict[int, set[str]] = {}
        for r in rows:
            teaches.setdefault(r["course_id"], set()).add(r["skill_key"])
        out = []
        while left and teaches:
            value = lambda c: len(teaches[c] & left.keys()) * sum(left[s] for s in sorted(teaches[c] & left.keys()))
            best = min(sorted(teaches), key=lambda c: (-round(value(c), 9), rank[c]))
            got = teaches.pop(best) & left.keys()
            if not got:
                break
            primary = min(got, key=lambda s: (-left[s], s))
            out.append((user, len(out) + 1, best, primary, ",".join(sorted(got - {primary}))))
            for s in got:
                del left[s]
        return out

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"user_id": pa.int64(), "step": pa.int32(), "course_id": pa.int64(), "primary_skill": pa.string(), "other_skills": pa.string()}
        for batch in batches:
            out = [x for user, rows in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) for x in cover(user, rows)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds.values())], list(kinds))

    j = pairs.join(quality.select("course_id", "rank"), "course_id").select(F.col("user_id").cast("long").alias("user_id"), "skill_key", "priority", F.col("course_id").cast("long").alias("course_id"), "rank")
    lists = j.groupBy("user_id").agg(F.collect_list(F.struct("skill_key", "priority", "course_id", "rank")).alias("rows"))
    return lists.mapInArrow(covers, "user_id long, step int, course_id long, primary_skill string, other_skills string")
