"""Mixing sources to target weights by hash-random keys, distributed prefix sums and an exact cut.

Every document has a random but reproducible key (MD5 of seed and id). Within a source the key order is split
into ranges by key prefix; sizes are summed per range, prefix sums run over the ranges, and only the one range
that holds the budget's end is sorted. What leaves is one cut key per source, so the documents themselves are
never shuffled: a map-side comparison of key and cut decides how often each is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table, unused

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows that one key range should hold at most, about.
RANGE_ROWS = 20_000
#: Sources whose budgets and cuts are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weighted shares that stop at ``max_epochs`` sizes.

    Sources in code-point order, null last, take the weights in turn. In ascending order of cap/weight the full
    sources are a prefix, so one ordered pass finds the level at which the rest share what is left. It has one
    row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = totals.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.withColumns({"all_size": F.sum("source_size").over(everything) * F.lit(share), "all_w": F.sum("w").over(everything)})
    t = t.withColumns({"cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(order), F.lit(0))})
    level = (F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    t = t.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def cuts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """One row per source: source, source_size, target, epochs (whole passes), cut_key (the next pass takes smaller keys; null: all)."""
    narrow = cut(docs.select("source", key_of(seed).alias("key"), size_of(F.col("text")).alias("size")))
    most = narrow.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = 1
    while digits < 12 and most / 16**digits > RANGE_ROWS:
        digits += 1
    narrow = narrow.withColumn("range", F.substring("key", 1, digits))
    ranges = narrow.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = cut(goal)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    g = per_source(goal.select(F.col("source").alias("g_source"), "rest"))
    # The first range whose end reaches the budget; its rows alone are sorted.
    ends = (
        ranges.join(g, F.col("source").eqNullSafe(F.col("g_source")))
        .filter((F.col("range_before") <= F.col("rest")) & (F.col("range_before") + F.col("range_size") >= F.col("rest")))
        .select(F.col("source").alias("e_source"), F.col("range").alias("e_range"), "range_before", "rest")
    )
    ends = per_source(ends)
    inside = narrow.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range")))
    inside = inside.groupBy("source", "range", "key", "range_before", "rest").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("range_before") + F.sum("size").over(upto) - F.col("size") / 2
    found = inside.withColumn("over", middle >= F.col("rest")).filter("over").groupBy(F.col("source").alias("f_source")).agg(F.min("key").alias("found_key"))
    # A budget that ends past the middle of its range's last document is cut before the next range.
    last = ends.groupBy(F.col("e_source").alias("l_source")).agg(F.max("e_range").alias("last_range"))
    out = goal.join(found, F.col("source").eqNullSafe(F.col("f_source")), "left").join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    after = F.concat("last_range", F.lit("g"))  # sorts after every hexadecimal key of the range
    return out.select("source", "source_size", "target", "epochs", F.coalesce("found_key", after).alias("cut_key"))


def per_source(few: DataFrame) -> DataFrame:
    """A table of one row per source, marked for broadcast if it is small; beyond that Spark deals it as it sees fit."""
    few = cut(few)
    return F.broadcast(few) if few.count() <= BROADCAST_SOURCES else few


def measured(docs: DataFrame, names: list[str], weights: tuple[int, ...], max_epochs: int, share: float, seed: str) -> DataFrame:
    """``docs`` with four more columns of these names: size, source_size, target, copies."""
    size, source_size, target, copies = names
    key, source, epochs, end = unused(docs, "mixing_key", "mixing_source", "mixing_epochs", "mixing_cut")
    c = cuts(docs, weights, max_epochs, share, seed)
    c = per_source(c.withColumnsRenamed({"source": source, "source_size": source_size, "target": target, "epochs": epochs, "cut_key": end}))
    d = docs.withColumns({key: key_of(seed), size: size_of(F.col("text"))}).join(c, F.col("source").eqNullSafe(F.col(source)), "left")
    again = F.coalesce(F.col(key) < F.col(end), F.lit(False)) & (F.col(epochs) < max_epochs)
    return d.withColumn(copies, F.col(epochs) + F.when(again, 1).otherwise(0)).drop(key, source, epochs, end)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_copies: how often the mix takes each document.

    Whole documents are taken; the one over whose middle the budget's end falls decides which side it belongs to,
    so a source misses its target by half a document at most. Null text: size 0. Null source: a source of its
    own, last. Rows with the same doc_id and text have the same key and stand or fall together. Empty table: no
    rows. Extra columns stay as they are; only the four names above are taken, from columns that had them.
    """
    names = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    return measured(docs, names, weights, max_epochs, share, seed)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with the columns of documents.

    Nulls, ties, repeated rows and empty tables as in ``mix``; extra columns stay, whatever their names.
    """
    names = unused(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_nth")
    taken = measured(docs, names[:4], WEIGHTS, MAX_EPOCHS, 1.0, SEED).filter(F.col(names[3]) > 0)
    return taken.withColumn(names[4], F.explode(F.array_repeat(F.lit(1), F.col(names[3]).cast("int")))).select(*[f"`{c}`" for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source) AS rn,
        CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(w) OVER () AS BIGINT) AS all_w FROM w),
p AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
        CAST(coalesce(sum(w) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_before FROM o),
l AS (SELECT *, CAST(all_size - cap_before AS DOUBLE) / CAST(all_w - w_before AS DOUBLE) AS lev FROM p),
f AS (SELECT lev FROM l WHERE lev * w <= cap ORDER BY rn LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT lev FROM f) * w, CAST(cap AS DOUBLE))) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
k AS (SELECT source, key, sum(size) AS key_size FROM d GROUP BY source, key),
c AS (SELECT source, key, sum(key_size) OVER (PARTITION BY source ORDER BY key) - key_size / 2 AS middle FROM k)
SELECT d.doc_id, d.size, e.source_size, e.target,
       CAST(d.size * (e.epochs + CASE WHEN c.middle < e.target - e.epochs * e.source_size AND e.epochs < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.key = d.key
"""
