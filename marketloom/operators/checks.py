"""Constraints that a database would hold: violations as rows, counted per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: rows that break each rule; null counts as keeping it, as in SQL's CHECK. One pass."""
    counts = df.agg(*[F.sum((~F.coalesce(c, F.lit(True))).cast("long")).alias(r) for r, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"`{r}`"), F.lit(0).cast("long")).alias("n")) for r in rules])
    return counts.select(F.inline(pairs))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def total(counts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, counts)
