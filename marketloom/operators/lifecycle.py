"""Incremental maintenance of tables: change detection, upserts by column policy, ageing, retention, health, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\u001f"
STALE_AFTER, DEGRADED_AFTER = 3, 3


def content_id(*parts: Column, length: int = 32) -> Column:
    """Hexadecimal id of stripped parts."""
    return F.left(F.sha2(F.concat_ws(SEPARATOR, *[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), 256), F.lit(length))


def detect_changes(batch: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """batch with ``change``: new, changed or unchanged against the stored digests."""
    old = stored.select(F.col(key).alias("o_key"), F.col(digest).alias("o_digest"))
    change = F.when(F.col("o_key").isNull(), "new").when(F.col(digest) == F.col("o_digest"), "unchanged").otherwise("changed")
    return batch.join(old, F.col(key) == F.col("o_key"), "left").withColumn("change", change).drop("o_key", "o_digest")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order, unlike dropDuplicates, which promises none."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], fill: list[str], preserve: list[str], reset: dict[str, Column] | None = None) -> DataFrame:
    """A snapshot after an upsert: ``overwrite`` columns take the new value, ``fill`` only one that isn't null, ``preserve`` keep the old."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    j = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full")
    fresh = F.col(f"n_{key}").isNotNull()
    out = [F.coalesce(f"n_{key}", f"o_{key}").alias(key)]
    out += [F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in overwrite]
    out += [F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in fill]
    out += [F.coalesce(f"o_{c}", f"n_{c}").alias(c) for c in preserve]
    out += [F.when(fresh, v).otherwise(F.col(f"o_{c}")).alias(c) for c, v in (reset or {}).items()]
    return j.select(*out)


def upsert_observed(old: DataFrame, new: DataFrame, key: str, columns: list[str], flag: str) -> DataFrame:
    """Volatile columns change only where they were observed; an observed null overwrites."""
    n = new.select(F.col(key).alias("n_key"), F.col(flag).alias("n_flag"), *[F.col(c).alias(f"n_{c}") for c in columns])
    seen = F.coalesce("n_flag", F.lit(False))
    return old.join(n, F.col(key) == F.col("n_key"), "left").select(key, *[F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def age_and_touch(rows: DataFrame, seen: DataFrame, censused: DataFrame, today: Column) -> DataFrame:
    """One cycle: rows of censused sources miss it unless seen; seen rows come back; three misses make a row stale."""
    s = seen.select(F.col("posting_id").alias("s_id")).distinct()
    c = censused.select(F.col("source").alias("c_source")).distinct()
    j = rows.join(s, F.col("posting_id") == F.col("s_id"), "left").join(F.broadcast(c), F.col("source") == F.col("c_source"), "left")
    is_seen, aged = F.col("s_id").isNotNull(), F.col("c_source").isNotNull() & (F.col("status") == "active")
    missed = F.when(is_seen, 0).when(aged, F.col("missed_cycles") + 1).otherwise(F.col("missed_cycles"))
    j = j.withColumn("missed_cycles", missed)
    stale = ~is_seen & (F.col("status") == "active") & (F.col("missed_cycles") >= STALE_AFTER)
    return j.select(
        "posting_id", "source", F.when(is_seen & (F.col("status") == "stale"), "active").when(stale, "stale").otherwise(F.col("status")).alias("status"),
        "missed_cycles", F.when(is_seen, None).when(stale, F.coalesce("stale_since", today)).otherwise(F.col("stale_since")).alias("stale_since"), "duplicate_of",
    )


def prune(rows: DataFrame, today: Column, days: int = 60) -> DataFrame:
    """Without rows stale for longer than ``days``; a duplicate whose canonical row goes is canonical again."""
    gone = (F.col("status") == "stale") & F.col("stale_since").isNotNull() & (F.datediff(today, F.col("stale_since")) > days)
    kept = rows.filter(~gone)
    ids = kept.select(F.col("posting_id").alias("k_id"))
    j = kept.join(ids, F.col("duplicate_of") == F.col("k_id"), "left")
    return j.select(*[c for c in rows.columns if c != "duplicate_of"], F.when(F.col("k_id").isNotNull(), F.col("duplicate_of")).alias("duplicate_of"))


def keep_windows(stats: DataFrame, n: int) -> DataFrame:
    """Rows of the newest n distinct windows; n is 2 at least, for trends need the one before."""
    newest = stats.select("window_end").distinct().orderBy(F.desc("window_end")).limit(max(2, n)).agg(F.min("window_end").alias("oldest"))
    return stats.crossJoin(F.broadcast(newest)).filter("window_end >= oldest").drop("oldest")


def source_health(attempts: DataFrame) -> DataFrame:
    """Fold of (source, ts, ok, error): failures since the last success, times, degraded since the third failure in a row."""
    w = Window.partitionBy("source").orderBy("ts", "event_id")
    a = attempts.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    run = Window.partitionBy("source", "island").orderBy("ts", "event_id")
    a = a.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(run))
    last = F.max(F.struct("ts", "event_id", "failures", "island"))
    out = a.groupBy("source").agg(
        last.alias("last"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success_at"), F.max("ts").alias("last_attempt_at"), F.count("*").alias("total_cycles"),
        F.max(F.when(F.col("failures") == DEGRADED_AFTER, F.struct("island", "ts"))).alias("third"),
    )
    degraded = F.when((F.col("last.failures") >= DEGRADED_AFTER) & (F.col("third.island") == F.col("last.island")), F.col("third.ts"))
    return out.select("source", F.col("last.failures").alias("consecutive_failures"), "last_success_at", "last_attempt_at", degraded.alias("degraded_since"), "total_cycles")


def claims(events: DataFrame, period: Column, limit: int) -> DataFrame:
    """Replay of a quota: the first ``limit`` events of a user, kind and period are granted."""
    e = events.withColumn("period_start", period)
    w = Window.partitionBy("user_id", "kind", "period_start").orderBy("ts", "event_id")
    e = e.withColumn("granted", F.row_number().over(w) <= limit)
    return e.groupBy("user_id", "kind", "period_start").agg(F.sum(F.col("granted").cast("long")).alias("used"), F.sum((~F.col("granted")).cast("long")).alias("refused"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row that comes first in ``order`` for each key (DISTINCT ON)."""
    return keep_first(df, key, order)


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, in ascending order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
