"""Which posting is whose duplicate, which row a new text belongs to, and what state a listing is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_destination(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(posting_id, final_url) with canonical_id: the stored canonical of the URL, else the least id of the batch; its own: null."""
    first = batch.filter("final_url is not null").groupBy(F.col("final_url").alias("f_url")).agg(F.min("posting_id").alias("f_id"))
    s = stored.groupBy(F.col("final_url").alias("s_url")).agg(F.min("posting_id").alias("s_id"))
    j = batch.join(first, F.col("final_url") == F.col("f_url"), "left").join(s, F.col("final_url") == F.col("s_url"), "left")
    return j.select("posting_id", "final_url", F.nullif(F.coalesce("s_id", "f_id"), F.col("posting_id")).alias("canonical_id"))


def by_link(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(posting_id, url, links, is_split, canonical_id) after the first outbound link's row, stored before batch, has taken over."""
    here = batch.groupBy(F.col("url").alias("b_url")).agg(F.min("posting_id").alias("b_id"))
    s = stored.groupBy(F.col("url").alias("s_url")).agg(F.min("posting_id").alias("s_id"))
    link = F.get("links", F.lit(0))
    j = batch.withColumn("link", link).join(s, F.col("link") == F.col("s_url"), "left").join(here, F.col("link") == F.col("b_url"), "left")
    to = F.nullif(F.coalesce("s_id", "b_id"), F.col("posting_id"))
    return j.select("posting_id", F.when(F.col("is_split"), F.col("canonical_id")).otherwise(F.coalesce(to, F.col("canonical_id"))).alias("canonical_id"))


def match_rows(new: DataFrame, old: DataFrame) -> DataFrame:
    """(row, title) with the old id of the same normalised title, if exactly one has it, and how it was found."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    o = old.groupBy(norm(F.col("title")).alias("o_title")).agg(F.count("*").alias("n"), F.min("id").alias("o_id"))
    j = new.join(o, norm(F.col("title")) == F.col("o_title"), "left")
    return j.select("row", F.when(F.col("n") == 1, F.col("o_id")).alias("id"), F.when(F.col("n").isNull(), "derived").when(F.col("n") == 1, "title").otherwise("ambiguous").alias("how"))


def insert_ignore(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key isn't stored, one per key."""
    return new.join(stored.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def destination_status(is_split: Column, link: Column, fetched: Column, jobs: Column, linked_back: Column) -> Column:
    return (
        F.when(is_split, "hub").when(link.isNull(), "no_link").when(~fetched, "unreachable").when(jobs != 1, "hub").when(linked_back, "source_is_destination").otherwise("resolved")
    )


def prunable(final_url: Column, status: Column) -> Column:
    return final_url.isNull() & status.isNotNull() & ~status.isin("resolved", "source_is_destination")


def routed(risk_band: Column, is_roundup: Column, flagged: Column) -> tuple[Column, Column]:
    """status and reason of a new posting."""
    status = F.when(risk_band == "reject", "rejected").when(risk_band == "adjudicate", "needs_review").when(is_roundup, "needs_review").when(flagged, "needs_review").otherwise("active")
    reason = F.when(risk_band == "reject", "risk").when(risk_band == "adjudicate", "adjudicate").when(is_roundup, "roundup").when(flagged, "near_duplicate")
    return status, reason


def adjudicated(risk: Column, verdict: Column, confidence: Column, quote_ok: Column) -> Column:
    """Risk after a second opinion, which counts only with a quote that stands in the text."""
    return F.when(~quote_ok | verdict.isNull(), risk).when(verdict == "scam", F.greatest(risk, confidence)).otherwise(F.least(risk, F.lit(0.35)))


def consumed(events: DataFrame, hours: int) -> DataFrame:
    """Single-use tokens replayed: of each token's attempts the first before its expiry succeeds, no other."""
    from pyspark.sql import Window

    w = Window.partitionBy("token")
    ok = F.col("ts") < F.min("ts").over(w) + F.make_dt_interval(hours=F.lit(hours))
    e = events.withColumn("in_time", ok & (F.col("ts") > F.min("ts").over(w)))
    first = F.row_number().over(Window.partitionBy("token", "in_time").orderBy("ts", "event_id")) == 1
    return e.withColumn("accepted", F.col("in_time") & first)


def sync_chunks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """doc, ordinal, action of each chunk: embed (new or changed), keep, delete."""
    n = new.select(F.col("doc").alias("n_doc"), F.col("ordinal").alias("n_ordinal"), F.col("digest").alias("n_digest"))
    j = n.join(stored, (F.col("n_doc") == F.col("doc")) & (F.col("n_ordinal") == F.col("ordinal")), "full")
    action = F.when(F.col("n_doc").isNull(), "delete").when(F.col("digest") == F.col("n_digest"), "keep").otherwise("embed")
    return j.select(F.coalesce("n_doc", "doc").alias("doc"), F.coalesce("n_ordinal", "ordinal").alias("ordinal"), action.alias("action"))


def fenced(verdicts: DataFrame, requested: DataFrame, held: DataFrame) -> DataFrame:
    """Outside verdicts that may stand: of a requested skill that is missing, citing a held skill that isn't weak."""
    ok = held.filter("not weak").select("user_id", F.col("held_key").alias("cited")).distinct()
    return verdicts.join(requested.filter("verdict = 'missing'").select("user_id", "skill_key").distinct(), ["user_id", "skill_key"], "left_semi").join(ok, ["user_id", "cited"], "left_semi")


def reconciled(claims: DataFrame, judged: DataFrame) -> DataFrame:
    """Claims with the first judgement of each; unknown names drop, unjudged claims stay at the lowest grade."""
    from .lifecycle import keep_first

    first = keep_first(judged, ["name"], [F.col("n")]).select(F.col("name").alias("j_name"), "grade")
    return claims.join(first, F.col("name") == F.col("j_name"), "left").select("name", F.coalesce("grade", F.lit("claim_only")).alias("grade"))
