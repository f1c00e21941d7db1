"""What a cycle does around its records: dates stated in words, essences, loading, counters, taxonomy sync, migrations, gaps, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The months' first letters in order, three each.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NAMES = "|".join(MONTHS[i : i + 3] for i in range(0, len(MONTHS), 3))
MAX_ASKED, LOW_OCR = 8, 0.60


def stated_date(raw: Column) -> Column:
    """YYYY-MM where digits or a month's name state it, else the latest year, else null: nothing is made up."""
    iso, named = r"\b(20\d{2})[-/](0[1-9]|1[0-2])\b", rf"(?i)\b({NAMES})[a-z]*\.?\s*,?\s*(20\d{{2}})\b"
    month = F.lpad(((F.instr(F.lit(MONTHS), F.lower(F.regexp_extract(raw, named, 1))) + 2) / 3).cast("int").cast("string"), 2, "0")
    by_name = F.concat_ws("-", F.regexp_extract(raw, named, 2), month)
    years = F.array_max(F.regexp_extract_all(raw, F.lit(r"\b(20\d{2})\b"), F.lit(1)))
    return F.when(F.regexp_like(raw, F.lit(iso)), F.concat_ws("-", F.regexp_extract(raw, iso, 1), F.regexp_extract(raw, iso, 2))).when(F.regexp_like(raw, F.lit(named)), by_name).otherwise(years)


def wanted_title(headline: Column, role: Column, roles_only: Column) -> Column:
    """The title to search with: a wanted role replaces the headline where no other will do, and joins it elsewhere."""
    head, want = F.trim(F.coalesce(headline, F.lit(""))), F.trim(F.coalesce(role, F.lit("")))
    return F.when(want == "", head).when(F.coalesce(roles_only, F.lit(False)) | (head == ""), want).otherwise(F.concat_ws(" / ", head, want))


def wanted_essence(title: Column, location: Column, arrangement: Column, skills: Column) -> Column:
    """Lines of what is known; the arrangement only leans the search, it filters nothing."""
    place, way = F.trim(F.coalesce(location, F.lit(""))), F.trim(F.coalesce(arrangement, F.lit("")))
    known = F.when(F.size(skills) > 0, F.concat(F.lit("skills: "), F.array_join(skills, ", ")))
    lines = F.array(F.nullif(title, F.lit("")), F.nullif(place, F.lit("")), F.when(way != "", F.concat(F.lit("preferred work arrangement: "), way)), known)
    return F.array_join(lines, "\n")


def loaded_missing(details: DataFrame, plain: DataFrame, owner: str) -> DataFrame:
    """Per owner the missing skills in lower case, the first of equals: from ``details`` (owner, position, skill, esco_code,
    priority_score) where the owner has any, else from ``plain`` (owner, position, skill) with priority 1 and no code."""
    bare = plain.join(details.select(owner).distinct(), owner, "left_anti").select(owner, "position", "skill", F.lit(None).cast("string").alias("esco_code"), F.lit(1.0).alias("priority_score"), F.lit(True).alias("fallback"))
    rich = details.select(owner, "position", "skill", F.col("esco_code").cast("string"), F.coalesce(F.col("priority_score").cast("double"), F.lit(0.0)).alias("priority_score"), F.lit(False).alias("fallback"))
    rows = rich.unionByName(bare).withColumn("skill", F.lower(F.trim("skill"))).filter("skill <> ''")
    first = rows.groupBy(owner, "skill").agg(F.min_by(F.struct("esco_code", "priority_score", "fallback"), "position").alias("x"))
    return first.select(owner, "skill", "x.*")


def merged_counters(batches: DataFrame, run: str, counters: list[str]) -> DataFrame:
    """Counters of a run: the sums over its batches, a counter that a batch lacks counting 0."""
    return batches.groupBy(run).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])


def synced_concepts(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Concepts after a sync: what comes in replaces what is stored under its key, the last of equals by ``ordinal``; the rest stays."""
    cols = [c for c in stored.columns if c not in (key, "taxonomy_version")]
    old = stored.select(key, F.lit(-1).cast("long").alias("ordinal"), F.struct(*cols, "taxonomy_version").alias("x"))
    new = incoming.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.struct(*cols, F.lit(version).alias("taxonomy_version")).alias("x"))
    return old.unionAll(new).groupBy(key).agg(F.max_by("x", "ordinal").alias("x")).select(key, "x.*")


def embedding_queue(labels: DataFrame, n: int) -> DataFrame:
    """The next labels without a vector: a sync that was interrupted goes on from there."""
    return labels.filter("embedding IS NULL").orderBy("label_key", "esco_uri").limit(n)


def embedded(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Live rows that duplicate no other, each with its vector; a row without one is an error, not a gap."""
    live = rows.filter((F.col("status") == "active") & F.col("duplicate_of").isNull())
    got = live.join(vectors, key, "left")
    return got.withColumn("vector", F.coalesce("vector", F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string"))).cast("array<double>")))


def migration_plan(files: DataFrame, applied: DataFrame) -> DataFrame:
    """What each file (name, body) means to a database with ``applied`` (version, checksum): bad_name, duplicate, drifted, applied or pending."""
    v = F.regexp_extract("name", r"^([0-9]+)_.+\.sql$", 1)
    f = files.select("name", F.nullif(v, F.lit("")).alias("version"), F.sha2("body", 256).alias("own"))
    # Counted before it is joined, so that no version's files meet in one window.
    many = f.filter("version is not null").groupBy("version").agg(F.count("*").alias("n"))
    a = applied.select("version", F.col("checksum").alias("was"))
    state = F.when(F.col("version").isNull(), "bad_name").when(F.col("n") > 1, "duplicate").when(F.col("was").isNull(), "pending").when(F.col("was") != F.col("own"), "drifted").otherwise("applied")
    return f.join(many, "version", "left").join(a, "version", "left").select("name", "version", state.alias("state"))


def gap_list(fields: DataFrame, owner: str) -> DataFrame:
    """Fields to ask for: required ones that are blank, then optional ones, then those that rest on weak OCR.

    ``fields``: owner, path, position, kind (required, optional, other), value, dropped, grounded, confidence, supplied.
    What a person supplied is not asked again. All gaps are kept; ``asked`` are the first MAX_ASKED of an owner.
    """
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    weak = ~blank & F.col("grounded") & (F.col("confidence") < LOW_OCR)
    rank = F.when(blank & (F.col("kind") == "required"), 0).when(blank & (F.col("kind") == "optional"), 1).when(weak, 2)
    reason = F.when(F.col("rank") == 2, "low_confidence").when(F.col("dropped"), "not_verified").otherwise("not_found")
    g = fields.filter(~F.col("supplied")).withColumn("rank", rank).filter("rank is not null")
    place = F.row_number().over(Window.partitionBy(owner).orderBy("rank", "position", "path"))
    return g.select(owner, "path", reason.alias("reason"), place.alias("place")).withColumn("asked", F.col("place") <= MAX_ASKED)


def collected_status(spark: SparkSession, reports: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(report, status, n) of each report, a short list of counts; one that fails says unavailable and leaves the others alone."""
    rows: list[tuple] = []
    for name, report in reports.items():
        try:
            rows += [(name, r.status, r.n) for r in report().select("status", "n").collect()]  # counts by status: a few rows
        except PySparkException:
            rows.append((name, "unavailable", None))
    return spark.createDataFrame(rows, "report string, status string, n long")


def over_retention(windows: Column, keep: int) -> Column:
    """Pruning comes before the new snapshot, so one window more than is kept is as it should be."""
    return F.coalesce(windows, F.lit(0)) > keep + 1


def checkpoints(nodes: DataFrame, run: str, low: float, high: float) -> DataFrame:
    """Progress after each node (run, position, node, weight, skipped) within low to high; nodes that will not run take no part of it."""
    w = Window.partitionBy(run)
    upto, total = F.sum("weight").over(w.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)), F.sum("weight").over(w)
    share = F.when(total > 0, upto / total).otherwise(F.lit(0.0))
    return nodes.filter(~F.col("skipped")).select(run, "node", F.round(low + (high - low) * share, 4).alias("progress"))


def suggested_role(matches: DataFrame, owner: str) -> DataFrame:
    """Per owner the best of the matches (owner, match_id, title, score, why) that have a score and say why; the lower id of equals."""
    ok = matches.filter(F.col("score").isNotNull() & (F.trim(F.coalesce("why", F.lit(""))) != ""))
    best = F.max(F.struct("score", (-F.col("match_id")).alias("m"), "title", "why"))
    return ok.groupBy(owner).agg(best.alias("b")).select(owner, F.col("b.title").alias("title"), F.col("b.score").alias("score"), F.col("b.why").alias("why"))


def judged_method(method: Column, judged: Column, quote_found: Column, supplied: Column) -> Column:
    """How a field ends: what people supplied and what is grounded stays; in between a judge must say so and quote what is there."""
    sure = F.coalesce(judged, F.lit(False)) & F.coalesce(quote_found, F.lit(False))
    return F.when(F.coalesce(supplied, F.lit(False)), "human").when(method == "grounded", "grounded").when((method == "adjudicate") & sure, "adjudicated").otherwise("dropped")
