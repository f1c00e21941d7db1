"""Benchmark decontamination by winnowing.

A fingerprint of a text is the least hash of its k-word grams in every run of w consecutive grams, so two texts
that share a span of w + k - 1 words share a fingerprint. For the benchmark's windows of ``span`` words k is 5
and w is span - 4; items shorter than a window are a window of their own, with k and w set for their length in
the same way. Documents join the benchmark on fingerprints; each hit is extended to the whole windows around it,
which are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let, over_runs, table, unused

SPAN = 13
GRAM = 5
#: The benchmark's fingerprints are broadcast up to this many (12 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 500_000
WORD_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bench_words(text: Column) -> Column:
    """array<string>: runs of a-z, 0-9 and all beyond ASCII, A-Z lower-cased; null: no words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def folded_words(text: Column) -> Column:
    """As bench_words, in Unicode's lower case: equal words stay equal, and the rest is settled by comparing windows."""
    return F.array_remove(F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(words: Column, k: int, length: int) -> Column:
    """array<bigint> of one hash for each run of k words."""
    return over_runs(words, k, lambda x: F.xxhash64(x, F.lit(length)))


def sliding_min(x: Column, w: int) -> Column:
    """Least value of each run of w."""
    return x if w == 1 else over_runs(x, w, F.array_min)


def seeds_of(words: Column, length: int) -> Column:
    """array<bigint>: the distinct fingerprints that any shared span of ``length`` words must have in common."""
    k = min(GRAM, length)
    got = let(gram_hashes(words, k, length), lambda g: F.array_distinct(sliding_min(g, length - k + 1)))
    return F.when(F.size(words) < length, F.array().cast("array<bigint>")).otherwise(got)


def windows_at(words: Column, folded: Column, seeds: Column, length: int) -> Column:
    """array<struct<start,len,win>>: the windows of ``length`` words that hold a gram whose hash is among seeds."""
    k = min(GRAM, length)

    def starts(g: Column, found: Column, n: Column) -> Column:
        at = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(found, x), i)), lambda i: i.isNotNull())
        around = F.transform(at, lambda i: F.sequence(F.greatest(F.lit(0), i - (length - k)), F.least(i, n - length)))
        return F.array_distinct(F.flatten(F.filter(around, lambda x: F.size(x) > 0)))

    def body(w: Column) -> Column:
        n = F.size(w)
        s = let(gram_hashes(folded, k, length), lambda g: starts(g, seeds, n))
        return F.transform(s, lambda i: F.struct(i.alias("start"), F.lit(length).alias("len"), F.array_join(F.slice(w, i + 1, F.lit(length)), " ").alias("win")))

    return F.when(F.size(words) < length, F.array().cast("array<struct<start:int,len:int,win:string>>")).otherwise(let(words, body))


def contamination(docs: DataFrame, bench: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, text_key (hash of the text), n_words, n_hit, items (sorted array of item ids as strings), spans (hit intervals as start, end).

    Null or empty text: no words, no hits. Null item text or an item without words: no windows. Repeated rows
    each get the same answer. An empty benchmark: no hits. Extra columns of both tables are not looked at.
    """
    b = bench.select("item_id", bench_words(F.col("text")).alias("w"), folded_words(F.col("text")).alias("f")).filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(span)))
    lengths = sorted(r[0] for r in b.select("len").distinct().collect())  # span values at most
    d = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "text")
    base = d.select("doc_id", "text_key", F.coalesce(F.regexp_count("text", F.lit(WORD_RUN)), F.lit(0)).cast("long").alias("n_words"))
    if not lengths:
        none = F.array().cast("array<string>")
        return base.withColumns({"n_hit": F.lit(0).cast("long"), "items": none, "spans": F.array().cast("array<struct<start:int,end:int>>")})
    per_length = F.lit(None).cast("array<bigint>")
    for x in lengths:
        per_length = F.when(F.col("len") == x, seeds_of(F.col("f"), x)).otherwise(per_length)
    b_seeds = cut(b.select(F.explode(per_length).alias("seed")).distinct())
    small = b_seeds.count() <= BROADCAST_ROWS
    seeds = let(folded_words(F.col("text")), lambda w: F.flatten(F.array(*[seeds_of(w, x) for x in lengths])))
    found = d.select("doc_id", "text_key", F.explode(seeds).alias("seed")).join(F.broadcast(b_seeds) if small else b_seeds, "seed", "left_semi")
    # One row for each text that shares a fingerprint, however many documents or rows hold it.
    found = found.groupBy("text_key").agg(F.collect_set("seed").alias("seeds"), F.min("doc_id").alias("one_id")).withColumnRenamed("text_key", "one_key")
    one = (F.col("text_key") == F.col("one_key")) & F.col("doc_id").eqNullSafe(F.col("one_id"))
    texts = d.join(found, one).select("text_key", "text", "seeds").dropDuplicates(["text_key"]).withColumns({"w": bench_words(F.col("text")), "f": folded_words(F.col("text"))})
    around = F.flatten(F.array(*[windows_at(F.col("w"), F.col("f"), F.col("seeds"), x) for x in lengths]))
    near = texts.select("text_key", F.inline(around))
    at = F.sequence(F.lit(0), F.size("w") - F.col("len"))
    b_windows = b.select("item_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, F.col("len")), " ")))).alias("win"))
    hits = cut(near.join(b_windows.select("win").distinct(), "win", "left_semi"))
    items = hits.select("text_key", "win").distinct().join(b_windows, "win").select("text_key", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("text_key").agg(F.sort_array(F.collect_list("item")).alias("items"))

    # Intervals that begin where none before reaches: a running maximum of ends marks them.
    w = Window.partitionBy("text_key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    ivs = hits.select("text_key", "start", "len").distinct().withColumn("reach", F.max(F.col("start") + F.col("len")).over(w))
    new = F.coalesce(F.col("start") > F.col("reach"), F.lit(True))
    ivs = ivs.withColumn("run", F.sum(new.cast("int")).over(Window.partitionBy("text_key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, 0)))
    spans = ivs.groupBy("text_key", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"))
    spans = spans.groupBy("text_key").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # Cut, so that Spark can split a hot text's rows in the join.
    out = base.join(cut(spans.join(items, "text_key")), "text_key", "left")
    return out.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the benchmark doesn't contaminate.

    Rows go by their doc_id and text; repeated rows go or stay together. Null and empty texts stay. Null doc_id: by
    the text. Empty table or benchmark: nothing goes. Extra columns stay, whatever their names.
    """
    i, k = unused(docs, "bad_id", "bad_key")
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).filter(is_contaminated()).select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(i)) & (key == F.col(k)), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
