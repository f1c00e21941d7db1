"""Line-first cleaning: judge every line, drop the failing ones, then reject documents that lost too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, over_runs, table, words_of

#: Fixed values. Lines that hold one of these are boilerplate, whatever else they say.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled", "privacy policy",
    "terms of service", "terms of use", "lorem ipsum", "sign up for our newsletter", "click here to",
)
#: Marks that end a sentence.
ENDINGS = r"[.!?:;…。！？\"'”’»)\]]\s*$"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"\p{Lu}{2,}+"
#: A line fails if it has more symbols a word than this,
MAX_SYMBOLS = 0.3
#: or, from so many words on, more runs of capitals a word than this,
MIN_CAPS_WORDS, MAX_CAPS = 4, 0.5
#: or if it is a short line without a sentence's end (navigation).
MAX_NAV_WORDS = 4
#: A document that loses more than this share of its words is rejected.
MAX_LOST = 0.3


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n words breaks a rule of punctuation, navigation or boilerplate."""
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > MAX_SYMBOLS * n
    shouted = (n >= MIN_CAPS_WORDS) & (F.regexp_count(line, F.lit(CAPITALS)) > MAX_CAPS * n)
    navigation = (n <= MAX_NAV_WORDS) & ~line.rlike(ENDINGS)
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | low.contains(phrase)
    return symbols | shouted | navigation | boiler


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more, the first occurrence included.

    Windows are told apart by 64-bit hashes; two different ones of a text meet with a chance below 1e-9 even in
    texts of 100,000 words.
    """

    def covered(tri: Column) -> Column:
        pairs = F.sort_array(F.transform(tri, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

        def twice(s: Column) -> Column:
            near = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.when(x["t"] == y["t"], F.array(x["i"], y["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))

        def union(p: Column) -> Column:
            return F.aggregate(
                p,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end")),
                lambda a, i: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - i)).cast("long").alias("n"), (i + 3).alias("end")),
                lambda a: a["n"],
            )

        return let(let(pairs, twice), union)

    def count(tri: Column) -> Column:
        return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0).cast("long")).otherwise(covered(tri))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(over_runs(words, 3, lambda x: F.xxhash64(x)), count))


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words, q_lost_words, q_clean_text, q_base_failed, q_kept.

    q_clean_text is the text without its failing lines. Null or empty text: no words, so the base rule fails it
    and q_clean_text is empty. A repeated row is judged like the first. Very long texts are read whole, in one
    row. Extra columns stay; names that begin with q_ are taken.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith("q_")])
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    judged = F.transform(F.split(text, "\n"), lambda x: let(F.regexp_count(x, F.lit(WORD)), lambda n: F.struct(x.alias("line"), n.alias("n"), ((n > 0) & line_fails(x, n)).alias("bad"))))
    bad = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.when(x["bad"], x["n"]).otherwise(0))
    good = lambda a: F.array_join(F.transform(F.filter(a, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    cleaned = let(judged, lambda a: F.struct(bad(a).alias("lost"), good(a).alias("text")))
    # One struct of all that is computed from the text, so that each part is computed once.
    q = F.struct(
        words.alias("words"), cleaned.alias("cleaned"),
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup_lines"),
    )

    def verdict(x: Column) -> Column:
        failed = (x["words"]["n"] < 50) | (100 * x["words"]["r"] > 50 * x["words"]["n"])
        return F.struct(
            x["words"]["n"].alias("q_words"), x["word_chars"].alias("q_word_chars"), x["symbols"].alias("q_symbols"), x["dup_lines"].alias("q_dup_lines"),
            x["words"]["r"].alias("q_repeat_words"), x["cleaned"]["lost"].alias("q_lost_words"), x["cleaned"]["text"].alias("q_clean_text"),
            failed.alias("q_base_failed"), (~failed & (x["cleaned"]["lost"] <= max_lost * x["words"]["n"])).alias("q_kept"),
        )

    return docs.select("*", F.inline(F.array(let(q, verdict))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = clean(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
        F.col("q_lost_words").alias("lost_words"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
t AS (SELECT *, CASE WHEN len(words) < 3 THEN [] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END AS tri FROM w),
x AS (SELECT doc_id, text, words, lines, CASE WHEN len(list_distinct(tri)) = len(tri) THEN NULL ELSE tri END AS tri FROM t),
e AS (SELECT doc_id, unnest(tri) AS g, unnest(range(len(tri))) AS i FROM x WHERE tri IS NOT NULL),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM e) WHERE c > 1),
u AS (SELECT doc_id, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM w),
m AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l),
v AS (SELECT doc_id, len(lw) AS n,
        len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.3 * len(lw)
        OR (len(lw) >= 4 AND len(regexp_extract_all(line, '\p{Lu}{2,}')) > 0.5 * len(lw))
        OR (len(lw) <= 4 AND NOT regexp_matches(line, '[.!?:;…。！？"''”’»)\]]\s*$'))
        OR regexp_matches(lower(line), 'all rights reserved|cookie policy|enable javascript|javascript is disabled|privacy policy|terms of service|terms of use|lorem ipsum|sign up for our newsletter|click here to') AS bad FROM m WHERE len(lw) > 0),
b AS (SELECT doc_id, CAST(coalesce(sum(n) FILTER (WHERE bad), 0) AS BIGINT) AS lost FROM v GROUP BY doc_id),
q AS (SELECT x.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(lines, lambda z: regexp_matches(z, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        coalesce(u.n, 0) AS n_repeat_words, coalesce(b.lost, 0) AS lost_words
      FROM x LEFT JOIN u ON u.doc_id = x.doc_id LEFT JOIN b ON b.doc_id = x.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.3 * n_words AS kept
FROM q
"""
