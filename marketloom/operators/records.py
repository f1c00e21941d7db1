"""Records of profiles and postings: gates, merges, precedence, signals, lines, envelopes and the small rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights of the risk signals, and of the lengths that two of them look at.
SIGNAL_WEIGHTS = {"whatsapp_only_contact": 0.30, "no_employer_named": 0.25, "contact_only_no_role": 0.20, "no_role_described": 0.10, "mass_vacancy_no_detail": 0.10}
ROLE_CHARS = 120
#: Edges of a token in grounding form.
EDGE = r"[\s@.+\-/]"


def contains_span(needle: Column, text: Column) -> Column:
    """Whether a needle stands in a text with an edge of a token on either side, both in grounding form; an empty one doesn't."""
    pattern = F.concat(F.lit(rf"(^|{EDGE})\Q"), needle, F.lit(rf"\E($|{EDGE})"))
    return F.coalesce((needle != "") & F.regexp_like(text, pattern), F.lit(False))


def enough_text(name: Column, description: Column, least: int = 30) -> Column:
    """insufficient_text for rows that say too little, else null."""
    return F.when(F.length(F.trim(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))) < least, "insufficient_text")


def in_scope(stated: Column, by_url: Column, scope: tuple[str, ...]) -> Column:
    """A stated country decides; where none is stated that of the URL does; where neither is known the row stays."""
    known = F.coalesce(stated, by_url)
    return known.isNull() | known.isin(*scope)


def quantised(score: Column, step: float = 0.1) -> Column:
    """Minus the number of steps, halves to even."""
    return -F.bround(score / step, 0)


def limited(df: DataFrame, n: int | None) -> DataFrame:
    """No number, no limit."""
    return df if n is None else df.limit(n)


def line_numbers(blocks: DataFrame, page: str, order: list[str], share: float = 0.6, default: float = 10.0) -> DataFrame:
    """``blocks`` (page, top, left, height, ...) with ``line``, and ``place`` in reading order.

    Blocks go by top, then left; one within ``share`` of the median height from the head of the open line joins it,
    any other opens a line. The fold is over one page's blocks, in an array.
    """
    own = blocks.groupBy(page).agg((F.coalesce(F.median(F.nullif("height", F.lit(0))), F.lit(default / share)) * share).alias("tolerance"), F.sort_array(F.collect_list(F.struct("top", "left", *order))).alias("b"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("head"), F.array().cast("array<int>").alias("lines"))

    def add(a: Column, x: Column) -> Column:
        same = F.coalesce(F.abs(x["top"] - a["head"]) <= F.col("tolerance"), F.lit(False))
        line = F.when(same, a["line"]).otherwise(a["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, a["head"]).otherwise(x["top"].cast("double")).alias("head"), F.concat(a["lines"], F.array(line)).alias("lines"))

    numbered = own.select(page, F.posexplode(F.arrays_zip(F.col("b"), F.aggregate("b", start, add, lambda a: a["lines"]).alias("n"))).alias("at", "x"))
    numbered = numbered.select(page, "x.b.*", F.col("x.n").alias("line"))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("line", "left", "top", *order)))


def stripped(text: Column) -> Column:
    """The text without spaces of any kind (Unicode's space separators) at its ends; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\p{Zs}+|\p{Zs}+\z", "")


def structural_signals(text: Column, title: Column, company: Column, whatsapp: str, email: str, link: str, role: str, many: str) -> Column:
    """array<struct<code,weight,evidence>> in the order in which they are looked for; what is an absence quotes nothing."""
    body = stripped(text)
    has_role = body.rlike(role)
    source = audit_source(title, text)
    said, crowd = F.nullif(F.regexp_extract(body, f"({whatsapp})", 1), F.lit("")), F.nullif(F.regexp_extract(source, f"({many})", 1), F.lit(""))
    none = F.lit(None).cast("string")

    def signal(code: str, when: Column, evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(SIGNAL_WEIGHTS[code]).alias("weight"), evidence.alias("evidence")))

    found = F.array(
        signal("whatsapp_only_contact", said.isNotNull() & ~body.rlike(email) & ~body.rlike(link), said),
        signal("no_employer_named", stripped(company) == "", none),
        signal("contact_only_no_role", ~has_role & (F.length(body) < ROLE_CHARS), none),
        signal("no_role_described", ~has_role & (F.length(body) >= ROLE_CHARS), none),
        signal("mass_vacancy_no_detail", ~has_role & crowd.isNotNull(), crowd),
    )
    return F.filter(found, lambda x: x.isNotNull())


def audit_source(title: Column, text: Column) -> Column:
    """All that a signal may quote from."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def auditable(signals: Column, source: Column) -> Column:
    """Whether each quoted span occurs in the source."""
    return F.forall(signals, lambda s: s["evidence"].isNull() | F.contains(source, s["evidence"]))


def precedence(stated: Column, extracted: Column, verified: Column) -> Column:
    """What the source states, else what was extracted and verified, else nothing."""
    return F.coalesce(stated, F.when(verified, extracted))


def updated(stored: DataFrame, changes: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows with the changes' values in the allowed columns; a change of any other column is an error."""
    if wrong := sorted(set(changes.columns) - {key, *allowed}):
        raise ValueError(f"may not be updated: {', '.join(wrong)}")
    new = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("u_key"), *[F.col(x).alias(f"u_{x}") for x in new], F.lit(True).alias("u_row"))
    j = stored.join(c, F.col(key) == F.col("u_key"), "left")
    return j.select(*[F.when(F.col("u_row"), F.col(f"u_{x}")).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in stored.columns])


def run_stage(stage: Column, since: Column, now: Column, minutes: int = 30) -> Column:
    """The stage of a run; an open one of which nothing was heard for ``minutes`` is stale."""
    return F.when(~stage.isin("done", "failed") & (F.unix_timestamp(now) - F.unix_timestamp(since) > 60 * minutes), "stale").otherwise(stage)


def sections(paths: DataFrame) -> DataFrame:
    """(record, prefix, score, grounded) to per prefix and over all: mean score of the grounded, their share, counts."""
    grounded = F.col("grounded")
    g = paths.groupingSets([["record", "prefix"], ["record"]], "record", "prefix").agg(
        F.round(F.avg(F.when(grounded, F.col("score"))), 6).alias("confidence"), F.count(F.when(grounded, 1)).alias("n_grounded"), F.count("*").alias("n")
    )
    return g.select("record", F.coalesce("prefix", F.lit("all")).alias("prefix"), "confidence", "n_grounded", "n", F.round(F.col("n_grounded") / F.col("n"), 6).alias("precision"))


def not_seen(old: Column, new: Column, key) -> Column:
    """Two arrays of structs as one: the old, then of the new those whose key is in neither the old nor before them."""
    both = F.concat(old, new)
    keys = F.transform(both, key)
    return F.filter(both, lambda x, i: (i < F.size(old)) | (F.array_position(keys, key(x)) == i + 1))


def split_list(raw: Column) -> Column:
    """What was typed with commas or semicolons in between."""
    return F.filter(F.transform(F.split(raw, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def cleaned_skills(skills: Column, markers: tuple[str, ...] = ("n/a", "none", "not stated")) -> Column:
    """Stripped, without blanks and words for nothing, each once whatever its case, in order."""
    own = F.filter(F.transform(skills, lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(*markers))
    low = F.transform(own, F.lower)
    return F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def title_cased(slug: Column, small: tuple[str, ...] = ("a", "an", "and", "for", "in", "of", "the", "to", "with"), fixed: dict[str, str] | None = None) -> Column:
    """Words of a slug with capitals, but for small words inside; and names that are written in their own way."""
    fixed = {"api": "API", "apis": "APIs", "sql": "SQL", "html": "HTML", "css": "CSS"} if fixed is None else fixed

    def word(w: Column, i: Column) -> Column:
        own = F.when(w.isin(*small) & (i > 0), w).otherwise(F.initcap(w))
        for k, v in fixed.items():
            own = F.when(w == k, v).otherwise(own)
        return own

    return F.array_join(F.transform(F.filter(F.split(F.lower(slug), "-"), lambda x: x != ""), word), " ")


def handle(raw: Column) -> Column:
    """A channel's handle from @name, a t.me link or the name; 5 to 32 letters, digits and _, first a letter; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^(https?://)?(www\.)?(t\.me|telegram\.me)/(s/)?", ""), "^@", "")
    name = F.lower(F.regexp_replace(bare, r"[/?].*$", ""))
    return F.when(name.rlike(r"^[a-z][a-z0-9_]{4,31}$"), name)


def price_label(amount: Column, currency: Column, free: Column) -> Column:
    return F.when(free | (amount == 0), "Free").when(amount.isNull(), "Price not stated").otherwise(F.concat_ws(" ", currency, F.round(amount).cast("long").cast("string")))


def envelope(value: Column, confidence: Column, evidence: Column) -> Column:
    """{value, confidence, evidence}; nothing stated, nothing but nulls."""
    ok = value.isNotNull()
    return F.struct(value.alias("value"), F.when(ok, F.round(confidence, 3)).alias("confidence"), F.when(ok, evidence).alias("evidence"))


def sectioned_chunks(text: Column, fallback: Column, size: int = 1200) -> Column:
    """Passages of a Markdown text: one per ## section, split at blank lines where longer than ``size``, the title above each; the H1 is the title."""
    from ..functions.text import packed

    h1 = F.regexp_extract(text, r"(?m)^# (.*)$", 1)
    title = F.when(h1 != "", F.trim(h1)).otherwise(F.replace(fallback, F.lit("-"), F.lit(" ")))
    body = F.regexp_replace(text, r"\A#\s+.*?(\n|\z)", "")
    parts = F.filter(F.transform(F.split(body, r"\n(?=##\s)"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.transform(F.flatten(F.transform(parts, lambda x: F.when(F.length(x) <= size, F.array(x)).otherwise(packed(F.split(x, "\n\n"), size)))), lambda x: F.concat(title, F.lit("\n\n"), x))
