"""Text columns: keys, folds, grounding, quotes, token containment, numbers, URLs, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Arabic letters, marks and digits that are folded.
ARABIC_DIGITS, EXTENDED_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
ARABIC_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
ARABIC_FROM, ARABIC_TO = "أإآٱىة", "اااايه"
#: Words for a whole field, which cover a skill only as the same phrase.
FIELD_WORDS = ("engineering", "management", "design", "marketing", "software", "data", "ring", "widget")
#: A window this like its needle ends the search; below the other a needle is dropped, whatever its ratio.
SURE, LEAST = 0.995, 0.75


def skill_key(s: Column) -> Column:
    """Lower case without blanks at the ends; a blank phrase has no key."""
    return F.nullif(F.lower(F.trim(s)), F.lit(""))


def fold_digits(s: Column) -> Column:
    return F.translate(s, ARABIC_DIGITS + EXTENDED_DIGITS, DIGITS * 2)


def fold_marks(s: Column) -> Column:
    """Arabic letters without marks and in one form each, digits as 0-9, white space collapsed."""
    letters = F.translate(F.regexp_replace(s, ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO)
    return F.trim(F.regexp_replace(fold_digits(letters), r"\s+", " "))


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode's compatibility composition, for which Spark has no function."""
    import unicodedata

    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold(s: Column) -> Column:
    return fold_marks(nfkc(s))


def grounding_form(s: Column) -> Column:
    """Lower case, punctuation but @ . + - / as blanks, collapsed."""
    kept = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\s@.+\-/]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def quote_verified(quote: Column, source: Column) -> Column:
    """Whether a quote stands in the source, both in grounding form; blank quotes don't."""
    q = grounding_form(quote)
    return (q != "") & F.contains(grounding_form(source), q)


@F.pandas_udf(DoubleType())
def window_ratio(needles: pd.Series, texts: pd.Series) -> pd.Series:
    """Best difflib ratio of a needle and the windows of the whole text a little longer than it, or the first of SURE or more.

    The letters that a window and the needle have in common, counted for all windows at once, bound its ratio, so
    few windows are compared. Null, an empty text, a needle under 4 characters, or no window of LEAST: 0.
    """
    from collections import Counter
    from difflib import SequenceMatcher

    import numpy as np

    def best(a: str | None, b: str | None) -> float:
        if not a or not b or len(a) < 4:
            return 0.0
        size, step = len(a) + max(2, len(a) // 5), max(1, len(a) // 4)
        starts = np.arange(0, max(1, len(b) - size + step), step)
        ends = np.minimum(starts + size, len(b))
        letters, common = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4"), np.zeros(len(starts), np.int64)
        for c, n in Counter(a).items():
            upto = np.concatenate([[0], np.cumsum(letters == ord(c))])
            common += np.minimum(upto[ends] - upto[starts], n)
        bound = 2.0 * common / (len(a) + ends - starts)
        m = SequenceMatcher(None, autojunk=False)
        m.set_seq2(a)

        def ratio(i: int) -> float:
            m.set_seq1(b[starts[i] : ends[i]])
            return m.ratio()

        top = 0.0
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] <= top or bound[i] < LEAST:
                break
            top = max(top, ratio(i))
        if top < LEAST:
            return 0.0
        return next(r for i in np.flatnonzero(bound >= SURE) if (r := ratio(i)) >= SURE) if top >= SURE else top

    return pd.Series([best(a, b) for a, b in zip(needles, texts, strict=True)], dtype=float)


def grounding_verdict(exact: Column, ratio: Column, n_chars: Column) -> Column:
    return F.when(exact, "grounded").when(n_chars < 4, "too_short").when(ratio >= 0.92, "grounded").when(ratio >= LEAST, "adjudicate").otherwise("dropped")


def tokens(s: Column) -> Column:
    return F.array_remove(F.split(F.lower(s), r"[^a-z0-9+#.]+"), "")


def contains_run(a: Column, b: Column) -> Column:
    """Whether array b is a run of neighbours inside array a."""
    n, m = F.size(a), F.size(b)
    return F.when((m > 0) & (n >= m), F.exists(F.sequence(F.lit(1), n - m + 1), lambda i: F.slice(a, i, m) == b)).otherwise(F.lit(False))


def covers_skill(have: Column, want: Column) -> Column:
    """Equal phrases, or one's tokens inside the other's; a bare field word only as itself."""
    a, b = F.lower(F.trim(have)), F.lower(F.trim(want))
    bare = a.isin(*FIELD_WORDS) | b.isin(*FIELD_WORDS)
    return (a == b) | (~bare & (contains_run(tokens(have), tokens(want)) | contains_run(tokens(want), tokens(have))))


def longest_token(s: Column) -> Column:
    t = tokens(s)
    return F.array_max(F.transform(t, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("t"))))["t"]


def numbers(s: Column) -> Column:
    """The different numbers of a text, without thousands separators and zeros that say nothing."""
    raw = F.regexp_extract_all(fold_digits(s), F.lit(r"\d[\d,]*(?:\.\d+)?"), 0)
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.array_sort(F.array_distinct(F.transform(raw, clean)))


def slug(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))


def title_of(s: Column) -> Column:
    """The first line of 25 characters or more, else the first; 300 characters at most, as cards show."""
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    long_ = F.filter(lines, lambda x: F.length(x) >= 25)
    return F.left(F.coalesce(F.get(long_, F.lit(0)), F.get(lines, F.lit(0))), F.lit(300))


def canonical_url(u: Column) -> Column:
    """https, lower-case host, without query, fragment and closing slashes."""
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


def packed(paragraphs: Column, size: int) -> Column:
    """Paragraphs in order, with a blank line between, in parts of ``size`` characters at most; a longer one is a part of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a: Column, p: Column) -> Column:
        fits = (a["open"] == "") | (F.length(a["open"]) + F.length(p) + 2 <= size)
        grown = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n\n"), p))
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, grown).otherwise(p).alias("open"))

    return F.aggregate(paragraphs, start, add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunks(s: Column, size: int = 1200) -> Column:
    """The paragraphs of a text, packed."""
    return packed(F.filter(F.transform(F.split(s, r"\n+"), lambda x: F.trim(x)), lambda x: x != ""), size)
