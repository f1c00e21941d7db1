"""Risk, stated facts, durations and other rules of the market."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signals of a risky text: name, pattern, weight. The patterns are parameters; these fit the test texts.
SIGNALS = (("contact", r"(?i)whatsapp|@", 0.35), ("fee", r"(?i)registration fee|license", 0.5), ("pressure", r"!!", 0.3), ("symbols", r"[%$#&*]{3}", 0.25), ("link", r"https?://", 0.2))


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w) over an array, each w in 0..1; rounded to 6, below 1."""
    clamp = lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))
    p = F.aggregate(weights, F.lit(1.0), lambda a, w: a * (F.lit(1.0) - clamp(w)))
    return F.least(F.lit(0.999999), F.round(F.lit(1.0) - p, 6))


def risk(text: Column, signals=SIGNALS) -> Column:
    return noisy_or(F.filter(F.array(*[F.when(text.rlike(p), F.lit(w)) for _, p, w in signals]), lambda x: x.isNotNull()))


def band(score: Column) -> Column:
    """Of legitimacy = 1 - risk."""
    return F.when(score <= 0.30, "reject").when(score <= 0.60, "adjudicate").otherwise("clean")


def stated_arrangement(text: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """The one arrangement whose phrases the text has; none if several do."""
    low = F.lower(text)

    def any_of(ps: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in ps:
            out = out | F.contains(low, F.lit(p))
        return out

    found = F.filter(F.array(*[F.when(any_of(ps), F.lit(k)) for k, ps in phrases.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


NUMBER = r"(\d+(?:\.\d+)?)"
RANGE = NUMBER + r"(?:\s*(?:-|–|to)\s*" + NUMBER + ")?"


def workload_hours(s: Column) -> Column:
    """struct<lo,hi>: hours of a stated workload. Weekly hours need a number of weeks, else nothing is said."""
    low = F.lower(s)
    weeks = F.nullif(F.regexp_extract(low, r"(\d+)\s*weeks?\b", 1), F.lit("")).try_cast("double")
    part = lambda unit, i: F.nullif(F.regexp_extract(low, RANGE + r"\s*" + unit, i), F.lit("")).try_cast("double")
    h1, h2, m1, m2 = part(r"(?:hours?|hrs?|h)\b", 1), part(r"(?:hours?|hrs?|h)\b", 2), part(r"(?:minutes?|mins?)\b", 1), part(r"(?:minutes?|mins?)\b", 2)
    lo = F.when(h1.isNotNull() | m1.isNotNull(), F.coalesce(h1, F.lit(0.0)) + F.coalesce(m1, F.lit(0.0)) / 60)
    hi = F.when(lo.isNotNull(), F.coalesce(h2, h1, F.lit(0.0)) + F.coalesce(m2, m1, F.lit(0.0)) / 60)
    weekly = low.rlike(r"(?:a|per|/|each)\s*week|weekly")
    times = F.when(weekly, weeks).otherwise(F.lit(1.0))
    a, b = F.round(F.least(lo, hi) * times, 2), F.round(F.greatest(lo, hi) * times, 2)
    return F.when(a.isNotNull(), F.struct(a.alias("lo"), b.alias("hi")))


def iso_hours(s: Column) -> Column:
    """Hours of an ISO-8601 duration of days, hours and minutes; weeks and what else is refused."""
    ok = s.rlike(r"^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?)?$") & s.rlike(r"\d")
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract(s, p, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(ok, F.round(n(r"(\d+)D") * 24 + n(r"T(?:\d+M)?(\d+)H") + n(r"(\d+)M") / 60, 2))


def shrunk_rating(rating: Column, reviews: Column, mean: Column, prior: float = 50.0) -> Column:
    """(v r + C m) / (v + C); no rating stays none, no reviews count as 0."""
    v = F.coalesce(reviews.cast("double"), F.lit(0.0))
    return F.when(rating.isNotNull(), (v * rating + prior * mean) / (v + prior))


def demand_weight(n: Column) -> Column:
    return F.log1p(F.greatest(F.lit(1), n).cast("double"))


def age_label(days: Column) -> Column:
    return F.when(days.isNull(), None).when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 30, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise("over a month ago")
