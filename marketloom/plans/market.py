"""Demand and supply queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand as D
from ..operators import supply as S
from ..sources import domain as V
from .registry import query

def joined(name):
    """A list as text, so that any engine's result is compared alike."""
    return F.array_join(F.col(name).cast("array<string>"), ",")


END, DAYS = "1997-07-01", 365
ELIGIBLE = "status = 'active' AND duplicate_of IS NULL AND listing_intent = 'vacancy' AND poster_type = 'company' AND sector IS NOT NULL AND country IS NOT NULL"


def counts_sql(end: str, days: int) -> str:
    return f"""SELECT sector, skill_key, mode() WITHIN GROUP (ORDER BY skill) AS skill, count(DISTINCT posting_id) AS frequency_count, count(DISTINCT source_post) AS distinct_posts
  FROM posting_skills WHERE {ELIGIBLE} AND posted_date > DATE '{end}' - INTERVAL {days} DAY AND posted_date <= DATE '{end}' GROUP BY sector, skill_key"""


def stats_sql(end: str, days: int, before: str) -> str:
    return f"""WITH {V.SKILLS_SQL}, {V.MAP_SQL}, cur AS ({counts_sql(end, days)}), prev AS ({counts_sql(before, days)}),
vol AS (SELECT sector, count(*) AS sector_volume FROM postings WHERE {ELIGIBLE} AND posted_date > DATE '{end}' - INTERVAL {days} DAY AND posted_date <= DATE '{end}' GROUP BY sector),
j AS (SELECT c.*, m.esco_code, v.sector_volume, coalesce(p.frequency_count, 0) AS prior_frequency_count, (SELECT count(*) FROM prev) AS has
  FROM cur c JOIN vol v ON v.sector = c.sector LEFT JOIN prev p ON p.sector = c.sector AND p.skill_key = c.skill_key LEFT JOIN skill_map m ON m.skill_key = c.skill_key)
SELECT sector, skill_key, skill, esco_code, frequency_count, prior_frequency_count,
  CASE WHEN has = 0 THEN 'no_prior_data' WHEN prior_frequency_count = 0 THEN 'new' WHEN frequency_count < 5 AND prior_frequency_count < 5 THEN 'stable'
       WHEN frequency_count * 100 >= prior_frequency_count * 120 THEN 'rising' WHEN frequency_count * 100 <= prior_frequency_count * 80 THEN 'falling' ELSE 'stable' END AS trend,
  sector_volume, distinct_posts, sector_volume < 10 AS low_confidence, DATE '{end}' AS window_end FROM j"""


def stats(spark, sf_dir, end, days, before):
    posts = D.eligible(V.postings(spark, sf_dir))
    skills = V.posting_skills(spark, sf_dir, posts)
    return D.demand_stats(posts, skills, D.skill_counts(skills, before, days), V.skill_map(spark, sf_dir), end, days)


@query("demand_stats", stats_sql(END, DAYS, "1996-07-01"))
def demand_stats(spark, sf_dir):
    return stats(spark, sf_dir, END, DAYS, "1996-07-01")


WINDOWS = (("1995-02-10", 30, "1995-01-01"), ("1995-03-12", 30, "1995-02-10"), ("1998-05-01", 30, "1998-04-01"))


@query("trend_labels", " UNION ALL ".join(f"SELECT window_end, trend, count(*) AS n, sum(frequency_count)::BIGINT AS frequency FROM ({stats_sql(*w)}) GROUP BY window_end, trend" for w in WINDOWS))
def trend_labels(spark, sf_dir):
    out = None
    for w in WINDOWS:
        one = stats(spark, sf_dir, *w).groupBy("window_end", "trend").agg(F.count("*").alias("n"), F.sum("frequency_count").alias("frequency"))
        out = one if out is None else out.unionByName(one)
    return out


IN_WINDOW = f"posted_date > DATE '{END}' - INTERVAL {DAYS} DAY AND posted_date <= DATE '{END}'"


def window_skills(spark, sf_dir):
    posts = D.eligible(V.postings(spark, sf_dir)).filter(D.in_window(F.col("posted_date"), END, DAYS))
    return V.posting_skills(spark, sf_dir, posts)


@query("demand_cooccurrence_top5", f"""WITH {V.SKILLS_SQL}, a AS (SELECT DISTINCT posting_id, sector, skill_key FROM posting_skills WHERE {ELIGIBLE} AND {IN_WINDOW}),
n AS (SELECT a.sector, a.skill_key, b.skill_key AS other_key, count(*) AS n FROM a JOIN a b ON a.posting_id = b.posting_id AND a.skill_key <> b.skill_key GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY sector, skill_key ORDER BY n DESC, other_key) AS rank FROM n QUALIFY rank <= 5""")
def demand_cooccurrence(spark, sf_dir):
    return D.cooccurring(window_skills(spark, sf_dir))


@query("demand_samples_top5", f"""WITH {V.SKILLS_SQL}, a AS (SELECT DISTINCT sector, skill_key, posting_id, posted_date FROM posting_skills WHERE {ELIGIBLE} AND {IN_WINDOW})
SELECT *, row_number() OVER (PARTITION BY sector, skill_key ORDER BY posted_date DESC, posting_id) AS rank FROM a QUALIFY rank <= 5""")
def demand_samples(spark, sf_dir):
    return D.samples(window_skills(spark, sf_dir))


@query("demand_zeroed_sectors", f"""WITH {V.SKILLS_SQL}, e AS (SELECT * FROM posting_skills WHERE {ELIGIBLE} AND country = 'NATION_3')
SELECT DISTINCT sector, skill_key FROM e WHERE posted_date > DATE '1996-12-31' - INTERVAL 60 DAY AND posted_date <= DATE '1996-12-31' AND (sector, skill_key) NOT IN (
  SELECT (sector, skill_key) FROM e WHERE posted_date > DATE '1997-03-01' - INTERVAL 60 DAY AND posted_date <= DATE '1997-03-01')""")
def demand_zeroed(spark, sf_dir):
    skills = V.posting_skills(spark, sf_dir, D.eligible(V.postings(spark, sf_dir), ["NATION_3"]))
    before, now = (skills.filter(D.in_window(F.col("posted_date"), end, 60)).select("sector", "skill_key").distinct() for end in ("1996-12-31", "1997-03-01"))
    return before.join(now, ["sector", "skill_key"], "left_anti")


@query("demand_null_country_audit", f"""WITH {V.POSTINGS_SQL} SELECT count(*) AS n_postings, count(DISTINCT posting_id) FILTER (WHERE salary > 200000) AS n_high_salary
FROM postings WHERE status = 'active' AND duplicate_of IS NULL AND listing_intent = 'vacancy' AND poster_type = 'company' AND country IS NULL AND {IN_WINDOW}""")
def null_country(spark, sf_dir):
    return D.null_country_audit(V.postings(spark, sf_dir), END, DAYS)


@query("modal_sector", f"WITH {V.POSTINGS_SQL} SELECT sector, count(*) AS n FROM postings WHERE {ELIGIBLE} GROUP BY sector ORDER BY n DESC, sector LIMIT 1")
def modal_sector(spark, sf_dir):
    return D.eligible(V.postings(spark, sf_dir)).groupBy("sector").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sector").limit(1)


ACTIVE = "status = 'active' AND duplicate_of IS NULL"


@query("supply_by_skill", f"""WITH {V.COURSES_SQL}, c AS (SELECT * FROM courses WHERE {ACTIVE}),
lv AS (SELECT skill_key, string_agg(level || ':' || n, ',' ORDER BY n DESC, level) AS levels FROM (SELECT skill_key, coalesce(level, 'unstated') AS level, count(*) AS n FROM c GROUP BY ALL) GROUP BY skill_key),
sm AS (SELECT skill_key, string_agg(course_id, ',' ORDER BY course_id) AS sample_courses FROM (SELECT skill_key, course_id FROM c QUALIFY row_number() OVER (PARTITION BY skill_key ORDER BY course_id) <= 5) GROUP BY skill_key)
SELECT c.skill_key, mode() WITHIN GROUP (ORDER BY c.name) AS skill, count(DISTINCT course_id) AS course_count, count(DISTINCT provider) AS provider_count,
  count(DISTINCT course_id) FILTER (WHERE provider IS NULL) AS courses_without_provider, (SELECT count(*) FROM c) AS total_courses,
  any_value(lv.levels) AS levels, any_value(sm.sample_courses) AS sample_courses, count(DISTINCT course_id) < 3 AS low_confidence
FROM c JOIN lv ON lv.skill_key = c.skill_key JOIN sm ON sm.skill_key = c.skill_key GROUP BY c.skill_key""")
def supply_by_skill(spark, sf_dir):
    out = S.by_skill(V.courses(spark, sf_dir).filter(D.aggregable_course()))
    return out.withColumns({"levels": F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["level"], x["n"])), ","), "sample_courses": joined("sample_courses")})


CONCEPT_SQL = f"""c AS (SELECT * FROM courses WHERE {ACTIVE}), j AS (SELECT c.*, m.esco_code FROM c JOIN skill_map m ON m.skill_key = c.skill_key WHERE m.esco_code IS NOT NULL),
concepts AS (SELECT esco_code, mode() WITHIN GROUP (ORDER BY skill_key) AS label, count(DISTINCT course_id) AS course_count, count(DISTINCT provider) AS provider_count,
  string_agg(DISTINCT skill_key, ',' ORDER BY skill_key) AS variant_keys FROM j GROUP BY esco_code)"""


@query("supply_by_concept", f"WITH {V.COURSES_SQL}, {V.MAP_SQL}, {CONCEPT_SQL} SELECT * FROM concepts")
def supply_by_concept(spark, sf_dir):
    return S.by_concept(V.courses(spark, sf_dir).filter(D.aggregable_course()), V.skill_map(spark, sf_dir)).withColumn("variant_keys", joined("variant_keys"))


DEMAND_CONCEPT = f"""d AS (SELECT esco_code, count(DISTINCT posting_id) AS demand FROM posting_skills s JOIN skill_map m ON m.skill_key = s.skill_key
  WHERE {ELIGIBLE} AND {IN_WINDOW} AND m.esco_code IS NOT NULL GROUP BY esco_code)"""


@query("supply_vs_demand", f"""WITH {V.SKILLS_SQL}, {V.COURSES_SQL}, {V.MAP_SQL}, {CONCEPT_SQL}, {DEMAND_CONCEPT}
SELECT d.esco_code, d.demand, coalesce(s.course_count, 0) AS course_count, coalesce(s.provider_count, 0) AS provider_count, coalesce(s.course_count, 0) = 0 AS uncovered
FROM d LEFT JOIN (SELECT * FROM concepts WHERE esco_code <> 'gizmo') s ON s.esco_code = d.esco_code""")
def supply_vs_demand(spark, sf_dir):
    m = V.skill_map(spark, sf_dir)
    have = S.by_concept(V.courses(spark, sf_dir).filter(D.aggregable_course()), m).filter("esco_code <> 'gizmo'")
    return S.against_demand(S.concept_demand(window_skills(spark, sf_dir), m), have)


@query("wrong_grain_fanout", f"""WITH {V.SKILLS_SQL}, {V.COURSES_SQL}, {V.MAP_SQL}, {CONCEPT_SQL}, {DEMAND_CONCEPT},
k AS (SELECT skill_key, count(*) AS n FROM c GROUP BY skill_key),
f AS (SELECT d.esco_code, d.demand FROM d JOIN skill_map m ON m.esco_code = d.esco_code JOIN k ON k.skill_key = m.skill_key)
SELECT (SELECT count(*) FROM d) AS concepts, (SELECT count(*) FROM f) AS fanned_rows, (SELECT sum(demand)::BIGINT FROM d) AS demand, (SELECT sum(demand)::BIGINT FROM f) AS fanned_demand""")
def wrong_grain(spark, sf_dir):
    m = V.skill_map(spark, sf_dir)
    keys = V.courses(spark, sf_dir).filter(D.aggregable_course()).groupBy("skill_key").agg(F.count("*").alias("n"))
    return S.fanout(S.concept_demand(window_skills(spark, sf_dir), m), keys, m)


@query("clustered_posts", f"""WITH {V.POSTINGS_SQL} SELECT source_post, count(*) AS children, count(DISTINCT posted_date) AS distinct_dates, count(DISTINCT posted_date) < count(*) AS shares_body,
  min(company) AS company, string_agg(posting_id, ',' ORDER BY posting_id) AS posting_ids FROM postings WHERE status = 'active' AND sector = 'BUILDING' GROUP BY source_post HAVING count(*) > 1""")
def clustered_posts(spark, sf_dir):
    return S.clustered(V.postings(spark, sf_dir).filter("status = 'active' and sector = 'BUILDING'")).withColumn("posting_ids", joined("posting_ids"))
