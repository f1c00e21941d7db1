"""Gap, recommendation, status and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand as D
from ..operators import gap as G
from ..operators import recommend as R
from ..sources import domain as V
from .market import ELIGIBLE
from .registry import query

#: A search: every hundredth user against all postings. They hold what they ordered before 1996, and want their sector's postings of a week.
GAP_SQL = f"""{V.SKILLS_SQL}, {V.MAP_SQL},
held AS (SELECT source_post AS user_id, s.skill_key AS held_key, m.esco_code AS held_code, max(posted_date) < DATE '1995-06-01' AS weak
  FROM posting_skills s LEFT JOIN skill_map m ON m.skill_key = s.skill_key WHERE source_post % 100 = 0 AND posted_date < DATE '1996-01-01' GROUP BY ALL),
users AS (SELECT DISTINCT source_post AS user_id, sector FROM postings WHERE source_post % 100 = 0),
required AS (SELECT u.user_id, s.posting_id, s.sector, s.skill_key, m.esco_code FROM users u JOIN (SELECT * FROM posting_skills
    WHERE {ELIGIBLE} AND posted_date > DATE '1997-06-24' AND posted_date <= DATE '1997-07-01') s ON s.sector = u.sector LEFT JOIN skill_map m ON m.skill_key = s.skill_key),
demand AS (SELECT s.sector, s.skill_key, m.esco_code, count(DISTINCT posting_id) AS frequency_count FROM posting_skills s LEFT JOIN skill_map m ON m.skill_key = s.skill_key
  WHERE {ELIGIBLE} AND posted_date > DATE '1997-07-01' - INTERVAL 365 DAY AND posted_date <= DATE '1997-07-01' GROUP BY ALL),
best AS (SELECT r.user_id, r.skill_key, max(CASE WHEN hit AND NOT weak THEN 2 WHEN hit OR shared THEN 1 ELSE 0 END) AS s FROM (
  SELECT r.user_id, r.skill_key, h.weak, coalesce(r.esco_code = h.held_code, FALSE) OR h.held_key = r.skill_key AS hit,
    len(list_intersect(string_split(h.held_key, ' '), string_split(r.skill_key, ' '))) > 0 AS shared
  FROM (SELECT DISTINCT user_id, skill_key, esco_code FROM required) r JOIN held h ON h.user_id = r.user_id) r GROUP BY ALL),
judged AS (SELECT r.*, CASE s WHEN 2 THEN 'matched' WHEN 1 THEN 'possible_match' ELSE 'missing' END AS verdict,
    coalesce((SELECT sum(frequency_count) FROM demand d WHERE d.sector = r.sector AND d.esco_code = r.esco_code), (SELECT sum(frequency_count) FROM demand d WHERE d.sector = r.sector AND d.skill_key = r.skill_key),
      (SELECT sum(frequency_count) FROM demand d WHERE d.esco_code = r.esco_code), (SELECT sum(frequency_count) FROM demand d WHERE d.skill_key = r.skill_key), 0)::BIGINT AS demand
  FROM required r LEFT JOIN best b ON b.user_id = r.user_id AND b.skill_key = r.skill_key),
g AS (SELECT user_id, posting_id, sum(CASE WHEN verdict = 'missing' THEN w ELSE 0 END)::DOUBLE AS miss, sum(CASE WHEN verdict = 'possible_match' THEN w ELSE 0 END)::DOUBLE AS maybe, sum(w)::DOUBLE AS total, count(*) AS n_required
  FROM (SELECT *, CAST(round(ln(1 + greatest(1, demand)), 9) AS DECIMAL(18, 9)) AS w FROM judged) GROUP BY ALL)"""


def judged(spark, sf_dir, per_posting=True):
    """Requirements with verdict and demand: of each posting, or each user's different ones, which are found before they are dealt to users."""
    posts = V.postings(spark, sf_dir)
    m = V.skill_map(spark, sf_dir)
    skills = lambda which: V.posting_skills(spark, sf_dir, posts.filter(which), few=True).join(m, "skill_key", "left")
    early = F.max("posted_date") < F.lit("1995-06-01").cast("date")
    held = skills("source_post % 100 = 0 and posted_date < date'1996-01-01'").groupBy(F.col("source_post").alias("user_id"), F.col("skill_key").alias("held_key"), F.col("esco_code").alias("held_code")).agg(early.alias("weak"))
    users = posts.filter("source_post % 100 = 0").select(F.col("source_post").alias("user_id"), "sector").distinct()
    ok = D.aggregable() & F.col("sector").isNotNull() & F.col("country").isNotNull()
    now = skills(ok & D.in_window(F.col("posted_date"), "1997-07-01", 7))
    what = (["posting_id"] if per_posting else []) + ["sector", "skill_key", "esco_code"]
    now = now.select(*what) if per_posting else now.select(*what).distinct()
    required = now.join(users, "sector").select("user_id", *what)
    year = skills(ok & D.in_window(F.col("posted_date"), "1997-07-01", 365))
    demand = year.groupBy("sector", "skill_key", "esco_code").agg(F.countDistinct("posting_id").alias("frequency_count"))
    return G.demand_lookup(G.verdicts(required, held), demand)


@query("skill_verdicts", f"WITH {GAP_SQL} SELECT user_id, posting_id, skill_key, verdict, demand FROM judged")
def skill_verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("user_id", "posting_id", "skill_key", "verdict", "demand")


@query("gap_scores", f"""WITH {GAP_SQL} SELECT user_id, posting_id, n_required, CASE WHEN total <= 0 OR maybe = total THEN NULL ELSE round(miss / (total - maybe), 4) END AS gap,
  CASE WHEN total <= 0 THEN NULL WHEN maybe = total THEN 0.0 ELSE round(miss / total, 4) END::DOUBLE AS low, CASE WHEN total <= 0 THEN NULL WHEN maybe = total THEN 1.0 ELSE round((miss + maybe) / total, 4) END::DOUBLE AS high FROM g""")
def gap_scores(spark, sf_dir):
    return G.gap_scores(judged(spark, sf_dir))


@query("pooled_gap", f"WITH {GAP_SQL} SELECT user_id, CASE WHEN sum(total) > 0 THEN round(sum(miss) / sum(total), 4) END AS pooled_gap FROM g GROUP BY user_id")
def pooled(spark, sf_dir):
    return G.pooled_gap(judged(spark, sf_dir))


MISSING_SQL = f"""{GAP_SQL}, mg AS (SELECT user_id, coalesce(esco_code, skill_key) AS skill, max(demand) AS demand, count(DISTINCT posting_id) AS n_postings, string_agg(DISTINCT skill_key, ',' ORDER BY skill_key) AS variants
  FROM judged WHERE verdict = 'missing' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY demand DESC, n_postings DESC, skill) AS rank FROM mg QUALIFY rank <= 10)"""


@query("missing_skill_groups", f"WITH {MISSING_SQL} SELECT * FROM ranked")
def missing_groups(spark, sf_dir):
    return G.missing_by_concept(judged(spark, sf_dir))


@query("canonical_groups")
def canonical(spark, sf_dir):
    miss = judged(spark, sf_dir).filter("verdict = 'missing' and esco_code is null").groupBy("user_id", "skill_key").agg(F.max("demand").alias("weight"))
    return G.canonical_groups(miss)


SHRUNK = """m AS (SELECT coalesce(avg(rating), 0) AS mean FROM courses WHERE status = 'active' AND duplicate_of IS NULL),
c AS (SELECT course_id, rating, price, round(CASE WHEN rating IS NOT NULL THEN (coalesce(review_count, 0) * rating + 50 * mean) / (coalesce(review_count, 0) + 50) END, 6) AS shrunk, enrollment_count, review_count
  FROM courses, m WHERE status = 'active' AND duplicate_of IS NULL)"""


@query("shrunk_rating_rank", f"""WITH {V.COURSES_SQL}, {SHRUNK} SELECT course_id, shrunk, row_number() OVER (ORDER BY shrunk DESC NULLS LAST, enrollment_count DESC NULLS LAST, review_count DESC NULLS LAST, price NULLS LAST, course_id) AS rank FROM c""")
def shrunk_rank(spark, sf_dir):
    return R.ranked(V.courses(spark, sf_dir).filter(D.aggregable_course())).select("course_id", "shrunk", "rank")


@query("prefer_free_rank", f"""WITH {V.COURSES_SQL}, {SHRUNK} SELECT course_id, row_number() OVER (ORDER BY CASE WHEN price = 0 THEN 0 WHEN price IS NULL THEN 1 ELSE 2 END, shrunk DESC NULLS LAST, enrollment_count DESC NULLS LAST, review_count DESC NULLS LAST, price NULLS LAST, course_id) AS rank FROM c""")
def free_rank(spark, sf_dir):
    return R.ranked(V.courses(spark, sf_dir).filter(D.aggregable_course()), prefer_free=True).select("course_id", "rank")


@query("priority_thirds", f"""WITH {MISSING_SQL}, s AS (SELECT min(demand) AS lo, max(demand) AS hi FROM ranked)
SELECT user_id, skill, demand, CASE WHEN hi = lo THEN 'moderate' WHEN (demand - lo) / (hi - lo) >= 2.0::DOUBLE / 3 THEN 'high' WHEN (demand - lo) / (hi - lo) >= 1.0::DOUBLE / 3 THEN 'moderate' ELSE 'low' END AS bucket FROM ranked, s""")
def thirds(spark, sf_dir):
    return R.thirds(G.missing_by_concept(judged(spark, sf_dir)), "demand").select("user_id", "skill", "demand", "bucket")


@query("greedy_cover")
def cover(spark, sf_dir):
    miss = judged(spark, sf_dir, per_posting=False).filter("verdict = 'missing'").groupBy("user_id", "skill_key", "esco_code").agg(F.max("demand").cast("double").alias("priority"))
    c = V.courses(spark, sf_dir).filter(D.aggregable_course())
    quality = R.ranked(c)
    return R.greedy_cover(R.cover_candidates(miss, c, V.skill_map(spark, sf_dir), quality), quality)


@query("status_census", f"""WITH {V.POSTINGS_SQL} SELECT status, coalesce(country, 'unknown') AS country, duplicate_of IS NULL AS canonical, count(*) AS n FROM postings GROUP BY ALL""")
def census(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("status", F.coalesce("country", F.lit("unknown")).alias("country"), F.col("duplicate_of").isNull().alias("canonical")).agg(F.count("*").alias("n"))


@query("window_census", "SELECT count(DISTINCT last_day(o_orderdate)) AS windows, count(*) AS n, max(last_day(o_orderdate)) AS newest FROM orders")
def windows(spark, sf_dir):
    d = V.table(spark, sf_dir, "orders").select(F.last_day("o_orderdate").alias("w"))
    return d.agg(F.countDistinct("w").alias("windows"), F.count("*").alias("n"), F.max("w").alias("newest"))


@query("taxonomy_coverage", f"WITH {V.MAP_SQL} SELECT count(*) AS n_keys, count(esco_code) AS n_mapped, round(count(esco_code) / count(*), 6) AS coverage FROM skill_map")
def coverage(spark, sf_dir):
    return V.skill_map(spark, sf_dir).agg(F.count("*").alias("n_keys"), F.count("esco_code").alias("n_mapped"), F.round(F.count("esco_code") / F.count("*"), 6).alias("coverage"))


@query("pending_skill_keys", f"""WITH {V.MAP_SQL}, m AS (SELECT skill_key, CASE WHEN esco_code IS NULL THEN 'unmapped' ELSE 'exact' END AS method, CASE WHEN length(skill_key) % 2 = 0 THEN 'v1' ELSE 'v2' END AS version FROM skill_map WHERE skill_key NOT LIKE 'b%')
SELECT k.skill_key FROM (SELECT DISTINCT lower(trim(p_name)) AS skill_key FROM part) k LEFT JOIN m ON m.skill_key = k.skill_key WHERE m.skill_key IS NULL OR (m.method = 'unmapped' AND m.version <> 'v2')""")
def pending(spark, sf_dir):
    m = V.skill_map(spark, sf_dir).filter("skill_key not like 'b%'")
    m = m.select(F.col("skill_key").alias("m_key"), F.when(F.col("esco_code").isNull(), "unmapped").otherwise("exact").alias("method"), F.when(F.length("skill_key") % 2 == 0, "v1").otherwise("v2").alias("version"))
    keys = V.table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("skill_key")).distinct()
    return keys.join(m, F.col("skill_key") == F.col("m_key"), "left").filter("m_key is null or (method = 'unmapped' and version <> 'v2')").select("skill_key")


@query("taxonomy_lexical_map", """WITH l AS (SELECT lower(trim(p_name)) AS label_key, TRUE AS is_preferred, p_partkey AS concept FROM part UNION ALL SELECT lower(p_type), FALSE, p_partkey FROM part),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY label_key ORDER BY is_preferred DESC, concept) = 1)
SELECT k.k AS skill_key, b.concept, CASE WHEN b.concept IS NULL THEN 'unmapped' WHEN b.is_preferred THEN 'exact' ELSE 'alt_label' END AS method
FROM (SELECT DISTINCT lower(trim(p_name)) AS k FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT lower(p_brand) FROM part) k LEFT JOIN b ON b.label_key = k.k""")
def lexical(spark, sf_dir):
    from ..operators.lifecycle import latest

    p = V.table(spark, sf_dir, "part")
    pref = p.select(F.lower(F.trim("p_name")).alias("label_key"), F.lit(True).alias("is_preferred"), F.col("p_partkey").alias("concept"))
    labels = pref.unionByName(p.select(F.lower("p_type").alias("label_key"), F.lit(False).alias("is_preferred"), F.col("p_partkey").alias("concept")))
    best = latest(labels, ["label_key"], [F.desc("is_preferred"), F.col("concept")])
    keys = p.select(F.lower(F.trim("p_name")).alias("k")).union(p.select(F.lower("p_type"))).union(p.select(F.lower("p_brand"))).distinct()
    method = F.when(F.col("concept").isNull(), "unmapped").when(F.col("is_preferred"), "exact").otherwise("alt_label")
    return keys.join(best, F.col("k") == F.col("label_key"), "left").select(F.col("k").alias("skill_key"), "concept", method.alias("method"))


@query("dashboard_rollup", f"""WITH {MISSING_SQL}, p AS (SELECT user_id, avg(gap) AS a FROM (SELECT user_id, CASE WHEN total <= 0 OR maybe = total THEN NULL ELSE round(miss / (total - maybe), 4) END AS gap FROM g) GROUP BY user_id),
st AS (SELECT user_id, count(DISTINCT skill_key) FILTER (WHERE verdict = 'matched') AS n_strengths FROM judged GROUP BY user_id),
tp AS (SELECT user_id, string_agg(skill, ',' ORDER BY rank) AS top_gaps FROM ranked WHERE rank <= 2 GROUP BY user_id)
SELECT st.user_id, CAST(round((1 - round(p.a, 6)) * 100) AS INTEGER) AS readiness, n_strengths, top_gaps FROM st LEFT JOIN p ON p.user_id = st.user_id LEFT JOIN tp ON tp.user_id = st.user_id""")
def dashboard(spark, sf_dir):
    j = judged(spark, sf_dir)
    ready = G.gap_scores(j).groupBy("user_id").agg(F.round((1 - F.round(F.avg("gap"), 6)) * 100).cast("int").alias("readiness"))
    strengths = j.groupBy("user_id").agg(F.countDistinct(F.when(F.col("verdict") == "matched", F.col("skill_key"))).alias("n_strengths"))
    top = G.missing_by_concept(j, 2).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "skill"))), lambda x: x["skill"]), ",").alias("top_gaps"))
    return strengths.join(ready, "user_id", "left").join(top, "user_id", "left").select("user_id", "readiness", "n_strengths", "top_gaps")
