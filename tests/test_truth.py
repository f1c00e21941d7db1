"""Truth tables of the market's rules on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from marketloom.functions import rules as R
from marketloom.functions import text as T
from marketloom.operators import demand as D
from marketloom.operators import gap as G
from marketloom.operators import lifecycle as L
from marketloom.operators import recommend as C
from marketloom.operators import supply as S
from marketloom.operators import vectors as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_trend_labels(spark):
    rows = [(6, 5, True, "rising"), (5, 10, True, "falling"), (2, 4, True, "stable"), (4, 20, True, "falling"), (3, None, False, "no_prior_data"), (3, 0, True, "new"), (10, 9, True, "stable")]
    d = spark.createDataFrame(rows, "n int, p int, has boolean, want string")
    assert all(r.got == r.want for r in d.select("want", D.trend(F.col("n"), F.col("p"), F.col("has")).alias("got")).collect())


def test_eligibility_and_spelling(spark):
    base = dict(sector="2", status="active", duplicate_of=None, listing_intent="vacancy", poster_type="company", country="OM", source_post=1, posted_date=dt.date(2026, 7, 1))
    rows = [base | {"posting_id": i, "skills": ["Python", "SQL"]} for i in range(6)] + [base | {"posting_id": 10 + i, "skills": ["sql"]} for i in range(5)]
    for k, v in (("status", "stale"), ("duplicate_of", 1), ("listing_intent", "service"), ("poster_type", "individual"), ("country", None), ("sector", None)):
        rows.append(base | {"posting_id": 50 + len(rows), "skills": ["Python"], k: v})
    schema = "posting_id long, sector string, status string, duplicate_of long, listing_intent string, poster_type string, country string, source_post long, posted_date date, skills array<string>"
    posts = D.eligible(spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows], schema))
    skills = posts.withColumn("skill", F.explode("skills")).withColumn("skill_key", F.lower("skill"))
    got = {r.skill_key: (r.frequency_count, r.skill) for r in D.skill_counts(skills, "2026-07-22", 30).collect()}
    assert got == {"python": (6, "Python"), "sql": (11, "SQL")}


def test_age_then_touch_nets_zero_and_prune_promotes(spark):
    day = F.lit("2026-01-01").cast("date")
    rows = spark.createDataFrame([(1, "a", "active", 2, None, None), (2, "a", "active", 2, None, None), (3, "b", "active", 2, None, None), (4, "a", "stale", 5, dt.date(2025, 1, 1), None), (5, "a", "active", 0, None, 4)], "posting_id long, source string, status string, missed_cycles int, stale_since date, duplicate_of long")
    now = L.age_and_touch(rows, rows.filter("posting_id in (1, 5)"), spark.createDataFrame([("a",)], "source string"), day)
    got = {r.posting_id: r for r in now.collect()}
    assert (got[1].missed_cycles, got[1].status) == (0, "active") and (got[2].missed_cycles, got[2].status, got[2].stale_since) == (3, "stale", dt.date(2026, 1, 1))
    assert (got[3].missed_cycles, got[3].status) == (2, "active")
    kept = {r.posting_id: r.duplicate_of for r in L.prune(now, day).collect()}
    assert 4 not in kept and kept[5] is None


def test_gap_edges(spark):
    g = lambda m, p, t: tuple(one(spark, x) for x in G.gap_of(F.lit(m), F.lit(p), F.lit(t)))
    assert g(0.0, 0.0, 0.0) == (None, None, None) and g(0.0, 2.0, 2.0) == (None, 0.0, 1.0) and g(1.0, 1.0, 4.0) == (0.3333, 0.25, 0.5)
    t = lambda s: one(spark, G.tier(F.lit(False), F.lit(False), F.lit(False), F.lit(s), F.lit(False)))
    assert [t(s) for s in (0.8, 0.79, 0.6, 0.59)] == ["matched", "possible_match", "possible_match", "missing"]
    assert one(spark, G.tier(F.lit(True), F.lit(False), F.lit(False), F.lit(0.0), F.lit(True))) == "possible_match"


def test_ranking_cover_and_supply(spark):
    c = spark.createDataFrame([(1, 4.9, 1000, 5, 9.0), (2, 5.0, 2, 5, 9.0), (3, 0.0, None, None, None), (4, None, None, None, None), (5, None, None, None, None)], "course_id long, rating double, review_count long, enrollment_count long, price double")
    assert [r.course_id for r in C.ranked(c).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    pairs = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 1.0, 1), (1, "c", 1.0, 1), (1, "a", 1.0, 2)], "user_id long, skill_key string, priority double, course_id long")
    got = C.greedy_cover(pairs, C.ranked(c)).collect()
    assert [(r.course_id, r.primary_skill, r.other_skills) for r in got] == [(1, "a", "b,c")]
    courses = spark.createDataFrame([(1, "p", "ml"), (1, "p", "machine learning"), (1, "p", "ML ops")], "course_id long, provider string, skill_key string")
    m = spark.createDataFrame([("ml", "x"), ("machine learning", "x"), ("ML ops", "x")], "skill_key string, esco_code string")
    assert S.by_concept(courses, m).first().course_count == 1


def test_risk_and_durations(spark):
    assert one(spark, R.noisy_or(F.array(*[F.lit(0.9)] * 5))) < 1
    assert one(spark, R.noisy_or(F.array(F.lit(0.3)))) <= one(spark, R.noisy_or(F.array(F.lit(0.3), F.lit(0.1))))
    assert one(spark, R.workload_hours(F.lit("2 hours a week"))) is None and tuple(one(spark, R.workload_hours(F.lit("90-120 minutes")))) == (1.5, 2.0)
    assert one(spark, R.iso_hours(F.lit("P4W"))) is None


def test_text_rules(spark):
    c = lambda a, b: one(spark, T.covers_skill(F.lit(a), F.lit(b)))
    assert not c("java", "javascript") and c("Machine Learning", "learning") and not c("data", "data analysis") and c("data", "Data")
    assert one(spark, T.fold(F.lit("ﷲ  أحمد ٣٤ ﬁ"))).endswith("احمد 34 fi")
    assert one(spark, T.numbers(F.lit("1,200.50 and 3.0, ٣"))) == ["1200.5", "3"]
    assert not one(spark, T.quote_verified(F.lit(" "), F.lit("x"))) and one(spark, T.quote_verified(F.lit("A, b!"), F.lit("x a b y")))
    assert one(spark, T.canonical_url(F.lit("HTTP://Ex.COM/a/b/?q#f"))) == "https://ex.com/a/b"
    assert one(spark, T.chunks(F.lit("a\n\nb\nccc"), 4)) == ["a\n\nb", "ccc"]


def test_chains_and_health(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9)], "id long, parent long")
    assert {r.id: r.root for r in X.flatten_chains(links).collect()} == {5: 2, 4: 2, 3: 2, 9: 7, 8: 7, 7: 7}
    a = spark.createDataFrame([("s", dt.datetime(2026, 1, i), i, i == 2) for i in range(1, 7)], "source string, ts timestamp, event_id long, ok boolean")
    r = L.source_health(a).first()
    assert (r.consecutive_failures, r.total_cycles, r.degraded_since, r.last_success_at) == (4, 6, dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 2))


def test_near_pairs_of_many_blocks(spark):
    """All pairs of blocks against a plain loop, with copies, nulls, other lengths, and what is no number."""
    import random

    r = random.Random(3)
    rows = [(i, r.choice([0, 1, None]), [r.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(300, 1, rows[0][2]), (301, 1, None), (302, 1, [0.5, None]), (303, 1, [1.0]), (304, 0, [0.5]), (None, 1, rows[0][2]), (305, 1, [float("nan")] * 2), (306, 1, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, group int, vector array<float>")
    want = set()
    for i, g, x in rows:
        for j, h, y in rows:
            if i is not None and j is not None and i < j and x and y and len(x) == len(y) and None not in x + y:
                dot = sum(p * q for p, q in zip(x, y, strict=True))
                if not dot < 0.5:
                    want.add((i, j, None if g is None or h is None else g == h, str(round(dot, 5))))
    got = [(p.a, p.b, p.same_group, str(p.similarity)) for p in X.near_pairs(v, 0.5, rows=40).collect()]
    assert set(got) == want and len(got) == len(want)


def test_near_pairs_in_time(spark):
    """50 million pairs: a product of matrices takes seconds, one expression a pair took minutes."""
    import time

    from pyspark.sql import functions as F

    d = [F.hash("id", F.lit(k)).cast("float") / 2**34 for k in range(64)]
    v = spark.range(10_000).select("id", (F.col("id") % 10).alias("group"), F.array(*d).cast("array<float>").alias("vector"))
    start = time.time()
    assert X.near_pairs(v, 0.15).count() > 0 and time.time() - start < 60


def test_cover_candidates_choose_the_same(spark):
    """The few courses that can be chosen give what all candidates give; many that teach the same leave one."""
    import random

    r = random.Random(5)
    keys = [f"k{i}" for i in range(12)]
    courses = spark.createDataFrame([(i, r.choice(keys), 4.0, i % 7, i % 5, float(i % 3)) for i in range(400) for _ in range(1 + i % 2)], "course_id long, skill_key string, rating double, review_count long, enrollment_count long, price double")
    mapping = spark.createDataFrame([(k, None if i % 4 == 0 else f"c{i % 3}") for i, k in enumerate(keys)], "skill_key string, esco_code string")
    codes = {x.skill_key: x.esco_code for x in mapping.collect()}
    missing = spark.createDataFrame([(u, k, codes[k], float(r.randint(1, 5))) for u in range(30) for k in r.sample(keys, 7)], "user_id long, skill_key string, esco_code string, priority double")
    quality = C.ranked(courses.dropDuplicates(["course_id"])).localCheckpoint()
    for cap in (3, 20, 200):
        few, every = C.cover_candidates(missing, courses, mapping, quality, cap), C.candidates(missing, courses, mapping, cap)
        assert sorted(C.greedy_cover(few, quality).collect()) == sorted(C.greedy_cover(every, quality).collect()) and few.count() <= every.count()
    assert few.count() * 10 < every.count()


def test_cover_chooses_among_all_courses_of_a_skill(spark):
    """The best course of a concept and of a key without one has the last of over 200 ids, and is chosen."""
    rows = [(i, k, 1.0 + 4.0 * (i == n), 1_000, 5, 9.0) for k, a, n in (("ml", 0, 260), ("rust", 1_000, 1_230)) for i in range(a, n + 1)]
    courses = spark.createDataFrame(rows, "course_id long, skill_key string, rating double, review_count long, enrollment_count long, price double")
    mapping = spark.createDataFrame([("ml", "c"), ("rust", None)], "skill_key string, esco_code string")
    missing = spark.createDataFrame([(1, "ml", "c", 2.0), (1, "rust", None, 1.0)], "user_id long, skill_key string, esco_code string, priority double")
    quality = C.ranked(courses)
    for pairs in (C.cover_candidates(missing, courses, mapping, quality), C.candidates(missing, courses, mapping)):
        got = sorted(C.greedy_cover(pairs, quality).collect(), key=lambda r: r.step)
        assert [(r.course_id, r.primary_skill) for r in got] == [(260, "ml"), (1_230, "rust")]


def test_near_pair_queries_equal_their_sql(spark, tmp_path):
    """Copies, null ids, null labels and null vectors."""
    import duckdb

    from marketloom.plans import catalog

    rows = [(i, (0, 1, None)[i % 3], [((i * k) % 7 - 3) / 8 for k in range(1, 9)]) for i in range(60)] + [(None, 0, [0.5] * 8), (90, 1, [0.5] * 8), (91, 0, None), (92, None, [0.5] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("neardup_in_group", "neardup_cross_group"):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        want = c.execute(catalog.SQL[name]).fetchall()
        assert len(got) == len(want) > 0 and set(got) == set(want)


def test_decisions_of_many_pairs(spark):
    """Each vector's best match among copies and ties, against a plain loop; a vector without id matches nothing."""
    rows = [(i, i % 3, [((i * k) % 7 - 3) / 4 for k in range(1, 9)]) for i in range(60)] + [(None, 0, [0.5] * 8), (90, 1, [0.5] * 8)]
    want = {}
    for i, g, x in rows:
        own = [(h != g, -dot, j) for j, h, y in rows if i is not None and j is not None and j < i and (dot := round(sum(p * q for p, q in zip(x, y, strict=True)), 5)) >= 0.35]
        if own:
            other, dot, j = min(own)
            want[i] = (j, -dot, "needs_review" if other else "duplicate")
    v = spark.createDataFrame(rows, "id long, group int, vector array<float>")
    assert {r.id: (r.match, r.similarity, r.decision) for r in X.merge_decision(X.near_pairs(v, 0.35)).collect()} == want
