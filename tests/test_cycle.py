"""Truth tables of a cycle's operators, and late rows in streams."""

import time

import pytest
from pyspark.sql import functions as F

from marketloom.operators import cycle as C
from marketloom.operators import pages as P
from marketloom.streaming import events as S


def test_stated_dates(spark):
    table = [("2026-06", "2026-06"), ("Expected June 2026", "2026-06"), ("sept., 2025", "2025-09"), ("2024 - 2026", "2026"), ("2026/13", "2026"), ("1999", None), ("soon", None), ("", None), (None, None), ("DEC 2021", "2021-12")]
    d = spark.createDataFrame(table, "raw string, want string").withColumn("got", C.stated_date(F.col("raw")))
    assert [(r.raw, r.got) for r in d.collect()] == table


def test_preferences(spark):
    table = [("nurse", None, None, "nurse"), ("nurse", "chef", False, "nurse / chef"), ("nurse", "chef", True, "chef"), ("", "chef", None, "chef"), (None, " ", True, "")]
    d = spark.createDataFrame(table, "h string, r string, o boolean, want string")
    got = d.select("want", C.wanted_title(F.col("h"), F.col("r"), F.col("o")).alias("t"), C.wanted_essence(F.col("h"), F.lit(" "), F.col("r"), F.array()).alias("e")).collect()
    assert all(r.t == r.want for r in got) and got[1].e == "nurse\npreferred work arrangement: chef" and got[4].e == ""


def test_missing_skills_fall_back_by_owner(spark):
    rich = spark.createDataFrame([(1, 1, " SQL", "c1", 0.5), (1, 0, "sql ", "c0", None), (1, 2, " ", "c", 1.0)], "u int, position int, skill string, esco_code string, priority_score double")
    bare = spark.createDataFrame([(1, 0, "java"), (2, 0, "Go"), (2, 1, "go"), (2, 2, None)], "u int, position int, skill string")
    got = {(r.u, r.skill): (r.esco_code, r.priority_score, r.fallback) for r in C.loaded_missing(rich, bare, "u").collect()}
    assert got == {(1, "sql"): ("c0", 0.0, False), (2, "go"): (None, 1.0, True)}


def test_sync_counters_and_vectors(spark):
    old = spark.createDataFrame([("a", "A", "v1"), ("b", "B", "v1")], "k string, label string, taxonomy_version string")
    new = spark.createDataFrame([("b", "B1", 0), ("b", "B2", 1), ("c", "C", 0)], "k string, label string, ordinal int")
    assert sorted(tuple(r) for r in C.synced_concepts(old, new, "k", "v2").collect()) == [("a", "A", "v1"), ("b", "B2", "v2"), ("c", "C", "v2")]
    b = spark.createDataFrame([(1, 2, None), (1, 3, 4)], "run int, x long, y long")
    assert tuple(C.merged_counters(b, "run", ["x", "y"]).first()) == (1, 5, 4)
    rows = spark.createDataFrame([(1, "active", None), (2, "stale", None), (3, "active", 1)], "id int, status string, duplicate_of int")
    v = spark.createDataFrame([(1, [0.5])], "id int, vector array<double>")
    assert [r.id for r in C.embedded(rows, v, "id").collect()] == [1]
    with pytest.raises(Exception, match="no vector for 1"):
        C.embedded(rows, v.limit(0), "id").collect()


def test_migration_states(spark):
    files = spark.createDataFrame([("0001_a.sql", "x"), ("0002_b.sql", "y"), ("0003_c.sql", "z"), ("0003_d.sql", "z"), ("b.sql", "w"), ("0010_e.sql", "n")], "name string, body string")
    done = spark.createDataFrame([("0001", "x"), ("0002", "old")], "version string, body string").select("version", F.sha2("body", 256).alias("checksum"))
    got = {r.name: r.state for r in C.migration_plan(files, done).collect()}
    assert got == {"0001_a.sql": "applied", "0002_b.sql": "drifted", "0003_c.sql": "duplicate", "0003_d.sql": "duplicate", "b.sql": "bad_name", "0010_e.sql": "pending"}


def test_gaps_are_ranked_and_all_kept(spark):
    rows = [(1, f"o{i}", i, "optional", None, False, False, None, False) for i in range(9)]
    rows += [(1, "name", 20, "required", " ", True, False, None, False), (1, "weak", 0, "other", "v", False, True, 0.59, False), (1, "sure", 0, "other", "v", False, True, 0.6, False), (1, "told", 0, "required", None, False, False, None, True)]
    f = spark.createDataFrame(rows, "u int, path string, position int, kind string, value string, dropped boolean, grounded boolean, confidence double, supplied boolean")
    got = sorted((r.place, r.path, r.reason, r.asked) for r in C.gap_list(f, "u").collect())
    assert [g[1] for g in got] == ["name", *(f"o{i}" for i in range(9)), "weak"] and got[0][2:] == ("not_verified", True) and got[10][2:] == ("low_confidence", False)
    assert sum(g[3] for g in got) == 8


def test_a_failed_report_leaves_the_others(spark):
    ok = lambda: spark.createDataFrame([("active", 2)], "status string, n long")
    late = lambda: ok().withColumn("n", F.raise_error(F.lit("broken")).cast("long"))
    got = C.collected_status(spark, {"a": late, "b": ok, "c": lambda: spark.table("not_there")}).collect()
    assert [tuple(r) for r in got] == [("a", "unavailable", None), ("b", "active", 2), ("c", "unavailable", None)]
    over = spark.createDataFrame([(3,), (4,), (None,)], "w int").select(C.over_retention(F.col("w"), 2).alias("o")).collect()
    assert [r.o for r in over] == [False, True, False]


def test_late_rows_are_dropped_and_closed_windows_written_once(spark, tmp_path):
    def put(name, rows):
        d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in order of their times

    put("a", [(1, "2024-01-01 00:10:00", 1, "x"), (2, "2024-01-01 01:50:00", 1, "x"), (3, "2024-01-01 05:00:00", 1, "x")])
    put("b", [(4, "2024-01-01 00:20:00", 1, "x"), (5, "2024-01-01 09:00:00", 1, "x")])
    put("c", [(6, "2024-01-01 00:30:00", 1, "x"), (7, "2024-01-01 08:20:00", 1, "x"), (8, "2024-01-01 12:00:00", 1, "x")])
    stream = lambda: spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("value", F.lit(1.0))
    got = sorted((r.hour.hour, r.n) for r in S.drained(S.hourly(stream()), "append").collect())
    # Event 4 comes in the micro-batch in which its hour is closed, and is still taken; 6 comes after that; 12:00 is still open.
    assert got == [(0, 2), (1, 1), (5, 1), (8, 1), (9, 1)]
    got = sorted((r.start.hour, r.start.minute, r.n) for r in S.drained(S.sessions(stream()), "append").collect())
    assert got == [(0, 10, 2), (1, 50, 1), (5, 0, 1), (8, 20, 1), (9, 0, 1)]


def test_progress_skips_what_will_not_run(spark):
    n = spark.createDataFrame([(1, 0, "a", 1.0, False), (1, 1, "b", 5.0, True), (1, 2, "c", 3.0, False), (2, 0, "a", 0.0, False)], "run int, position int, node string, weight double, skipped boolean")
    assert sorted(tuple(r) for r in C.checkpoints(n, "run", 0.0, 0.4).collect()) == [(1, "a", 0.1), (1, "c", 0.4), (2, "a", 0.0)]


def test_roles_and_judgements(spark):
    m = spark.createDataFrame([(1, 1, "x", 0.9, " "), (1, 2, "y", 0.5, "w"), (1, 3, "z", 0.5, "w"), (1, 4, "v", None, "w"), (2, 5, "u", 0.9, None)], "u int, match_id int, title string, score double, why string")
    assert [tuple(r) for r in C.suggested_role(m, "u").collect()] == [(1, "y", 0.5, "w")]
    table = [("grounded", None, None, None, "grounded"), ("adjudicate", True, True, False, "adjudicated"), ("adjudicate", True, False, False, "dropped"), ("adjudicate", None, True, False, "dropped"), ("dropped", True, True, False, "dropped"), ("dropped", None, None, True, "human")]
    d = spark.createDataFrame(table, "m string, j boolean, q boolean, s boolean, want string")
    assert all(r.got == r.want for r in d.withColumn("got", C.judged_method(F.col("m"), F.col("j"), F.col("q"), F.col("s"))).collect())


def test_pages(spark):
    html = "<header>top</header><nav><a href='/x'>menu</a></nav><p>One</p><svg><text>pic</text></svg><footer>end</footer><p>Two &amp; three</p>" + "<script>no</script>"
    d = spark.createDataFrame([(1, "http://a.b/c", html), (2, "http://a.b/d", None), (3, None, "x" * 30_000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in P.readable(d).collect()}
    assert got[1] == "One\nTwo & three" and got[2] == "" and len(got[3]) == P.MAX_PAGE_CHARS
    times = spark.createDataFrame([("2026-07-19T11:01:31+04:00",), ("2026-07-19T07:01:31",), ("2026-07-19T07:01:31Z",), ("yesterday",), ("",), (None,)], "t string")
    got = [r.x for r in times.select(F.unix_timestamp(P.message_time(F.col("t"))).alias("x")).collect()]
    assert got[0] == got[1] == got[2] and got[0] is not None and got[3:] == [None] * 3
    links = F.array(F.lit("#top"), F.lit("mailto:a@b.c"), F.lit("http://B.com/x?utm_source=t"), F.lit("/rel"), F.lit("https://b.com/x"), F.lit("https://c.com/y"))
    got = spark.range(1).select(P.outbound_links(links).alias("x")).first().x
    assert len(got) == 2 and got[0].endswith("b.com/x") and got[1].endswith("c.com/y")
