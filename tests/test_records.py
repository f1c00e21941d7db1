"""Truth tables of the record operators."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import gap as G
from marketloom.operators import records as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_spans_stand_on_edges(spark):
    table = [("java", "javascript and c", False), ("java", "knows java.", True), ("bank muscat", "at bank muscat head office", True), ("3.1", "gpa 3.10", False), ("a", "", False), ("", "a", False), ("x+", "x+-y", True), ("(", "(", True)]
    d = spark.createDataFrame(table, "n string, s string, want boolean")
    assert all(r.got == r.want for r in d.withColumn("got", X.contains_span(F.col("n"), F.col("s"))).collect())


def test_tiers(spark):
    no, yes = F.lit(False), F.lit(True)
    tier = lambda *a: one(spark, G.tier(*a))
    assert tier(yes, no, no, F.lit(0.0), no) == "matched" and tier(yes, no, no, F.lit(0.0), yes) == "possible_match"
    assert tier(no, no, no, F.lit(0.8), no) == "matched" and tier(no, no, no, F.lit(0.6), no) == "possible_match" and tier(no, no, no, F.lit(0.59), no) == "missing"


def test_sections_become_chunks(spark):
    text = "# My title\nOpening\n## One\n" + "a" * 30 + "\n\n" + "b" * 30 + "\n## Two\nend\n\n\n"
    assert one(spark, X.sectioned_chunks(F.lit(text), F.lit("x-y"), 50)) == [f"My title\n\n{p}" for p in ("Opening", "## One\n" + "a" * 30, "b" * 30, "## Two\nend")]
    assert one(spark, X.sectioned_chunks(F.lit("plain"), F.lit("x-y"))) == ["x y\n\nplain"]


def test_signals_quote_what_is_there(spark):
    s = lambda text, title, company: one(spark, X.structural_signals(F.lit(text), F.lit(title), F.lit(company).cast("string"), r"wa\.me/\d+", r"\S+@\S+", "https?://", r"(?i)duties", r"\d+ vacancies"))
    assert [x.code for x in s("call wa.me/123", "15 vacancies", None)] == ["whatsapp_only_contact", "no_employer_named", "contact_only_no_role", "mass_vacancy_no_detail"]
    assert [x.evidence for x in s("call wa.me/123", "15 vacancies", "Co")] == ["wa.me/123", None, "15 vacancies"]
    assert s("Duties: cooking. wa.me/1 a@b.c", "", "Co") == [] and [x.code for x in s("x" * 130, "", "Co")] == ["no_role_described"]
    bad = F.array(F.struct(F.lit("c").alias("code"), F.lit(0.1).alias("weight"), F.lit("absent").alias("evidence")))
    assert not one(spark, X.auditable(bad, F.lit("text"))) and one(spark, X.auditable(bad, F.lit("is absent here")))


def test_signals_equal_their_sql(spark, tmp_path):
    """Letters beside a word that are not ASCII's, folds beyond ASCII, spaces of all kinds, empty and null values."""
    import duckdb

    from marketloom.plans import catalog

    texts = ["él les", "éles " * 30, "lesé", "ilesé", "leſ", "leſx", "ANDñ", "x_and", "\u0661\u0662 ads", "é12 ads.", "12 adſ ", "\u00a0" * 130, "\u2003" + "x" * 119 + "\u00a0", "\t" + "x" * 118 + "\n", "x" * 119 + "\u00a0\n", "+123456 \u00e9@b https:/", "", None]
    rows = [(3 * i + k, x, (" ", "\u00a0", "web", None)[i % 4]) for i, x in enumerate(texts) for k in (0, 1, 2)] + [(1000 + 4 * i, "x", c) for i, c in enumerate((" ", "\u00a0\u3000", "\t", "web", None))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["structural_signals"](spark, str(tmp_path)).select("doc_id", "auditable", "codes").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(c.execute(catalog.SQL["structural_signals"]).fetchall()) and len(got) == len(rows)


def test_small_rules(spark):
    assert [one(spark, X.quantised(F.lit(v))) for v in (0.25, 0.35, 0.36, 0.0)] == [-2.0, -3.0, -4.0, 0.0]
    assert one(spark, X.title_cased(F.lit("apis-and-the-web-of-html"))) == "APIs and the Web of HTML"
    assert [one(spark, X.handle(F.lit(h))) for h in ("@Jobs_Oman", "https://t.me/s/jobs_oman?before=3", "ab", "1jobs")] == ["jobs_oman", "jobs_oman", None, None]
    assert one(spark, X.cleaned_skills(F.array(*map(F.lit, (" SQL", "sql", "N/A", "", "Go"))))) == ["SQL", "Go"] and one(spark, X.split_list(F.lit("a, b;;c "))) == ["a", "b", "c"]
    assert one(spark, X.enough_text(F.lit(None).cast("string"), F.lit("short"))) == "insufficient_text" and one(spark, X.enough_text(F.lit("x" * 30), F.lit(None).cast("string"))) is None
    assert one(spark, X.in_scope(F.lit(None).cast("string"), F.lit(None).cast("string"), ("om",))) and not one(spark, X.in_scope(F.lit("ae"), F.lit("om"), ("om",)))
    assert [one(spark, X.price_label(F.lit(a).cast("double"), F.lit("USD"), F.lit(f))) for a, f in ((None, False), (0.0, False), (9.6, False), (9.6, True))] == ["Price not stated", "Free", "USD 10", "Free"]
    assert X.limited(spark.range(5), None).count() == 5 and X.limited(spark.range(5), 2).count() == 2
    now = F.lit("2026-01-01 10:31:00").cast("timestamp")
    assert [one(spark, X.run_stage(F.lit(s), F.lit("2026-01-01 10:00:00").cast("timestamp"), now)) for s in ("gap", "done")] == ["stale", "done"]


def test_updates_of_other_columns_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    assert X.updated(rows, rows.select("id", F.lit(None).cast("string").alias("x")), "id", ("x",)).first() == (1, None, "b")
    with pytest.raises(ValueError):
        X.updated(rows, rows, "id", ("x",))


def test_lines_go_from_their_head(spark):
    """Each block is near the one before, but the third is too far from the head."""
    b = spark.createDataFrame([(1, float(t), float(l), 10.0, n) for n, (t, l) in enumerate([(0, 5), (5, 1), (10, 3), (40, 0)])], "page int, top double, left double, height double, n int")
    assert [(r.n, r.line) for r in X.line_numbers(b, "page", ["n"]).orderBy("place").collect()] == [(1, 0), (0, 0), (2, 1), (3, 2)]


def test_lists_merge_by_what_was_not_seen(spark):
    s = lambda *ids: F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("k")) for i, k in ids])
    got = one(spark, X.not_seen(s((1, "a"), (2, "a")), s((3, "a"), (4, "b"), (5, "b")), lambda x: x["k"]))
    assert [x.id for x in got] == [1, 2, 4]
