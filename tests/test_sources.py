import json

from pyspark.sql import functions as F

from marketloom.functions.leaves import Leaves
from marketloom.operators import checks
from marketloom.sources import files as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_taxonomy(spark, tmp_path):
    p = write(tmp_path / "t.csv", '﻿conceptType,conceptUri,skillType,preferredLabel,altLabels\nK,u/1,skill,Manage time,"prioritise tasks\ntime planning"\nK,,skill,x,\nK,u/2,skill,,\n')
    t = S.taxonomy_csv(spark, p)
    assert [(r.uri, r.label, r.alt_labels) for r in t.collect()] == [("u/1", "Manage time", ["prioritise tasks", "time planning"])]
    assert {(r.label_key, r.is_preferred) for r in S.taxonomy_labels(t).collect()} == {("manage time", True), ("prioritise tasks", False), ("time planning", False)}


def test_atom(spark, tmp_path):
    e = '<entry><id>1</id><published>{}T10:00:00Z</published><title>t</title><content>x</content><category term="a"/><link rel="self" href="s"/><link rel="alternate" href="https://h/2024/01/p.html"/></entry>'
    p = write(tmp_path / "f.xml", "<feed>" + e.format("2024-01-02") + e.format("2020-01-02") + "</feed>")
    assert [(r.url, r.categories) for r in S.atom_feed(spark, p, "2023-01-01").collect()] == [("https://h/2024/01/p.html", ["a"])]


def test_catalogue_and_curriculum(spark, tmp_path):
    c = {"elements": [{"id": "1", "slug": "a", "name": "A", "partnerIds": ["p"], "primaryLanguages": ["en"]}, {"id": "2", "slug": "b", "name": "B", "primaryLanguages": ["fr"]}, {"id": "3", "slug": " ", "name": "C"}], "linked": {"partners.v1": [{"id": "p", "name": "P"}]}}
    assert [(r.course_id, r.provider) for r in S.catalogue_json(spark, write(tmp_path / "c.json", json.dumps(c))).collect()] == [("1", "P")]
    m = {"x": {"title": "X", "intro": ["i", "j"], "blocks": {"b": {"title": "B", "intro": ["k"]}}}, "y": {"title": None, "blocks": {}}}
    got = {(r.kind, r.slug, r.text) for r in S.curriculum_json(spark, write(tmp_path / "m.json", json.dumps(m))).collect()}
    assert got == {("course", "x", "i\nj"), ("block", "x/b", "k")}


def test_job_postings(spark):
    job = lambda lo, hi: '<script type="application/ld+json">' + json.dumps({"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "O"}, "jobLocation": {"address": {"addressLocality": "M", "addressRegion": "M"}}, "baseSalary": {"currency": "OMR", "value": {"minValue": lo, "maxValue": hi}}, "datePosted": "2024-01-02T00:00"}) + "</script>"
    d = spark.createDataFrame([("a", job(1, 2)), ("b", job(3, 2)), ("c", "none")], "url string, html string")
    got = {r.url: r for r in S.job_postings(d).collect()}
    assert (got["a"].salary_min, got["a"].currency, got["a"].location, str(got["a"].posted)) == (1.0, "OMR", "M", "2024-01-02")
    assert got["b"].salary_min is None and got["b"].currency is None and "c" not in got


def test_documents_decoding_roundups(spark, tmp_path):
    write(tmp_path / "k/one.en.md", "# Title\n\ntext")
    write(tmp_path / "k/note.md", "x")
    assert [(r.slug, r.locale, r.title) for r in S.documents(spark, f"file://{tmp_path}/k").collect()] == [("one", "en", "Title")]
    d = spark.createDataFrame([(bytearray("é".encode()), None), (bytearray("سلام".encode("windows-1256")), None)], "b binary, c string")
    assert [r[0] for r in d.select(S.decoded(F.col("b"), F.col("c"))).collect()] == ["é", "سلام"]
    posts = spark.createDataFrame([("http://h/i", "t", "b", ["http://h/1", "http://h/2", "http://o/3"]), ("http://h/j", "t", "b", ["http://h/1"])], "url string, title string, body string, links array<string>")
    pages = spark.createDataFrame([("http://h/1", "1", "x"), ("http://h/2", "2", "y")], "url string, title string, body string")
    assert {(r.url, r.source_post) for r in S.expand_roundups(posts, pages).collect()} == {("http://h/1", "http://h/i"), ("http://h/2", "http://h/i"), ("http://h/j", None)}


def test_windows_are_replaced_whole(spark, tmp_path):
    p = f"file://{tmp_path}/w"
    S.replace_windows(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "window_end string, n int"), p)
    S.replace_windows(spark.createDataFrame([("a", 9)], "window_end string, n int"), p)
    assert {(r.window_end, r.n) for r in spark.read.parquet(p).collect()} == {("a", 9), ("b", 3)}


def test_outcomes_samples_checks_leaves(spark):
    a = spark.createDataFrame([("x", True, 3, 10), ("x", True, 10, 10), ("y", True, 1, 10), ("z", False, 1, 10)], "source string, ok boolean, n int, page_limit int")
    assert {r.source: r.may_age_inventory for r in S.scan_outcomes(a).collect()} == {"x": False, "y": True, "z": False}
    r = spark.range(100)
    assert S.sample_for_labels(r, 5).collect() == S.sample_for_labels(r, 5).collect()
    v = {x.rule: x.n for x in checks.violations(a, {"n": F.col("n") < 5, "ok": F.col("ok")}).collect()}
    assert v == {"n": 1, "ok": 1}
    assert checks.duplicates(a, ["source"]).count() == 1 and checks.orphans(a, a.filter("source = 'x'"), "source", "source").count() == 2
    got = {tuple(x) for x in Leaves(F.lit(json.dumps({"a": {"b": ["x", {"c": "y"}], "category": "z"}, "d": 1}))).collect()}
    assert got == {("a.b[0]", "x"), ("a.b[1].c", "y")}
