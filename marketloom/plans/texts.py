"""Text, rule and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import pages as P
from ..sources.domain import COURSES_SQL, courses, table
from .registry import query

RISK_SQL = """r AS (SELECT doc_id, least(0.999999, round(1 - product(1 - w), 6)) AS risk FROM (
  SELECT doc_id, unnest([0.0, CASE WHEN regexp_matches(text, '(?i)whatsapp|@') THEN 0.35 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)registration fee|license') THEN 0.5 ELSE 0 END,
    CASE WHEN contains(text, '!!') THEN 0.3 ELSE 0 END, CASE WHEN regexp_matches(text, '[%$#&*]{3}') THEN 0.25 ELSE 0 END, CASE WHEN regexp_matches(text, 'https?://') THEN 0.2 ELSE 0 END])::DOUBLE AS w FROM documents) GROUP BY doc_id)"""


@query("risk_noisy_or", f"WITH {RISK_SQL} SELECT doc_id, risk FROM r")
def risk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.risk(F.col("text")).alias("risk"))


@query("risk_bands", f"""WITH {RISK_SQL}, b AS (SELECT CASE WHEN round(1 - risk, 6) <= 0.30 THEN 'reject' WHEN round(1 - risk, 6) <= 0.60 THEN 'adjudicate' ELSE 'clean' END AS band FROM r)
SELECT d.band, count(b.band) AS n FROM (VALUES ('clean'), ('adjudicate'), ('reject')) d(band) LEFT JOIN b ON b.band = d.band GROUP BY d.band""")
def bands(spark, sf_dir):
    score = F.round(1 - R.risk(F.col("text")), 6)
    have = table(spark, sf_dir, "documents").groupBy(R.band(score).alias("band")).agg(F.count("*").alias("c"))
    names = spark.createDataFrame([("clean",), ("adjudicate",), ("reject",)], "band string")
    return names.join(have, "band", "left").select("band", F.coalesce("c", F.lit(0).cast("long")).alias("n"))


PHRASES = {"remote": ("home", "on the", "für"), "hybrid": ("from", "sur"), "onsite": ("with", "para")}


@query("stated_facts", """WITH f AS (SELECT doc_id, list_filter([CASE WHEN contains(l, 'home') OR contains(l, 'on the') OR contains(l, 'für') THEN 'remote' END,
  CASE WHEN contains(l, 'from') OR contains(l, 'sur') THEN 'hybrid' END, CASE WHEN contains(l, 'with') OR contains(l, 'para') THEN 'onsite' END], lambda x: x IS NOT NULL) AS f FROM (SELECT doc_id, lower(text) AS l FROM documents))
SELECT doc_id, CASE WHEN len(f) = 1 THEN f[1] END AS arrangement FROM f""")
def stated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.stated_arrangement(F.col("text"), PHRASES).alias("arrangement"))


FORM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s@.+\\-/]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("grounding_fuzzy")
def fuzzy(spark, sf_dir):
    """Whole texts searched for a piece of their middle with its first letter changed, or for their end spliced to their beginning. Null as empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.grounding_form(F.col("text")), F.lit("")).alias("s"))
    d = d.repartition("doc_id")  # the search costs far more than moving the texts, so no file is one task
    middle = F.concat(F.lit("x"), F.substr("s", F.floor(F.length("s") / 2).cast("int") + 2, F.lit(30)))
    splice = F.concat(F.right("s", F.lit(15)), F.left("s", F.lit(15)))
    d = d.withColumn("needle", F.when(F.col("doc_id") % 2 == 0, middle).otherwise(splice))
    r, exact = T.window_ratio("needle", "s"), (F.col("needle") != "") & F.contains("s", "needle")
    return d.select("doc_id", r.alias("ratio"), T.grounding_verdict(exact, r, F.length("needle")).alias("verdict"))


NUM = "list_sort(list_distinct(list_transform(regexp_extract_all({}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: regexp_replace(regexp_replace(replace(x, ',', ''), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''))))"


@query("number_grounding", f"""WITH c AS (SELECT conv_id, turn, {NUM.format('text')} AS n, lag({NUM.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, array_to_string(n, ' ') AS numbers, len(list_filter(n, lambda x: NOT list_contains(coalesce(p, []), x))) AS n_ungrounded FROM c""")
def number_grounding(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.numbers(F.col("text")).alias("n"))
    c = c.withColumn("p", F.coalesce(F.lag("n").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>")))
    return c.select("conv_id", "turn", F.array_join("n", " ").alias("numbers"), F.size(F.array_except("n", "p")).cast("long").alias("n_ungrounded"))


@query("digit_fold", """SELECT item_id, translate(translate(v, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '۰۱۲۳۴۵۶۷۸۹', '0123456789') AS folded FROM (
  SELECT item_id, translate(concat_ws(' ', text, item_id * 1234567), '0123456789', '٠١٢٣٤٥۶۷۸۹') AS v FROM benchmark)""")
def digits(spark, sf_dir):
    v = F.translate(F.concat_ws(" ", "text", (F.col("item_id") * 1234567).cast("string")), T.DIGITS, "٠١٢٣٤٥۶۷۸۹")
    return table(spark, sf_dir, "benchmark").select("item_id", T.fold_digits(v).alias("folded"))


@query("text_fold")
def text_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


NAMES = "n AS (SELECT DISTINCT lower(trim(p_name)) AS k FROM part UNION SELECT DISTINCT list_extract(string_split(lower(trim(p_name)), ' '), -1) FROM part)"


@query("token_containment_join", f"""WITH {NAMES} SELECT a.k AS have, b.k AS want FROM n a JOIN n b ON a.k = b.k OR (a.k NOT IN ('engineering', 'management', 'design', 'marketing', 'software', 'data', 'ring', 'widget')
  AND b.k NOT IN ('engineering', 'management', 'design', 'marketing', 'software', 'data', 'ring', 'widget') AND (contains(' ' || a.k || ' ', ' ' || b.k || ' ') OR contains(' ' || b.k || ' ', ' ' || a.k || ' ')))""")
def containment(spark, sf_dir):
    """Containment implies a common token, so candidates come from a join on tokens and the rule settles them."""
    key = F.lower(F.trim("p_name"))
    p = table(spark, sf_dir, "part")
    n = p.select(key.alias("k")).union(p.select(F.element_at(F.split(key, " "), -1).alias("k"))).distinct()
    a = n.select(F.col("k").alias("have"), F.explode(T.tokens(F.col("k"))).alias("t"))
    b = n.select(F.col("k").alias("want"), F.explode(T.tokens(F.col("k"))).alias("t"))
    return a.join(b, "t").select("have", "want").distinct().filter(T.covers_skill(F.col("have"), F.col("want")))


@query("canonical_urls", r"""SELECT page_id, 'https://' || lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS url FROM pages""")
def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("job_link_predicate", r"""SELECT page_id, regexp_matches(url, '/[a-z]{2}/\d+') AND NOT regexp_matches(lower(url), '\.(png|jpe?g|css|js|pdf)(\?|$)') AS is_detail,
  regexp_matches(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '(^|\.)example\.(org|net)$') AS is_social FROM pages""")
def links(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", P.is_detail(u).alias("is_detail"), P.in_domains(u, ("example.org", "example.net")).alias("is_social"))


@query("html_text_links")
def html_links(spark, sf_dir):
    d = P.text_and_links(table(spark, sf_dir, "pages"))
    return d.select("page_id", F.sha2("text", 256).alias("text_sha256"), F.size("links").alias("n_links"))


@query("jsonld_courses")
def jsonld(spark, sf_dir):
    """The objects of JSON-LD blocks, as the parser finds them in whole pages, each of which is given a block at its end: those of the tables carry none."""
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Course","name":"'), F.col("page_id").cast("string"), F.lit('","offers":[{"price":10},{"price":"299"}]}]}</script>'))
    return P.json_ld(table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), ld).alias("html")), "Course").select("page_id", "name", "price")


@query("md_chunks", """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
w(doc_id, i, chunk, cur) AS (SELECT doc_id, 1, 1, ps[1] FROM p WHERE len(ps) > 0 UNION ALL
  SELECT w.doc_id, i + 1, CASE WHEN len(cur) + len(ps[i + 1]) + 2 <= 1200 THEN chunk ELSE chunk + 1 END, CASE WHEN len(cur) + len(ps[i + 1]) + 2 <= 1200 THEN cur || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END
  FROM w JOIN p ON p.doc_id = w.doc_id WHERE i < len(ps))
SELECT doc_id, chunk AS ordinal, max(len(cur)) AS n_chars, sha256(arg_max(cur, i)) AS digest FROM w GROUP BY doc_id, chunk""")
def md_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("pos", "chunk"))
    return d.select("doc_id", (F.col("pos") + 1).alias("ordinal"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


DURATIONS = (("4 weeks of study, 2-4 hours a week", 8.0, 16.0), ("6 weeks, 3 hours a week", 18.0, 18.0), ("2-4 hours", 2.0, 4.0), ("90-120 minutes", 1.5, 2.0), ("2 hours per week", None, None), ("1 hour 30 minutes", 1.5, 1.5), ("self paced", None, None))


@query("duration_parse", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {'NULL' if a is None else a}::DOUBLE, {'NULL' if b is None else b}::DOUBLE)" for s, a, b in DURATIONS) + ") t(stated, hours_min, hours_max)")
def durations(spark, sf_dir):
    d = spark.createDataFrame([(s,) for s, _, _ in DURATIONS], "stated string").withColumn("h", R.workload_hours(F.col("stated")))
    return d.select("stated", F.col("h.lo").alias("hours_min"), F.col("h.hi").alias("hours_max"))


ISO = (("PT1H30M", 1.5), ("P1DT2H", 26.0), ("P4W", None), ("PT45M", 0.75), ("x", None))


@query("iso_durations", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {'NULL' if h is None else h}::DOUBLE)" for s, h in ISO) + ") t(stated, hours)")
def iso(spark, sf_dir):
    return spark.createDataFrame([(s,) for s, _ in ISO], "stated string").withColumn("hours", R.iso_hours(F.col("stated")))


@query("title_and_slug", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
t AS (SELECT doc_id, left(coalesce(list_filter(ls, lambda x: len(x) >= 25)[1], ls[1]), 300) AS title FROM l) SELECT doc_id, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t""")
def titles(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"))
    return t.withColumn("slug", T.slug(F.col("title")))


@query("longest_token", f"""WITH {COURSES_SQL}, t AS (SELECT course_id, list_filter(regexp_split_to_array(lower(name || ' ' || p_type), '[^a-z0-9+#.]+'), lambda x: x <> '') AS ts FROM courses),
u AS (SELECT course_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM t) SELECT course_id, t AS token FROM u QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY len(t) DESC, i) = 1""")
def longest(spark, sf_dir):
    return courses(spark, sf_dir).select("course_id", T.longest_token(F.concat_ws(" ", "name", "p_type")).alias("token"))
