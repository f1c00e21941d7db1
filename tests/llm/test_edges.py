"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import components, decontamination, html_text, line_dedup, mixing, near_dedup, passages, perfect_hash, quality, toxicity
from marketloom.llm.common import ascii_lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
WORDS = ["".join("abcdefghij"[int(c)] for c in str(1000 + i)) for i in range(4000)]


def words(n):
    return [R.choice(WORDS) for _ in range(n)]


LONG = " ".join(words(30_000))
BASE = words(200)
EDITED = list(BASE)
EDITED[100] = "changed"
ROWS = [
    (0, None, "en", "a", 0), (1, "", "en", None, 0), (2, " ".join(BASE), "en", "a", 1), (3, " ".join(BASE), "en", "b", 1), (4, " ".join(EDITED).upper(), "en", "b", 1),
    (5, LONG, "en", "a", 1), (6, "one two", "en", None, 1), (6, "one two", "en", None, 1), (7, "ONE Two", "fr", "c", 1), (8, " \t\n", None, "c", 1), (9, "Éa ß x\nShared line of text.\nend", "de", "c", 1), (10, "shared LINE of text. \nother", "de", "c", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    extra = {c: F.lit("x") for c in ("size", "key", "block", "score", "start", "word", "seed", "rep", "w", "host", "text_key", "q_words", "tox_score")}
    return d.withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_dedup(spark, docs, none):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert (got[0].n_shingles, got[0].component_id, got[0].kept) == (0, 0, True) and got[8].n_shingles == 0 and got[1].component_id == 1
    assert got[3].component_id == got[4].component_id == 2 and not got[4].kept and got[2].kept and got[2].n_shingles == 196
    assert got[7].component_id == 6 and got[6].kept and got[5].component_id == 5
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.stage(spark, docs, "")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 5, 6, 6, 8, 9, 10]


def test_near_dedup_against_all_pairs(spark):
    base = words(120)
    rows, sets = [], {}
    for i in range(90):
        w = list(base) if i % 3 else words(120)
        for _ in range(R.randrange(0, 9)):
            w[R.randrange(120)] = R.choice(WORDS)
        rows.append((i, " ".join(w)))
        sets[i] = {tuple(w[j : j + 5]) for j in range(116)}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}


def tasks_of(spark, run):
    """What run() returns, and the tasks of all its jobs."""
    sc, group = spark.sparkContext, f"tasks-{R.random()}"
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    sc.setJobGroup(group, group)
    try:
        for n, v in zip(names, ("50", "false"), strict=True):
            spark.conf.set(n, v)
        got, jobs = run(), sc.statusTracker()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in jobs.getJobIdsForGroup(group) for s in jobs.getJobInfo(j).stageIds}
        return got, sum(i.numCompletedTasks for i in map(jobs.getStageInfo, stages) if i)
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_tasks_follow_the_rows_not_the_shuffle_partitions(spark):
    # The driver remembers every task: 4 rounds on 211 partitions were 17,000 tasks for a few thousand edges.
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19], "u long, v long")
    got, tasks = tasks_of(spark, lambda: {r.node: r.component for r in components.components(edges).collect()})
    assert got == {i: i // 20 * 20 for i in range(60)}
    assert tasks < 1_500, tasks
    near = [(k * 10 + j, " ".join([*(f"w{k}x{i}" for i in range(100)), *["end"] * (j > 0)])) for k in range(5) for j in range(3)]
    got, tasks = tasks_of(spark, lambda: {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(near, "doc_id long, text string")).collect()})
    assert got == {d: d // 10 * 10 for d, _ in near}
    assert tasks < 2_000, tasks


def test_components(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n) if i % 20 != 19] + [(5, 5), (1, 0)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == i // 20 * 20 for i in got) and len(got) == n
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(BASE[50:80])), (2, "one-two"), (3, None), (4, "..."), (5, "nothing here at all"), (6, "ONE two")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert (got[2].n_hit, got[2].items, [tuple(s) for s in got[2].spans]) == (30, ["1"], [(50, 80)]) and got[4].n_hit == 30
    assert (got[6].n_hit, got[6].items, got[6].n_words) == (2, ["2", "6"], 2) and got[0].n_words == 0 and got[5].n_hit == 0
    assert decontamination.contamination(none, bench).count() == 0 and decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(docs, bench).count() == len(ROWS)


def test_decontamination_against_windows(spark):
    pool = [f"v{i}" for i in range(12)]
    ds = [(i, " ".join(R.choice(pool) for _ in range(R.randrange(0, 60)))) for i in range(60)]
    items = [(i, " ".join(R.choice(pool) for _ in range(R.choice([2, 3, 12, 13, 14, 30])))) for i in range(25)]
    items += [(100 + i, " ".join(ds[i][1].split()[3:25])) for i in range(12)]
    want = {}
    for i, t in ds:
        w, hit, ids = t.split(), set(), set()
        for k, u in items:
            b = u.split()
            n = min(13, len(b))
            win = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in win:
                    hit |= set(range(j, j + n))
                    ids.add(str(k))
        want[i] = (len(hit), sorted(ids))
    got = decontamination.contamination(spark.createDataFrame(ds, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, r.items) for r in got} == want


def test_toxicity(spark, docs, none):
    rows, labels = [], []
    for i in range(400):
        w, bad = words(30), i % 5 == 0
        if bad:
            w[R.randrange(30)], w[R.randrange(30)] = R.choice(["zorg", "blim"]), "quax" + R.choice("abcdefgh")
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    g = toxicity.learn(d, lab)
    assert "quax" in {s[:4] for s in g.starts}
    got = {r.doc_id: (r.tox_score >= 0.5) for r in toxicity.score(d, g).collect()}
    wrong = sum(got[i] != bool(t) for i, t in labels)
    assert wrong <= 4
    s = toxicity.score(docs, g)
    assert s.count() == len(ROWS) and s.filter("tox_score is null or tox_score >= 0.5").count() == 0 and toxicity.score(none, g).count() == 0
    assert toxicity.score(docs, toxicity.learn(d, lab.limit(0))).filter("tox_score >= 0.5").count() == 0


def test_grammar_scales_matches():
    g = toxicity.Grammar({"idiot": 1.0, "scum*": 1.0})
    score = g.score
    assert score("you idiot") > score("an idiot came") > 0.5 > score("he said an idiot came") > score("nothing here. all fine")
    assert score("not an idiot") < 0.5 and score("idiot. not here") > 0.5 and score("idiot, the one who came to you") == score("an idiot came")
    assert score("i will kill you") > 0.5 and max(map(score, ("kill the process", "i will not kill you", "he said i will kill you"))) < 0.5 < score("scummy. idiot")
    assert g.events("not one of the scummy, an idiot you know")[:2] == [1.0, 1.0]  # the second stands beyond the negation's reach


def test_composition_is_one_transducer_after_the_other():
    steps = [toxicity.scope()]
    steps.append(toxicity.aim(steps[0].written()))
    steps.append(toxicity.threat(steps[0].then(steps[1]).written()))
    whole = toxicity.composed()
    for _ in range(300):
        state, states = whole.start, [t.start for t in steps]
        for _ in range(25):
            symbol = x = R.choice(list(toxicity.SYMBOLS))
            for i, t in enumerate(steps):
                states[i], x = t.arcs[states[i], x]
            state, out = whole.arcs[state, symbol]
            assert out == x


def test_toxicity_is_in_the_clause_not_in_the_word(spark):
    """Rows whose label the insult's presence alone gives wrongly: denied and reported insults are not toxic, threats without insults are."""
    rows, labels = [], []
    for i in range(900):
        w, bad = words(12), i % 3 == 0
        insult = R.choice(["zorg", "quaxly", "blimmer"])
        said = f"you {insult}" if i % 2 else insult
        if not bad:
            said = [f"not {said}", f"he said {said}", "kill time"][i // 3 % 3]
        at = R.randrange(4, 12)
        rows.append((i, " ".join(w[:at]) + ". " + " ".join(w[:2]) + " " + said + " " + " ".join(w[at:]) + "."))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    g = toxicity.learn(d, lab)
    got = {r.doc_id: r.tox_score >= 0.5 for r in toxicity.score(d, g).filter("tox_held_out").collect()}
    assert len(got) > 100 and sum(got[i] != bool(labels[i][1]) for i in got) <= len(got) // 50
    present = sum(any(g.insult(t) for t in rows[i][1].split()) != bool(labels[i][1]) for i in got)
    assert present > len(got) // 4  # what the words alone would get wrong


def test_stages_with_clashing_columns(spark, tmp_path):
    from marketloom.llm import token_records

    names = ("gone_id", "gone_1", "bad_id", "bad_key", "mix_foo", "mix_size", "MIX_copies", "tox_foo", "tox_score", "t1", "node", "rep", "start", "n_tokens", "mixing_key", "id", "h1")
    rows = [(i, " ".join(words(30)), "en", "ab"[i % 2], 1) for i in range(30)] + [(None, None, None, None, None), (3, "", None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in names})
    place = f"file://{tmp_path}"
    d.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    for stage, left in ((toxicity.stage, 32), (near_dedup.stage, 32), (decontamination.stage, 31), (mixing.stage, None)):
        for x, n in ((d, left), (d.limit(0), 0)):
            out = stage(spark, x, place)
            got = out.collect()
            assert out.columns == d.columns and all(r[c] == c for r in got for c in names) and n in (None, len(got))
    assert token_records.stage(spark, d, place).count() == 32


def test_near_dedup_judges_rows_that_share_an_id_by_their_own_text(spark):
    base = words(100)
    near = base[:50] + ["changed"] + base[51:]
    d = spark.createDataFrame([(4, " ".join(base)), (5, " ".join(near)), (5, " ".join(words(80))), (6, "a b"), (6, "c d")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect())
    assert got == [(4, 96, 4, True), (5, 76, 5, True), (5, 96, 4, False), (6, 1, 6, True), (6, 1, 6, True)]
    assert sorted(r.text for r in near_dedup.stage(spark, d, "").collect()) == sorted([d.collect()[0].text, d.collect()[2].text, "a b", "c d"])


def test_quality(spark, docs, none):
    rows = [(1, "\n".join([" ".join(BASE) + ".", "Home | About | Contact", "MENU ITEM TWO THREE FOUR", "All rights reserved by them."])), (2, "% " * 200 + " ".join(BASE)), (3, "a b c a b c a b c " * 10), (4, "x y z w x y z")]
    got = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].q_kept and got[1].q_clean_text == " ".join(BASE) + "." and got[1].q_lost_words == 15
    assert not got[2].q_kept and not got[2].q_base_failed and got[3].q_base_failed and got[3].q_repeat_words == 90
    assert got[4].q_repeat_words == 6
    q = quality.clean(docs)
    assert q.count() == len(ROWS) and quality.clean(none).count() == 0 and q.filter("doc_id = 0").first().q_words == 0
    assert q.filter("doc_id = 5").first().q_words == 30_000


def test_mixing(spark, docs, none):
    rows = [(i, " ".join(["w"] * R.randrange(0, 20)), None, s, 0) for i in range(3000) for s in [("a" if i % 2 else "b" if i % 3 else "c" if i % 5 else None)]]
    d = spark.createDataFrame(rows, SCHEMA)
    m = mixing.mix(d).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in m:
        size[r.source] += r.mix_size
        taken[r.source] += r.mix_size * r.mix_copies
        target[r.source] = r.mix_target
        assert 0 <= r.mix_copies <= 3
    assert all(abs(taken[s] - target[s]) <= 20 and target[s] <= 3 * size[s] for s in size) and abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert {(r.doc_id, r.mix_copies) for r in mixing.mix(d).collect()} == {(r.doc_id, r.mix_copies) for r in m}
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(none).count() == 0
    out = mixing.stage(spark, d, "")
    assert out.columns == d.columns and Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.mix_copies for r in m if r.mix_copies})


def test_line_dedup(spark, docs, none):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[9].kept_text == ROWS[10][1] and got[10].kept_text == "other" and (got[10].n_lines, got[10].n_dropped) == (2, 1)
    assert (got[0].n_lines, got[0].kept_sha256) == (1, hashlib.sha256(b"").hexdigest()) and got[2].n_dropped == 0 and got[3].n_dropped == 1
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_lines(docs, shard_keys=1).filter("n_dropped > 0").count() == 2


def test_perfect_hash():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 5000, np.uint64), r.integers(0, 2**63, 5000, np.uint64)
    h = perfect_hash.build(a, b)
    assert sorted(perfect_hash.find(h, a, b).tolist()) == list(range(5000))
    assert perfect_hash.find(perfect_hash.build(a[:0], b[:0]), a, b).max() == -1
    assert (line_dedup.shard_numbers(a[:0], 3)).size == 0


def test_shards_as_spark_deals(spark):
    import numpy as np

    d = spark.range(-50, 50).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("s")).toPandas()
    assert line_dedup.shard_numbers(d["id"].to_numpy().view(np.uint64), 7).tolist() == d["s"].tolist()


def test_html(spark):
    nav = '<div class="box"><p>Site wide words</p></div>'
    page = lambda i, body: (i, f"http://h.example/{i}", f"<html><body>{nav}{body}</body></html>")
    rows = [page(i, f"<p>Own text number {i} &amp; more</p><footer>f</footer>") for i in range(6)] + [(90, None, None), (91, "http://o.example/", ""), (92, "x", "<article><header>h</header><h1>T</h1><p>a<b>b</b>\n c<p>d<ul><li>e</ul><div class='comments'>no</div><script>1</script></article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()}
    assert got[3] == "Own text number 3 & more" and got[90] == got[91] == "" and got[92] == "T\nab c\nd\ne"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_by_place_and_count(spark):
    """Near copies of an article keep its list and table; what few pages of a large host repeat outside it goes."""
    ul, side = "<ul><li>first point</ul><table><tr><td>cell</table>", "<div><p>rare words</p></div>"
    rows = [(i, f"http://n.example/{i}", f"<body>{side}<article><p>Copy {i} of a text</p>{ul}</article></body>") for i in range(3)]
    rows += [(10 + i, "http://l.example/", f"<body>{side if i < 3 else ''}<p>Own text {i}</p></body>") for i in range(300)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [f"Copy {i} of a text\nfirst point\ncell" for i in range(3)]
    assert all(got[10 + i] == f"Own text {i}" for i in range(300))


def test_html_only_templates_tell(spark):
    """On a host with pages to count on, what recurs goes by its hash, inside and outside articles; slots that rotate go by their kind."""
    rows, want = [], {}
    for i in range(200):
        own = [f"Own paragraph {i} {' '.join(words(20))}", "A line that articles share."]
        box = f"<div><p>Read our terms number {i % 4}</p></div>"
        slot = f'<div class="zone"><p>Today: offer {i // 2 if i > 120 else i % 7}</p></div>'
        body = f"<article><p>{own[0]}</p>{box}<p>{own[1]}</p></article>" if i % 2 else f"{box}<p>{own[0]}</p><p>{own[1]}</p>"
        rows.append((i, f"http://u.example/{i}", f"<body><div><b>Site</b> words</div>{body}{slot}<div><p>Signed, {i}</p></div></body>"))
        want[i] = "\n".join([*own, f"Signed, {i}"])
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_subtree_counts_against_brute_force(spark):
    rows = []
    for i in range(60):
        parts = [f"<div class='k{k}'><ul><li>{k} {R.randrange(3)}</ul></div>" for k in R.sample(range(6), 3)]
        rows.append((i, f"http://{'ab'[i % 2]}.example/{i}", f"<body>{''.join(parts)}<p>{' '.join(words(40))}</p></body>"))
    rows += [(100 + i, f"http://a.example/{100 + i}", rows[0][2]) for i in range(5)]  # copies count once
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(d, min_pages=3, host_pages=10).collect()}
    seen = defaultdict(set)
    pages = {i: html_text.Page(h) for i, _, h in rows}
    for i, url, h in rows:
        for _, hash_, _, _ in pages[i].subtrees():
            seen[url[:12], hash_].add(h)
    for i, url, _ in rows:
        gone = {h for _, h, _, _ in pages[i].subtrees() if len(seen[url[:12], h]) >= 3}
        assert got[i] in (pages[i].main_text(gone, set(), True), pages[i].main_text(gone, {k for _, _, k, _ in pages[i].subtrees()}, True))


def test_html_is_linear_in_nesting_and_stray_tags():
    import time

    def took(n):
        start = time.process_time()
        page = html_text.Page("<div>" * n + "x" + "</div>" * n + "</p></b>" * n)
        list(page.subtrees()), page.root(), page.main_text(set(), set(), True)
        return time.process_time() - start

    took(500)
    assert took(40_000) < 25 * max(took(4_000), 0.02)


def test_passages(spark, docs, none):
    p = words(60)
    fuzzy = list(p)
    fuzzy[20], fuzzy[40] = "changed", "altered"
    rows = [(1, words(100) + p + words(50)), (2, words(10) + fuzzy + words(80)), (3, words(150)), (4, words(5) + p), (5, words(40) + p[:15] + words(60))]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(d).collect()}
    assert got[1].class_id == got[2].class_id == got[4].class_id == 1 and got[3].class_id == 3 and got[5].class_id == 5
    assert got[4].n_repeat_words == 60 and got[2].n_repeat_words == 60 and got[2].refs == [1] and got[1].n_links == 2 and got[1].n_repeat_words == 0
    assert [tuple(s) for s in got[4].spans] == [(5, 65, 1, 100, 160), (5, 65, 2, 10, 70)]
    e = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert e[3].class_id == e[4].class_id == 2 and e[3].n_repeat_words == 200 and e[0].n_words == 0 and e[5].class_id == 5
    assert passages.repeated_passages(none).count() == 0


def test_passages_whose_first_holders_have_a_part(spark):
    """Two documents share 60 words; earlier ones hold parts of under 50, so do texts within the same document."""
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for trial in range(80):
        p, n, at = fresh(60), 41 + trial % 9, 10 * trial
        if trial % 4 == 3:  # the part stands in the second holder itself, before the whole
            parts, inside = [], fresh(5) + p[:n]
        else:
            parts, inside = [p[:n], p[60 - n :]][: 1 + trial % 2], []
        rows += [(at + i, fresh(30) + x + fresh(30)) for i, x in enumerate(parts)]
        rows += [(at + 5, inside + fresh(30) + p + fresh(20)), (at + 6, fresh(25) + p + fresh(40))]
    runs = [{tuple(w[j : j + 50]): j for j in range(len(w) - 49)} for _, w in rows]
    want = {}
    for i, (doc, w) in enumerate(rows):
        near = range(max(0, i - 4), i)
        hit = {q for k in near for g, j in runs[i].items() if g in runs[k] for q in range(j, j + 50)}
        want[doc] = (len(hit), [rows[k][0] for k in near if not runs[k].keys().isdisjoint(runs[i])])
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {x.doc_id: (x.n_repeat_words, x.refs) for x in passages.repeated_passages(d).collect()}
    assert got == want and sum(n == 60 for n, _ in want.values()) == 80


def test_passages_behind_many_part_holders(spark):
    """Edited passages whose every seed has a part holder first and another just before: linked all the same, beside no others."""
    import random

    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for case in range(8):
        p, base = words(100), 100 * case
        parts = [words(60) + p[a : a + 34] + words(60) for _ in range(2) for a in (0, 33, 66)]
        edited = [f"x{base}y{i}" if i % 15 == 7 else w for i, w in enumerate(p)]
        texts = [*parts[:3], words(30) + p + words(30), *parts[3:], words(30) + edited + words(30)]
        rows += [(base + i, " ".join(t)) for i, t in enumerate(texts)]
        want.add((base + 7, base + 3))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(x.doc_id, ref) for x in got for ref in x.refs} == want
    assert all(x.n_repeat_words >= 90 and x.class_id == x.doc_id - 4 for x in got if x.doc_id % 100 == 7)


def test_passages_beside_lines_that_many_share(spark, monkeypatch):
    """Two lines that all documents share, of 14 and 32 words, cost no text a pair, the short one no pair; an edited passage around each is found."""
    r = random.Random(29)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    short, long = fresh(14), fresh(32)
    around = {k: (fresh(25), fresh(25)) for k in ("short", "long")}
    edited = lambda w: [fresh(1)[0] if i % 9 == 4 else x for i, x in enumerate(w)]
    rows = [(i, fresh(40) + (short if i % 2 else long) + fresh(40)) for i in range(80)]
    for at, (k, line) in ((20, ("short", short)), (60, ("short", short)), (21, ("long", long)), (61, ("long", long))):
        x, y = around[k]
        rows[at] = at, fresh(40) + (x + line + y if at < 40 else edited(x) + line + edited(y)) + fresh(40)
    dealt, pairs, settled, cut = [], [], passages.settled, passages.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["doc", "ref"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(passages, "settled", lambda d, f: dealt.append(f.count()) or settled(d, f))
    monkeypatch.setattr(passages, "cut", counted)
    found = {(x.doc, x.ref) for x in passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc long, text string").withColumnRenamed("doc", "doc_id")).collect()}
    assert found == {(60, 20), (61, 21)} and dealt[1] <= 4
    assert pairs[0] <= 40 * 39 / 2 + 4  # of the long line alone


def test_passages_that_part_holders_surround(spark):
    """Edited passages between documents that hold a part of them: planted pairs, recall 0.9 at one word in ten changed, and no link beside them."""
    r = random.Random(23)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], set()
    for trial in range(50):
        p, at = fresh(64), 10 * trial
        q = [w if r.random() > 0.1 else fresh(1)[0] for w in p]
        parts = [(0, p[:30]), (1, p[34:]), (4, p[16:46])][: trial % 4]
        rows += [(at + i, fresh(20) + x + fresh(20)) for i, x in parts]
        rows += [(at + 2, fresh(30) + p + fresh(20)), (at + 6, fresh(25) + q + fresh(40))]
        planted.add((at + 6, at + 2))
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    found = {(x.doc_id, ref) for x in got for ref in x.refs}
    # Brute force over all pairs: what can be linked at all holds a word in common.
    sets = {i: set(w) for i, w in rows}
    may = {(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= passages.MIN_WORDS * passages.MIN_EQUAL}
    assert len(planted & found) >= 0.9 * len(planted) and found <= may


def test_stretches_cover_all_runs():
    n = passages.MIN_WORDS
    for _ in range(300):
        pts = sorted({(x, x + R.choice([0, 7, -x])) for x in (R.randrange(300) for _ in range(R.randrange(1, 40)))})
        x, y = (passages.np.array(v) for v in zip(*pts, strict=True))
        got = passages.stretches(x, y)
        assert {q for a, _, k in got for q in range(a, a + k)} == {q for a, _ in pts for q in range(a, a + n)}
        assert all((a + j, b + j) in pts for a, b, k in got for j in range(k - n + 1))


def test_chain_is_the_best(spark):
    for _ in range(30):
        n = R.randrange(1, 9)
        pts = sorted({(R.randrange(40), R.randrange(40)) for _ in range(n)})
        x, y = [a for a, _ in pts], [b for _, b in pts]

        def value(chain):
            s = float(passages.K)
            for a, b in zip(chain, chain[1:]):
                dx, dy = x[b] - x[a], y[b] - y[a]
                if dx <= 0 or dy <= 0:
                    return -1e9
                s += min(passages.K, dx, dy) - passages.GAP_COST * (dx + dy)
            return s

        every = [[i for i in range(len(pts)) if m >> i & 1] for m in range(1, 1 << len(pts))]
        best = passages.best_chain(x, y)
        # The search drops what own coverage lies beyond the nearest predecessor, so it may miss a little of the optimum.
        assert value(best) >= max(map(value, every)) - passages.K


def test_ascii_lower(spark):
    assert spark.range(1).select(ascii_lower(F.lit("AÉZß")).alias("x")).first().x == "aÉzß"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(words(80)), "en", "ab"[i % 2], 1) for i in range(40)] + [(100, "zorg " * 3, "en", "a", 1)]
    rows += [(200, rows[0][1], "en", "a", 1)]
    place = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[:40]))], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    out = [r.doc_id for r in corpus_pipeline.run(spark, place).collect()]
    assert 200 not in out and 5 not in out and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_records"]
    seen = defaultdict(int)
    for i in out:
        seen[i] += 1
    assert max(seen.values()) <= 3
