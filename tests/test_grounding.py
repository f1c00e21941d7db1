"""Fuzzy grounding over whole texts against a plain loop over all windows."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.plans import catalog


def plain(a, b):
    if not a or not b or len(a) < 4:
        return 0.0
    size, step, top = len(a) + max(2, len(a) // 5), max(1, len(a) // 4), 0.0
    for i in range(0, max(1, len(b) - size + step), step):
        top = max(top, SequenceMatcher(None, b[i : i + size], a, autojunk=False).ratio())
        if top >= 0.995:
            break
    return top if top >= 0.75 else 0.0


def verdict(a, b):
    r = plain(a, b)
    return "grounded" if a and a in b else "too_short" if len(a) < 4 else "grounded" if r >= 0.92 else "adjudicate" if r >= 0.75 else "dropped"


def test_ratio_is_that_of_all_windows(spark):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choices("abcdé", k=r.randint(1, 5))) for _ in range(n))
    table = [(words(r.randint(1, 8)), words(r.randint(0, 60))) for _ in range(120)]
    late = words(900)
    table += [(late[-40:-5], late), (late[-41:-20] + "z" + late[-19:], late), (None, "a b c d"), ("abcd", None), ("abc", "abc"), ("abcd", ""), ("abcd", "ab"), ("aaaa", "aaaa" * 9), ("😀😀ab c", "x 😀😀ab d y")]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(table)], "i int, a string, b string").select("i", T.window_ratio("a", "b").alias("r")).collect()
    assert len(got) == len(table)
    for i, x in got:
        assert x == pytest.approx(plain(*table[i]), abs=1e-12), table[i]


def test_query_searches_whole_texts(spark, tmp_path):
    r = random.Random(9)
    body = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))
    rows = [(i, body(r.choice((1, 4, 12, 80, 700)))) for i in range(1, 31)] + [(31, ""), (32, ""), (33, None), (34, None), (35, "ab"), (36, "a"), (36, "a"), (38, body(2500).upper() + " ;; ")]
    spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("x").alias("s")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, text in rows:
        s = re.sub(r"\s+", " ", re.sub(r"[^\w\s@.+\-/]|_", " ", (text or "").lower())).strip()
        needle = "x" + s[len(s) // 2 + 1 :][:30] if k % 2 == 0 else s[-15:] + s[:15]
        want.append((k, round(plain(needle, s), 9), verdict(needle, s)))
    got = [(x.doc_id, round(x.ratio, 9), x.verdict) for x in catalog.QUERIES["grounding_fuzzy"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {v for _, _, v in got} >= {"grounded", "too_short"}
