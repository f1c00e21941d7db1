import math
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import ctw as C


def brute(texts, train, depth):
    """The tree as nested dictionaries and plain recursion."""
    counts = {}
    for t, y in zip(texts, train):
        if not y:
            continue
        b = bytes([255] * depth) + t + b"\xff"
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                ctx, node = b[i - d : i], 1
                for s in range(7, -1, -1):
                    bit = b[i] >> s & 1
                    counts.setdefault((ctx, node), [0, 0])[bit] += 1
                    node = node * 2 + bit
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    kids = {}
    for ctx, node in counts:
        if ctx:
            kids.setdefault((ctx[1:], node), []).append((ctx, node))
    memo = {}

    def pw(k):
        if k not in memo:
            own = kt(counts[k])
            memo[k] = own if len(k[0]) == depth else np.logaddexp(own, sum(pw(c) for c in kids[k])) - math.log(2)
        return memo[k]

    def logp(t):
        total, b = 0.0, bytes([255] * depth) + t + b"\xff"
        for i in range(depth, len(b)):
            node = 1
            for s in range(7, -1, -1):
                bit, p, mass = b[i] >> s & 1, 0.0, 1.0
                for d in range(depth + 1):
                    n = counts.get((b[i - d : i], node), [0, 0])
                    est = (n[bit] + 0.5) / (sum(n) + 1)
                    deeper = d < depth and (b[i - d - 1 : i], node) in counts
                    stop = math.exp(kt(n) - math.log(2) - pw((b[i - d : i], node))) if deeper else 1.0
                    p += mass * stop * est
                    mass *= 1 - stop
                total += math.log10(p)
                node = node * 2 + bit
        return total

    return [logp(t) for t in texts]


def test_scores_equal_the_plain_tree(spark):
    texts = ["The cat sat on the mat.", "the CAT sat", "É ünï cat\ton  the mat", "", None, "zzz the cat sat on", "the cat sat on the mat."] * 2
    rows = [(i, t, i % 4 != 2, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean, score string")
    got = {r.doc_id: r for r in C.score_texts(docs, F.col("t"), depth=3).collect()}
    fold = [C.folded(t) for _, t, _, _ in rows]
    want = brute(fold, [y for _, _, y, _ in rows], 3)
    c = Counter(w for t, (_, _, y, _) in zip(fold, rows) if y for w in [*t.split(), b""])
    n, v = sum(c.values()), len(c)
    for (i, _, _, _), t, w in zip(rows, fold, want):
        toks = [*t.split(), b""]
        assert abs(got[i].score - w) < 1e-9
        assert abs(got[i].base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks)) < 1e-9
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(toks), sum(c[x] > 0 for x in toks), n)


def test_probabilities_sum_to_one():
    g, _ = C.grams_of([b"abracadabra", b"abba"], 2)
    u, n = np.unique(g, return_counts=True)
    low = C.levels(u, n, 2, 2)[2]
    k = (low.keys >> 8 & 255) << 8 | (low.keys & 255)
    keys, at = np.unique(k, return_inverse=True)
    top = C.top_levels(np.stack([keys, np.bincount(at, low.n0), np.bincount(at, low.n1), np.bincount(at, low.pw)], 1).astype(float))
    every = np.arange(256, dtype=np.int64)
    for ctx in (b"ab", b"zz", b"za"):
        p = C.log10_probabilities((ctx[0] << 16 | ctx[1] << 8) | every, top | C.levels(u, n, 2, 2), 2)
        assert abs((10**p).sum() - 1) < 1e-9


def test_no_rows_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.score_texts(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = C.score_texts(one, F.lit(False)).first()
    assert abs(r.score - 24 * math.log10(0.5)) < 1e-9 and r.train_tokens == 0 and r.n_known == 0


def hot_pair(n, depth=5):
    """Grams of one two-byte context, with shares of one longer context and of grams that training hasn't seen."""
    r = np.random.default_rng(7)
    near = np.where(r.random(n) < 0.5, 97, r.integers(97, 123, n))
    g = r.integers(97, 123, n) << 8 * depth
    for i in range(depth - 1, 3, -1):
        g |= r.integers(97, 123, n) << 8 * i
    g = np.unique(g | near << 24 | 101 << 16 | 32 << 8 | r.integers(60, 90, n))
    return g, r.integers(0, 4, len(g))


def test_a_cut_context_weighs_as_the_whole_one():
    g, n = hot_pair(3_000)
    g, n = np.r_[g, g[:400] ^ (5 << 8)], np.r_[n, n[:400]]  # and some of another pair
    low = C.levels(g, n, 5, 2)
    k = (low[2].keys >> 8 & 255) << 8 | (low[2].keys & 255)
    keys, at = np.unique(k, return_inverse=True)
    want = [keys, *(np.bincount(at, x) for x in (low[2].n0, low[2].n1, low[2].pw))]
    top = C.top_levels(np.stack(want, 1).astype(float))
    p = dict(zip(g.tolist(), C.log10_probabilities(g, top | low, 5)))
    for size in (1, 300, 2_000, 10**6):
        at = C.cuts(np.sort(C.by_context(g, 5)), 5, size)
        assert [a for a, _, _ in at] + [len(g)] == [0] + [b for _, b, _ in at]
        assert max(d for _, _, d in at) == {1: 5, 300: 4, 2_000: 3, 10**6: 2}[size]
        for got, x in zip(C.bucket_sums(g, n, 5, size), want):
            assert np.allclose(got, x, rtol=1e-12, atol=1e-9)
        gram, value = C.bucket_values(g, n, top, 5, size)
        assert sorted(gram.tolist()) == sorted(g.tolist())
        assert max(abs(p[x] - v) for x, v in zip(gram.tolist(), value.tolist())) < 1e-9


def test_a_hot_pair_is_solved_in_little_memory():
    g, n = hot_pair(150_000)
    top = C.top_levels(np.stack(C.bucket_sums(g, n, 5), 1))
    tracemalloc.start()
    C.bucket_values(g, n, top, 5)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 45, peak


def test_blocks_in_batches_of_one_row(spark, monkeypatch):
    texts = ["one two two", "two three", None, "", "only here here", "four one", "zwei ünï", "only here here", "ONE four"] * 2
    rows = [(None if i == 5 else i // 2, t, i % 3 != 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score, r.train)
    want = sorted(C.score_texts(docs, F.col("t"), depth=3).collect(), key=key)
    monkeypatch.setattr(C, "BATCH", 1)
    monkeypatch.setattr(C, "ROWS", 2)
    monkeypatch.setattr(C, "parts", lambda *_: 4)
    got = sorted(C.score_texts(docs, F.col("t"), depth=3).collect(), key=key)
    assert len(got) == len(rows)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and all(abs(x - y) < 1e-9 for x, y in zip(a[5:], b[5:]))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "1"
