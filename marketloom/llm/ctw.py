"""LM scoring by context-tree weighting.

A byte is eight binary decisions, so a node of the model is a context of up to DEPTH bytes and a prefix of the
next byte's bits. Each node keeps its counts of zeros and ones; its Krichevsky-Trofimov estimate is mixed half
and half with the product of its children's weighted estimates, bottom-up. Seen from the root, that gives every
depth of a context a posterior weight, and a bit's probability is the weighted mean of the estimates of all
depths; where training has not seen a deeper context, the weight stays with the deepest one it has seen.

How it is spread out: texts are dealt to blocks. A block counts its grams (context and byte) and its words once
and sends each distinct one with its count, not each occurrence. Counts are summed per gram; the tree is built
in buckets that hold all of a two-byte context, so only the nodes of depth 0 and 1 (at most 256 * 255 + 255) are
brought together. A block then gets back one number for each of its distinct grams and words, and scores its
texts. Nothing that grows with the corpus reaches the driver or is broadcast.

What a task holds: texts pass by in small batches, so of a block there are only the distinct grams and words. A
bucket's tree is built in pieces of at most PIECE grams (or the 256 of one longest context); a context with more is
cut by the byte before it, and its own nodes are summed from those of its pieces.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_bytes, give_back, parts, stored, table, tidy

#: Bytes of context. A gram is DEPTH + 1 bytes; the tree needs at least 2.
DEPTH = 5
#: MB of the input's files that make a block.
BLOCK_MB = 12
#: MB of stored counts whose answers make a partition, at least as many as the session's shuffle partitions.
COUNTS_MB = 4
#: Distinct grams in a bucket of the tree, about.
BUCKET_GRAMS = 100_000
#: Grams whose part of the tree is in memory at once, about.
PIECE = 20_000
#: Before a text and after it; no byte of UTF-8.
EDGE = 255
#: Bytes that are turned into grams at once.
CHUNK = 1_000_000
#: Bytes of an Arrow batch, on both sides; more only for one longer text.
BATCH = 4 << 20
#: Rows of a batch that a task sends.
ROWS = 100_000
END = b""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def folded(text: str | bytes | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower()


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts, one after the other, and where each text's begin."""
    edge = bytes([EDGE])
    joined = np.frombuffer(b"".join([edge * depth + t + edge for t in texts]), np.uint8)
    starts = np.cumsum([0, *(len(t) + depth + 1 for t in texts)])
    g = np.zeros(len(joined) - depth, np.uint64)
    for j in range(depth + 1):
        g <<= np.uint64(8)
        g |= joined[j : len(joined) - depth + j]
    first = starts[:-1]
    use = np.ones(len(g), bool)
    for s in starts[1:-1]:
        use[s - depth : s] = False  # grams across two texts
    return g[use].view(np.int64), np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(first)]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT estimate of n0 zeros and n1 ones in any order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; relative error below 1e-13 for x >= 0.5."""
    x = np.asarray(x, float)
    y, prod = x + 8.0, np.ones_like(x)
    for i in range(8):
        prod = prod * (x + i)
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(prod)


def bit_path(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 bit nodes (1, then prefix with a leading one) and bits of each byte, most significant first."""
    b = byte.astype(np.int64)[:, None] | 256
    shift = np.arange(8, 0, -1)
    return b >> shift, (b >> (shift - 1)) & 1


class Level:
    """Nodes of one depth: sorted keys (context << 8 | bit node), counts, and the logarithms of KT and of the weighted estimate."""

    def __init__(self, ctx: np.ndarray, byte: np.ndarray, count: np.ndarray):
        nodes, bits = bit_path(byte)
        keys = ((ctx.astype(np.int64) << 8)[:, None] | nodes).ravel()
        w = np.repeat(count, 8).astype(float)
        self.keys, at = np.unique(keys, return_inverse=True)
        ones = np.bincount(at, w * bits.ravel(), len(self.keys))
        self.n0, self.n1 = np.bincount(at, w, len(self.keys)) - ones, ones
        self.kt = log_kt(self.n0, self.n1)
        self.pw = self.kt.copy()

    def mix(self, below: Level) -> None:
        """Weighted estimates from the children's; a child's context has one more byte in front."""
        n = (below.keys >> 8).astype(np.int64)
        parent = (n & self.mask) << 8 | (below.keys & 255)
        at = np.searchsorted(self.keys, parent)
        kids = np.bincount(at, below.pw, len(self.keys))
        self.pw = np.logaddexp(self.kt, kids) - np.log(2)

    mask = 0

    def at(self, ctx: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each node, and whether training has seen it."""
        k = (ctx.astype(np.int64) << 8)[:, None] | nodes
        i = np.minimum(np.searchsorted(self.keys, k), max(len(self.keys) - 1, 0))
        return i, self.keys[i] == k if len(self.keys) else np.zeros(k.shape, bool)


def levels(gram: np.ndarray, count: np.ndarray, depth: int, lowest: int) -> dict[int, Level]:
    """Levels ``lowest`` to ``depth`` of the trained grams, mixed from below."""
    seen = count > 0
    g, c = gram[seen], count[seen]
    out: dict[int, Level] = {}
    for d in range(depth, lowest - 1, -1):
        mask = (1 << 8 * d) - 1
        out[d] = Level((g >> 8) & mask, g & 255, c)
        out[d].mask = mask
        if d < depth:
            out[d].mix(out[d + 1])
    return out


def by_context(gram: np.ndarray, depth: int) -> np.ndarray:
    """Grams as numbers that sort by the context's last byte, the one before it and so on, then by the byte itself."""
    out = gram & 255
    for i in range(1, depth + 1):
        out = out | ((gram >> 8 * i) & 255) << 8 * (depth + 1 - i)
    return out


def cuts(ordered: np.ndarray, depth: int, size: int, lowest: int = 2) -> list[tuple[int, int, int]]:
    """Pieces (begin, end, level) of grams in the order of ``by_context``: whole contexts of ``level`` bytes, ``size`` grams about.

    Contexts of ``lowest`` bytes with more grams than ``size`` are cut by the byte before them, and so on to ``depth``.
    """
    out: list[tuple[int, int, int]] = []

    def split(a: int, b: int, d: int) -> None:
        ctx = ordered[a:b] >> 8 * (depth + 1 - d)
        begin = a
        for s, e in pairwise([a, *(np.flatnonzero(ctx[1:] != ctx[:-1]) + (a + 1)).tolist(), b]):
            large = e - s > size and d < depth
            if begin < s and (large or e - begin > size):
                out.append((begin, s, d))
                begin = s
            if large:
                split(s, e, d + 1)
                begin = e
        if begin < b:
            out.append((begin, b, d))

    if len(ordered):
        split(0, len(ordered), lowest)
    return out


Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def added(several: list[Sums]) -> Sums:
    """Sorted keys, and the sums of n0, n1 and the children's weighted estimates."""
    k, *values = (np.concatenate(x) for x in zip(*several, strict=True))
    keys, at = np.unique(k, return_inverse=True)
    n0, n1, kids = (np.bincount(at, x, len(keys)).astype(float) for x in values)
    return keys, n0, n1, kids


def raised(level: Level, d: int) -> Sums:
    """What the nodes of depth ``d`` bring to those of depth d - 1."""
    k = (level.keys >> 8 & ((1 << 8 * (d - 1)) - 1)) << 8 | (level.keys & 255)
    return added([(k, level.n0, level.n1, level.pw)])


def cut_levels(gram: np.ndarray, count: np.ndarray, at: list[tuple[int, int, int]], depth: int) -> tuple[dict[int, Level], Sums]:
    """Nodes of the contexts that are cut, by depth, and what the whole bucket brings to depth 1."""
    none = np.zeros(0)
    up: dict[int, list[Sums]] = {d: [(none.astype(np.int64), none, none, none)] for d in range(1, depth)}
    for a, b, d in at:
        up[d - 1].append(raised(levels(gram[a:b], count[a:b], depth, d)[d], d))
    large: dict[int, Level] = {}
    for d in range(max((d for _, _, d in at), default=2) - 1, 1, -1):
        large[d] = Top(*added(up[d]))
        up[d - 1].append(raised(large[d], d))
    return large, added(up[1])


def bucket_sums(gram: np.ndarray, count: np.ndarray, depth: int, size: int = PIECE) -> Sums:
    """What a bucket, all grams of some two-byte contexts, brings to depth 1."""
    ordered = by_context(gram, depth)
    order = np.argsort(ordered)
    return cut_levels(gram[order], count[order], cuts(ordered[order], depth, size), depth)[1]


def bucket_values(gram: np.ndarray, count: np.ndarray, top: dict[int, Level], depth: int, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's grams in another order, and the log10 probability of each."""
    ordered = by_context(gram, depth)
    order = np.argsort(ordered)
    gram, count, at = gram[order], count[order], cuts(ordered[order], depth, size)
    large = cut_levels(gram, count, at, depth)[0] if any(d > 2 for _, _, d in at) else {}
    out = np.zeros(len(gram))
    for a, b, d in at:
        tree = top | {e: large[e] for e in range(2, d)} | levels(gram[a:b], count[a:b], depth, d)
        for i in range(a, b, size):  # the grams of one longest context may be more
            out[i : min(i + size, b)] = log10_probabilities(gram[i : min(i + size, b)], tree, depth)
    return gram, out


def log10_probabilities(gram: np.ndarray, tree: dict[int, Level], depth: int) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the bytes before it."""
    nodes, bits = bit_path(gram & 255)
    p = np.zeros(nodes.shape)
    mass = np.ones(nodes.shape)
    where = {d: tree[d].at((gram >> 8) & ((1 << 8 * d) - 1), nodes) for d in range(depth + 1)}
    for d in range(depth + 1):
        lv, (i, seen) = tree[d], where[d]
        if not len(lv.keys):
            return np.full(len(gram), 8 * np.log10(0.5)) if d == 0 else np.log10(p).sum(axis=1)
        n0, n1 = np.where(seen, lv.n0[i], 0.0), np.where(seen, lv.n1[i], 0.0)
        kt = (np.where(bits == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        deeper = where[d + 1][1] if d < depth else np.zeros(nodes.shape, bool)
        stop = np.where(deeper, np.exp(np.minimum(0.0, lv.kt[i] - np.log(2) - lv.pw[i])), 1.0)
        p += mass * stop * kt
        mass = mass * (1.0 - stop)
    return np.log10(p).sum(axis=1)


class Top(Level):
    """Depth 1 or 0 from counts and, for depth 1, the sums of the children's weighted estimates."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, kids: np.ndarray):  # noqa: D107
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.kt = log_kt(n0, n1)
        self.pw = np.logaddexp(self.kt, kids) - np.log(2)


def top_levels(rows: np.ndarray) -> dict[int, Level]:
    """Depths 0 and 1 from rows of (key of depth 1, n0, n1, kids), sorted by key."""
    one = Top(rows[:, 0].astype(np.int64), rows[:, 1], rows[:, 2], rows[:, 3])
    node = one.keys & 255
    keys, at = np.unique(node, return_inverse=True)
    n = len(keys)
    zero = Top(keys, np.bincount(at, one.n0, n), np.bincount(at, one.n1, n), np.bincount(at, one.pw, n))
    return {0: zero, 1: one}


def score_texts(docs: DataFrame, train: Column, depth: int = DEPTH, block_mb: int = BLOCK_MB) -> DataFrame:
    """doc_id, train (whether the model learnt from it), n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The text is what is scored: its bytes with A-Z in lower case, and its end. Null text: as an empty one, which
    has one token, its end. Repeated rows count and are scored one by one. Without training rows every bit has
    probability 1/2. Empty table: no rows. Extra columns are not returned.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    with batch_bytes(docs.sparkSession, BATCH):
        return stored(scored(docs, train, depth, block_mb), "ctw-scores")


def scored(docs: DataFrame, train: Column, depth: int, block_mb: int) -> DataFrame:
    blocks = parts(docs, block_mb)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))
    d = d.withColumn("text", F.col("text").cast("binary"))

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        others: set[bytes] = set()
        keys, counts, pending, settled = [], [], 0, 0
        for batch in batches:
            texts, trains = [folded(x) for x in batch.column("text").to_pylist()], batch.column("train").to_pylist()
            for x, y in zip(texts, trains, strict=True):
                if y:
                    words.update(x.split())
                    words[END] += 1
                else:
                    others.update(x.split())
            for y in (True, False):
                own = [x for x, z in zip(texts, trains, strict=True) if bool(z) == y]
                for a, b in chunks(own):
                    u, c = np.unique(grams_of(own[a:b], depth)[0], return_counts=True)
                    keys.append(u)
                    counts.append(c if y else np.zeros(len(u), np.int64))
                    pending += len(u)
            if pending > max(CHUNK, settled):
                k, n = summed(keys, counts)
                keys, counts, pending, settled = [k], [n], 0, len(k)
        grams, n = summed(keys, counts)
        del keys, counts
        others.difference_update(words)
        if END not in words:
            others.add(END)

        def rows(gram: pa.Array, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
            block = pa.array(np.full(len(n), key[0].as_py(), np.int32))
            return pa.record_batch({"block": block, "gram": gram, "word": word, "n": n})

        for i in range(0, len(grams), ROWS):
            g = pa.array(grams[i : i + ROWS])
            yield rows(g, pa.nulls(len(g), pa.binary()), pa.array(n[i : i + ROWS], pa.int64()))
        for some in (words.items(), ((w, 0) for w in others)):
            for part in batched(some, ROWS):
                w = pa.array([w for w, _ in part], pa.binary())
                yield rows(pa.nulls(len(w), pa.int64()), w, pa.array([c for _, c in part], pa.int64()))
        del words, others, grams, n
        give_back()

    counted = stored(d.groupBy("block").applyInArrow(count, "block int, gram long, word binary, n long"), "ctw-counts")
    by_gram, by_word = counted.filter("gram is not null"), counted.filter("word is not null")
    grams = stored(by_gram.groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    words = stored(by_word.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")), "ctw-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    size, distinct = int(total.n), int(total.v)
    buckets = max(8, -(-grams.count() // BUCKET_GRAMS))
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    grams = grams.withColumn("bucket", F.pmod(F.xxhash64(pair), F.lit(buckets)))

    def deep(key: tuple, t: pa.Table) -> pa.Table:
        keys, n0, n1, kids = bucket_sums(t.column("gram").to_numpy(), t.column("n").to_numpy(), depth)
        give_back()
        return pa.table({"key": keys, "n0": n0, "n1": n1, "kids": kids})

    shallow = grams.select("bucket", "gram", "n").groupBy("bucket").applyInArrow(deep, "key long, n0 double, n1 double, kids double")
    # Sums in a fixed order, so that reruns agree to the last bit.
    shallow = shallow.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sort_array(F.collect_list("kids")).alias("kids"))
    shallow = shallow.withColumn("kids", F.aggregate("kids", F.lit(0.0), lambda a, x: a + x))
    rows = shallow.orderBy("key").collect()  # at most 256 * 255
    top = top_levels(np.array([[r.key, r.n0, r.n1, r.kids] for r in rows], float).reshape(-1, 4))

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        gram, value = bucket_values(t.column("gram").to_numpy(), t.column("n").to_numpy(), top, depth)
        give_back()
        return pa.table({"gram": gram, "value": value})

    solved = stored(grams.select("bucket", "gram", "n").groupBy("bucket").applyInArrow(solve, "gram long, value double"), "ctw-solved")
    # What a block's texts need comes before them: key is a gram or doc_id, bytes a word or text.
    nothing, no_train = F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("boolean").alias("train")
    back = by_gram.select("block", "gram").join(solved, "gram").select("block", F.lit(0).alias("kind"), F.col("gram").alias("key"), nothing, "value", no_train)
    # A word that no other block has needs no answer: its block's own count is the corpus's.
    common = words.filter("blocks > 1").select("word", F.col("n").cast("double").alias("value"))
    back = back.unionAll(by_word.select("block", "word").join(common, "word").select("block", F.lit(1), F.lit(None).cast("long"), "word", "value", no_train))
    back = back.unionAll(d.select("block", F.lit(2), "doc_id", "text", F.lit(None).cast("double"), "train"))
    floor = float(np.log10(size + distinct + 1))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in pairwise([0, *change.tolist(), len(b)]):
                if texts is None or b[i] != block:
                    if texts is not None:
                        yield texts.rows(size)
                    block, texts = b[i], Block(depth, floor)
                texts.take(int(kind[i]), batch.slice(i, j - i))
        if texts is not None:
            yield texts.rows(size)

    out = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    # One block a partition: by a hash several would meet in one, and their rows are sorted together. Where the
    # input's size isn't known there are far more blocks than that takes.
    dealt = min(blocks, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(counted, COUNTS_MB)))
    return back.repartitionById(dealt, "block").sortWithinPartitions("block", "kind").mapInArrow(tidy(answer), out)


class Block:
    """A block's answers, which come first, and what is known of its texts so far."""

    def __init__(self, depth: int, floor: float):
        self.depth, self.floor = depth, floor
        self.grams: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.lookup: Lookup | None = None
        self.value: dict[bytes, float] = {}
        #: Words without an answer, which no other block has, and where they occur.
        self.own: dict[bytes, int] = {}
        self.own_at, self.own_word = array("q"), array("q")
        self.ids: list[int | None] = []
        self.trains: list[bool | None] = []
        self.n_tokens, self.n_known, self.n_bytes = array("q"), array("q"), array("q")
        self.base, self.score = array("d"), array("d")

    def take(self, kind: int, batch: pa.RecordBatch) -> None:
        if kind == 0:
            self.grams.append(np.array(batch.column("key")))  # copies, which do not keep the batch
            self.values.append(np.array(batch.column("value")))
        elif kind == 1:
            v = np.log10(np.array(batch.column("value")) + 1)
            self.value.update(zip(batch.column("bytes").to_pylist(), v.tolist(), strict=True))
        else:
            self.texts(batch)

    def texts(self, batch: pa.RecordBatch) -> None:
        if self.lookup is None:
            g = np.concatenate(self.grams)
            order = np.argsort(g)
            self.lookup = Lookup(g[order], np.concatenate(self.values)[order])
            self.grams, self.values = [], []
        texts = [folded(x) for x in batch.column("bytes").to_pylist()]
        self.ids += batch.column("key").to_pylist()
        self.trains += batch.column("train").to_pylist()
        get, own = self.value.get, self.own
        for x in texts:
            words = x.split()
            words.append(END)
            got = [*map(get, words)]
            if None in got:
                for w, v in zip(words, got, strict=True):
                    if v is None:
                        self.own_word.append(own.setdefault(w, len(own)))
                        self.own_at.append(len(self.base))
                got = [v for v in got if v is not None]
            self.n_tokens.append(len(words))
            self.n_known.append(len(got) - got.count(0.0))
            self.n_bytes.append(len(x) + 1)
            self.base.append(sum(got) - len(words) * self.floor)
        for a, b in chunks(texts):
            gr, starts = grams_of(texts[a:b], self.depth)
            self.score.extend(np.add.reduceat(self.lookup(gr), starts).tolist())

    def rows(self, size: int) -> pa.RecordBatch:
        n = len(self.base)
        at, word = np.array(self.own_at, np.int64), np.array(self.own_word, np.int64)
        learnt = np.array([bool(y) for y in self.trains], float)
        c = np.bincount(word, learnt[at], len(self.own))
        base = np.array(self.base, float) + np.bincount(at, np.log10(c + 1)[word], n)
        known = np.array(self.n_known, np.int64) + np.bincount(at, (c > 0)[word].astype(float), n).astype(np.int64)
        score = np.array(self.score, float)
        return pa.record_batch(
            {
                "doc_id": pa.array(self.ids, pa.int64()), "train": pa.array(self.trains, pa.bool_()), "n_tokens": pa.array(np.array(self.n_tokens, np.int64)), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, size, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
                "bits_per_byte": pa.array(-score / np.log10(2) / np.array(self.n_bytes, np.int64)),
            }
        )


class Lookup:
    """Values of a block's grams by an open hash table of its own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        import pandas as pd

        self.index, self.values = pd.Index(keys), values

    def __call__(self, g: np.ndarray) -> np.ndarray:
        return self.values[self.index.get_indexer(g)]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = score_texts(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))
    return d.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
