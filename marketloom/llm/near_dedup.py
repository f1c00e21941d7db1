"""MinHash near-dedup: banding, signature check, full-set check, components.

Documents with equal shingle sets are one node (copies are never paired), numbered by itself: rows that share a
doc_id but not their text are different nodes. A node's signature has HASHES minima of
universal hash functions; BANDS bands of them are its buckets. In a bucket every node is compared with the least
one, and what these links join becomes a component. Only pairs that share a bucket and still lie in different
components are compared beyond that, inside their bucket's task. So near copies of one another cost as many
comparisons as there are of them, no pair that shares a bucket goes unchecked, and what leaves a task is links
alone. A pair that passes the signature check is settled on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fitted, free, table, tidy, unused
from .components import components

WORDS, SIMILARITY = 5, (75, 100)
#: A pair at the threshold shares none of the 32 bands of 4 with a chance of 5e-6.
HASHES, BANDS = 128, 32
#: Share of equal minima below which a pair isn't settled on full sets: 4.4 standard deviations below the threshold.
MIN_EQUAL = 0.58
#: Ids and text keys of documents in candidate pairs are broadcast up to this many (32 bytes each), else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket that one task compares with as many others, at most.
CHUNK = 4_000
#: Nodes to a task, in tables that have a few hundred bytes to a node, or a row to a node and band.
NODES_A_TASK = 5_000
SEED = 20240229


class WordHashes(dict):
    """Hashes of words, remembered up to ``limit`` of them (some 180 bytes each); a full memory is emptied, which costs time and nothing else."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the text with A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def parameters() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    a = r.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
    return a, r.integers(0, 2**64, HASHES, np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each function a * x + b over the set, by its upper half."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 512):
            out = np.minimum(out, (s[i : i + 512, None] * a + b).min(axis=0))
    return out >> np.uint64(32)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One key per band, the band's number mixed in."""
    rows = sig.reshape(BANDS, -1)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out


def text_key() -> list:
    """128 bits that name a text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (hash of the text), n_shingles, s1, s2 (hash of the set), bands, sig (a byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, (a, b) = WordHashes(100_000), parameters()
        for batch in batches:
            n, s1, s2, bands, sig = [], [], [], [], []
            texts = batch.column(3)
            for i in range(batch.num_rows):
                s = shingles(texts[i].as_py(), known)
                n.append(len(s))
                x = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                s1.append(x[0])
                s2.append(x[1])
                if len(s):
                    m = signature(s, a, b)
                    bands.append(bands_of(m).view(np.int64))
                    sig.append(m.astype(np.uint8).tobytes())
                else:
                    bands.append(np.zeros(0, np.int64))
                    sig.append(b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "bands", "sig"],
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    return d.mapInArrow(tidy(run), "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary")


def few(df: DataFrame, n: int) -> DataFrame:
    """In no more partitions than so many nodes need."""
    return fitted(df, n, NODES_A_TASK)


def alike(pairs: DataFrame, sigs: DataFrame, n: int) -> DataFrame:
    """Of pairs (a, b) those whose signatures agree in MIN_EQUAL of the minima; n: nodes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
                batch = batch.filter(pa.array((x == y).mean(axis=1) >= MIN_EQUAL))
            yield batch.select([0, 1])

    left = sigs.select(F.col("node").alias("l"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("node").alias("r"), F.col("sig").alias("sig_b"))
    both = few(few(pairs.join(right, F.col("b") == F.col("r")), n).join(left, F.col("a") == F.col("l")), n)
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the similarity; n: nodes at most."""
    pairs = cut(few(pairs.distinct(), n))
    texts = involved(docs, nodes, pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct(), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, left = WordHashes(), None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                t = ta[i].as_py()
                if t != last:
                    last, left = t, shingles(t, known)
                right = shingles(tb[i].as_py(), known)
                keep.append(reaches(left, right))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    with_b = pairs.join(texts.select(F.col("node").alias("r"), F.col("text").alias("tb")), F.col("b") == F.col("r")).select("a", "b", "tb")
    full = with_b.join(texts.select(F.col("node").alias("l"), F.col("text").alias("ta")), F.col("a") == F.col("l"))
    return full.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long").distinct()


def involved(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, text of the wanted nodes: of each the text of its least document."""
    ids = cut(few(nodes.join(few(wanted, n), "node", "left_semi").select("node", "rep", F.col("t1").alias("x1"), F.col("t2").alias("x2")), n))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    d = docs.select(F.col("doc_id").cast("long").alias("id"), *text_key(), "text")
    found = d.join(ids, (F.col("id") == F.col("rep")) & (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2")))
    return found.select("node", "text").dropDuplicates(["node"])


def across(buckets: DataFrame, nodes: DataFrame, comp: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between different components among the pairs that share a bucket.

    A bucket's pairs are settled where they are found: signatures first, then full sets, the likest pairs first,
    and none whose ends earlier links of the bucket have joined. So only links leave a task, fewer than it has
    members. A pair that shares several buckets belongs to the one of its first common band. Buckets of more than
    CHUNK members are dealt to tasks by pairs of chunks. n: nodes at most.
    """
    comp = comp.withColumnRenamed("node", "c_node")
    named = few(buckets.join(comp, F.col("node") == F.col("c_node"), "left"), n).select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    mixed_keys = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    open_ = cut(few(named.join(few(mixed_keys, n), "key", "left_semi"), n))
    # Of buckets with the same members the one of the first band has all their pairs.
    same = open_.groupBy("key").agg(F.min("band").alias("band"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24)).alias("m2"), F.count("*").alias("n"))
    one = few(same, n).groupBy("m1", "m2", "n").agg(F.min(F.struct("band", "key")).alias("k"))
    one = cut(few(one.select(F.col("k.key").alias("key"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), n))
    part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = open_.join(one, "key").withColumn("c", part).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", "band", "node", "component", "c", F.least("c", "d").alias("c1"), F.greatest("c", "d").alias("c2"))
    texts = involved(docs, nodes, open_.select("node").distinct(), n)
    facts = texts.join(nodes.select("node", "sig", "bands"), "node").withColumnRenamed("node", "f_node")
    full = dealt.join(facts, F.col("node") == F.col("f_node")).drop("f_node")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        c1, c2 = key[1].as_py(), key[2].as_py()
        rep, comp, c = (t.column(k).to_numpy() for k in ("node", "component", "c"))
        band, texts = t.column("band")[0].as_py(), t.column("text")
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        names, sizes = np.unique(comp, return_counts=True)
        large = comp == names[sizes.argmax()]
        rows = np.flatnonzero(~large)  # two members of the largest component need no comparison
        found = []
        step = max(1, 20_000_000 // (len(rep) * HASHES))
        for i in range(0, len(rows), step):
            x = rows[i : i + step]
            equal = (sig[x][:, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.int16)
            ok = (equal >= MIN_EQUAL * HASHES) & (comp[x][:, None] != comp[None, :]) & (large[None, :] | (rep[x][:, None] < rep[None, :]))
            if c1 != c2:
                ok &= c[x][:, None] != c[None, :]
            p, q = np.nonzero(ok)
            p, e = x[p], equal[p, q]
            mine = (bands[p] == bands[q]).argmax(axis=1) == band
            found.append(np.stack([e[mine], p[mine], q[mine]]).astype(np.int64))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        pairs = pairs[:, np.lexsort((rep[pairs[2]], rep[pairs[1]], -pairs[0]))]
        root = {x: x for x in names.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        known, sets, out = WordHashes(), {}, []
        for p, q in zip(pairs[1].tolist(), pairs[2].tolist(), strict=True):
            u, v = top(int(comp[p])), top(int(comp[q]))
            if u == v:
                continue
            for k in (p, q):
                if k not in sets:
                    sets[k] = shingles(texts[k].as_py(), known)
            if reaches(sets[p], sets[q]):
                root[max(u, v)] = min(u, v)
                out.append((int(rep[p]), int(rep[q])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return full.groupBy("key", "c1", "c2").applyInArrow(run, "a long, b long").distinct()


def reaches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    small, large = sorted((len(x), len(y)))
    if SIMILARITY[1] * small < SIMILARITY[0] * large or not small:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (small + large - both)


def labelled(docs: DataFrame) -> DataFrame:
    """near_duplicates with t1, t2: the hash of the row's text."""
    f = cut(features(docs))
    n = f.count()
    own = f.filter("n_shingles > 0 and doc_id is not null")
    nodes = own.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("x"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # Numbered in a table that is written before it is read, so that a node keeps its number.
    nodes = cut(few(nodes, n).select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "x.*", "last", "bands", "sig").withColumnRenamed("doc_id", "rep"))
    sigs = nodes.select("node", "sig")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    centers = buckets.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other")).filter("center < other").select("key", "center")
    buckets = cut(few(buckets.join(cut(few(centers, n)), "key"), n))
    star = few(buckets.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), n)
    links = cut(few(confirmed(alike(star, sigs, n), nodes, docs, n), n))
    comp = cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    free(docs.sparkSession)
    more = cut(few(across(buckets.select("key", "band", "node"), nodes, comp, docs, n), n))
    if not more.isEmpty():
        comp = cut(components(links.unionAll(more).select(F.col("a").alias("u"), F.col("b").alias("v"))))
    free(docs.sparkSession)
    # Nodes that are linked, by the least doc_id of their component, and copies; other documents need no look-up.
    facts = nodes.select("node", "s1", "s2", "rep", "last")
    linked = cut(few(comp.join(facts, "node"), n))
    least = few(linked.groupBy("component").agg(F.min("rep").alias("component_id")), n)
    copied = few(facts.filter("rep < last").join(linked.select("node"), "node", "left_anti"), n).select("s1", "s2", F.col("rep").alias("component_id"))
    named = few(linked.join(least, "component"), n).select("s1", "s2", "component_id").unionAll(copied)
    named = cut(named.select(F.col("s1").alias("g1"), F.col("s2").alias("g2"), "component_id"))
    out = f.select("doc_id", "t1", "t2", "n_shingles", "s1", "s2").join(named, (F.col("s1") == F.col("g1")) & (F.col("s2") == F.col("g2")), "left")
    out = few(out, n).select("doc_id", "t1", "t2", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    A text with fewer than five words, but any, has one shingle: all of them. Null or empty text: no shingles,
    no links. Rows with the same doc_id are judged each by its own text. Null doc_id: no links, component null,
    kept. Equal texts (ties) are one node, whose least doc_id stands for it. Empty table: no rows. Extra columns,
    whatever their names, are not looked at and not returned.
    """
    return labelled(docs).drop("t1", "t2")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the least doc_id of each component.

    Rows go by their doc_id and text, so a row that shares a doc_id with a copy, but not its text, stays; repeated
    rows of the kept document all stay. Null doc_id, null and empty texts stay. Empty table: no rows. Extra columns stay.
    """
    i, a, b = unused(docs, "gone_id", "gone_1", "gone_2")
    gone = labelled(docs).filter("not kept").select(F.col("doc_id").alias(i), F.col("t1").alias(a), F.col("t2").alias(b)).distinct()
    t1, t2 = text_key()
    return docs.join(gone, (docs["doc_id"] == F.col(i)) & (t1 == F.col(a)) & (t2 == F.col(b)), "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
