"""Line dedup through sharded minimal perfect hashes.

Spark counts the 128-bit hashes of the lines' keys. Those found in two documents or more are dealt by hash to
shards; each shard becomes one file in the shared folder: a minimal perfect hash and, by its numbers, arrays of
64-bit fingerprints, document counts and smallest doc_ids. Documents are then read once more and probe the
arrays; their lines are never joined or shuffled. A task opens the shards that its batch needs one by one, in
shard order, and keeps as many as CACHE_MB allows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import perfect_hash
from .common import cut, fresh_dir, table
from .files import pack, read_bytes, unpack, write_bytes

MIN_CHARS = 10
#: Keys of a shard, about: some 25 MB of arrays.
SHARD_KEYS = 1_000_000
CACHE_MB = 200
#: What a null doc_id counts as: after all others.
NO_ID = 2**63 - 1


def key_of(line: bytes) -> bytes:
    """ASCII white space stripped, A-Z lower-cased."""
    return line.strip(b" \t\n\r\x0b\x0c").lower()


def is_long(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least


def hashes_of(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    raw = b"".join([xxhash.xxh3_128_digest(k) for k in keys])
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 and, with ``with_text``, kept_text.

    A line of at least ``min_chars`` code points whose key another document with a smaller doc_id holds is
    dropped. Null or empty text: one empty line, kept. Rows with the same doc_id are one document: none of them
    drops what only they share. Null doc_id: one document, after all others. Empty table: no rows. Extra
    columns are not returned.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = {k for x in (texts[i].as_py() or "").encode().split(b"\n") if is_long(k := key_of(x), min_chars)}
                keys += own
                ids += [NO_ID if doc_id is None else doc_id] * len(own)
            a, b = hashes_of(keys)
            yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8")), pa.array(ids, pa.int64())], ["a", "b", "doc"])

    per_key = d.mapInArrow(lines, "a long, b long, doc long").groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("doc").alias("n"))
    shared = cut(per_key.filter("first < last").select("a", "b", "first", "n"))
    shards = max(1, -(-shared.count() // shard_keys))
    folder = fresh_dir(spark, "line-index")

    def index(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = (rows.column(c).to_numpy().view("<u8") for c in ("a", "b"))
        h = perfect_hash.build(a, b)
        at = perfect_hash.find(h, a, b)
        prints, counts, first = np.empty(len(a), "<u8"), np.empty(len(a), "<u4"), np.empty(len(a), "<i8")
        prints[at] = b
        counts[at] = np.minimum(rows.column("n").to_numpy(), 2**32 - 1)
        first[at] = rows.column("first").to_numpy()
        shard = key[0].as_py()
        path = write_bytes(folder, f"shard-{shard:06d}", pack(prints=prints, counts=counts, first=first, **h))
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": [path]})

    made = shared.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(index, "shard long, path string").collect()
    paths = {r.shard: r.path for r in made}  # a row per shard
    del shared

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, dict] = OrderedDict()

        def shard_of(k: int) -> dict:
            if k not in cache:
                cache[k] = unpack(read_bytes(paths[k]))
                while len(cache) > 1 and sum(x.nbytes for s in cache.values() for x in s.values()) > CACHE_MB << 20:
                    cache.popitem(last=False)
            cache.move_to_end(k)
            return cache[k]

        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            split = [(texts[i].as_py() or "").encode().split(b"\n") for i in range(len(ids))]
            where, keys = [], []
            for i, own in enumerate(split):
                for j, x in enumerate(own):
                    if is_long(k := key_of(x), min_chars):
                        where.append((i, j))
                        keys.append(k)
            a, b = hashes_of(keys)
            dropped: list[set[int]] = [set() for _ in ids]
            if len(a) and paths:
                to = shard_numbers(a, shards)
                me = np.array([NO_ID if ids[i] is None else ids[i] for i, _ in where], np.int64)
                for k in np.unique(to):
                    if int(k) not in paths:
                        continue
                    s, mine = shard_of(int(k)), np.flatnonzero(to == k)
                    at = perfect_hash.find(s, a[mine], b[mine])
                    hit = at >= 0
                    hit[hit] = (s["prints"][at[hit]] == b[mine][hit]) & (s["first"][at[hit]] < me[mine][hit])
                    for x in mine[hit]:
                        dropped[where[x][0]].add(where[x][1])
            kept = [b"\n".join([x for j, x in enumerate(own) if j not in dropped[i]]) if dropped[i] else b"\n".join(own) for i, own in enumerate(split)]
            cols = {"doc_id": pa.array(ids, pa.int64()), "n_lines": pa.array(map(len, split), pa.int64()), "n_dropped": pa.array(map(len, dropped), pa.int64()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
            yield pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}))

    return d.mapInArrow(probe, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)


def shard_numbers(a: np.ndarray, shards: int) -> np.ndarray:
    """pmod(xxhash64(a), shards), as Spark deals the keys."""
    with np.errstate(over="ignore"):
        p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
        turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
        h = np.uint64(42) + p5 + np.uint64(8)
        h = turn(h ^ turn(a.astype(np.uint64) * p2, 31) * p1, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), shards)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, i, line, s.first IS NOT NULL AND s.first < k.doc_id AS dropped FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
