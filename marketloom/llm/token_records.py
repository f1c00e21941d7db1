"""Token ids as length-delimited binary records with an offset index.

A shard is a run of documents in ascending doc_id order. Its record file holds one frame per document:
    uint64 length of the payload | uint32 masked checksum of those 8 bytes | payload | uint32 masked checksum of the payload
and a payload is
    uint8 bytes per id (2 or 4) | uint8 1 if the doc_id is null | int64 doc_id | uint32 number of ids | the ids,
all little-endian. A checksum is CRC-32 turned right by 15 bits plus 0xA282EAD8, so that checksums of data that
holds checksums stay strong. The index file beside it holds the uint64 offset of every frame, for shuffled reads.
The manifest (one row per shard) names the files of the attempts that succeeded; readers open nothing else.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, parts, small_batches, table, tidy
from .files import opened

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARD_MB = 24
#: Bytes, as Python counts them, that a task's memory of encoded words may take; a full memory is emptied, which costs time and nothing else.
MEMORY_BYTES = 48 << 20
#: What a word and its ids cost beside their own bytes: two objects and a slot.
ENTRY_BYTES = 200
#: Characters of texts that are encoded at a time, words that the model gets at a time, pieces whose ids are laid out at a time.
GROUP_CHARS, GROUP_WORDS, GROUP_PIECES = 4_000_000, 20_000, 200_000
#: Bytes of a record file that are read at a time, at least.
READ_BYTES, READ_ROWS = 8 << 20, 20_000
#: Letters whose lower case is the same alone and in a word, and which are composed, then marks.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#$|]*)")
# The definition under which letters are one word of the model and marks another, all else of the file being free.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
HEAD, BODY = "<QI", "<BBqI"
HEAD_BYTES, BODY_BYTES = struct.calcsize(HEAD), struct.calcsize(BODY)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(BODY, width, doc_id is None, doc_id or 0, len(ids)) + ids.astype(f"<u{width}").tobytes()


def frames(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each frame; ValueError if a checksum or a length is wrong."""
    at = 0
    while at < len(data):
        doc, ids, at = frame_at(data, at)
        yield doc, ids


def records(uri: str) -> Iterator[tuple[int | None, np.ndarray, int]]:
    """(doc_id, ids, offset) of each record of a file, which is read in blocks: memory for a block and a record, whatever the file's size."""
    place, path = opened(uri)
    with place.open_input_stream(path) as f:
        data, base, at = b"", 0, 0
        while True:
            need = HEAD_BYTES
            if at + HEAD_BYTES <= len(data):
                need = HEAD_BYTES + struct.unpack_from("<Q", data, at)[0] + 4
                if masked(data[at : at + 8]) != struct.unpack_from(HEAD, data, at)[1]:
                    raise ValueError(f"wrong checksum of the length at {base + at}")
            if at + need > len(data):
                more = f.read(max(READ_BYTES, at + need - len(data)))
                if not more:
                    if at < len(data):
                        raise ValueError("truncated frame")
                    return
                data, base, at = data[at:] + more, base + at, 0
                continue
            doc, ids, end = frame_at(data, at)
            yield doc, ids, base + at
            at = end


def frame_at(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    if at + HEAD_BYTES > len(data):
        raise ValueError("truncated frame")
    n, check = struct.unpack_from(HEAD, data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"wrong checksum of the length at {at}")
    body = data[at + HEAD_BYTES : at + HEAD_BYTES + n]
    end = at + HEAD_BYTES + n + 4
    if end > len(data) or masked(body) != struct.unpack_from("<I", data, end - 4)[0]:
        raise ValueError(f"wrong checksum of the payload at {at}")
    width, null, doc, count = struct.unpack_from(BODY, body)
    return None if null else doc, np.frombuffer(body, f"<u{width}", count, BODY_BYTES), end


def read_one(uri: str, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset of the index: two small reads, whatever the shard's size."""
    place, path = opened(uri)
    with place.open_input_file(path) as f:
        head = f.read_at(HEAD_BYTES, offset)
        return frame_at(head + f.read_at(struct.unpack(HEAD, head)[0] + 4, offset + HEAD_BYTES), 0)[:2]


def is_plain(definition: dict) -> bool:
    """Whether a tokenizer's definition takes a piece of SIMPLE apart into one word of letters and one of marks, whatever these are."""
    pre = definition.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}, {}]
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    added = [t["content"] for t in definition.get("added_tokens") or []]
    return (
        definition.get("normalizer") == NORMAL and len(steps) == 2 and steps[0] == split and {k: steps[1].get(k) for k in BYTES} == BYTES
        and {k: definition["model"].get(k) for k in PLAIN_MODEL} == PLAIN_MODEL and bool(definition["model"].get("end_of_word_suffix"))
        and not any(SIMPLE.search(t) and not re.search(r"[^A-Za-zÀ-ÖØ-öø-ÿ.,;:!?%&*#$|]", t) for t in added)
    )


class Encoder:
    """Texts to ids. Nothing looks across the spaces and line ends that the tokenizer drops, so Arrow cuts texts there
    and numbers the distinct pieces; each is encoded once a group. Where the tokenizer's own definition says that
    letters are one word of its model, and marks another, these go to the model alone, many at a time: the id that
    ends a word is told by its suffix. All else goes through the whole tokenizer. Words are remembered for the task."""

    def __init__(self, path: str | None, end_id: int):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None or os.sep not in path:
            import public_tokenizers

            path = public_tokenizers.path(path or TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if max(len(vocab), max(vocab.values()) + 1, end_id + 1) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind)
        self.plain = is_plain(definition)
        if self.plain:
            suffix = definition["model"]["end_of_word_suffix"]
            self.bare = Tokenizer(self.tokenizer.model)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            # Letters beyond ASCII as the model's byte characters: those that can be printed, then the rest from 256 on.
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}
            self.letters = {c: "".join(table[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.known: dict[str, bytes] = {"": b""}
        self.used = 0

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of any kind, from the whole tokenizer."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters in lower case, or of marks, from the model alone."""
        out: list[bytes] = []
        for k in range(0, len(words), GROUP_WORDS):
            group = words[k : k + GROUP_WORDS]
            given = [w if w.isascii() else w.translate(self.letters) for w in group]
            ids = np.array(self.bare.encode_batch_fast([given], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self.encoded(group)
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; of letters and the marks after them, which the tokenizer takes apart, each by itself."""
        if self.used > MEMORY_BYTES:
            self.known, self.used = {"": b""}, 0
        known, match = self.known, SIMPLE.fullmatch
        if not self.plain:
            new = [p for p in pieces if p not in known]
            self.remember(new, self.encoded(new))
            return [known[p] for p in pieces]
        parts = [(m[1].lower(), m[2]) if (m := match(p)) else (p, None) for p in pieces]
        # A piece that isn't simple and a run of letters in lower case are never the same string.
        new = list({w for c, t in parts if t is not None for w in (c, t) if w not in known})
        self.remember(new, self.words(new))
        rest = [c for c, t in parts if t is None and c not in known]
        self.remember(rest, self.encoded(rest))
        return [known[c] + known[t] if t else known[c] for c, t in parts]

    def remember(self, words: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.used += sum(map(len, words)) + sum(map(len, ids)) + ENTRY_BYTES * len(words)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, the end id last."""
        texts = texts.fill_null("")
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = pieces.flatten()
        numbered = flat.dictionary_encode()
        got = self.learn(numbered.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(got), self.kind)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.width
        starts = np.cumsum(sizes) - sizes
        which, ends = numbered.indices.to_numpy(), pieces.value_lengths().to_numpy().cumsum()
        at = doc = 0
        while doc < len(texts):  # whole texts of about GROUP_PIECES pieces
            last = max(doc + 1, int(np.searchsorted(ends, at + GROUP_PIECES, "right")))
            w = which[at : ends[last - 1]]
            n = sizes[w]
            upto = np.cumsum(n)
            own = ids[np.repeat(starts[w] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
            first = 0
            for i in range(doc, last):
                k = int(ends[i]) - at
                stop = int(upto[k - 1]) if k else 0
                yield np.concatenate([own[first:stop], self.end])
                first = stop
            doc, at = last, int(ends[last - 1])


def groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about GROUP_CHARS bytes together."""
    a = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= GROUP_CHARS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_mb: int = SHARD_MB) -> list[Any]:
    """Writes all documents and returns the manifest: rows of shard, path, index_path, docs, tokens in document order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), None
        place, root = opened(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        offsets, at, tokens, out = array("Q"), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                enc = Encoder(tokenizer, end_id)
                place.create_dir(root, recursive=True)
                out = place.open_output_stream(f"{name}.rec")
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                for doc_id, got in zip(ids[a:b], enc.encode(texts.slice(a, b - a)), strict=True):
                    data = frame(payload(doc_id, got, enc.width))
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
                    tokens += len(got)
        if out is not None:
            out.close()
            with place.open_output_stream(f"{name}.idx") as f:
                f.write(np.frombuffer(offsets, "=u8").astype("<u8").tobytes())
            base = f"{folder}/{name.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{base}.rec"], "index_path": [f"{base}.idx"], "docs": [len(offsets)], "tokens": [tokens]})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.repartitionByRange(parts(docs, shard_mb), "doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        done = d.mapInArrow(tidy(write), "shard long, path string, index_path string, docs long, tokens long").collect()  # a row per shard
    return sorted(done, key=lambda r: r.shard)


def read_shards(spark: SparkSession, manifest: list[Any]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, offset of every record, from the files."""
    rows, start = [], 0
    for r in manifest:
        rows.append((r.shard, r.path, start))
        start += r.tokens
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                start, got = r["base"], {k: array("q") for k in names[1:]}
                docs: list[int | None] = []
                for doc, ids, at in records(r["path"]):
                    docs.append(doc)
                    for k, v in zip(names[1:], (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), r["shard"], at), strict=True):
                        got[k].append(v)
                    start += len(ids)
                    if len(docs) >= READ_ROWS:
                        yield table_of(docs, got)
                        docs, got = [], {k: array("q") for k in names[1:]}
                if docs:
                    yield table_of(docs, got)

    names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")

    def table_of(docs: list[int | None], got: dict[str, array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(np.frombuffer(got[k], np.int64)) for k in names[1:])], names)

    shards = spark.createDataFrame(rows, "shard long, path string, base long")
    return shards.repartition(max(1, len(rows)), "shard").mapInArrow(tidy(read), out)


def write_and_read(spark: SparkSession, docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the record files of ``docs`` and returns what reading them gives, one row a record.

    Null text: only the end id. Null doc_id: first, framed as null. Repeated rows are records of their own, next
    to each other; equal doc_ids are ordered by text. Empty table: no files, no rows. Extra columns aren't written.
    """
    folder = folder or fresh_dir(spark, "token-records")
    return read_shards(spark, write_shards(docs, folder, tokenizer, end_id))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: a row per record, as read from the files; nulls, ties, repeated rows, empty tables and extra columns as in ``write_and_read``."""
    return write_and_read(spark, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark, table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
