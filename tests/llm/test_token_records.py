import zlib

import numpy as np
import pytest

from marketloom.llm import token_records as T
from marketloom.llm.files import read_bytes


def test_frames_round_trip_and_checksums():
    data = T.frame(T.payload(7, np.array([1, 2, 49407]), 2)) + T.frame(T.payload(None, np.array([]), 2))
    got = list(T.frames(data))
    assert got[0][0] == 7 and got[0][1].tolist() == [1, 2, 49407] and got[1][0] is None
    for at in (0, 9, 13, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(T.frames(bytes(bad)))


def test_files_hold_what_the_tokenizer_gives(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {3: "Hello  wörld\n\tΣΑΣ it's", 1: None, 2: "", 5: "x" * 3000 + " \ue000 a\ue000b  <|endoftext|>á b c 1234,5.", 4: "Hello  wörld\n\tΣΑΣ it's", None: "n"}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(3, texts[3], "again")], "doc_id long, text string, start string")
    folder = f"file://{tmp_path}/out"
    manifest = T.write_shards(docs, folder)
    rows = T.read_shards(spark, manifest).collect()
    t = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    want, start = [], 0
    for k in [None, 1, 2, 3, 3, 4, 5]:
        ids = np.array(t.encode(texts[k] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in rows)
    paths = {m.shard: m for m in manifest}
    r = next(r for r in rows if r.doc_id == 5)
    doc, ids = T.read_one(paths[r.shard].path, r.offset)
    assert doc == 5 and len(ids) == r.n_tokens
    m = paths[r.shard]
    assert r.offset in np.frombuffer(read_bytes(m.index_path), "<u8")


def test_empty_table(spark):
    assert T.write_and_read(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fast_path_against_the_tokenizer():
    """Every kind of piece, from each kind of character by itself and mixed, and a text longer than a group."""
    import random

    import pyarrow as pa

    r = random.Random(4)
    chars = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180), 0x301, 0x3A3, 0x3C2, 0x130, 0x1E9E, 0x4E2D, 0xFB01, 0x1F600]]
    letters = [c for c in chars if T.SIMPLE.fullmatch(c)]
    pieces = [*chars, *("".join(r.choice(chars) for _ in range(r.randrange(1, 9))) for _ in range(3000))]
    pieces += ["".join(r.choice(letters) for _ in range(r.randrange(1, 15))) + r.choice(["", ".", "!?", "***"]) for _ in range(3000)]
    texts = [r.choice([" ", "\n", "  ", "\t"]).join(r.sample(pieces, r.randrange(0, 40))) for _ in range(400)] + [None, "", " ".join(pieces * 400)]
    enc = T.Encoder(None, 1)
    assert enc.plain
    got = list(enc.encode(pa.array(texts)))
    want = enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert all(g.tolist() == [*w.ids, 1] for g, w in zip(got, want, strict=True))


def test_other_definitions_take_the_whole_tokenizer():
    import json

    import public_tokenizers

    with open(public_tokenizers.path(T.TOKENIZER), encoding="utf-8") as f:
        d = json.load(f)
    assert T.is_plain(d)
    assert not T.is_plain(d | {"normalizer": None}) and not T.is_plain(d | {"model": d["model"] | {"end_of_word_suffix": None}})
    assert not T.is_plain(d | {"added_tokens": [{"content": "hello"}]}) and not T.is_plain(d | {"pre_tokenizer": {"type": "Whitespace"}})


def test_records_are_read_in_blocks(tmp_path, monkeypatch):
    rows = [(i if i % 3 else None, np.arange(i * 37 % 5000)) for i in range(60)]
    (tmp_path / "a.rec").write_bytes(b"".join(T.frame(T.payload(i, x, 4)) for i, x in rows))
    monkeypatch.setattr(T, "READ_BYTES", 1000)
    got = list(T.records(f"file://{tmp_path}/a.rec"))
    assert [(i, x.tolist()) for i, x, _ in got] == [(i, x.tolist()) for i, x in rows] and T.read_one(f"file://{tmp_path}/a.rec", got[17][2])[0] == 17
    (tmp_path / "b.rec").write_bytes((tmp_path / "a.rec").read_bytes()[:-1])
    with pytest.raises(ValueError):
        list(T.records(f"file://{tmp_path}/b.rec"))
