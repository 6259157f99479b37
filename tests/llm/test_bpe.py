import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from entroflow.llm import bpe, packing

ALPHABET = list("aAbszt'’ \n\t.,!?-0129é 　́ñ中文🙂​\u0085|<>$#lrevmdİΣ\0\x1c") + ["'s", "'ll", "  ", "\n\n", "<|endoftext|>", "the ", " and", " '", " 're"]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return [None, "", " ", "a" * 5000, "é" * 3000, "<|endoftext|>"] + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return bpe.ForcedBoundaryCodec(bpe.tokenizer_path(bpe.BYTE_BPE))


def library(tokenizer, texts):
    return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_same_ids_as_the_library(codec, monkeypatch):
    texts = random_texts(20_000)
    want = library(codec.tokenizer, texts)
    for memo in (500_000, 5000):
        monkeypatch.setattr(bpe, "MEMO_ENTRIES", memo)
        got = [i for at in range(0, len(texts), 700) for i in codec.encode_column(pa.array(texts[at : at + 700], pa.string()))]
        assert got == want
    assert [codec.decode(i) for i in got] == [codec.tokenizer.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for i in want]


def test_batches_beyond_the_memo(codec, monkeypatch):
    """Fragments just learned stay for their batch, whatever its size."""
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 300)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(n)) for n in (200, 250, 1000, 40, 290, 1)]
    for part in (texts[:1], texts[1:2], texts[:3], texts[3:], texts):
        assert list(codec.encode_column(pa.array(part, pa.string()))) == library(codec.tokenizer, part)


def test_cuts_join_no_token(codec):
    data = np.frombuffer("one two, three".encode(), np.uint8)
    raw = data.tobytes()
    cut = [0, *codec.cuts(data).tolist(), len(raw)]
    parts = [raw[a:b] for a, b in zip(cut, cut[1:])]
    assert b"".join(parts) == raw and len(parts) > 3
    pairs = {p[i : i + 2] for p in codec.pieces.values() for i in range(len(p) - 1)}
    assert all(raw[c - 1 : c + 1] not in pairs for c in cut[1:-1])


def test_sliced_column(codec):
    texts = random_texts(50, 3)
    assert list(codec.encode_column(pa.array(texts, pa.string()).slice(7, 20))) == library(codec.tokenizer, texts[7:27])


def test_round_trip(spark):
    texts = random_texts(200, 1)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    digests = {r.doc_id: r for r in bpe.round_trip_digests(df).collect()}
    assert all(digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    assert bpe.round_trip_digests(df.where("false")).count() == 0


def test_whole_table(spark, sf_dir, codec):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(docs, library(codec.tokenizer, list(docs.values()))))
    for r in bpe.op7_bpe(spark, sf_dir).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]) // 4, hashlib.sha256(want[r.doc_id]).hexdigest())


def test_word_chunks(monkeypatch):
    enc = packing.ChunkEncoder(bpe.tokenizer_path(packing.WORD_BPE))
    texts = random_texts(20_000, 2)
    want = library(enc.tokenizer, texts)
    for memo in (500_000, 5000):
        monkeypatch.setattr(packing, "MEMO_CHUNKS", memo)
        assert [i for at in range(0, len(texts), 700) for i in enc.encode_all(texts[at : at + 700])] == want
