import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from entroflow.llm import common, minhash
from entroflow.llm.graph import components

from .brute import near_components, shingles

SCHEMA = "doc_id long, text string, component long, key string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], SCHEMA)


def group(seed, base_words=120, members=60, change=0.05, start=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    out = []
    for i in range(members):
        w = [x if rng.random() > change * rng.random() * 2 else f"z{rng.randrange(9999)}" for x in base]
        out.append((start + i, " ".join(w)))
    return out


def check(spark, docs, width=2):
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, docs), width=width).collect()}
    want = near_components(dict(docs), width)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t, width)) for i, t in docs}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two\n"), (8, "two one"), (9, "É é"), (10, "é é"), (11, "a b " * 20_000), (12, "a b " * 20_001)]
    check(spark, docs)


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_null_and_repeated_ids(spark):
    r = minhash.near_duplicates(frame(spark, [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c")])).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in r) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True)]


@pytest.mark.parametrize("change", [0.03, 0.06, 0.12])
def test_group_of_near_copies(spark, change):
    check(spark, group(1, members=120, change=change) + group(2, members=15, change=0.02, start=500) + [(900 + i, f"single text number {i} of its own kind") for i in range(20)])


def test_five_word_shingles(spark):
    check(spark, group(3, members=60, change=0.02), width=5)


def test_groups_of_strangers_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SMALL", 8)
    check(spark, group(4, members=90, change=0.10))


def test_sf_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in minhash.op2_minhash(spark, sf_dir).collect()}
    assert got == near_components(dict(docs))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (7, 7), (None, 3), (100, 50)] + [(200, 200 + i) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    want = {i: 0 for i in range(1, 41)} | {100: 50, 75: 50} | {200 + i: 200 for i in range(1, 30)}
    assert got == want
    assert components(df.where(F.lit(False))).count() == 0


def test_long_words_are_not_kept(spark):
    memo = common.WordHashes()
    long = [b"%06d" % i * 1000 for i in range(500)]
    assert [memo[w] for w in long] == [common.WordHashes()[w] for w in long]
    assert memo[b"short"] == memo[b"short"]
    assert sum(map(len, memo)) < 1000
    check(spark, [(i, "".join(chr(0x4E00 + (i // 2 * 7 + j * 13) % 5000) for j in range(3000)) + f" tail of {i // 2}") for i in range(20)])


def test_minimum_hashes_take_memory_by_the_piece():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 200_000, 3, *[20_000] * 150, 2, 1)]
    tracemalloc.start()
    got = minhash.minimum_hashes(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    for i in (0, 1, 2, 3, 70, 152, 153, 154):
        assert (got[i] == [((((sets[i] ^ x) * t) >> np.uint64(32)).min()) for x, t in zip(minhash.XOR, minhash.TIMES)]).all()


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pc.sum(pc.binary_length(b.column(1))).as_py()], pa.int64())], ["n"])

    docs = spark.range(300, numPartitions=1).select("id", F.expr("repeat('ab ', 40000)").alias("text"))
    with common.arrow_rows(spark, minhash.ARROW_ROWS, getattr(minhash, "ARROW_BYTES", None)):
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 300 * 120_000
    assert max(got) <= (4 << 20) + 120_000
