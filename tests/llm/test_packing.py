import zlib

import numpy as np
import pytest

from entroflow.llm import packing
from entroflow.llm.bpe import tokenizer_path

SCHEMA = "doc_id long, text string, bucket string, length long"


def ids_of(texts):
    enc = packing.ChunkEncoder(tokenizer_path(packing.WORD_BPE))
    return [np.asarray([*e.ids, packing.END_ID], "<u4") for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(spark, docs, sequence=4096, classes=256):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA)
    pieces = packing.pack_documents(df, sequence=sequence, classes=classes).collect()
    ids, seen = dict(zip([i for i, _ in docs], ids_of([t for _, t in docs]))), {}
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.length == len(own[p.start : p.start + p.length]) > 0
        assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        seen.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    covered = {}
    for p in pieces:
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
    assert {i: sum(n for _, n in c) for i, c in covered.items()} == {i: len(x) for i, x in ids.items()}
    for c in covered.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(c), sorted(c)[1:]))
    return seen


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, "word"), (4, "a b " * 9000), (5, "<|endoftext|> x"), (6, "word")])
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_sequences_are_well_filled(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 200, 1500))]
    seen = check(spark, docs, 256, 64)
    assert sum(n for p in seen.values() for _, n in p) / (256 * len(seen)) > 0.94


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b", "", 1)] * 3 + [(7, "c", "", 1)] * 2, SCHEMA)
    p = packing.pack_documents(df).collect()
    assert len(p) == 5 and {x.sequence_id for x in p} == {0} and sorted(x.offset for x in p)[0] == 0


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_solution_covers_and_is_near_the_bound(n):
    lengths = np.random.default_rng(n).integers(1, 60, n)
    demand = np.bincount(lengths, minlength=65)[1:65]
    patterns = packing.solve(demand, 64)
    assert (sum(p.count * p.uses for p in patterns) >= demand).all()
    assert all((p.count * np.arange(1, 65)).sum() <= 64 for p in patterns)
    assert sum(p.uses for p in patterns) <= np.ceil(lengths.sum() / 64 * 1.02) + 3


def test_pricing_is_exact():
    rng = np.random.default_rng(5)
    sizes, values = np.array([2, 3, 7]), rng.uniform(0, 1, 3)
    best = max(a * values[0] + b * values[1] + c * values[2] for a in range(11) for b in range(7) for c in range(3) if 2 * a + 3 * b + 7 * c <= 20)
    worth, count = packing.price(values, sizes, 20)
    assert worth == pytest.approx(best) and count @ sizes <= 20 and count @ values == pytest.approx(best)


def test_no_demand():
    assert packing.solve(np.zeros(64, int), 64) == []
