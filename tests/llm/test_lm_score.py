import collections
import math

import numpy as np
import pytest

from entroflow.llm import lm_score as lm

from .brute import crc, words

SCHEMA = "doc_id long, text string, token long, score double"


def brute(docs):
    tokens = [(i, [*words(t), None]) for i, t in docs]
    held = [i is not None and crc(i) % 7 == 2 for i, _ in docs]
    c = collections.Counter(w for (i, ws), h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, ws), h in zip(tokens, held)]


def check(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], SCHEMA)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score_documents(df, **options).collect()), key=str)
    want = sorted(brute(docs), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_edge_cases(spark):
    docs = [(i, f"the cat number {i} sat on mat {i % 3}") for i in range(50)] + [(60, None), (61, ""), (62, " \n"), (None, "the null cat"), (63, "A Á a"), (63, "A Á a"), (64, "word " * 30_000)]
    check(spark, docs)
    check(spark, docs, head=1)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lm.score_documents(df).count() == 0
    only_held = [i for i in range(200) if crc(i) % 7 == 2]
    check(spark, [(i, "all held out") for i in only_held])


def test_whole_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_levels():
    c = np.arange(1, 5000)
    q = lm.level_of(c)
    assert (q >= 1).all() and (np.diff(q) >= 0).all() and lm.MEANS[1] == 1 and lm.MEANS[2] == 2 and lm.MEANS[3] == 3
    assert (np.abs(lm.MEANS[q] / c - 1) < 0.34).all()


def test_filter_never_undercounts(spark):
    docs = spark.createDataFrame([(f"a b c w{i % 40} a b",) for i in range(400)], "text string")
    f = lm.build_filter(docs, 400 * 7)
    h = lm.WordHashes()
    t = np.array([h[b"a"], h[b"b"], h[b"w3"], h[b"nowhere"]], np.int64)
    got = f.levels(lm.unigram(t))
    assert (got[:3] >= lm.level_of(np.array([800, 800, 10]))).all()
    assert f.levels(lm.bigram(t[:1], t[1:2]))[0] >= lm.level_of(np.array([800]))[0]
    fake = lm.mix(np.arange(10_000, dtype=np.uint64))
    assert (f.levels(fake) > 0).mean() < 0.05


def test_model_beats_the_base_on_held_out_text(spark):
    rng = np.random.default_rng(0)
    follow = {i: rng.integers(0, 200, 3) for i in range(200)}
    docs = []
    for i in range(600):
        w = [int(rng.integers(0, 200))]
        for _ in range(40):
            w.append(int(rng.choice(follow[w[-1]])))
        docs.append((i, " ".join(f"w{x}" for x in w)))
    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], SCHEMA)
    rows = [r for r in lm.score_documents(df).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.05 * sum(r.n_tokens for r in rows)
    assert all(r.score < 0 for r in rows)


def test_mass_of_the_model_over_the_vocabulary(spark):
    """The probabilities of all words after a context add up to about one: levels round counts, and absent pairs are found now and then.

    Nothing follows the end of a text, so its context keeps the share of the single words alone.
    """
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.4, 60)) for _ in range(300)]
    tokens = [w for t in texts for w in (*words(t), b"")]
    n, v = len(tokens), len(set(tokens))
    f = lm.build_filter(spark.createDataFrame([(t,) for t in texts], "text string"), n)
    h = lm.WordHashes()
    every = np.array([h[w] for w in sorted(set(tokens))], np.int64)
    word = np.minimum((f.counts(lm.unigram(every)) + 1) / (n + v + 1), 1)
    mass = []
    for w in sorted(set(tokens))[:60]:
        ahead = f.counts(lm.unigram(np.array([h[w]], np.int64)))[0]
        trust = lm.TRUST * ahead / (ahead + lm.MU)
        pair = f.counts(lm.bigram(np.full(len(every), h[w]), every))
        mass.append((trust * np.minimum(pair / ahead, 1) + (1 - trust) * word).sum())
    assert 1 - lm.TRUST < min(mass) and max(mass) < 1.3 and 0.9 < np.mean(mass) < 1.15
    print("mass", min(mass), np.mean(mass), max(mass))


def test_filter_grows_with_its_entries():
    assert [lm.segments_for(n) for n in (0, 1, 10**8, 10**9, 10**10)] == [1024, 1024, 1024, 1024, 16384]


def test_filter_fits_distinct_text(spark):
    """Each bigram of this text is new: at 8 bits a token one absent bigram in six would be found."""
    docs = spark.createDataFrame([(" ".join(f"w{i}x{j}" for j in range(200)),) for i in range(1200)], "text string")
    f = lm.build_filter(docs, 1200 * 201)
    assert (f.levels(lm.mix(np.arange(20_000, dtype=np.uint64))) > 0).mean() < 0.02


def test_head_gives_the_filters_scores(spark, sf_dir, monkeypatch):
    """From no n-gram in the head to all of them, the scores are the same."""
    monkeypatch.setattr(lm, "CHUNK_CHARS", 3000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).collect()] + [(None, None), (-1, ""), (-2, "unheard of words"), (-2, "unheard of words"), (-3, "word " * 3000)]
    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in rows], SCHEMA)
    for d in (df, df.where("doc_id = 0"), df.where("false")):
        one, *others = (sorted(map(tuple, lm.score_documents(d, head_keys=k).collect()), key=str) for k in (1, 50_000, 1 << 40))
        for other in others:
            # Spark adds up the rare words of a base score in any order; the rest is the same to the bit.
            assert [r[:5] + r[6:] for r in one] == [r[:5] + r[6:] for r in other] and len(one) == d.count()
            assert [r[5] for r in one] == pytest.approx([r[5] for r in other], rel=1e-12)


def test_head_is_bounded(spark):
    docs = spark.createDataFrame([(f"a b c w{i % 40} a b",) for i in range(400)], "text string")
    n = lm.most_tokens(docs)
    assert n >= 400 * 7
    for most in (1, 3, 10, 1000):
        assert len(lm.Head.of(lm.filter_table(docs, n, most)).keys) <= most


def test_score_agrees_with_counted_levels(spark):
    """The score from a plain count of n-grams and their levels; a filter finds some n-grams at too high a level."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.4, 50))) for i in range(300)]
    tokens = {i: [*words(t), None] for i, t in docs}
    learned = [ws for i, ws in tokens.items() if crc(i) % 7 != 2]
    c = collections.Counter(w for ws in learned for w in ws) + collections.Counter({"": len(learned)})
    pairs = collections.Counter(p for ws in learned for p in zip(["", *ws], ws))
    n = sum(map(len, learned))
    v = len(c) - 1

    def mean(x):
        return lm.MEANS[lm.level_of(np.array([x]))[0]] if x else 0.0

    def score(ws):
        out = 0.0
        for before, w in zip(["", *ws], ws):
            t = lm.TRUST * mean(c[before]) / (mean(c[before]) + lm.MU)
            out += math.log10(t * min(mean(pairs[before, w]) / max(mean(c[before]), 1), 1) + (1 - t) * min((mean(c[w]) + 1) / (n + v + 1), 1))
        return out

    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], SCHEMA)
    off = np.array([r.score - score(tokens[r.doc_id]) for r in lm.score_documents(df).collect()])
    assert np.median(np.abs(off)) < 0.2 and np.abs(off).max() < 1.5
    print("off", off.min(), np.median(np.abs(off)), off.max())
