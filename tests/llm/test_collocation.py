"""Phrase mining against a plain count of all phrases."""

import re
from collections import Counter

import duckdb
import pytest

from entroflow.llm import collocation as c

ALPHABET = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ALPHABET)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    held = set()
    for (lang, p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= 100 * f[lang, p[i : i + size]]:
                    held.add((lang, p[i : i + size]))
    rows = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in held:
            score, k, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -score) for lang, found in rows.items() for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def mined(df, **options):
    return sorted(tuple(r) for r in c.collocations(df, **options).collect())


def frame(spark, docs):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(docs)], "doc_id long, lang string, text string")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("least,most", [(8, 250_000), (8, 60), (30, 5)])
def test_as_a_plain_count(spark, small, least, most):
    """Also where nearly every prefix is too large for a task and is counted word by word."""
    docs = [(r.lang, r.text) for r in small.collect()]
    want = brute(docs, least)
    assert mined(small, least=least, most=most) == want and len(want) > 50


def test_long_phrases_by_every_way(spark):
    phrase = "one two three four five six"
    docs = [("en", f"{phrase} x{i % 3}, {phrase}") for i in range(40)] + [("en", "one two three"), (None, "a a a a a a a a"), ("fr", "one two")] * 12
    want = brute(docs, 10)
    for most in (1, 3, 1000):
        assert mined(frame(spark, docs).repartition(3), least=10, most=most) == want
    assert mined(frame(spark, docs), least=10, top=2) == brute(docs, 10, top=2)


def test_hot_rows_in_bitmaps_full_of_false_hits(spark, monkeypatch):
    """Prefixes that a bitmap wrongly takes for large ones keep their counts."""
    monkeypatch.setattr(c, "hits", lambda words, keys: keys == keys)
    docs = [("en", "a b c d e. b c d. e e e e e e x"), ("de", "a b a b a b q")] * 15
    assert mined(frame(spark, docs), least=10, most=20) == brute(docs, 10)


def test_edges(spark):
    docs = [(None, None), ("en", ""), ("en", " .,\n"), ("en", "A b\tC  d\x0be f"), ("en", "É b É b. a b c"), ("", "A b"), ("en", "x\x00y z")] * 10
    want = brute(docs, 5)
    more = frame(spark, docs).selectExpr("*", "1 AS f", "2 AS p", "3 AS w1", "4 AS rank", "5 AS n")
    assert mined(more, least=5) == want and want
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [("en", None)])) == []
    long = [("en", "alpha beta gamma " * 40_000 + "delta")]
    assert mined(frame(spark, long), most=1000) == brute(long, 100)


def test_exact_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", None, 10**17, None), ("en", "a", 10**14 + 1, 1), ("en", "b", 10**14, 2)], "lang string, word string, f long, id long")
    phrases = spark.createDataFrame([([1, 2], 10**14 - 1)], c.PHRASES)
    assert [r.score for r in c.scored(phrases, words).collect()] == [1000 * (10**14 - 1) * 10**17 // ((10**14 + 1) * 10**14)]


def test_sql(small, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    got = sorted(con.execute(c.OP11_SQL).fetchall())
    assert got == brute([(r.lang, r.text) for r in small.collect()], 100) and got
