import numpy as np
import pytest
from pyspark.sql import functions as F

from entroflow.llm import language, quality

from .brute import crc

SCHEMA = "doc_id long, text string, lang string, source string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.0) for i, t, lang in rows], SCHEMA)


def longest_matches(q, data):
    """Phrases of q by looking for substrings."""
    n = at = 0
    while at < len(q):
        end = at + 1
        while end < len(q) and q[at : end + 1] in data:
            end += 1
        at, n = end, n + 1
    return n


def by_stretch(q, data):
    return sum(longest_matches(q[at : at + language.STRETCH], data) for at in range(0, len(q), language.STRETCH))


def test_parses_are_longest_matches():
    rng = np.random.default_rng(0)
    texts = {k: bytes(rng.choice(list(b"abc"), 200 + i).tolist()) for i, k in enumerate("xyz")} | {"one": b"abracadabra abba"}
    asked = [bytes(rng.choice(list(b"abcd"), n).tolist()) for n in [*range(40), 1023, 1024, 1025, 5000]]
    p = language.Parser(texts)
    assert p.phrases(asked).tolist() == [[by_stretch(q, texts[k]) for k in p.languages] for q in asked]
    assert p.phrases([]).shape == (0, 4)


def test_phrases_run_over_words():
    assert language.Parser({"en": b"the cat sat on the mat"}).phrases([b"cat sat on the", b"", b"?"]).tolist() == [[1], [0], [1]]


def test_predictions_same_as_by_substrings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = language.train(docs, sample=6)
    want = {}
    for r in docs.collect():
        if r.text and any(c.isalpha() for c in r.text) and len(r.text) < 6000:
            q = language.parsed_bytes(r.text)
            cost = {k: by_stretch(q, t) * np.log2(len(t)) for k, t in texts.items()}
            want[r.doc_id] = min(sorted(cost), key=cost.get)
    got = {r.doc_id: r.lang_pred for r in language.predict_language(docs, texts).collect()}
    assert len(want) > 100 and {i: got[i] for i in want} == want


def test_training_text_is_whole_rows(spark):
    rows = [(i, f"Row {i} " + "αβγ δ. " * 5000, "xx") for i in range(60)] + [(100 + i, f"uno {i}", "yy") for i in range(3)] + [(200, "½ ² 3", "zz"), (201, None, "zz")]
    texts = language.train(frame(spark, rows), sample=5)
    assert sorted(texts) == ["xx", "yy"] and texts["xx"].count(language.BETWEEN) == 5
    whole = {language.parsed_bytes(t) for _, t, _ in rows if t}
    assert all(part in whole for t in texts.values() for part in t.split(language.BETWEEN)[:-1])


def test_equal_entropies_go_to_the_first_name():
    assert language.Parser({"b": b"abc", "a": b"abc"}).predict(["xyz"]) == (["a"], [0.5])


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op1_language(spark, sf).collect()
    assert len(got) == len(lang) and all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, f"alpha beta gamma {i}", "xx") for i in range(40)] + [(100 + i, f"uno dos tres {i}", "yy") for i in range(40)]
    docs = frame(spark, [*rows, (300, None, "xx"), (301, "", None), (302, "12 !! 34 ½ ² ①", "yy"), (None, "uno dos", None), (303, "dos tres " * 50_000, None), (303, "dos tres", None)])
    texts = language.train(docs)
    got = {(r.doc_id, i): r for i, r in enumerate(language.predict_language(docs, texts).collect())}
    said = {k[0]: r.lang_pred for k, r in got.items()}
    assert said[300] == said[301] == said[302] == "und" and said[303] == said[None] == "yy" and said[0] == "xx"
    assert len(got) == docs.count() and language.keep_known(docs, texts).count() == docs.count() - 3
    empty = docs.where("false")
    assert language.train(empty) == {} and language.predict_language(empty, {}).count() == 0
    assert {r.lang_pred for r in language.predict_language(docs, {}).collect()} == {"und"}


def test_prediction_ignores_other_columns(spark):
    docs = frame(spark, [(i, "alpha beta" if i % 2 else "uno dos", "xx" if i % 2 else "yy") for i in range(60)])
    texts = language.train(docs)
    changed = docs.withColumns({"lang": F.lit("zz"), "doc_id": F.col("doc_id") + 7})
    a = [r.lang_pred for r in language.predict_language(docs, texts).collect()]
    assert a == [r.lang_pred for r in language.predict_language(changed, texts).collect()]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op10_quality(spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in out) / len(out) > 0.99
    pos, neg = [r.score for r in out if label[r.doc_id]], [r.score for r in out if not label[r.doc_id]]
    assert np.mean([[p > q for q in neg] for p in pos]) > 0.99


def test_quality_edge_cases(spark):
    rows = [(i, "A plain sentence of words, and more of them." if i % 2 else "BUY!! NOW!! " * 9, "en") for i in range(60)]
    docs = frame(spark, [*rows, (100, None, "en"), (101, "", "en"), (None, "WIN!! " * 9, "en"), (102, "word " * 100_000, "en"), (102, "word", "en")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (None, 1, 0), (100, None, 0)], "doc_id long, quality int, toxic int")
    ranking = quality.train(docs, labels)
    got = quality.score_quality(docs, ranking).collect()
    assert len(got) == docs.count()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert [r.predicted for r in got if r.doc_id is None] == [0] and [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.score_quality(docs.where("false"), ranking).count() == 0
    assert quality.train(docs, labels.where("false")) is None and quality.train(docs, labels.where("quality = 1")) is None
    assert {r.predicted for r in quality.score_quality(docs, None).collect()} == {1}
    kept = quality.keep_good(docs, ranking)
    assert kept.columns == docs.columns and kept.where("doc_id < 60 AND doc_id % 2 = 0").count() == 0


def test_weights_rank_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(int)
    r = quality.fit(x, y)
    assert r.weights[0] > 0 > r.weights[1] and ((r.score(x) >= quality.CUT) == y).mean() > 0.97


def plain_features(text):
    """The quality features by loops over characters and words."""
    text = (text or "").encode()
    words, word = [], b""
    for b in text + b" ":
        if chr(b) in " \t\n\r\x0b\x0c":
            words, word = words + [word] if word else words, b""
        else:
            word += bytes([b])
    if not words:
        return [0.0] * 8
    upper = letters = digits = symbols = seen = 0
    for b in text:
        c = chr(b)
        upper += "A" <= c <= "Z"
        letters += "A" <= c <= "Z" or "a" <= c <= "z"
        digits += "0" <= c <= "9"
        seen += b > 32
        symbols += 32 < b < 127 and not c.isalnum() and c not in ".,;:'\"-()?"
    n, lines = len(words), text.split(b"\n")
    repeats = sum(words[i] == words[i - 1] for i in range(1, n))
    return [
        upper / max(letters, 1), (symbols / seen) ** 0.5, (digits / seen) ** 0.5, (repeats / n) ** 0.5, np.log(1 + len(set(words))) / np.log(1 + n),
        min(seen / n / 10, 2.0), 1 - len(set(lines)) / len(lines), np.log(1 + n) / 10,
    ]


def plain_ranking(x, y, steps=4000, ridge=1e-3):
    """Weights and threshold by accelerated gradient descent over every pair, the threshold by trying every middle between two worths."""
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    top = np.linalg.eigvalsh(d.T @ d / len(d))[-1] / 4 + ridge
    slow = (np.sqrt(top / ridge) - 1) / (np.sqrt(top / ridge) + 1)
    w = ahead = np.zeros(x.shape[1])
    for _ in range(steps):
        new = ahead + (d.T @ (1 / (1 + np.exp(d @ ahead))) / len(d) - ridge * ahead) / top
        w, ahead = new, new + slow * (new - w)
    worth = z @ w
    s = np.unique(worth)
    wrong = lambda t: (worth[y == 1] < t).mean() + (worth[y == 0] >= t).mean()
    return z, w, min(wrong(t) for t in (s[1:] + s[:-1]) / 2), wrong


def test_ranking_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, len(quality.FEATURES)))
    y = (x[:, 0] - 2 * x[:, 1] + 0.5 * x[:, 4] + rng.normal(size=160) > 0.3).astype(int)
    z, w, least, wrong = plain_ranking(x, y)
    r = quality.fit(x, y, pairs=400_000)
    assert np.abs(r.weights - w).max() < 0.03 * np.abs(w).max()
    assert np.corrcoef(z @ r.weights, z @ w)[0, 1] > 0.9999
    # The threshold is as good as the best there is, on worths of its own.
    worth = z @ r.weights
    own = lambda t: (worth[y == 1] < t).mean() + (worth[y == 0] >= t).mean()
    s = np.unique(worth)
    assert own(r.threshold) <= min(own(t) for t in (s[1:] + s[:-1]) / 2) + 0.02 and least == pytest.approx(own(r.threshold), abs=0.05)


def test_quality_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    label = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if r.doc_id is not None and r.quality in (0, 1) and crc(r.doc_id) % 4 != 2:
            label[r.doc_id] = min(r.quality, label.get(r.doc_id, 1))
    own = {(i, t): plain_features(t) for i, t in docs}
    for (i, t), f in own.items():
        assert quality.features(t) == pytest.approx(f, abs=1e-12)
    train = [(own[i, t], label[i]) for i, t in docs if i in label]
    x, y = np.array([f for f, _ in train]), np.array([q for _, q in train])
    _, w, _, _ = plain_ranking(x, y)
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    worth = {k: (np.array(f) - x.mean(axis=0)) / scale @ w for k, f in own.items()}
    got = {r.doc_id: r.score for r in quality.op10_quality(spark, sf_dir).collect()}
    assert len(got) == len({i for i, _ in docs})
    a, b = np.array([worth[k] for k in own]), np.array([np.log(got[i] / (1 - got[i])) for i, _ in own])
    assert np.corrcoef(a, b)[0, 1] > 0.99
