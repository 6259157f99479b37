"""Personal data against the plain patterns, and disclosing terms against counts by hand."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entroflow.llm import privacy as p

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = sum(int(c) for c in d[-1::-2]) + sum(sum(map(int, str(2 * int(c)))) for c in d[-2::-2])
    return total % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(v) <= 255 for v in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def spelt(spans):
    return ",".join(f"{p.KINDS[k]}:{s}:{e}" for s, k, e in spans)


ODD = [
    "", "a@b", "a@b.c@d.e", "a@b.c@d.e.f@g.h.", "@x.y", "me.%+-@a-b.c-d..e", "x@y.z.@q.r", "1.2.3", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "0000255.01.002.3", "é1.2.3.4é", "1..2.3.4.5",
    "4111 1111-1111 1111", "4111  1111 1111 1111 4111111111111111", "+1 (499) 555-6503", "+1 499 555 6503 4111", "++49-30-1234567+49301234567)", "+1", "+12", "+(1)2", "4111111111111111@x.de", "+49 1.2.3.4.5.6.7.8",
    "٣@x.de 1٣.2.3.4", "K@x.de", "-@-.-", "0" * 16 + " " + "0" * 19 + "-" + "0" * 20,
]


@pytest.mark.parametrize("text", ODD)
def test_odd_spans(text):
    assert p.base_spans(text) == plain(text)


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="a1@.+- ()4%é", max_size=60))
def test_any_spans(text):
    assert p.base_spans(text) == plain(text)


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="0123456789 -", min_size=14, max_size=40))
def test_any_numbers(text):
    assert p.base_spans(text) == plain(text)


def test_long_runs_in_linear_time():
    for unit in ("1", "a", "a@", "1.", "1 ", "+1", "@a.", "+1 ", "1.1.1.1", "a@a.a"):
        p.base_spans(unit * 300_000)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    rows = p.op13_privacy(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(spelt(base).encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("term")) == spelt(base)
        assert r.spans.count("term") == r.n_term


def disclosed(docs, alpha, support, window):
    """{term: generalised} by plain counts."""
    n, words, pairs, entities, stems, stem_pairs = 0, {}, {}, {}, {}, {}
    for text in docs:
        spans = plain(text)
        clear = list(text)
        for s, _, e in spans:
            clear[s:e] = " " * (e - s)
        tokens = [(m.start(), m.group().lower()) for m in re.finditer(r"\w+", "".join(clear))]
        for _, w in tokens:
            n += 1
            words[w] = words.get(w, 0) + 1
            if len(w) > p.STEM:
                stems[w[: p.STEM]] = stems.get(w[: p.STEM], 0) + 1
        for s, k, e in spans:
            value = (k, text[s:e].lower() if k == 0 else re.sub("[^0-9]+", "." if k == 1 else "", text[s:e]))
            entities[value] = entities.get(value, 0) + 1
            near = [w for at, w in tokens if at < s][-window:] + [w for at, w in tokens if at >= e][:window]
            for w in set(near):
                pairs.setdefault((w, value), []).append(tuple(sorted(set(near))))
            for stem in {w[: p.STEM] for w in near if len(w) > p.STEM}:
                stem_pairs[stem, value] = stem_pairs.get((stem, value), 0) + 1
    share = lambda both, one, e: min(1.0, math.log(both * n / (one * entities[e])) / math.log(n / entities[e]))
    out = {}
    for (w, e), found in pairs.items():
        if len(set(found)) >= support and share(len(found), words[w], e) >= alpha:
            general = len(w) > p.STEM and share(stem_pairs[w[: p.STEM], e], stems[w[: p.STEM]], e) < alpha
            out[w] = out.get(w, True) and general
    return out


def revealing():
    """Filler, and 30 contexts of one address in which a name and a place occur that hardly occur elsewhere."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lorem", "winter", "stone", "garden", "window", "market") for b in ("s", "ed", "ly", "er", "ing", "")]
    some = lambda k: " ".join(rng.choices(words, k=k))
    docs = [f"{some(60)} the River, {some(20)}" for _ in range(120)]
    docs += [f"{some(30)} Zebulon {rng.choice(words)} gardenia jane.doe@mail.example.org {rng.choice(words)} Kirkwall {some(30)}" for _ in range(30)]
    docs += [f"{some(10)} zebulon spoke {some(10)}"]
    docs += ["copied passage quagga beside 188.54.39.104 only"] * 50
    return docs


def test_disclosing_terms(spark):
    docs = revealing()
    want = disclosed(docs, p.ALPHA, p.SUPPORT, p.WINDOW)
    assert {"zebulon", "kirkwall", "gardenia"} <= want.keys() and "quagga" not in want and want["gardenia"] and not want["kirkwall"] and not {"river", "lorems"} & want.keys()
    df = frame(spark, list(enumerate(docs))).repartition(5)
    got = {}
    for r in p.private_spans(df, keep_text=True).collect():
        base = [(s["start"], s["kind"], s["end"]) for s in r.spans if s["kind"] < 4]
        assert base == plain(r.text)
        for s in r.spans:
            if s["kind"] == 4:
                got[r.text[s["start"] : s["end"]].lower()] = s["general"]
        hidden = {r.text[s["start"] : s["end"]].lower() for s in r.spans if s["kind"] == 4}
        assert hidden == {w for w in re.findall(r"\w+", EMAIL.sub(" ", r.text).lower()) if w in want}
    assert got == want
    clean = {r.doc_id: r.text for r in p.sanitise(df).collect()}
    assert "[EMAIL]" in clean[125] and "Zebulon" not in clean[125] and "gard*" in clean[125] and clean[0] == docs[0] and clean[150].count("[TERM]") == 1 and "[IP]" in clean[160]


def test_edges(spark):
    docs = [(None, None), (None, "a@b.c"), (1, ""), (1, "x"), (1, "x"), (2**60 + 1, "call +1 (499) 555-6503 " * 2000)]
    rows = p.private_digests(frame(spark, docs).selectExpr("*", "1 AS uid", "2 AS key", "'x' AS spans", "3 AS base")).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_phone, r.n_term) for r in rows), key=str) == sorted([(None, 0, 0, 0), (None, 1, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (2**60 + 1, 0, 2000, 0)], key=str)
    assert p.private_digests(frame(spark, [])).collect() == []
    assert [r.text for r in p.sanitise(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [None, ""]
