"""Alignment against the two libraries' own ids and a plain loop over their ends."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from entroflow.llm import alignment as al
from entroflow.llm.bpe import byte_alphabet

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ends(sizes):
    out = []
    for s in sizes:
        out.append((out[-1] if out else 0) + s)
    return out


def one(both, text):
    """Ids of either side, groups and links of a text."""
    a, b = both
    if not text:
        return [], [], [], []
    alphabet, raw = byte_alphabet(), (" " + text).encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [bytes(alphabet[ch] for ch in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(ba) != raw or b"".join(bb) != raw:
        return [], [], [], []
    ea, eb = ends(map(len, ba)), ends(map(len, bb))
    groups, links, p, q = [], [], 0, 0
    for e in sorted(set(ea) & set(eb)):
        i, j = ea.index(e, p) + 1, eb.index(e, q) + 1
        groups.append((ia[p:i], ib[q:j]))
        links.append((ia[i - 1], ib[j - 1]))
        p, q = i, j
    return ia, ib, groups, links


def brute(both, docs):
    found = [(d, *one(both, t)) for d, t in docs]
    count = Counter(link for *_, links in found for link in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for d, ia, ib, groups, links in found:
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(spelt.encode()).hexdigest() if groups else ""
        rows.append((d, len(ia), len(ib), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(rows, key=str)


def got(df, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in al.align_documents(df, **options).collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_whole_table(spark, sf_dir, both):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(df) == brute(both, [(r.doc_id, r.text) for r in df.collect()])


def test_edges(spark, both, monkeypatch):
    odd = [None, "", " ", "  two  blanks ", "▁ blank", "<s> </s> <unk> <|endoftext|> <0x41>", "日本語 テキスト 🦜🦜", "a\tb\r\n\x00c", "é é", "x" * 300, " " * 100, "naïve ﬁ　x", "it's I'LL"]
    docs = [(i, t) for i, t in enumerate(odd)] + [(None, "the cat"), (None, None), (3, "the cat"), (2**60 + 1, "the cat sat")]
    want = brute(both, docs)
    assert got(frame(spark, docs)) == want
    assert got(frame(spark, docs), broadcast_pairs=0) == want
    assert got(frame(spark, docs).selectExpr("*", "1 AS uid", "2 AS a", "3 AS count", "'x' AS n")) == want
    assert got(frame(spark, [])) == []


def test_long_texts_in_stretches(spark, both, monkeypatch):
    words = " ".join(f"w{i * 7919 % 10007}  x" if i % 5 else "é日 " for i in range(20_000))
    model = al.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    assert model.stretches
    assert model.encode_all([words, "y" * 50_000, words[:100]]) == both[1].encode([words, "y" * 50_000, words[:100]])


def test_groups(spark, both):
    docs = [(1, "alignment of tokenizers, naïvely"), (2, None), (None, "日本 x")]
    rows = al.grouped_tokens(frame(spark, docs)).collect()
    for d, t in docs:
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.group)
        assert [(r.a, r.b) for r in own] == [(list(a), list(b)) for a, b in one(both, t)[2]]
        assert not own or (own[0].start, own[-1].end) == (0, len((" " + t).encode())) and all(x.end == y.start for x, y in zip(own, own[1:]))


def test_pairs_are_suffixes(spark, sf_dir, both):
    """The bound on what is broadcast: of linked tokens one is a suffix of the other."""
    a = al.worker_cache(("t",), lambda: al.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    pairs = al.pair_counts(al.aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()
    assert pairs and all((x := a.a_bytes[r.a]).endswith(y := a.b.pieces[r.b]) or y.endswith(x) for r in pairs)
    assert all(r.best_b >= r["count"] <= r.best_a for r in pairs)
