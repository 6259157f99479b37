"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a piece model end at the same byte of a text.

Both encode a blank and the text. A two-pointer merge of the cumulative token ends, inside mapInPandas, finds the byte
offsets at which both have a boundary; they cut the tokens into groups, and the two tokens that end there are linked.
Spark counts the links of each id pair over the corpus and joins the counts, and the highest count of either side's id,
back to the documents' links.

The pair counts are small whatever the corpus: tokens that end together match byte by byte from their ends, so one is a
suffix of the other, and a vocabulary's tokens have as many suffixes as they have bytes. For the two public
vocabularies this allows 324,297 pairs. The join broadcasts them after checking their number, and shuffles beyond it.

Long texts are encoded whole: for the piece model in stretches that begin where a blank follows another character, as
no piece holds a blank after anything but blanks, which the encoder checks when it reads the model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import row_ids
from .bpe import BYTE_BPE, codec, tokenizer_path
from .common import arrow_rows, materialize, table, worker_cache

PIECES = "piece_bpe_32k.model"
#: Characters after which a stretch for the piece model ends at the next place that allows it.
STRETCH = 20_000
#: Characters of the texts that are merged at once, unless one text has more.
MERGED = 1_000_000
#: Pairs of ids that are broadcast at most.
BROADCAST_PAIRS = 2_000_000
BLANK = "▁"

_BREAK = re.compile(r"(?<=[^ ]) ")


class PieceModel:
    """A sentencepiece model; pieces[i] is the bytes that id i stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.stretches = not any(BLANK in p.lstrip(BLANK) for p in names)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text as the model gives them, which puts a blank in front."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while self.stretches and len(text) - at > STRETCH:
                found = _BREAK.search(text, at + STRETCH)
                if not found:
                    break
                # The blank is left out, as the model adds one.
                parts.append(text[at : found.start()])
                owner.append(i)
                at = found.end()
            parts.append(text[at:])
            owner.append(i)
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in zip(owner, self.model.encode(parts, num_threads=1)):
            out[i] += ids
        return out


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = codec(byte_path), PieceModel(piece_path)
        n = max(self.a.pieces) + 1
        self.a_bytes = [self.a.pieces.get(i, b"") for i in range(n)]
        self.a_size = np.array([len(p) for p in self.a_bytes], np.int64)
        self.b_size = np.array([len(p) for p in self.b.pieces], np.int64)
        ids_a, ids_b = [str(i).encode() for i in range(n)], [str(i).encode() for i in range(len(self.b.pieces))]
        #: What a token adds to the text of groups, for A and then B: within its group, and as its side's last.
        self.spelt = [i + b"," for i in ids_a] + [i + b"|" for i in ids_a] + [i + b"," for i in ids_b] + [i + b";" for i in ids_b]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Both sides' ids of each text; none where it is null or empty or either side's bytes aren't those of blank and text."""
        pieces = iter(self.b.encode_all([t for t in texts if t]))
        for text in texts:
            if not text:
                yield [], []
                continue
            raw, b = b" " + text.encode(), next(pieces)
            a = self.a.quick.encode_ordinary(" " + text)
            same = b"".join(map(self.b.pieces.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a)) == raw
            yield (a, b) if same else ([], [])


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in either side of the ends that both have: a merge of two ascending runs (a stable sort of them), in which equal ends meet."""
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")
    ends = both[order]
    meet = np.flatnonzero(ends[1:] == ends[:-1])
    return order[meet], order[meet + 1] - len(ends_a)


ALIGNED = "uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def _aligned(al: Aligner, texts: list[str | None]) -> dict[str, list]:
    """For each text the columns of ALIGNED after doc_id: numbers, the digest of its groups, and its distinct linked pairs with their number."""
    encoded = list(al.encode_all(texts))
    n_a, n_b = (np.array([len(e[side]) for e in encoded], np.int64) for side in (0, 1))
    a, b = (np.array([i for e in encoded for i in e[side]], np.int64) for side in (0, 1))
    doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    # Texts follow one another, so ends ascend over all of them; each text's last ends meet.
    at_a, at_b = merged(np.cumsum(al.a_size[a]), np.cumsum(al.b_size[b]))
    n_groups = np.bincount(doc_a[at_a], minlength=len(texts))

    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[at_a], last_b[at_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    codes = np.concatenate([a + last_a * len(al.a_bytes), b + last_b * len(al.b.pieces) + 2 * len(al.a_bytes)])
    spelt = list(map(al.spelt.__getitem__, codes[np.argsort(np.concatenate([group_a, group_b]), kind="stable")].tolist()))
    ends = np.cumsum(n_a + n_b)
    digests = [hashlib.sha256(b"".join(spelt[e - n : e])[:-1]).hexdigest() if n else "" for e, n in zip(ends.tolist(), (n_a + n_b).tolist())]

    width = len(al.b.pieces)
    pair, n = np.unique((doc_a[at_a] * len(al.a_bytes) + a[at_a]) * width + b[at_b], return_counts=True)
    own, pair = np.divmod(pair, width * len(al.a_bytes))
    cut = np.searchsorted(own, np.arange(1, len(texts)))
    split = lambda v: np.split(v.astype(np.int32), cut) if len(texts) else []
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": digests, "a": split(pair // width), "b": split(pair % width), "n": split(n)}


def _whole(ids: pd.Series) -> pd.Series:
    """Ids that came as strings, as pandas would turn a column of whole numbers with nulls into floating ones."""
    return pd.Series(pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"))


def _runs(texts: list[str | None]) -> Iterator[slice]:
    """Slices of texts of at most MERGED characters, or of one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > MERGED and i > at:
            yield slice(at, i)
            at, size = i, len(t or "")
    if at < len(texts):
        yield slice(at, len(texts))


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """A row a document: uid (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256, and its distinct links as arrays a, b (ids) and n (how often)."""
    paths = byte_path or tokenizer_path(BYTE_BPE), piece_path or tokenizer_path(PIECES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al, ids = worker_cache(("align", *paths), lambda: Aligner(*paths)), row_ids()
        for f in frames:
            texts = [None if pd.isna(t) else t for t in f["text"]]
            for part in _runs(texts):
                own = f["doc_id"].iloc[part]
                yield pd.DataFrame({"uid": [next(ids) for _ in own], "doc_id": _whole(own), **_aligned(al, texts[part])})

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, ALIGNED)


def grouped_tokens(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """A row a group: doc_id, group (from 0), start, end (bytes of blank and text), a and b (its ids in order). Documents without tokens give none."""
    paths = byte_path or tokenizer_path(BYTE_BPE), piece_path or tokenizer_path(PIECES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = worker_cache(("align", *paths), lambda: Aligner(*paths))
        for f in frames:
            for doc, text in zip(_whole(f["doc_id"]), f["text"]):
                a, b = (np.array(v, np.int64) for v in al.encode(None if pd.isna(text) else text))
                if not len(a):
                    continue
                ends = np.cumsum(al.a_size[a])
                at_a, at_b = merged(ends, np.cumsum(al.b_size[b]))
                stop = ends[at_a]
                yield pd.DataFrame(
                    {"doc_id": pd.array([doc] * len(stop), "Int64"), "group": np.arange(len(stop)), "start": np.concatenate([[0], stop[:-1]]), "end": stop, "a": np.split(a, at_a[:-1] + 1), "b": np.split(b, at_b[:-1] + 1)}
                )

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id long, `group` long, start long, `end` long, a array<int>, b array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, count: links of each id pair over all documents, with the highest count of its A id (best_a) and of its B id (best_b)."""
    links = found.select(F.explode(F.arrays_zip("a", "b", "n")).alias("l")).select("l.*")
    counts = materialize(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "op12-pairs")
    best = lambda side: counts.groupBy(side).agg(F.max("count").alias(f"best_{side}"))
    return counts.join(best("a"), "a").join(best("b"), "b").select("a", "b", "count", "best_a", "best_b")


def align_documents(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Alignment of each document under two tokenizers: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a.

    Null and empty texts, and texts that either tokenizer doesn't give back byte by byte (such as with the character
    that stands for a blank), have zeros and an empty groups_sha256. Ties for the highest count all count in n_best.
    Rows map one to one, repeated rows and null ids included, and repeated rows' links count each time; an empty table
    gives none, other columns are ignored.
    """
    with arrow_rows(docs.sparkSession, 500):
        found = materialize(aligned(docs, byte_path, piece_path), "op12-aligned")
    pairs = materialize(pair_counts(found), "op12-counts")
    if pairs.count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    own = ["uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    links = found.select(*own, F.explode_outer(F.arrays_zip("a", "b", "n")).alias("l")).select(*own, "l.*").join(pairs, ["a", "b"], "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = links.groupBy(*own).agg(
        count("n").alias("n_links"), count(F.when(F.col("count") == F.col("best_b"), F.col("n"))).alias("n_best"), count(F.col("n") * F.col("count")).alias("count_sum"),
        count(F.when(F.col("count") == F.col("best_a"), F.col("n"))).alias("n_best_a"),
    )
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
