"""Packing documents into fixed-length sequences by cutting-stock column generation.

Tokens: the word-level BPE is encoded chunk by chunk (chunks end at ASCII white space, which the tokenizer drops), with
a bounded memo in each worker. A document over the sequence length gives full pieces and a remainder; the others stay
whole. Histogram: pieces are counted by length class, a fixed number of classes whatever the input. Columns: on that
histogram, and so at the same cost for any input, a linear program over patterns (multisets of classes that fit into a
sequence) is solved by column generation; a knapsack by dynamic programming prices new patterns. Rounding: patterns are
used floor(x) times, what is left is filled largest first. Assignment: the pieces of a class are ranked within hash
buckets whose sizes follow the input, bucket totals give each piece its rank, and rank intervals of the patterns name
its sequence. Offsets are running sums within a sequence, which holds a bounded number of pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import materialize, small_batches, table, worker_cache

WORD_BPE = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 2
#: Length classes of a sequence; a class is SEQUENCE / CLASSES tokens wide.
CLASSES = 256
#: Pieces that a rank bucket of a class holds on average, at most.
BUCKET_ROWS = 500
#: Chunks that a worker's memo holds before it starts afresh, some 200 MB; rare chunks recur, and encoding one is slow.
MEMO_CHUNKS = 1_000_000


STOPS = re.compile(rb"(?<=[a-z])([,.])(?=\s)")


def chunks(text: str | None) -> list[bytes]:
    """Parts of a text that the tokenizer encodes alone, in order.

    It drops white space and lower-cases, so ASCII white space separates them and A-Z may go before; a comma or full
    stop between a letter and white space is a piece of its own. A text that may hold an added token, whose case
    counts, is only split.
    """
    if not text:
        return []
    raw = text.encode()
    return raw.split() if b"<|" in raw else STOPS.sub(rb" \1", raw.lower()).split()


class ChunkEncoder:
    """Ids of whole texts as bytes, little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A NUL between blanks is a token of its own; it tells where a chunk's ids end.
        self.zero = self.tokenizer.encode("\0", add_special_tokens=False).ids
        assert len(self.zero) == 1
        self.memo: dict[bytes, bytes] = {}

    def _learn(self, chunks: set[bytes]) -> None:
        joined = [c for c in chunks if b"\0" not in c]
        groups = [joined[i : i + 1000] for i in range(0, len(joined), 1000)]
        texts = [" \0 ".join(c.decode() for c in g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.zero[0]), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for c, end in zip(group, ends):
                self.memo[c] = raw[4 * at : 4 * end]
                at = end + 1
        alone = [c for c in chunks if b"\0" in c]
        for c, e in zip(alone, self.tokenizer.encode_batch([c.decode() for c in alone], add_special_tokens=False)):
            self.memo[c] = np.asarray(e.ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        rows = [chunks(t) for t in texts]
        seen = set().union(*rows)
        missing = seen.difference(self.memo)
        if len(self.memo) + len(missing) > MEMO_CHUNKS:
            self.memo.clear()
            missing = seen
        if missing:
            self._learn(missing)
        get = self.memo.__getitem__
        for r in rows:
            yield b"".join(map(get, r))


def encoder(path: str) -> ChunkEncoder:
    return worker_cache(("chunks", path), lambda: ChunkEncoder(path))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Encode each row of (doc_id, text), null as empty, append the end id, and cut it into pieces of at most a sequence."""
    path = path or tokenizer_path(WORD_BPE)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in small_batches(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, sequence):
                    piece = ids[4 * at : 4 * (at + sequence)]
                    for column, v in zip(out, (doc, at, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


@dataclass
class Pattern:
    """count[i] pieces of class i + 1 in each of `uses` sequences."""

    count: np.ndarray
    uses: int


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the multiset of sizes within capacity whose values sum to most."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        best[c] = best[c - 1]
        if len(fits):
            gain = best[c - sizes[fits]] + values[fits]
            i = int(np.argmax(gain))
            if gain[i] > best[c] + 1e-12:
                best[c], taken[c] = gain[i], fits[i]
    count, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            count[taken[c]] += 1
            c -= sizes[taken[c]]
    return float(best[capacity]), count


def solve(demand: np.ndarray, capacity: int = CLASSES, rounds: int = 5000, gap: float = 1e-3) -> list[Pattern]:
    """Patterns that together offer at least demand[i] places of size i + 1, for few sequences.

    Revised simplex on the covering program: the basis starts with one pattern a class, the priced pattern enters, the
    ratio test names the one that leaves. It ends when no pattern prices out or when the duality bound is within gap.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1].astype(float)
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    for _ in range(rounds):
        x = inverse @ need
        dual = inverse.sum(axis=0)
        worth, column = price(np.maximum(dual, 0), sizes, capacity)
        if worth <= 1 + gap:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    x = np.maximum(inverse @ need, 0)
    left = demand.astype(np.int64).copy()
    patterns = []
    for j in np.argsort(-x, kind="stable"):
        uses = int(np.floor(x[j] + 1e-9))
        if uses:
            count = np.zeros(len(demand), np.int64)
            count[sizes - 1] = np.rint(basis[:, j]).astype(np.int64)
            patterns.append(Pattern(count, uses))
            left -= count * uses
    left = np.maximum(left, 0)
    while left.any():
        room, count = capacity, np.zeros(len(demand), np.int64)
        for i in np.flatnonzero(left)[::-1]:
            n = min(int(left[i]), room // (i + 1))
            count[i] += n
            room -= n * (i + 1)
        used = count > 0
        uses = int((left[used] // count[used]).min())
        patterns.append(Pattern(count, uses))
        left -= count * uses
    return patterns


def rank_intervals(patterns: list[Pattern], classes: int) -> list[dict[str, np.ndarray]]:
    """For each class the rank at which each pattern that uses it begins, its first sequence and its places a sequence."""
    base = np.concatenate([[0], np.cumsum([p.uses for p in patterns])]).astype(np.int64)
    out = []
    for i in range(classes):
        own = [j for j, p in enumerate(patterns) if p.count[i]]
        places = np.array([patterns[j].count[i] for j in own], np.int64)
        offered = np.array([patterns[j].uses for j in own], np.int64) * places
        out.append({"begin": np.concatenate([[0], np.cumsum(offered)])[:-1].astype(np.int64), "base": base[own], "places": places})
    return out


def assign(pieces: DataFrame, sequence: int = SEQUENCE, classes: int = CLASSES) -> DataFrame:
    """Give each piece its sequence_id and offset; pieces have the columns that cut_documents returns."""
    width = sequence // classes
    sized = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    rows = sized.groupBy("class").count().collect()  # one row a class
    demand = np.zeros(classes, np.int64)
    for r in rows:
        demand[r["class"] - 1] = r["count"]
    intervals = rank_intervals(solve(demand, classes), classes)
    buckets = 1 + int(demand.max()) // BUCKET_ROWS

    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("class", "bucket").count().select("class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = sized.withColumn("rank", F.row_number().over(within)).join(totals, ["class", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("ahead"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            seq = np.zeros(len(rank), np.int64)
            for i in np.unique(kind):
                at, v = kind == i, intervals[i - 1]
                j = np.searchsorted(v["begin"], rank[at], "right") - 1
                seq[at] = v["base"][j] + (rank[at] - v["begin"][j]) // v["places"][j]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select(*columns, "class", "rank").mapInArrow(name, f"{PIECES}, sequence_id long")
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, classes: int = CLASSES) -> DataFrame:
    """Pack rows of (doc_id, text) into sequences of at most `sequence` tokens.

    Returns a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are
    one end id. Only documents over a sequence are cut, at multiples of it, so long texts give full sequences and one
    remainder. Repeated rows are packed as often as they occur; rows with a null doc_id are packed like any other.
    Ties in length are ranked by hash bucket, doc_id and start. Other columns are ignored; no rows give no pieces.
    """
    return assign(materialize(cut_documents(docs, path, sequence), "packing-pieces"), sequence, classes)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
