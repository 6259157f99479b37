"""Language-model scores from a Bloom filter that holds quantised n-gram counts.

Training documents give unigram and bigram counts. A count c is stored as its level 1 + floor(log_BASE c): the n-gram
enters the filter once for each level up to its own, so probing level after level until one is absent returns the
level, and the mean count of that level is the estimate. The filter has no false negatives; its size follows the number
of its entries (n-gram, level) without a maximum. Partial counts leave the tasks aggregated and are dealt by the
filter's segment; a partition adds up its n-grams, sizes its segments by their entries and sets their bits. There are as
many segments as keep each bounded, and they are a table in the shared folder. What is shuffled names an n-gram by its segment and 32 bits of its hash in it: with PART_KEYS
n-grams a segment, one in 4,000 shares its name with another, far fewer than a filter finds by mistake.

The filter grows with the corpus and so stays a table: chunks of documents ask for their distinct n-grams by segment, a
partition answers the questions to its segments one after another by probing, and the levels return to their chunks.
What is broadcast is a bounded part of it: the probed levels of the most frequent n-grams, at most HEAD_KEYS of them,
which most tokens consist of. Only the other n-grams of a chunk are asked for. Scores are the same with or without it.

A token's probability is t * count(v, w) / count(v) + (1 - t) * P(w), P(w) = (count(w) + 1) / (N + V + 1), with the trust
t = TRUST * count(v) / (count(v) + MU) and counts read from the filter; v is the token before w, or the start of the text.

The exact unigram score uses exact counts: words with at least N / HEAD tokens, of which there are HEAD at most, travel
with the tasks, and the others are joined by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, materialize, mix, table, worker_cache, words

BASE = 1.5
TRUST, MU = 0.3, 10.0
#: N-grams whose levels travel with the tasks, at most.
HEAD_KEYS = 12_000_000
BITS_AN_ENTRY = 10
#: Segments of the filter, at least.
SEGMENTS = 1024
PROBES = 4
LEVELS = 64
#: Training tokens whose n-grams a segment holds, and a task adds up at once, on average.
PART_KEYS = 1_000_000
#: Characters of text after which a chunk of documents ends, and the rows that a task counts at once.
CHUNK_CHARS, COUNT_CHARS = 1_000_000, 4_000_000
#: Rows of an Arrow batch of documents.
DOCS_A_BATCH = 2000
#: Rows and bytes of an Arrow batch where rows are chunks or questions.
QUESTIONS_A_BATCH, BYTES_A_BATCH = 500, 8 << 20
HEAD = 2_000_000

#: Stand-ins for the end and the start of a text; no word is empty or holds a blank.
END, START = b"", b" "


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _means() -> np.ndarray:
    """The mean of the whole numbers of each level, 0 for level 0; a level without any has its lower bound."""
    out = [0.0]
    for q in range(1, LEVELS + 1):
        low, high = np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1
        out.append((low + high) / 2 if high >= low else BASE ** (q - 1))
    return np.array(out)


MEANS = _means()


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by its end, and the number of tokens of each text."""
    get, end = worker_cache("words", WordHashes).__getitem__, WordHashes().__missing__(END)
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        before = len(flat)
        flat.extend(map(get, words(t)))
        flat.append(end)
        sizes[i] = len(flat) - before
    return np.array(flat, np.int64), sizes


def preceding(values: np.ndarray, sizes: np.ndarray, first) -> np.ndarray:
    """The value of the token before each token, `first` at the start of a text."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[np.cumsum(sizes) - sizes] = first
    return before


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token."""
    return preceding(tokens, sizes, WordHashes().__missing__(START))


def unigram(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens.view(np.uint64))


def bigram(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(unigram(before) * np.uint64(0x9E3779B97F4A7C15) + tokens.view(np.uint64))


def positions(keys: np.ndarray, levels: np.ndarray, width: np.ndarray | int) -> list[np.ndarray]:
    """The bits of (key, level) within the key's segment of `width` < 2^32 bits, for each of the PROBES."""
    first = mix(keys + levels.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    second = mix(first) | np.uint64(1)
    half, width = np.uint64(32), np.asarray(width, np.uint64)
    return [((((first + second * np.uint64(i)) >> half) * width) >> half).view(np.int64) for i in range(PROBES)]


def segment(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key, its leading bits; segments is a power of two."""
    return (keys >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def short_keys(keys: np.ndarray, segments: int) -> np.ndarray:
    """Keys cut to their segment and the 32 bits that follow, which name an n-gram from here on."""
    drop = np.uint64(64 - (segments.bit_length() - 1) - 32)
    return keys >> drop << drop


def packed_key(keys: np.ndarray, segments: int) -> np.ndarray:
    """The 32 bits of a short key that its segment leaves open."""
    return (keys >> np.uint64(64 - (segments.bit_length() - 1) - 32)).astype("<u4")


def unpacked_key(data: bytes, name: int, segments: int) -> np.ndarray:
    low = np.uint64(64 - (segments.bit_length() - 1) - 32)
    return (np.uint64(name) << np.uint64(65 - segments.bit_length())) | (np.frombuffer(data, "<u4").astype(np.uint64) << low)


@dataclass
class LogFrequencyFilter:
    """All segments' bits one after another; a segment begins at the byte `begin` and has `width` bits."""

    bits: np.ndarray
    begin: np.ndarray
    width: np.ndarray

    @staticmethod
    def of(fields: dict[int, bytes], segments: int) -> LogFrequencyFilter:
        """The filter of segments' bits by number; a segment without entries has one byte of zeros."""
        parts = [fields.get(s, bytes(1)) for s in range(segments)]
        size = np.array([len(p) for p in parts], np.int64)
        return LogFrequencyFilter(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size * 8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probing from 1 upwards; 0 if absent."""
        keys = short_keys(keys, len(self.width))
        at = segment(keys, len(self.width))
        return probe(self.bits, keys, self.begin[at] * 8, self.width[at])

    def counts(self, keys: np.ndarray) -> np.ndarray:
        unique, inverse = np.unique(keys, return_inverse=True)
        return MEANS[self.levels(unique)][inverse]


def probe(bits: np.ndarray, keys: np.ndarray, base: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The level of each key in bits, where its segment begins at the bit `base` and has `width` bits."""
    found = np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))
    for q in range(1, LEVELS + 1):
        if not len(left):
            break
        there = np.ones(len(left), np.uint8)
        for at in positions(keys, np.array([q]), width):
            at += base
            there &= bits[at >> 3] >> (at & 7).astype(np.uint8)
        there = there.view(bool)
        left, keys, base, width = left[there], keys[there], base[there], width[there]
        found[left] = q
    return found


def slices(batches: Iterator[pa.RecordBatch], chars: int, column: int = 0) -> Iterator[pa.RecordBatch]:
    """The same batches, cut before the texts of a slice exceed so many characters; a longer text is a slice of its own."""
    for b in batches:
        before, at = np.cumsum([len(t or "") for t in b.column(column).to_pylist()]), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + chars, "right")))
            yield b.slice(at, end - at)
            at = end


def most_tokens(docs: DataFrame) -> int:
    """A bound on the number of tokens of `text`: words are apart by a blank, and each text has an end."""
    chars = F.length(F.coalesce("text", F.lit("")))
    return int(docs.agg(F.coalesce(F.sum(F.floor((chars + 1) / 2) + 1), F.lit(0))).first()[0])


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffle files go when it ends; its result is a table, and nothing reads them again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def segments_for(n_tokens: int) -> int:
    """A power of two from SEGMENTS on that keeps segments within PART_KEYS tokens on average."""
    return max(SEGMENTS, 1 << (max(n_tokens - 1, 0) // PART_KEYS).bit_length())


FILTER_SCHEMA = "segment int, bits binary, tokens array<long>, counts array<long>, head_keys binary, head_levels binary"


def filter_table(docs: DataFrame, n_tokens: int, head_keys: int = HEAD_KEYS) -> DataFrame:
    """The filter of docs, which have at most n_tokens tokens, and their exact unigram counts, a row a segment.

    Unigrams (contexts and starts included) and bigrams are counted and their levels' bits set. A task ships its
    partial counts packed, one row a segment; a segment is added up as a whole, and its size is BITS_AN_ENTRY for each
    of its entries. A segment without entries has no row. Columns: segment, bits; tokens and counts (the segment's
    tokens by 64-bit hash); head_keys and head_levels, what probing gives for the n-grams that are counted
    3 * n_tokens / head_keys times or more. A token counts in three n-grams at most, so these are head_keys at most.
    """
    segments = segments_for(n_tokens)
    frequent = 3 * n_tokens / head_keys

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, COUNT_CHARS):
            tokens, sizes = token_hashes(b.column(0).to_pylist())
            if not len(tokens):
                continue
            pairs, n_pairs = np.unique(short_keys(bigram(contexts(tokens, sizes), tokens), segments), return_counts=True)
            tokens, times = np.unique(tokens, return_counts=True)
            order = np.argsort(unigram(tokens))
            tokens, times = tokens[order], times[order].astype("<u4")
            singles = unigram(tokens)
            starts = unigram(np.array([WordHashes().__missing__(START)]))
            keys = np.concatenate([short_keys(np.concatenate([singles, starts]), segments), pairs])
            n = np.concatenate([times, [len(sizes)], n_pairs]).astype("<u4")
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            # Keys are sorted, and so are their segments.
            name, low = segment(keys, segments), packed_key(keys, segments)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(name)]])
            name = name[cut[:-1]]
            ends = [np.searchsorted(segment(singles, segments), name, side) for side in ("left", "right")]
            packed = [(low[lo:hi], n[lo:hi], tokens[x:y], times[x:y]) for lo, hi, x, y in zip(cut, cut[1:], *ends)]
            fields = [pa.array([f.tobytes() for f in column], pa.binary()) for column in zip(*packed)]
            yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int32)), *fields], ["segment", "keys", "n", "tokens", "times"])

    def added_up(names: list[bytes], counts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
        k, inverse = np.unique(np.frombuffer(b"".join(names), kind), return_inverse=True)
        return k, np.bincount(inverse, np.frombuffer(b"".join(counts), "<u4"), len(k)).astype(np.int64)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, ([], [], [], [])

        def done() -> pa.RecordBatch:
            low, n = added_up(parts[0], parts[1], "<u4")
            k, t = unpacked_key(low.tobytes(), now, segments), level_of(n)
            entries = int(t.sum())
            flags = np.zeros(-(-entries * BITS_AN_ENTRY // 8) * 8, bool)
            for where in positions(np.repeat(k, t), np.arange(entries) - np.repeat(np.cumsum(t) - t, t) + 1, len(flags)):
                flags[where] = True
            field = np.packbits(flags, bitorder="little")
            head = k[n >= frequent]
            levels = probe(field, head, np.zeros(len(head), np.int64), np.full(len(head), len(flags)))
            tokens, counts = added_up(parts[2], parts[3], "<i8")
            for p in parts:
                p.clear()
            values = [now, field.tobytes(), tokens, counts, head.tobytes(), levels.astype(np.uint8).tobytes()]
            types = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["segment", "bits", "tokens", "counts", "head_keys", "head_levels"])

        for b in batches:
            for s, *row in zip(*(column.to_pylist() for column in b.columns)):
                if s != now:
                    if parts[0]:
                        yield done()
                    now = s
                for p, value in zip(parts, row):
                    p.append(value)
        if parts[0]:
            yield done()

    counted = docs.select("text").mapInArrow(partial, "segment int, keys binary, n binary, tokens binary, times binary")
    dealt = counted.repartition("segment").sortWithinPartitions("segment")
    with freed_shuffles(docs.sparkSession):
        return materialize(dealt.mapInArrow(bits, FILTER_SCHEMA), "lm-filter")


def unigram_counts(fields: DataFrame) -> DataFrame:
    """Exact counts of tokens from the filter's table: token (its 64-bit hash) and count."""
    return fields.select(F.explode(F.arrays_zip("tokens", "counts")).alias("e")).select(F.col("e.tokens").alias("token"), F.col("e.counts").alias("count"))


@dataclass
class Head:
    """The levels of the most frequent n-grams, by short key in order."""

    keys: np.ndarray
    found: np.ndarray

    @staticmethod
    def of(fields: DataFrame) -> Head:
        rows = fields.where(F.length("head_keys") > 0).select("head_keys", "head_levels").collect()
        keys = np.frombuffer(b"".join(r.head_keys for r in rows), np.uint64)
        order = np.argsort(keys)
        return Head(keys[order], np.frombuffer(b"".join(r.head_levels for r in rows), np.uint8)[order])

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each short key, 0 if it isn't among these."""
        if not len(self.keys):
            return np.zeros(len(keys), np.uint8)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.found[at], np.uint8(0))


def build_filter(docs: DataFrame, n_tokens: int) -> LogFrequencyFilter:
    """The filter of docs in one piece."""
    fields = filter_table(docs, n_tokens).select("segment", "bits").collect()
    return LogFrequencyFilter.of({r.segment: r.bits for r in fields}, segments_for(n_tokens))


def ngrams(tokens: np.ndarray, sizes: np.ndarray, segments: int) -> np.ndarray:
    """The n-grams (short keys) whose levels the scores of documents take: the start, each token, each token after the one before it."""
    return short_keys(np.concatenate([unigram(np.array([WordHashes().__missing__(START)])), unigram(tokens), bigram(contexts(tokens, sizes), tokens)]), segments)


def chunked(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, text) packed as (chunk, docs), a bounded number and size in each; docs is a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, CHUNK_CHARS, 2):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["docs"])

    packed = rows.select("doc_id", "held_out", "text").mapInArrow(run, "docs binary")
    return materialize(packed.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks").select("chunk", "docs")


def unpacked(docs: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs.as_buffer()).read_next_batch()


def dealt_levels(chunks: DataFrame, fields: DataFrame, segments: int, head: Callable[[], Head]) -> DataFrame:
    """By chunk the levels of its distinct n-grams outside the head as an array of (segment, levels) in order of the segments, a byte an n-gram.

    A chunk without such n-grams has no row.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, docs in zip(b.column(0).to_pylist(), b.column(1)):
                keys = np.unique(ngrams(*token_hashes(unpacked(docs).column(2).to_pylist()), segments))
                keys = keys[head().levels(keys) == 0]
                if not len(keys):
                    continue
                name, low = segment(keys, segments), packed_key(keys, segments)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(name)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[cut[:-1]].astype(np.int32)), pa.array(np.full(len(cut) - 1, chunk)), pa.array([low[lo:hi].tobytes() for lo, hi in zip(cut, cut[1:])], pa.binary())], ["segment", "chunk", "data"]
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, field = None, None
        for b in batches:
            where, chunk = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, levels = b.column(2).to_pylist(), [b""] * b.num_rows
            edges = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi and chunk[lo] < 0:
                    now, field = where[lo], np.frombuffer(data[lo], np.uint8)
                    lo += 1
                if lo < hi:
                    # All questions of the batch to one segment are answered at once.
                    keys = unpacked_key(b"".join(data[lo:hi]), int(where[lo]), segments)
                    found = probe(field, keys, np.zeros(len(keys), np.int64), np.full(len(keys), len(field) * 8)) if where[lo] == now else np.zeros(len(keys))
                    raw, ends = found.astype(np.uint8).tobytes(), np.cumsum([0, *(len(d) // 4 for d in data[lo:hi])])
                    levels[lo:hi] = [raw[x:y] for x, y in zip(ends, ends[1:])]
            asked_ = pa.array(chunk >= 0)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(levels, pa.binary())], ["chunk", "segment", "levels"]).filter(asked_)

    questions = chunks.mapInArrow(ask, "segment int, chunk long, data binary")
    # A segment's bits come before its questions.
    both = questions.unionByName(fields.select("segment", F.lit(-1).cast("long").alias("chunk"), F.col("bits").alias("data")))
    answers = both.repartition("segment").sortWithinPartitions("segment", "chunk").mapInArrow(answer, "chunk long, segment int, levels binary")
    return answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("segment", "levels"))).alias("answers"))


def score_documents(docs: DataFrame, head: int = HEAD, head_keys: int = HEAD_KEYS) -> DataFrame:
    """Learn from the rows of (doc_id, text) that aren't held out and score every row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text is its end
    token alone. Rows map one to one, so repeated rows are scored, and learned from, as often as they occur; a null
    doc_id isn't held out. Other columns are ignored. Without training rows all counts are zero. At most `head` words'
    counts and head_keys n-grams' levels are broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    training = rows.where("NOT held_out")
    bound = most_tokens(training)
    segments = segments_for(bound)
    with arrow_rows(spark, DOCS_A_BATCH):
        fields = filter_table(training, bound, head_keys)
    counts = unigram_counts(fields)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total.n), int(total.v)
    denominator = n + v + 1
    frequent = counts.where(F.col("count") * head >= n).toArrow().sort_by("token")
    shared: Broadcast = spark.sparkContext.broadcast((frequent["token"].to_numpy(), frequent["count"].to_numpy(), Head.of(fields)))

    def scores(doc_ids: pa.Array, held: pa.Array, tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        head_token, head_count, _ = shared.value
        begin = np.cumsum(sizes) - sizes
        start, here, pair = counts[0], counts[1 : len(tokens) + 1], counts[len(tokens) + 1 :]
        ahead = preceding(here, sizes, start)
        trust = TRUST * ahead / (ahead + MU)
        p = trust * np.minimum(pair / np.maximum(ahead, 1), 1) + (1 - trust) * np.minimum((here + 1) / denominator, 1)
        score = np.add.reduceat(np.log10(p), begin)

        at = np.minimum(np.searchsorted(head_token, tokens), max(len(head_token) - 1, 0))
        known = head_token[at] == tokens if len(head_token) else np.zeros(len(tokens), bool)
        c = np.where(known, head_count[at] if len(head_token) else 0, 0)
        base = np.add.reduceat(np.where(known, np.log10((c + 1) / denominator), 0.0), begin)
        n_head = np.add.reduceat(known.astype(np.int64), begin)
        row = np.repeat(np.arange(len(sizes)), sizes)[~known]
        rare = pa.array(tokens[~known])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [doc_ids, held, pa.array(sizes), pa.array(n_head), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), rare)],
            ["doc_id", "held_out", "n_tokens", "n_head", "head_score", "score", "rare"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, answers in zip(*b.columns):
                doc_ids, held, texts = unpacked(packed).columns
                tokens, sizes = token_hashes(texts.to_pylist())
                keys, where = np.unique(ngrams(tokens, sizes, segments), return_inverse=True)
                levels = shared.value[2].levels(keys)
                levels[levels == 0] = np.frombuffer(b"".join(a["levels"] for a in answers.as_py() or ()), np.uint8)
                yield scores(doc_ids, held, tokens, sizes, MEANS[levels][where])

    schema = "doc_id long, held_out boolean, n_tokens long, n_head long, head_score double, score double, rare array<long>"
    with arrow_rows(spark, DOCS_A_BATCH):
        chunks = chunked(rows)
    with arrow_rows(spark, QUESTIONS_A_BATCH, BYTES_A_BATCH), freed_shuffles(spark):
        answered = chunks.join(dealt_levels(chunks, fields, segments, lambda: shared.value[2]), "chunk", "left")
        scored = answered.select("docs", "answers").mapInArrow(run, schema)
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("token")).groupBy("row", "token").count().withColumnRenamed("count", "times")
    rest = (
        rare.join(counts, "token", "left")
        .withColumn("c", F.coalesce("count", F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(denominator)))).alias("rare_score"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rare"))
    )
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
