"""Phrase collocation mining by growth of contiguous patterns (PrefixSpan for runs of words).

Words are counted, then pairs of neighbours, and those with at least `least` occurrences stay: no phrase with a rarer word
or pair can be frequent. Each occurrence of a frequent pair is projected: a pointer row holds its words and the up to
three after them, as 64-bit numbers of (lang, word), up to the end of the piece or the first rare pair. A task gets all
pointer rows of its prefixes, sorts them, and from then on a pattern's projected database is a range of rows: it extends
each pattern to the right, depth first, as long as the range weighs enough.

A prefix with more than ROWS pointer rows isn't left to one task: it is counted by a grouped sum and its extensions by
one word are prefixes of their own, and so on to the full length, so a task holds a bounded number of rows whatever
share of the corpus one word has. Rows that repeat are summed within a task before they move.

Words and phrases are named by hashes while they travel, and get their text back by a join. With 2^64 names, two of a
million frequent words share one with probability 3e-8.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bits import bitmap_of, hits, longs
from .common import arrow_rows, materialize, mix, small_batches, table

LEAST, LONGEST, TOP = 100, 5, 2000
#: Pointer rows of a prefix that one task takes, and of a task's prefixes on average.
ROWS = 250_000
#: Words that a task counts, pairs and pointer rows that it sums and names that it remembers before it sends them on or starts afresh.
COUNTED, PAIRED, SUMMED, NAMED = 200_000, 2_000_000, 400_000, 300_000
#: Partial results of the ranking in each language, so that no task ranks all phrases of one.
PARTS = 64

_STOPS = b".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes.maketrans(_STOPS + b"\t", b"." * len(_STOPS) + b" ")
_TO_BLANK = bytes.maketrans(_STOPS + b"\t", b" " * (len(_STOPS) + 1))


def _by_lang(batch: pa.RecordBatch) -> dict[str, bytes]:
    """The batch's texts by language, A-Z lower-cased, with a full stop (which ends pieces) between texts."""
    found: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault("und" if lang is None else lang, []).append(text or "")
    return {lang: ".".join(texts).encode().lower() for lang, texts in found.items()}


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def name_of(word: bytes, seed: int) -> int:
    """The number of a word in a language, a signed integer that isn't 0."""
    h = xxhash.xxh64_intdigest(word, seed)
    return (h - (1 << 64) if h >> 63 else h) or 1


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, f, id of words with at least `least` occurrences; with null word and id, the number n of all as f."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                words, n = [None, *map(bytes.decode, c)], [c.total(), *c.values()]
                for at in range(0, len(n), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[part]), pa.string()), pa.array(words[part], pa.string()), longs(n[part])], ["lang", "word", "n"])
            found.clear()

        for b in small_batches(batches):
            for lang, raw in _by_lang(b).items():
                found.setdefault(lang, Counter()).update(raw.translate(_TO_BLANK).split())
            if sum(map(len, found.values())) > COUNTED:
                yield from out()
        yield from out()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [None if w is None else name_of(w.encode(), _seed(lang)) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], ["lang", "word", "f", "id"])

    counts = docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    return counts.where((F.col("f") >= least) | F.col("word").isNull()).mapInArrow(name, "lang string, word string, f long, id long")


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair of neighbouring words; their own numbers are hashes already."""
    return (first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)).view(np.int64)


def _named(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[np.ndarray]:
    """The texts' words as numbers, in order; 0 stands for words that aren't in the bitmap and between pieces."""
    known: dict[str, dict[bytes, int]] = {}
    for b in small_batches(batches):
        for lang, raw in _by_lang(b).items():
            tokens = raw.translate(_TO_STOP).replace(b".", b" . ").split()
            memo = known.setdefault(lang, {})
            here = set(tokens)
            new = list(here.difference(memo, (b".",)))
            ids = np.array([name_of(w, _seed(lang)) for w in new], np.int64)
            if sum(map(len, known.values())) + len(new) > NAMED:
                # What this batch doesn't hold is forgotten.
                memo = {w: memo[w] for w in here.intersection(memo)}
                known.clear()
                known[lang] = memo
            memo.update(zip(new, np.where(hits(frequent, ids), ids, 0).tolist()))
            memo[b"."] = 0
            yield np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))


def frequent_pairs(docs: DataFrame, words, least: int = LEAST) -> DataFrame:
    """h: numbers of pairs of neighbouring frequent words (a bitmap of their ids) with at least `least` occurrences, and of few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if waiting:
                h, n = np.unique(np.concatenate(waiting), return_counts=True)
                waiting.clear()
                for at in range(0, len(n), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([longs(h[part]), longs(n[part])], ["h", "n"])

        for ids in _named(batches, words.value):
            both = (ids[:-1] != 0) & (ids[1:] != 0)
            waiting.append(pair_hash(ids[:-1][both], ids[1:][both]))
            if sum(map(len, waiting)) > PAIRED:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def _runs(ids: np.ndarray, pairs: np.ndarray, longest: int) -> np.ndarray:
    """A row for each word that makes a frequent pair with the next, with the words after it as long as each makes one with its neighbour."""
    linked = (ids[:-1] != 0) & (ids[1:] != 0)
    linked[linked] = hits(pairs, pair_hash(ids[:-1][linked], ids[1:][linked]))
    linked = np.concatenate([linked, np.zeros(longest, bool)])
    padded = np.concatenate([ids, np.zeros(longest, np.int64)])
    at = np.flatnonzero(linked)[:, None] + np.arange(longest)
    alive = np.ones(at.shape, bool)
    alive[:, 1:] = np.logical_and.accumulate(linked[at[:, :-1]], axis=1)
    return padded[at] * alive


def prefix_hash(rows: np.ndarray) -> np.ndarray:
    """A number for each row's words, in order."""
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = mix(h ^ mix(np.ascontiguousarray(rows[:, c]).view(np.uint64) + np.uint64(c)))
    return h.view(np.int64)


def _summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    _, first, inverse, n = np.unique(prefix_hash(rows), return_index=True, return_inverse=True, return_counts=True)
    if (rows[first][inverse] == rows).all():
        return rows[first], n
    return np.unique(rows, axis=0, return_counts=True)


def _names(longest: int) -> list[str]:
    return [f"w{i + 1}" for i in range(longest)]


def _schema(longest: int) -> str:
    return ", ".join(f"{w} long" for w in _names(longest)) + ", n long"


def pointers(docs: DataFrame, words, pairs, longest: int = LONGEST) -> DataFrame:
    """w1..., n: occurrences of frequent words with the words after them, as far as `longest` and pairs are frequent (bitmaps of both); 0 ends a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if waiting:
                rows, n = _summed(np.concatenate(waiting))
                waiting.clear()
                for at in range(0, len(n), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([*(longs(c) for c in rows[part].T), longs(n[part])], [*_names(longest), "n"])

        for ids in _named(batches, words.value):
            waiting.append(_runs(ids, pairs.value, longest))
            if sum(map(len, waiting)) > SUMMED:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, _schema(longest))


def _matrix(batch, longest: int) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in _names(longest)]) if batch.num_rows else np.zeros((0, longest), np.int64)


def _depth(rows: np.ndarray, large: list) -> np.ndarray:
    """Words of the prefix whose task takes a row: one more than those of its longest prefix that is too large for a task."""
    depth = np.ones(len(rows), np.int64)
    for d, words in enumerate(large, 1):
        depth += (depth == d) & hits(words.value, prefix_hash(rows[:, :d]))
    return depth


def _dealt(windows: DataFrame, large: list, bins: int, longest: int) -> DataFrame:
    """windows with `depth`, and `bin`: the task of a row's prefix of that many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b, longest)
            depth = _depth(rows, large)
            task = np.zeros(len(rows), np.int64)
            for d in np.unique(depth):
                own = depth == d
                task[own] = mix(prefix_hash(rows[own, :d]).view(np.uint64)) % np.uint64(bins)
            yield pa.RecordBatch.from_arrays([*b.columns, longs(depth), longs(task)], [*_names(longest), "n", "depth", "bin"])

    return windows.mapInArrow(run, f"{_schema(longest)}, depth long, bin long")


def grow(rows: np.ndarray, n: np.ndarray, depth: np.ndarray, least: int) -> tuple[list[list[int]], list[int]]:
    """Patterns of at least two words that begin with a task's prefixes, and their occurrences, by depth-first extension to the right.

    A pattern's projected database is the range of sorted rows that begin with it. Patterns shorter than their rows'
    depth have rows in other tasks too: they are passed through and not reported.
    """
    order = np.lexsort(rows.T[::-1])
    rows, depth = rows[order], depth[order]
    total = np.concatenate([[0], np.cumsum(n[order])])
    patterns, found = [], []
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, c = todo.pop()
        column = rows[lo:hi, c]
        starts = lo + np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        ends = np.append(starts[1:], hi)
        f = total[ends] - total[starts]
        part = depth[starts] > c + 1
        for i in np.flatnonzero((rows[starts, c] != 0) & ((f >= least) | part)):
            if c and not part[i]:
                patterns.append(rows[starts[i], : c + 1].tolist())
                found.append(int(f[i]))
            if c + 1 < rows.shape[1]:
                todo.append((int(starts[i]), int(ends[i]), c + 1))
    return patterns, found


PHRASES = "p array<long>, f long"


def _hit(sizes: DataFrame, words: list[str], large) -> DataFrame:
    """The rows of sizes whose prefix counts as large: all that are, and those that the bitmap takes for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hits(large.value, prefix_hash(np.column_stack([b.column(w).to_numpy() for w in words]))))) if b.num_rows else b

    return sizes.mapInArrow(run, sizes.schema)


def frequent_phrases(windows: DataFrame, singles: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = ROWS) -> DataFrame:
    """p (ids of two to `longest` words) and f of phrases with at least `least` occurrences.

    windows: what pointers returns, as a table. singles: id and f of the frequent words.
    """
    spark, words = windows.sparkSession, _names(longest)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([longs(prefix_hash(np.column_stack([c.to_numpy() for c in b.columns])) if b.num_rows else [])], ["h"])

    # Prefixes too large for a task, word by word; each level reads only the rows that the one before left to it.
    large, counted, sizes = [], [], None
    over = singles.where(F.col("f") > most).select(F.col("id").alias("w1"))
    for d in range(1, longest):
        if over.isEmpty():
            break
        large.append(bitmap_of(over.select(*words[:d]).mapInArrow(hashed, "h long"), "h"))
        if sizes is not None:
            counted.append(_hit(sizes, words[:d], large[-1]))
        held = _dealt(windows, list(large), 1, longest).where((F.col("depth") == d + 1) & (F.col(words[d]) != 0))
        sizes = held.groupBy(*words[: d + 1]).agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("rows")).where(F.col("f") >= least)
        sizes = materialize(sizes, "op11-sizes")
        over = sizes.where(F.col("rows") > most)
    else:
        counted.append(sizes)
    sums = [c.select(F.array(*[w for w in words if w in c.columns]).alias("p"), "f") for c in counted]

    bins = max(1, -(-windows.count() // most))
    dealt = _dealt(windows, large, bins, longest)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rows = _matrix(t, longest)
        patterns, f = grow(rows, t.column("n").to_numpy(), t.column("depth").to_numpy(), least)
        return pa.table([pa.array(patterns, pa.list_(pa.int64())), longs(f)], names=["p", "f"])

    own = dealt.where(F.col("depth") < longest) if len(large) == longest - 1 else dealt
    parts = max(bins, spark.sparkContext.defaultParallelism)
    grown = own.repartition(parts, "bin").groupBy("bin").applyInArrow(run, PHRASES)
    for s in sums:
        grown = grown.unionByName(s)
    return grown


def scored(phrases: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases that no longer candidate with as many occurrences contains.

    The score is that of the cut with the lowest floor(1000 a n / (l r)), of several the shortest first part. Products are
    decimals of 38 digits: exact up to 10^15 occurrences of a phrase and 10^18 words.
    """
    named = words.where("id IS NOT NULL").select("id", "lang", "word", "f")
    totals = words.where("id IS NULL").select("lang", F.col("f").alias("n"))
    every = phrases.unionByName(named.select(F.array("id").alias("p"), "f"))
    # One word more holds any longer candidate of equal count: those between have that count as well.
    longer = phrases.where(F.size("p") > 2).select("f", F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"))
    longer = longer.groupBy("p").agg(F.max("f").alias("longer"))
    kept = phrases.withColumnRenamed("f", "a").join(longer, "p", "left").where("longer IS NULL OR longer < a").drop("longer")
    home = kept.join(named.select(F.col("id").alias("_first"), "lang"), F.col("p")[0] == F.col("_first")).drop("_first").join(totals, "lang")
    cuts = home.withColumn("k", F.explode(F.expr("sequence(1, size(p) - 1)"))).withColumns({"left": F.expr("slice(p, 1, k)"), "right": F.expr("slice(p, k + 1, size(p) - k)")})
    cuts = cuts.join(every.select(F.col("p").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    exact = F.expr("cast((cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(19,0))) as long)")
    best = cuts.groupBy("p", "lang", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    spelt = best.select("*", F.posexplode("p").alias("at", "id")).join(named.select("id", "word"), "id")
    text = spelt.groupBy("p", "lang", "a", "n", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    return text.select("lang", F.array_join(F.transform("spelt", lambda s: s["word"]), " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` rows of each lang with their rank; parts of a language are cut to as many before they meet."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return whole.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most: int = ROWS) -> DataFrame:
    """The best-scoring phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null text is empty, null lang is `und`; texts without a word, and an empty table, give no rows. Phrases don't cross
    `.,;:!?` and line ends; repeated rows count as often as they occur. Ties in score go by count, then by phrase. Other
    columns are ignored. `most` bounds the pointer rows that a task takes of one prefix.
    """
    with arrow_rows(docs.sparkSession, 500):
        words = materialize(word_counts(docs, least), "op11-words")
        singles = words.where("id IS NOT NULL")
        frequent = bitmap_of(singles, "id")
        pairs = materialize(frequent_pairs(docs, frequent, least), "op11-pairs")
        windows = materialize(pointers(docs, frequent, bitmap_of(pairs, "h"), longest), "op11-pointers")
    phrases = materialize(frequent_phrases(windows, singles, least, longest, most), "op11-phrases")
    return ranked(scored(phrases, words, least), top)


def op11_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, s, count(*) AS f FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE len(w) >= s) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, s, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE s > 1),
longer AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, s, a, k, unnest(range(1, s - k + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS k) WHERE s > k) GROUP BY ALL),
cut AS (SELECT c.*, unnest(range(1, s)) AS k FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
sc AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cut JOIN tot USING (lang)
 JOIN g x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1 : k], ' ') JOIN g y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[k + 1 : cut.s], ' ')),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= {TOP}"""
