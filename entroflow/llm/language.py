"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is parsed against it into phrases, each the longest
match that the automaton still accepts; a phrase runs on over words. Phrases times the log of the training length is the
text's length in bits, the cross-parsing entropy but for a factor that all languages share; the language with the least
wins. Texts are parsed as bytes of UTF-8 in lower case, many stretches of STRETCH bytes in step.

The training text of a language is that of a bounded sample of labelled rows: SAMPLE rows, those with the smallest hash
of doc_id among about four times as many drawn by hash, texts of at most LONG characters first. Their texts are taken
whole. Every whole text is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, worker_cache
from .quality import held_out

SAMPLE = 32
LONG = 8000
#: Rows whose stretches are parsed in step.
ROWS = 500
SHARPNESS = 8.0
UNKNOWN = "und"
#: Bytes of text that are parsed at a time.
STRETCH = 1024
#: Ends a row's text, a byte that no text holds, so that phrases don't run from one row into the next.
BETWEEN = b"\xff"


#: ASCII without letters becomes blanks, the rest stays: bytes beyond ASCII are parts of letters for the most part.
LETTER_BYTES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def parsed_bytes(text: str) -> bytes:
    """What is learned and parsed of a text: UTF-8 in lower case, runs of ASCII other than letters as one blank."""
    return b" ".join(text.lower().encode().translate(LETTER_BYTES).split())


class SuffixAutomaton:
    """Accepts the substrings of a byte string. A state is the dict of its transitions, from a byte to the next state's number."""

    def __init__(self, data: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in data:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class Parser:
    """The automata of all languages as one table of transitions, which parses many stretches of text in step.

    An entry is the place of the next state's row. Where a phrase ends it is the complement (~) of the row that the next
    phrase is in after its first byte; row 0 has no transitions and stands before a text and after bytes that occur nowhere.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        self.bits = np.array([np.log2(max(len(texts[k]), 2)) for k in self.languages])
        used = sorted(set().union(*texts.values())) if texts else []
        self.width = len(used) + 1
        self.code = np.zeros(256, np.uint8 if self.width <= 256 else np.uint16)
        self.code[used] = np.arange(1, self.width)
        tables, self.before = [], []
        rows = 0
        for k in self.languages:
            following = SuffixAutomaton(texts[k]).next
            state = np.repeat(np.arange(len(following)), [len(d) for d in following])
            c = self.code[np.fromiter((c for d in following for c in d), np.int64, len(state))].astype(np.int64)
            to = np.fromiter((t for d in following for t in d.values()), np.int64, len(state))
            del following
            # Rows of this language: the one without transitions, then its states from the start.
            base = rows + 1
            n = int(state.max(initial=0) if not len(to) else max(state.max(), to.max())) + 1
            first = np.full(self.width, rows, np.int64)
            first[c[state == 0]] = base + to[state == 0]
            table = np.tile(~(first * self.width), (n + 1, 1))
            table[state + 1, c] = (base + to) * self.width
            if table.size and (base + n) * self.width >= 1 << 31:
                raise ValueError("the training texts are too long; take fewer rows")
            tables.append(table.astype(np.int32))
            self.before.append(rows * self.width)
            rows = base + n
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Longest matches that cover each text from left to right, by text and language.

        A byte that occurs nowhere is a phrase, and a phrase ends where a stretch of STRETCH bytes does.
        """
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        lanes = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), lanes)
        if not len(owner) or not self.languages:
            return total
        part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(size[owner] - part * STRETCH, STRETCH)
        begin = (np.cumsum(size) - size)[owner] + part * STRETCH
        order = np.argsort(-length, kind="stable")
        owner, length, begin = owner[order], length[order], begin[order]
        codes = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        state = np.repeat(np.array(self.before, np.int32)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        # Lanes that are still running come first: those at least t + 1 long.
        running = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        for t, m in enumerate(running):
            to = self.table.take(state[:, :m] + codes[begin[:m] + t])
            ended = to >> 31
            count[:, :m] -= ended
            np.bitwise_xor(to, ended, out=state[:, :m])
        np.add.at(total, owner, count.T)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores from 0 to 1; "und" and 0 without letters (Unicode category L) or languages."""
        data = [parsed_bytes(t) if t and any(c.isalpha() for c in t) else b"" for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        entropy = self.phrases(data) * self.bits
        best = entropy.argmin(axis=1)
        least = np.maximum(entropy[np.arange(len(texts)), best], 1)
        score = 1 / np.exp(-SHARPNESS * (entropy / least[:, None] - 1)).sum(axis=1)
        return [self.languages[b] if d else UNKNOWN for b, d in zip(best, data)], [float(s) if d else 0.0 for s, d in zip(score, data)]


def parser(texts: dict[str, bytes]) -> Parser:
    return worker_cache(("languages", tuple(sorted(texts.items()))), lambda: Parser(texts))


def train(docs: DataFrame, sample: int = SAMPLE, long: int = LONG) -> dict[str, bytes]:
    """Training text of each language from rows (doc_id, text, lang) that have a lang and aren't held out.

    Rows with a null id, lang or text, or a text without a letter, teach nothing; a language without others isn't learned.
    """
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").count().select("lang", (F.lit(4e6) * sample / F.col("count")).alias("share"))
    # One row a language.
    drawn = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("text") > long, F.xxhash64("doc_id"), "doc_id", "text"))
    out: dict[str, bytes] = {}
    for r in drawn.withColumn("place", place).where(F.col("place") <= sample).orderBy("lang", "place").collect():
        out[r.lang] = out.get(r.lang, b"") + parsed_bytes(r.text) + BETWEEN
    return out


def predict_language(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """Predict each row of (doc_id, text): doc_id, held_out, lang_pred, score.

    `und` with score 0 if text is null, empty or without a letter (Unicode category L), or if no language was learned.
    Equal entropies go to the language that sorts first. Rows map one to one; other columns, lang among them, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(texts)
        for b in small_batches(batches, ROWS):
            lang, score = p.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """The rows of docs whose text has a verdict, not `und`, with all their columns; no shuffle.

    A text without a letter has none. Any other is given the learned language that fits best, however badly, and stays.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(texts)
        for b in small_batches(batches, ROWS):
            yield b.filter(pa.array([k != UNKNOWN for k in p.predict(b.column(at).to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, train(docs))
