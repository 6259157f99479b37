"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal what they found.

What the patterns find (mail addresses, network addresses, card and phone numbers) are the protected entities. The
corpus tells how strongly a term t reveals an entity e: with N words, c(t) and c(e) occurrences and c(t, e) occurrences
of e that have t within WINDOW words, the pointwise mutual information log(c(t, e) N / (c(t) c(e))) is compared with the
information of the entity itself, log(N / c(e)). Their ratio, the disclosure, is 1 when t occurs only beside e, so that
reading t gives e away. A term whose disclosure for some entity reaches `alpha`, in at least `support` different
contexts (copies of a passage are one), is generalised to its first letters where these disclose nothing, else removed,
wherever it occurs.

Two passes over the texts: the first counts terms and co-occurrences, and Spark derives the disclosing terms by joins of
the counts; the second finds these terms' places. A bitmap of bounded size tells the second pass which words may be
such terms, and a join on the term decides. All counts cover all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bitmap_of, hits, longs, row_ids
from .common import arrow_rows, materialize, small_batches, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity that count as its context.
WINDOW = 10
#: Share of an entity's information that a term has to give away, and contexts in which it has to.
ALPHA, SUPPORT = 0.98, 3
#: Letters that a generalised term keeps.
STEM = 4
#: Words that a task counts before it sends the counts on.
COUNTED = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins where a run of digits does: what fails there fails within the run as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order; kind is a place in KINDS. Linear in the text's length."""
    out = []
    done = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode())
    return (h - (1 << 64) if h >> 63 else h) or 1


def term_key(word: str) -> int:
    return _hash("t" + word.lower())


def stem_key(word: str) -> int:
    """The number of a word's first letters; 0 where they are all of it."""
    return _hash("s" + word.lower()[:STEM]) if len(word) > STEM else 0


def entity_key(kind: int, value: str) -> int:
    return _hash(f"{kind}:{value.lower() if kind == 0 else _NOT_DIGIT.sub('.' if kind == 1 else '', value)}")


def _blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with blanks in place of the spans."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            parts += [text[at:start], " " * (end - max(start, at))]
            at = end
    return "".join([*parts, text[at:]])


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> Iterator[tuple[int, int, list[str]]]:
    """(entity, context, words): for each span its value's number, a number of its surroundings (their set of words), and the words there."""
    words = [(m.start(), m.group()) for m in _WORD.finditer(_blanked(text, spans))]
    starts = [s for s, _ in words]
    for start, kind, end in spans:
        near = [w for _, w in words[max(0, bisect_left(starts, start) - window) : bisect_left(starts, start)]] + [w for _, w in words[bisect_left(starts, end) :][:window]]
        yield entity_key(kind, text[start:end]), _hash(" ".join(sorted({w.lower() for w in near}))), near


def observations(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, stem, entity, context, n: summed rows of the counts.

    (0, 0, 0, 0): all words. (key, 0, 0, 0): a term's or stem's occurrences. (0, 0, entity, 0): an entity's. The rest:
    the occurrences of an entity in a context that holds the term; stem is the number of the term's first letters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            total: Counter = Counter(seen)
            for w, n in words.items():
                total[term_key(w), 0, 0, 0] += n
                if len(w) > STEM:
                    total[stem_key(w), 0, 0, 0] += n
                total[0, 0, 0, 0] += n
            words.clear()
            seen.clear()
            rows = np.array([(*k, n) for k, n in total.items()], np.int64).reshape(-1, 5)
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([longs(c) for c in rows[at : at + 50_000].T], ["key", "stem", "entity", "context", "n"])

        for b in small_batches(batches, 200):
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                words.update(_WORD.findall(_blanked(text, spans) if spans else text))
                for entity, context, near in contexts(text, spans, window) if spans else ():
                    seen[0, 0, entity, 0] += 1
                    for key, stem in {(term_key(w), stem_key(w)) for w in near}:
                        seen[key, stem, entity, context] += 1
            if len(words) + len(seen) > COUNTED:
                yield from out()
        yield from out()

    rows = docs.select("text").mapInArrow(run, "key long, stem long, entity long, context long, n long")
    return rows.groupBy("key", "stem", "entity", "context").agg(F.sum("n").alias("n"))


def disclosing_terms(seen: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """key, entities, disclosure, general: terms to sanitise, with the highest disclosure and whether their first letters disclose nothing.

    seen: what observations returns, as a table. A term whose first letters are all of it has none to generalise to.
    """
    together = seen.where("key <> 0 AND entity <> 0")
    terms = seen.where("key <> 0 AND entity = 0").select("key", F.col("n").alias("c_t"))
    entities = seen.where("key = 0 AND entity <> 0").select("entity", F.col("n").alias("c_e"))
    everything = seen.where("key = 0 AND entity = 0").select(F.col("n").alias("c_all"))  # one row

    def disclosure(pairs: DataFrame) -> DataFrame:
        known = pairs.join(terms, "key").join(entities, "entity").join(F.broadcast(everything))
        of_entity = F.log(F.col("c_all") / F.col("c_e"))
        shared = F.log(F.col("c_te").cast("double") * F.col("c_all") / (F.col("c_t").cast("double") * F.col("c_e")))
        # An entity without information of its own is every word of the corpus; nothing discloses it.
        return known.withColumn("disclosure", F.when(of_entity > 0, F.least(F.lit(1.0), shared / of_entity)))

    pairs = together.groupBy("key", "stem", "entity").agg(F.sum("n").alias("c_te"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support)
    found = disclosure(pairs).where(F.col("disclosure") >= alpha).select("key", "stem", "entity", "disclosure")
    # A context counts once for a stem, whatever the number of its words there.
    wanted = found.where("stem <> 0").select("stem", "entity").distinct()
    stems = together.where("stem <> 0").join(wanted, ["stem", "entity"], "left_semi").groupBy("stem", "entity", "context").agg(F.max("n").alias("n"))
    stems = disclosure(stems.groupBy(F.col("stem").alias("key"), "entity").agg(F.sum("n").alias("c_te")))
    stems = stems.select(F.col("key").alias("stem"), "entity", F.col("disclosure").alias("by_stem"))
    general = F.bool_and(F.coalesce(F.col("by_stem") < alpha, F.lit(False))).alias("general")
    return found.join(stems, ["stem", "entity"], "left").groupBy("key").agg(F.count(F.lit(1)).alias("entities"), F.max("disclosure").alias("disclosure"), general)


def places(docs: DataFrame, terms, keep_text: bool = False) -> DataFrame:
    """uid, doc_id, base and maybe spans, and text where asked: base holds what the patterns find, maybe the words that may be among terms (a bitmap)."""
    span = "array<struct<start: int, kind: int, `end`: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bitmap = row_ids(), terms.value
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        maybes = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        any_term = bool(bitmap.any())
        for b in small_batches(batches, 200):
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            clear = [_blanked(t, s) if s else t for t, s in zip(texts, base)]
            own = [set(_WORD.findall(t)) for t in clear] if any_term else []
            words = list(set().union(*own))
            keys = np.array([term_key(w) for w in words], np.int64)
            hit = hits(bitmap, keys)
            known = {w: int(k) for w, k, h in zip(words, keys, hit) if h}
            maybe = [[(known[m.group()], m.start(), m.end()) for m in _WORD.finditer(t) if m.group() in known] if known and not known.keys().isdisjoint(w) else [] for t, w in zip(clear, own or [set()] * len(texts))]
            tuples = lambda rows, names: [[dict(zip(names, r)) for r in row] for row in rows]
            columns = [longs([next(ids) for _ in texts]), b.column(0), pa.array(tuples(base, ("start", "kind", "end")), kinds), pa.array(tuples(maybe, ("key", "start", "end")), maybes)]
            yield pa.RecordBatch.from_arrays([*columns, *([b.column(1)] if keep_text else [])], ["uid", "doc_id", "base", "maybe", *(["text"] if keep_text else [])])

    schema = f"uid long, doc_id long, base {span}, maybe array<struct<key: long, start: int, `end`: int>>" + (", text string" if keep_text else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def private_spans(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """uid, doc_id and spans, with text where asked: an array of (start, kind, end, general) in order, kind 0 to 3 by KINDS and 4 a term.

    Null text is empty. Rows map one to one, repeated rows and null ids included; an empty table gives none, other columns
    are ignored. Base spans of different kinds may overlap; terms lie outside them.
    """
    with arrow_rows(docs.sparkSession, 500):
        seen = materialize(observations(docs, window), "op13-observations")
        terms = materialize(disclosing_terms(seen, alpha, support), "op13-terms")
        found = materialize(places(docs, bitmap_of(terms, "key"), keep_text), "op13-places")
    own = ["uid", "doc_id", *(["text"] if keep_text else [])]
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("general")))
    sure = found.where(F.size("maybe") == 0).select(*own, base.alias("spans"))
    open_ = found.where(F.size("maybe") > 0)
    asked = open_.select("uid", F.explode("maybe").alias("m")).select("uid", "m.*").join(terms.select("key", "general"), "key")
    known = asked.groupBy("uid").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "general")).alias("more"))
    both = open_.join(known, "uid", "left").select(*own, F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int,general:boolean>>")))).alias("spans"))
    return sure.unionByName(both)


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """doc_id and text without personal data: patterns become [EMAIL] and so on, terms their first letters and *, or [TERM].

    Of overlapping spans the first stands for all. Texts without a span, null ones included, stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = [f"[{k.upper()}]" for k in (*KINDS, TERM)]
        for b in small_batches(batches):
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], text[s["start"] :][:STEM] + "*" if s["general"] else labels[s["kind"]]]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]) if spans else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    found = private_spans(docs, alpha, support, window, keep_text=True)
    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def private_digests(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points, joined by commas), n_term; rows as in private_spans."""
    found = private_spans(docs, alpha, support, window)
    names = F.array(*map(F.lit, (*KINDS, TERM)))
    spelt = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, spelt), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(len(KINDS)).alias("n_term"),
    )


def op13_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_digests(table(spark, sf_dir, "documents"))
