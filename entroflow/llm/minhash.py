"""Near-duplicate detection by MinHash with tensored banding, every link verified on the full shingle sets.

Two collections of GROUPS groups of SUB minimum hashes are computed for a document; each pair of a group of the one and
a group of the other forms a table key, so GROUPS ** 2 tables of 2 * SUB hashes cost 2 * GROUPS * SUB minimum hashes, and
not GROUPS ** 2 * 2 * SUB. A pair of similarity s meets unless all groups of a collection differ, with probability
1 - (1 - (1 - s ** SUB) ** GROUPS) ** 2: 0.0004 at 0.8, 0.00002 at 0.85.

Documents with equal sets are one class from the start, so exact copies cost one row. A table's bucket links each
member with its smallest and its largest one: as many candidates as members. The verified links give components. Where
a bucket then still holds several components, the documents outside a large component are compared with its members, and
those of other buckets with each other, first by their minimum hashes: a pair goes on if these agree in a share of LIKELY, which
lies over five standard errors under the threshold, whatever the size of the bucket or group. Groups are dealt into
blocks on both sides, so a task holds two blocks at most, and only askers with a likely partner in a block visit it
with their full sets. So no bucket has to fit into a task, and no group emits all its pairs. Links found by hashes of
shingles are confirmed on the shingles themselves, from the whole texts, as are the stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, likely_in, materialize, mix, small_batches, table, worker_cache, words
from .graph import components

SHINGLE = 2
SIMILARITY = 80
GROUPS = 12
SUB = 3
#: Members of a block whose sets a task holds at once.
BLOCK = 512
#: Members of a component that makes a group, and of a bucket whose likely pairs are verified one by one, at most.
LARGE, SMALL = 16, 64
#: Agreement of the 72 minimum hashes below which a pair isn't verified: 5.3 standard errors under the threshold of 0.8.
LIKELY = 0.55
#: Rows of an Arrow batch of whole texts or sets, and its bytes: a batch goes on until it holds them, so by one row more at most.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20
#: Shingles that are hashed at once; only a single text with more takes more.
PIECE = 1 << 17

_rng = np.random.default_rng(20)
XOR = _rng.integers(0, 1 << 63, 2 * GROUPS * SUB, np.uint64) * np.uint64(2)
TIMES = _rng.integers(0, 1 << 63, 2 * GROUPS * SUB, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Distinct shingles of width words; fewer words are one shingle, no words none."""
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(width))))


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(worker_cache("words", WordHashes).__getitem__, w), np.int64, len(w)).view(np.uint64)
    size = min(width, len(w))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def minimum_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minimum hashes (upper 32 bits) for each non-empty set, about PIECE shingles at a time."""
    out = np.empty((len(sets), len(XOR)), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= PIECE:
            size += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        begin = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for i, (x, t) in enumerate(zip(XOR, TIMES)):
            out[lo:hi, i] = np.minimum.reduceat(((flat ^ x) * t) >> np.uint64(32), begin).astype(np.uint32)
        lo = hi
    return out


SIGNED = "doc_id long, n_shingles long, same binary, hashes binary, groups array<long>"


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, same (digest of the set), its minimum hashes and their groups; the last three null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingle_hashes(t, width) for t in b.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            low = minimum_hashes(full) if full else np.zeros((0, len(XOR)), np.uint32)
            group = low.reshape(len(full), 2 * GROUPS, SUB).astype(np.uint64)
            key = mix(mix(group[:, :, 0] + (group[:, :, 1] << np.uint64(32))) + group[:, :, 2]).view(np.int64)
            rows = iter(zip(low, key.tolist()))
            same, hashes, groups = [], [], []
            for s in sets:
                signature, keys = next(rows) if len(s) else (None, None)
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                hashes.append(signature.tobytes() if len(s) else None)
                groups.append(keys)
            n = pa.array([len(shingles(t, width)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n, pa.array(same, pa.binary()), pa.array(hashes, pa.binary()), pa.array(groups, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "same", "hashes", "groups"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, id) of every class in every table."""
    tables = GROUPS * GROUPS
    keys = F.expr(f"transform(sequence(0, {tables - 1}), t -> xxhash64(groups[t div {GROUPS}], groups[{GROUPS} + t % {GROUPS}], t))")
    return classes.select("id", F.explode(keys).alias("key"))


def verify(pairs: DataFrame, docs: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union of their shingle sets, from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 200):
            keep, last, left = [], None, set()
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if s != last:
                    last, left = s, shingles(s, width)
                right = shingles(t, width)
                common = len(left & right)
                keep.append(100 * common >= similarity * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select("doc_id", "text")
    left = pairs.join(likely_in(texts.toDF("a", "text_a"), "a", pairs), "a")
    both = left.join(likely_in(texts.toDF("b", "text_b"), "b", pairs), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def pairs_in_small_buckets(members: DataFrame, likely: float = LIKELY) -> DataFrame:
    """Pairs (a, b), a < b, of one bucket but two components whose minimum hashes agree often enough.

    members: key, id, component, hashes of buckets of at most SMALL members.
    """

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, part = group["id"].to_numpy(), group["component"].to_numpy()
        low = np.frombuffer(b"".join(group["hashes"].to_pylist()), np.uint32).reshape(len(ids), -1)
        x, y = np.nonzero((ids[:, None] < ids[None, :]) & (part[:, None] != part[None, :]))
        near = (low[x] == low[y]).mean(axis=1) >= likely
        yield pa.RecordBatch.from_arrays([pa.array(ids[x[near]]), pa.array(ids[y[near]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key"]):
            yield from compare(group)

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of equal values in the columns `by` of sorted batches, each as one table."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        k = [t[c].to_numpy() for c in by]
        edges = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1).tolist(), t.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            own = tuple(c[lo] for c in k)
            if held and own != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(lo, hi - lo))
            last = own
    if held:
        yield pa.concat_tables(held).combine_chunks()


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingle hashes as bytes) of the documents that ids names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingle_hashes(t, width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    texts = likely_in(docs.select(F.col("doc_id").alias("id"), "text"), "id", ids).join(ids, "id", "left_semi")
    return texts.mapInArrow(run, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles"))


class Block:
    """Shingle sets of a bounded number of documents, by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner, flat = owner[order], flat[order]
        self.keys, self.begin = np.unique(flat, return_index=True)
        self.begin = np.append(self.begin, len(flat))

    def similar(self, s: np.ndarray, similarity: int) -> np.ndarray:
        """Documents whose set is at least `similarity` per cent alike to s."""
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        n = self.begin[at + 1] - self.begin[at]
        where = np.repeat(self.begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[where], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= similarity * (self.sizes + len(s) - common))


def dealt(members: DataFrame, askers: DataFrame, hashes: DataFrame) -> DataFrame:
    """Units (group, block, part): each block of about BLOCK members with each part of about BLOCK askers of its group.

    Columns group, block, part, asks, id, component, hashes.
    """

    def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"{name}s"))
        return rows.join(sizes, "group").withColumn(name, F.pmod(F.xxhash64("id"), f"{name}s").cast("int")).drop(f"{name}s"), sizes

    held, blocks = numbered(members, "block")
    asking, parts = numbered(askers, "part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = held.join(parts, "group").select("group", "block", every("parts").alias("part"), F.lit(False).alias("asks"), "id", "component")
    asked = asking.join(blocks, "group").select("group", every("blocks").alias("block"), "part", F.lit(True).alias("asks"), "id", "component")
    return rows.unionByName(asked).join(hashes, "id").select("group", "block", "part", "asks", "id", "component", "hashes")


UNIT = ["group", "block", "part"]


def likely_visits(units: DataFrame, likely: float = LIKELY) -> DataFrame:
    """(group, block, part, asks, id, component) of the askers with a likely partner in a block, and of the partners."""

    def compare(unit: pa.Table) -> pa.RecordBatch:
        asks, part = unit["asks"].to_numpy(), unit["component"].to_numpy()
        low = np.frombuffer(b"".join(unit["hashes"].to_pylist()), np.uint32).reshape(unit.num_rows, -1)
        asking, held = np.flatnonzero(asks), np.flatnonzero(~asks)
        stay = np.zeros(unit.num_rows, bool)
        for i in asking:
            near = held[((low[held] == low[i]).mean(axis=1) >= likely) & (part[held] != part[i])]
            stay[near] = True
            stay[i] = len(near) > 0
        return unit.select([*UNIT, "asks", "id", "component"]).filter(pa.array(stay)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, UNIT):
            yield from compare(unit).to_batches()

    schema = "group long, block int, part int, asks boolean, id long, component long"
    return units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, schema)


def links_in_groups(visits: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) by sets of hashes between the askers and the members of a unit, one for each component that an asker meets in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, ids, part, sets_ = None, None, [], [], []
        for b in batches:
            a, c = [], []
            for *unit, asks, i, p, raw in zip(*(col.to_pylist() for col in b.columns)):
                if unit != now:
                    now, block, ids, part, sets_ = unit, None, [], [], []
                s = np.frombuffer(raw, np.uint64)
                if not asks:
                    ids.append(i)
                    part.append(p)
                    sets_.append(s)
                elif ids:
                    if block is None:
                        block, part = Block(sets_), np.array(part)
                    met = set()
                    for y in block.similar(s, similarity):
                        if part[y] != p and part[y] not in met:
                            met.add(part[y])
                            a.append(min(i, ids[y]))
                            c.append(max(i, ids[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    rows = visits.join(sets, "id").select(*UNIT, "asks", "id", "component", "shingles")
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "asks").mapInArrow(run, "a long, b long").distinct()


def further_links(members: DataFrame, labels: DataFrame, classes: DataFrame, tried: DataFrame, docs: DataFrame, similarity: int, width: int) -> DataFrame:
    """Links across components within buckets, which the stars don't decide.

    A large component (LARGE members) is one group: whoever shares a bucket with it asks all its members and the other
    askers. A bucket over SMALL members without a large component is a group of its own. In the other buckets, of at
    most SMALL members, likely pairs are verified one by one. Buckets of up to three members are decided by their stars.
    """
    placed = materialize(members.where("size > 3").select("key", "id", "size").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "minhash-placed")
    large = materialize(labels.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("n")).where(f"n >= {LARGE}").select("component"), "minhash-large")
    mixed = placed.groupBy("key", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "size")
    big = materialize(placed.join(large, "component", "left_semi").select("key", F.col("component").alias("group")).distinct(), "minhash-large-buckets")
    mixed = materialize(mixed.join(big.select("key").distinct().withColumn("big", F.lit(True)), "key", "left"), "minhash-mixed")

    near_big = mixed.where("big").select("key").join(big, "key")
    strangers = placed.select("key", "id", "component").join(near_big, "key").where("component <> group").select("group", "id", "component").distinct()
    everyone = large.join(labels, "component").select(F.col("component").alias("group"), "id", "component")
    roots = large.select(F.col("component").alias("group"), F.col("component").alias("id"), "component")
    crowd = placed.join(mixed.where(f"big IS NULL AND size > {SMALL}").select("key"), "key").select(F.col("key").alias("group"), "id", "component")
    askers = materialize(strangers.unionByName(crowd), "minhash-askers")
    held = materialize(everyone.unionByName(roots).join(askers.select("group").distinct(), "group", "left_semi").unionByName(askers), "minhash-held")
    few = placed.join(mixed.where(f"big IS NULL AND size <= {SMALL}").select("key"), "key").join(classes.select("id", "hashes"), "id")
    found = verify(pairs_in_small_buckets(few.select("key", "id", "component", "hashes")).join(tried, ["a", "b"], "left_anti"), docs, similarity, width)
    if askers.isEmpty():
        return found
    visits = materialize(likely_visits(dealt(held, askers, classes.select("id", "hashes"))), "minhash-visits")
    sets = materialize(full_sets(docs, visits.select("id").distinct(), width), "minhash-sets")
    return found.unionByName(verify(links_in_groups(visits, sets, similarity), docs, similarity, width))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """Components of rows (doc_id, text) under links of shingle-set similarity of at least `similarity` per cent.

    Returns doc_id, n_shingles, component_id, kept. A text that is null, empty or blank has no shingle and is its own
    component. doc_id identifies a document: rows that repeat one share a component, and one row of it should be
    kept. Rows with a null doc_id link with nothing (component null, kept true). Other columns are ignored; an empty
    table gives an empty result.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS, ARROW_BYTES):
        signed = materialize(signatures(docs, width), "minhash-signatures")
        classes = materialize(
            signed.where("same IS NOT NULL AND doc_id IS NOT NULL")
            .groupBy("same")
            .agg(F.min("doc_id").alias("id"), F.min_by(F.struct("hashes", "groups"), "doc_id").alias("s"))
            .select("same", "id", "s.hashes", "s.groups"),
            "minhash-classes",
        )
        rows = bucket_rows(classes)
        buckets = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
        members = materialize(rows.join(buckets, "key"), "minhash-members")
        star = members.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.a", "p.b")
        tried = materialize(star.where("a < b").distinct(), "minhash-candidates")
        links = materialize(verify(tried, docs, similarity, width), "minhash-links")
        labels = components(links)

        more = materialize(further_links(members, labels, classes, tried, docs, similarity, width), "minhash-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    named = classes.select("same", "id").join(labels, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "same")
        .join(named, "same", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
