"""Near-duplicate vectors by a robust-pruned flat graph on overlapping cluster shards.

Shards: the vectors of a label and length are dealt to their nearest centres, level after level until a shard holds at most
SHARD vectors or no longer shrinks. The centres of a shard are fitted by a few Lloyd steps on a bounded sample of it (SAMPLE
vectors), by a task of its own. A shard that doesn't shrink is dealt into blocks of about BLOCK by hash.

Overlap: a vector belongs to the shard of its nearest centre (its home) and to the home of every vector that comes within the
radius of it, give or take OVERLAP. Such pairs of different homes are found by sketches: signs of random projections tell
the angle of two vectors within a few hundredths, and further ones, cut at the medians of the label, are the keys of several
tables. Rows that share a key are compared by their sketches, so nothing but keys and sketches travels. So a vector has as many
shards as its neighbours have homes, one if it has none, whatever the number of shards is; a margin around the borders between
centres had nearly every vector in several shards, and more of them with every level. Key bits and tables of a label follow
from a sample of it: keys of about BUCKET rows, tables enough that pairs at the radius meet in one but for a share of MISSED.

Build: in each block the vectors are dealt once more into overlapping sub-shards around a few pivots, in each of which
robust pruning picks the neighbours of a vector among those nearest to it (a candidate is dropped if a kept one is ALPHA
times closer to it than the vector is). Union: the adjacency lists of a vector, from all shards that it belongs to, are
united to one flat graph, a table of (vector, neighbours).

Search: the vectors whose home a block's shard is walk the united graph over the vectors of that block, from the medoids of
its sub-shards. Greedy search keeps a beam; once it stands still, every vector within the radius is expanded until no new
one turns up. Each found link is verified by its cosine in double precision. A unit returns the number of links of
each vector that asked, and a spanning forest of the links it found: fewer rows than vectors, however dense a group is,
and the same components as all the links have.

Audit: a bounded set of vectors (AUDIT of them, by hash) is compared with all rows by brute force.

Disk: vectors keep the type that the table has (floats stay floats, arithmetic is double); beside the shards that they belong
to no table holds them, links travel apart from them, and tables and shuffles that nothing reads any more are removed. What
shuffles vectors runs in up to ROUNDS jobs one after another, each on its share of the shards or vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_OLD_SHUFFLES, configured, discard, filter_of, likely_in, materialize, passed, scratch_path, scratch_table, table
from .graph import components

COSINE = 0.98
SAMPLE = 4000
SHARD = 4000
#: Centres of one level, at most.
FANOUT = 256
#: Rows that a task deals to their centres at once, on average.
PART = 50_000
#: A shard that keeps more than this share of the one it comes from is not divided further.
STUCK = 0.8
#: By how much, as a chord, sketches may take a vector for further than the radius.
OVERLAP = 0.12
#: Bits of a sketch, most tables of keys and bits of a key, tables that are compared in one job.
SKETCH = 512
TABLES = 16
KEY_BITS = 16
TOGETHER = 2
#: Rows of a key that is no group of near vectors, about, and the share of pairs at the radius that no table may bring together.
BUCKET = 1000
MISSED = 1e-4
#: Jobs that deal, build or search one after another, at most, and components of vectors that are worth one.
ROUNDS = 4
ROUND = 8_000_000
BLOCK = 4000
SUB_SHARD = 400
DEGREE = 24
BEAM = 48
ALPHA = 1.2
#: Vectors that the audit compares with all rows, and the recall under which a result is an error.
AUDIT = 200
LEAST_RECALL = 0.9


def usable() -> Column:
    """Whether a row can link: no null in id, label, vector or components, all finite, not zero."""
    v = F.col("embedding")
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & real & some, F.lit(False))


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, scaled to length 1 without overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def fit_centres(x: np.ndarray, k: int, steps: int = 5) -> np.ndarray:
    """Spherical Lloyd steps from k spread-out rows of x."""
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        own = np.argmax(x @ centres.T, axis=1)
        for c in np.unique(own):
            mean = x[own == c].mean(axis=0)
            n = np.linalg.norm(mean)
            if n > 0:
                centres[c] = mean / n
    return centres


def pruned(similar: np.ndarray, nearest: np.ndarray, own: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(candidates by distance, whether they stay) for each of the rows own: those that no nearer one that stays covers, `degree` at most.

    similar: cosines of all rows; nearest: candidates of each row of own, among which it may be itself.
    """
    distance = np.where(nearest == own[:, None], np.inf, np.maximum(1 - similar[own[:, None], nearest], 0))
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, far = np.take_along_axis(nearest, order, axis=1), np.take_along_axis(distance, order, axis=1)
    alive, kept = np.isfinite(far), np.zeros(far.shape, bool)
    for at in range(far.shape[1]):
        now = np.flatnonzero(alive[:, at] & (kept.sum(axis=1) < degree))
        kept[now, at] = True
        # Squared chords compare as twice these; alpha applies to chords.
        alive[now] &= alpha * alpha * np.maximum(1 - similar[candidates[now, at, None], candidates[now]], 0) > far[now]
    return candidates, kept


def robust_prune(x: np.ndarray, i: int, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours of x[i]: candidates by distance, without those that a kept one covers."""
    rows = np.r_[i, candidates]
    order, kept = pruned(x[rows] @ x[rows].T, np.arange(1, len(rows))[None, :], np.zeros(1, np.int64), degree, alpha)
    return rows[order[kept]].tolist()


def adjacency(x: np.ndarray, order: np.ndarray, sub_shard: int = SUB_SHARD) -> tuple[list[set[int]], list[int]]:
    """Robust-pruned neighbours of each row of x, united over overlapping sub-shards, and the sub-shards' medoids.

    order: numbers whose hash picks the pivots.
    """
    k = max(1, int(np.ceil(2 * len(x) / sub_shard)))
    pivots = x[np.argsort(order * 2654435761 % (1 << 32), kind="stable")[:k]]
    two = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :2]
    links: list[set[int]] = [set() for _ in range(len(x))]
    medoids = []
    for c in range(k):
        near = np.flatnonzero((two == c).any(axis=1))
        for at in range(0, len(near), 4 * sub_shard):
            own = near[at : at + 4 * sub_shard]
            similar = x[own] @ x[own].T
            medoids.append(int(own[np.argmax(similar.sum(axis=1))]))
            most = min(len(own), 3 * DEGREE + 1)
            nearest = np.argpartition(-similar, most - 1, axis=1)[:, :most]
            candidates, kept = pruned(similar, nearest, np.arange(len(own)))
            row, at = np.nonzero(kept)
            for i, j in zip(own[row].tolist(), own[candidates[row, at]].tolist()):
                links[i].add(j)
                links[j].add(i)
    return links, medoids


class FlatGraph:
    """Search over rows of x by their neighbours' positions."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], medoids: np.ndarray):
        self.x, self.links, self.medoids = x, links, medoids

    def within(self, q: np.ndarray, cosine: float, beam: int = BEAM) -> np.ndarray:
        """Rows whose cosine with q is at least `cosine`, found by range-expanding greedy search."""
        seen = np.zeros(len(self.x), bool)
        expanded = np.zeros(len(self.x), bool)
        pool = np.unique(self.medoids)
        seen[pool] = True
        score = self.x[pool] @ q
        while True:
            order = np.argsort(-score, kind="stable")
            # The beam's best, and beyond it all that lie within the range.
            keep = order[: max(beam, int((score >= cosine).sum()))]
            pool, score = pool[keep], score[keep]
            todo = pool[~expanded[pool]]
            if not len(todo):
                break
            ranged = todo[score[~expanded[pool]] >= cosine]
            step = ranged if len(ranged) else todo[:4]
            expanded[step] = True
            new = np.unique(np.concatenate([self.links[i] for i in step]))
            new = new[~seen[new]]
            seen[new] = True
            pool, score = np.concatenate([pool, new]), np.concatenate([score, self.x[new] @ q])
        return pool[score >= cosine]


PLACED = ["node", "label", "embedding", "copies", "shard", "home"]


def in_rounds(rows: DataFrame, rounds: int, *key: str) -> list[DataFrame]:
    """rows by a hash of their key in so many shares."""
    return [rows.where(F.pmod(F.xxhash64(*key, F.lit(3)), F.lit(rounds)) == r) for r in range(rounds)] if rounds > 1 else [rows]


def written(parts: list[DataFrame], label: str, **options: str) -> tuple[DataFrame, str]:
    """The rows of the parts, a job each, as one scratch table and its path."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, label)
    for part in parts:
        part.write.mode("append").options(**options).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path), path


def fitted(rows: DataFrame, sizes: DataFrame, key: list[str], sample: int, fit: Callable[[pa.Table], dict], kind: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rounds: int) -> list[DataFrame]:
    """What run makes of the rows (node, embedding and others) of the keys in sizes (key, n) and of fit's row for the key (`kind`), in parts of about PART rows.

    fit sees about `sample` of a key's n rows, in order of node; run sees no fitted row where that sample is empty.
    """
    types, rows = dict(rows.dtypes), rows.join(sizes, key)
    drawn = rows.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < F.lit(float(sample << 20)) / F.col("n")).select(*key, "n", "node", "embedding")

    def one(group: pa.Table) -> pa.Table:
        g = group.sort_by("node")
        return pa.Table.from_pylist([{c: g[c][0].as_py() for c in key} | fit(g)])

    found = materialize(drawn.groupBy(*key).applyInArrow(one, ", ".join([f"{c} {types[c]}" for c in key] + [kind])), "vectors-fitted")
    parts = F.ceil(F.col("n") / PART).cast("int")
    spread = found.join(sizes, key).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("n")
    return [share.groupBy(*key, "part").cogroup(spread.groupBy(*key, "part")).applyInArrow(run, schema) for share in in_rounds(dealt, rounds, "node")]


def divided(placed: DataFrame, sizes: DataFrame, sample: int, shard: int, rounds: int = 1) -> list[DataFrame]:
    """The rows of the shards in sizes (label, shard, n) dealt to centres of their own."""

    def fit(g: pa.Table) -> dict:
        x = unit_rows(g["embedding"].combine_chunks())
        # Shards of half the size that is wanted, as some come out larger than others.
        return {"centres": fit_centres(x, max(2, min(FANOUT, len(x) // 4, -(-2 * g["n"][0].as_py() // shard)))).tolist()}

    def deal(rows: pa.Table, found: pa.Table) -> pa.Table:
        # A shard whose sample is empty stays whole.
        if not rows.num_rows or not found.num_rows:
            return rows.select(PLACED)
        c = np.array(found["centres"][0].as_py(), float)
        at = (unit_rows(rows["embedding"].combine_chunks()) @ c.T).argmax(axis=1)
        name = rows["shard"][0].as_py()
        return rows.select(PLACED).set_column(4, "shard", pa.array([f"{name}.{i}" for i in at], pa.string()))

    schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in PLACED)
    return fitted(placed, sizes, ["label", "shard"], sample, fit, "centres array<array<double>>", deal, schema, rounds)


@lru_cache(2)
def planes(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions of keys and of sketches."""
    rng = np.random.default_rng(7)
    return rng.normal(size=(dims, TABLES * KEY_BITS)), rng.normal(size=(dims, SKETCH))


def key_plan(x: np.ndarray, n: int, cosine: float) -> dict:
    """Medians of the projections of a sample x of n vectors, the bits of a key and the number of tables."""
    along = planes(x.shape[1])[0]
    middle = np.median(x @ along, axis=0)
    u = np.random.default_rng(8).normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    own, other = ((y @ along > middle).reshape(-1, TABLES, KEY_BITS) for y in (x, cosine * x + np.sqrt(max(0, 1 - cosine * cosine)) * u))
    # Pairs of the sample that share a key of so many bits, and pairs at the radius that do.
    key, bits, share = np.zeros((len(x), TABLES), np.int64), 0, 1.0
    while bits < KEY_BITS and n * share > BUCKET:
        key = key * 2 + own[:, :, bits]
        bits += 1
        counts = [np.unique(k, return_counts=True)[1] for k in key.T]
        share = float(np.mean([(c * (c - 1)).sum() for c in counts])) / max(1, len(x) * (len(x) - 1))
    met = float((own == other)[:, :, :bits].all(axis=2).mean())
    tables = TABLES if met <= 0 else 1 if met >= 1 else int(np.clip(np.ceil(np.log(MISSED) / np.log(1 - met)), 1, TABLES))
    return {"middle": middle.tolist(), "bits": bits, "tables": tables}


SKETCHED = "node long, label long, root string, shard string, sketch binary, keys array<int>"


def sketched(homes: DataFrame, cosine: float, sample: int, rounds: int) -> list[DataFrame]:
    """Sketch and keys, one for each table, of every vector of a label and length (root) that has several shards."""
    root = F.split("shard", r"\.")[0]
    rows = homes.where(F.contains("shard", F.lit("."))).withColumn("root", root)
    sizes = materialize(rows.groupBy("label", "root").agg(F.count(F.lit(1)).alias("n")), "vectors-sizes")

    def fit(g: pa.Table) -> dict:
        return key_plan(unit_rows(g["embedding"].combine_chunks()), g["n"][0].as_py(), cosine)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        g = rows.select(["node", "label", "root", "shard"])
        x = unit_rows(rows["embedding"].combine_chunks()) if rows.num_rows else np.zeros((0, 1))
        along, sketches = planes(x.shape[1])
        # Without a sample all rows share one key.
        middle, bits, tables = (found[c][0].as_py() for c in ("middle", "bits", "tables")) if found.num_rows else (0.0, 0, 1)
        keys = (x @ along > np.array(middle)).reshape(-1, TABLES, KEY_BITS)[:, :tables, :bits] @ (1 << np.arange(bits, dtype=np.int32))
        bytes_of = np.packbits(x @ sketches > 0, axis=1)
        return g.append_column("sketch", pa.array([r.tobytes() for r in bytes_of], pa.binary())).append_column("keys", pa.array(keys.astype(np.int32).tolist(), pa.list_(pa.int32())))

    return fitted(rows, sizes, ["label", "root"], sample, fit, "middle array<double>, bits long, tables long", run, SKETCHED, rounds)


def near_homes(a: np.ndarray, home_a: np.ndarray, b: np.ndarray, home_b: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, home of a row of b that is another than its own and whose sketch differs in at most `most` bits), each once."""
    order = np.argsort(home_b, kind="stable")
    b, home_b = b[order], home_b[order]
    starts = np.flatnonzero(np.r_[True, home_b[1:] != home_b[:-1]])
    rows, homes, some = [np.zeros(0, np.int64)], [home_b[:0]], min(2, b.shape[1])
    # Two of the words tell most pairs apart, six standard errors being left to the others.
    rough = most / SKETCH * 64 * some + 6 * np.sqrt(64 * some) / 2
    for at in range(0, len(a), 256):
        left = np.arange(at, min(at + 256, len(a)))
        differ = sum(np.bitwise_count(a[left, w, None] ^ b[None, :, w]).astype(np.int16) for w in range(some))
        maybe = ((differ <= rough) & (home_a[left, None] != home_b[None, :])).any(axis=1)
        left, differ = left[maybe], differ[maybe]
        if len(left):
            for w in range(some, b.shape[1]):
                differ += np.bitwise_count(a[left, w, None] ^ b[None, :, w])
            hit = np.logical_or.reduceat((differ <= most) & (home_a[left, None] != home_b[None, :]), starts, axis=1)
            row, at_home = np.nonzero(hit)
            rows.append(left[row])
            homes.append(home_b[starts[at_home]])
    return np.concatenate(rows), np.concatenate(homes)


KEY = ["label", "root", "at", "key"]


def large_keys(sketches: DataFrame) -> DataFrame:
    """(KEY, blocks): keys of many rows, which are dealt into blocks, every two of which meet."""
    n = sketches.select("label", "root", F.posexplode("keys").alias("at", "key")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return materialize(n.select(*KEY, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "vectors-keys")


def met(sketches: DataFrame, large: DataFrame, first: int, cosine: float) -> DataFrame:
    """(node, label, shard): the homes of vectors that are near by their sketches and share a key of TOGETHER tables from the first on."""
    chord = min(2.0, np.sqrt(max(0.0, 2 - 2 * cosine)) + OVERLAP)
    most = SKETCH * 2 * np.arcsin(chord / 2) / np.pi
    keyed = sketches.select("node", "label", "root", "shard", "sketch", F.posexplode("keys").alias("at", "key")).where(F.col("at").between(first, first + TOGETHER - 1))
    keyed = keyed.join(large, KEY, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    units = keyed.withColumn("u", F.explode(pairs)).select("node", "shard", "sketch", "block", *KEY, "u.i", "u.j")

    def run(group: pa.Table) -> pa.Table:
        nodes, block = group["node"].to_numpy(), group["block"].to_numpy()
        named = group["shard"].combine_chunks().dictionary_encode()
        home = named.indices.to_numpy()
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(nodes), -1)
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        sides = [(block == i, block == j)] + ([(block == j, block == i)] if i != j else [])
        found = [(nodes[p][row], shard) for p, q in sides if p.any() and q.any() for row, shard in [near_homes(sketch[p], home[p], sketch[q], home[q], most)]]
        node = np.concatenate([np.zeros(0, np.int64), *(n for n, _ in found)])
        shard = np.concatenate([np.zeros(0, np.int32), *(h for _, h in found)])
        return pa.table({"node": node, "label": pa.repeat(group["label"][0], len(node)), "shard": named.dictionary.take(pa.array(shard, pa.int32()))})

    return units.groupBy(*KEY, "i", "j").applyInArrow(run, "node long, label long, shard string")


def visitors(homes: DataFrame, cosine: float, sample: int, rounds: int) -> DataFrame | None:
    """(node, label, shard) for the shards that a vector belongs to beside its home; None if no label has several shards."""
    spark = homes.sparkSession
    if homes.where(F.contains("shard", F.lit("."))).isEmpty():
        return None
    sketches, path = written(sketched(homes, cosine, sample, rounds), "vectors-sketches")
    tables = sketches.agg(F.max(F.size("keys"))).first()[0]
    large = large_keys(sketches)
    found, at = written([met(sketches, large, first, cosine) for first in range(0, tables, TOGETHER)], "vectors-met")
    visits = materialize(found.distinct(), "vectors-visits")
    discard(spark, path, at)
    return visits


def members(classes: DataFrame, shard: int | None = None, sample: int = SAMPLE, path: str | None = None, paths: list[str] | None = None, cosine: float = COSINE, rounds: int = 1) -> DataFrame:
    """Classes (node, label, embedding, copies) with their shard and whether it is their home, a row for each shard they belong to.

    path: that of classes, if they are a table that may go; paths: takes the paths of the tables that the result reads.
    """
    shard, spark, kept = shard or SHARD, classes.sparkSession, [] if paths is None else paths
    placed = classes.withColumns({"shard": F.size("embedding").cast("string"), "home": F.lit(True)}).select(PLACED)
    done, before = None, None
    while True:
        sizes = placed.groupBy("label", "shard").agg(F.count(F.lit(1)).alias("n"))
        if before is None:
            divisible = F.col("n") > shard
        else:
            parent = before.select("label", F.col("shard").alias("parent"), F.col("n").alias("whole"))
            sizes = sizes.withColumn("parent", F.regexp_replace("shard", r"\.\d+$", "")).join(parent, ["label", "parent"], "left")
            # A shard that stayed whole has no parent among those divided.
            divisible = (F.col("n") > shard) & F.coalesce(F.col("n") <= STUCK * F.col("whole"), F.lit(False))
        sizes = materialize(sizes.select("label", "shard", "n", divisible.alias("divide")), "vectors-sizes")
        large = sizes.where("divide").select("label", "shard", "n")
        if large.isEmpty():
            kept += [path] if path else []
            homes = placed if done is None else done.unionByName(placed)
            break
        rest = placed.join(sizes.where("NOT divide").select("label", "shard"), ["label", "shard"]).select(PLACED)
        rest, at = written(in_rounds(rest, rounds, "node"), "vectors-members")
        kept.append(at)
        done = rest if done is None else done.unionByName(rest)
        dealt, at = written(divided(placed, large, sample, shard, rounds), "vectors-members")
        discard(spark, *([path] if path else []))
        placed, path, before = dealt, at, large
    visits = visitors(homes, cosine, sample, rounds)
    if visits is None:
        return homes
    away = likely_in(homes, "node", visits.select("node")).drop("shard", "home").join(visits, ["node", "label"]).withColumn("home", F.lit(False)).select(PLACED)
    away, at = written(in_rounds(away, rounds, "node"), "vectors-members")
    kept.append(at)
    return homes.unionByName(away)


def blocked(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """placed with the number of blocks of its shard and its own; sizes: label, shard, blocks."""
    return placed.join(sizes, ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))


BUILT = "node long, label long, shard string, blocks int, block int, medoid boolean, links array<long>"


def built(blocks: DataFrame) -> DataFrame:
    """Each vector's block in each of its shards, whether it is a medoid there, and its neighbours (nodes) within the block."""

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by("node")
        nodes = g["node"].to_numpy()
        links, medoids = adjacency(unit_rows(g["embedding"].combine_chunks()), nodes)
        medoid = np.zeros(len(nodes), bool)
        medoid[medoids] = True
        named = pa.array([nodes[sorted(s)] for s in links], pa.list_(pa.int64()))
        return g.select([c.split()[0] for c in BUILT.split(", ")[:5]]).append_column("medoid", pa.array(medoid)).append_column("links", named)

    return blocks.groupBy("label", "shard", "block").applyInArrow(run, BUILT)


def united(graph: DataFrame, away: DataFrame) -> tuple[DataFrame, str]:
    """graph with the neighbours of each vector from all blocks that hold it, and the path of those that are new; away: nodes, once or more, with several shards."""
    marked = passed(graph, "node", filter_of(away, "node"))
    shared = marked.where("passed").drop("passed")
    several = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list("links"))).alias("all")).where("n > 1").select("node", "all")
    shared = shared.join(several, "node", "left").withColumn("links", F.coalesce("all", "links")).drop("all")
    shared, path = scratch_table(shared.select(graph.columns), "vectors-united", compression="zstd")
    return marked.where("NOT passed").drop("passed").unionByName(shared), path


def unit_links(nodes: np.ndarray, x: np.ndarray, copies: np.ndarray, links: list, medoids: np.ndarray, asks: np.ndarray, holds: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that ask, their numbers of verified links to rows that hold, a spanning forest of these links as pairs of nodes).

    nodes are in order; copies: rows that a row stands for; links: neighbours by node, those beyond the unit are left out.
    """
    held = np.flatnonzero(holds)
    own = nodes[held]

    def inside(found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        return at[own[at] == found]

    graph = FlatGraph(x[held], [inside(np.asarray(links[i], np.int64)) for i in held], inside(nodes[medoids & holds]))
    asking = np.flatnonzero(asks)
    n, root, forest = np.zeros(len(asking), np.int64), np.arange(len(nodes)), []
    for at, i in enumerate(asking):
        found = held[graph.within(x[i], cosine - 1e-9)]
        found = found[((x[found] * x[i]).sum(axis=1) >= cosine) & (found != i)]
        n[at] = copies[found].sum()
        others, first = np.unique(root[found], return_index=True)
        new = others != root[i]
        if new.any():
            forest += [(nodes[i], nodes[j]) for j in found[first[new]]]
            root[np.isin(root, others[new])] = root[i]
    return asking, n, np.array(forest, np.int64).reshape(-1, 2)


def searched(blocks: DataFrame, graph: DataFrame, cosine: float) -> DataFrame:
    """Rows (node, n) for each search of a vector in a block, and rows (a, b) of the links' forests."""
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    unit = ["label", "shard", "i", "j"]
    # A block's vectors ask in every block of their home shard, their own among them; a block is held for the askers of every block.
    asks = F.transform(every, lambda o: F.struct(F.col("block").alias("i"), o.alias("j"), F.col("home").alias("asks"), (o == F.col("block")).alias("holds")))
    holds = F.transform(F.filter(every, lambda o: o != F.col("block")), lambda o: F.struct(o.alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("holds")))
    roles = blocks.withColumn("u", F.explode(F.concat(asks, holds))).where("u.asks OR u.holds")
    roles = roles.select("label", "shard", "u.i", "u.j", "node", "embedding", "copies", "u.asks", "u.holds")
    # The links of a block's vectors go to each unit that holds it.
    held = graph.withColumn("i", F.explode(every)).select("label", "shard", "i", F.col("block").alias("j"), "node", "medoid", "links")

    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        g, known = group.sort_by("node"), known.sort_by("node")
        nodes, asks, holds = (g[c].to_numpy() for c in ("node", "asks", "holds"))
        node = n = np.zeros(0, np.int64)
        forest = np.zeros((0, 2), np.int64)
        if asks.any() and holds.any():
            at = np.searchsorted(nodes, known["node"].to_numpy())
            medoid, links = np.zeros(len(nodes), bool), [[]] * len(nodes)
            medoid[at] = known["medoid"].to_numpy()
            for i, own in zip(at.tolist(), known["links"].to_pylist()):
                links[i] = own
            rows, n, forest = unit_links(nodes, unit_rows(g["embedding"].combine_chunks()), g["copies"].to_numpy(), links, medoid, asks, holds, cosine)
            node = nodes[rows]
        empty, blank = pa.nulls(len(forest), pa.int64()), pa.nulls(len(node), pa.int64())
        return pa.table({"node": pa.concat_arrays([pa.array(node), empty]), "n": pa.concat_arrays([pa.array(n), empty]), "a": pa.concat_arrays([blank, pa.array(forest[:, 0])]), "b": pa.concat_arrays([blank, pa.array(forest[:, 1])])})

    return roles.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInArrow(run, "node long, n long, a long, b long")


def audit(classes: DataFrame, cosine: float = COSINE, queries: int = AUDIT, rounds: int = 1) -> tuple[int, int, int]:
    """Brute force on a bounded set of queries: links that classes count, links that there are, and links that join two components.

    classes: node, label, embedding, copies, n, component. The queries are the `queries` classes of smallest hash, in a
    closure; every class is compared with them once.
    """
    chosen = [r.node for r in classes.select("node").orderBy(F.xxhash64("node"), "node").limit(queries).collect()]
    asked = classes.where(F.col("node").isin(chosen)).select("node", "label", "embedding", "component", "copies", "n").collect()
    ready: dict[tuple, tuple] = {}
    for r in asked:
        ready.setdefault((r.label, len(r.embedding)), []).append(r)
    ready = {k: (unit_rows(pa.array([r.embedding for r in v])), np.array([r.component for r in v])) for k, v in ready.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = torn = 0
            sizes = pa.compute.list_value_length(b.column(1)).to_numpy()
            for label, d in ready:
                part = b.filter(pa.array((b.column(0).to_numpy() == label) & (sizes == d)))
                if part.num_rows:
                    x, component = ready[label, d]
                    near = unit_rows(part.column(1)) @ x.T >= cosine
                    links += int((near * part.column(2).to_numpy()[:, None]).sum())
                    torn += int((near & (part.column(3).to_numpy()[:, None] != component[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([torn])], ["links", "torn"])

    links = torn = 0
    for part in in_rounds(classes, rounds, "node"):
        r = part.select("label", "embedding", "copies", "component").mapInArrow(run, "links long, torn long").agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("torn"), F.lit(0))).first()
        links, torn = links + r[0], torn + r[1]
    # A query meets itself once among all rows.
    return sum(r.n for r in asked), links - len(asked), torn


def near_vectors(vectors: DataFrame, cosine: float = COSINE, queries: int = AUDIT) -> DataFrame:
    """Link rows (vec_id, embedding, label) of equal labels whose vectors' cosine is at least `cosine`.

    Returns vec_id, n_links, component_id, kept, one row per row. Vectors that are null, zero or hold a null or
    non-finite component, and rows without a label or id, link with nothing; vectors of different lengths link with
    nothing either. Rows equal in label and vector are one class, searched once, and link with each other, so a repeated
    row counts as a link of the other; a row that repeats a vec_id with another vector is a vector of its own. Other
    columns are ignored; an empty table gives an empty result. A recall under LEAST_RECALL in the audit, of `queries`
    vectors, is an error.
    """
    with configured(vectors.sparkSession, NO_OLD_SHUFFLES):
        return _near(vectors, cosine, queries)


def _near(vectors: DataFrame, cosine: float, queries: int) -> DataFrame:
    spark = vectors.sparkSession
    keyed = vectors.select("vec_id", "label", "embedding")
    kind = keyed.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = keyed.where(usable()).select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    # Classes are told apart by their vectors; rows find theirs by a digest of it (0 and -0 are equal), which is short.
    digest = F.unhex(F.md5(F.concat_ws(",", F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1])).cast("array<string>")))).alias("digest")
    classes = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes, path = scratch_table(classes.select(F.monotonically_increasing_id().alias("node"), "vec_id", "label", "embedding", "copies"), "vectors-classes")
    names = materialize(classes.select("node", "vec_id", "label", "copies", digest), "vectors-names")
    rounds = 1 + min(ROUNDS - 1, (classes.agg(F.sum(F.size("embedding"))).first()[0] or 0) // ROUND)
    paths: list[str] = []
    placed = members(classes.drop("vec_id"), path=path, paths=paths, cosine=cosine, rounds=rounds)
    sizes = placed.groupBy("label", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = in_rounds(blocked(placed, materialize(sizes, "vectors-blocks")), rounds, "label", "shard")
    graph, path = written([built(part) for part in blocks], "vectors-graph", compression="zstd")
    links = [path]
    away = placed.where("NOT home").select("node")
    if not away.isEmpty():
        graph, path = united(graph, away)
        links.append(path)
    found, _ = written([searched(part, known, cosine) for part, known in zip(blocks, in_rounds(graph, rounds, "label", "shard"))], "vectors-links")
    discard(spark, *links)
    degree = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    named = names.select("node", "vec_id").join(components(found.where("a IS NOT NULL").select("a", "b")).toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("vec_id").alias("component"))
    labels = named.join(lowest, "root").select("node", "component")
    by_class = names.join(degree, "node", "left").join(labels, "node").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    by_class = materialize(by_class, "vectors-by-class")
    vectors_of = placed.where("home").select("node", "label", "embedding", "copies").join(by_class.select("node", "n", "component"), "node")
    counted, there, torn = audit(vectors_of, cosine, queries, rounds) if queries else (0, 0, 0)
    discard(spark, *paths)
    if counted < LEAST_RECALL * there:
        raise RuntimeError(f"the audit found {counted} of {there} links; {torn} links join two components")
    linked = rows.select("vec_id", "label", digest).join(by_class.select("label", "digest", "n", "component"), ["label", "digest"]).select("vec_id", "n", "component")
    alone = keyed.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    out = linked.unionByName(alone).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id
"""
