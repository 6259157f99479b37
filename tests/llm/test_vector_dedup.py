from pathlib import Path

import duckdb
import numpy as np
import pytest

from entroflow.llm import vector_dedup as v

from .brute import Sets

SCHEMA = "vec_id long, embedding array<float>, label int, shard string"


def brute(rows, cosine=0.98):
    x = {i: (np.array(e, float) / np.linalg.norm(np.array(e, float)), label) for i, e, label in rows if label is not None and e is not None and None not in e and np.isfinite(e).all() and any(e)}
    n, sets = {i: 0 for i, _, _ in rows}, Sets([i for i, _, _ in rows])
    for a in x:
        for b in x:
            if a < b and x[a][1] == x[b][1] and len(x[a][0]) == len(x[b][0]) and x[a][0] @ x[b][0] >= cosine:
                n[a] += 1
                n[b] += 1
                sets.join(a, b)
    return {i: (n[i], sets.find(i), sets.find(i) == i) for i, _, _ in rows}


def check(spark, rows):
    df = spark.createDataFrame([(i, e, label, "clash") for i, e, label in rows], SCHEMA)
    got = v.near_vectors(df)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def cloud(n, dims=16, centres=12, noise=0.02, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return [(i, (c[i % centres] + noise * rng.normal(size=dims) * np.linalg.norm(c[i % centres])).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0)]
    check(spark, rows)


def test_empty_table(spark):
    assert v.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clusters(spark):
    check(spark, cloud(600))


def test_units_and_shards(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", 60)
    monkeypatch.setattr(v, "OVERLAP", 0.5)
    monkeypatch.setattr(v, "SHARD", 100)
    monkeypatch.setattr(v, "PART", 50)
    check(spark, cloud(500, seed=1))


def test_several_levels_of_shards(spark, monkeypatch):
    monkeypatch.setattr(v, "SHARD", 12)
    monkeypatch.setattr(v, "FANOUT", 2)
    df = spark.createDataFrame([(i, label, e, 1) for i, e, label in cloud(300, seed=4)], "node long, label long, embedding array<double>, copies long")
    placed = v.members(df).collect()
    assert max(r.shard.count(".") for r in placed) >= 2
    assert sorted(r.node for r in placed if r.home) == list(range(300))


@pytest.mark.parametrize("order,block", [("down", 4000), ("mixed", 12)])
def test_chains_are_one_component(spark, monkeypatch, order, block):
    monkeypatch.setattr(v, "BLOCK", block)
    ids = {"up": list(range(1, 40)), "down": list(range(39, 0, -1)), "mixed": [i * 17 % 39 + 1 for i in range(39)]}[order]
    check(spark, [(i, [float(np.cos(n / 6)), float(np.sin(n / 6))], 0) for n, i in enumerate(ids)])


def test_repeated_rows_stay_as_many(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.0], None), (3, [1.0, 0.0], None), (None, [1.0, 0.0], 0)]
    got = v.near_vectors(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_audit_notices_lost_links(spark):
    x = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]]
    schema = "node long, vec_id long, label long, embedding array<double>, copies long, n long, component long"
    right = [(0, 0, 0, x[0], 2, 2, 0), (1, 1, 0, x[1], 1, 2, 0), (2, 2, 0, x[2], 1, 0, 2)]
    assert v.audit(spark.createDataFrame(right, schema)) == (4, 5 - 1, 0)
    wrong = [(0, 0, 0, x[0], 2, 1, 0), (1, 1, 0, x[1], 1, 0, 1), (2, 2, 0, x[2], 1, 0, 2)]
    assert v.audit(spark.createDataFrame(wrong, schema)) == (1, 4, 2)


def test_whole_table_and_sql(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in v.op5_vectors(spark, sf_dir).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    assert {i: (n, c, k) for i, n, c, k in con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({v.OP5_SQL})").fetchall()} == want


def test_graph_search_reaches_the_range():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[:900] = x[0] + 0.02 * rng.normal(size=(900, 32)) * np.linalg.norm(x[0])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, medoids = v.adjacency(x, np.arange(3000))
    g = v.FlatGraph(x, [np.array(sorted(s)) for s in links], np.array(medoids))
    hits = total = 0
    for i in range(0, 3000, 50):
        truth = set(np.flatnonzero(x @ x[i] >= 0.98))
        hits += len(truth & set(g.within(x[i], 0.98)))
        total += len(truth)
    assert hits / total >= 0.99


@pytest.mark.parametrize("degree", [4, 24])
def test_pruning_keeps_the_nearest(degree):
    x = np.random.default_rng(3).normal(size=(80, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = v.robust_prune(x, 0, np.arange(1, 80), degree)
    assert kept[0] == 1 + int(np.argmax(x[1:] @ x[0])) and len(kept) <= degree


def test_no_copies_of_vectors_stay(spark, monkeypatch):
    """Tables that hold vectors or links are removed once nothing reads them; they took several times the input."""
    monkeypatch.setattr(v, "SHARD", 4000)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.rglob("*.parquet"))
    out = v.near_vectors(spark.createDataFrame(cloud(300, dims=64, noise=0.005), "vec_id long, embedding array<float>, label int"))
    assert sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - before if p.is_file()) < 300 * 64 * 4
    assert out.count() == 300 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_overlap_follows_neighbours(spark, monkeypatch):
    """A vector lies in its home and its neighbours' homes; with a margin around borders it lay in nearly all shards, and copies outgrew the input."""
    monkeypatch.setattr(v, "SHARD", 200)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[2900:] = x[:100] + 0.15 * rng.normal(size=(100, 64))
    df = spark.createDataFrame([(i, 0, e.tolist(), 1) for i, e in enumerate(x)], "node long, label long, embedding array<double>, copies long")
    rows = v.members(df).select("node", "shard", "home").collect()
    home = {r.node: r.shard for r in rows if r.home}
    assert sorted(home) == list(range(3000)) and len(set(home.values())) >= 15 and len(rows) <= 3400
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, 2900 + i) for i in range(100) if x[i] @ x[2900 + i] >= 0.98]
    held = {(r.node, r.shard) for r in rows}
    assert len(pairs) > 50 and any(home[a] != home[b] for a, b in pairs)
    assert all((a, home[b]) in held and (b, home[a]) in held for a, b in pairs)


def test_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(v, "ROUND", 2000)
    monkeypatch.setattr(v, "SHARD", 100)
    check(spark, cloud(500, seed=7))
