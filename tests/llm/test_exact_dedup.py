import hashlib

import duckdb
import pytest

from entroflow.llm import exact_dedup
from entroflow.llm.exact_dedup import OP4_SQL, op4_exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, n_chars long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute(docs):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append((-(len(t or "")), i is None, i))
    out = []
    for i, t in docs:
        g = groups[norm(t)]
        out.append((i, min(g)[2], len(g), min(g)[2] == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [
    [],
    [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a b"), (8, "x" * 200_000), (9, "x" * 200_000)],
    [(5, "same"), (3, "same"), (3, "same"), (9, "other"), (None, "same"), (None, "alone")],
    [(i, f"text {i % 7}" + " " * (i % 5)) for i in range(200)],
]


@pytest.mark.parametrize("docs", CASES)
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_brute_force(spark, docs, digest_bytes):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], SCHEMA)
    assert rows(exact_dedup.exact_dedup(df, digest_bytes)) == brute(docs)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({OP4_SQL})").fetchall()
    assert rows(op4_exact_dedup(spark, sf_dir)) == sorted(want, key=str)


def test_native_plan(spark, sf_dir):
    plan = op4_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_compaction_looks_up_the_filter_and_merges_the_rest(spark):
    schema = "key binary, keep_id long, code_points int, digest binary, group_size long"
    older = spark.createDataFrame([(b"a", 5, 9, b"a", 2), (b"b", None, 4, b"b", 1), (b"c", 3, 4, b"c", 1)], schema)
    newer = spark.createDataFrame([(b"a", 4, 9, b"a", 3), (b"b", 8, 4, b"b", 1), (b"d", 1, 1, b"d", 7)], schema)
    a, b = (exact_dedup.Level(x, exact_dedup.filter_of(x, "key")) for x in (older, newer))
    assert {bytes(r.key): r.passed for r in exact_dedup.passed(newer, "key", a.filter).collect()} == {b"a": True, b"b": True, b"d": False}
    level = exact_dedup.compact(a, b)
    assert sorted((bytes(r.key), r.keep_id, r.code_points, r.group_size) for r in level.entries.collect()) == [(b"a", 4, 9, 5), (b"b", 8, 4, 2), (b"c", 3, 4, 1), (b"d", 1, 1, 7)]
    assert all(r.passed for r in exact_dedup.passed(older.unionByName(newer), "key", level.filter).collect())
