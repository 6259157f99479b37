"""The driver contract in a fresh process without Spark."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); from pyspark import SparkContext; assert SparkContext._active_spark_context is None; print(len(q), len(o))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, with_sql = map(int, done.stdout.split())
    assert n > 90 and with_sql > 70
