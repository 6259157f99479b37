"""Dated logs: pruning by name, zip members, plain and compressed files, writing."""

import datetime as dt
import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from entroflow.sources import logs, series

DAY = dt.date(2024, 2, 28)


def day(i):
    return DAY + dt.timedelta(days=i)


@pytest.fixture()
def folder(tmp_path):
    for i in range(4):
        with zipfile.ZipFile(tmp_path / f"site7_{day(i):%Y%m%d}.zip", "w") as z:
            z.writestr("one.txt", f"a{i}\r\nb{i}\n\nlast{i}")
            z.writestr("sub/two.txt", f"c{i}\n")
            z.writestr("empty.txt", "")
    (tmp_path / "site_20240301.txt").write_text("plain\n")
    (tmp_path / "x99999999_20240302.txt.gz").write_bytes(gzip.compress("zipped é\n".encode()))
    (tmp_path / "undated.txt").write_text("none\n")
    (tmp_path / "_log_20240301_part.zip").write_text("not committed")
    (tmp_path / "nested").mkdir()
    return str(tmp_path)


def test_lines_of_all_files(spark, folder):
    got = {(r.file, r.member, r.line_no): (r.file_date, r.line) for r in logs.read_logs(spark, folder).collect()}
    want = {("site_20240301.txt", None, 0): (day(2), "plain"), ("x99999999_20240302.txt.gz", None, 0): (day(3), "zipped é"), ("undated.txt", None, 0): (None, "none")}
    for i in range(4):
        name = f"site7_{day(i):%Y%m%d}.zip"
        want |= {(name, "one.txt", k): (day(i), v) for k, v in enumerate((f"a{i}", f"b{i}", "", f"last{i}"))} | {(name, "sub/two.txt", 0): (day(i), f"c{i}")}
    assert got == want


def test_other_days_are_not_opened(spark, folder):
    # A damaged file raises where it is opened, so these pass only if it isn't.
    with open(f"{folder}/broken_{day(0):%Y%m%d}.zip", "w") as f:
        f.write("no zip file")
    files = lambda df: {r.file[:14] for r in df.select("file").distinct().collect()}
    read = lambda: logs.read_logs(spark, folder)
    assert files(logs.read_logs(spark, folder, day(1), day(2))) == {"site7_20240229", "site7_20240301", "site_20240301."}
    assert files(read().where((F.col("file_date") > F.lit(day(0))) & (F.col("file_date") < F.lit(day(2))) & (F.col("line") != ""))) == {"site7_20240229"}
    assert files(read().where(F.col("file_date").isin(day(1), day(3)) & (F.col("line_no") == 0))) == {"site7_20240229", "site7_20240302", "x99999999_2024"}
    assert files(read().where(F.col("file_date") == F.lit(day(3)))) == {"site7_20240302", "x99999999_2024"}
    with pytest.raises(Exception, match="zip"):
        read().collect()


def test_tasks_take_files_by_size():
    sizes = [("a", 5), ("c", 5), ("b", 5), ("d", 100), ("e", 1)]
    assert [f.names for f in logs.dealt(sizes, 10)] == [("a", "b"), ("c",), ("d",), ("e",)]
    assert logs.dealt([], 10) == []


def test_long_members_come_in_batches(monkeypatch):
    monkeypatch.setattr(logs, "BATCH_LINES", 3)
    batches = list(logs._batches("log_20240301.txt", "m", (b"%d\n" % i for i in range(7))))
    assert [b.num_rows for b in batches] == [3, 3, 1]
    assert [r["line_no"] for b in batches for r in b.to_pylist()] == list(range(7))
    assert logs.date_of("no20249999_20240301") == dt.date(2024, 3, 1) and logs.date_of("x1234567") is None


def test_written_logs_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(day(i % 3) if i % 7 else None, f"line {i:04d}" if i % 5 else None) for i in range(300)]
    logs.write_logs(spark.createDataFrame(rows, "file_date date, line string"), path)
    logs.write_logs(spark.createDataFrame([(day(9), "later")], "file_date date, line string"), path)
    back = logs.read_logs(spark, path)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.file_date, r.line) for r in back.collect()), key=key) == sorted([*((d, v or "") for d, v in rows), (day(9), "later")], key=key)
    names = [r.file for r in logs.listing(spark, path).collect()]
    assert names and all(n.startswith("log_") for n in names)
    assert {r.file for r in back.select("file").distinct().collect()} == set(names)


def test_empty_folder_and_empty_table(spark, tmp_path):
    assert logs.read_logs(spark, str(tmp_path)).count() == 0
    logs.write_logs(spark.createDataFrame([], "file_date date, line string"), str(tmp_path / "none"))
    assert logs.read_logs(spark, str(tmp_path / "none")).count() == 0


def test_flux_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f_20240301.zip", "w") as z:
        z.writestr("f.txt", "head\n# date time u v w value qc\n2024-03-01 10:00:00 1 2 3 4.5 1\n2024-03-01 11:00:00 1 2 3 -999 0\n2024-03-01 12:00:00 1\n")
    got = series.read_flux_zips(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.ts.hour, r.value, r.qc) for r in got] == [(17, 4.5, 1), (18, None, 0), (19, None, None)]
