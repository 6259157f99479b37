"""Queries on zipped logs that Spark writes from the events, with SQL on the events themselves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..sources import logs, scratch, series
from .queries import load, query


def event_logs(spark, sf_dir: str) -> str:
    """A folder of zipped logs, one or more a day, with a header line each day; local time is 7 hours behind. Returns its path."""
    e = load(spark, sf_dir, "events").where("ts IS NOT NULL").withColumn("local", F.col("ts") - F.expr("INTERVAL 7 HOURS"))
    value = F.when(F.col("event_id") % 10 == 0, F.lit(-999.0)).otherwise(F.col("value"))
    line = F.concat_ws(" ", F.date_format("local", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("u v w"), F.coalesce(value.cast("string"), F.lit("NaN")), (F.col("event_id") % 4).cast("string"))
    rows = e.select(F.to_date("local").alias("file_date"), line.alias("line"))
    heads = rows.select("file_date").distinct().withColumn("line", F.lit("# date time u v w value qc"))
    path = scratch.path_for(spark, "logs")
    logs.write_logs(rows.unionByName(heads), path)
    return path


_LINES = "lg AS (SELECT ts, CAST(ts - INTERVAL 7 HOURS AS DATE) AS day, CASE WHEN event_id % 10 <> 0 THEN value END AS value, CAST(event_id % 4 AS INTEGER) AS qc FROM events WHERE ts IS NOT NULL)"


@query(f"WITH {_LINES} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value, qc, CASE WHEN qc IN (0, 1) THEN value END AS good FROM lg")
def zipped_log(spark, sf_dir):
    rows = series.read_flux_zips(spark, event_logs(spark, sf_dir))
    return rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value", "qc", series.quality_masked(F.col("value"), F.col("qc")).alias("good"))


#: The days that log_days reads, from the first one on.
_FROM, _TO = 5, 20


@query(f"WITH {_LINES} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, round(sum(value), 6) + 0e0 AS total FROM lg WHERE day BETWEEN (SELECT min(day) FROM lg) + {_FROM} AND (SELECT min(day) FROM lg) + {_TO} GROUP BY day")
def log_days(spark, sf_dir):
    """Files are chosen by the date in their names: those of other days aren't opened."""
    path = event_logs(spark, sf_dir)
    first = logs.read_logs(spark, path).agg(F.min("file_date")).first()[0]
    rows = series.read_flux_zips(spark, path, first + dt.timedelta(days=_FROM), first + dt.timedelta(days=_TO))
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 7 HOURS")).cast("string")
    return rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 6) + F.lit(0.0)).alias("total"))


@query(f"WITH {_LINES} SELECT strftime(day, '%Y%m%d') AS day, true AS filled FROM lg GROUP BY day")
def file_listing(spark, sf_dir):
    """The files of the folder by name; how many a day has depends on the number of tasks."""
    files = logs.listing(spark, event_logs(spark, sf_dir), "log_*.zip")
    return files.groupBy(F.regexp_extract("file", r"\d{8}", 0).alias("day")).agg((F.min("length") > 0).alias("filled"))
