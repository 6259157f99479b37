"""Reading and writing series: CSV and Parquet sources, time-column detection, text logs, small report sinks."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logs


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating-point columns: aggregates then skip it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def numeric_columns(df: DataFrame, time_col: str | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != time_col]


def detect_time_column(df: DataFrame, preferred: str | None = None, sample: int = 20) -> str | None:
    """The preferred column if there is one, else the first timestamp column or text column whose first values all parse."""
    if preferred in df.columns:
        return preferred
    for f in df.schema:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
        if isinstance(f.dataType, T.StringType):
            first = df.where(F.col(f.name).isNotNull()).select(f.name).limit(sample)
            n, parsed = first.agg(F.count(F.lit(1)), F.count(F.try_to_timestamp(F.col(f.name)))).first()
            if n and n == parsed:
                return f.name
    return None


def load_csv(spark: SparkSession, path: str | list[str], time_col: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV table with its time column parsed; files are read in parallel and order is by time wherever it matters."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    name = detect_time_column(df, time_col)
    if name is None:
        raise ValueError("no column can be read as time")
    if isinstance(df.schema[name].dataType, T.StringType):
        df = df.withColumn(name, F.to_timestamp(name))
    return missing_as_null(df)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")


def between_dates(df: DataFrame, start: str, end: str, pattern: str = r"(\d{8})") -> DataFrame:
    """Rows of files whose name holds a date from start to end (yyyymmdd)."""
    date = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return df.where((date >= start) & (date <= end))


def flux_rows(lines: DataFrame, shift_hours: int = 7, fill: float = -999.0, line: str = "value") -> DataFrame:
    """Lines "date time .. value qc" (fields 1, 2, 6, 7) as (ts, value, qc), shifted to UTC; the fill value becomes null, lines without a time are left out."""
    part = F.split(F.trim(line), r"\s+")
    rows = lines.select(
        F.try_to_timestamp(F.concat_ws(" ", part[0], F.try_element_at(part, F.lit(2)))).alias("ts"), F.try_element_at(part, F.lit(6)).try_cast("double").alias("value"), F.try_element_at(part, F.lit(7)).try_cast("int").alias("qc")
    )
    return rows.where("ts IS NOT NULL").withColumns({"ts": F.col("ts") + F.expr(f"INTERVAL {shift_hours} HOURS"), "value": F.nullif(F.col("value"), F.lit(fill))})


def read_flux_log(spark: SparkSession, path: str, shift_hours: int = 7, fill: float = -999.0) -> DataFrame:
    """flux_rows of plain text files."""
    return flux_rows(spark.read.text(path), shift_hours, fill)


def read_flux_zips(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, shift_hours: int = 7, fill: float = -999.0) -> DataFrame:
    """flux_rows of a folder of zipped logs; of dated files only those from start to end are opened."""
    return flux_rows(logs.read_logs(spark, path, start, end), shift_hours, fill, "line")


def quality_masked(value: Column, qc: Column, good: Sequence[int] = (0, 1), default: int = 2) -> Column:
    """value where its flag is good, a missing flag counting as default."""
    return F.when(F.coalesce(qc, F.lit(default)).isin(*good), value)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_layers(df: DataFrame, path: str, by: str = "target") -> None:
    """Long layers (by, entity, idx, value, baseline, excess) as Parquet, a folder for each value of `by`."""
    df.write.partitionBy(by).parquet(path)


def load_series(spark: SparkSession, path: str, columns: Sequence[str] | None = None, before: str | None = None, time_col: str | None = None) -> DataFrame:
    """One artifact (Parquet, else CSV): some of its columns, up to a cutoff that is excluded."""
    df = missing_as_null(spark.read.parquet(path)) if path.rstrip("/").endswith(".parquet") else load_csv(spark, path, time_col)
    name = detect_time_column(df, time_col)
    if before is not None:
        df = df.where(F.col(name) < F.lit(before).cast(df.schema[name].dataType))
    if columns:
        require_columns(df, columns)
        df = df.select(name, *[c for c in columns if c != name])
    return df


def markdown(rows: list[dict], columns: Sequence[str]) -> str:
    """A Markdown table of a few collected rows."""
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows])


def latex(rows: list[dict], columns: Sequence[str]) -> str:
    body = [" & ".join("" if r[c] is None else str(r[c]) for c in columns) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(columns) + r" \\ \hline", *body, r"\end{tabular}"])


def report_json(row: dict) -> str:
    return json.dumps(row, default=str, sort_keys=True)
