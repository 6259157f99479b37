"""Time grids, resampling onto them, and gaps. A series table is long: key columns, a time column and a value.

Times are compared as whole microseconds, so nothing depends on rounding. A sample finds the grid points whose window
holds it by arithmetic on its bin; no join on a range and no sort takes place, and aggregation starts within the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import numeric_columns, require_columns
from . import scan

HOUR = 3_600_000_000
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1e6)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def anchor(start: Column, centre: str = "standard") -> Column:
    """Where a grid begins, in microseconds: start floored to the hour, or noon or midnight of its day."""
    if centre == "standard":
        return start - F.pmod(start, F.lit(HOUR))
    if centre not in ("noon", "midnight"):
        raise ValueError(f"no grid centre {centre!r}")
    return start - F.pmod(start, F.lit(DAY)) + F.lit(12 * HOUR if centre == "noon" else 0)


def time_grid(bounds: DataFrame, hours: float, centre: str = "standard") -> DataFrame:
    """Grid points of each row (start, end in microseconds, any keys): the keys, us and idx, the position on the grid."""
    step = int(hours * HOUR)
    first = anchor(F.col("start"), centre)
    return bounds.withColumn("_a", first).withColumn("us", F.explode(F.sequence("_a", F.greatest("_a", "end"), F.lit(step)))).where("us >= start AND us <= end").withColumn(
        "idx", F.expr(f"(us - greatest(_a, _a + cast(ceil((start - _a) / {step}D) AS BIGINT) * {step})) div {step}")
    ).drop("_a", "start", "end")


def span(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time in microseconds, by key."""
    return df.groupBy(*keys).agg(F.min(micros(F.col(ts))).alias("start"), F.max(micros(F.col(ts))).alias("end"))


def bucket(df: DataFrame, ts: str, hours: float) -> DataFrame:
    """df with us, the start of the tumbling bin that holds ts; bins count from midnight, are closed left and labelled left."""
    step = int(hours * HOUR)
    at = micros(F.col(ts))
    return df.withColumn("us", at - F.pmod(at, F.lit(step)))


def bucket_grid(binned: DataFrame, hours: float, keys: Sequence[str], value_keys: DataFrame | None = None) -> DataFrame:
    """Every bin from the first to the last of all rows, for each key."""
    step = int(hours * HOUR)
    bins = binned.agg(F.min("us").alias("a"), F.max("us").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.lit(step))).alias("us"))
    if not keys:
        return bins
    # One row a key and one a bin: the grid itself, not a product of data rows.
    bounds = binned.agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return (value_keys or binned.select(*keys).distinct()).join(F.broadcast(bounds)).withColumn("us", F.explode(F.sequence("a", "b", F.lit(step)))).drop("a", "b")


def resample(df: DataFrame, ts: str, hours: float, aggregates: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Tumbling aggregates by key and bin, empty bins kept with nulls."""
    binned = bucket(df, ts, hours)
    return bucket_grid(binned, hours, keys).join(binned.groupBy(*keys, "us").agg(*aggregates), [*keys, "us"], "left")


def kernel_resample(df: DataFrame, ts: str, value: str, hours: float, kind: str = "mean", keys: Sequence[str] = (), centre: str = "standard", sigma_fraction: float = 0.25) -> DataFrame:
    """Values on a grid: keys, us, idx, value; null where the window is empty.

    kind "mean" is the Gaussian-weighted mean over 4 sigma to each side, "circular" its counterpart for degrees,
    "flux" the sum over half an interval to each side, both ends included. Null values are left out.
    """
    step = int(hours * HOUR)
    sigma = sigma_fraction * step
    reach = step / 2 if kind == "flux" else 4 * sigma
    bounds = span(df, ts).withColumn("_a", anchor(F.col("start"), centre))
    rows = df.where(F.col(value).isNotNull()).select(*keys, micros(F.col(ts)).alias("_t"), F.col(value).cast("double").alias("_v")).join(F.broadcast(bounds))
    wide = int(-(-reach // step))
    near = rows.withColumn("_b", F.floor((F.col("_t") - F.col("_a")) / step)).withColumn("us", F.explode(F.transform(F.sequence(F.lit(-wide), F.lit(wide + 1)), lambda o: F.col("_a") + (F.col("_b") + o) * step)))
    near = near.where((F.abs(F.col("_t") - F.col("us")) <= reach) & F.col("us").between(F.col("start"), F.col("end")))
    w = F.exp(F.lit(-0.5) * F.pow((F.col("_t") - F.col("us")) / sigma, 2))
    v = F.col("_v")
    if kind == "mean":
        result = F.sum(w * v) / F.sum(w)
    elif kind == "circular":
        result = F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(F.radians(v))), F.sum(w * F.cos(F.radians(v))))), F.lit(360.0))
    elif kind == "flux":
        result = F.sum(v)
    else:
        raise ValueError(f"no kernel {kind!r}")
    values = near.groupBy(*keys, "us").agg(result.alias("value"))
    ends = span(df, ts)
    grid = time_grid(df.select(*keys).distinct().join(F.broadcast(ends)) if keys else ends, hours, centre)
    return grid.join(values, [*keys, "us"], "left")


def runs(df: DataFrame, flag: Column, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with run, a number that is the same along consecutive rows of equal flag."""
    return scan.numbered(df, flag, order, keys).drop("_b")


def gaps(df: DataFrame, keys: Sequence[str] = (), order: str = "idx", us: str = "us", value: str = "value") -> DataFrame:
    """Interior runs of missing values: keys, first and last position, n_missing, gap_hours up to the next value."""
    d = scan.numbered(df, F.col(value).isNull(), order, keys)
    whole = scan.run_facts(d, keys, order)
    starts = d.groupBy(*keys, "run").agg(F.min(us).alias("_s"), F.min(F.col(value).isNull()).alias("_missing"))
    g = scan.same(whole, starts, [*keys, "run"])
    # Runs of values and of gaps take turns, so a gap ends where the next run begins.
    after = starts.select(*keys, (F.col("run") - 1).alias("run"), F.col("_s").alias("_e"))
    inner = scan.same(g.where("_missing AND run > _first_run AND run < _last_run"), after, [*keys, "run"])
    return inner.select(*keys, F.col("_lo").alias("first_idx"), F.col("_hi").alias("last_idx"), F.col("_rows").alias("n_missing"), ((F.col("_e") - F.col("_s")) / HOUR).alias("gap_hours"))


def interpolate(df: DataFrame, max_gap_hours: float | None = 3.0, keys: Sequence[str] = (), order: str = "idx", us: str = "us", value: str = "value") -> DataFrame:
    """df with filled: missing values on the line between their neighbours, in gaps of at most max_gap_hours (None: all interior ones)."""
    there = F.col(value).isNotNull()
    d = scan.neighbours(df, keys, order, there, us, value)
    of = lambda side, c: F.col(side)[c]
    places = of("_ahead", order) - of("_back", order)
    # A gap lasts from its first missing point to the next value.
    step = (of("_ahead", us) - of("_back", us)) / places
    line = of("_back", value) + (of("_ahead", value) - of("_back", value)) * (F.col(order) - of("_back", order)) / places
    short = F.lit(True) if max_gap_hours is None else (of("_ahead", us) - of("_back", us) - step) / HOUR <= max_gap_hours
    fill = F.when(there, F.col(value)).when(F.col("_back").isNotNull() & F.col("_ahead").isNotNull() & short, line)
    return d.withColumn("filled", fill).drop("_back", "_ahead")


def align_datasets(datasets: Sequence[tuple[DataFrame, str]], hours: float = 6, circular: Sequence[str] = (), flux: Sequence[str] = (), max_gap_hours: float = 3.0) -> DataFrame:
    """Several wide tables (frame, time column) on one grid over their joint span, long: variable, us, idx, value.

    Numeric columns are resampled by kind and short gaps filled. A variable in two tables is an error, as is no table.
    """
    if not datasets:
        raise ValueError("nothing to align")
    names = [c for df, ts in datasets for c in numeric_columns(df, ts)]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"columns in more than one table: {', '.join(sorted(twice))}")
    parts = []
    for df, ts in datasets:
        own = numeric_columns(df, ts)
        require_columns(df, [ts])
        if own:
            parts.append(df.select(F.col(ts).cast("timestamp").alias("ts"), *[F.col(c).cast("double") for c in own]).unpivot(["ts"], own, "variable", "value"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    ends = span(long, "ts")
    out = None
    for kind in ("mean", "circular", "flux"):
        chosen = [n for n in names if (n in flux) == (kind == "flux") and (kind == "flux" or (n in circular) == (kind == "circular"))]
        if chosen:
            # Bounds come from all tables, so each kind lies on the same grid.
            edges = ends.select(F.explode(F.array(from_micros(F.col("start")).cast("timestamp"), from_micros(F.col("end")).cast("timestamp"))).alias("ts"))
            every = long.select("variable").where(F.col("variable").isin(*chosen)).distinct().join(F.broadcast(edges)).withColumn("value", F.lit(None).cast("double"))
            part = kernel_resample(long.where(F.col("variable").isin(*chosen)).unionByName(every), "ts", "value", hours, kind, ["variable"])
            out = part if out is None else out.unionByName(part)
    return interpolate(out, max_gap_hours, ["variable"]).withColumn("value", F.col("filled")).drop("filled")


def detect_frequency(df: DataFrame, ts: str, window_days: float = 30) -> DataFrame:
    """One row: median step in hours, its label and the points of a window. Steps near 1, 4, 6 and 12 hours snap to them.

    Steps are taken within spans of 32 days, and between a span's first time and the last one of the span before.
    """
    step = F.col("h")
    t = df.select(micros(F.col(ts)).alias("us")).where("us IS NOT NULL").withColumn("span", F.floor(F.col("us") / (32 * 24 * HOUR)))
    inner = t.select((F.col("us") - F.lag("us").over(Window.partitionBy("span").orderBy("us"))).alias("d"))
    # A row a span.
    ends = t.groupBy("span").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    outer = ends.select((F.col("lo") - F.lag("hi").over(Window.orderBy("span"))).alias("d"))
    h = inner.unionByName(outer).agg(F.percentile(F.col("d") / HOUR, F.lit(0.5)).alias("h"))
    label, points = F.concat(F.lit("inferred_"), F.format_string("%.1f", step), F.lit("H")), F.floor(F.lit(window_days * 24) / step)
    for snap in (1, 4, 6, 12):
        near = F.abs(step - snap) < 0.1
        label = F.when(near, F.lit(f"{snap}H")).otherwise(label)
        points = F.when(near, F.lit(int(window_days * (24 // snap)))).otherwise(points)
    return h.select(step.alias("median_hours"), label.alias("label"), points.cast("long").alias("window_points"))


def to_length(df: DataFrame, n: int, keys: Sequence[str] = (), value: str = "value", order: str = "idx") -> DataFrame:
    """keys, i, value: each series (order counts from 0) drawn out to n points, linear on the unit interval.

    A point of the result comes from the two rows around it, so each row is sent to the points within a step of it.
    """
    sizes = df.groupBy(*keys).agg((F.max(order) + 1).alias("_n"))
    rows = df.join(sizes, list(keys)) if keys else df.join(F.broadcast(sizes))
    step = (F.col("_n") - 1) / F.lit(float(max(n - 1, 1)))
    at = F.col(order)
    low, high = F.ceil((at - 1) / step), F.floor((at + 1) / step)
    every = F.when(F.col("_n") == 1, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))))
    weight = F.when(F.col("_n") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("i") * step - at)))
    return rows.withColumn("i", F.explode(every)).groupBy(*keys, F.col("i").cast("long").alias("i")).agg(F.sum(weight * F.col(value)).alias("value"))
