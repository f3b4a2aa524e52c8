"""Finding the time axis of a table, its cadence and its coarser levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions import names, text
from seriesloom.operators.frames import attach, numeric_columns, text_columns, time_columns
from seriesloom.operators.profile import column_stats, date_text_columns
from seriesloom.operators.rowindex import block_columns, block_window, with_row_index

DAY = 86_400


def parse_datetime(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add ``into``: the first reading (general, then month formats) that parses more than 80 % of the rows, else null."""
    return df.withColumn(into, text.parse_candidates(F.col(column).cast("string"))[best_reading(df, column)])


def best_reading(df: DataFrame, column: str) -> int:
    """The number of the first reading that parses more than 80 % of the rows, else 0."""
    readings = text.parse_candidates(F.col(column).cast("string"))
    row = df.agg(F.count("*").alias("n"), *[F.count(p).alias(f"p{i}") for i, p in enumerate(readings)]).first()
    return next((i for i in range(len(readings)) if row[f"p{i}"] > 0.8 * row["n"]), 0)


def is_date_like_text(df: DataFrame, columns: Sequence[str], least: float = 0.6) -> DataFrame:
    """``column, share, date_like``: at least 60 % of all values are shaped like a date."""
    from seriesloom.operators.frames import named_rows

    shares = {c: F.coalesce(F.avg(text.is_date_shaped(F.col(c).cast("string")).cast("double")), F.lit(0.0)) for c in columns}
    return named_rows(df, "column", {c: {"share": share, "date_like": share >= least} for c, share in shares.items()})


def _epoch(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def gaps_of(times: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct ``ts`` per key with ``idx``, ``n`` and ``gap`` seconds to the time before."""
    distinct = times.where(F.col("ts").isNotNull()).groupBy(*keys, "ts").agg(F.count("*").alias("copies"))
    indexed = with_row_index(distinct, ["ts"], keys)
    return block_columns(indexed, keys, 1, {"gap": _epoch(F.col("ts")) - F.lag(_epoch(F.col("ts"))).over(block_window(keys))})


def gap_stats(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Modal gap (seconds), gap ratio, consistency, start, end, rows and duplicate share per key."""
    gaps = gaps_of(df.select(*keys, F.col(ts).alias("ts")), keys)
    # The modal gap comes from counted gaps: a hot gap is combined before the shuffle.
    counted = gaps.where(F.col("gap").isNotNull()).groupBy(*keys, "gap").agg(F.count("*").alias("c"))
    modal = counted.groupBy(*keys).agg(
        F.min_by("gap", F.struct(-F.col("c"), F.col("gap"))).alias("modal_gap_seconds"),
        F.max("c").alias("_modal"), F.sum("c").alias("_gaps"),
    )
    ends = gaps.groupBy(*keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("distinct_times"), F.sum("copies").alias("rows")
    )
    joined = attach(ends, modal, keys)
    consistency = F.coalesce(F.col("_modal") / F.col("_gaps"), F.lit(1.0))
    return joined.select(
        *keys, "rows", "distinct_times", "modal_gap_seconds", (1 - consistency).alias("gap_ratio"),
        consistency.alias("consistency"), "start", "end",
        (1 - F.col("distinct_times") / F.col("rows")).alias("duplicate_ratio"),
        seasonality_hint(F.col("modal_gap_seconds")).alias("seasonality_hint"),
    )


def seasonality_hint(gap_seconds: Column) -> Column:
    return F.when(gap_seconds >= DAY, "daily-like").otherwise("sub-daily")


def ordering_score(df: DataFrame, ts: str, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of steps, in the given row order, on which time does not go back."""
    slim = df.where(F.col(ts).isNotNull()).select(*keys, *dict.fromkeys([*order_by, ts]))
    indexed = with_row_index(slim, order_by, keys)
    stepped = block_columns(indexed, keys, 1, {"_before": F.lag(ts).over(block_window(keys))})
    return stepped.groupBy(*keys).agg(F.coalesce(
        F.avg(F.when(F.col("_before").isNotNull(), (F.col(ts) >= F.col("_before")).cast("double"))), F.lit(1.0)
    ).alias("ordering"))


def time_candidates(df: DataFrame) -> DataFrame:
    """``column, ...`` facts of every column that could be the time axis, best first in ``rank_key`` order.

    Timestamps and date text qualify; numbers never do here. Candidates need 80 % readable rows, a positive modal gap
    and a span of two days.
    """
    readings = {c: ("timestamp", F.col(c).cast("timestamp_ntz")) for c in time_columns(df)}
    readings |= {c: ("text", text.parse_candidates(F.col(c))[i]) for c, i in date_text_columns(df).items()}
    if not readings:
        return df.sparkSession.createDataFrame([], "column string, kind string, name_score double, distinct_times long, parse_rate double, consistency double, gap_ratio double")
    # all candidates stacked, so that one keyed job indexes their times
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), r.alias("ts")) for c, (_, r) in readings.items()])).alias("x")).select("x.*")
    rows = df.count()
    kinds = F.create_map(*[F.lit(x) for c, (k, _) in readings.items() for x in (c, k)])
    every = gap_stats(stacked, "ts", ["column"]).withColumns({"parse_rate": F.col("rows") / max(rows, 1), "kind": kinds[F.col("column")]})
    return every.where(
        (F.col("parse_rate") > 0.8) & (F.col("modal_gap_seconds") > 0)
        & (_epoch(F.col("end")) - _epoch(F.col("start")) >= 2 * DAY) & ~names.non_time_column(F.col("column"))
    ).withColumn("name_score", names.time_name_score(F.col("column")))


def detect_time_axis(df: DataFrame) -> DataFrame:
    """The best candidate by (name score, distinct times, parse rate); no row when there is none."""
    return time_candidates(df).orderBy(
        F.desc("name_score"), F.desc("distinct_times"), F.desc("parse_rate"), F.asc("column")
    ).limit(1)


@dataclass(frozen=True)
class TimeAxis:
    """A time column and how to read it: ``timestamp``, ``text`` (dates as text) or ``year`` (numbers)."""

    column: str
    kind: str
    consistency: float | None = None
    gap_ratio: float = 0.0


def find_time_axis(df: DataFrame, column: str | None = None, years: bool = True) -> TimeAxis | None:
    """The given, else the detected, else the named time column or (with ``years``) the year column."""
    if column is None:
        found = detect_time_axis(df).first()
        if found:
            return TimeAxis(found["column"], found["kind"], found["consistency"], found["gap_ratio"])
        found = fallback_time_axis(df).first()
        if found is None or (found["source"] == "year" and not years):
            return None
        column = found["column"]
    if column in time_columns(df):
        return TimeAxis(column, "timestamp")
    return TimeAxis(column, "year" if column in numeric_columns(df) else "text")


def with_time(df: DataFrame, axis: TimeAxis) -> DataFrame:
    """The frame with the axis column as a timestamp; a year stays a number."""
    if axis.kind == "year":
        return df
    if axis.kind == "timestamp":
        return df.withColumn(axis.column, F.col(axis.column).cast("timestamp_ntz"))
    return read_time(df, axis, time_reading(df, axis))


def time_reading(df: DataFrame, axis: TimeAxis) -> int | None:
    """The number of the reading that suits the dates in text; None for other axes."""
    if axis.kind != "text":
        return None
    found = date_text_columns(df.select(axis.column)).get(axis.column)
    return best_reading(df, axis.column) if found is None else found


def read_time(df: DataFrame, axis: TimeAxis, reading: int | None) -> DataFrame:
    """The frame with the axis column read in the way that ``time_reading`` has found, in this or another table."""
    if axis.kind != "text":
        return with_time(df, axis)
    return df.withColumn(axis.column, text.parse_candidates(F.col(axis.column).cast("string"))[reading or 0])


def instants(df: DataFrame, axis: TimeAxis) -> DataFrame:
    """The frame with the axis column as a timestamp, years as their first instant."""
    if axis.kind != "year":
        return with_time(df, axis)
    return df.withColumn(axis.column, F.make_timestamp_ntz(F.col(axis.column).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def implicit_index(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``column, rows, unique_values, lowest, modal_step, is_index`` for integer columns counting up from near zero."""
    slim = with_row_index(df.select(*dict.fromkeys([*order_by, *columns])), order_by)
    w = block_window()
    stepped = block_columns(slim, (), 1, {f"_step{i}": F.col(c) - F.lag(c).over(w) for i, c in enumerate(columns)})
    from seriesloom.operators.frames import named_rows
    from seriesloom.operators.profile import distinct_counts

    steps = stepped.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_step{i}").cast("double").alias("step")) for i, c in enumerate(columns)
    ])).alias("s")).select("s.*").where("step is not null").groupBy("column", "step").agg(F.count("*").alias("c"))
    modal = steps.groupBy("column").agg(F.min_by("step", F.struct(-F.col("c"), F.col("step"))).alias("modal_step"))
    facts = named_rows(stepped, "column", {c: {
        "rows": F.count(c), "lowest": F.min(c).cast("double"), "integral": F.every(F.col(c) == F.round(F.col(c))),
        "rising": F.every(F.coalesce(F.col(f"_step{i}") >= 0, F.lit(True))),
    } for i, c in enumerate(columns)})
    counts = distinct_counts(df, columns).select("column", "unique_values")
    joined = facts.join(F.broadcast(modal), "column", "left").join(F.broadcast(counts), "column", "left")  # one row per column
    is_index = (
        (F.col("rows") >= 100) & F.col("integral") & F.col("rising") & (F.col("unique_values") > 0.95 * F.col("rows"))
        & (F.col("lowest") <= 10) & (F.abs(F.col("modal_step") - 1) < 0.01) & ~names.non_time_column(F.col("column"))
    )
    return joined.select("column", "rows", "unique_values", "lowest", "modal_step", F.coalesce(is_index, F.lit(False)).alias("is_index"))


def year_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, lowest, highest, unique_values, is_year`` for numeric columns named like a year."""
    from seriesloom.operators.frames import named_rows
    from seriesloom.operators.profile import distinct_counts

    columns = list(columns or numeric_columns(df))
    facts = named_rows(df, "column", {c: {
        "rows": F.count(c), "lowest": F.min(c).cast("double"), "highest": F.max(c).cast("double"),
        "integral": F.every(F.col(c) == F.round(F.col(c))),
    } for c in columns})
    counts = distinct_counts(df, columns).select("column", "unique_values")
    is_year = (
        names.year_name(F.col("column")) & (F.col("rows") >= 3) & F.col("integral") & (F.col("lowest") >= 1800)
        & (F.col("highest") <= 2200) & (F.col("unique_values") >= 2)
    )
    return facts.join(F.broadcast(counts), "column", "left").select(  # one row per column
        "column", "lowest", "highest", "unique_values", F.coalesce(is_year, F.lit(False)).alias("is_year")
    )


def fallback_time_axis(df: DataFrame) -> DataFrame:
    """First time-named timestamp or date-text column, else the year column with most values: ``column, source``."""
    dates = date_text_columns(df)
    named = [c for c in df.columns if c in time_columns(df) or c in dates]
    position = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    found = column_stats(df.select(*named)).where(
        names.date_name(F.col("column")) & (F.col("missing_percent") < 20)
    ).select("column", F.lit("named").alias("source"), F.lit(0).alias("_order"), position[F.col("column")].alias("_tie")) if named else None
    years = year_columns(df).where("is_year").select(
        "column", F.lit("year").alias("source"), F.lit(1).alias("_order"), (-F.col("unique_values")).cast("int").alias("_tie")
    ) if numeric_columns(df) else None
    parts = [p for p in (found, years) if p is not None]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, source string")
    return reduce(DataFrame.unionByName, parts).orderBy("_order", "_tie", "column").limit(1).select("column", "source")


def time_levels(gap_seconds: Column) -> Column:
    """Coarser levels worth aggregating to, finest first."""
    return (
        F.when(gap_seconds < DAY, F.array(F.lit("hour"), F.lit("day"), F.lit("week")))
        .when(gap_seconds < 28 * DAY, F.array(F.lit("day"), F.lit("week"), F.lit("month")))
        .otherwise(F.array(F.lit("month"), F.lit("quarter"), F.lit("year")))
    )


def time_rollup(series: DataFrame, levels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, level, period, points, total, mean``: a series (``ts``, ``value``) aggregated to several levels in one shuffle."""
    stacked = series.select(*keys, "value", F.explode(F.array(*[
        F.struct(F.lit(l).alias("level"), F.date_trunc(l, F.col("ts")).cast("timestamp_ntz").alias("period")) for l in levels
    ])).alias("p"))
    return stacked.groupBy(*keys, "p.level", "p.period").agg(
        F.count("*").alias("points"), F.sum("value").alias("total"), F.avg("value").alias("mean")
    )


def entity_columns(df: DataFrame, target: str | None = None, time_column: str | None = None, words: Sequence[str] = names.ENTITY_WORDS) -> DataFrame:
    """Up to two text columns named like an entity with 1 < distinct < 0.8 n, fewest values first."""
    texts = [c for c in text_columns(df) if c not in (target, time_column)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, unique_values long")
    return column_stats(df.select(*texts)).where(
        names.contains_any(names.spaced(F.col("column")), words)
        & (F.col("unique_values") > 1) & (F.col("unique_values") < 0.8 * F.col("rows"))
    ).orderBy("unique_values", "column").limit(2).select("column", "unique_values")


def future_timestamps(df: DataFrame, ts: str, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, step, ts``: last time plus modal gap times step."""
    facts = gap_stats(df, ts, keys)
    gap = F.coalesce("modal_gap_seconds", F.lit(float(DAY)))
    return facts.select(*keys, "end", gap.alias("_gap"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).select(
        *keys, "step", (F.col("end") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("_gap") * F.col("step")).cast("decimal(18,6)"))).alias("ts")
    )


def sort_series(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows ordered by keys and time: range partitions, each sorted, so writers keep the order without a global merge.

    Rows of one key and time are spread by a hash of the whole row.
    """
    order = [*keys, ts, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)
