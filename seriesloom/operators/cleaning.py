"""Cleaning and encoding as plan and apply: one bounded job finds fill values, bounds and categories, one ``select`` uses them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions import names
from seriesloom.operators.frames import categorical_columns, col, nan_to_null, numeric_columns, text_columns
from seriesloom.operators.profile import column_stats, value_counts
from seriesloom.operators.quantiles import exact_quantiles, fences_from
from seriesloom.operators.rowindex import with_row_index
from seriesloom.operators.series import forward_backward_fill


def to_numeric(c: Column) -> Column:
    """Number or null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def unusable_columns(stats: DataFrame, target: str | None = None, time_column: str | None = None) -> DataFrame:
    """``column, reason`` of the columns to drop, from ``column_stats`` rows."""
    name, text_type = F.col("column"), F.col("data_type") == "string"
    leak = names.leakage_reason(name, F.lit(target)) if target else F.lit(None).cast("string")
    reason = (
        F.when(leak.isNotNull(), leak)
        .when(F.col("missing_percent") > 70, "mostly missing")
        .when(F.col("unique_values") <= 1, "constant")
        .when((F.col("unique_values") == F.col("rows")) & text_type, "one text value per row")
        .when(text_type & (F.col("unique_values") > F.greatest(F.lit(200), F.floor(F.col("rows") * 0.8))), "free text or identifier")
    )
    kept = [c for c in (target, time_column) if c]
    out = stats.where(~name.isin(kept)) if kept else stats
    return out.select("column", reason.alias("reason")).where("reason is not null")


def require_target(df: DataFrame, target: str) -> DataFrame:
    """Target as number; rows without it are removed."""
    return df.withColumn(target, to_numeric(col(target))).where(col(target).isNotNull())


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities count as missing; rows with any missing value in the columns are removed."""
    test = F.lit(True)
    for c in columns:
        value = col(c).cast("double")
        test = test & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return df.where(test)


def clip_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values capped to the interquartile fences."""
    fences = fences_from(exact_quantiles(df, columns, [0.25, 0.75]), k)
    return df.withColumns({
        c: F.when(col(c).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(low)), F.lit(high)))
        for c, (low, high, _) in fences.items()
    })


def clip_report(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """``column, low, high, capped_low, capped_high``."""
    from seriesloom.operators.frames import named_rows

    fences = fences_from(exact_quantiles(df, columns, [0.25, 0.75]), k)
    return named_rows(df, "column", {c: {
        "low": F.lit(low), "high": F.lit(high),
        "capped_low": F.count_if(col(c) < F.lit(low)), "capped_high": F.count_if(col(c) > F.lit(high)),
    } for c, (low, high, _) in fences.items()})


def clip_iqr_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """Every numeric column but the target, when it has more than eight values and a positive interquartile range."""
    columns = [c for c in numeric_columns(df) if c != target]
    sizes = df.agg(*[F.count(col(c)).alias(c) for c in columns]).first()
    fences = fences_from(exact_quantiles(df, columns, [0.25, 0.75]))
    return df.withColumns({
        c: F.when(col(c).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(low)), F.lit(high)))
        for c, (low, high, iqr) in fences.items() if iqr > 0 and sizes[c] > 8
    })


def impute_median(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    medians = exact_quantiles(df if fit is None else fit, columns, [0.5])
    return df.withColumns({
        c: F.coalesce(col(c).cast("double"), F.lit(v[0])) for c, v in medians.items() if v[0] is not None
    })


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column as text, ties to the smallest value."""
    return {r["column"]: r["value"] for r in value_counts(df, columns, 1).collect()}  # one row per column


def impute_mode(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({
        c: F.coalesce(col(c), F.lit(v).cast(types[c])) for c, v in modes(df if fit is None else fit, columns).items()
    })


def impute_constant(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit(value)) for c in columns})


def impute_categorical_auto(df: DataFrame, columns: Sequence[str] | None = None, fit: DataFrame | None = None) -> DataFrame:
    """Text columns: the mode when under 5 % are missing, else ``Unknown``."""
    columns = list(columns or categorical_columns(df))
    return fill_texts(df, text_fills(df if fit is None else fit, columns)) if columns else df


def text_fills(source: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """What stands for a missing text: the mode when under 5 % are missing, else ``Unknown``."""
    share = source.agg(*[F.avg(col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    rare = [c for c in columns if share[c] is not None and 0 < share[c] < 0.05]
    best = modes(source, rare) if rare else {}
    return {c: best.get(c, "Unknown") for c in columns}


def fill_texts(df: DataFrame, fills: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in fills.items()}) if fills else df


def fill_numbers(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in medians.items()}) if medians else df


def cap(df: DataFrame, fences: dict[str, Sequence[float]]) -> DataFrame:
    """Values of each column held between its (low, high)."""
    return df.withColumns({
        c: F.least(F.greatest(col(c).cast("double"), F.lit(bounds[0])), F.lit(bounds[1])) for c, bounds in fences.items()
    }) if fences else df


def flag_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": col(c).isNull().cast("double") for c in columns}) if columns else df


def missing_indicator(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.25, fit: DataFrame | None = None) -> DataFrame:
    """``<column>_was_missing`` as 0/1 for columns with at least a quarter missing."""
    columns = list(columns or numeric_columns(df))
    row = (df if fit is None else fit).agg(*[F.avg(col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return df.withColumns({
        f"{c}_was_missing": col(c).isNull().cast("double") for c in columns if row[c] is not None and row[c] >= share
    })


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: sorted distinct values numbered from 0. Numbering is distributed, so any number of values works."""
    distinct = df.where(col(column).isNotNull()).select(col(column).alias("value")).distinct()
    return with_row_index(distinct, ["value"]).select("value", F.col("idx").alias("code"))


def label_encode(
    df: DataFrame, column: str, into: str | None = None, fit: DataFrame | None = None, codes: DataFrame | None = None,
) -> DataFrame:
    """Replace a column by its code (of ``codes`` when given); missing stays missing, as do values not seen in ``fit``."""
    codes = category_codes(df if fit is None else fit, column) if codes is None else codes
    out = into or column
    joined = df.join(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")), col(column) == F.col("_value"), "left").drop("_value")
    if out == column:
        joined = joined.drop(column)
    return joined.withColumnRenamed("_code", out)


def onehot_values(df: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """Distinct values, sorted. More than ``limit`` is an error: every value becomes a column."""
    values = [r[0] for r in df.select(col(column).cast("string")).where(col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values; use codes instead")
    return sorted(values)


def onehot_encode(df: DataFrame, column: str, prefix: str | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per value; the column itself is dropped."""
    values = onehot_values(df, column) if values is None else values
    name = prefix or column
    return df.withColumns({
        f"{name}_{v}": F.coalesce((col(column).cast("string") == v).cast("double"), F.lit(0.0)) for v in values
    }).drop(column)


@dataclass
class EncodingPlan:
    onehot: dict[str, list[str]] = field(default_factory=dict)
    codes: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [f"onehot_{c}_{v}" for c, vs in self.onehot.items() for v in vs] + [f"enc_{c}" for c in self.codes]


def plan_encoding(df: DataFrame, columns: Sequence[str] | None = None) -> EncodingPlan:
    """One-hot for few values (at most min(24, max(4, 5 % of rows))), codes for more, nothing for a single value or for nested columns.

    Every value gets its column, and ``Unknown`` one of its own where values are missing.
    """
    columns = list(columns if columns is not None else categorical_columns(df))
    plan = EncodingPlan()
    if not columns:
        return plan
    counts = column_stats(df.select(*map(col, columns))).collect()  # one row per column
    for c in columns:
        row = next(r for r in counts if r["column"] == c)
        unique, rows = row["unique_values"], row["rows"]
        if row["data_type"] not in ("string", "boolean") or unique <= 1:
            plan.ignored.append(c)
        elif unique <= min(24, max(4, int(rows * 0.05))):
            values = onehot_values(df, c)
            if row["missing_percent"] > 0:
                values = sorted({*values, "Unknown"})
            plan.onehot[c] = values
        else:
            plan.codes.append(c)
    return plan


def encode_auto(df: DataFrame, plan: EncodingPlan, fit: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add the encoded columns; the text columns stay. ``tables`` holds the codes of columns when they are known already."""
    out = df.withColumns({
        f"onehot_{c}_{v}": (F.coalesce(col(c).cast("string"), F.lit("Unknown")) == v).cast("double")
        for c, vs in plan.onehot.items() for v in vs
    }) if plan.onehot else df
    for c in plan.codes:
        out = label_encode(out, c, into=f"enc_{c}", fit=df if fit is None else fit, codes=(tables or {}).get(c))
        out = out.withColumn(f"enc_{c}", F.col(f"enc_{c}").cast("double"))
    return out


def standard_scale(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    row = (df if fit is None else fit).agg(*[
        x for c in columns for x in (F.avg(col(c)).alias(f"m_{c}"), F.stddev_pop(col(c)).alias(f"s_{c}"))
    ]).first()
    return df.withColumns({c: (col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns})


#: Carries which rows belong to the training part through cleaning and features.
TRAINING = "_training"


@dataclass
class CleaningReport:
    original_rows: int = 0
    rows: int = 0
    dropped: dict[str, str] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)  # of every numeric feature, missing somewhere or not
    fences: dict[str, tuple[float, float]] = field(default_factory=dict)
    fills: dict[str, str] = field(default_factory=dict)

    def as_rows(self, df: DataFrame) -> DataFrame:
        """``position, step``."""
        return df.sparkSession.createDataFrame(list(enumerate(self.steps, 1)), "position int, step string")


def prepare_frame(
    df: DataFrame, target: str, time_column: str | None = None, entities: Sequence[str] = (),
    order_by: Sequence[str] = (), fit_where: Column | None = None,
) -> tuple[DataFrame, CleaningReport]:
    """Drop unusable columns, require the target, fill gaps, cap outliers; returns the frame and the steps taken.

    With a time column gaps are filled forward per entity (never from later rows), what remains by the median. The time column itself
    is left as it is. ``order_by`` breaks ties in time. ``fit_where`` selects the rows that drops, medians, modes and fences are taken
    from (all rows when missing). A frame that already has positions ``idx`` and ``n`` in that order is not sorted again.
    """
    report = CleaningReport()
    frame = nan_to_null(df)
    placed = {"idx", "n"} <= set(df.columns)
    carried = [c for c in ("idx", "n", TRAINING) if c in df.columns]
    drops = {r["column"]: r["reason"] for r in unusable_columns(column_stats(frame if fit_where is None else frame.where(fit_where)), target, time_column).collect()}
    drops = {c: r for c, r in drops.items() if c not in {*order_by, *carried}}
    report.dropped = drops
    if drops:
        frame = frame.drop(*drops)
        report.steps.append(f"dropped {len(drops)} column(s): " + ", ".join(sorted(drops)))
    report.original_rows = df.count()
    frame = require_target(frame, target)
    entities = [e for e in entities if e in frame.columns]
    numeric = [c for c in numeric_columns(frame) if c not in {*order_by, *carried, time_column}]
    counts = frame.agg(F.count("*").alias("rows"), *[F.count_if(col(c).isNull()).alias(c) for c in frame.columns]).first()
    report.rows = counts["rows"]
    gaps = [c for c in numeric if counts[c] and c != target]
    flagged = [c for c in gaps if counts[c] / max(report.rows, 1) >= 0.25]
    if flagged:
        frame = flag_missing(frame, flagged)
        report.indicators = [f"{c}_was_missing" for c in flagged]
        report.steps.append("added indicators: " + ", ".join(report.indicators))
    if gaps and time_column:
        indexed = frame if placed else with_row_index(frame, [time_column, *order_by], entities)
        frame = forward_backward_fill(indexed, gaps, entities, backward=False)
        frame = frame if placed else frame.drop("idx", "n")
    if gaps:
        fit = frame.where(fit_where) if fit_where is not None else frame
        report.medians = {c: v[0] for c, v in exact_quantiles(fit, gaps, [0.5]).items() if v[0] is not None}
        frame = fill_numbers(frame, report.medians)
        report.steps.append(("forward fill, then median: " if time_column else "median: ") + ", ".join(gaps))
    features = [c for c in numeric if c != target]
    fit = frame.where(fit_where) if fit_where is not None else frame
    quartiles = exact_quantiles(fit, features, [0.25, 0.5, 0.75]) if features else {}
    report.medians = {c: v[1] for c, v in quartiles.items() if v[1] is not None} | report.medians
    fences = fences_from(quartiles) if report.rows > 8 else {}
    report.fences = {c: (low, high) for c, (low, high, width) in fences.items() if width > 0}
    if report.fences:
        frame = cap(frame, report.fences)
        report.steps.append("capped to interquartile fences: " + ", ".join(report.fences))
    texts = [c for c in text_columns(frame) if counts[c] and c != time_column]
    if texts:
        report.fills = text_fills(frame.where(fit_where) if fit_where is not None else frame, texts)
        frame = fill_texts(frame, report.fills)
        report.steps.append("filled text: " + ", ".join(texts))
    return frame, report

