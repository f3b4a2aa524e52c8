"""Features of a series: lags, rolling statistics, differences, calendar; and the supervised matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions import names
from seriesloom.operators.cleaning import TRAINING, EncodingPlan, category_codes, encode_auto, finite_rows, plan_encoding
from seriesloom.operators.frames import categorical_columns, numeric_columns
from seriesloom.operators.rowindex import block_columns, block_window, with_row_index

# Lags, rolling windows and differences offered as features.
LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
WINDOWS = (3, 6, 12, 24, 72, 168)
DIFFS = (1, 24)


def history_steps(longest: int) -> tuple[list[int], list[int], list[int]]:
    """Lags, windows and differences that fit the longest series."""
    lags = [k for k in LAGS if k <= max(1, longest // 3)]
    if not lags and longest > 1:
        lags = [1]
    windows = [w for w in WINDOWS if w <= max(3, longest // 2)]
    diffs = [d for d in DIFFS if longest > d]
    return lags, windows, diffs


def lag_columns(lags: Sequence[int], keys: Sequence[str] = (), value: str = "value") -> dict[str, Column]:
    w = block_window(keys)
    return {f"lag_{k}": F.lag(value, k).over(w) for k in lags}


def rolling_columns(windows: Sequence[int], keys: Sequence[str] = (), value: str = "value", include_current: bool = False) -> dict[str, Column]:
    """Mean and population deviation over the last w values, null with fewer than max(2, w/2) of them.

    The current value is left out unless ``include_current``: with it, the features would reveal the target.
    """
    end = 0 if include_current else -1
    out = {}
    for width in windows:
        frame = block_window(keys).rowsBetween(end - width + 1, end)
        enough = F.count(value).over(frame) >= max(2, width // 2)
        out[f"rolling_mean_{width}"] = F.when(enough, F.avg(value).over(frame))
        out[f"rolling_std_{width}"] = F.when(enough, F.stddev_pop(value).over(frame))
    return out


def diff_columns(diffs: Sequence[int], keys: Sequence[str] = (), value: str = "value", include_current: bool = False) -> dict[str, Column]:
    """Difference over d steps, ending at the value before the current one unless ``include_current``."""
    w = block_window(keys)
    now = F.col(value) if include_current else F.lag(value, 1).over(w)
    back = 0 if include_current else 1
    return {f"diff_{d}": now - F.lag(value, d + back).over(w) for d in diffs}


def lag_features(indexed: DataFrame, lags: Sequence[int], keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    return block_columns(indexed, keys, max(lags), lag_columns(lags, keys, value))


def rolling_features(indexed: DataFrame, windows: Sequence[int], keys: Sequence[str] = (), value: str = "value", include_current: bool = False) -> DataFrame:
    return block_columns(indexed, keys, max(windows), rolling_columns(windows, keys, value, include_current))


def diff_features(indexed: DataFrame, diffs: Sequence[int], keys: Sequence[str] = (), value: str = "value", include_current: bool = False) -> DataFrame:
    return block_columns(indexed, keys, max(diffs) + 1, diff_columns(diffs, keys, value, include_current))


def fallback_features(indexed: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Row position and, from eight rows on, the last three values; for tables without any other feature."""
    w = block_window(keys)
    return block_columns(indexed, keys, 3, {
        "row_position": F.col("idx").cast("double"),
        **{f"fallback_lag_{k}": F.when(F.col("n") >= 8, F.lag(value, k).over(w)) for k in (1, 2, 3)},
    })


def lag_sequence(indexed: DataFrame, steps: int = 24, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Add ``sequence``: the ``steps`` values before the row; rows without full history are removed."""
    frame = block_window(keys).rowsBetween(-steps, -1)
    return block_columns(indexed, keys, steps, {"sequence": F.collect_list(value).over(frame)}).where(F.size("sequence") == steps)


def calendar_columns(ts: str) -> dict[str, Column]:
    day = F.weekday(F.col(ts))
    return {
        "hour": F.hour(ts), "dayofweek": day, "month": F.month(ts), "dayofyear": F.dayofyear(ts),
        "is_weekend": F.when(day >= 5, 1.0).otherwise(0.0),
    }


def cyclical_columns(ts: str) -> dict[str, Column]:
    turn = lambda c, period: 2 * F.pi() * c / period
    hour, day, month = turn(F.hour(ts), 24.0), turn(F.weekday(F.col(ts)), 7.0), turn(F.month(ts), 12.0)
    return {
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(day), "dow_cos": F.cos(day),
        "month_sin": F.sin(month), "month_cos": F.cos(month),
    }


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(calendar_columns(ts))


def cyclical_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(cyclical_columns(ts))


def year_features(df: DataFrame, year: str, first_year: int | None = None) -> DataFrame:
    """Year, decade, distance from the first year and its place in a ten-year cycle; the input column stays as it is."""
    start = df.agg(F.min(year)).first()[0] if first_year is None else first_year
    trend = (F.col(year) - F.lit(start)).cast("double")
    turn = 2 * F.pi() * trend / 10.0
    return df.withColumns({
        "year_value": F.col(year).cast("double"), "decade": F.floor(F.col(year) / 10) * 10.0, "year_trend": trend,
        "year_sin": F.sin(turn), "year_cos": F.cos(turn),
    })


@dataclass
class FeaturePlan:
    target: str
    features: list[str] = field(default_factory=list)
    temporal: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)
    text_candidates: list[str] = field(default_factory=list)
    encoding: EncodingPlan = field(default_factory=EncodingPlan)
    tables: dict[str, DataFrame] = field(default_factory=dict)  # value, code of each column encoded by number
    lags: list[int] = field(default_factory=list)
    windows: list[int] = field(default_factory=list)
    diffs: list[int] = field(default_factory=list)
    first_year: float | None = None

    @property
    def reach(self) -> int:
        """How many rows before its own a row's features look at."""
        return max([*self.lags, *self.windows, *[d + 1 for d in self.diffs], 3 if "row_position" in self.features else 0])

    def as_rows(self, df: DataFrame) -> DataFrame:
        """``feature, role`` with roles temporal, encoded, numeric, blocked and text_candidate."""
        encoded = set(self.encoding.names)
        rows = [
            (f, "temporal" if f in self.temporal else "encoded" if f in encoded else "numeric") for f in self.features
        ] + [(c, "blocked") for c in self.blocked] + [(c, "text_candidate") for c in self.text_candidates]
        return df.sparkSession.createDataFrame(rows, "feature string, role string")


def split_features(df: DataFrame, columns: Sequence[str], target: str) -> tuple[list[str], list[str]]:
    """Safe and blocked feature names."""
    listed = [c for c in columns if c != target]
    if not listed:
        return [], []
    flags = df.sparkSession.createDataFrame([(c,) for c in listed], "column string").select(
        "column", names.safe_feature(F.col("column"), F.lit(target)).alias("ok")
    ).collect()  # one row per column
    ok = {r["column"] for r in flags if r["ok"]}
    return [c for c in listed if c in ok], [c for c in listed if c not in ok]


#: Columns that tell a row's place and part, never features.
CARRIED = ("idx", "n", TRAINING)


def temporal_features(
    indexed: DataFrame, plan: FeaturePlan, time_column: str, entities: Sequence[str] = (), year_axis: bool = False, include_current: bool = False,
) -> DataFrame:
    """Add the lags, rolling statistics, differences and calendar (or year) columns that the plan names."""
    added = lag_columns(plan.lags, entities, plan.target) | rolling_columns(plan.windows, entities, plan.target, include_current)
    added |= diff_columns(plan.diffs, entities, plan.target, include_current)
    out = block_columns(indexed, entities, max(plan.reach, 1), added)
    if year_axis:
        return year_features(out, time_column, plan.first_year)
    return out.withColumns(calendar_columns(time_column) | cyclical_columns(time_column))


def supervised_matrix(
    df: DataFrame, target: str, time_column: str | None = None, entities: Sequence[str] = (),
    order_by: Sequence[str] = (), include_current: bool = False, fit_where: Column | None = None,
    year_axis: bool = False,
) -> tuple[DataFrame, FeaturePlan]:
    """Target, features, ``idx`` (position within the whole ordered table) and the plan; incomplete rows are removed.

    Numeric columns pass through, text is encoded, and with a time column lags, rolling statistics, differences and calendar
    columns are added per entity. ``order_by`` must make the order unique. A frame with positions ``idx`` and ``n`` in that order is not
    sorted again.
    """
    fixed = {target, time_column, *order_by, *entities, *CARRIED}
    safe, blocked = split_features(df, [c for c in numeric_columns(df) if c not in fixed], target)
    plan = FeaturePlan(target, blocked=blocked)
    texts, _ = split_features(df, [c for c in categorical_columns(df) if c not in {target, time_column, *CARRIED}], target)
    fit = df.where(fit_where) if fit_where is not None else df
    plan.encoding = plan_encoding(fit, texts)
    plan.text_candidates = list(plan.encoding.codes)
    plan.tables = {c: category_codes(fit, c) for c in plan.encoding.codes}
    encoded = encode_auto(df, plan.encoding, tables=plan.tables)
    order = [time_column, *order_by] if time_column else list(order_by)
    indexed = encoded if {"idx", "n"} <= set(encoded.columns) else with_row_index(encoded, order, entities if time_column else ())
    if time_column:
        longest = indexed.agg(F.max("n")).first()[0] or 0
        plan.lags, plan.windows, plan.diffs = history_steps(longest)
        if year_axis:
            plan.first_year = indexed.agg(F.min(time_column)).first()[0]
        out = temporal_features(indexed, plan, time_column, entities, year_axis, include_current)
        plan.temporal = [c for c in out.columns if c not in indexed.columns]
    else:
        out = indexed
    plan.features = [*safe, *plan.encoding.names, *dict.fromkeys(plan.temporal)]
    if not plan.features:
        out = fallback_features(indexed, entities if time_column else (), target)
        plan.features = ["row_position"] + [f"fallback_lag_{k}" for k in (1, 2, 3)]
    out = out.withColumns({f: F.col(f).cast("double") for f in plan.features} | {target: F.col(target).cast("double")})
    kept = finite_rows(out, [target, *plan.features])
    extra = [c for c in dict.fromkeys([*entities, *order, "idx", "n"]) if c not in {target, *plan.features}]
    return kept.select(*extra, target, *plan.features), plan
