"""Steps by name, so that a job can be written as a list of (name, arguments)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame

from seriesloom.operators import cleaning, features, profile, tables

STEPS: dict[str, Callable[..., DataFrame]] = {
    "drop_columns": lambda df, columns: tables.drop_columns(df, columns)[0],
    "dedupe_rows": profile.dedupe_rows,
    "require_target": cleaning.require_target,
    "finite_rows": cleaning.finite_rows,
    "clip_iqr": cleaning.clip_iqr,
    "clip_iqr_features": cleaning.clip_iqr_features,
    "impute_median": cleaning.impute_median,
    "impute_mode": cleaning.impute_mode,
    "impute_constant": cleaning.impute_constant,
    "impute_categorical_auto": cleaning.impute_categorical_auto,
    "missing_indicator": cleaning.missing_indicator,
    "label_encode": cleaning.label_encode,
    "onehot_encode": cleaning.onehot_encode,
    "standard_scale": cleaning.standard_scale,
    "calendar_features": features.calendar_features,
    "cyclical_features": features.cyclical_features,
    "column_profile": profile.column_profile,
    "missing_report": profile.missing_report,
    "describe_numeric": profile.describe_numeric,
    "value_counts": profile.value_counts,
    "anomaly_report": profile.anomaly_report,
}


def register_step(name: str, step: Callable[..., DataFrame]) -> None:
    STEPS[name] = step


def run_step(df: DataFrame, name: str, **arguments: object) -> DataFrame:
    if name not in STEPS:
        raise KeyError(f"unknown step {name}; known: {', '.join(sorted(STEPS))}")
    return STEPS[name](df, **arguments)


def run_steps(df: DataFrame, steps: Iterable[tuple[str, Mapping[str, object]]]) -> DataFrame:
    for name, arguments in steps:
        df = run_step(df, name, **arguments)
    return df
