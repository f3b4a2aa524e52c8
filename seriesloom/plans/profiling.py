"""The full profile of a dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seriesloom.functions import domains, names, text
from seriesloom.operators import associations, profile, scoring, series, timeaxis
from seriesloom.operators.frames import attach
from seriesloom.operators.rowindex import with_row_index
from seriesloom.sources.evidence import evidence_chunks, evidence_id, write_evidence


@dataclass
class Profile:
    dataset: str
    target: str | None
    time_column: str | None
    columns: DataFrame
    summary: DataFrame
    roles: DataFrame
    metrics: DataFrame | None
    forecastability: DataFrame | None
    behavior: DataFrame
    quality: DataFrame
    signals: DataFrame | None
    redundant: DataFrame
    strategy: DataFrame
    facts: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        named = {
            "dataset_summary": self.summary, "quality": self.quality, "forecastability": self.forecastability,
            "strategy": self.strategy, "feature_signals": self.signals, "behavior": self.behavior,
            "column_roles": self.roles, "column_profile": self.columns, "redundant_pairs": self.redundant, "series_metrics": self.metrics,
            "meaning": self.facts,
        }
        return {k: v for k, v in named.items() if v is not None}


def series_facts(df: DataFrame, ts: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Behaviour metrics, cadence and score of the target, per key."""
    metrics = series.series_metrics(series.indexed_series(df, ts, target, keys), keys)
    gaps = timeaxis.gap_stats(df, ts, keys)
    facts = scoring.attach_interval_facts(metrics, gaps, keys)
    return facts.withColumn("score", F.when(F.col("n") < 24, 25.0).otherwise(scoring.series_score()))


def profile_dataset(
    df: DataFrame, dataset: str, order_by: Sequence[str], target: str | None = None, keys: Sequence[str] = (),
    path: str | None = None,
) -> Profile:
    """All sections. ``order_by`` numbers the rows of a table without time axis and breaks ties in time.

    A date in text is read as a timestamp first. Signals and redundant pairs are complete; rank_signals and the like cut them for
    display. With ``path`` the sections are stored there as evidence.
    """
    columns = profile.column_profile(df, dataset)
    axis = timeaxis.find_time_axis(df, years=False)
    ts = axis.column if axis else None
    df = timeaxis.with_time(df, axis) if axis else df
    if target is None:
        best = scoring.recommend_target(df).first()
        target = best["column"] if best else None
    summary = profile.dataset_summary(df, ts, target)
    roles = scoring.column_roles(columns, target, ts)
    quality = scoring.quality_report(df, target, axis.consistency if axis else None, axis.gap_ratio if axis else 0.0)
    numeric, texts = associations.usable_features(df, target) if target else ([], [])
    signals, metrics, forecastability = None, None, None
    order = [ts, *order_by] if ts else list(order_by)
    if target:
        indexed = with_row_index(df.select(*dict.fromkeys([*order, target, *numeric])), order)
        parts = [associations.predictive_signals(indexed, target, numeric)] if numeric else []
        parts += [associations.eta_squared(df, target, texts)] if texts else []
        signals = reduce(DataFrame.unionByName, parts) if parts else None
    if target and ts:
        facts = series_facts(df, ts, target, keys)
        metrics = facts
        forecastability = scoring.forecastability_series(facts, keys)
        behavior = scoring.temporal_behavior(facts, keys)
        strategy = scoring.recommend_strategy(facts, keys)
    else:
        behavior = scoring.cross_sectional_shape(df, target) if target else summary.select("rows")
        if target:
            plain = with_row_index(df.select(*order_by, F.col(target).cast("double").alias("value")), order_by)
            noise = series.noise_ratio(plain)
            features = max(len(numeric), 0)
            facts = noise.select(
                "noise_ratio", F.lit(df.count()).cast("long").alias("n"), F.lit(0.0).alias("seasonality"), F.lit(0.0).alias("consistency"),
            ).withColumn("score", scoring.forecastability_table(F.col("n"), F.lit(float(features)), F.col("noise_ratio")))
            strategy = scoring.recommend_strategy(facts, timed=False)
        else:
            facts = summary.select(F.col("rows").alias("n"))
            strategy = summary.select(F.lit(None).cast("string").alias("family"))
    redundant = associations.redundant_pairs(associations.corr_matrix(df), first=None)
    words = F.lit(" ".join([dataset, *df.columns]))
    domain = domains.domain_by_tokens(words)
    meaning = summary.select(
        F.lit(dataset).alias("dataset"), text.title_from_id(F.lit(dataset)).alias("title"), "rows", "columns", "missing_percent",
        "target", F.lit(ts).alias("time_column"), domain.alias("domain"), domains.use_case(domain, ts is not None).alias("use_case"),
        F.lit("time-series" if ts else "cross-sectional").alias("dataset_type"),
    )
    found = Profile(dataset, target, ts, columns, summary, roles, metrics, forecastability, behavior, quality, signals, redundant, strategy, meaning)
    if path:
        chunks = evidence_chunks(found.sections())
        whole = chunks.agg(F.max(F.when(F.col("kind") == "dataset_summary", F.col("text"))).alias("content"))
        keyed = attach(chunks, whole.select(evidence_id(F.lit(dataset), F.col("content")).alias("evidence_id")))
        write_evidence(keyed.select("evidence_id", "kind", "text"), path)
    return found


def leakage_warnings(df: DataFrame, target: str) -> DataFrame:
    """``column`` of names that hint at future values of the target."""
    return profile.column_stats(df).where(names.leakage_warning(F.col("column"), F.lit(target))).select("column")
