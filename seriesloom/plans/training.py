"""Profile facts to model: choose, clean, build features, train, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from seriesloom.operators import autoregression, cleaning, features, scoring, timeaxis
from seriesloom.operators.associations import eta_squared, predictive_signals, usable_features
from seriesloom.operators.frames import numeric_columns
from seriesloom.operators.rowindex import with_row_index
from seriesloom.operators.series import indexed_series, noise_ratio
from seriesloom.operators.timeaxis import TimeAxis, instants
from seriesloom.operators.trees import SHORTEST, TreeResult, train_trees
from seriesloom.operators.validation import persistence_baseline, regression_metrics, split_index
from seriesloom.plans.profiling import series_facts
from seriesloom.plans.rawscoring import Scorer, scorer_of, write_scorer
from seriesloom.session import cut_lineage
from seriesloom.sources.models import write_model
from seriesloom.sources.runlog import append_run

# The kernel and sequence models of the rule tables are trained as these ensembles.
FAMILIES = {"RandomForest": "forest", "SVM": "forest", "XGBoost": "boosting", "LSTM": "boosting"}


@dataclass
class TrainingRun:
    model: str
    target: str
    time_column: str | None
    metrics: DataFrame
    baseline: DataFrame
    steps: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    trees: TreeResult | None = None
    keys: list[str] = field(default_factory=list)
    matrix: DataFrame | None = None
    scorer: Scorer | None = None

    def report(self) -> DataFrame:
        """``model, target, candidate, rows, mae, rmse, mape, r2, mase``: chosen model next to the last-value baseline, per key for
        autoregression."""
        head = [*self.keys, F.lit(self.model).alias("model"), F.lit(self.target).alias("target")]
        numbers = ["rows", "mae", "rmse", "mape", "r2", "mase"]
        return self.metrics.select(*head, F.lit("model").alias("candidate"), *numbers).unionByName(
            self.baseline.select(*head, F.lit("last_value").alias("candidate"), *numbers))


def choose_model(df: DataFrame, axis: TimeAxis | None, target: str, order_by: Sequence[str], override: str = "auto", entities: Sequence[str] = ()) -> str:
    """The model of the rule tables for the table's own facts; with entities the one that most of them get."""
    if override != "auto":
        return override
    numeric, texts = usable_features(df, target)
    quality = scoring.quality_report(df, target, axis.consistency if axis else None, axis.gap_ratio if axis else 0.0).first()
    order = [*([axis.column] if axis else []), *order_by]
    indexed = with_row_index(df.select(*dict.fromkeys([*order, target, *numeric])), order)
    if axis is None:
        noise = noise_ratio(indexed.withColumn("value", F.col(target).cast("double"))).first()["noise_ratio"]
        facts = df.agg(F.count(target).alias("n")).withColumns({"noise_ratio": F.lit(noise), "score": scoring.forecastability_table(F.col("n"), F.lit(float(len(numeric))), F.lit(noise))})
        return scoring.select_model(facts.withColumns({c: F.lit(0.0) for c in ("seasonality", "consistency", "trust", "strong_signals", "numeric_columns")}).withColumn("family", F.lit("")), timed=False).first()["model"]
    signals = [predictive_signals(indexed, target, numeric)] if numeric else []
    signals += [eta_squared(df, target, texts)] if texts else []
    strong = sum(s.where("role = 'strong_driver'").count() for s in signals)
    facts = series_facts(instants(df, axis), axis.column, target, entities)
    kept = [*entities, "n", "score", "seasonality", "noise_ratio", "consistency"]
    ready = scoring.recommend_strategy(facts, kept).withColumns({
        "trust": F.lit(float(quality["trust_score"])), "strong_signals": F.lit(strong), "numeric_columns": F.lit(len(numeric_columns(df))),
    })
    models = scoring.select_model(ready, entities).groupBy("model").agg(F.count("*").alias("series"))
    return models.orderBy(F.desc("series"), "model").first()["model"]


def last_value_run(df: DataFrame, target: str, order: Sequence[str], keys: Sequence[str], time_column: str | None, steps: list[str]) -> TrainingRun:
    """The result for tables too short for trees: the last training value stands for every later row."""
    slim = df.where(F.col(target).isNotNull()).select(*dict.fromkeys([*keys, *order]), F.col(target).cast("double").alias("value"))
    tests = persistence_baseline(with_row_index(slim, order, keys), keys)
    scored = regression_metrics(tests.withColumns({"actual": F.col("value"), "predicted": F.col("baseline")}), keys)
    return TrainingRun("LastValue", target, time_column, scored, scored, steps, keys=list(keys))


def train_and_report(
    df: DataFrame, target: str, order_by: Sequence[str], time_column: str | None = None, entities: Sequence[str] = (),
    model: str = "auto", grid: Sequence[dict] | None = None, folds: int | None = None, dataset: str = "table", path: str | None = None,
) -> TrainingRun:
    """The whole way from a table to a scored model. ``order_by`` makes the row order unique.

    The table is ordered and split once, before anything is fitted: drops, fill values, fences and categories come from the
    training rows only. The time column, given or found, is read as timestamp, date text or year. Fewer than 20 complete rows give the
    last-value result. With ``path`` a row of the run log is stored below it, and below ``path/model`` the model with all that
    ``rawscoring.score_rows`` needs to apply it to raw rows.
    """
    axis = timeaxis.find_time_axis(df, time_column)
    column, keys = (axis.column, list(entities)) if axis else (None, [])
    reading = timeaxis.time_reading(df, axis) if axis else None
    frame = timeaxis.read_time(df, axis, reading) if axis else df
    chosen = choose_model(frame, axis, target, order_by, model, keys)
    if chosen == "ARIMA" and axis:
        scored = autoregression.train_ar(indexed_series(instants(frame, axis), column, target, keys), keys)
        best = scored.where("best")
        run = TrainingRun(chosen, target, column, best, scored.where("candidate = 'last_value'"), ["autoregression on differences"], keys=keys)
        return _kept(run, dataset, path)
    order = [*([column] if column else []), *order_by]
    placed = with_row_index(cleaning.require_target(frame, target), order, keys)
    placed = placed.withColumn(cleaning.TRAINING, F.col("idx") < split_index(F.col("n")))
    fit = F.col(cleaning.TRAINING)
    clean, report = cleaning.prepare_frame(placed, target, column, keys, order_by, fit)
    matrix, plan = features.supervised_matrix(clean, target, column, keys, order_by, fit_where=fit, year_axis=axis is not None and axis.kind == "year")
    matrix = cut_lineage(matrix)
    if matrix.count() < SHORTEST:
        return _kept(last_value_run(frame, target, order, keys, column, report.steps), dataset, path)
    result = train_trees(matrix, target, plan.features, order, keys, FAMILIES.get(chosen, "forest"), grid, folds or (4 if axis else 3))
    scorer = scorer_of(df, clean, target, axis, reading, keys, order_by, report, plan)
    run = TrainingRun(chosen, target, column, result.metrics, result.baseline, report.steps, plan.features, result, matrix=matrix, scorer=scorer)
    return _kept(run, dataset, path)


def _kept(run: TrainingRun, dataset: str, path: str | None) -> TrainingRun:
    """Store the fitted stages and append the run to the log, when a path is given."""
    if path is None:
        return run
    report = run.report()
    head = {"run_id": F.uuid(), "dataset": F.lit(dataset), "ts": F.current_timestamp().cast("timestamp_ntz"), "features": F.lit(len(run.features))}
    rows = report.where("candidate = 'model'").withColumns(head)
    append_run(rows.select("run_id", "dataset", "model", "mae", "rmse", "mape", "r2", "mase", "rows", "features", "target", "ts"), f"{path}/runs")
    if run.trees is not None:
        meta = run.metrics.select(F.lit(run.model).alias("model"), F.lit(run.target).alias("target"), F.to_json(F.map_from_arrays(
            F.array(*[F.lit(k) for k in run.trees.params]), F.array(*[F.lit(float(v)) for v in run.trees.params.values()]))).alias("params"),
            F.array(*[F.lit(f) for f in run.features]).alias("features"), "rows", "mae", "rmse", "r2")
        write_model(run.trees.model, meta, f"{path}/model")
        write_scorer(run.scorer, f"{path}/model")
    return run
