"""Column profiles and table-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from seriesloom.functions import stats, text
from seriesloom.operators.frames import categorical_columns, col, named_rows, nan_to_null, numeric_columns, text_columns, time_columns
from seriesloom.operators.quantiles import exact_quantiles, fences_from


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> list[DataFrame]:
    """Rows ``column, value, rows`` for every distinct non-null value, one frame per type family.

    Columns of one family are stacked and counted together: one shuffle of already combined counts per family, with the
    values hashed in their own type. Nested and binary columns form a family per type, maps as their sorted entries; what holds a map inside, which
    has no order, is not counted.
    """
    families: dict[str, list[str]] = {}
    for f in df.schema:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, T.IntegralType):
            family = "bigint"
        elif isinstance(f.dataType, T.DecimalType):  # all digits, and as many behind the point as the column has
            family = f"decimal(38,{f.dataType.scale})"
        elif isinstance(f.dataType, T.NumericType):
            family = "double"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            family = "timestamp_ntz"
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            family = "string"
        elif is_counted(f.dataType):
            family = f.dataType.simpleString()
        else:
            continue
        families.setdefault(family, []).append(f.name)
    frames = []
    value = lambda c, family: F.array_sort(F.map_entries(col(c))) if family.startswith("map<") else col(c).cast(family)
    for family, names in families.items():
        # A column goes by its place while rows are stacked and counted: a flat array of values costs far less than structs with names.
        stacked = df.select(F.posexplode(F.array(*[value(c, family) for c in names])).alias("_place", "value")).where(F.col("value").isNotNull())
        counted = stacked.groupBy("_place", "value").agg(F.count("*").alias("rows"))
        frames.append(counted.select(F.array(*[F.lit(c) for c in names])[F.col("_place")].alias("column"), "value", "rows"))
    return frames


def is_counted(kind: T.DataType) -> bool:
    """Whether ``value_frequencies`` tells the values of a type apart."""
    name = kind.simpleString()
    return not ("map<" in name[1:] or "variant" in name or "interval" in name)


def distinct_of(frequencies: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        f.groupBy("column").agg(
            F.count("value").alias("unique_values"), F.sum("rows").alias("total"), F.max("rows").alias("dominant_rows")
        ) for f in frequencies
    ])


def _ranked_from(frequencies: list[DataFrame], k: int) -> DataFrame:
    """The rank filter is applied by Spark inside each task before the shuffle, so k rows per column and task travel."""
    order = Window.partitionBy("column").orderBy(F.desc("rows"), F.asc("value"))
    return reduce(DataFrame.unionByName, [
        f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("column", "rank", F.col("value").cast("string").alias("value"), "rows") for f in frequencies
    ])


def tops_of(frequencies: list[DataFrame], k: int) -> DataFrame:
    return _ranked_from(frequencies, k).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("top_values")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, unique_values, total, dominant_rows`` per column holding any value."""
    return distinct_of(value_frequencies(df, columns))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column: ``column, rank, value, rows`` (ties by value)."""
    return _ranked_from(value_frequencies(df, columns), k)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """``column, top_values``: the k most frequent values as strings, most frequent first."""
    return tops_of(value_frequencies(df, columns), k)


def date_text_columns(df: DataFrame) -> dict[str, int]:
    """Text columns that hold dates, with the number of the reading that parses most rows.

    A column qualifies when at least 60 % of its values are shaped like a date and more than 80 % of its rows parse.
    """
    columns = text_columns(df)
    if not columns:
        return {}
    shaped = df.agg(*[F.avg(text.is_date_shaped(col(c)).cast("double")).alias(c) for c in columns]).first()
    likely = [c for c in columns if (shaped[c] or 0.0) >= 0.6]
    if not likely:
        return {}
    row = df.agg(F.count("*").alias("n"), *[
        F.struct(*[F.count(p).alias(f"p{i}") for i, p in enumerate(text.parse_candidates(col(c)))]).alias(c)
        for c in likely
    ]).first()
    found = {}
    for c in likely:
        readings = [i for i in range(1 + len(text.MONTH_FORMATS)) if row[c][f"p{i}"] > 0.8 * row["n"]]
        if readings:
            found[c] = readings[0]
    return found


def column_stats(df: DataFrame) -> DataFrame:
    """``column, data_type, rows, missing_percent, unique_values`` for every column; the input of the name and drop rules.

    ``unique_values`` is null for a type that is not counted. NaN is missing.
    """
    df = nan_to_null(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    base = named_rows(df, "column", {
        c: {
            "data_type": F.lit(types[c]),
            "rows": F.count("*"),
            "missing_percent": F.coalesce(F.avg(col(c).isNull().cast("double")) * 100, F.lit(0.0)),
        } for c in df.columns
    })
    counts = distinct_counts(df).select("column", "unique_values")
    known = [f.name for f in df.schema if is_counted(f.dataType)]
    return base.join(F.broadcast(counts), "column", "left").withColumn(  # one row per column
        "unique_values", F.coalesce("unique_values", F.when(F.col("column").isin(known), F.lit(0).cast("long")))
    )


def kind_rule(date_text: Column, numeric: Column, temporal: Column, unique_values: Column, filled: Column) -> Column:
    """numeric / datetime / text / categorical from column facts."""
    limit = F.least(F.lit(500.0), F.greatest(F.lit(50.0), F.greatest(filled, F.lit(1)) * 0.5))
    return (
        F.when(temporal | date_text, "datetime").when(numeric, "numeric")
        .when(unique_values > limit, "text").otherwise("categorical")
    )


def infer_kind(df: DataFrame) -> DataFrame:
    """``column, kind, unique_values, filled``."""
    dates = date_text_columns(df)
    stats_ = column_stats(df)
    filled = F.col("rows") - F.round(F.col("rows") * F.col("missing_percent") / 100)
    return stats_.select(
        "column",
        kind_rule(
            F.col("column").isin(list(dates)), F.col("column").isin(numeric_columns(df)),
            F.col("column").isin(time_columns(df)), F.col("unique_values"), filled,
        ).alias("kind"),
        "unique_values",
    )


def column_profile(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """One row per column: kind, missing share, distinct values, moments, median, outlier share, mean words, top values.

    NaN is missing.
    """
    df = nan_to_null(df)
    numeric, temporal, strings = numeric_columns(df), time_columns(df), text_columns(df)
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    fences = fences_from(quartiles)
    dates = date_text_columns(df)
    null = F.lit(None).cast("double")
    facts = {}
    for c in df.columns:
        v = col(c).cast("double") if c in numeric else null
        low, high, iqr = fences.get(c, (None, None, 0.0))
        outside = (v < F.lit(low)) | (v > F.lit(high)) if iqr else F.lit(False)
        facts[c] = {
            "rows": F.count("*"),
            "min": F.min(v) if c in numeric else null,
            "max": F.max(v) if c in numeric else null,
            "mean": F.avg(v) if c in numeric else null,
            "median": F.lit(quartiles[c][1]).cast("double") if c in numeric else null,
            "std": F.sqrt(F.var_pop(v)) if c in numeric else null,
            "variance": F.var_pop(v) if c in numeric else null,
            "outlier_percent": stats.percent(F.count_if(outside), F.count(col(c))) if c in numeric else null,
            "words": F.avg(text.word_count(col(c))) if c in strings else null,
        }
    wide = named_rows(df, "column", facts)
    frequencies = value_frequencies(df)  # shared: both uses read the same shuffle
    counts = distinct_of(frequencies).select("column", "unique_values", F.col("total").alias("filled"))
    tops = tops_of(frequencies, 3)
    # Both joined sides have one row per column.
    joined = wide.join(F.broadcast(counts), "column", "left").join(F.broadcast(tops), "column", "left")
    joined = joined.withColumn("filled", F.coalesce("filled", F.lit(0)))
    kind = kind_rule(
        F.col("column").isin(list(dates)), F.col("column").isin(numeric), F.col("column").isin(temporal),
        F.coalesce("unique_values", F.lit(0)), F.col("filled"),
    )
    return joined.select(
        F.lit(dataset).alias("dataset"), "column", kind.alias("kind"),
        F.when(F.col("rows") > 0, (F.col("rows") - F.col("filled")) * 100.0 / F.col("rows")).otherwise(0.0)
        .alias("missing_percent"),
        F.coalesce("unique_values", F.lit(0)).cast("long").alias("unique_values"),
        "min", "max", "mean", "median", "std", "variance", "outlier_percent",
        F.when(kind == "text", F.col("words")).alias("word_count_mean"),
        F.coalesce("top_values", F.array().cast("array<string>")).alias("top_values"),
    )


def dataset_summary(df: DataFrame, time_column: str | None = None, target: str | None = None) -> DataFrame:
    """Rows, columns, share of missing cells and time range. NaN is missing."""
    df = nan_to_null(df)
    missing = reduce(lambda a, b: a + b, [F.count_if(col(c).isNull()) for c in df.columns])
    when = col(time_column) if time_column else F.lit(None).cast("timestamp_ntz")
    return df.agg(
        F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        (missing * 100.0 / F.greatest(F.count("*") * len(df.columns), F.lit(1))).alias("missing_percent"),
        F.min(when).alias("time_start"), F.max(when).alias("time_end"),
    ).withColumn("target", F.lit(target).cast("string"))


def dataset_overview(df: DataFrame, order_by: Sequence[str], samples: int = 3) -> DataFrame:
    """Column facts with the first few values in the given order."""
    kinds = {c: "numeric" for c in numeric_columns(df)} | {c: "datetime" for c in time_columns(df)}
    first = df.orderBy(*order_by).limit(samples).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.struct(*order_by).alias("at"), col(c).cast("string").alias("v"))
        for c in df.columns
    ])).alias("s")).select("s.*")
    first = first.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("sample_values")
    )
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kinds.get(c, "categorical"))])
    return column_stats(df).join(F.broadcast(first), "column", "left").select(  # one row per column
        "column", kind[F.col("column")].alias("kind"), "rows", "missing_percent", "unique_values", "sample_values"
    )


def type_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("kind").agg(F.count("*").alias("columns"))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: ``column, missing, percent, severity``. NaN is missing."""
    df = nan_to_null(df)
    counts = named_rows(df, "column", {
        c: {"rows": F.count("*"), "missing": F.count_if(col(c).isNull())} for c in df.columns
    })
    share = F.col("missing") / F.col("rows")
    return counts.where(F.col("missing") > 0).select(
        "column", "missing", (share * 100).alias("percent"),
        F.when(share > 0.3, "high").when(share > 0.05, "medium").otherwise("low").alias("severity"),
    )


def missing_by_stratum(df: DataFrame, target: str) -> DataFrame:
    """Missing share among rows above the third quartile of the target and among the others."""
    q3 = exact_quantiles(df, [target], [0.75])[target][0]
    missing = reduce(lambda a, b: a + b, [col(c).isNull().cast("double") for c in df.columns]) / len(df.columns)
    high = F.coalesce(F.col(target) > F.lit(q3), F.lit(False))
    return df.groupBy(F.when(high, "high").otherwise("rest").alias("stratum")).agg(
        F.count("*").alias("rows"), F.avg(missing).alias("missing_share")
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, five-number summary and bias-corrected skewness per numeric column. NaN is missing."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return named_rows(df, "column", {
        c: {
            "mean": F.avg(col(c)), "std": F.stddev_samp(col(c)), "min": F.min(col(c).cast("double")),
            "q1": F.lit(quartiles[c][0]).cast("double"), "q2": F.lit(quartiles[c][1]).cast("double"),
            "q3": F.lit(quartiles[c][2]).cast("double"), "max": F.max(col(c).cast("double")),
            "skewness": stats.skewness_g1(col(c)),
        } for c in columns
    })


def numeric_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population moments, median, G1, G2 and outlier share per numeric column. NaN is missing."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    fences = fences_from(quartiles)
    facts = {}
    for c in columns:
        low, high, iqr = fences.get(c, (None, None, 0.0))
        outside = (col(c) < F.lit(low)) | (col(c) > F.lit(high)) if iqr else F.lit(False)
        facts[c] = {
            "mean": F.avg(col(c)), "median": F.lit(quartiles[c][1]).cast("double"), "std": F.sqrt(F.var_pop(col(c))),
            "variance": F.var_pop(col(c)), "min": F.min(col(c).cast("double")), "max": F.max(col(c).cast("double")),
            "skewness": stats.skewness_g1(col(c)), "kurtosis": stats.kurtosis_g2(col(c)),
            "outlier_percent": stats.percent(F.count_if(outside), F.count(col(c))),
        }
    return named_rows(df, "column", facts)


def categorical_analysis(df: DataFrame, k: int = 5) -> DataFrame:
    """Distinct values, top five, share of the most frequent value and mean word count per text column."""
    columns = [c for c in categorical_columns(df) if c not in date_text_columns(df)]
    lengths = named_rows(df, "column", {
        c: {"word_count_mean": F.avg(text.word_count(col(c).cast("string")))} for c in columns
    })
    frequencies = value_frequencies(df, columns)
    return (
        distinct_of(frequencies).join(F.broadcast(tops_of(frequencies, k)), "column").join(F.broadcast(lengths), "column")
        .select("column", "unique_values", "top_values",
                (F.col("dominant_rows") / F.col("total")).alias("dominant_share"), "word_count_mean")
    )


def word_count_mean(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(text.word_count(F.col(column))).alias("word_count_mean"))


def constant_columns(df: DataFrame) -> DataFrame:
    return column_stats(df).where(F.col("unique_values") <= 1).select("column", "unique_values")


def high_cardinality(df: DataFrame, limit: int = 20) -> DataFrame:
    """Non-numeric columns with more than ``limit`` distinct values.

    A sketch in one scan first drops the columns far below the limit; the rest is counted exactly.
    """
    columns = [c for c in categorical_columns(df) + time_columns(df)]
    if not columns:
        return column_stats(df).where(F.lit(False)).select("column", "unique_values")
    guess = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in columns]).first()
    likely = [c for c in columns if guess[c] > limit / 2]
    if not likely:
        likely = columns[:1]
    return distinct_counts(df, likely).where(F.col("unique_values") > limit).select("column", "unique_values")


def high_cardinality_profile(profile: DataFrame, rows: int) -> DataFrame:
    """Columns of a profile whose distinct count exceeds min(500, max(50, half the rows))."""
    limit = min(500, max(50, int(rows * 0.5)))
    return profile.where(F.col("unique_values") > limit).select("column", "unique_values")


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """``column, low, high, outliers, percent`` by the interquartile fence; NaN is missing."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    fences = fences_from(exact_quantiles(df, columns, [0.25, 0.75]), k)
    facts = {}
    for c in columns:
        low, high, iqr = fences.get(c, (None, None, 0.0))
        outside = F.count_if((col(c) < F.lit(low)) | (col(c) > F.lit(high)))
        facts[c] = {
            "low": F.lit(low).cast("double"), "high": F.lit(high).cast("double"), "outliers": outside,
            "percent": stats.percent(outside, F.count(col(c))) if iqr else F.lit(0.0),
        }
    return named_rows(df, "column", facts)


def _exact(value: Column, kind: T.DataType) -> Column:
    """A value as JSON keeps it apart: timestamps to the microsecond, one zero."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return value.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _exact(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_exact(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return value


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns of a row, told apart by name, so that long texts never become shuffle keys."""
    values = [_exact(col(f.name), f.dataType).alias(f.name) for f in df.schema]
    return F.unhex(F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies."""
    groups = df.groupBy(row_digest(df).alias("_row")).agg(F.count("*").alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def dedupe_rows(df: DataFrame) -> DataFrame:
    """One of each set of equal rows, told by digest; copies are reduced before the shuffle."""
    kept = df.groupBy(row_digest(df).alias("_row")).agg(F.any_value(F.struct(*[col(c) for c in df.columns])).alias("_kept"))
    return kept.select("_kept.*")


def anomaly_report(df: DataFrame, k: float = 1.5, cardinality: int = 20) -> DataFrame:
    """Duplicates, constant columns, high-cardinality text columns and outlier columns as ``issue, column, n``."""
    counts = column_stats(df)
    texts = categorical_columns(df) + time_columns(df)
    return (
        duplicate_count(df).where("duplicate_rows > 0")
        .select(F.lit("duplicate_rows").alias("issue"), F.lit("*").alias("column"), F.col("duplicate_rows").alias("n"))
        .unionByName(counts.where("unique_values <= 1").select(
            F.lit("constant").alias("issue"), "column", F.col("unique_values").alias("n")))
        .unionByName(counts.where((F.col("unique_values") > cardinality) & F.col("column").isin(texts)).select(
            F.lit("high_cardinality").alias("issue"), "column", F.col("unique_values").alias("n")))
        .unionByName(outlier_counts(df, k=k).where("outliers > 0").select(
            F.lit("outliers").alias("issue"), "column", F.col("outliers").alias("n")))
    )


def analyze_classes(df: DataFrame, target: str) -> DataFrame:
    """Class counts and shares with the imbalance ratio (largest to smallest class, above 3 is imbalanced)."""
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("rows"))
    totals = counts.agg(
        F.sum("rows").alias("_all"), F.max(F.when(F.col("class").isNotNull(), F.col("rows"))).alias("_max"),
        F.min(F.when(F.col("class").isNotNull(), F.col("rows"))).alias("_min"),
    )
    from seriesloom.operators.frames import attach

    return attach(counts.where(F.col("class").isNotNull()), totals).select(
        "class", "rows", (F.col("rows") * 100.0 / F.col("_all")).alias("percent"),
        (F.col("_max") / F.col("_min")).alias("imbalance_ratio"), (F.col("_max") / F.col("_min") > 3).alias("is_imbalanced"),
    )


def analyze_numeric_target(df: DataFrame, target: str) -> DataFrame:
    g1 = stats.skewness_g1(F.col(target))
    return df.agg(
        F.count_if(F.col(target).isNull()).alias("missing"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"), F.max(target).alias("max"), g1.alias("skewness"), (F.abs(g1) > 1).alias("is_skewed"),
    )


def analyze_target(df: DataFrame, target: str, task: str = "regression", classes: int = 20) -> DataFrame:
    """Class balance when asked for or when the target has few values, else the shape of its distribution."""
    if task == "classification" or df.agg(F.approx_count_distinct(target)).first()[0] <= 4 * classes:
        few = df.select(target).where(F.col(target).isNotNull()).distinct().limit(classes + 1).count() <= classes
        if task == "classification" or few:
            return analyze_classes(df, target)
    return analyze_numeric_target(df, target)


def record_batches(indexed: DataFrame, columns: Sequence[str], batches: int = 9) -> DataFrame:
    """Profile of contiguous row ranges of a frame with ``idx`` and ``n``: rows, missing share, means of the numerics, parse rates of the times."""
    frame = indexed.select(*columns)
    numeric = numeric_columns(frame)
    size = F.greatest(F.ceil(F.col("n") / batches), F.lit(1))
    missing = reduce(lambda a, b: a + b, [col(c).isNull().cast("double") for c in columns])
    dates = [F.avg(col(c).isNotNull().cast("double")).alias(f"parse_rate_{c}") for c in time_columns(frame)]
    return indexed.groupBy((F.floor(F.col("idx") / size) + 1).cast("long").alias("batch")).agg(
        F.count("*").alias("rows"), (F.min("idx") + 1).alias("first_row"), (F.max("idx") + 1).alias("last_row"),
        (F.sum(missing) * 100 / (F.count("*") * len(columns))).alias("missing_percent"),
        F.lit(len(numeric)).alias("numeric_columns"), F.lit(len(columns) - len(numeric)).alias("categorical_columns"),
        *[F.avg(col(c)).alias(f"mean_{c}") for c in numeric], *dates,
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins with labels: ``bin, low, high, rows, label``. Empty bins are kept."""
    row = df.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not row["n"]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, rows long, label string")
    bins = min(12, max(6, int(row["n"] ** 0.5 // 2)))
    lo, hi = float(row["lo"]), float(row["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    span = float(row["hi"]) - float(row["lo"])
    if span >= 10_000:
        show = lambda c: F.concat(F.format_string("%.1f", c / 1000), F.lit("K"))
    else:
        import math

        digits = 2 if span == 0 else 0 if span >= 100 else 1 if span >= 1 else max(2, 1 - math.floor(math.log10(span)))
        show = lambda c: F.format_string(f"%.{digits}f", c)
    at = F.least(F.floor((F.col(column) - lo) / width) + 1, F.lit(bins)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("rows"))
    slots = df.sparkSession.range(1, bins + 1, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    low, high = lo + (F.col("bin") - 1) * width, F.when(F.col("bin") == bins, F.lit(hi)).otherwise(lo + F.col("bin") * width)
    return slots.join(F.broadcast(counts), "bin", "left").select(  # at most 12 rows on either side
        "bin", low.alias("low"), high.alias("high"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        F.concat(show(low), F.lit("-"), show(high)).alias("label"),
    )


def duplicate_timestamps(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows repeating an earlier timestamp."""
    per_time = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count("*").alias("_rows"))
    return per_time.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.count("*").alias("distinct_times"),
        (1 - F.count("*") / F.sum("_rows")).alias("duplicate_ratio"),
    )
