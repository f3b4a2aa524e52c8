"""Rules on column names, as expressions over a column holding names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from seriesloom.functions.text import name_tokens

# Names that never are a time axis.
NON_TIME_NAMES = (
    "age", "year_of_birth", "birth_year", "yob", "grade", "class", "level", "score", "rating", "rank", "user_id",
    "customer_id", "row", "row_id", "row id", "seq", "num", "number", "count", "quantity", "amount", "id", "order_id",
    "order id", "customer id", "product_id", "product id", "postal_code", "postal code", "zip", "zipcode", "zip code",
    "code", "year",
)
# Words that make a name temporal, and the weights of time-name words.
TEMPORAL_WORDS = ("date", "time", "timestamp", "period", "datetime", "month", "year")
DATE_WORDS = ("date", "time", "timestamp", "datetime")
TIME_WEIGHTS = (
    (("order date", "transaction date"), 5.0), (("date",), 4.0), (("timestamp", "datetime"), 4.0), (("time",), 3.0),
    (("month", "year"), 3.0), (("ship date", "delivery date"), 1.0),
)
IDENTIFIER_MARKS = ("id", "code", "zip", "postal", "row")
# Names never used as a feature.
EXCLUDED_FEATURES = ("index", "row", "row id", "id", "postal code", "zip", "zipcode", "year")
EXCLUDED_FEATURE_PARTS = ("whisker", "rank", "residual", "dystopia")
# Words marking a feature derived from the target, an interval, or the future.
DERIVED_WORDS = (
    "rank", "ranking", "percentile", "quantile", "bucket", "bin", "whisker", "prediction", "predicted", "forecast",
    "fitted", "residual", "error", "label", "target",
)
INTERVAL_WORDS = ("lower", "upper", "bound", "bounds", "interval", "confidence", "ci")
STRICT_INTERVAL_WORDS = ("whisker", "interval", "confidence", "ci")
SEMANTIC_WORDS = ("score", "value", "rate", "amount")
FUTURE_MARKS = ("future", "next", "pred", "forecast", "target", "label")
WARNING_MARKS = ("future", "next", "pred", "forecast", "target")
COMPONENT_WORDS = ("room", "room-level", "zonal", "lighting", "hvac", "local", "historical", "savings", "potential")
# Words naming an entity (panel key) and grouping columns.
ENTITY_WORDS = ("name", "country", "state", "region", "city", "entity", "group", "store", "product", "customer")
GROUP_NAMES = (
    "year", "month", "quarter", "week", "day", "hour", "country", "region", "state", "city", "district", "rank",
    "rank_in_year", "position",
)
# Names and words never chosen as target.
NON_TARGET_NAMES = (
    "age", "year", "year_of_birth", "birth_year", "yob", "id", "user_id", "customer_id", "index", "row", "row_id", "seq",
    "num", "number", "day", "month", "hour", "minute", "second", "week", "quarter", "grade", "class", "rank",
    "rank_in_year", "order", "position", "zip", "postal", "code", "postal_code", "zipcode", "country_code",
    "lower_whisker", "upper_whisker",
)
TARGET_EXCLUDE_MARKS = (
    "explained", "whisker", "residual", "dystopia", "rank", "id", "code", "index", "row", "postal", "zip", "year",
)
TARGET_ALWAYS_ALLOWED = ("happiness score", "sales", "price", "hourly demand", "demand", "target")
TARGET_ID_WORDS = ("id", "code", "key", "seq", "row")
TARGET_PHRASES = (
    "energy consumption", "hourly demand", "energy demand", "power demand", "electricity demand", "sales", "revenue",
    "price", "target value", "target",
)
TARGET_UNITS = ("kwh", "mwh", "mw", "kw", "watt", "$", "price", "revenue", "sales")
TARGET_EXACT = (
    "happiness score", "happiness_score", "score", "sales", "price", "demand", "hourly demand", "target",
    "energy consumption",
)
TARGET_HINTS = (
    "happiness_score", "happiness", "wellbeing", "life_satisfaction", "demand", "consumption", "load", "energy", "price",
    "value", "target", "sales", "revenue", "output", "production", "total", "rate", "generation", "usage", "kwh", "mwh",
    "mw", "kw", "watt", "emission", "traffic", "score", "hours", "minutes", "session", "mental", "addiction", "screen",
    "sleep", "gdp", "expectancy", "life", "freedom", "generosity", "support", "measure", "metric", "flow", "volume", "count",
)
TARGET_LOW_PRIORITY = ("indicator", "status", "flag", "category", "class", "participation", "outage", "reduction")
TARGET_COMPONENTS = (
    "historical", "room-level", "room level", "zonal", "lighting", "hvac", "local", "savings", "potential", "target %",
    "carbon", "emission", "reactive", "smart plug", "water", "temperature", "humidity", "occupancy", "price",
)
TARGET_BEST = ("energy consumption kwh", "energy consumption")


def spaced(name: Column) -> Column:
    return F.trim(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def non_time_column(name: Column) -> Column:
    n = spaced(name)
    return n.isin(*NON_TIME_NAMES) | n.endswith(" id") | n.endswith(" code")


def temporal_name(name: Column) -> Column:
    return contains_any(spaced(name), TEMPORAL_WORDS)


def date_name(name: Column) -> Column:
    """Named like a date and not like an identifier."""
    n = spaced(name)
    return contains_any(n, DATE_WORDS) & ~contains_any(n, IDENTIFIER_MARKS)


def year_name(name: Column) -> Column:
    n = spaced(name)
    return n.contains("year") | n.isin("yr", "fiscal year")


def time_name_score(name: Column) -> Column:
    n = spaced(name)
    score = F.lit(0.0)
    for parts, weight in TIME_WEIGHTS:
        score = score + F.when(contains_any(n, parts), weight).otherwise(0.0)
    return score - F.when(contains_any(n, IDENTIFIER_MARKS), 5.0).otherwise(0.0)


def excluded_feature(name: Column) -> Column:
    n = spaced(name)
    return n.isin(*EXCLUDED_FEATURES) | n.endswith(" id") | n.endswith(" code") | contains_any(n, EXCLUDED_FEATURE_PARTS)


def leakage_reason(name: Column, target: Column) -> Column:
    """Why a feature would leak the target, judged by its name; null when it would not."""
    flat = lambda c: F.trim(F.translate(F.lower(c), "_-", "  "))
    words, goal = name_tokens(name), name_tokens(target)
    shares_goal = F.arrays_overlap(words, goal)
    interval = F.arrays_overlap(words, _array(INTERVAL_WORDS)) & (
        shares_goal | F.arrays_overlap(words, _array(STRICT_INTERVAL_WORDS))
    )
    return (
        F.when(flat(name) == flat(target), "target column")
        .when(F.arrays_overlap(words, _array(DERIVED_WORDS)), "derived from the target or known only afterwards")
        .when(interval, "interval or uncertainty of the target")
        .when((F.size(goal) > 0) & (F.size(F.array_except(goal, words)) == 0), "name contains the target name")
        .when(shares_goal & F.arrays_overlap(words, _array(SEMANTIC_WORDS)), "name overlaps the target's words")
    )


def safe_feature(name: Column, target: Column) -> Column:
    """False for names with a leakage reason, a future marker next to a target word, or a component of an energy target."""
    words, goal = name_tokens(name), name_tokens(target)
    n, t = spaced(name), spaced(target)
    future = F.arrays_overlap(words, goal) & contains_any(n, FUTURE_MARKS)
    energy = t.contains("energy consumption") & n.contains("energy consumption")
    component = (
        F.array_contains(goal, "energy") & F.array_contains(goal, "consumption")
        & F.arrays_overlap(words, _array(COMPONENT_WORDS))
    )
    return leakage_reason(name, target).isNull() & ~future & ~energy & ~component


def leakage_warning(name: Column, target: Column) -> Column:
    shares = F.arrays_overlap(name_tokens(name), name_tokens(target))
    return (name != target) & shares & contains_any(F.lower(name), WARNING_MARKS)


def excluded_target(name: Column, substrings: bool = False) -> Column:
    """Names never used as target. Markers match whole words; ``substrings`` also matches inside words (humid-ity)."""
    n = F.trim(F.translate(F.lower(name), "_()", "   "))
    words = F.split(n, " +")
    marked = contains_any(n, TARGET_EXCLUDE_MARKS) if substrings else F.arrays_overlap(words, _array(TARGET_EXCLUDE_MARKS))
    by_words = F.arrays_overlap(words, _array(NON_TARGET_NAMES))
    return (~n.isin(*TARGET_ALWAYS_ALLOWED) & marked) | by_words | F.lower(name).isin(*NON_TARGET_NAMES)


def target_score(name: Column, unique_values: Column, rows: Column, mean: Column, std: Column) -> Column:
    """Preference for a numeric column as forecast target."""
    n = F.trim(F.translate(F.lower(name), "_()", "   "))
    add = lambda test, points: F.when(test, float(points)).otherwise(0.0)
    hints = [h.replace("_", " ") for h in TARGET_HINTS]
    low = contains_any(n, TARGET_LOW_PRIORITY)
    share = unique_values / F.greatest(rows, F.lit(1))
    return (
        add(contains_any(n, TARGET_PHRASES), 8) + add(contains_any(n, TARGET_UNITS), 3) + add(n.isin(*TARGET_EXACT), 6)
        + F.when(F.lower(name).isin(*[h.replace(" ", "_") for h in TARGET_HINTS]), 3.0).when(contains_any(n, hints), 2.0).otherwise(0.0)
        + F.when(unique_values <= 2, -7.0).when((unique_values <= 10) & low, -5.0).when((share < 0.01) & low, -3.0).otherwise(0.0)
        + add(low, -2) + add(contains_any(n, TARGET_COMPONENTS), -4) + add(n.isin(*TARGET_BEST), 6)
        + F.when(F.abs(mean) > 0, F.least(std / F.abs(mean), F.lit(1.0))).otherwise(0.0)
        + F.least(share, F.lit(1.0))
    )


def id_named(name: Column) -> Column:
    return F.arrays_overlap(F.split(F.trim(F.translate(F.lower(name), "_()", "   ")), " +"), _array(TARGET_ID_WORDS))
