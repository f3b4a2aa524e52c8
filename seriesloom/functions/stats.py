"""Statistical expressions whose conventions differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def skewness_g1(c: Column) -> Column:
    """Bias-corrected sample skewness (null below three values)."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_g2(c: Column) -> Column:
    """Bias-corrected sample excess kurtosis (null below four values)."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; 0 with fewer than three pairs or without variance."""
    return F.coalesce(F.when(F.regr_count(a, b) >= 3, pearson(a, b)), F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs, null or 0 without variance.

    ``corr`` divides by zero for a constant column, which is an error in ANSI mode; the coefficient of determination does not.
    """
    return F.signum(F.covar_pop(a, b)) * F.sqrt(F.regr_r2(a, b))


def percent(part: Column, all_: Column) -> Column:
    """Share in percent, null when there is nothing."""
    return F.try_divide(part * 100.0, all_)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / max(bottom, 1)``, the guard used by all deviation ratios."""
    return top / F.greatest(bottom, F.lit(1.0))


def whole(c: Column) -> Column:
    """Integer part as long."""
    return F.floor(c).cast("long")


def score_grade(score: Column) -> Column:
    return (
        F.when(score >= 80, "strong").when(score >= 60, "moderate").when(score >= 40, "weak").otherwise("poor")
    )


def trend_label(first: Column, last: Column) -> Column:
    return F.when(last > first, "up").when(last < first, "down").otherwise("stable")


def significant(c: Column, digits: int = 9) -> Column:
    """Round to significant digits; used where one output column mixes magnitudes."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double"))
