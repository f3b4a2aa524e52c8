"""Paging, sorting and filtering of tables and catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seriesloom.operators.frames import attach


def preview_page(df: DataFrame, order_by: Sequence[str], page: int = 1, page_size: int = 25, after: Sequence | None = None) -> DataFrame:
    """One page with ``total_rows`` and ``total_pages``; pages count from 1.

    Without ``after`` the first page * page_size rows are held, which suits the first pages. ``after`` takes the values of ``order_by`` (none
    null) in the last row before the page; then a page costs the same however deep it lies, and ``page`` is not used.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be at least 1")
    if after is None:
        rows = df.orderBy(*order_by).offset((page - 1) * page_size).limit(page_size)
    else:
        later = F.struct(*order_by) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order_by, after)])
        rows = df.where(later).orderBy(*order_by).limit(page_size)
    total = df.agg(F.count("*").alias("total_rows"))
    return attach(rows, total).withColumn("total_pages", F.ceil(F.col("total_rows") / page_size).cast("long"))


def sort_table(df: DataFrame, column: str, descending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Rows sorted by a column, numbers as numbers and text without regard to case."""
    kind = dict(df.dtypes)[column]
    key = F.lower(column) if kind == "string" else F.col(column)
    return df.orderBy(key.desc() if descending else key.asc(), *tie)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame without the columns, and the names that were not there."""
    return df.drop(*[c for c in columns if c in df.columns]), [c for c in columns if c not in df.columns]


def catalog_filter(catalog: DataFrame, domain: str | None = None, time_series_only: bool = False) -> DataFrame:
    """By domain (``general`` or none means all) and by the time-series flag."""
    out = catalog
    if domain not in (None, "general"):
        out = out.where(F.col("domain") == domain)
    if time_series_only:
        out = out.where("is_time_series")
    return out


def catalog_text_filter(catalog: DataFrame, query: str, text_columns: Sequence[str], tags: str | None = None) -> DataFrame:
    """Rows whose text columns or any tag contain the query, without regard to case."""
    wanted = query.lower()
    test = F.lit(False)
    for c in text_columns:
        test = test | F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    if tags:
        test = test | F.coalesce(F.exists(tags, lambda t: F.lower(F.trim(t)).contains(wanted)), F.lit(False))
    return catalog.where(test)
