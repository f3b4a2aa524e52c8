"""Catalog search: merge, filter, rank, limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.operators.pairing import merge_catalogs
from seriesloom.operators.retrieval import rank_tfidf
from seriesloom.operators.tables import catalog_filter


def search_catalog(
    *catalogs: DataFrame, query: str, domain: str | None = None, time_series_only: bool = False, limit: int = 10,
) -> DataFrame:
    """Catalog rows (``id, title, description, tags, domain, is_time_series, ref``) with ``score``, the ``limit`` best first."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    merged = merge_catalogs(*catalogs)
    kept = catalog_filter(merged, domain, time_series_only)
    text = F.concat_ws(" ", "title", "description", F.array_join("tags", " "), "domain")
    ranked = rank_tfidf(kept.withColumn("_text", text), query, "_text", limit, "id")
    return ranked.drop("_text")
