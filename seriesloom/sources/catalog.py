"""A catalog of dataset folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.functions import domains, text
from seriesloom.operators.retrieval import tags_from_text
from seriesloom.sources.files import file_shapes, list_files


def entry_columns(folder: Column, file: Column, header: Column) -> dict[str, Column]:
    """Catalog fields of one folder from its name, its main file and that file's header."""
    owner, slug = text.owner_of(folder), text.slug_of(folder)
    title = text.title_from_slug(slug)
    words = F.concat_ws(" ", folder, file, title, F.array_join(header, " "))
    domain = domains.domain_by_substring(words)
    return {
        "id": F.when(owner.isNotNull(), F.concat(owner, F.lit("--"), slug)).otherwise(folder),
        "ref": F.when(owner.isNotNull(), F.concat(owner, F.lit("/"), slug)),
        "title": title, "domain": domain, "tags": tags_from_text(words, domain),
        "is_time_series": domains.looks_time_series(words),
    }


def build_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per folder below ``root``: its largest CSV with title, domain, tags, rows and columns."""
    files = list_files(spark, root).withColumn("_folder", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    main = files.groupBy("_folder").agg(F.max_by("path", F.struct("length", "path")).alias("path"))
    shapes = file_shapes(spark, root).withColumn("_file", F.regexp_replace("path", "^file:/+", "/")).drop("path")
    joined = main.withColumn("_file", F.regexp_replace("path", "^file:/+", "/")).join(shapes, "_file", "left")
    fields = entry_columns(F.col("_folder"), F.regexp_extract("_file", r"([^/]+)$", 1), F.coalesce("header", F.array()))
    return joined.select(
        *[c.alias(name) for name, c in fields.items()], F.col("rows").alias("row_count"), F.col("columns").alias("column_count"), "path"
    )
