"""Reading CSV folders and writing cleaned tables, reports and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from seriesloom.operators.frames import col, nan_to_null


def scan_csv(
    spark: SparkSession, path: str | list[str], schema: str | None = None, multi_line: bool = False, encoding: str | None = None,
) -> DataFrame:
    """CSV with header and inferred types; a file with text that is not UTF-8 is read as latin-1, the others are not.

    Give ``schema`` for big folders: inference reads the data once more. ``multi_line`` allows line breaks inside quotes, at the price of
    one task per file. With ``encoding`` the texts are not looked through for their encoding first.
    """
    if encoding:
        told = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", encoding)
        return nan_to_null(told.schema(schema).csv(path) if schema else told.option("inferSchema", True).csv(path))
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max(~F.is_valid_utf8("value")).alias("broken"))
    broken = {r["path"]: r["broken"] for r in files.collect()}  # one row per file
    read = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if not any(broken.values()):
        frame = read.schema(schema).csv(path) if schema else read.option("inferSchema", True).csv(path)
        return nan_to_null(frame)
    sets = {e: [p for p, b in broken.items() if b == (e != "UTF-8")] for e in ("UTF-8", "ISO-8859-1")}
    frames = [
        read.option("encoding", e).schema(schema).csv(paths) if schema else read.option("encoding", e).option("inferSchema", False).csv(paths)
        for e, paths in sets.items() if paths
    ]
    both = reduce(DataFrame.unionByName, frames)
    return nan_to_null(both if schema else _typed(both))


def scan_csv_rejects(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the schema reads, and the others as ``file, block, record, reason``: text that one scan would turn into silent nulls.

    A record is rejected when a value does not fit its column (``bad value``) or when it has fewer or more fields than the header (``bad
    width``). ``file`` and ``block`` (the offset of the block that the scan split off) tell where it stands, ``record`` is the line itself.
    Empty fields are nulls, not errors; NaN is missing. Both results come from the same scan of every column.
    """
    names = spark.createDataFrame([], schema).columns
    read = spark.read.schema(f"{schema}, _record string").option("header", True).option("escape", '"').option("columnPruning", False)
    frame = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").csv(path)
    found = frame.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    # Always true; names every column, so that a count of the rejects still parses all values (Spark refuses to read the record alone).
    found = found.where(F.xxhash64(*map(col, names)) >= F.lit(-2**63))
    broken = F.col("_record").isNotNull()
    quoted = F.regexp_replace("_record", r'"(?:[^"]|"")*"', "")  # separators inside quotes do not count
    width = F.length(quoted) - F.length(F.replace(quoted, F.lit(","), F.lit(""))) + 1
    rejects = found.where(broken).select(
        F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_record").alias("record"),
        F.when(width != len(names), "bad width").otherwise("bad value").alias("reason"),
    )
    return nan_to_null(found.where(~broken).select(*map(col, names))), rejects


def _typed(text: DataFrame) -> DataFrame:
    """All-text columns as the narrowest of long, double, timestamp and text that reads every value."""
    kinds = ("bigint", "double", "timestamp")
    row = text.agg(*[
        F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{i}_{k}") for i, c in enumerate(text.columns) for k in kinds
    ]).first()
    chosen = [next((k for k in kinds if not row[f"{i}_{k}"]), "string") for i in range(len(text.columns))]
    return text.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(text.columns, chosen)])


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``path, length`` of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(folder).select("path", "length")
    )


def largest_file(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    return list_files(spark, folder, pattern).orderBy(F.desc("length"), "path").limit(1)


def file_shapes(spark: SparkSession, folder: str, multi_line: bool = False, pattern: str = "*.csv") -> DataFrame:
    """``path, header, columns, rows`` per CSV file below a folder; rows are the parsed records after the header.

    Files in which some line has an odd number of quotes may hold line breaks inside quotes: only these (with ``multi_line`` all) are
    parsed as a whole, one task per file.
    """
    found = {"recursiveFileLookup": True, "pathGlobFilter": pattern}
    lines = spark.read.options(**found).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    facts = lines.groupBy("path").agg(
        F.count_if(F.length("value") > 0).alias("_lines"), F.max((odd % 2 == 1) | F.lit(multi_line)).alias("_split"), F.min_by("value", F.struct("_block", "_at")).alias("_first"),
    )
    split = [r["path"] for r in facts.where("_split").select("path").collect()]  # one row per such file
    whole = facts.where("NOT _split").select("path", (F.col("_lines") - 1).alias("rows"), F.col("_first").alias("_line"))
    header = _header(whole).select("path", "header", "rows")
    if split:
        read = lambda: spark.read.option("multiLine", True).option("escape", '"')
        records = read().schema("first string").csv(split).groupBy(F.col("_metadata.file_path").alias("path")).agg((F.count("*") - 1).alias("rows"))
        heads = spark.createDataFrame([(p, read().option("header", True).csv(p).columns) for p in split], "path string, header array<string>")
        header = header.unionByName(heads.join(records, "path").select("path", "header", "rows"))
    return header.select("path", "header", F.size("header").alias("columns"), "rows")


def _header(files: DataFrame) -> DataFrame:
    """``header``: the fields of ``_line``, quotes and escaped quotes read as in CSV."""
    fields = F.regexp_extract_all("_line", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(fields, lambda f: F.trim(F.when(f.startswith('"'), F.replace(F.regexp_replace(f, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)))
    return files.withColumn("header", plain)


class FrameCache:
    """Tables loaded once per path and kept in memory and on disk until released."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}

    def load(self, path: str, required: bool = True) -> DataFrame | None:
        if path not in self._frames:
            if path.endswith(".parquet"):
                frame = self.spark.read.parquet(path)
            else:
                found = largest_file(self.spark, path).first() if not path.endswith(".csv") else {"path": path}
                if found is None:
                    if required:
                        raise FileNotFoundError(f"no CSV file below {path}")
                    return None
                frame = scan_csv(self.spark, found["path"])
            self._frames[path] = frame.persist(StorageLevel.MEMORY_AND_DISK)
        return self._frames[path]

    def release(self) -> None:
        for frame in self._frames.values():
            frame.unpersist()
        self._frames.clear()


def write_cleaned(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if file_format == "csv" else writer.format(file_format).save(path)


def write_report(report: DataFrame, path: str, **meta: str) -> None:
    """Report rows as JSON lines, each with the metadata given."""
    rows = report.withColumns({f"meta_{k}": F.lit(v) for k, v in meta.items()}) if meta else report
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
