"""A folder's profile after each change equals that of all its files, and only what is new is read."""

import pytest
from pyspark.sql import functions as F

from seriesloom.sources import files, increments
from seriesloom.streaming import sketches

SHOWN = ["column", "rows", "missing", "lowest", "highest", "unique_values", "top_values"]


def facts(df):
    return sorted(tuple(map(str, r)) for r in df.select(SHOWN).collect())


def test_only_new_files_are_read(spark, tmp_path):
    folder, store, whole = (str(tmp_path / n) for n in ("in", "store", "whole"))
    part = lambda a, b, word: spark.range(a, b).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("x"), F.lit(word).alias("w")).coalesce(1)
    schema = "k long, x double, w string"
    read_paths = []

    def read(paths):
        read_paths.append(paths)
        return spark.read.schema(schema).parquet(*paths)

    refresh = lambda: increments.refresh_profile(spark, folder, store, read)

    def expect():
        sketches.keep_batch(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder), ["k", "x", "w"], whole + str(len(read_paths)), 0)
        return facts(sketches.reconcile(spark, whole + str(len(read_paths))))

    part(0, 10, "a").write.parquet(f"{folder}/1")
    part(10, 30, "b").write.parquet(f"{folder}/2")
    assert len(refresh()) == 2 and facts(increments.folder_profile(spark, store)) == expect()
    assert refresh() == [] and len(read_paths) == 1  # nothing new, nothing read
    part(30, 35, "c").write.parquet(f"{folder}/3")
    assert [p.split("/")[-2] for p in refresh()] == ["3"] and facts(increments.folder_profile(spark, store)) == expect()
    part(100, 140, "d").write.mode("overwrite").parquet(f"{folder}/1")  # replaced: the rest of its batch is read again
    assert [p.split("/")[-2] for p in refresh()] == ["1", "2"] and facts(increments.folder_profile(spark, store)) == expect()


def test_failed_refresh_changes_nothing(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.range(5).write.parquet(f"{folder}/1")
    with pytest.raises(ValueError):
        increments.folder_profile(spark, store)
    increments.refresh_profile(spark, folder, store, lambda p: spark.read.parquet(*p))
    before = facts(increments.folder_profile(spark, store))
    spark.range(5, 9).write.parquet(f"{folder}/2")

    def broken(paths):  # parts are written, then the reading fails
        sketches.keep_batch(spark.read.parquet(*paths), ["id"], store, 77)
        raise OSError("lost")

    with pytest.raises(OSError):
        increments.refresh_profile(spark, folder, store, broken)
    assert facts(increments.folder_profile(spark, store)) == before
    assert len(increments.refresh_profile(spark, folder, store, lambda p: spark.read.parquet(*p))) == len(list((tmp_path / "in" / "2").glob("*.parquet")))
    assert {r["rows"] for r in increments.folder_profile(spark, store).collect()} == {9}


def test_rejected_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t,x\n1,"p, ""q""",2.5\nbad,t,1\n2,,\n3,t\n4,t,1,9\n5,u,NaN\n6,"v,w",oops\n')
    read, rejects = files.scan_csv_rejects(spark, str(tmp_path), "k long, t string, x double")
    assert sorted(map(tuple, read.collect())) == [(1, 'p, "q"', 2.5), (2, None, None), (5, "u", None)]
    assert sorted((r.record, r.reason) for r in rejects.collect()) == [
        ("3,t", "bad width"), ("4,t,1,9", "bad width"), ('6,"v,w",oops', "bad value"), ("bad,t,1", "bad value")]
    assert {r.file.split("/")[-1] for r in rejects.collect()} == {"a.csv"} and read.columns == ["k", "t", "x"]
    assert rejects.count() == 4 and rejects.select("reason").distinct().count() == 2
