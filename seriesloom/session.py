"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "seriesloom", master: str | None = None, **conf: object) -> SparkSession:
    """Session with the settings the operators assume (UTC, AQE); extra settings as keywords with ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting uses a folder below its warehouse; a cluster without it is an error, because
    a folder of one machine is lost with that machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows, their order and their partition numbers are fixed from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
