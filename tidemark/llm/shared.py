"""What several operators need from the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


#: Lets Spark delete the shuffle files of a query when it ends, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read from there, so that a lost executor costs no recomputation."""
    spark = SparkSession.getActiveSession() or df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a new frame, since the setting is read when a frame is made
    finally:
        spark.conf.set(_CLEANUP, before)


def shuffled(df: DataFrame) -> DataFrame:
    """The frame, never to be broadcast: what grows with the input is joined by a shuffle, however small Spark takes it to be."""
    return df.hint("merge")


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``used`` under neutral names, and the names to give back with ``withColumnsRenamed``."""
    others = {c: f"caller_{n}" for n, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(others), {v: k for k, v in others.items()}
