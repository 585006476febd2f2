"""Cutting the lineage of frames that are built in rounds, and computing columns once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; of its own only on one machine where that is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the folder that driver and executors share and read from there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but through Parquet: a checkpoint keeps what Spark inferred of its plan, which grows from round to round."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are computed once for all their uses: Spark doesn't merge projections across a generator."""
    one = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_once")
    return df.select("*", one).select(*(c for c in df.columns if c not in columns), *(F.col(f"_once.{name}").alias(name) for name in columns))
