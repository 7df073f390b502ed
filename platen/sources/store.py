"""Reliable checkpoints and folders in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. One is set only where the session has none and runs on one machine (tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="platen-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by `by` into as many partitions as the session's shuffles have. Spark joins none of these into a larger one, so
    what a task sorts or groups is that share of the rows, where it would else grow up to a fixed size of what was sent."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def uri_of(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Spark takes it for, in the form that pyarrow reads too."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder that nothing else uses, beside the checkpoints."""
    return uri_of(spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
