"""Where intermediate files may go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    This is what the cluster names in ``spark.checkpoint.dir``.  Only a local
    session may fall back on a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="shelfcast-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative estimators cut their lineage in files that outlive an executor."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the files.

    Used where a table is read many times (an iterative fit, several fill values)
    and where a short table meets a long one: its file size then tells the planner
    whether it may be broadcast, before the long side has been shuffled.  The
    lineage ends at files that outlive any executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
