"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Read from the session.  Only a local session (one machine) that does not
    name one gets a temporary folder of its own; a cluster session without
    it is refused.  The SparkContext is pointed at it if it is not already.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; a shared folder is required to cut lineage")
        d = tempfile.mkdtemp(prefix="sitepulse-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name under the shared folder that no other run uses."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so a
    result reused by several reports survives executor loss without
    recomputing its inputs."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
