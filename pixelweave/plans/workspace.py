"""Tables and files that outlive executors, below the folder that all of them share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets a folder of
    its own. On a cluster a missing setting is an error: a machine-local folder
    would lose files that other executors need.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm_dir.get() if jvm_dir.isDefined() else None
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join("/tmp", "pixelweave-checkpoints")
        spark.sparkContext.setCheckpointDir("file://" + base)
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/pixelweave"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of this application below the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder; results read from it are gone, too."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts lineage with a table that outlives any executor. The planner goes
    by the size of its files, see ``dealt``.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles and sorts it, whatever its files' size.

    Places and labels of millions of pixels pack into a few MB of Parquet, for
    which the planner would broadcast them: rows that the driver can't hold.
    """
    return df.hint("merge")
