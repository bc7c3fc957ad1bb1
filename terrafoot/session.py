"""Session-bound helpers: tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where none is set, a local session gets a temporary one; a cluster has no folder of its own that
    all its machines see, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrafoot-"))
        path = spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/terrafoot-{spark.sparkContext.applicationId}"


def materialised(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` written to the shared folder and read back.

    Row ids then agree on all branches of a plan, and later stages restart from these files when an
    executor is lost.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialised` that nothing reads any more, as in the rounds of a loop."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            deleted(df.sparkSession, path)


def clear_shared(spark: SparkSession) -> None:
    """Deletes all that this application has in the shared folder; results that were not written out go too."""
    deleted(spark, shared_dir(spark))
