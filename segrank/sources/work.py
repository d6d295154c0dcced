"""Tables between steps: written once, read by all that follow, so that plans stay short and rows stay the same if executors are lost."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from segrank.functions.guards import ScreeningError


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, a local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/segrank-work"
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise ScreeningError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "segrank-work")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex[:16]}/{name}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote, through Hadoop's file system."""
    path = getattr(df, "_stored_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
