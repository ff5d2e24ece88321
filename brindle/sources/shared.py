"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it names the folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as Parquet and read again: its lineage starts at the files."""
    path = f"{shared_dir(df.sparkSession)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
