"""Intermediates that are read more than once: written as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTLED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; on a cluster that would
    be a folder that no other machine sees, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corrolla-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, computed now and read back from the shared folder, so that what follows computes none of it again and lost
    executors cost nothing of it. The files go when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corrolla/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_settled() -> None:
    """Remove all settled frames; those that still read one become invalid."""
    while _SETTLED:
        spark, path = _SETTLED.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


atexit.register(forget_settled)
