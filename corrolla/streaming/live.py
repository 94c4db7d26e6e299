"""The live path as streams: file source, change detection with state, upsert by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type over tumbling windows; rows later than `late` are dropped with their state."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A row (key, order, prev, new) whenever a key's value differs from its last one, over all micro-batches. Rows must
    arrive in order; within a batch they are put in order."""
    kinds = {n: rows.schema[n].dataType.simpleString() for n in (key, order, value)}

    def step(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at, new in sorted((a, v) for b in batches for a, v in zip(b[order], b[value])):
            if last is not None and new != last:
                out.append((group[0], at, last, new))
            last = new
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, "prev", "new"])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, prev {kinds[value]}, new {kinds[value]}"
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, f"last {kinds[value]}", "append", "NoTimeout")


def upsert(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last version of each key. Every batch writes a new generation beside the old one
    and then names it in a pointer file, so a reader or a retry never sees half of one."""
    from corrolla.sources.tables import latest_by_key

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path)
        rows = batch if before is None else before.select(batch.columns).unionByName(batch)
        latest_by_key(rows, keys, version).write.mode("overwrite").parquet(f"{path}/g{number}")
        spark.createDataFrame([(number,)], "g long").coalesce(1).write.mode("overwrite").json(f"{path}/at/{number:012d}")

    return put


def current(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/at")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/g{int(max(done))}") if done else None
