"""Helpers shared by the training-data operators: written intermediates, skew-safe joins and numbering."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corrolla.sources.shared import shared_dir

#: The white space that separates words, as a regular-expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Rows of a written intermediate are kept here, below the cluster's shared folder.
_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor. They are removed at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corrolla/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Remove intermediates that nothing will read again: what was made of them must be written itself."""
    for df in frames:
        _remove(df.sparkSession, df._written_path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != df._written_path]
    tidy(frames[0])


def tidy(df: DataFrame) -> None:
    """Let go of the shuffle files of plans that nothing refers to: Spark removes them once the driver's garbage is gone."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def mark_written() -> set[str]:
    """What of the intermediates is not the caller's: all written so far."""
    return {path for _, path in _WRITTEN}


def discard_since(mark: set[str], keep: DataFrame) -> None:
    """Remove the intermediates written since the mark, but for `keep`."""
    for spark, path in [x for x in _WRITTEN if x[1] not in mark and x[1] != keep._written_path]:
        _remove(spark, path)
        _WRITTEN.remove((spark, path))


def forget_written() -> None:
    """Remove every intermediate written so far; DataFrames that still read one become invalid."""
    while _WRITTEN:
        try:
            _remove(*_WRITTEN.pop())
        except Exception:  # noqa: BLE001  the session may be gone already
            return


atexit.register(forget_written)


#: Bytes of a table that are sent to every executor at most, whatever its rows are wide. The driver holds a sent table as a
#: hash table of up to four times its values, besides the rows and the blocks it is made of, and several at a time.
SENT_BYTES = 4 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of df's values, nearly: 8 for a number, the length of a text, 24 for each member of an array."""
    each = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        wide = F.octet_length(field.name) if kind in ("string", "binary") else 24 * F.size(field.name) if kind == "array" else F.lit(8)
        each = each + F.coalesce(wide, F.lit(0)).cast("long")
    return df.agg(F.sum(each)).first()[0] or 0


def send_small(df: DataFrame) -> DataFrame:
    """df, marked to be sent to every executor if it has SENT_BYTES at most; beyond, Spark joins it by a shuffle. df should
    be written, as it is read twice."""
    return F.broadcast(df) if size_of(df) <= SENT_BYTES else df


def _release() -> None:
    """Give memory that this process has free back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run):
    """run (of mapInArrow) whose worker keeps no free memory once a task is over: workers stay for all later stages, and what
    each has freed would count against its executor till the end."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return released


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def heavy_keys(keys: DataFrame, key: str, share: int = 1000) -> list:
    """The values of key that hold at least 1/share of the rows: at most `share` of them, whatever the input."""
    counts = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.where((F.col("n") * share >= total) & (F.col("n") > 64)).select(key).collect()]


def join_skewed(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of left (any number of rows a key) with right (one row a key at most).

    Keys holding 1/share or more of left's rows are at most `share` by construction; their rows of right are
    broadcast, so those rows of left never move. The rest is an ordinary shuffled join.
    """
    heavy = heavy_keys(left, key, share)
    if not heavy:
        return left.join(right, key)
    is_heavy = F.col(key).isin(heavy)
    return left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), key).unionByName(
        left.where(~is_heavy).join(right.where(~is_heavy), key)
    )


def numbered(df: DataFrame, group: str, slot: str, by: str, parts: int = 256) -> DataFrame:
    """Number the rows of each group from 0 without gaps; no task holds a whole group.

    Rows are dealt by a hash of `by` (an array or scalar column) to `parts` portions of their group and numbered
    there; the portions' sizes, groups x parts rows, give each portion its first number.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_part", F.pmod(F.xxhash64(F.col(by), F.lit("slot")), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(group, "_part").orderBy(by)
    return (
        dealt.withColumn("_at", F.row_number().over(within) - 1)
        .join(F.broadcast(first), [group, "_part"])
        .withColumn(slot, (F.col("_at") + F.col("_first")).cast("long"))
        .drop("_at", "_first", "_part")
    )
