"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole, shards get nearly equal bytes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corrolla.llm.common import join_skewed, numbered, read_documents, text_or_empty, written

#: Groups that one task differences at a time, and partial partitions that the driver combines at the end.
BLOCK_GROUPS = 20_000
LAST_VECTORS = 512


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions into one. vectors: (m, k), each row the loads of k parts.

    Takes the two rows of largest spread, joins the heaviest part of one with the lightest of the other and so on, and
    puts the sum back, until one row is left. Returns its loads, and for each input row the part of the result that each
    of its parts went to. Ties go to the row that came first.
    """
    m, k = vectors.shape
    order = np.argsort(-vectors, axis=1, kind="stable")
    loads = [v for v in np.take_along_axis(vectors, order, axis=1)] + [None] * (m - 1)
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(loads[:m])]
    heapq.heapify(heap)
    kids = np.zeros((max(m - 1, 0), 2), dtype=np.int64)
    places = np.zeros((max(m - 1, 0), k), dtype=np.int16)
    for node in range(m, 2 * m - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = loads[a] + loads[b][::-1]
        loads[a] = loads[b] = None
        down = np.argsort(-total, kind="stable")
        loads[node] = total[down]
        kids[node - m] = a, b
        places[node - m][down] = np.arange(k)  # part j before the sort is part places[j] after it
        heapq.heappush(heap, (int(loads[node][-1] - loads[node][0]), node))
    goes = np.zeros((2 * m - 1, k), dtype=np.int16)
    goes[2 * m - 2] = np.arange(k)
    for node in range(2 * m - 2, m - 1, -1):
        a, b = kids[node - m]
        to = goes[node][places[node - m]]
        goes[a], goes[b] = to, to[::-1]
    out = np.zeros((m, k), dtype=np.int16)
    np.put_along_axis(out, order, goes[:m], axis=1)
    return loads[2 * m - 2], out


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """key, size -> key, shard. Blocks of groups are differenced apart, then the blocks' partial partitions together:
    in further rounds of blocks while they are many, at last at most LAST_VECTORS of them on the driver."""
    spark = groups.sparkSession
    n = groups.count()
    blocks = max(1, -(-n // BLOCK_GROUPS))
    dealt = groups.withColumn("_block", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        vectors = np.zeros((len(pdf), shards), dtype=np.int64)
        vectors[:, 0] = pdf["size"]
        loads, goes = difference(vectors)
        own = pd.DataFrame({"key": pdf["key"], "_block": pdf["_block"], "part": goes[:, 0].astype("int32"), "loads": None})
        return pd.concat([own, pd.DataFrame({"key": [None], "_block": pdf["_block"].iloc[:1].to_numpy(), "part": [-1], "loads": [loads.tolist()]})])

    done = written(dealt.groupBy("_block").applyInPandas(first, "key binary, _block long, part int, loads array<long>"), "blocks")
    placed = done.where("part >= 0").select("key", "_block", "part")
    vectors = done.where("part < 0").select("_block", "loads")
    while blocks > LAST_VECTORS:
        blocks = -(-blocks // LAST_VECTORS)

        def again(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_block", ignore_index=True)
            loads, goes = difference(np.array(pdf["loads"].tolist(), dtype=np.int64))
            up = pdf["_up"].iloc[0]
            rows = [(int(b), int(j), int(up), int(p), None) for b, to in zip(pdf["_block"], goes) for j, p in enumerate(to)]
            return pd.DataFrame([*rows, (-1, -1, int(up), -1, loads.tolist())], columns=["_block", "part", "_up", "_to", "loads"])

        ups = vectors.withColumn("_up", F.pmod("_block", F.lit(blocks)))
        level = written(ups.groupBy("_up").applyInPandas(again, "_block long, part int, _up long, _to int, loads array<long>"), "level")
        moves = level.where("part >= 0").select("_block", "part", "_up", "_to")
        placed = written(placed.join(moves, ["_block", "part"]).select("key", F.col("_up").alias("_block"), F.col("_to").alias("part")), "placed")
        vectors = level.where("part < 0").select(F.col("_up").alias("_block"), "loads")
    last = sorted((r["_block"], r["loads"]) for r in vectors.collect())
    if not last:
        return groups.select("key", F.lit(0).alias("shard")).limit(0)
    _, goes = difference(np.array([x for _, x in last], dtype=np.int64))
    moves = spark.createDataFrame(
        [(int(b), j, int(p)) for (b, _), to in zip(last, goes) for j, p in enumerate(to)], "_block long, part int, shard int"
    )
    return placed.join(F.broadcast(moves), ["_block", "part"]).select("key", "shard")  # LAST_VECTORS x shards rows at most


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Put every row into one of `shards` shards of nearly equal bytes; rows with equal texts go to the same one.

    Returns id_col, size (UTF-8 bytes and `overhead`), text_crc32, shard and slot (from 0 without gaps, by id within
    portions of a shard). A null text has no bytes and counts as empty. A group of equal texts is never split, so one
    larger than total / shards makes its shard larger by what it exceeds that. Rows alike in id and text are
    interchangeable; null ids are numbered like others; further columns of docs play no part; an empty table gives an
    empty result. A group may hold any share of the rows: only its bytes are added up, by key, before differencing.
    """
    text = text_or_empty(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("key"),
        ),
        "sized",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    shard_of = written(assign_groups(groups, shards), "shards")
    placed = join_skewed(rows, shard_of, "key").drop("key")
    return numbered(placed, "shard", "slot", "_id").withColumnRenamed("_id", id_col)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(read_documents(spark, sf_dir), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
