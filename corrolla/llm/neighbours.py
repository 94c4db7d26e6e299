"""Approximate nearest neighbours by cross-polytope hashing: pseudo-rotations, nearest signed axes, probes, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corrolla.llm.common import send_small, written

#: Vectors that a task holds at a time, with tables of their own; cells with more are split. Vectors that a cell should have.
CHUNK, CELL = 8192, 1 << 17
#: Probes of one table at most: as many of a query's best buckets are ranked.
MOST_PROBES = 4096


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    rows, n = x.shape
    step = 1
    while step < n:
        x = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class Hasher:
    """`tables` hash tables over `dim` rotated coordinates, each of `axes` joined cross-polytope hashes: a vector's bucket is
    the nearest signed axis of each of a table's rotations."""

    width: int
    largest: float  # norm by which vectors are scaled, or 0 where all have the same
    tables: int
    axes: int
    seed: int = 1

    @property
    def dim(self) -> int:
        return 1 << max(0, (self.width + bool(self.largest)) - 1).bit_length()

    def _unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose inner products order as the original ones do: a coordinate makes up for shorter norms."""
        out = np.zeros((len(x), self.dim))
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if query or not self.largest:
            out[:, : self.width] = x / norms
        else:
            out[:, : self.width] = x / self.largest
            out[:, self.width : self.width + 1] = np.sqrt(np.clip(1 - (norms / self.largest) ** 2, 0, None))
        return out

    def rotated(self, x: np.ndarray, query: bool):
        """For each table and axis, the rotated vectors' signed coordinates: (rows, 2 dim)."""
        rng, unit = np.random.default_rng(self.seed), self._unit(x, query)
        for _ in range(self.tables):
            own = []
            for _ in range(self.axes):
                y = unit
                for _ in range(3):
                    y = _hadamard(y * rng.choice([-1.0, 1.0], self.dim))
                own.append(np.concatenate([y, -y], axis=1))
            yield own

    def bucket(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t, own in enumerate(self.rotated(x, False)):
            for y in own:
                out[:, t] = out[:, t] * (2 * self.dim) + y.argmax(axis=1)
        return out

    def ranked(self, x: np.ndarray, n: int, ordered: bool = True):
        """For each table, the n most promising buckets of each query (rows, n), best first if ordered: by the sum of the
        coordinates at their axes. Of two sorted lists only places i and j with (i + 1) (j + 1) <= n can be among the n best
        sums, so the axes are joined one after the other over those places."""
        for own in self.rotated(x, True):
            best, score = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
            for y in own:
                axis = np.argsort(-y, axis=1, kind="stable")[:, :n]
                along = np.take_along_axis(y, axis, 1)
                i, j = _corner(best.shape[1], axis.shape[1], n)
                best, score = best[:, i] * (2 * self.dim) + axis[:, j], score[:, i] + along[:, j]
                if best.shape[1] > n:
                    keep = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    best, score = np.take_along_axis(best, keep, 1), np.take_along_axis(score, keep, 1)
                if ordered or y is not own[-1]:
                    keep = np.argsort(-score, axis=1, kind="stable")
                    best, score = np.take_along_axis(best, keep, 1), np.take_along_axis(score, keep, 1)
            yield best


def _corner(a: int, b: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < a and j < b of two lists with (i + 1) (j + 1) <= n."""
    width = np.minimum(b, n // np.arange(1, a + 1))
    i = np.repeat(np.arange(a), width)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)


def fit_probes(hasher: Hasher, sample: np.ndarray, k: int, recall: float, queries: int = 128) -> int:
    """The fewest probes a table that find `recall` of the k nearest among the sample for its first rows: each neighbour
    needs as many as the best place that its bucket has in one of the tables."""
    q = sample[:queries]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1 or not hasher.axes:
        return 1
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = hasher.bucket(sample)[nearest]  # (queries, k, tables)
    place = np.full(nearest.shape, MOST_PROBES)
    for t, ranked in enumerate(hasher.ranked(q, MOST_PROBES)):
        for i in range(len(q)):
            order = np.argsort(ranked[i], kind="stable")
            at = np.minimum(np.searchsorted(ranked[i], own[i, :, t], sorter=order), len(order) - 1)
            place[i] = np.minimum(place[i], np.where(ranked[i][order[at]] == own[i, :, t], order[at], MOST_PROBES - 1))
    return int(np.quantile(place, recall, method="higher")) + 1


class Tables:
    """The hash tables of one block of vectors, as rows sorted by bucket."""

    def __init__(self, hasher: Hasher, x: np.ndarray):
        self.order, self.buckets = [], []
        for own in hasher.bucket(x).T:
            order = np.argsort(own, kind="stable")
            self.order.append(order)
            self.buckets.append(own[order])

    def candidates(self, probes: list[np.ndarray]):
        """For each query, given each table's probes (queries, n), the rows in the buckets probed, each once, in order."""
        hit = np.zeros((len(probes[0]), len(self.order[0])), dtype=bool)
        for order, buckets, p in zip(self.order, self.buckets, probes):
            own, start = np.unique(buckets, return_index=True)
            place = np.searchsorted(own, p)
            place[place == len(own)] = 0
            who, which = np.nonzero(own[place] == p)
            low = start[place[who, which]]
            n = np.r_[start[1:], len(buckets)][place[who, which]] - low
            ends = np.cumsum(n)
            if len(ends):
                hit[np.repeat(who, n), order[np.arange(ends[-1]) + np.repeat(low - ends + n, n)]] = True
        for row in hit:
            yield np.flatnonzero(row)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _v (array of floats or doubles) of the rows that take part: not null, of the commonest width (the larger on a
    tie), with finite components, not all of them zero."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where("_id IS NOT NULL AND size(_v) > 0")
    rows = rows.where(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0))
    widths = rows.groupBy(F.size("_v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    return rows.where(F.size("_v") == (widths[0]["w"] if widths else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    tables: int = 14,
    axes: int = 2,
    recall: float = 0.94,
    sample_rows: int = 20_000,
) -> DataFrame:
    """The k rows of vectors with the largest inner products for each row of queries, its own id left out.

    Returns query_id, rank (from 1), vec_id, score (double, on the original vectors), nearest first, ties to the
    smaller id; fewer than k only where fewer were found.

    Every vector is sent once to its cell, a cross-polytope hash of as many axes as it takes for cells of about CELL
    vectors (none below that), and there to one of the cell's chunks of about CHUNK vectors. A chunk has `tables` hash tables of
    `axes` axes over its vectors. A query goes to its most promising cells, probes the most promising buckets of each
    table in all of their chunks, and the vectors found are ranked exactly (all of the chunk's, where k or fewer are found);
    the chunks' best are merged. How many cells
    and buckets a query probes is fitted on at most sample_rows vectors and 128 of them as queries, so that `recall` of the
    nearest are found there by the tables, and half of the rest is left to be missed by the cells; in larger sets the
    nearest are nearer and easier to find. Nothing else depends on the number of vectors.

    Null, zero, non-finite vectors, those of another width than the commonest, and null ids take no part. Of rows with
    equal vectors only the k + 1 smallest ids can be among anyone's nearest, so where there are more, the others are not
    indexed; equal queries are searched once. Repeated ids count as candidates once for each different vector; further
    columns play no part; an empty table gives an empty result.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    key = F.struct(F.xxhash64("_v").alias("a"), F.hash("_v").alias("b")).alias("_key")
    rows = written(valid_vectors(vectors, id_col, vector_col).select("_id", "_v", key), "vectors")
    asked = written(valid_vectors(queries, id_col, vector_col).select("_id", "_v", key), "queries")
    reps = written(asked.groupBy("_key").agg(F.min("_id").alias("_id"), F.first("_v").alias("_v")), "representatives")
    alike = written(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_key"), "alike")
    index = rows
    if alike.take(1):  # of equal vectors the first ids, each once
        same = rows.join(send_small(alike), "_key").groupBy("_key", "_id").agg(F.first("_v").alias("_v"))
        first = Window.partitionBy("_key").orderBy("_id")
        same = same.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).select("_id", "_v", "_key")
        index = written(rows.join(send_small(alike), "_key", "left_anti").select("_id", "_v", "_key").unionByName(same), "indexed")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    n, low, high, width = index.agg(F.count(F.lit(1)), F.min(norm), F.max(norm), F.max(F.size("_v"))).first()
    if not n or not reps.take(1):
        return spark.createDataFrame([], schema)
    largest = 0.0 if high - low <= 1e-3 * high else high
    hasher, homes = Hasher(width, largest, tables, axes), Hasher(width, largest, 1, 0, seed=2)
    while (2 * homes.dim) ** homes.axes * CELL < n:
        homes = replace(homes, axes=homes.axes + 1)
    share = min(1.0, 0.9 * sample_rows / n)
    drawn = index.where(F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000)).select("_v").limit(sample_rows)
    sample = np.array([r[0] for r in drawn.collect()], dtype=np.float64).reshape(-1, width)
    probes, cells = fit_probes(hasher, sample, k, recall), fit_probes(homes, sample, k, (1 + recall) / 2)
    kind = index.schema["_v"].dataType.simpleString()

    def placing(batches):
        for batch in batches:
            cell = homes.bucket(_matrix(batch.column(1)))[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["_id", "_v", "_cell"])

    def routing(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                [found] = homes.ranked(_matrix(part.column(1)), cells)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(found), pa.list_(pa.int64()))], names=["_id", "_v", "_cells"])

    placed = index.select("_id", "_v").mapInArrow(placing, f"_id long, _v {kind}, _cell long")
    asking = reps.select("_id", "_v")
    if homes.axes:
        placed = written(placed, "placed")
        asking = asking.mapInArrow(routing, f"_id long, _v {kind}, _cells array<long>").select("_id", "_v", F.explode("_cells").alias("_cell"))
    else:
        asking = asking.withColumn("_cell", F.lit(0).cast("long"))
    sizes = written(placed.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks")), "cells")
    left = placed.join(send_small(sizes), "_cell").withColumn("_chunk", F.pmod(F.xxhash64("_id"), "_chunks").cast("int"))
    right = asking.join(send_small(sizes), "_cell").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    cols = ["_cell", "_chunk", "_kind", "_id", "_v"]
    both = left.withColumn("_kind", F.lit(0)).select(cols).unionByName(right.withColumn("_kind", F.lit(1)).select(cols))
    dealt = both.repartition("_cell", "_chunk").sortWithinPartitions("_cell", "_chunk", "_kind")

    def search(batches):
        """Rows come a chunk's vectors first, then its queries: only the vectors are held."""
        at, ids, held, built = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                group, is_query = tuple(keys[a, :2]), keys[a, 2]
                if group != at:
                    at, ids, held, built = group, [], [], None
                v, i = _matrix(batch.column(4).slice(a, b - a)), batch.column(3).slice(a, b - a).to_numpy()
                if not is_query:
                    ids.append(i)
                    held.append(v)
                    continue
                if not held:
                    continue
                if built is None:
                    names, x = np.concatenate(ids), np.concatenate(held)
                    built = Tables(hasher, x)
                for c in range(0, len(v), 256):
                    part = v[c : c + 256]
                    for who, near in enumerate(built.candidates(list(hasher.ranked(part, probes, ordered=False)))):
                        if len(near) <= k:  # too few to choose from: the whole chunk
                            near = np.arange(len(x))
                        scores = (x[near] * part[who]).sum(axis=1)
                        if len(near) > k + 1:
                            border = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                            near, scores = near[scores >= border], scores[scores >= border]  # ties at the border all stay
                        out[0].append(np.full(len(near), i[c + who]))
                        out[1].append(names[near])
                        out[2].append(scores)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["_q", "vec_id", "score"])

    found = dealt.mapInArrow(search, "_q long, vec_id long, score double").groupBy("_q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = best.groupBy("_q").agg(F.collect_list(F.struct("score", "vec_id")).alias("_near"))  # k + 1 at most
    named = written(reps.select("_key", F.col("_id").alias("_q")).join(lists, "_q").select("_key", "_near"), "found")
    out = asked.select("_key", F.col("_id").alias("query_id")).join(named, "_key")
    out = out.select("query_id", F.explode("_near").alias("_n"))
    out = out.select("query_id", "_n.vec_id", "_n.score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
