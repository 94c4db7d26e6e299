"""Correlation networks: all pairs of symbols over a sliding window, thresholds, signs and what changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrolla.functions import series as S
from corrolla.operators.panel import complete_windows


def _clean(r: Column) -> Column:
    """NaN as null, and no more digits than any order of summing agrees on, so that thresholds cut alike."""
    return F.round(F.when(~F.isnan(r), r), 12)


def rolling_pairs(rets: DataFrame, n: int = 30) -> DataFrame:
    """(rn, date, u, v, r) with u < v for each window of n rows, labelled by its last, over the symbols whole in it.

    One shuffle by date position makes the pairs, one by pair slides the window; a universe's network is a subset.
    """
    rows = complete_windows(rets, n).select("rn", "date", "symbol", "ret", "whole")
    a = rows.select("rn", "date", F.col("symbol").alias("u"), F.col("ret").alias("x"), F.col("whole").alias("wa"))
    b = rows.select("rn", F.col("symbol").alias("v"), F.col("ret").alias("y"), F.col("whole").alias("wb"))
    pairs = a.join(b, "rn").where("u < v")
    w = S.trailing(S.series("u", "v"), n)
    return pairs.withColumn("r", _clean(S.corr("x", "y", w))).where("wa AND wb").select("rn", "date", "u", "v", "r")


def pairwise(rets: DataFrame, least: int = 10) -> DataFrame:
    """(u, v, n, r) over the whole panel, each pair on the rows that both have; null where they are fewer than least."""
    rows = rets.where("ret IS NOT NULL")
    a = rows.select("rn", F.col("symbol").alias("u"), F.col("ret").alias("x"))
    b = rows.select("rn", F.col("symbol").alias("v"), F.col("ret").alias("y"))
    out = a.join(b, "rn").where("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), S.corr("x", "y").alias("r"))
    return out.withColumn("r", F.when(F.col("n") >= least, _clean(F.col("r"))))


def signed_edges(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs at the threshold or above, with weight and sign. Missing correlations are no edges."""
    return pairs.where(F.abs("r") >= threshold).withColumn("w", F.abs("r")).withColumn("s", F.signum("r").cast("int"))


def distance(r: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.coalesce(r, F.lit(0.0)))))


def census(edges: DataFrame) -> DataFrame:
    """Signed triangles by date: how many, and how many have a negative product. Counted by two equi-joins on an end."""
    e = edges.select("rn", "u", "v", "s")
    two = e.alias("a").join(e.alias("b"), (F.col("a.rn") == F.col("b.rn")) & (F.col("a.v") == F.col("b.u")))
    two = two.select("a.rn", "a.u", F.col("b.v").alias("v"), (F.col("a.s") * F.col("b.s")).alias("s2"))
    tri = two.join(e, ["rn", "u", "v"]).withColumn("p", F.col("s") * F.col("s2"))
    return tri.groupBy("rn").agg(F.count(F.lit(1)).alias("n_triangles"), F.count_if(F.col("p") < 0).alias("n_unbalanced"))


def sign_flips(pairs: DataFrame, lag: int, threshold: float = 0.3) -> DataFrame:
    """Pairs strong now and `lag` rows before, with opposite signs."""
    now = signed_edges(pairs, threshold).select("rn", "date", "u", "v", "r")
    old = signed_edges(pairs, threshold).select((F.col("rn") + lag).alias("rn"), "u", "v", F.col("r").alias("r_before"))
    both = now.join(old, ["rn", "u", "v"])
    return both.withColumn("flipped", F.signum("r") != F.signum("r_before")).withColumn("change", F.abs(F.col("r") - F.col("r_before")))
