"""Panels: a dense grid of dates and symbols, returns, completeness and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corrolla.functions import series as S


def dense(panel: DataFrame) -> DataFrame:
    """Every symbol on every date of the panel, with the date's position rn from 0. panel is read three times: settle it
    first. The dates, a calendar, are numbered in one task and sent to every executor: some thousand rows for daily data."""
    dates = panel.select("date").distinct().withColumn("_p", F.lit("panel"))
    dates = dates.withColumn("rn", (F.row_number().over(Window.partitionBy("_p").orderBy("date")) - 1).cast("long")).drop("_p")
    return panel.select("symbol").distinct().crossJoin(F.broadcast(dates)).join(panel, ["symbol", "date"], "left")


def returns(panel: DataFrame) -> DataFrame:
    """(symbol, date, rn, close, pad, ret): gaps are padded, so a stale price has return 0 and a leading gap none."""
    w = S.series("symbol")
    return dense(panel).withColumn("pad", S.pad(F.col("close"), w)).withColumn("ret", S.simple_return(F.col("pad"), w))


def live_fill(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """The daily job's rule: fill forward, then back, keep symbols with enough values, the rest of the gaps are 0."""
    w = S.series("symbol")
    filled = returns(panel).withColumn("fill", F.coalesce("ret", S.pad(F.col("ret"), w))).withColumn("fill", F.coalesce("fill", S.backfill(F.col("fill"), w)))
    whole = Window.partitionBy("symbol")
    kept = filled.withColumn("_k", F.count("fill").over(whole) >= share * F.count(F.lit(1)).over(whole)).where("_k").drop("_k")
    return kept.withColumn("fill", F.coalesce("fill", F.lit(0.0)))


def complete_windows(rets: DataFrame, n: int) -> DataFrame:
    """rets with whole: whether the symbol has a return on each of the n rows that end here."""
    return rets.withColumn("whole", F.count("ret").over(S.trailing(S.series("symbol"), n)) == n)


def window_ends(rets: DataFrame, n: int, include_last: bool = False) -> DataFrame:
    """(rn, date) of each row that ends a window of n rows; the newest row ends one only with include_last."""
    dates = rets.select("rn", "date").distinct()
    last = dates.groupBy().agg(F.max("rn").alias("_last"))
    kept = dates.crossJoin(F.broadcast(last)).where((F.col("rn") >= n - 1) & (F.col("rn") < F.col("_last") + int(include_last)))
    return kept.select("rn", "date")


def weekdays(rows: DataFrame, column: str = "date") -> DataFrame:
    """Rows from Monday to Friday."""
    return rows.where(F.weekday(column) < 5)


def padded_range(rows: DataFrame, first, last, window: int, column: str = "date") -> DataFrame:
    """Rows from first to last (dates), and before them as many calendar days as a window's lead-in takes."""
    lead = int(1.7 * window) + 5  # fixed values
    return rows.where(F.col(column).between(F.date_sub(F.lit(first).cast("date"), lead), F.lit(last).cast("date")))


def whole_in_both(rets: DataFrame, n: int, first: int, second: int) -> DataFrame:
    """Symbols that are whole in the windows of n rows that end at the rows first and second."""
    whole = complete_windows(rets, n).where("whole")
    return whole.where(F.col("rn") == first).select("symbol").intersect(whole.where(F.col("rn") == second).select("symbol"))


def coverage(panel: DataFrame) -> DataFrame:
    seen = panel.where(F.col("close").isNotNull())
    return seen.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("close").alias("n_obs"))


def available(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(F.count("close").alias("n_symbols"))
