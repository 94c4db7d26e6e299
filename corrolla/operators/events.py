"""Event studies: alignment of events with rows, responses per event and category, dummies, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corrolla.functions import series as S


def nearest_rows(events: DataFrame, rows: DataFrame, key: str = "label") -> DataFrame:
    """Each event (event_date and more, told apart by key) with the row of the nearest date in each panel, however far, the
    later one on a tie. Two as-of lookups, the date before and the one after, by one union and one window; events are few."""
    if "panel" not in rows.columns:  # one series
        return nearest_rows(events, rows.withColumn("panel", F.lit("-")), key).drop("panel")
    dates = rows.select("panel", "date").distinct()
    marks = rows.select("panel").distinct().crossJoin(F.broadcast(events.select(key, "event_date")))
    both = dates.select("panel", F.col("date").alias("_at"), "date").withColumn("_side", F.lit(0))
    both = both.unionByName(marks.select("panel", key, F.col("event_date").alias("_at")).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("panel").orderBy("_at", "_side")
    both = both.withColumn("_before", F.last("date", ignorenulls=True).over(S.upto(w)))
    both = both.withColumn("_after", F.first("date", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    later = F.datediff("_after", "_at") <= F.datediff("_at", "_before")
    near = F.when(F.col("_before").isNull() | later, F.col("_after")).otherwise(F.col("_before"))
    spots = both.where("_side = 1").select("panel", key, near.alias("date")).where("date IS NOT NULL")
    return rows.join(F.broadcast(spots.join(events, key)), ["panel", "date"])


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, keys: list[str]) -> DataFrame:
    """left with the last value of right at or before its time: one union, one window, no range join."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(*keys, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def event_dummy(rows: DataFrame, at: DataFrame, reach: int = 2) -> DataFrame:
    """rows with dummy: 1 within `reach` positions of an event. at: (rn) of the events, few."""
    spots = at.select(F.explode(F.sequence(F.col("rn") - reach, F.col("rn") + reach)).alias("rn")).distinct().withColumn("_e", F.lit(1))
    return rows.join(F.broadcast(spots), "rn", "left").withColumn("dummy", F.coalesce("_e", F.lit(0))).drop("_e")


def responses(df: DataFrame, column: str, pre: int = 30, post: int = 30, least: int = 15) -> DataFrame:
    """Every row's response, were it an event: post less pre, post alone, and pre over 15 and 30 rows, in z units."""
    w = S.series("panel")
    z = F.col(column)
    out = df.withColumn("post_pre", F.when(F.col("rn") >= pre, S.delta(z, w, pre, post, least)))
    out = out.withColumn("post_only", F.when(F.col("rn") >= pre, F.avg(z).over(w.rowsBetween(0, post - 1))))
    out = out.withColumn("pre15", F.when(F.col("rn") >= pre, F.avg(z).over(w.rowsBetween(-15, -1))))
    out = out.withColumn("pre30", F.when(F.col("rn") >= pre, F.avg(z).over(w.rowsBetween(-30, -1))))
    return out.withColumn("scaled", F.when(F.col("rn") >= pre, S.delta(z, w, pre, post, least, scaled=True)))


def fixed_baseline(df: DataFrame, column: str, base: tuple[int, int], event: tuple[int, int]) -> DataFrame:
    """Response of an event window of positions against a baseline window, with why there is none where there is none."""
    at = lambda r: (F.col("rn") >= r[0]) & (F.col("rn") < r[1])
    own = F.when(at(base), F.col(column))
    agg = df.groupBy("panel").agg(
        F.count(own).alias("n_base"),
        F.avg(own).alias("mean"),
        F.stddev_samp(own).alias("sd"),
        F.count(F.when(at(event), F.col(column))).alias("n_event"),
        F.avg(F.when(at(event), F.col(column))).alias("event_mean"),
    )
    reason = F.when(F.col("n_base") < 5, "few base rows").when(F.col("n_event") < 3, "few event rows").when(F.col("sd") == 0, "flat base")
    return agg.withColumn("reason", reason).withColumn("response", F.when(reason.isNull(), (F.col("event_mean") - F.col("mean")) / F.col("sd")))


def sessions(rows: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Rows of a key with the number of their session: a new one starts after a gap."""
    w = Window.partitionBy(key).orderBy(time, "event_id")
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds).cast("long"), F.lit(1))
    return rows.withColumn("_n", new).withColumn("session", F.sum("_n").over(S.upto(w))).drop("_n")


def around(events: DataFrame, rows: DataFrame, columns: list[str], keys: list[str], pre: int = 30, post: int = 30, least: int = 10, key: str = "label") -> DataFrame:
    """For each event and series (keys): means of each column over the `post` rows with a value from the event's date on less
    those over the `pre` rows before it (d_<column>), n_pre and n_post; null with fewer than `least` rows on a side.

    rows have a date. Rows without a value in any column don't count. Events are few."""
    known = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    both = known.crossJoin(F.broadcast(events.select(key, "event_date")))
    after = F.col("date") >= F.col("event_date")
    back = Window.partitionBy(*keys, key, after).orderBy(F.desc("date"))
    ahead = Window.partitionBy(*keys, key, after).orderBy("date")
    place = F.when(after, F.row_number().over(ahead)).otherwise(F.row_number().over(back))
    both = both.withColumn("_a", after).withColumn("_k", place).where(F.when(F.col("_a"), F.col("_k") <= post).otherwise(F.col("_k") <= pre))
    sides = [F.avg(F.when(F.col("_a") == a, F.col(c))).alias(f"_{int(a)}_{c}") for a in (True, False) for c in columns]
    agg = both.groupBy(*keys, key).agg(F.count_if(~F.col("_a")).alias("n_pre"), F.count_if("_a").alias("n_post"), *sides)
    enough = F.expr(f"n_pre >= {least} AND n_post >= {least}")
    return agg.select(*keys, key, "n_pre", "n_post", *[F.when(enough, F.col(f"_1_{c}") - F.col(f"_0_{c}")).alias(f"d_{c}") for c in columns])


def local_scores(events: DataFrame, rows: DataFrame, columns: list[str], reach: int = 35, floor: float = 1e-9, key: str = "label") -> DataFrame:
    """rows within `reach` rows of each event's nearest row, with each column scored against those rows alone: a series for
    each event."""
    at = nearest_rows(events, rows, key).select("panel", key, F.col("rn").alias("_at"))
    own = rows.join(F.broadcast(at), "panel").where(F.abs(F.col("rn") - F.col("_at")) <= reach)
    w = Window.partitionBy("panel", key)
    scored = [((F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_samp(c).over(w), F.lit(floor))).alias(c) for c in columns]
    return own.select("panel", key, "rn", "date", *scored)
