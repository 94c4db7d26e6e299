"""Joins, sets, maps, formats and exports that the studies are made of, one query each."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corrolla.operators import panel as P
from corrolla.plans.registry import IND, RET, W, _ind, _rets, query, r
from corrolla.sources import tables as T

#: Fixed values. Hours from the start of an event's day to its close, by kind of event; other kinds have none.
CLOSES = {"view": 16, "click": 20, "purchase": 6}
_CLOSES = ", ".join(f"('{k}', {v})" for k, v in CLOSES.items())


@query("outer_months", "WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, count(*) AS n_orders FROM orders GROUP BY 1), l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mo, count(*) AS n_lines FROM lineitem GROUP BY 1) SELECT CAST(coalesce(o.mo, l.mo) AS VARCHAR) AS month, n_orders, n_lines FROM o FULL JOIN l ON o.mo = l.mo")
def _(spark, d):
    by = lambda t, c, n: T.table(spark, d, t).groupBy(F.date_trunc("month", c).cast("date").alias("mo")).agg(F.count(F.lit(1)).alias(n))
    both = T.joined_outer(by("orders", "o_orderdate", "n_orders"), by("lineitem", "l_shipdate", "n_lines"), "mo")
    return both.select(F.col("mo").cast("string").alias("month"), "n_orders", "n_lines")


@query("lookup_default", f"SELECT coalesce(h, -1) AS hours, count(*) AS n FROM events LEFT JOIN (VALUES {_CLOSES}) t(k, h) ON event_type = k GROUP BY 1")
def _(spark, d):
    dim = spark.createDataFrame([(k, str(v)) for k, v in CLOSES.items()], "event_type string, hours string")
    rows = T.lookup(T.table(spark, d, "events"), F.broadcast(dim), "event_type", "hours", "-1")
    return rows.groupBy(F.col("hours").cast("int").alias("hours")).agg(F.count(F.lit(1)).alias("n"))


@query("close_times", f"WITH e AS (SELECT user_id, event_type, event_id, ts, date_trunc('day', ts) + to_hours(coalesce(h, 0)) AS closes FROM events LEFT JOIN (VALUES {_CLOSES}) t(k, h) ON event_type = k) SELECT user_id, event_type, strftime(closes, '%Y-%m-%d %H') AS closes, arg_max(event_id, (ts, event_id)) AS event_id FROM e GROUP BY 1, 2, 3")
def _(spark, d):
    """Each day's last event of a user and kind, dated by the hour at which that kind's day closes."""
    hours = F.create_map(*[F.lit(x) for kv in CLOSES.items() for x in kv])
    e = T.table(spark, d, "events").withColumn("hours", F.coalesce(F.try_element_at(hours, F.col("event_type")), F.lit(0)))
    closes = F.date_format(F.date_trunc("day", "ts") + F.make_dt_interval(hours=F.col("hours")), "yyyy-MM-dd HH")
    return e.groupBy("user_id", "event_type", closes.alias("closes")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("weekday_rows", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1")
def _(spark, d):
    rows = P.weekdays(T.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")))
    return rows.groupBy(F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("padded_range", f"WITH {IND} SELECT rn, round(price, 6) AS price FROM ind WHERE date BETWEEN DATE '1998-01-01' - INTERVAL {int(1.7 * W) + 5} DAY AND DATE '1999-01-01'")
def _(spark, d):
    return P.padded_range(_ind(spark, d), "1998-01-01", "1999-01-01", W).select("rn", r("price").alias("price"))


_WHOLE = f"{RET}, whole AS (SELECT *, count(ret) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) = {W} AS whole FROM ret)"


@query("whole_in_both", f"WITH {_WHOLE} SELECT symbol FROM whole WHERE whole AND rn = 60 INTERSECT SELECT symbol FROM whole WHERE whole AND rn = 120")
def _(spark, d):
    return P.whole_in_both(_rets(spark, d), W, 60, 120)


@query("recent_rows", "WITH m AS (SELECT CAST(max(ts) AS DATE) AS last FROM events) SELECT event_type, count(*) AS n FROM events, m WHERE CAST(ts AS DATE) >= last - INTERVAL 5 DAY GROUP BY 1")
def _(spark, d):
    """The last five days, counted back from the newest row as a clock would from today."""
    e = T.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day").alias("last"))
    return e.join(F.broadcast(last), F.col("day") >= F.date_sub("last", 5)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("kind_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def _(spark, d):
    """A map of counts for each user, looked up with a default."""
    by = T.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = by.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # one entry a kind
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(k + "s")
    return maps.select("user_id", get("view"), get("purchase"), F.size("m").cast("long").alias("kinds"))


@query("formatted", "SELECT user_id, format('{:+.1f}%', 100 * avg(value) / max(value)) AS share, format('{:.2f}', sum(value)) AS total, to_base64(encode('user ' || user_id)) AS code FROM events GROUP BY user_id")
def _(spark, d):
    by = T.table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("a"), F.max("value").alias("m"), F.sum("value").alias("s"))
    return by.select("user_id", F.format_string("%+.1f%%", 100 * F.col("a") / F.col("m")).alias("share"), F.format_string("%.2f", F.col("s")).alias("total"), F.base64(F.encode(F.concat(F.lit("user "), F.col("user_id").cast("string")), "UTF-8")).alias("code"))


@query("described", f"WITH {IND} SELECT count(l1) AS n, round(avg(l1), 6) AS mean, round(stddev_samp(l1), 6) AS sd, round(min(l1), 6) AS least, round(quantile_cont(l1, 0.25), 6) AS q25, round(quantile_cont(l1, 0.5), 6) AS q50, round(quantile_cont(l1, 0.75), 6) AS q75, round(max(l1), 6) AS most FROM ind")
def _(spark, d):
    q = lambda x: r(F.percentile("l1", F.lit(x)))
    return _ind(spark, d).agg(F.count("l1").alias("n"), r(F.avg("l1")).alias("mean"), r(F.stddev_samp("l1")).alias("sd"), r(F.min("l1")).alias("least"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), r(F.max("l1")).alias("most"))


@query("enough_rows", "SELECT user_id, count(*) AS n_obs FROM events GROUP BY 1 HAVING count(*) >= 50")
def _(spark, d):
    counts = T.table(spark, d, "events").groupBy(F.col("user_id").alias("symbol")).agg(F.count(F.lit(1)).alias("n_obs"))
    return T.enough_rows(counts).select(F.col("symbol").alias("user_id"), "n_obs")


@query("wide_and_long", f"WITH {RET} SELECT symbol, rn, round(close, 6) AS close FROM grid WHERE close IS NOT NULL")
def _(spark, d):
    """The panel as one column a symbol and back again: missing cells go."""
    rows = _rets(spark, d).select("symbol", "rn", "close")
    names = [f"Brand#{i}" for i in range(1, 26)]  # the brands there are
    wide = rows.select(F.col("rn").alias("date"), "symbol", "close").transform(lambda x: T.to_wide(x, names))
    return T.read_wide(wide).select("symbol", F.col("date").alias("rn"), r("close").alias("close"))


@query("export_document")
def _(spark, d):
    """One document with the newest rows of three tables: 90 events, 50 orders and 100 lines."""
    def newest(table: str, by: str, n: int, *columns: str):
        rows = T.newest(T.table(spark, d, table).select(by, *columns), by, n)
        return rows.agg(F.sort_array(F.collect_list(F.struct(by, *columns)), asc=False).alias(table))

    parts = [newest("events", "event_id", 90, "event_type", "value"), newest("orders", "o_orderkey", 50, "o_totalprice"), newest("lineitem", "l_orderkey", 100, "l_linenumber", "l_quantity")]
    out = parts[0]
    for x in parts[1:]:
        out = out.crossJoin(F.broadcast(x))  # one row each
    return out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


@query("rank_by_window", f"WITH {IND} SELECT rn, rank() OVER (ORDER BY unb DESC) AS place FROM ind")
def _(spark, d):
    return _ind(spark, d).select("rn", F.rank().over(Window.partitionBy("panel").orderBy(F.desc("unb"))).alias("place"))
