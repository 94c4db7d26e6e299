"""Event studies, backtests, as-of joins and the live path as queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corrolla.functions import series as S
from corrolla.operators import events as E, panel as P, signals as G
from corrolla.plans.registry import DIV, IND, _div, _ind, query, r
from corrolla.sources import tables as T

#: Fixed values. Events inside the panel's range: date, label, category.
EVENTS = [
    ("1996-02-14", "a1", "policy"),
    ("1996-11-05", "a2", "market"),
    ("1997-07-02", "a3", "market"),
    ("1998-03-19", "a4", "policy"),
    ("1998-10-01", "a5", "market"),
    ("1999-05-13", "a6", "policy"),
    ("2000-01-06", "a7", "market"),
    ("2000-09-21", "a8", "policy"),
]
EV = "ev AS (SELECT CAST(d AS DATE) AS event_date, label, category FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EVENTS) + ") t(d, label, category))"
NEAR = EV + ", near AS (SELECT * FROM (SELECT e.label, e.category, e.event_date, v.*, row_number() OVER (PARTITION BY e.label ORDER BY abs(date_diff('day', e.event_date, v.date)), v.date DESC) AS k FROM ev e CROSS JOIN {} v) WHERE k = 1)"
RESP = """resp AS (SELECT *,
  CASE WHEN rn >= 30 AND count(z) OVER b >= 15 AND count(z) OVER a >= 15 THEN avg(z) OVER a - avg(z) OVER b END AS post_pre,
  CASE WHEN rn >= 30 THEN avg(z) OVER a END AS post_only,
  CASE WHEN rn >= 30 THEN avg(z) OVER (PARTITION BY panel ORDER BY rn ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) END AS pre15,
  CASE WHEN rn >= 30 THEN avg(z) OVER b END AS pre30,
  CASE WHEN rn >= 30 AND count(z) OVER b >= 15 AND count(z) OVER a >= 15 THEN (avg(z) OVER a - avg(z) OVER b) / nullif(stddev_pop(z) OVER b, 0) END AS scaled
  FROM (SELECT *, e_div AS z FROM div)
  WINDOW a AS (PARTITION BY panel ORDER BY rn ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING), b AS (PARTITION BY panel ORDER BY rn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


def _events(spark):
    return spark.createDataFrame(EVENTS, "d string, label string, category string").select(F.to_date("d").alias("event_date"), "label", "category")


def _responses(spark, d):
    return E.nearest_rows(_events(spark), E.responses(_div(spark, d), "e_div"))


# ---- alignment


@query("nearest_event_date", f"WITH {IND}, {NEAR.format('ind')} SELECT label, rn FROM near")
def _(spark, d):
    return E.nearest_rows(_events(spark), _ind(spark, d)).select("label", "rn")


@query("union_events", f"WITH {EV}, b AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS DATE) AS event_date, 'error' AS label, 'log' AS category FROM events WHERE event_type = 'error') SELECT CAST(event_date AS VARCHAR) AS day, label, category FROM (SELECT * FROM ev UNION ALL SELECT * FROM b)")
def _(spark, d):
    days = T.table(spark, d, "events").where("event_type = 'error'").select(F.to_date("ts").alias("event_date")).distinct()
    more = days.withColumn("label", F.lit("error")).withColumn("category", F.lit("log"))
    return _events(spark).unionByName(more).select(F.col("event_date").cast("string").alias("day"), "label", "category")


@query("event_dummy", f"WITH {IND}, {NEAR.format('ind')} SELECT i.rn, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE abs(n.rn - i.rn) <= 2) THEN 1 ELSE 0 END AS dummy FROM ind i")
def _(spark, d):
    i = _ind(spark, d)
    return E.event_dummy(i, E.nearest_rows(_events(spark), i).select("rn")).select("rn", "dummy")


@query("asof_backward", "SELECT l.event_id, round(b.value, 6) + 0.0 AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON l.user_id = b.user_id AND l.ts >= b.ts")
def _(spark, d):
    e = T.table(spark, d, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return E.as_of(left, right, "ts", "last_purchase", ["user_id"]).select("event_id", r("last_purchase").alias("last_purchase"))


@query("reindex_ffill", "WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS h), v AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT strftime(h.h, '%Y-%m-%d %H') AS hour, last_value(n IGNORE NULLS) OVER (ORDER BY h.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM h LEFT JOIN v ON h.h = v.h")
def _(spark, d):
    hours = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-30 23:00:00', interval 1 hour)) AS h")
    key = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")
    v = T.table(spark, d, "events").where("event_type = 'error'").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    grid = hours.select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), F.lit("PE").alias("panel"))
    return grid.join(v, "hour", "left").select("hour", S.pad(F.col("n"), S.series("panel", order="hour")).alias("n"))


# ---- responses

for _name, _columns in {
    "delta_sigma_post_pre": ["post_pre"],
    "delta_sigma_modes": ["post_only", "pre15", "pre30"],
    "delta_sigma_scaled": ["scaled"],
}.items():

    @query(_name, f"WITH {DIV}, {RESP}, {NEAR.format('resp')} SELECT label, rn, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _columns) + " FROM near")
    def _(spark, d, columns=_columns):
        return _responses(spark, d).select("label", "rn", *[r(c).alias(c) for c in columns])


@query("category_event_mean", f"WITH {DIV}, {RESP}, {NEAR.format('resp')} SELECT category, count(post_pre) AS n, round(avg(post_pre), 6) + 0.0 AS mean_response FROM near GROUP BY category")
def _(spark, d):
    return _responses(spark, d).groupBy("category").agg(F.count("post_pre").alias("n"), r(F.avg("post_pre")).alias("mean_response"))


@query("pointwise_z28", f"WITH {IND} SELECT rn, CASE WHEN count(l1) OVER w >= 28 THEN round((l1 - avg(l1) OVER w) / nullif(stddev_samp(l1) OVER w, 0), 6) + 0.0 END AS z FROM ind WINDOW w AS (ORDER BY rn ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return _ind(spark, d).select("rn", r(S.trailing_z(F.col("l1"), S.series("panel"))).alias("z"))


@query("window_z28", f"WITH {IND} SELECT rn, CASE WHEN count(l1) OVER w >= 28 AND count(l1) OVER a >= 10 THEN round((avg(l1) OVER a - avg(l1) OVER w) / nullif(stddev_samp(l1) OVER w, 0), 6) + 0.0 END AS z FROM ind WINDOW w AS (ORDER BY rn ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), a AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)")
def _(spark, d):
    return _ind(spark, d).select("rn", r(S.trailing_window_z(F.col("l1"), S.series("panel"))).alias("z"))


@query("fixed_baseline_response", f"WITH {IND}, b AS (SELECT count(l1) FILTER (rn >= 40 AND rn < 100) AS n_base, avg(l1) FILTER (rn >= 40 AND rn < 100) AS m, stddev_samp(l1) FILTER (rn >= 40 AND rn < 100) AS s, count(l1) FILTER (rn >= 100 AND rn < 130) AS n_event, avg(l1) FILTER (rn >= 100 AND rn < 130) AS em FROM ind) SELECT n_base, n_event, round((em - m) / s, 6) + 0.0 AS response FROM b")
def _(spark, d):
    return E.fixed_baseline(_ind(spark, d), "l1", (40, 100), (100, 130)).select("n_base", "n_event", r("response").alias("response"))


@query("alpha_invariants", f"WITH {DIV} SELECT rn, CASE WHEN n > 0 THEN round(k * 1.0 / n, 6) END AS alpha_naive, round(sqrt(q) / sqrt(greatest(n, 1)), 6) AS alpha_norm FROM (SELECT rn, (z_l1 IS NOT NULL)::INT + (z_unb IS NOT NULL)::INT AS n, coalesce((abs(z_l1) >= 2)::INT, 0) + coalesce((abs(z_unb) >= 2)::INT, 0) AS k, coalesce(z_l1 * z_l1, 0) + coalesce(z_unb * z_unb, 0) AS q FROM div)")
def _(spark, d):
    z = F.filter(F.array("z_l1", "z_unb"), lambda x: x.isNotNull())
    i = _div(spark, d).withColumn("z", z).withColumn("n", F.size("z"))
    k = F.size(F.filter("z", lambda x: F.abs(x) >= 2))
    q = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    return i.select("rn", F.when(F.col("n") > 0, r(k / F.col("n"))).alias("alpha_naive"), r(F.sqrt(q) / F.sqrt(F.greatest("n", F.lit(1)))).alias("alpha_norm"))


_PAIRD = f"{DIV}, long AS (SELECT rn, 'e_div' AS name, e_div AS z FROM div UNION ALL SELECT rn, 'l1', z_l1 FROM div UNION ALL SELECT rn, 'unb', z_unb FROM div)"


@query("pair_diffs", f"WITH {_PAIRD} SELECT a.rn, a.name || ' - ' || b.name AS pair, round(a.z - b.z, 6) + 0.0 AS diff FROM long a JOIN long b ON a.rn = b.rn AND a.name < b.name WHERE a.z IS NOT NULL AND b.z IS NOT NULL")
def _(spark, d):
    return _pair_diffs(spark, d).select("rn", "pair", r("diff").alias("diff"))


def _pair_diffs(spark, d):
    named = _div(spark, d).select("rn", F.col("e_div"), F.col("z_l1").alias("l1"), F.col("z_unb").alias("unb"))
    long = named.unpivot(["rn"], ["e_div", "l1", "unb"], "name", "z").where("z IS NOT NULL")
    a, b = long.select("rn", F.col("name").alias("x"), F.col("z").alias("zx")), long.select("rn", F.col("name").alias("y"), F.col("z").alias("zy"))
    return a.join(b, "rn").where("x < y").select("rn", F.concat_ws(" - ", "x", "y").alias("pair"), (F.col("zx") - F.col("zy")).alias("diff"))


@query("rank_by_abs", f"WITH {_PAIRD}, p AS (SELECT a.name || ' - ' || b.name AS pair, avg(a.z - b.z) AS m FROM long a JOIN long b ON a.rn = b.rn AND a.name < b.name GROUP BY 1) SELECT pair, rank() OVER (ORDER BY abs(m) DESC) AS place, round(100 * (1 - (rank() OVER (ORDER BY abs(m) DESC) - 1) / (count(*) OVER ())::DOUBLE), 4) AS percentile FROM p")
def _(spark, d):
    m = _pair_diffs(spark, d).groupBy("pair").agg(F.avg("diff").alias("m")).withColumn("p", F.lit(1))
    place = F.rank().over(Window.partitionBy("p").orderBy(F.desc(F.abs("m"))))
    n = F.count(F.lit(1)).over(Window.partitionBy("p"))
    return m.select("pair", place.alias("place"), r(100 * (1 - (place - 1) / n), 4).alias("percentile"))


# ---- signals and simulation

_SIM = """raw AS (SELECT *, coalesce({on}, false) AS raw FROM {src}),
held AS (SELECT *, coalesce(rn - max(CASE WHEN raw THEN rn END) OVER (PARTITION BY {k} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 5, false) AS held FROM raw),
pos AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY {k} ORDER BY rn), false) AS position, coalesce(price / lag(price) OVER (PARTITION BY {k} ORDER BY rn) - 1, 0) AS market FROM held),
flip AS (SELECT *, coalesce(position <> lag(position) OVER (PARTITION BY {k} ORDER BY rn), false) AS flip FROM pos),
strat AS (SELECT *, CASE WHEN {inv} THEN market ELSE 0.0 END - CASE WHEN flip THEN 0.0005 ELSE 0.0 END AS strategy FROM flip),
eq AS (SELECT *, exp(sum(ln(1 + strategy)) OVER (PARTITION BY {k} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM strat),
run AS (SELECT *, equity / max(equity) OVER (PARTITION BY {k} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM eq)"""
_METRICS = """SELECT {k}, count(*) AS n, round(arg_max(equity, rn) - 1, 6) + 0.0 AS total_return, round(pow(arg_max(equity, rn), 252.0 / count(*)) - 1, 6) + 0.0 AS cagr,
  round(stddev_samp(strategy) * sqrt(252), 6) AS volatility,
  round(CASE WHEN stddev_samp(strategy) * sqrt(252) > 1e-9 THEN (pow(arg_max(equity, rn), 252.0 / count(*)) - 1) / (stddev_samp(strategy) * sqrt(252)) ELSE 0 END, 6) + 0.0 AS growth_ratio,
  round(CASE WHEN stddev_samp(strategy) > 1e-12 THEN avg(strategy) / stddev_samp(strategy) * sqrt(252) ELSE 0 END, 6) + 0.0 AS mean_ratio,
  round(min(drawdown), 6) + 0.0 AS max_drawdown, round(avg(position::INT), 6) AS share_on, count(*) FILTER (flip) AS n_changes FROM run GROUP BY {k}"""
_ON = {
    "s1": "e_div >= 0.8",
    "s2": "e_div <= -0.5",
    "s3": "abs(z_l1) >= 1",
    "s4": "abs(z_unb) >= 1",
    "s5": "abs(z_l1) >= 1 OR abs(z_unb) >= 1",
    "s6": "abs(z_l1) >= 1 AND abs(z_unb) >= 1",
}


def _sim(on: str, direction: str = "short", src: str = "div", k: str = "panel") -> str:
    return _SIM.format(on=on, src=src, k=k, inv="NOT position" if direction == "short" else "position")


def _rounded(m, *keys):
    return m.select(*keys, "n", *[r(c).alias(c) for c in ("total_return", "cagr", "volatility", "growth_ratio", "mean_ratio", "max_drawdown", "share_on")], "n_changes")


@query("hysteresis", f"WITH {DIV}, {_sim(_ON['s1'])} SELECT rn, raw, held FROM held")
def _(spark, d):
    run = G.simulate(_div(spark, d), S.SIGNALS["s1"](), ["panel"])
    return run.select("rn", "raw", "held")


@query("signal_blocks", f"WITH {DIV}, {_sim(_ON['s1'])}, m AS (SELECT *, (held AND NOT coalesce(lag(held) OVER (ORDER BY rn), false))::INT AS s FROM held), b AS (SELECT *, sum(s) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM m), n AS (SELECT b, count(*) AS n FROM b WHERE held GROUP BY b) SELECT count(*) AS n_blocks, CAST(floor(avg(n)) AS BIGINT) AS block_length FROM n")
def _(spark, d):
    run = G.simulate(_div(spark, d), S.SIGNALS["s1"](), ["panel"])
    return G.signal_blocks(run, "held", ["panel"]).drop("panel")


for _direction in ("short", "long"):

    @query(f"simulate_{_direction}", f"WITH {DIV}, {_sim(_ON['s1'], _direction)} SELECT rn, position, round(strategy, 6) + 0.0 AS strategy, round(equity, 6) AS equity, round(drawdown, 6) + 0.0 AS drawdown FROM run")
    def _(spark, d, direction=_direction):
        run = G.simulate(_div(spark, d), S.SIGNALS["s1"](), ["panel"], direction)
        return run.select("rn", "position", *[r(c).alias(c) for c in ("strategy", "equity", "drawdown")])


@query("buy_hold", f"WITH {DIV}, {_sim('false')} " + _METRICS.format(k="panel"))
def _(spark, d):
    return _rounded(G.metrics(G.simulate(_div(spark, d), F.lit(False), ["panel"]), ["panel"]), "panel")


_GRID = ", ".join(f"('{k}')" for k in _ON)
_CASE = "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ON.items()) + " END"
_GSRC = "(SELECT d.*, name, side, name || '/' || side AS cfg FROM div d CROSS JOIN (VALUES " + _GRID + ") t(name) CROSS JOIN (VALUES ('short'), ('long')) u(side))"


@query("metrics_table", f"WITH {DIV}, {_SIM.format(on=_CASE, src=_GSRC, k='cfg', inv=chr(67) + 'ASE side WHEN ' + chr(39) + 'short' + chr(39) + ' THEN NOT position ELSE position END')} " + _METRICS.format(k="cfg"))
def _(spark, d):
    on = F.lit(None).cast("boolean")
    for name, signal in S.SIGNALS.items():
        on = F.when(F.col("name") == name, signal()).otherwise(on)
    grid = spark.createDataFrame([(n, s) for n in S.SIGNALS for s in ("short", "long")], "name string, side string")
    rows = _div(spark, d).crossJoin(F.broadcast(grid)).withColumn("cfg", F.concat_ws("/", "name", "side"))
    short = G.simulate(rows.where("side = 'short'"), on, ["cfg"], "short")
    long = G.simulate(rows.where("side = 'long'"), on, ["cfg"], "long")
    return _rounded(G.metrics(short.unionByName(long), ["cfg"]), "cfg")


@query("threshold_sensitivity", f"WITH {DIV}, {_SIM.format(on='e_div >= t / 10.0', src='(SELECT d.*, t FROM div d CROSS JOIN (SELECT unnest(range(5, 13)) AS t))', k='t', inv='NOT position')} " + _METRICS.format(k="t"))
def _(spark, d):
    steps = F.broadcast(spark.range(5, 13).withColumnRenamed("id", "t"))
    run = G.simulate(_div(spark, d).crossJoin(steps), F.col("e_div") >= F.col("t") / F.lit(10.0), ["t"])
    return _rounded(G.metrics(run, ["t"]), "t")


@query("half_split_rank", f"WITH {IND}, h AS (SELECT *, CASE WHEN rn < (SELECT (max(rn) + 1) / 2.0 FROM ind) THEN 0 ELSE 1 END AS half FROM ind WHERE l1 IS NOT NULL), k AS (SELECT half, rank() OVER (PARTITION BY half ORDER BY l1) + (count(*) OVER (PARTITION BY half, l1) - 1) / 2.0 AS a, rank() OVER (PARTITION BY half ORDER BY unb) + (count(*) OVER (PARTITION BY half, unb) - 1) / 2.0 AS b FROM h) SELECT half, round(corr(a, b), 6) AS rho FROM k GROUP BY half")
def _(spark, d):
    i = _ind(spark, d)
    n = i.groupBy("panel").agg(((F.max("rn") + 1) / 2).alias("mid"))
    h = i.where("l1 IS NOT NULL").join(F.broadcast(n), "panel").withColumn("half", (F.col("rn") >= F.col("mid")).cast("int"))
    ranked = h.select("half", S.average_rank(F.col("l1"), "half").alias("a"), S.average_rank(F.col("unb"), "half").alias("b"))
    return ranked.groupBy("half").agg(r(S.corr("a", "b")).alias("rho"))


_FOLDS = "n AS (SELECT max(rn) + 1 AS n FROM ind), f AS (SELECT k AS fold, k * 30 AS first, k * 30 + 120 AS mid, k * 30 + 150 AS last FROM n, unnest(range(0, CAST(floor((n - 150) / 30.0) AS BIGINT) + 1)) t(k) WHERE n >= 150)"


@query("walkforward_folds", f"WITH {IND}, {_FOLDS} SELECT fold, first, mid, last FROM f")
def _(spark, d):
    return G.folds(_ind(spark, d), 120, 30)


_WF = f"""{DIV}, {_FOLDS}, cut AS (SELECT fold, quantile_cont(e_div, 0.8) AS threshold FROM div JOIN f ON rn >= first AND rn < mid GROUP BY fold HAVING count(e_div) >= 30),
mk AS (SELECT *, price / lag(price) OVER (ORDER BY rn) - 1 AS market FROM div),
t AS (SELECT f.fold, mk.*, threshold, coalesce(e_div >= threshold, false) AS raw FROM mk JOIN f ON rn >= mid AND rn < last JOIN cut ON cut.fold = f.fold),
h AS (SELECT *, coalesce(rn - max(CASE WHEN raw THEN rn END) OVER (PARTITION BY fold ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 5, false) AS held FROM t),
p AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY fold ORDER BY rn), false) AS position FROM h),
s AS (SELECT *, CASE WHEN position THEN 0.0 ELSE coalesce(market, 0) END - CASE WHEN coalesce(position <> lag(position) OVER (PARTITION BY fold ORDER BY rn), false) THEN 0.0005 ELSE 0.0 END AS strategy FROM p)"""


@query("walkforward_oos", f"WITH {_WF} SELECT fold, rn, round(threshold, 6) + 0.0 AS threshold, position, round(strategy, 6) + 0.0 AS strategy FROM s")
def _(spark, d):
    return G.walk_forward(_div(spark, d), 120, 30).select("fold", "rn", r("threshold").alias("threshold"), "position", r("strategy").alias("strategy"))


@query("walkforward_summary", f"WITH {_WF} SELECT fold, count(*) AS n, round(exp(sum(ln(1 + strategy))) - 1, 6) + 0.0 AS strategy_return, round(exp(sum(ln(1 + coalesce(market, 0)))) - 1, 6) + 0.0 AS market_return FROM s GROUP BY fold")
def _(spark, d):
    w = G.walk_forward(_div(spark, d), 120, 30)
    total = lambda c: r(F.product(1 + c) - 1)
    return w.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), total(F.col("strategy")).alias("strategy_return"), total(F.coalesce("market", F.lit(0.0))).alias("market_return"))


@query("vix_matched_rule", f"WITH {IND}, {_FOLDS}, cut AS (SELECT fold, quantile_cont(l1, 0.7) AS threshold FROM ind JOIN f ON rn >= first AND rn < mid GROUP BY fold HAVING count(l1) >= 60) SELECT f.fold, rn, round(threshold, 6) AS threshold, coalesce(l1 >= threshold, false) AS \"on\" FROM ind JOIN f ON rn >= mid AND rn < last JOIN cut ON cut.fold = f.fold")
def _(spark, d):
    return G.matched_rate(_ind(spark, d), "l1", 120, 30, 0.3).select("fold", "rn", r("threshold").alias("threshold"), "on")


_TRIG = f"""{IND}, fw AS (SELECT *, lead(price, 20) OVER (ORDER BY rn) / price - 1 AS fwd FROM ind), hit AS (SELECT * FROM fw WHERE fwd <= (SELECT quantile_cont(fwd, 0.1) FROM fw)),
cl AS (SELECT *, sum(nw) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (SELECT *, CASE WHEN coalesce(rn - lag(rn) OVER (ORDER BY rn) > 15, true) THEN 1 ELSE 0 END AS nw FROM hit))"""


@query("forward_return_triggers", f"WITH {_TRIG} SELECT rn, round(fwd, 6) + 0.0 AS fwd, cluster FROM cl")
def _(spark, d):
    return G.triggers(_ind(spark, d)).select("rn", r("fwd").alias("fwd"), "cluster")


_PEAK = f"""{_TRIG}, st AS (SELECT cluster, min(rn) AS at FROM cl GROUP BY cluster),
pk AS (SELECT * FROM (SELECT s.cluster, s.at, i.rn AS peak_rn, i.price AS peak, row_number() OVER (PARTITION BY s.cluster ORDER BY i.price DESC, i.rn) AS k FROM st s JOIN ind i ON i.rn <= s.at AND i.rn > s.at - 25) WHERE k = 1),
tr AS (SELECT * FROM (SELECT p.cluster, p.peak_rn, p.peak, i.rn AS trough_rn, i.price AS trough, row_number() OVER (PARTITION BY p.cluster ORDER BY i.price, i.rn) AS k2 FROM pk p JOIN ind i ON i.rn >= p.peak_rn AND i.rn < p.peak_rn + 60) WHERE k2 = 1)"""


@query("peak_trough", f"WITH {_PEAK} SELECT cluster, peak_rn, trough_rn, round(trough / peak - 1, 6) + 0.0 AS fall FROM tr")
def _(spark, d):
    i = _ind(spark, d)
    return G.peaks_and_troughs(i, G.triggers(i)).select("cluster", "peak_rn", "trough_rn", r("fall").alias("fall"))


@query("leadlag_summary", f"WITH {_PEAK}, sig AS (SELECT rn FROM (SELECT rn, {'e_div'} FROM (SELECT * FROM (WITH {DIV} SELECT rn, e_div FROM div))) WHERE e_div >= 0.8), lg AS (SELECT cluster, min(s.rn) - any_value(peak_rn) AS lag FROM tr JOIN sig s ON s.rn BETWEEN peak_rn - 30 AND peak_rn + 30 GROUP BY cluster) SELECT count(*) FILTER (lag <= -3) AS n_lead, count(*) FILTER (lag > -3 AND lag <= 3) AS n_same, count(*) FILTER (lag > 3) AS n_lag, median(lag) AS middle FROM lg")
def _(spark, d):
    div = _div(spark, d)
    tops = G.peaks_and_troughs(div, G.triggers(div)).select("cluster", "peak_rn")
    sig = div.where("e_div >= 0.8").select("rn")
    near = sig.join(F.broadcast(tops), F.expr("rn BETWEEN peak_rn - 30 AND peak_rn + 30"))  # one row for each fall
    lags = near.groupBy("cluster", "peak_rn").agg((F.min("rn") - F.col("peak_rn")).alias("lag"))
    return lags.agg(F.count_if(F.expr("lag <= -3")).alias("n_lead"), F.count_if(F.expr("lag > -3 AND lag <= 3")).alias("n_same"), F.count_if(F.expr("lag > 3")).alias("n_lag"), F.median("lag").alias("middle"))


# ---- the live path

_CLS = f"{DIV}, c AS (SELECT *, CASE WHEN e_div >= 0.8 THEN 'policy' WHEN e_div <= -0.5 THEN 'strength' WHEN z_l1 >= 0.7 THEN 'volatile' ELSE 'calm' END AS cls FROM div), p AS (SELECT *, lag(cls) OVER (ORDER BY rn) AS prev FROM c)"


def _classes(spark, d):
    c = _div(spark, d).withColumn("cls", S.classify(F.col("e_div"), F.col("z_l1")))
    return c.withColumn("prev", F.lag("cls").over(S.series("panel")))


@query("classify_regime", f"WITH {_CLS} SELECT rn, cls FROM c")
def _(spark, d):
    return _classes(spark, d).select("rn", "cls")


@query("classification_changes", f"WITH {_CLS} SELECT rn, prev, cls FROM p WHERE prev IS NOT NULL AND prev <> cls")
def _(spark, d):
    return _classes(spark, d).where("prev IS NOT NULL AND prev <> cls").select("rn", "prev", "cls")


@query("trade_decision", f"WITH {_CLS} SELECT rn, CASE WHEN cls = prev THEN 'none' WHEN cls = 'policy' THEN 'close' WHEN cls = 'strength' THEN 'open_long' WHEN prev IN ('policy', 'strength') THEN 'close_to_neutral' ELSE 'none' END AS action FROM p")
def _(spark, d):
    return _classes(spark, d).select("rn", S.trade_action(F.col("prev"), F.col("cls")).alias("action"))


@query("monthly_live_summary", f"WITH {_CLS} SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (cls = 'policy') AS n_policy, count(*) FILTER (cls = 'strength') AS n_strength, count(*) FILTER (cls = 'volatile') AS n_volatile, count(*) FILTER (cls = 'calm') AS n_calm, round(avg(e_div), 6) + 0.0 AS mean_div, round(max(e_div), 6) + 0.0 AS max_div, round(min(e_div), 6) + 0.0 AS min_div FROM c GROUP BY 1")
def _(spark, d):
    c = _classes(spark, d).groupBy(F.date_format("date", "yyyy-MM").alias("month"))
    counts = [F.count_if(F.col("cls") == k).alias(f"n_{k}") for k in ("policy", "strength", "volatile", "calm")]
    return c.agg(F.count(F.lit(1)).alias("n"), *counts, r(F.avg("e_div")).alias("mean_div"), r(F.max("e_div")).alias("max_div"), r(F.min("e_div")).alias("min_div"))


@query("live_cumulative", f"WITH {_CLS}, k AS (SELECT cls, count(*) AS n FROM c GROUP BY cls) SELECT (SELECT cls FROM k ORDER BY n DESC, cls LIMIT 1) AS commonest, (SELECT arg_max(rn, e_div) FROM c) AS highest_rn, (SELECT arg_min(rn, e_div) FROM c) AS lowest_rn, (SELECT count(*) FROM p WHERE prev IS NOT NULL AND prev <> cls) AS n_changes")
def _(spark, d):
    c = _classes(spark, d)
    top = c.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("cls", F.struct((-F.col("n")).alias("k"), "cls")).alias("commonest"))
    rest = c.agg(F.max_by("rn", "e_div").alias("highest_rn"), F.min_by("rn", "e_div").alias("lowest_rn"), F.count_if(F.expr("prev IS NOT NULL AND prev <> cls")).alias("n_changes"))
    return top.crossJoin(rest)


#: Fixed values. What the live score falls back on with fewer than 30 rows in the last 90 days: mean and deviation.
LIVE_L1 = (1.045, 0.312)


@query("live_z90", f"WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1e6 AS l1 FROM orders GROUP BY 1), z AS (SELECT *, count(l1) OVER w AS n, avg(l1) OVER w AS m, stddev_samp(l1) OVER w AS s FROM o WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) SELECT CAST(date AS VARCHAR) AS day, n, round(CASE WHEN n >= 30 THEN (l1 - m) / nullif(s, 0) ELSE (l1 - {LIVE_L1[0]}) / {LIVE_L1[1]} END, 6) + 0.0 AS z FROM z")
def _(spark, d):
    """Days, not rows: of the 90 calendar days before, those that have a value; the day itself is left out."""
    o = T.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1e6).alias("l1"))
    w = Window.partitionBy("panel").orderBy(F.unix_date("date")).rangeBetween(-90, -1)
    o = o.withColumn("panel", F.lit("PX")).withColumn("n", F.count("l1").over(w))
    own = (F.col("l1") - F.avg("l1").over(w)) / F.nullif(F.stddev_samp("l1").over(w), F.lit(0.0))
    z = F.when(F.col("n") >= 30, own).otherwise((F.col("l1") - LIVE_L1[0]) / LIVE_L1[1])
    return o.select(F.col("date").cast("string").alias("day"), "n", r(z).alias("z"))


@query("event_sessions", "WITH s AS (SELECT *, CASE WHEN coalesce(epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 7200, true) THEN 1 ELSE 0 END AS nw FROM events), t AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM s) SELECT user_id, session, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM t GROUP BY 1, 2")
def _(spark, d):
    e = E.sessions(T.table(spark, d, "events"), "user_id", "ts", 7200)
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


@query("newest_events", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def _(spark, d):
    return T.newest(T.table(spark, d, "events").select("event_id", "user_id"), "event_id", 50)


@query("health_check", "SELECT count(*) AS n_rows, CAST(max(ts) AS DATE)::VARCHAR AS last_day, count(DISTINCT user_id) AS n_users, count(*) FILTER (value IS NULL) AS n_missing FROM events")
def _(spark, d):
    e = T.table(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").cast("date").cast("string").alias("last_day"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value").isNull()).alias("n_missing"))


@query("balance_history", "WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM events) SELECT user_id, day::VARCHAR AS day, round(arg_max(b, event_id), 4) + 0.0 AS balance FROM b GROUP BY user_id, day")
def _(spark, d):
    e = T.table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return T.daily_balance(e, "day", "event_id", "value", "user_id").select("user_id", "day", r("balance", 4).alias("balance"))


@query("event_density", "WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS density_15d, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS density_30d, CAST(gap AS INT) AS days_since, CASE WHEN gap > 0 THEN round(ln(1 + 30.0 / gap), 6) END AS log_inv_gap FROM e")
def _(spark, d):
    e = T.table(spark, d, "events").withColumn("day", F.unix_date(F.col("ts").cast("date")))
    w = Window.partitionBy("user_id").orderBy("day")
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    counts = [F.count(F.lit(1)).over(w.rangeBetween(-n, -1)).alias(f"density_{n}d") for n in (15, 30)]
    return e.select("event_id", *counts, gap.alias("days_since"), F.when(gap > 0, r(F.log(1 + 30.0 / gap))).alias("log_inv_gap"))


# ---- targets, audits, comparisons

_TARGET = "(SELECT d.rn, d.e_div, d.z_l1, d.z_unb, x.symbol, x.pad AS price FROM div d JOIN ret x ON x.rn = d.rn WHERE x.pad IS NOT NULL)"


@query("target_backtest", f"WITH {DIV}, {_SIM.format(on=_ON['s1'], src=_TARGET, k='symbol', inv='NOT position')} " + _METRICS.format(k="symbol"))
def _(spark, d):
    rets = P.returns(T.brand_panel(spark, d))
    div = G.divergence(G.index_series(rets)).select("rn", "e_div", "z_l1", "z_unb")
    rows = rets.where("pad IS NOT NULL").select("rn", "symbol", F.col("pad").alias("price")).join(div, "rn")
    return _rounded(G.metrics(G.simulate(rows, S.SIGNALS["s1"](), ["symbol"]), ["symbol"]), "symbol")


@query("lookahead_audit", f"WITH {DIV}, f AS (SELECT z_l1 AS a, (l1 - avg(l1) OVER ()) / stddev_samp(l1) OVER () AS b FROM div) SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mean_gap, round(max(abs(a - b)), 6) AS max_gap, round(corr(a, b), 6) AS c FROM f WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    f = _div(spark, d).select(F.col("z_l1").alias("a"), S.full_z(F.col("l1"), "panel").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    gap = F.abs(F.col("a") - F.col("b"))
    return f.agg(F.count(F.lit(1)).alias("n"), r(F.avg(gap)).alias("mean_gap"), r(F.max(gap)).alias("max_gap"), r(S.corr("a", "b")).alias("c"))


@query("full_quantile_rule", f"WITH {DIV}, {_sim('l1 >= (SELECT quantile_cont(l1, 0.7) FROM div)')} " + _METRICS.format(k="panel"))
def _(spark, d):
    div = _div(spark, d)
    cut = div.groupBy("panel").agg(F.percentile("l1", F.lit(0.7)).alias("cut"))
    run = G.simulate(div.join(F.broadcast(cut), "panel"), F.col("l1") >= F.col("cut"), ["panel"])
    return _rounded(G.metrics(run, ["panel"]), "panel")


@query("forward_return_by_class", f"WITH {_CLS}, w AS (SELECT cls, lead(price, 20) OVER (ORDER BY rn) / price - 1 AS fwd FROM c) SELECT cls, count(fwd) AS n, round(avg(fwd), 6) + 0.0 AS mean_fwd, round(median(fwd), 6) + 0.0 AS median_fwd FROM w GROUP BY cls")
def _(spark, d):
    w = _classes(spark, d).select("cls", S.forward_return(F.col("price"), S.series("panel"), 20).alias("fwd"))
    return w.groupBy("cls").agg(F.count("fwd").alias("n"), r(F.avg("fwd")).alias("mean_fwd"), r(F.median("fwd")).alias("median_fwd"))


_RESPONSE = "(SELECT (avg(l1) FILTER (rn >= 100 AND rn < 130) - avg(l1) FILTER (rn >= 40 AND rn < 100)) / stddev_samp(l1) FILTER (rn >= 40 AND rn < 100) AS v FROM {})"


@query(
    "exclusion_verdict",
    f"WITH {IND}, less AS (SELECT rn, stddev_samp(ret) AS l1 FROM ret WHERE symbol NOT LIKE 'Brand#1%' GROUP BY rn), "
    f"b AS (SELECT a.v AS base, x.v AS less FROM {_RESPONSE.format('ind')} a, {_RESPONSE.format('less')} x) "
    "SELECT round(base, 6) + 0.0 AS base, round(less, 6) + 0.0 AS excluded, round(abs(base - less), 6) AS diff_abs, round(abs(base - less) / abs(base), 6) AS diff_rel, sign(base) = sign(less) AS sign_preserved, abs(base - less) <= 0.5 AS robust FROM b",
)
def _(spark, d):
    rets = P.returns(T.brand_panel(spark, d))
    one = lambda x, name: E.fixed_baseline(G.index_series(x), "l1", (40, 100), (100, 130)).select("panel", F.col("response").alias(name))
    both = one(rets, "base").join(one(rets.where("NOT startswith(symbol, 'Brand#1')"), "less"), "panel")
    gap = F.abs(F.col("base") - F.col("less"))
    return both.select(r("base").alias("base"), r("less").alias("excluded"), r(gap).alias("diff_abs"), r(gap / F.abs("base")).alias("diff_rel"), (F.signum("base") == F.signum("less")).alias("sign_preserved"), (gap <= 0.5).alias("robust"))


@query("onset_backtrace", f"WITH {_TRIG}, st AS (SELECT cluster, min(rn) AS began FROM cl GROUP BY cluster), m AS (SELECT s.cluster, s.began, d.rn, d.e_div, row_number() OVER (PARTITION BY s.cluster ORDER BY d.rn DESC) AS k FROM st s JOIN (WITH {DIV} SELECT rn, e_div FROM div) d ON d.rn <= s.began AND d.rn > s.began - 30 WHERE d.e_div >= 0.5), g AS (SELECT *, coalesce(lag(rn) OVER (PARTITION BY cluster ORDER BY rn DESC), began) - rn AS gap FROM m), b AS (SELECT *, sum(CASE WHEN gap > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM g) SELECT cluster, min(rn) AS onset, any_value(began) - min(rn) AS lag FROM b WHERE broken = 0 GROUP BY cluster")
def _(spark, d):
    """From a cluster's first row back over rows of high divergence, with at most three lower rows between two of them
    and thirty rows in all."""
    div = _div(spark, d)
    start = G.triggers(div).groupBy("cluster").agg(F.min("rn").alias("at"))
    high = div.where("e_div >= 0.5").select("rn").join(F.broadcast(start), F.expr("rn <= at AND rn > at - 30"))  # a row a cluster
    w = Window.partitionBy("cluster").orderBy(F.desc("rn"))
    gap = high.withColumn("gap", F.coalesce(F.lag("rn").over(w), F.col("at")) - F.col("rn"))
    broken = gap.withColumn("broken", F.sum((F.col("gap") > 4).cast("int")).over(S.upto(w))).where("broken = 0")
    return broken.groupBy("cluster", "at").agg(F.min("rn").alias("onset")).select("cluster", "onset", (F.col("at") - F.col("onset")).alias("lag"))


@query("subsample_ci", f"WITH {IND}, s AS (SELECT rn % 7 AS part, avg(l1) AS m FROM ind WHERE l1 IS NOT NULL GROUP BY 1) SELECT count(*) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) AS t FROM s")
def _(spark, d):
    s = _ind(spark, d).where("l1 IS NOT NULL").groupBy((F.col("rn") % 7).alias("part")).agg(F.avg("l1").alias("m"))
    p = lambda q: r(F.percentile("m", F.lit(q)))
    return s.agg(F.count(F.lit(1)).alias("n"), p(0.025).alias("low"), p(0.975).alias("high"), r(F.avg("m") / (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))), 4).alias("t"))
