"""Queries over the star schema's panels, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrolla.functions import series as S
from corrolla.operators import correlation as C, events as E, panel as P, signals as G
from corrolla.sources import tables as T
from corrolla.sources.shared import settled

W = 30
_QUERIES: dict = {}
_SQL: dict[str, str] = {}

PX = """px AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RET = PX + """, dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn FROM (SELECT DISTINCT date FROM px)),
grid AS (SELECT s.symbol, d.date, d.rn, p.close FROM (SELECT DISTINCT symbol FROM px) s CROSS JOIN dt d LEFT JOIN px p ON p.symbol = s.symbol AND p.date = d.date),
padded AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM grid),
ret AS (SELECT *, pad / lag(pad) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM padded)"""
PAIRS = RET + f""", whole AS (SELECT *, count(ret) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) = {W} AS whole FROM ret),
slid AS (SELECT a.rn, a.date, a.symbol AS u, b.symbol AS v, a.whole AND b.whole AS whole,
  corr(a.ret, b.ret) OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.rn ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS c
  FROM whole a JOIN whole b ON a.rn = b.rn AND a.symbol < b.symbol),
pairs AS (SELECT rn, date, u, v, round(CASE WHEN NOT isnan(c) THEN c END, 12) AS r FROM slid WHERE whole),
edges AS MATERIALIZED (SELECT *, abs(r) AS w, CAST(sign(r) AS INT) AS s FROM pairs WHERE abs(r) >= 0.3)"""
IND = RET + """, ind AS (SELECT 'PX' AS panel, rn, date, avg(pad) AS price, stddev_samp(ret) AS l1, CAST(count(*) FILTER (ret < 0) AS DOUBLE) AS unb
  FROM ret GROUP BY rn, date)"""


def _zsql(c: str, least: int, frame: str = "UNBOUNDED PRECEDING AND CURRENT ROW", sd: str = "stddev_samp") -> str:
    w = f"OVER (PARTITION BY panel ORDER BY rn ROWS BETWEEN {frame})"
    return f"CASE WHEN count({c}) {w} >= {least} THEN ({c} - avg({c}) {w}) / nullif({sd}({c}) {w}, 0) END"


DIV = IND + f""", zed AS (SELECT *, {_zsql('l1', 30)} AS z_l1, {_zsql('unb', 30)} AS z_unb FROM ind),
div AS (SELECT *, z_unb - z_l1 AS e_div FROM zed)"""


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql.strip()
        return f

    return put


def query_of(name: str):
    return _QUERIES[name]


def r(c, n: int = 6):
    """Rounded, and without a negative zero, so that engines which add in another order agree."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


def _rets(spark, d) -> DataFrame:
    return settled(P.returns(T.brand_panel(spark, d)), "returns")


def _pairs(spark, d) -> DataFrame:
    return C.rolling_pairs(_rets(spark, d), W)


def _ind(spark, d) -> DataFrame:
    return G.index_series(_rets(spark, d))


def _div(spark, d, least: int = 30) -> DataFrame:
    return G.divergence(_ind(spark, d), least)


# ---- panels, returns, coverage


@query("returns_pad", f"WITH {RET} SELECT symbol, rn, round(pad, 8) AS pad, round(ret, 6) + 0.0 AS ret FROM ret")
def _(spark, d):
    return _rets(spark, d).select("symbol", "rn", F.round("pad", 8).alias("pad"), r("ret").alias("ret"))


@query("available_universe", f"WITH {RET} SELECT rn, count(close) AS n_symbols FROM grid GROUP BY rn")
def _(spark, d):
    return P.dense(T.brand_panel(spark, d)).groupBy("rn").agg(F.count("close").alias("n_symbols"))


@query("symbol_span", f"WITH {PX} SELECT symbol, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(close) AS n_obs FROM px WHERE close IS NOT NULL GROUP BY symbol")
def _(spark, d):
    return P.coverage(T.brand_panel(spark, d)).select("symbol", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), "n_obs")


@query("yearly_universe_stats", f"WITH {RET}, a AS (SELECT date, count(close) AS n FROM grid GROUP BY date) SELECT year(date) AS yr, min(n) AS least, median(n) AS middle, max(n) AS most FROM a GROUP BY 1")
def _(spark, d):
    a = P.available(P.dense(T.brand_panel(spark, d)))
    return a.groupBy(F.year("date").alias("yr")).agg(F.min("n_symbols").alias("least"), F.median("n_symbols").alias("middle"), F.max("n_symbols").alias("most"))


@query("breakpoints", f"WITH {RET}, a AS (SELECT rn, count(close) AS n FROM grid GROUP BY rn), b AS (SELECT *, lag(n) OVER (ORDER BY rn) AS p FROM a) SELECT rn, n FROM b WHERE p IS NULL OR n <> p")
def _(spark, d):
    a = P.dense(T.brand_panel(spark, d)).groupBy("rn").agg(F.count("close").alias("n")).withColumn("panel", F.lit("PX"))
    before = F.lag("n").over(S.series("panel"))
    return a.withColumn("p", before).where("p IS NULL OR n <> p").select("rn", "n")


@query("first_full_date", f"WITH {PX}, a AS (SELECT date, count(close) AS n FROM px GROUP BY date), k AS (SELECT count(DISTINCT symbol) AS k FROM px) SELECT CAST(min(date) FILTER (n = k) AS VARCHAR) AS full_date, CAST(min(date) FILTER (n >= k - 1) AS VARCHAR) AS near_full_date, (SELECT CAST(max(f) AS VARCHAR) FROM (SELECT min(date) AS f FROM px GROUP BY symbol)) AS latest_first FROM a, k")
def _(spark, d):
    p = T.brand_panel(spark, d)
    a, k = P.available(p), p.agg(F.countDistinct("symbol").alias("k"))
    first = P.coverage(p).agg(F.max("first_date").cast("string").alias("latest_first"))
    full = lambda c: F.min(F.when(c, F.col("date"))).cast("string")
    out = a.crossJoin(F.broadcast(k)).agg(full(F.expr("n_symbols = k")).alias("full_date"), full(F.expr("n_symbols >= k - 1")).alias("near_full_date"))
    return out.crossJoin(first)


@query("live_fill", f"WITH {RET}, f AS (SELECT *, coalesce(last_value(ret IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(ret IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fill FROM ret), g AS (SELECT *, count(fill) OVER (PARTITION BY symbol) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM f) SELECT symbol, rn, round(coalesce(fill, 0), 6) + 0.0 AS fill FROM g WHERE k >= 0.8 * n")
def _(spark, d):
    return P.live_fill(T.brand_panel(spark, d)).select("symbol", "rn", r("fill").alias("fill"))


@query("dedupe_keep_last", "SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    e = T.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("m"))
    return e.select("user_id", "event_type", "m.event_id", r("m.value").alias("value"))


@query("upsert_latest", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    e = T.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return T.latest_by_key(e, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


# ---- correlation networks


@query("rolling_corr_pairs", f"WITH {PAIRS} SELECT rn, u, v, round(r, 6) + 0.0 AS r FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("rn", "u", "v", r("r").alias("r"))


@query("pairwise_corr_minperiods", f"WITH {RET} SELECT a.symbol AS u, b.symbol AS v, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(corr(a.ret, b.ret), 6) + 0.0 END AS r FROM ret a JOIN ret b ON a.rn = b.rn AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return C.pairwise(_rets(spark, d)).select("u", "v", "n", r("r").alias("r"))


@query("mean_abs_corr", f"WITH {PAIRS} SELECT rn, count(*) AS n_pairs, round(avg(r), 6) + 0.0 AS mean_r, round(avg(abs(r)), 6) AS mean_abs_r FROM pairs GROUP BY rn")
def _(spark, d):
    return _pairs(spark, d).groupBy("rn").agg(F.count(F.lit(1)).alias("n_pairs"), r(F.avg("r")).alias("mean_r"), r(F.avg(F.abs("r"))).alias("mean_abs_r"))


@query("signed_edges", f"WITH {PAIRS} SELECT rn, u, v, round(w, 6) AS w, s FROM edges")
def _(spark, d):
    return C.signed_edges(_pairs(spark, d)).select("rn", "u", "v", r("w").alias("w"), "s")


@query("graph_density", f"WITH {PAIRS}, n AS (SELECT rn, count(*) AS n FROM whole WHERE whole GROUP BY rn), m AS (SELECT rn, count(*) AS m, count(*) FILTER (s < 0) AS neg FROM edges GROUP BY rn) SELECT rn, n AS n_symbols, coalesce(m, 0) AS n_edges, coalesce(neg, 0) AS n_negative, round(2.0 * coalesce(m, 0) / (n * (n - 1)), 6) AS density, n - coalesce(m, 0) AS euler FROM n LEFT JOIN m USING (rn)")
def _(spark, d):
    rets = _rets(spark, d)
    n = P.complete_windows(rets, W).where("whole").groupBy("rn").agg(F.count(F.lit(1)).alias("n_symbols"))
    m = C.signed_edges(C.rolling_pairs(rets, W)).groupBy("rn").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("s") < 0).alias("n_negative"))
    out = n.join(m, "rn", "left").fillna(0, ["n_edges", "n_negative"])
    return out.withColumn("density", r(2.0 * F.col("n_edges") / (F.col("n_symbols") * (F.col("n_symbols") - 1)))).withColumn("euler", F.expr("n_symbols - n_edges"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("rn", F.col("u").alias("symbol")).unionByName(edges.select("rn", F.col("v").alias("symbol")))


@query("degree_centrality", f"WITH {PAIRS}, n AS (SELECT rn, symbol, count(*) OVER (PARTITION BY rn) AS n FROM whole WHERE whole), e AS (SELECT rn, symbol, count(*) AS deg FROM (SELECT rn, u AS symbol FROM edges UNION ALL SELECT rn, v FROM edges) GROUP BY 1, 2) SELECT n.rn, n.symbol, coalesce(deg, 0) AS degree, round(coalesce(deg, 0) / (n - 1.0), 6) AS centrality FROM n LEFT JOIN e ON n.rn = e.rn AND n.symbol = e.symbol")
def _(spark, d):
    rets = _rets(spark, d)
    n = P.complete_windows(rets, W).where("whole").select("rn", "symbol", F.count(F.lit(1)).over(Window.partitionBy("rn")).alias("n"))
    deg = _ends(C.signed_edges(C.rolling_pairs(rets, W))).groupBy("rn", "symbol").agg(F.count(F.lit(1)).alias("degree"))
    return n.join(deg, ["rn", "symbol"], "left").fillna(0, ["degree"]).select("rn", "symbol", "degree", r(F.expr("degree / (n - 1.0)").cast("double")).alias("centrality"))


@query("isolated_nodes", f"WITH {PAIRS} SELECT rn, symbol FROM whole w WHERE whole AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.rn = w.rn AND (e.u = w.symbol OR e.v = w.symbol))")
def _(spark, d):
    rets = _rets(spark, d)
    return P.complete_windows(rets, W).where("whole").select("rn", "symbol").join(_ends(C.signed_edges(C.rolling_pairs(rets, W))), ["rn", "symbol"], "left_anti")


@query("triangle_census", f"WITH {PAIRS} SELECT a.rn, count(*) AS n_triangles, count(*) FILTER (a.s * b.s * c.s < 0) AS n_unbalanced FROM edges a JOIN edges b ON a.rn = b.rn AND a.v = b.u JOIN edges c ON c.rn = a.rn AND c.u = a.u AND c.v = b.v GROUP BY a.rn")
def _(spark, d):
    return C.census(C.signed_edges(_pairs(spark, d)))


@query("mantegna_distance", f"WITH {PAIRS} SELECT rn, u, v, round(sqrt(greatest(0.0, 2 * (1 - coalesce(r, 0)))), 6) AS dist FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("rn", "u", "v", r(C.distance(F.col("r"))).alias("dist"))


@query("threshold_sweep_edges", f"WITH {PAIRS}, t AS (SELECT unnest(range(2, 19)) AS k) SELECT rn, k, count(*) AS n_edges FROM pairs JOIN t ON abs(r) >= k / 20.0 GROUP BY rn, k")
def _(spark, d):
    steps = spark.range(2, 19).withColumnRenamed("id", "k")
    hit = _pairs(spark, d).join(F.broadcast(steps), F.abs("r") >= F.col("k") / F.lit(20.0))
    return hit.groupBy("rn", "k").agg(F.count(F.lit(1)).alias("n_edges"))


@query("sign_flip_pairs", f"WITH {PAIRS} SELECT a.rn, a.u, a.v, round(a.r, 6) AS r, round(b.r, 6) AS r_before, round(abs(a.r - b.r), 6) AS change FROM edges a JOIN edges b ON a.rn = b.rn + {W} AND a.u = b.u AND a.v = b.v WHERE a.s <> b.s")
def _(spark, d):
    return C.sign_flips(_pairs(spark, d), W).where("flipped").select("rn", "u", "v", *[r(c).alias(c) for c in ("r", "r_before", "change")])


@query("sign_flip_rate", f"WITH {PAIRS} SELECT a.rn, count(*) AS n_both, round(avg(CASE WHEN a.s <> b.s THEN 1.0 ELSE 0.0 END), 6) AS flip_rate FROM edges a JOIN edges b ON a.rn = b.rn + {W} AND a.u = b.u AND a.v = b.v GROUP BY a.rn")
def _(spark, d):
    return C.sign_flips(_pairs(spark, d), W).groupBy("rn").agg(F.count(F.lit(1)).alias("n_both"), r(F.avg(F.col("flipped").cast("double"))).alias("flip_rate"))


@query("topk_pairs", f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY abs(r) DESC, u, v) AS k FROM pairs) SELECT rn, k, u, v, round(r, 6) AS r FROM k WHERE k <= 5")
def _(spark, d):
    w = Window.partitionBy("rn").orderBy(F.desc(F.abs("r")), "u", "v")
    return _pairs(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5").select("rn", "k", "u", "v", r("r").alias("r"))


@query("loo_mean_corr", f"WITH {PAIRS}, sy AS (SELECT DISTINCT symbol FROM px) SELECT s.symbol AS left_out, round(avg(r), 6) + 0.0 AS mean_r, count(*) AS n FROM pairs p JOIN sy s ON s.symbol <> p.u AND s.symbol <> p.v GROUP BY s.symbol")
def _(spark, d):
    p = _pairs(spark, d)
    one = p.groupBy("u", "v").agg(F.sum("r").alias("s"), F.count("r").alias("k"), F.count(F.lit(1)).alias("n"))  # what leaves with a symbol is subtracted
    total = one.agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"), F.sum("n").alias("tn"))
    ends = one.select(F.col("u").alias("left_out"), "s", "k", "n").unionByName(one.select(F.col("v").alias("left_out"), "s", "k", "n"))
    gone = ends.groupBy("left_out").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    return gone.crossJoin(F.broadcast(total)).select("left_out", r(F.expr("(ts - s) / (tk - k)")).alias("mean_r"), F.expr("tn - n").alias("n"))


@query("class_exclusion_corr", f"WITH {PAIRS}, c AS (SELECT DISTINCT substr(symbol, 1, 7) AS cls FROM px) SELECT c.cls AS excluded, round(avg(abs(r)), 6) AS mean_abs_r, count(*) AS n FROM pairs JOIN c ON substr(u, 1, 7) <> cls AND substr(v, 1, 7) <> cls GROUP BY cls")
def _(spark, d):
    p = _pairs(spark, d).withColumns({"cu": F.substring("u", 1, 7), "cv": F.substring("v", 1, 7)})
    sums = p.groupBy("cu", "cv").agg(F.sum(F.abs("r")).alias("s"), F.count("r").alias("k"), F.count(F.lit(1)).alias("n"))
    classes = F.broadcast(T.table(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("excluded")).distinct())
    out = sums.join(classes, F.expr("cu <> excluded AND cv <> excluded")).groupBy("excluded")
    return out.agg(r(F.expr("sum(s) / sum(k)")).alias("mean_abs_r"), F.sum("n").alias("n"))


@query("symbol_set_diff", f"WITH {PX} SELECT DISTINCT p_brand AS symbol FROM part WHERE p_size > 25 EXCEPT SELECT symbol FROM px WHERE close > 90000")
def _(spark, d):
    big = T.brand_panel(spark, d).where("close > 90000").select("symbol")
    return T.table(spark, d, "part").where("p_size > 25").select(F.col("p_brand").alias("symbol")).distinct().join(big, "symbol", "left_anti")


# ---- scores and statistics of series


for _n in (30, 60, 90):

    @query(f"expanding_z_{_n}", f"WITH {IND} SELECT rn, round({_zsql('l1', _n)}, 6) + 0.0 AS z_l1, round({_zsql('unb', _n)}, 6) + 0.0 AS z_unb FROM ind")
    def _(spark, d, n=_n):
        return _div(spark, d, n).select("rn", r("z_l1").alias("z_l1"), r("z_unb").alias("z_unb"))


@query("rolling_z_90", f"WITH {IND} SELECT rn, round({_zsql('l1', 30, '89 PRECEDING AND CURRENT ROW', 'stddev_pop')}, 6) + 0.0 AS z FROM ind")
def _(spark, d):
    return _ind(spark, d).select("rn", r(S.rolling_z(F.col("l1"), S.series("panel"), 90)).alias("z"))


@query("full_z", f"WITH {IND} SELECT rn, round((l1 - avg(l1) OVER ()) / stddev_samp(l1) OVER (), 6) + 0.0 AS z FROM ind")
def _(spark, d):
    return _ind(spark, d).select("rn", r(S.full_z(F.col("l1"), "panel")).alias("z"))


@query("baseline_z", f"WITH {IND}, b AS (SELECT avg(l1) AS m, stddev_samp(l1) AS s FROM ind WHERE rn BETWEEN 40 AND 99) SELECT rn, round((l1 - m) / s, 6) + 0.0 AS z FROM ind, b WHERE rn >= 100")
def _(spark, d):
    i = _ind(spark, d)
    b = i.where("rn BETWEEN 40 AND 99").groupBy("panel").agg(F.avg("l1").alias("m"), F.stddev_samp("l1").alias("s"))
    return i.where("rn >= 100").join(F.broadcast(b), "panel").select("rn", r(F.expr("(l1 - m) / s")).alias("z"))


@query("rolling_corr_252", f"WITH {IND} SELECT rn, CASE WHEN count(l1 + unb) OVER w = 252 THEN round(corr(l1, unb) OVER w, 6) + 0.0 END AS c FROM ind WINDOW w AS (ORDER BY rn ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return _ind(spark, d).select("rn", r(S.rolling_corr(F.col("l1"), F.col("unb"), S.series("panel"), 252)).alias("c"))


_RANKS = "rk AS (SELECT *, rank() OVER (ORDER BY l1) + (count(*) OVER (PARTITION BY l1) - 1) / 2.0 AS a, rank() OVER (ORDER BY unb) + (count(*) OVER (PARTITION BY unb) - 1) / 2.0 AS b FROM ind WHERE l1 IS NOT NULL)"


@query("spearman", f"WITH {IND}, {_RANKS} SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM rk")
def _(spark, d):
    i = _ind(spark, d).where("l1 IS NOT NULL")
    ranked = i.select(S.average_rank(F.col("l1"), "panel").alias("a"), S.average_rank(F.col("unb"), "panel").alias("b"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), r(S.corr("a", "b")).alias("rho"))


@query("partial_corr", f"WITH {IND}, c AS (SELECT corr(l1, unb) AS xy, corr(l1, price) AS xz, corr(unb, price) AS yz FROM ind WHERE l1 IS NOT NULL) SELECT round(xy, 6) AS raw, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c")
def _(spark, d):
    i = _ind(spark, d).where("l1 IS NOT NULL")
    c = i.agg(S.corr("l1", "unb").alias("xy"), S.corr("l1", "price").alias("xz"), S.corr("unb", "price").alias("yz"))
    den = F.expr("sqrt((1 - xz * xz) * (1 - yz * yz))")
    return c.select(r("xy").alias("raw"), r(F.when(den > 1e-12, F.expr("xy - xz * yz") / den)).alias("partial"))


@query("ols_residual", f"WITH {IND}, f AS (SELECT regr_slope(unb, l1) AS b, regr_intercept(unb, l1) AS a, regr_r2(unb, l1) AS r2 FROM ind WHERE l1 IS NOT NULL) SELECT rn, round(unb - a - b * l1, 6) + 0.0 AS residual, round(r2, 6) AS r2 FROM ind, f WHERE l1 IS NOT NULL")
def _(spark, d):
    i = _ind(spark, d).where("l1 IS NOT NULL")
    f = i.groupBy("panel").agg(F.regr_slope("unb", "l1").alias("b"), F.regr_intercept("unb", "l1").alias("a"), F.regr_r2("unb", "l1").alias("r2"))
    return i.join(F.broadcast(f), "panel").select("rn", r(F.expr("unb - a - b * l1")).alias("residual"), r("r2").alias("r2"))


@query("pc1_share", f"WITH {IND} SELECT round((1 + abs(corr(l1, unb))) / 2, 6) AS share FROM ind WHERE l1 IS NOT NULL")
def _(spark, d):
    return _ind(spark, d).where("l1 IS NOT NULL").agg(r((1 + F.abs(S.corr("l1", "unb"))) / 2).alias("share"))


@query("anova_f", "WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm FROM g) SELECT round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f FROM g, t")
def _(spark, d):
    g = T.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    # sum n (m - gm)^2 = sum n m^2 - (sum n m)^2 / sum n
    return g.agg(r(F.expr("((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(1) - 1)) / (sum(n * v) / (sum(n) - count(1)))")).alias("f"))


@query("weighted_mean", "SELECT round(sum(m * n) / sum(n), 6) AS weighted, round(avg(m), 6) AS plain FROM (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY 1)")
def _(spark, d):
    g = T.table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.agg(r(F.expr("sum(m * n) / sum(n)")).alias("weighted"), r(F.avg("m")).alias("plain"))


@query("histogram30", f"WITH {IND}, b AS (SELECT min(l1) AS lo, max(l1) AS hi FROM ind) SELECT CAST(least(29, floor((l1 - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, count(*) AS n FROM ind, b WHERE l1 IS NOT NULL GROUP BY 1")
def _(spark, d):
    i = _ind(spark, d).where("l1 IS NOT NULL")
    b = i.groupBy("panel").agg(F.min("l1").alias("lo"), F.max("l1").alias("hi"))
    return i.join(F.broadcast(b), "panel").groupBy(F.least(F.lit(29), F.floor(F.expr("(l1 - lo) / (hi - lo) * 30"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("percentile_band", f"WITH {IND} SELECT round(quantile_cont(l1, 0.05), 6) AS p05, round(quantile_cont(l1, 0.5), 6) AS p50, round(quantile_cont(l1, 0.95), 6) AS p95, round(avg(l1), 6) AS mean, round(stddev_samp(l1), 6) AS sd, round(stddev_pop(l1), 6) AS sd0 FROM ind WHERE l1 IS NOT NULL")
def _(spark, d):
    p = lambda x: r(F.percentile("l1", F.lit(x)))
    return _ind(spark, d).agg(p(0.05).alias("p05"), p(0.5).alias("p50"), p(0.95).alias("p95"), r(F.avg("l1")).alias("mean"), r(F.stddev_samp("l1")).alias("sd"), r(F.stddev_pop("l1")).alias("sd0"))


@query("smoothed_5", f"WITH {IND} SELECT rn, round(avg(l1) OVER (ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS s, round(price / first_value(price) OVER (ORDER BY rn) * 100, 4) AS rebased FROM ind")
def _(spark, d):
    w = S.series("panel")
    return _ind(spark, d).select("rn", r(F.avg("l1").over(S.trailing(w, 5))).alias("s"), r(S.rebased(F.col("price"), w), 4).alias("rebased"))


@query("universe_cross_corr", f"WITH {IND}, m AS (SELECT date_trunc('month', date) AS mo, avg(price) AS p FROM ind GROUP BY 1), o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, avg(o_totalprice) AS q FROM orders GROUP BY 1) SELECT count(*) AS n, round(corr(p, q), 6) AS c FROM m JOIN o ON CAST(m.mo AS DATE) = o.mo")
def _(spark, d):
    m = _ind(spark, d).groupBy(F.date_trunc("month", "date").cast("date").alias("mo")).agg(F.avg("price").alias("p"))
    o = T.table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("mo")).agg(F.avg("o_totalprice").alias("q"))
    return m.join(o, "mo").agg(F.count(F.lit(1)).alias("n"), r(S.corr("p", "q")).alias("c"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly brand panel -> padded returns -> all-pairs rolling correlation -> signed network by month."""
    rets = P.returns(T.brand_panel(spark, sf_dir, "month"))
    pairs = C.rolling_pairs(rets, 12)
    edges = C.signed_edges(pairs)
    by = pairs.groupBy("rn", "date").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.abs("r")).alias("mean_abs_r"))
    counts = edges.groupBy("rn").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("s") < 0).alias("n_negative"))
    return by.join(counts, "rn", "left").join(C.census(edges), "rn", "left").fillna(0, ["n_edges", "n_negative", "n_triangles", "n_unbalanced"])


def queries() -> dict:
    from corrolla.plans import basics, indicators, studies, topology  # noqa: F401  they add their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
