"""The whole path on the network indicators: series of windows -> scores -> divergence -> simulation, walk-forward, event
studies, scenarios. SQL can't say the first step, so none of it has SQL; the tests hold it against a plain version."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from corrolla.functions import series as S
from corrolla.operators import correlation as C, events as E, inference as I, panel as P, signals as G, topology as N
from corrolla.plans.registry import W, _div, query, query_of, r
from corrolla.plans.studies import _events, _rounded
from corrolla.plans.topology import ROBUST_OUT, ROBUST_TRIALS, classes_out, dealt_out, left_out, scenario_series, settled_pairs, symbols_of
from corrolla.sources import tables as T
from corrolla.sources.shared import settled

#: Fixed values. The indicators from bars and those from signed cycles.
HOLES = ["l1", "l2", "linf", "n_bars", "mean", "entropy"]
UNB = ["n_unb", "unb_3", "unb_4", "unb_5plus", "weighted_unb"]
EVERY = HOLES + UNB
#: Fixed values. Rows of the last two and four years of weeks; rows that a response's baseline and event have.
PERIODS = {"2y": 104, "4y": 208}
BASE, EVENT = (60, 120), (120, 150)


def indicators(spark, d) -> DataFrame:
    """(panel, rn, date, price, n_symbols, EVERY, unb) for every window, computed once; price is the mean padded price."""
    rets, pairs = settled_pairs(spark, d)
    price = rets.groupBy("rn").agg(F.avg("pad").alias("price"))
    cols = [F.col(c).cast("double").alias(c) for c in EVERY]
    out = N.gamma_series(rets, pairs, W).join(F.broadcast(price), "rn")
    return settled(out.select(F.lit("PX").alias("panel"), "rn", "date", "price", "n_symbols", *cols, F.col("n_unb").cast("double").alias("unb")), "indicators")


def divergence(spark, d, least: int = 30) -> DataFrame:
    return settled(G.divergence(indicators(spark, d), least), "divergence")


def _out(df: DataFrame, *keep: str) -> DataFrame:
    """df with doubles rounded, dates as text, and no names of panels."""
    kinds = dict(df.dtypes)
    return df.select(*[r(c).alias(c) if kinds[c] == "double" else F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c) for c in keep])


# ---- scores, signals, simulation


@query("gamma_divergence")
def _(spark, d):
    rows = divergence(spark, d).withColumn("cls", S.classify(F.col("e_div"), F.col("z_l1")))
    return _out(rows, "rn", "date", "n_symbols", "z_l1", "z_unb", "e_div", "cls")


@query("gamma_simulate")
def _(spark, d):
    return _out(G.simulate(divergence(spark, d), S.SIGNALS["s1"](), ["panel"]), "rn", "position", "strategy", "equity", "drawdown")


def signal_grid(rows: DataFrame, sides=("short", "long")) -> DataFrame:
    """rows for each signal and side (name, side, cfg), with whether the signal is on."""
    spark = rows.sparkSession
    on = F.lit(None).cast("boolean")
    for name, signal in S.SIGNALS.items():
        on = F.when(F.col("name") == name, signal()).otherwise(on)
    grid = spark.createDataFrame([(n, s) for n in S.SIGNALS for s in sides], "name string, side string")
    return rows.crossJoin(F.broadcast(grid)).withColumn("cfg", F.concat_ws("/", "name", "side")).withColumn("on", on)


@query("gamma_metrics")
def _(spark, d):
    """Six signals, two sides and holding all along, ranked by growth over volatility."""
    rows = divergence(spark, d)
    grid = signal_grid(rows)
    runs = [G.simulate(grid.where(F.col("side") == side), F.col("on"), ["cfg"], side) for side in ("short", "long")]
    hold = G.simulate(rows.withColumn("cfg", F.lit("hold")), F.lit(False), ["cfg"])
    m = G.metrics(runs[0].unionByName(runs[1]).unionByName(hold, allowMissingColumns=True), ["cfg"]).withColumn("_p", F.lit(1))
    rank = F.rank().over(Window.partitionBy("_p").orderBy(F.desc("growth_ratio")))
    return _rounded(m.withColumn("place", rank), "cfg", "place")


@query("gamma_periods")
def _(spark, d):
    """The short rule over the last years and all along, scores being made anew in each period."""
    rows = indicators(spark, d)
    last = rows.agg(F.max("rn").alias("_last"))
    ends = spark.createDataFrame([*PERIODS.items(), ("all", 1 << 30)], "period string, n_rows long")
    rows = rows.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(ends)).where("rn > _last - n_rows")
    run = G.simulate(G.divergence(rows, 30, "period"), S.SIGNALS["s1"](), ["period"])
    return _rounded(G.metrics(run, ["period"]), "period")


@query("gamma_same_day")
def _(spark, d):
    """The first simulator: the signal acts on its own day, at no cost and without holding on; with the share of days on which
    the strategy beats the market."""
    grid = signal_grid(divergence(spark, d))
    runs = [G.simulate(grid.where(F.col("side") == side), F.col("on"), ["cfg"], side, hold=0, lag=0, cost=0.0) for side in ("short", "long")]
    run = runs[0].unionByName(runs[1])
    wins = run.groupBy("cfg").agg(F.avg((F.col("strategy") > F.col("market")).cast("double")).alias("win_rate"))
    m = G.metrics(run, ["cfg"]).join(F.broadcast(wins), "cfg").withColumn("win_rate", r("win_rate"))
    return _rounded(m, "cfg", "win_rate")


#: Fixed values. Training and test rows, quantiles and sides of the walk-forward grid.
GRID = [(tr, te, q, side) for tr in (104, 156) for te in (26, 52) for q in (0.7, 0.8, 0.9) for side in ("short", "long")]


def _grid(spark, of):
    rows = [(f"{tr}/{te}/{q}/{side}", tr, te, q, side) for tr, te, q, side in of]
    return spark.createDataFrame(rows, "cfg string, train int, test int, share double, side string")


@query("gamma_walkforward")
def _(spark, d):
    run = G.walk_forward_grid(divergence(spark, d), _grid(spark, [(104, 52, 0.8, "short")]))
    return _out(run, "fold", "rn", "threshold", "position", "strategy")


@query("gamma_walkforward_grid")
def _(spark, d):
    run = settled(G.walk_forward_grid(divergence(spark, d), _grid(spark, GRID)), "grid")
    return _out(G.grid_summary(run), "cfg", "n", "n_folds", "total_return", "market_return", "alpha", "growth_ratio", "mean_ratio", "max_drawdown", "fold_ratio_mean", "fold_ratio_sd", "win_rate")


RANDOM_RUNS = 500


@query("gamma_oos_random")
def _(spark, d):
    """Out of sample: the rule beside holding, a rule on dispersion that is off as often, and random rules with as many blocks
    of the same length in each fold; how many of the random ones do better."""
    div = divergence(spark, d)
    run = settled(G.walk_forward_grid(div, _grid(spark, [(104, 52, 0.8, "short")])), "oos")
    v = S.series("fold")
    marked = run.withColumn("_s", (F.col("held") & ~F.coalesce(F.lag("held").over(v), F.lit(False))).cast("int"))
    folds = marked.groupBy("fold").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("_s").alias("blocks"), F.count_if("held").alias("_h"), F.avg(F.col("position").cast("double")).alias("cash"))
    folds = settled(folds.withColumn("fold", F.col("fold").cast("long")).withColumn("length", F.when(F.col("blocks") > 0, F.floor(F.col("_h") / F.col("blocks"))).otherwise(5)), "folds")
    spots = I.random_folds(folds.select("fold", "first", "n", "blocks", "length"), RANDOM_RUNS).withColumn("on", F.lit(True))
    base = run.select(F.col("fold").cast("long").alias("fold"), "rn", "pos", "market")
    every = spark.range(RANDOM_RUNS).withColumnRenamed("id", "trial").crossJoin(F.broadcast(base)).join(spots, ["trial", "fold", "pos"], "left").fillna(False, ["on"])
    random = G.returns_summary(_acted(every, "on", ["trial", "fold"]), "strategy", "trial")
    gauge = G.numbered_rows(G.index_series(_returns(spark, d)).select("rn", F.col("l1").alias("gauge")).join(div.select("panel", "rn"), "rn"), "panel").select("pos", "gauge")
    train = base.select("fold").distinct().join(F.broadcast(folds), "fold")
    known = gauge.join(F.broadcast(train), F.expr("pos >= first - 104 AND pos < first")).groupBy("fold", "cash").agg(F.collect_list("gauge").alias("g"))
    cut = known.where(F.size("g") >= 60).select("fold", G.quantile_of(F.col("g"), 1 - F.col("cash")).alias("threshold"))
    tested = base.join(gauge, "pos").withColumn("_c", F.avg(F.col("gauge").isNotNull().cast("double")).over(Window.partitionBy("fold"))).where("_c > 0.9").join(F.broadcast(cut), "fold")
    tested = tested.withColumn("on", S.hysteresis(F.coalesce(F.col("gauge") >= F.col("threshold"), F.lit(False)), S.series("fold")))
    kinds = [("signal", run.select("rn", "strategy")), ("hold", run.select("rn", F.col("market").alias("strategy"))), ("gauge", _acted(tested, "on", ["fold"]).select("rn", "strategy"))]
    rows = None
    for name, one in kinds:
        one = G.returns_summary(one.withColumn("kind", F.lit(name)), "strategy", "kind")
        rows = one if rows is None else rows.unionByName(one)
    own = rows.where("kind = 'signal'").select(*[F.col(c).alias(f"own_{c}") for c in ("total_return", "growth_ratio", "max_drawdown")])
    better = [F.avg((F.col(c) > F.col(f"own_{c}") if c == "max_drawdown" else F.col(c) >= F.col(f"own_{c}")).cast("double")).alias(f"p_{c}") for c in ("total_return", "growth_ratio", "max_drawdown")]
    p = random.crossJoin(F.broadcast(own)).agg(*better)
    out = rows.crossJoin(F.broadcast(p))
    only = lambda c: F.when(F.col("kind") == "signal", F.col(c)).alias(c)
    out = out.select("kind", "n", "total_return", "growth_ratio", "max_drawdown", *[only(f"p_{c}") for c in ("total_return", "growth_ratio", "max_drawdown")])
    return _out(out, *out.columns)


def _acted(rows: DataFrame, on: str, keys: list[str], cost: float = 0.0005) -> DataFrame:
    """rows with strategy: out of the market from the row after a signal, restarting with the keys."""
    v = S.series(*keys)
    out = rows.withColumn("position", F.lag(on, 1, False).over(v)).withColumn("_f", S.changed(F.col("position"), v))
    return out.withColumn("strategy", F.when(F.col("position"), 0.0).otherwise(F.col("market")) - F.when(F.col("_f"), cost).otherwise(0.0))


def _returns(spark, d):
    return P.returns(T.brand_panel(spark, d))


# ---- twelve indicators: alpha, pairs, variants


def scores(spark, d, least: int | None = None) -> DataFrame:
    """(panel, rn, date, name, z) for each indicator: scores against 90 rows, deviations of the population."""
    long = indicators(spark, d).unpivot(["panel", "rn", "date"], EVERY, "name", "x")
    return long.withColumn("z", S.rolling_z(F.col("x"), S.series("panel", "name"), 90)).drop("x")


@query("gamma_alpha")
def _(spark, d):
    """How many of the twelve indicators are two deviations off, and their joint size; the twelfth is the divergence of the
    scores, scored again."""
    z = settled(scores(spark, d), "scores")
    both = z.groupBy("panel", "rn", "date").agg(F.max(F.when(F.col("name") == "n_unb", F.col("z"))).alias("u"), F.max(F.when(F.col("name") == "l1", F.col("z"))).alias("l"))
    again = both.withColumn("z", S.rolling_z(F.col("u") - F.col("l"), S.series("panel"), 90)).select("panel", "rn", "date", F.lit("e_div").alias("name"), "z")
    by = z.unionByName(again).groupBy("rn").agg(F.count("z").alias("n"), F.count_if(F.abs("z") >= 2).alias("_k"), F.sum(F.col("z") * F.col("z")).alias("_q"))
    naive = F.when(F.col("n") > 0, F.col("_k") / F.col("n"))
    norm = F.sqrt(F.coalesce("_q", F.lit(0.0))) / F.sqrt(F.when(F.col("n") > 0, F.col("n")).otherwise(len(EVERY) + 1))
    return _out(by.withColumns({"alpha_naive": naive, "alpha_norm": norm}), "rn", "n", "alpha_naive", "alpha_norm")


def pair_scores(spark, d) -> DataFrame:
    """(panel, rn, date, pair, diff) for each pair of the eleven indicators, in the order of EVERY."""
    z = scores(spark, d).where("z IS NOT NULL")
    wide = z.groupBy("panel", "rn", "date").pivot("name", EVERY).agg(F.first("z"))
    pairs = [F.struct(F.lit(f"{a} - {b}").alias("pair"), (F.col(a) - F.col(b)).alias("diff")) for a, b in combinations(EVERY, 2)]
    out = wide.select("panel", "rn", "date", F.explode(F.array(*pairs)).alias("p")).select("panel", "rn", "date", "p.pair", "p.diff")
    return out.where("diff IS NOT NULL")


@query("gamma_pair_diffs")
def _(spark, d):
    return _out(pair_scores(spark, d), "rn", "pair", "diff")


@query("gamma_pair_rank")
def _(spark, d):
    """Where the divergence stands among all pairs' mean responses to each category of events, by size, and what that makes
    it: outstanding (A), one of several alike (C), or ordinary (B)."""
    ev = _events(spark)
    long = settled(pair_scores(spark, d), "pairs")
    rows = E.around(ev, long, ["diff"], ["pair"], least=15).join(F.broadcast(ev.select("label", "category")), "label")
    mean = rows.groupBy("category", "pair").agg(F.avg("d_diff").alias("m")).where("m IS NOT NULL").withColumn("a", F.abs("m"))
    w = Window.partitionBy("category")
    ranked = mean.withColumn("place", F.rank().over(w.orderBy(F.desc("a")))).withColumn("n_pairs", F.count(F.lit(1)).over(w))
    ranked = ranked.withColumn("_k", F.row_number().over(w.orderBy(F.desc("a"), "pair"))).withColumn("_top", F.greatest(F.lit(5), F.floor(F.col("n_pairs") / 10)))
    top = F.col("_k") <= F.col("_top")
    ranked = ranked.withColumn("_hi", F.max(F.when(top, F.col("a"))).over(w)).withColumn("_lo", F.min(F.when(top, F.col("a"))).over(w))
    above = [F.count_if(F.col("m") > -F.col("own")).alias("n_above"), F.count_if(F.col("m") < -F.col("own")).alias("n_below")]
    own = ranked.where("pair = 'l1 - n_unb'").select("category", F.col("m").alias("own"), "place", "n_pairs", "_hi", "_lo")
    signed = ranked.select("category", "m").join(F.broadcast(own.select("category", "own")), "category").groupBy("category").agg(*above)
    share = 100 * (1 - (F.col("place") - 1) / F.col("n_pairs"))
    pattern = F.when((F.col("share") >= 90) & (F.col("_lo") > 0) & (F.col("_hi") / F.col("_lo") < 1.5), "C").when(F.col("share") >= 90, "A").otherwise("B")
    out = own.join(signed, "category").withColumn("share", share).withColumn("pattern", pattern).withColumn("response", -F.col("own"))
    return _out(out, "category", "response", "n_pairs", "place", "share", "n_above", "n_below", "pattern")


def variants(rows: DataFrame, *keys: str) -> DataFrame:
    """rows for each indicator from cycles and each from bars (cfg): the divergence of their expanding scores."""
    w = S.series(*keys)
    scored = rows.select(*keys, "rn", "price", *[S.expanding_z(F.col(c), w, 30).alias(c) for c in EVERY])
    each = [F.struct(F.lit(f"{u} x {h}").alias("cfg"), (F.col(u) - F.col(h)).alias("e_div")) for u in UNB for h in HOLES]
    return scored.select(*keys, "rn", "price", F.explode(F.array(*each)).alias("v")).select(*keys, "rn", "price", "v.cfg", "v.e_div")


@query("gamma_variants")
def _(spark, d):
    run = G.simulate(variants(indicators(spark, d), "panel"), S.SIGNALS["s1"](), ["cfg"])
    return _rounded(G.metrics(run, ["cfg"]), "cfg")


@query("gamma_variant_halves")
def _(spark, d):
    """Rank correlation of the variants' worst drawdowns between the two halves, scores being made anew in each."""
    rows = G.numbered_rows(indicators(spark, d).where(F.col("l1").isNotNull()), "panel")
    n = rows.agg((F.floor((F.max("pos") + 1) / 2)).alias("mid"))
    halves = rows.crossJoin(F.broadcast(n)).withColumn("half", (F.col("pos") >= F.col("mid")).cast("int")).drop("pos", "mid")
    m = G.metrics(G.simulate(variants(halves, "panel", "half"), S.SIGNALS["s1"](), ["half", "cfg"]), ["half", "cfg"])
    ranked = m.select("half", "cfg", S.average_rank(F.col("max_drawdown"), "half").alias("k"))
    both = ranked.where("half = 0").select("cfg", F.col("k").alias("a")).join(ranked.where("half = 1").select("cfg", F.col("k").alias("b")), "cfg")
    return both.agg(F.count(F.lit(1)).alias("n"), r(S.corr("a", "b")).alias("rho"))


# ---- event studies


@query("gamma_responses")
def _(spark, d):
    rows = E.nearest_rows(_events(spark), E.responses(divergence(spark, d), "e_div"))
    return _out(rows, "label", "rn", "post_pre", "post_only", "pre15", "pre30", "scaled")


@query("gamma_category_study")
def _(spark, d):
    """Category by mode by indicator: mean response of the events that have one."""
    z = divergence(spark, d).select("panel", "rn", "date", *[F.col(c).alias(n) for c, n in (("z_l1", "l1"), ("z_unb", "unb"), ("e_div", "e_div"))])
    out = None
    for name in ("l1", "unb", "e_div"):
        one = E.nearest_rows(_events(spark), E.responses(z, name)).select("category", F.lit(name).alias("indicator"), "post_pre", "post_only", "pre15", "pre30")
        out = one if out is None else out.unionByName(one)
    long = out.unpivot(["category", "indicator"], ["post_pre", "post_only", "pre15", "pre30"], "mode", "v")
    return _out(long.groupBy("category", "mode", "indicator").agg(F.count("v").alias("n"), F.avg("v").alias("mean")), "category", "mode", "indicator", "n", "mean")


@query("gamma_local_study")
def _(spark, d):
    """Responses with scores made from the rows around each event alone."""
    own = E.local_scores(_events(spark), indicators(spark, d).where(F.col("l1").isNotNull()), ["l1", "unb"])
    own = own.withColumn("e_div", F.col("unb") - F.col("l1")).withColumnRenamed("label", "of")
    rows = E.around(_events(spark), own, ["l1", "unb", "e_div"], ["of"]).where("of = label")
    return _out(rows, "label", "n_pre", "n_post", "d_l1", "d_unb", "d_e_div")


@query("gamma_permutation")
def _(spark, d):
    rows = settled(E.responses(divergence(spark, d), "e_div"), "responses")
    return I.permutation_p(rows, E.nearest_rows(_events(spark), rows), "post_pre", "category")


@query("gamma_inference")
def _(spark, d):
    rows = settled(E.responses(divergence(spark, d), "e_div"), "responses")
    return I.mean_inference(rows, E.nearest_rows(_events(spark), rows), "post_pre", "category")


@query("leadlag_verdict")
def _(spark, d):
    div = divergence(spark, d)
    tops = G.peaks_and_troughs(div, G.triggers(div)).select("cluster", "peak_rn")
    near = F.broadcast(tops).join(div.where("e_div >= 0.8").select("rn"), F.expr("rn BETWEEN peak_rn - 30 AND peak_rn + 30"))
    lags = tops.join(near.groupBy("cluster").agg((F.min("rn") - F.min("peak_rn")).alias("lag")), "cluster", "left")
    return _out(G.lag_verdict(lags), "n_events", "n_cross", "n_lead", "n_same", "n_lag", "middle", "mean", "least", "most", "verdict")


# ---- causality


@query("gamma_granger")
def _(spark, d):
    div, out = divergence(spark, d), None
    for cause, effect in (("l1", "unb"), ("unb", "l1")):
        one = I.granger(div, cause, effect).withColumn("direction", F.lit(f"{cause}->{effect}"))
        out = one if out is None else out.unionByName(one)
    return _out(out, "direction", "lag", "n", "f", "p", "chi2", "p_chi2")


def _with_dummy(spark, d) -> DataFrame:
    rows = divergence(spark, d)
    spots = E.nearest_rows(_events(spark).where("category = 'policy'"), rows).select("rn")
    return settled(E.event_dummy(rows, spots).withColumn("dummy", F.col("dummy").cast("double")), "dummies")


@query("granger_verdict")
def _(spark, d):
    rows = _with_dummy(spark, d)
    return _out(I.granger_verdict(I.granger(rows, "dummy", "e_div"), I.granger(rows, "e_div", "dummy")), "p_forward", "p_backward", "verdict")


DAG = ["l1", "unb", "entropy", "linf", "weighted_unb", "price", "dummy"]


@query("gamma_dag")
def _(spark, d):
    return I.causal_edges(I.jittered(_with_dummy(spark, d), ["dummy"]), DAG)


@query("dag_confounders")
def _(spark, d):
    return I.confounders(query_of("gamma_dag")(spark, d))


# ---- scenarios


def scenario_divergence(spark, d, excluded, least: int = 30) -> DataFrame:
    """(scenario, rn, date, price, l1, unb, z_l1, z_unb, e_div) of each scenario and of `all`."""
    base = indicators(spark, d).select("rn", "date", "price")
    rows = scenario_series(spark, d, excluded).select("scenario", "rn", "l1", F.col("n_unb").cast("double").alias("unb"))
    return settled(G.divergence(rows.join(F.broadcast(base), "rn"), least, "scenario"), "scenarios")


@query("class_exclusion_backtest")
def _(spark, d):
    run = G.simulate(scenario_divergence(spark, d, classes_out(spark, d)), S.SIGNALS["s1"](), ["scenario"])
    return _rounded(G.metrics(run, ["scenario"]), "scenario")


#: Fixed values. Symbols left out, and seeds, of the backtest by size of the universe.
SIZES, SEEDS = [5, 10, 15], 3


@query("universe_size_backtest")
def _(spark, d):
    rows = scenario_divergence(spark, d, dealt_out(spark, d, SIZES, SEEDS))
    run = G.simulate(rows, S.SIGNALS["s1"](), ["scenario"], hold=0, lag=0, cost=0.0)
    wins = run.groupBy("scenario").agg(F.avg((F.col("strategy") > F.col("market")).cast("double")).alias("win_rate"))
    return _rounded(G.metrics(run, ["scenario"]).join(F.broadcast(wins), "scenario").withColumn("win_rate", r("win_rate")), "scenario", "win_rate")


def event_shifts(spark, d, excluded) -> DataFrame:
    """(scenario, label, d_e_div) and the whole universe's beside it: contribution is what leaves with the scenario's symbols."""
    rows = E.around(_events(spark), scenario_divergence(spark, d, excluded, 20), ["e_div"], ["scenario"])
    rows = settled(rows.select("scenario", "label", F.round("d_e_div", 3).alias("d_e_div")), "shifts")
    base = rows.where("scenario = 'all' AND d_e_div IS NOT NULL").select("label", F.col("d_e_div").alias("base"))
    return rows.where("scenario <> 'all'").join(F.broadcast(base), "label").withColumn("contribution", F.round(F.col("base") - F.col("d_e_div"), 3))


@query("loo_by_event")
def _(spark, d):
    return event_shifts(spark, d, left_out(spark, d)).select("label", F.col("scenario").alias("symbol"), "d_e_div", "contribution")


@query("loo_matrix")
def _(spark, d):
    """Symbols by events: what each symbol contributes."""
    rows = event_shifts(spark, d, left_out(spark, d))
    labels = [x[0] for x in _events(spark).select("label").orderBy("label").collect()]  # the fixed list of events
    return rows.groupBy(F.col("scenario").alias("symbol")).pivot("label", labels).agg(F.first("contribution"))


def sources(spark, d, top: int = 5) -> DataFrame:
    """The symbols that contribute most (source) and least (noise) to each event's shift."""
    rows = event_shifts(spark, d, left_out(spark, d)).where("contribution IS NOT NULL")
    w = Window.partitionBy("label")
    rows = rows.withColumn("_a", F.row_number().over(w.orderBy(F.desc("contribution"), "scenario"))).withColumn("_z", F.row_number().over(w.orderBy("contribution", F.desc("scenario"))))
    a = rows.where(F.col("_a") <= top).select("label", F.lit("source").alias("kind"), F.col("_a").alias("place"), F.col("scenario").alias("symbol"), "contribution")
    z = rows.where(F.col("_z") <= top).select("label", F.lit("noise").alias("kind"), F.col("_z").alias("place"), F.col("scenario").alias("symbol"), "contribution")
    return settled(a.unionByName(z), "sources")


@query("loo_sources")
def _(spark, d):
    return sources(spark, d)


def source_counts(rows: DataFrame) -> DataFrame:
    """For each symbol among the sources, in how many and which events, and whether in all, or in all but one (two at least)."""
    n = rows.agg(F.countDistinct("label").alias("_n"))
    by = rows.where("kind = 'source'").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_events"), F.array_join(F.sort_array(F.collect_list("label")), ",").alias("events"))
    reach = F.when(F.col("n_events") == F.col("_n"), "universal").when(F.col("n_events") >= F.greatest(F.lit(2), F.col("_n") - 1), "near universal").otherwise("some")
    return by.crossJoin(F.broadcast(n)).withColumn("reach", reach).drop("_n")


@query("source_index")
def _(spark, d):
    return source_counts(sources(spark, d))


@query("class_by_event")
def _(spark, d):
    """What leaves each event's shift with a class; more than half a deviation counts as a collapse."""
    rows = event_shifts(spark, d, classes_out(spark, d))
    return rows.select(F.col("scenario").alias("excluded"), "label", "d_e_div", "contribution", (F.col("contribution") > 0.5).alias("collapse"))


@query("core_block")
def _(spark, d):
    """The sources of most events removed together (of half the events or more, where none is near universal)."""
    found = source_counts(sources(spark, d))
    n = _events(spark).count()
    core = found.where((F.col("reach") != "some") | (F.col("n_events") * 2 >= n)).select(F.lit("core").alias("scenario"), "symbol")
    rows = event_shifts(spark, d, settled(core, "core"))
    return rows.select("label", "base", "d_e_div", F.col("contribution").alias("fall"), ((F.col("base") > 0) & (F.col("d_e_div") <= 0)).alias("flips"))


def baseline_responses(rows: DataFrame) -> DataFrame:
    """(scenario, l1, unb, e_div): each indicator's mean over EVENT in deviations of BASE, and their difference."""
    at = lambda x: (F.col("rn") >= x[0]) & (F.col("rn") < x[1])
    aggs = []
    for c in ("l1", "unb"):
        base, event = F.when(at(BASE), F.col(c)), F.when(at(EVENT), F.col(c))
        sd = F.when((F.count(base) >= 5) & (F.count(event) >= 3), F.nullif(F.stddev_samp(base), F.lit(0.0)))
        aggs.append(((F.avg(event) - F.avg(base)) / sd).alias(c))
    return rows.groupBy("scenario").agg(*aggs).withColumn("e_div", F.col("unb") - F.col("l1"))


@query("subsample_responses")
def _(spark, d):
    """Thirty trials that leave ten symbols out: the band of their responses, and whether the whole universe's lies in it."""
    rows = scenario_series(spark, d, dealt_out(spark, d, [ROBUST_OUT], ROBUST_TRIALS)).select("scenario", "rn", "l1", F.col("n_unb").cast("double").alias("unb"))
    long = settled(baseline_responses(rows), "responses").unpivot(["scenario"], ["l1", "unb", "e_div"], "indicator", "v")
    own = long.where("scenario = 'all'").select("indicator", F.col("v").alias("own"))
    p = lambda q: F.percentile("v", F.lit(q))
    band = long.where("scenario <> 'all'").groupBy("indicator").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), p(0.05).alias("p05"), p(0.95).alias("p95"))
    out = band.join(F.broadcast(own), "indicator").withColumn("diff", F.col("mean") - F.col("own")).withColumn("within", F.expr("own BETWEEN p05 AND p95"))
    return _out(out, "indicator", "n", "mean", "sd", "p05", "p95", "own", "diff", "within")


@query("reduction_responses")
def _(spark, d):
    """Progressively fewer symbols, three trials of each size: the divergence's response."""
    rows = scenario_series(spark, d, dealt_out(spark, d, SIZES, SEEDS)).select("scenario", "rn", "l1", F.col("n_unb").cast("double").alias("unb"))
    by = baseline_responses(rows).where("scenario <> 'all'").withColumn("size", F.substring_index("scenario", "/", 1))
    out = by.groupBy("size").agg(F.count("e_div").alias("n"), F.avg("e_div").alias("mean"), F.stddev_pop("e_div").alias("sd"), F.min("e_div").alias("least"), F.max("e_div").alias("most"))
    return _out(out, "size", "n", "mean", "sd", "least", "most")


def universes(spark, d) -> DataFrame:
    """Eight universes by the symbols that each leaves out."""
    names = symbols_of(spark, d).withColumn("k", F.substring("symbol", 7, 2).cast("int"))
    rules = {"odd": "k % 2 = 0", "even": "k % 2 = 1", "low": "k > 12", "high": "k <= 12", "ones": "symbol NOT LIKE 'Brand#1%'", "not ones": "symbol LIKE 'Brand#1%'", "middle": "k < 7 OR k > 19", "edges": "k BETWEEN 7 AND 19"}
    out = None
    for name, gone in rules.items():
        one = names.where(gone).select(F.lit(name).alias("scenario"), "symbol")
        out = one if out is None else out.unionByName(one)
    return settled(out, "universes")


@query("universe_patterns")
def _(spark, d):
    rows = event_shifts(spark, d, universes(spark, d))
    return rows.select(F.col("scenario").alias("universe"), "label", "d_e_div", (F.signum("d_e_div") == F.signum("base")).alias("same_sign"))


@query("shifted_panel_diff")
def _(spark, d):
    """The shifts of the divergence on a panel whose days begin later (as another time zone's would) beside the plain one's;
    half a deviation is tolerated."""
    out = None
    for name, hours in (("plain", 0), ("shifted", 30)):
        rets = settled(P.returns(T.brand_panel(spark, d, hours=hours)), "returns")
        g = N.gamma_series(rets, settled(C.rolling_pairs(rets, W), "pairs"), W).select(F.lit(name).alias("scenario"), "rn", "date", "l1", F.col("n_unb").cast("double").alias("unb"))
        one = E.around(_events(spark), G.divergence(g, 30, "scenario"), ["e_div"], ["scenario"]).select("label", F.col("d_e_div").alias(name))
        out = one if out is None else out.join(one, "label")
    return _out(out.withColumn("diff", F.col("shifted") - F.col("plain")).withColumn("within", F.abs("diff") <= 0.5), "label", "plain", "shifted", "diff", "within")


# ---- the battery of conjectures: one row each, with its statistic and verdict


def _judged(rows: DataFrame, name: str, value, support, refute) -> DataFrame:
    """(name, value, verdict) from one row; neutral where neither holds or the value is missing."""
    v = F.when(support, "support").when(refute, "refute").otherwise("neutral")
    return rows.select(F.lit(name).alias("name"), value.cast("double").alias("value"), F.when(value.isNull(), "neutral").otherwise(v).alias("verdict"))


def _rank_corr(rows: DataFrame, a: str, b: str) -> DataFrame:
    known = rows.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").withColumn("_p", F.lit(1))
    return known.select(S.average_rank(F.col(a), "_p").alias("_a"), S.average_rank(F.col(b), "_p").alias("_b")).agg(S.corr("_a", "_b").alias("v"))


@query("battery")
def _(spark, d):
    ind = indicators(spark, d)
    div = settled(G.divergence(ind, 30), "divergence")
    rets, pairs = settled_pairs(spark, d)
    parts = []
    odd = N.cycle_label_counts(pairs, ["rn"], [2, 3, 5]).join(ind.select("rn", "l1"), "rn")
    most = odd.groupBy("k").agg(F.abs(S.corr(F.col("l1"), F.col("n_odd").cast("double"))).alias("c")).agg(F.max("c").alias("v"))
    parts.append(_judged(most, "labels modulo k are independent", F.col("v"), F.col("v") < 0.3, F.col("v") >= 0.3))
    w90 = S.trailing(S.series("panel"), 90)
    z = lambda c: F.when(F.count(c).over(w90) >= 90, (F.col(c) - F.avg(c).over(w90)) / F.nullif(F.stddev_samp(c).over(w90), F.lit(0.0)))
    rolled = ind.select("rn", (z("unb") - z("l1")).alias("again"), (S.rolling_z(F.col("unb"), S.series("panel"), 90) - S.rolling_z(F.col("l1"), S.series("panel"), 90)).alias("e"))
    parts.append(_judged(rolled.where("again IS NOT NULL AND e IS NOT NULL").agg(S.corr("e", "again").alias("v")), "divergence is a difference of scores", F.col("v"), F.col("v") >= 0.95, F.lit(False)))
    alpha = query_of("gamma_alpha")(spark, d)
    parts.append(_judged(_rank_corr(alpha, "alpha_naive", "alpha_norm"), "the two sizes order alike", F.col("v"), F.col("v") >= 0.7, F.col("v") < 0.5))
    whole = E.around(_events(spark), div, ["e_div"], ["panel"]).agg(F.avg("d_e_div").alias("all"))
    names = symbols_of(spark, d)
    classes = names.select(F.substring("symbol", 1, 7).alias("scenario")).distinct().where("scenario IN ('Brand#1', 'Brand#2')")
    others = classes.crossJoin(F.broadcast(names)).where("substring(symbol, 1, 7) <> scenario")
    each = E.around(_events(spark), scenario_divergence(spark, d, others.select("scenario", "symbol")), ["e_div"], ["scenario"]).where("scenario <> 'all'").groupBy("scenario").agg(F.avg("d_e_div").alias("m"))
    size = names.groupBy(F.substring("symbol", 1, 7).alias("scenario")).agg(F.count(F.lit(1)).alias("k"))
    sub = each.join(size, "scenario").agg(F.max("m").alias("most"), (F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("mean"))
    both = settled(whole.crossJoin(F.broadcast(sub)), "classes")
    parts.append(_judged(both, "the whole shifts more than any class", F.col("all") - F.col("most"), F.col("all") > F.col("most"), F.col("all") <= F.col("most")))
    roll = ind.select(S.rolling_corr(F.col("l1"), F.col("unb"), S.series("panel"), 252).alias("c")).where("c IS NOT NULL")
    steady = roll.agg(F.when(F.count("c") >= 52, F.stddev_samp("c")).alias("v"), (F.min("c") * F.max("c") < 0).alias("flip"))
    parts.append(_judged(steady, "the correlation is steady", F.col("v"), (F.col("v") < 0.15) & ~F.col("flip"), (F.col("v") >= 0.3) | F.col("flip")))
    resp = E.nearest_rows(_events(spark), E.responses(div, "e_div")).where("post_only IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("post_only").alias("m"), F.var_pop("post_only").alias("q"))
    f = F.expr("try_divide((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / nullif(count(1) - 1, 0), sum(n * q) / nullif(sum(n) - count(1), 0))")
    parts.append(_judged(resp.agg(f.alias("v")), "categories stand apart", F.col("v"), F.col("v") > 2, F.col("v") < 1))
    wide = None
    for n in (20, 30, 60, 90):
        one = N.window_invariants(pairs if n == W else C.rolling_pairs(rets, n), ["rn"], {"cycles"}).select("rn", F.col("n_unb").alias(f"w{n}"))
        wide = one if wide is None else wide.join(one, "rn")
    wide = settled(wide, "widths")
    near = _rank_corr(wide, "w20", "w30").unionByName(_rank_corr(wide, "w30", "w60")).unionByName(_rank_corr(wide, "w60", "w90")).agg(F.min("v").alias("v"))
    parts.append(_judged(near, "neighbouring windows order alike", F.col("v"), F.col("v") >= 0.7, F.col("v") < 0.3))
    calm = ind.where("n_unb = 0").agg(F.when(F.count(F.lit(1)) >= 5, F.avg((F.col("n_bars") == 0).cast("double"))).alias("v"))
    parts.append(_judged(calm, "balanced windows have no bars", F.col("v"), F.col("v") >= 0.95, F.col("v") < 0.95))
    least = I.granger_verdict(I.granger(div, "l1", "unb"), I.granger(div, "unb", "l1"))
    parts.append(_judged(least, "one past adds to the other", F.col("p_forward"), F.col("verdict") == "forward", F.col("verdict") != "forward"))
    gap = F.col("all") - F.col("mean")
    parts.append(_judged(both, "classes add up to the whole", gap, (F.signum("all") == F.signum("mean")) & (F.abs(gap) < 1), F.lit(True)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return _out(out, "name", "value", "verdict")


# ---- targets


@query("target_corr")
def _(spark, d):
    """For each symbol: the correlation of the size of its returns with the divergence of the same row."""
    rets = P.returns(T.brand_panel(spark, d)).select("rn", "symbol", F.abs("ret").alias("a"))
    rows = rets.join(F.broadcast(_div(spark, d).select("rn", "e_div")), "rn").where("a IS NOT NULL AND e_div IS NOT NULL")
    return _out(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), S.corr("a", "e_div").alias("c")), "symbol", "n", "c")
