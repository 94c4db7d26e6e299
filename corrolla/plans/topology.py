"""Topology, graph invariants, scenarios and inference as queries. SQL can't say these; the tests hold them against
brute force, but for the ones whose result SQL can count."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corrolla.operators import correlation as C, inference as I, panel as P, signals as G, topology as N
from corrolla.plans.registry import PAIRS, W, _div, _pairs, _rets, query, query_of, r
from corrolla.plans.studies import _events, E
from corrolla.functions import series as S
from corrolla.sources import tables as T
from corrolla.sources.shared import settled


def settled_pairs(spark, d, n: int = W):
    """(rets, pairs), each computed once."""
    rets = _rets(spark, d)
    return rets, settled(C.rolling_pairs(rets, n), "pairs")


def gamma(spark, d, parts=frozenset({"topology", "cycles"}), include_last: bool = False):
    rets, pairs = settled_pairs(spark, d)
    return N.gamma_series(rets, pairs, W, parts, include_last)


@query("gamma_series")
def _(spark, d):
    g = gamma(spark, d)
    return g.select("rn", "date", "n_symbols", r("l1").alias("L1_H1"), "n_unb", "n_edges", r("balance_rate").alias("balance_rate"))


@query("gamma_newest")
def _(spark, d):
    """The live job's window: the newest rows alone, the last one included."""
    rets = _rets(spark, d)
    last = rets.groupBy().agg(F.max("rn").alias("_last"))
    rets = settled(rets.crossJoin(F.broadcast(last)).where(F.col("rn") > F.col("_last") - W - 1).drop("_last"), "newest")
    return N.gamma_series(rets, settled(C.rolling_pairs(rets, W), "pairs"), W, include_last=True).where("n_symbols > 0").orderBy(F.desc("rn")).limit(1).select("rn", "n_symbols", r("l1").alias("l1"), "n_unb", "n_edges")


MULTI = ["l1", "l2", "linf", "mean", "entropy", "weighted_unb", "balance_rate"]


@query("multi_indicators")
def _(spark, d):
    return gamma(spark, d).select("rn", *[r(c).alias(c) for c in MULTI], "n_bars", "n_unb", "unb_3", "unb_4", "unb_5plus", "n_cycles")


@query("ediv_series")
def _(spark, d):
    g = gamma(spark, d).select("rn", F.col("l1"), F.col("n_unb").cast("double").alias("unb")).withColumn("panel", F.lit("PX"))
    return G.divergence(g).select("rn", r("z_l1").alias("z_l1"), r("z_unb").alias("z_unb"), r("e_div").alias("e_div"))


@query("h1_barcode")
def _(spark, d):
    return N.barcodes(_pairs(spark, d), ["rn"]).select("rn", "dim", r("birth").alias("birth"), r("death").alias("death"))


@query("longest_bars")
def _(spark, d):
    """The five longest cycles of each window."""
    bars = N.barcodes(_pairs(spark, d), ["rn"]).where("dim = 1").withColumn("length", F.col("death") - F.col("birth"))
    w = Window.partitionBy("rn").orderBy(F.desc("length"), "birth", "death")
    return bars.withColumn("place", F.row_number().over(w)).where("place <= 5").select("rn", "place", r("birth").alias("birth"), r("death").alias("death"))


@query("truncation_audit")
def _(spark, d):
    _, pairs = settled_pairs(spark, d)
    cut = N.barcodes(pairs, ["rn"]).where("dim = 1").groupBy("rn").agg(F.sum(F.col("death") - F.col("birth")).alias("cut"))
    full = N.barcodes(pairs, ["rn"], far=2.0).where("dim = 1").groupBy("rn").agg(F.sum(F.col("death") - F.col("birth")).alias("full"), F.count_if(F.col("birth") > N.FAR).alias("late"))
    both = full.join(cut, "rn", "left").withColumn("cut", F.coalesce("cut", F.lit(0.0)))
    return both.select("rn", r("cut").alias("l1_cut"), r("full").alias("l1_full"), F.col("late").alias("n_late"), r(F.when(F.col("full") > 0, 1 - F.col("cut") / F.col("full"))).alias("share_cut"))


@query("truncation_quantiles")
def _(spark, d):
    rows = query_of("truncation_audit")(spark, d)
    p = lambda x: r(F.percentile("share_cut", F.lit(x)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_late").alias("n_late"), p(0.05).alias("p05"), p(0.5).alias("p50"), p(0.95).alias("p95"), r(S.corr("l1_cut", "l1_full")).alias("corr"))


@query("cycle_mod_k")
def _(spark, d):
    return N.cycle_label_counts(_pairs(spark, d), ["rn"], [2, 3, 4, 5, 6])


@query(
    "betti_series",
    f"""WITH RECURSIVE {PAIRS}, w5 AS MATERIALIZED (SELECT rn, symbol FROM whole WHERE whole), e5 AS MATERIALIZED (SELECT rn, u, v FROM edges UNION ALL SELECT rn, v, u FROM edges),
reach(rn, s, t) AS (SELECT rn, symbol, symbol FROM w5 UNION SELECT r.rn, r.s, e.v FROM reach r JOIN e5 e ON e.rn = r.rn AND e.u = r.t),
c AS (SELECT rn, count(DISTINCT lo) AS betti0, count(*) AS n FROM (SELECT rn, s, min(t) AS lo FROM reach GROUP BY 1, 2) GROUP BY rn), m AS (SELECT rn, count(*) AS m FROM edges GROUP BY rn)
SELECT rn, betti0, greatest(0, coalesce(m, 0) - n + betti0) AS betti1 FROM c LEFT JOIN m USING (rn)""",
)
def _(spark, d):
    return N.window_invariants(_pairs(spark, d), ["rn"], set()).select("rn", "betti0", "betti1")


#: Fixed values. Thresholds of a sweep.
STEPS = [k / 20 for k in range(2, 19)]


@query("betti_sweep")
def _(spark, d):
    return N.betti_sweep(_pairs(spark, d), ["rn"], STEPS)


@query("betti_sweep_signed")
def _(spark, d):
    return N.betti_sweep(_pairs(spark, d), ["rn"], STEPS, signed=True)


@query("sweep_summary")
def _(spark, d):
    return N.sweep_summary(N.betti_sweep(_pairs(spark, d), ["rn"], STEPS), ["rn"])


for _name, (_part, _columns) in {
    "k_core": ("cores", ["max_core"]),
    "spectral_gap": ("gap", ["gap"]),
    "mst_ntl": ("forest", ["forest", "tree_length", "tree_edges"]),
    "clustering_weighted": ("clustering", ["clustering"]),
    "communities": ("communities", ["n_communities"]),
    "walk_balance": ("walks", ["walk_balance"]),
    "frustration": ("frustration", ["frustration"]),
    "max_cliques": ("cliques", ["n_cliques"]),
}.items():

    @query(_name)
    def _(spark, d, part=_part, columns=_columns):
        g = N.window_invariants(_pairs(spark, d), ["rn"], {part})
        return g.select("rn", *[(r(c) if N.FIELDS[c] == "double" else F.col(c)).alias(c) for c in columns])


@query("invariant_bundle")
def _(spark, d):
    g = N.window_invariants(_pairs(spark, d), ["rn"], N.BUNDLE)
    names = ["n_symbols", "n_edges", "density", "betti0", "betti1", "max_core", "gap", "clustering", "forest", "tree_length", "tree_edges", "n_communities", "n_cliques"]
    return g.select("rn", *[(r(c) if N.FIELDS[c] == "double" else F.col(c)).alias(c) for c in names])


@query("three_indicators")
def _(spark, d):
    """Signed cycles, walks and frustration side by side."""
    g = N.window_invariants(_pairs(spark, d), ["rn"], {"cycles", "walks", "frustration"})
    return g.select("rn", "n_unb", r("walk_balance").alias("walk_balance"), "frustration")


@query("three_indicators_corr")
def _(spark, d):
    g = settled(query_of("three_indicators")(spark, d), "three")
    names = ["n_unb", "walk_balance", "frustration"]
    cols = [r(S.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    return g.agg(F.count(F.lit(1)).alias("n"), *cols)


@query("core_numbers")
def _(spark, d):
    return N.node_invariants(_pairs(spark, d), ["rn"], {"core"}).select("rn", "symbol", "core")


@query("core_histogram")
def _(spark, d):
    return N.node_invariants(_pairs(spark, d), ["rn"], {"core"}).groupBy("rn", "core").agg(F.count(F.lit(1)).alias("n"))


@query("eigenvector_centrality")
def _(spark, d):
    return N.node_invariants(_pairs(spark, d), ["rn"], {"centrality"}).select("rn", "symbol", r("centrality").alias("centrality"))


@query("removal_impact")
def _(spark, d):
    return N.node_invariants(_pairs(spark, d), ["rn"], {"removal"}).select("rn", "symbol", r("removal").alias("removal"))


def symbols_of(spark, d):
    return settled(T.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct(), "symbols")


def scenario_series(spark, d, excluded):
    """window_invariants of each scenario (scenario, symbol left out) and of `all`, for every window."""
    rets, pairs = settled_pairs(spark, d)
    pairs = pairs.join(F.broadcast(P.window_ends(rets, W).select("rn")), "rn")  # the windows of gamma_series
    every = excluded.unionByName(spark.createDataFrame([("all", "-")], "scenario string, symbol string"))
    return N.window_invariants(N.scenarios(pairs, symbols_of(spark, d), settled(every, "scenarios")), ["scenario", "rn"])


def _scenarios(spark, d, excluded):
    by = scenario_series(spark, d, excluded).groupBy("scenario").agg(F.avg("l1").alias("l1"), F.avg("n_unb").alias("unb"))
    by = settled(by, "by-scenario")
    base = by.where("scenario = 'all'").select(F.col("l1").alias("b1"), F.col("unb").alias("bu"))
    out = by.crossJoin(F.broadcast(base))  # one row
    return out.select("scenario", r("l1").alias("l1"), r("unb").alias("n_unb"), r(F.col("b1") - F.col("l1")).alias("l1_contribution"), r(F.col("bu") - F.col("unb")).alias("unb_contribution"))


def left_out(spark, d):
    return symbols_of(spark, d).select(F.col("symbol").alias("scenario"), "symbol")


def classes_out(spark, d):
    return symbols_of(spark, d).select(F.substring("symbol", 1, 7).alias("scenario"), "symbol")


def dealt_out(spark, d, gone: list[int], trials: int):
    """Scenarios gK/tN: K symbols left out, drawn anew in each of `trials` seeded trials."""
    grid = spark.createDataFrame([(f"g{k}/t{t}", k) for k in gone for t in range(trials)], "scenario string, gone int")
    drawn = symbols_of(spark, d).crossJoin(F.broadcast(grid)).withColumn("k", F.row_number().over(N_window("scenario")))
    return drawn.where("k <= gone").select("scenario", "symbol")


@query("loo_contribution")
def _(spark, d):
    return _scenarios(spark, d, left_out(spark, d))


@query("class_exclusion")
def _(spark, d):
    return _scenarios(spark, d, classes_out(spark, d))


#: Fixed values. Trials of the robustness study and symbols that each leaves out; sizes and trials of the reduction.
ROBUST_TRIALS, ROBUST_OUT = 30, 10
REDUCED, REDUCED_TRIALS = [5, 10, 15], 3


@query("subsample_band")
def _(spark, d):
    """Mean over the windows of L1 in each trial, their band, and whether the whole universe lies within it."""
    every = settled(_scenarios(spark, d, dealt_out(spark, d, [ROBUST_OUT], ROBUST_TRIALS)), "trials")
    own = every.where("scenario = 'all'").select(F.col("l1").alias("own"))
    p = lambda q: r(F.percentile("l1", F.lit(q)))
    band = every.where("scenario <> 'all'").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l1")).alias("mean"), r(F.stddev_samp("l1")).alias("sd"), p(0.05).alias("p05"), p(0.95).alias("p95"))
    return band.crossJoin(F.broadcast(own)).withColumn("within", F.expr("own BETWEEN p05 AND p95"))


@query("reduction")
def _(spark, d):
    """Progressively fewer symbols: mean L1 and unbalanced cycles by number left out and trial."""
    out = _scenarios(spark, d, dealt_out(spark, d, REDUCED, REDUCED_TRIALS)).where("scenario <> 'all'")
    return out.select(F.substring_index("scenario", "/", 1).alias("gone"), "scenario", "l1", "n_unb")


def N_window(key: str):
    return Window.partitionBy(key).orderBy(F.xxhash64(key, "symbol"), "symbol")


@query("window_scan")
def _(spark, d):
    rets, out = _rets(spark, d), None
    for n in (20, 30, 60, 90):
        g = N.window_invariants(C.rolling_pairs(rets, n), ["rn"], {"cycles"}).agg(F.count(F.lit(1)).alias("n_windows"), r(F.avg("n_edges")).alias("n_edges"), r(F.avg("n_unb")).alias("n_unb"))
        one = g.withColumn("w", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("permutation_p")
def _(spark, d):
    rows = E.responses(_div(spark, d), "e_div")
    return I.permutation_p(rows, E.nearest_rows(_events(spark), rows), "post_pre", "category")


@query("random_benchmark")
def _(spark, d):
    div = _div(spark, d)
    own = G.metrics(G.simulate(div, S.SIGNALS["s1"](), ["panel"]), ["panel"]).select(F.col("total_return").alias("mine"), F.col("max_drawdown").alias("fall"))
    trials = I.random_signals(div.select("rn", "price"), 8, 10, 1000)
    runs = G.metrics(G.simulate(trials, F.col("on"), ["trial"], hold=0), ["trial"]).crossJoin(F.broadcast(own))
    p = lambda c, q: r(F.percentile(c, F.lit(q)))
    return runs.agg(F.count(F.lit(1)).alias("n"), p("total_return", 0.05).alias("p05"), p("total_return", 0.95).alias("p95"), r(F.avg((F.col("total_return") > F.col("mine")).cast("double"))).alias("p_return"), r(F.avg((F.col("max_drawdown") > F.col("fall")).cast("double"))).alias("p_drawdown"))


@query("granger")
def _(spark, d):
    div = _div(spark, d)
    out = I.granger(div, "l1", "unb").withColumn("direction", F.lit("l1->unb")).unionByName(I.granger(div, "unb", "l1").withColumn("direction", F.lit("unb->l1")))
    return out.select("direction", "lag", "n", r("f").alias("f"), r("p").alias("p"))


@query("pc_dag")
def _(spark, d):
    return I.causal_edges(_div(spark, d), ["z_l1", "z_unb", "price", "e_div"][:3])
