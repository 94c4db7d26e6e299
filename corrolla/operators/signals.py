"""Index series, divergence signals, simulation and walk-forward evaluation. Pure window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrolla.functions import series as S

YEAR = 252


def index_series(rets: DataFrame) -> DataFrame:
    """(panel, rn, date, price, l1, unb) from the cross-section of returns: the mean price, the dispersion of returns
    and the count of falls stand in for the network indicators."""
    return rets.groupBy("rn", "date").agg(
        F.avg("pad").alias("price"), F.stddev_samp("ret").alias("l1"), F.count_if(F.col("ret") < 0).cast("double").alias("unb")
    ).withColumn("panel", F.lit("PX"))


def divergence(ind: DataFrame, least: int = 30, *keys: str) -> DataFrame:
    """ind with z_l1, z_unb (expanding) and e_div, their difference."""
    w = S.series(*(keys or ("panel",)))
    out = ind.withColumns({f"z_{c}": S.expanding_z(F.col(c), w, least) for c in ("l1", "unb")})
    return out.withColumn("e_div", F.col("z_unb") - F.col("z_l1"))


def simulate(df: DataFrame, on: Column, keys: list[str], direction: str = "short", hold: int = 5, lag: int = 1, cost: float = 0.0005) -> DataFrame:
    """Daily positions and equity: raw signal, held on by hysteresis, acted on `lag` rows later, close to close.

    short goes to cash while the signal is on, long is invested only then. Each change of position costs `cost`.
    """
    w = S.series(*keys)
    out = df.withColumn("raw", F.coalesce(on, F.lit(False)))
    out = out.withColumn("held", S.hysteresis(F.col("raw"), w, hold) if hold else F.col("raw"))
    out = out.withColumn("position", F.lag("held", lag, False).over(w) if lag else F.col("held"))
    out = out.withColumn("market", F.coalesce(S.simple_return(F.col("price"), w), F.lit(0.0)))
    invested = ~F.col("position") if direction == "short" else F.col("position")
    out = out.withColumn("flip", S.changed(F.col("position"), w))
    out = out.withColumn("strategy", F.when(invested, F.col("market")).otherwise(0.0) - F.when(F.col("flip"), cost).otherwise(0.0))
    out = out.withColumn("equity", S.growth(F.col("strategy"), w))
    return out.withColumn("drawdown", S.drawdown(F.col("equity"), w))


def metrics(run: DataFrame, keys: list[str], year: int = YEAR) -> DataFrame:
    """Return, annual growth and volatility, their ratio, mean over deviation (a second, different ratio), worst
    drawdown, share in position, number of changes."""
    agg = run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("equity", "rn").alias("final"),
        F.stddev_samp("strategy").alias("sd"),
        F.avg("strategy").alias("mean"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.col("position").cast("double")).alias("share_on"),
        F.count_if("flip").alias("n_changes"),
    )
    vol = F.col("sd") * F.sqrt(F.lit(float(year)))
    cagr = F.pow("final", F.lit(float(year)) / F.col("n")) - 1
    return agg.select(
        *keys,
        "n",
        (F.col("final") - 1).alias("total_return"),
        cagr.alias("cagr"),
        vol.alias("volatility"),
        F.when(vol > 1e-9, cagr / vol).otherwise(0.0).alias("growth_ratio"),
        F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd") * F.sqrt(F.lit(float(year)))).otherwise(0.0).alias("mean_ratio"),
        "max_drawdown",
        "share_on",
        "n_changes",
    )


def signal_blocks(df: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """Number of runs of a signal and their mean length, cut to a whole number."""
    w = S.series(*keys)
    marked = df.withColumn("_s", (F.col(on) & ~F.coalesce(F.lag(on).over(w), F.lit(False))).cast("long")).withColumn("_b", F.sum("_s").over(S.upto(w)))
    runs = marked.where(on).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.floor(F.avg("n")).cast("long").alias("block_length"))


def folds(df: DataFrame, train: int, test: int) -> DataFrame:
    """Walk-forward folds: (fold, first, mid, last) by position, as many as fit; each trains on [first, mid) and tests on
    [mid, last)."""
    n = df.agg((F.max("rn") + 1).alias("n"))
    steps = F.sequence(F.lit(0), F.floor((F.col("n") - train - test) / test).cast("int"))
    out = n.where(F.col("n") >= train + test).select(F.explode(steps).alias("fold"))
    first = F.col("fold") * test
    return out.select("fold", first.alias("first"), (first + train).alias("mid"), (first + train + test).alias("last"))


def quantile_of(values: Column, p: Column | float) -> Column:
    """Linear interpolation on an array of numbers, with a share that may vary by row; null on an empty array."""
    s = F.sort_array(values)
    at = F.lit(p) * (F.size(s) - 1) if isinstance(p, float) else p * (F.size(s) - 1)
    low = F.floor(at).cast("int")
    x, y = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return F.when(F.size(s) > 0, x + (y - x) * (at - low))


def walk_forward(df: DataFrame, train: int, test: int, share: float = 0.8, least: int = 30, hold: int = 5, cost: float = 0.0005) -> DataFrame:
    """The short rule with the threshold of each fold's own training rows; hysteresis and lag restart with the fold.

    Returns are taken before the folds are cut. Folds with fewer than `least` scores to train on are skipped.
    """
    w = S.series("panel")
    rows = df.withColumn("market", S.simple_return(F.col("price"), w))
    f = F.broadcast(folds(df, train, test))  # a fold for every `test` rows
    cut = rows.join(f, (F.col("rn") >= F.col("first")) & (F.col("rn") < F.col("mid"))).groupBy("fold")
    cut = cut.agg(F.percentile("e_div", F.lit(share)).alias("threshold"), F.count("e_div").alias("_n")).where(F.col("_n") >= least).drop("_n")
    out = rows.join(f, (F.col("rn") >= F.col("mid")) & (F.col("rn") < F.col("last"))).join(cut, "fold")
    v = S.series("fold")
    out = out.withColumn("held", S.hysteresis(F.coalesce(F.col("e_div") >= F.col("threshold"), F.lit(False)), v, hold))
    out = out.withColumn("position", F.lag("held", 1, False).over(v)).withColumn("flip", S.changed(F.col("position"), v))
    return out.withColumn(
        "strategy", F.when(F.col("position"), 0.0).otherwise(F.coalesce("market", F.lit(0.0))) - F.when(F.col("flip"), cost).otherwise(0.0)
    ).select("fold", "rn", "date", "threshold", "position", "market", "strategy")


def matched_rate(df: DataFrame, gauge: str, train: int, test: int, cash: float) -> DataFrame:
    """A rule on another gauge that is off as often: on the training rows the gauge's quantile 1 - cash is taken."""
    f = F.broadcast(folds(df, train, test))
    cut = df.join(f, (F.col("rn") >= F.col("first")) & (F.col("rn") < F.col("mid"))).groupBy("fold")
    cut = cut.agg(quantile_of(F.collect_list(gauge), 1.0 - cash).alias("threshold"), F.count(gauge).alias("n_train")).where("n_train >= 60")
    out = df.join(f, (F.col("rn") >= F.col("mid")) & (F.col("rn") < F.col("last"))).join(cut, "fold")
    return out.withColumn("on", F.coalesce(F.col(gauge) >= F.col("threshold"), F.lit(False))).select("fold", "rn", "threshold", "on")


def triggers(df: DataFrame, ahead: int = 20, share: float = 0.1, gap: int = 15) -> DataFrame:
    """Rows whose forward return is in the lowest `share`, clustered where they are at most `gap` rows apart."""
    w = S.series("panel")
    out = df.withColumn("fwd", S.forward_return(F.col("price"), w, ahead))
    cut = out.groupBy("panel").agg(F.percentile("fwd", F.lit(share)).alias("cut"))
    hit = out.join(F.broadcast(cut), "panel").where("fwd <= cut")
    v = S.series("panel")
    new = F.coalesce((F.col("rn") - F.lag("rn").over(v) > gap).cast("long"), F.lit(1))
    return hit.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(S.upto(v))).drop("_n")


def peaks_and_troughs(df: DataFrame, hits: DataFrame, before: int = 25, horizon: int = 60) -> DataFrame:
    """For each cluster of triggers: the first highest price in the rows up to its first one, and from there the first
    lowest within the horizon, with the fall from one to the other."""
    start = hits.groupBy("cluster").agg(F.min("rn").alias("at"))
    p = df.select(F.col("rn").alias("prn"), "price")
    up = start.join(p, (F.col("prn") <= F.col("at")) & (F.col("prn") > F.col("at") - before))
    peak = up.groupBy("cluster", "at").agg(F.max(F.struct("price", (-F.col("prn")).alias("k"))).alias("m"))
    peak = peak.select("cluster", "at", F.col("m.price").alias("peak"), (-F.col("m.k")).alias("peak_rn"))
    down = peak.join(p, (F.col("prn") >= F.col("peak_rn")) & (F.col("prn") < F.col("peak_rn") + horizon))
    low = down.groupBy("cluster", "at", "peak", "peak_rn").agg(F.min(F.struct("price", "prn")).alias("m"))
    return low.select("cluster", "peak_rn", "peak", F.col("m.prn").alias("trough_rn"), F.col("m.price").alias("trough"), (F.col("m.price") / F.col("peak") - 1).alias("fall"))


def numbered_rows(df: DataFrame, *keys: str) -> DataFrame:
    """df with pos: the place of each row in its series, from 0, for series whose rn does not begin at 0."""
    return df.withColumn("pos", (F.row_number().over(S.series(*keys)) - 1).cast("long"))


def walk_forward_grid(df: DataFrame, grid: DataFrame, hold: int = 5, cost: float = 0.0005, least: int = 30) -> DataFrame:
    """Walk-forward by configuration: grid (cfg, train, test, share, side) against one series (panel, rn, price, e_div). A row
    (cfg, fold, rn, pos, threshold, held, position, market, strategy) for each test row of each fold that has `least` scores
    to train on. Thresholds are the training rows' quantile `share`; hysteresis and lag restart with each fold; returns
    are taken before the folds are cut. The grid is a few rows and its folds one for every `test` rows of the series."""
    rows = numbered_rows(df, "panel").withColumn("market", F.coalesce(S.simple_return(F.col("price"), S.series("panel")), F.lit(0.0)))
    n = rows.agg((F.max("pos") + 1).alias("n"))
    steps = F.expr("sequence(0, cast(floor((n - train - test) / test) AS int))")
    cut = grid.crossJoin(F.broadcast(n)).where("n >= train + test").select("cfg", "train", "test", "share", "side", F.explode(steps).alias("fold"))
    cut = F.broadcast(cut.withColumn("first", F.col("fold") * F.col("test")))
    inside = rows.join(cut, F.expr("pos >= first AND pos < first + train")).groupBy("cfg", "fold", "share")
    known = inside.agg(F.collect_list("e_div").alias("known"))  # a training span's scores
    known = known.where(F.size("known") >= least).select("cfg", "fold", quantile_of(F.col("known"), F.col("share")).alias("threshold"))
    out = rows.join(cut, F.expr("pos >= first + train AND pos < first + train + test")).join(F.broadcast(known), ["cfg", "fold"])
    v = S.series("cfg", "fold")
    out = out.withColumn("held", S.hysteresis(F.coalesce(F.col("e_div") >= F.col("threshold"), F.lit(False)), v, hold))
    out = out.withColumn("position", F.lag("held", 1, False).over(v)).withColumn("flip", S.changed(F.col("position"), v))
    invested = F.when(F.col("side") == "short", ~F.col("position")).otherwise(F.col("position"))
    strategy = F.when(invested, F.col("market")).otherwise(0.0) - F.when(F.col("flip"), cost).otherwise(0.0)
    return out.withColumn("strategy", strategy).select("cfg", "fold", "rn", "pos", "threshold", "held", "position", "market", "strategy")


def returns_summary(rows: DataFrame, column: str, *keys: str, year: int = YEAR) -> DataFrame:
    """keys, n, total_return, growth_ratio, mean_ratio and max_drawdown of a column of returns in order of rn."""
    w = S.series(*keys)
    run = rows.withColumn("_e", S.growth(F.col(column), w)).withColumn("_d", S.drawdown(F.col("_e"), w))
    agg = run.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("_e", "rn").alias("_f"), F.stddev_samp(column).alias("_s"), F.avg(column).alias("_m"), F.min("_d").alias("max_drawdown"))
    vol = F.col("_s") * F.sqrt(F.lit(float(year)))
    growth = (F.pow("_f", F.lit(float(year)) / F.col("n")) - 1) / vol
    return agg.select(
        *keys, "n", (F.col("_f") - 1).alias("total_return"), F.when(vol > 1e-9, growth).otherwise(0.0).alias("growth_ratio"),
        F.when(F.col("_s") > 1e-9, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(year)))).otherwise(0.0).alias("mean_ratio"), "max_drawdown",
    )


def grid_summary(run: DataFrame) -> DataFrame:
    """walk_forward_grid by configuration: folds, return beside the market's and the difference, both ratios, worst drawdown,
    mean and population deviation of the folds' growth ratios, share of folds that beat the market."""
    fold = returns_summary(run, "strategy", "cfg", "fold").join(returns_summary(run, "market", "cfg", "fold").select("cfg", "fold", F.col("total_return").alias("_b")), ["cfg", "fold"])
    by = fold.groupBy("cfg").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("growth_ratio").alias("fold_ratio_mean"), F.stddev_pop("growth_ratio").alias("fold_ratio_sd"),
        F.avg((F.col("total_return") > F.col("_b")).cast("double")).alias("win_rate"),
    )
    market = returns_summary(run, "market", "cfg").select("cfg", F.col("total_return").alias("market_return"))
    out = returns_summary(run, "strategy", "cfg").join(market, "cfg").join(by, "cfg")
    return out.withColumn("alpha", F.col("total_return") - F.col("market_return"))


def lag_verdict(lags: DataFrame) -> DataFrame:
    """What lags (lag; null where nothing was crossed) say: counts, middle and a verdict, which needs a majority of a third
    of the crossings, two at least, and a middle of two rows or more to the same side."""
    agg = lags.agg(
        F.count(F.lit(1)).alias("n_events"), F.count("lag").alias("n_cross"), F.count_if(F.expr("lag <= -3")).alias("n_lead"),
        F.count_if(F.expr("lag > -3 AND lag <= 3")).alias("n_same"), F.count_if(F.expr("lag > 3")).alias("n_lag"),
        F.median("lag").alias("middle"), F.avg("lag").alias("mean"), F.min("lag").alias("least"), F.max("lag").alias("most"),
    )
    margin = F.greatest(F.lit(2), F.floor(F.col("n_cross") / 3))
    verdict = F.when(F.col("n_cross") == 0, "insufficient").when((F.col("n_lead") - F.col("n_lag") >= margin) & (F.col("middle") <= -2), "predictive")
    return agg.withColumn("verdict", verdict.when((F.col("n_lag") - F.col("n_lead") >= margin) & (F.col("middle") >= 2), "reactive").otherwise("mixed"))
