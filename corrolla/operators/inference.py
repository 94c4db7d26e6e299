"""Resampling and causality: permutations, random block signals, Granger tests, constraint-based graphs."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corrolla.functions.series import corr


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or tiny), 1 + k / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def f_tail(f: float, d1: int, d2: int) -> float:
    return float(incomplete_beta(d2 / 2, d1 / 2, float(d2 / (d2 + d1 * f)))) if f > 0 else 1.0


def chi2_tail(x: float, k: int) -> float:
    """Probability that a chi-squared variable of k degrees exceeds x, by the recurrence from one or two degrees."""
    if x <= 0:
        return 1.0
    h = x / 2
    tail, term = (math.exp(-h), math.exp(-h)) if k % 2 == 0 else (math.erfc(math.sqrt(h)), 2 * math.sqrt(h / math.pi) * math.exp(-h))
    if k % 2 == 0:
        for i in range(1, k // 2):
            term *= h / i
            tail += term
    else:
        for i in range(1, (k + 1) // 2):
            tail += term
            term *= h / (i + 0.5)
    return min(1.0, tail)


def t_tail(t: float, free: int) -> float:
    """Two-sided tail of a t statistic."""
    return incomplete_beta(free / 2, 0.5, free / (free + t * t)) if free > 0 else 1.0


def granger(rows: DataFrame, cause: str, effect: str, lags: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(lag, n, f, p, chi2, p_chi2) for each lag: whether the cause's past adds to the effect's own. Spark sums the products of lagged
    columns; only their (2 lag + 1)-square matrices reach the driver."""
    from corrolla.functions.series import series

    spark, out, w = rows.sparkSession, [], series("panel")
    for k in lags:
        names = [*(f"y{i}" for i in range(1, k + 1)), *(f"x{i}" for i in range(1, k + 1))]
        cols = [F.lag(effect, i).over(w).alias(f"y{i}") for i in range(1, k + 1)] + [F.lag(cause, i).over(w).alias(f"x{i}") for i in range(1, k + 1)]
        data = rows.select("panel", F.col(effect).alias("y0"), *cols).na.drop().withColumn("one", F.lit(1.0))
        every = ["one", *names, "y0"]
        got = data.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(every) for b in every[i:]]).first().asDict()
        m = np.array([[got[f"{a}_{b}"] if f"{a}_{b}" in got else got[f"{b}_{a}"] for b in every] for a in every], dtype=float)
        if not np.isfinite(m).all():
            continue

        def rss(use):
            a, b = m[np.ix_(use, use)], m[use, -1]
            return m[-1, -1] - b @ np.linalg.lstsq(a, b, rcond=None)[0]

        n = int(m[0, 0])
        full, own = rss(list(range(2 * k + 1))), rss(list(range(k + 1)))
        free = n - 2 * k - 1
        f = max(0.0, (own - full) / k / (full / free)) if free > 0 and full > 0 else 0.0
        chi2 = max(0.0, n * (own - full) / full) if full > 0 else 0.0
        out.append((k, n, float(f), f_tail(f, k, free) if free > 0 else 1.0, float(chi2), chi2_tail(float(chi2), k)))
    return spark.createDataFrame(out, "lag int, n long, f double, p double, chi2 double, p_chi2 double")


def granger_verdict(forward: DataFrame, backward: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The least p over the lags each way, uncorrected, and which way they point."""
    out = forward.agg(F.min("p").alias("p_forward")).crossJoin(F.broadcast(backward.agg(F.min("p").alias("p_backward"))))
    verdict = F.when(F.expr("p_forward IS NULL OR p_backward IS NULL"), "no data").when(F.expr(f"p_forward < {alpha} AND p_backward >= {alpha}"), "forward")
    return out.withColumn("verdict", verdict.when(F.expr(f"p_forward < {alpha}"), "both").when(F.expr(f"p_backward < {alpha}"), "backward").otherwise("none"))


def jittered(rows: DataFrame, columns: list[str], size: float = 1e-9, seed: int = 42) -> DataFrame:
    """rows with a little noise on binary columns, so that no correlation matrix is singular."""
    return rows.withColumns({c: F.col(c) + F.randn(seed + i) * size for i, c in enumerate(columns)})


def confounders(edges: DataFrame) -> DataFrame:
    """(source, x, y): nodes with an arrow to both x and y; edges as pc_graph gives them, few."""
    out = edges.where("kind = 'directed'")
    a, b = out.select("source", F.col("target").alias("x")), out.select("source", F.col("target").alias("y"))
    return a.join(F.broadcast(b), "source").where("x < y")


def pc_graph(corr: np.ndarray, n: int, names: list[str], alpha: float = 0.05) -> list[tuple[str, str, str]]:
    """Edges (source, target, kind) of a graph by conditional independence: a stable skeleton, colliders, then the
    orientations that avoid new colliders and cycles."""
    k = len(names)
    adj = {i: set(range(k)) - {i} for i in range(k)}
    sep: dict[frozenset, tuple] = {}
    bound = -1.0

    def independent(i, j, given):
        p = np.linalg.pinv(corr[np.ix_([i, j, *given], [i, j, *given])])
        r = max(-0.999999, min(0.999999, -p[0, 1] / math.sqrt(abs(p[0, 0] * p[1, 1]) or 1e-300)))
        z = abs(0.5 * math.log((1 + r) / (1 - r))) * math.sqrt(max(n - len(given) - 3, 1))
        return math.erfc(z / math.sqrt(2)) > alpha

    for size in range(k - 1):
        before = {i: set(x) for i, x in adj.items()}
        for i in range(k):
            for j in sorted(before[i]):
                if i < j and j in adj[i]:
                    pools = [before[i] - {j}, before[j] - {i}]
                    for given in (g for pool in pools for g in combinations(sorted(pool), size)):
                        if independent(i, j, given):
                            adj[i].discard(j)
                            adj[j].discard(i)
                            sep[frozenset((i, j))] = given
                            break
    to = {(i, j) for i in adj for j in adj[i]}  # both ways: not oriented
    for c in range(k):
        for a, b in combinations(sorted(adj[c]), 2):
            if b not in adj[a] and c not in sep.get(frozenset((a, b)), ()):
                to -= {(c, a), (c, b)}
    arrow = lambda a, b: (a, b) in to and (b, a) not in to
    open_ = lambda a, b: (a, b) in to and (b, a) in to
    while bound != len(to):
        bound = len(to)
        for a in range(k):
            for b in sorted(adj[a]):
                if open_(a, b) and (
                    any(arrow(c, a) and b not in adj[c] for c in adj[a])
                    or any(arrow(a, c) and arrow(c, b) for c in adj[a] & adj[b])
                    or any(open_(a, c) and open_(a, d) and arrow(c, b) and arrow(d, b) and d not in adj[c] for c, d in combinations(adj[a] & adj[b], 2))
                ):
                    to.discard((b, a))
    out = []
    for i in range(k):
        for j in sorted(adj[i]):
            if i < j:
                kind = "undirected" if open_(i, j) else "directed"
                out.append((names[j], names[i], kind) if arrow(j, i) else (names[i], names[j], kind))
    return out


def causal_edges(rows: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """pc_graph over the correlations of a few columns, which Spark sums; constant columns are left out."""
    data = rows.select(*columns).na.drop()
    pairs = list(combinations(columns, 2))
    got = data.agg(F.count(F.lit(1)).alias("n"), *[corr(a, b).alias(f"{a}|{b}") for a, b in pairs], *[F.stddev_samp(c).alias(f"sd|{c}") for c in columns]).first().asDict()
    use = [c for c in columns if got[f"sd|{c}"]]
    m = np.eye(len(use))
    for i, a in enumerate(use):
        for j, b in enumerate(use[i + 1 :], i + 1):
            m[i, j] = m[j, i] = got[f"{a}|{b}"] or 0.0
    return rows.sparkSession.createDataFrame(pc_graph(m, got["n"] or 0, use, alpha) if use else [], "source string, target string, kind string")


def permutation_p(rows: DataFrame, events: DataFrame, column: str, by: str, draws: int = 5000, seed: int = 42) -> DataFrame:
    """(by, n, mean, p_two_sided, p_about_zero, p_upper) for each class of events against means of as many rows drawn at
    random without replacement: two-sided around the draws' mean, two-sided around 0, and one-sided.

    rows has every row's response, were it an event; its values are one column of one panel, a calendar's length, and
    go to each class."""
    pool = rows.where(F.col(column).isNotNull()).groupBy("panel").agg(F.sort_array(F.collect_list(column)).alias("pool"))
    own = events.where(F.col(column).isNotNull()).select("panel", by, column)
    kind = events.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pool, n = np.asarray(pdf["pool"].iloc[0]), len(pdf)
        mean = float(pdf[column].mean())
        rng = np.random.default_rng([seed, n])
        null = np.array([pool[rng.choice(len(pool), min(n, len(pool)), replace=False)].mean() for _ in range(draws)])
        p = lambda hit: (int(hit.sum()) + 1) / (draws + 1)
        row = (pdf[by].iloc[0], n, mean, p(np.abs(null - null.mean()) >= abs(mean - null.mean())), p(np.abs(null) >= abs(mean)), p(null >= mean))
        return pd.DataFrame([row], columns=[by, "n", "mean", "p_two_sided", "p_about_zero", "p_upper"])

    return own.join(F.broadcast(pool), "panel").groupBy(by).applyInPandas(run, f"{by} {kind}, n long, mean double, p_two_sided double, p_about_zero double, p_upper double")


def mean_inference(rows: DataFrame, events: DataFrame, column: str, by: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(by, n, mean, t, p_t, low, high, p_month, p_block) for the values of each class of events: a one-sample t test, a
    bootstrap interval of 90 %, and the share of random placings that reach the mean: each event to any row of its own
    calendar month, and all events moved by one and the same number of rows, around the end."""
    pool = rows.where(F.col(column).isNotNull()).groupBy("panel").agg(F.sort_array(F.collect_list(F.struct("rn", F.month("date").alias("m"), F.col(column).alias("v")))).alias("pool"))
    own = events.where(F.col(column).isNotNull()).select("panel", by, "rn", F.month("date").alias("_m"), column)
    kind = events.schema[by].dataType.simpleString()
    names = [by, "n", "mean", "t", "p_t", "low", "high", "p_month", "p_block"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        v, n = pdf[column].to_numpy(float), len(pdf)
        every = np.array([(x["rn"], x["m"], x["v"]) for x in pdf["pool"].iloc[0]], dtype=float)
        rng, mean = np.random.default_rng([seed, n]), float(v.mean())
        sd = float(v.std(ddof=1)) if n > 1 else 0.0
        t = mean / (sd / math.sqrt(n)) if sd > 0 else 0.0
        boot = v[rng.integers(0, n, (draws, n))].mean(axis=1)
        by_month = [every[every[:, 1] == m, 2] for m in pdf["_m"]]
        month = np.mean([x[rng.integers(0, len(x), draws)] for x in by_month], axis=0)
        at = np.searchsorted(every[:, 0], pdf["rn"].to_numpy(float))
        moved = every[(at[None, :] + rng.integers(0, len(every), draws)[:, None]) % len(every), 2].mean(axis=1)
        p = lambda null: (int((np.abs(null) >= abs(mean)).sum()) + 1) / (draws + 1)
        low, high = np.percentile(boot, [5, 95])
        return pd.DataFrame([(pdf[by].iloc[0], n, mean, t, t_tail(t, n - 1) if sd > 0 else 1.0, low, high, p(month), p(moved))], columns=names)

    schema = f"{by} {kind}, n long, mean double, t double, p_t double, low double, high double, p_month double, p_block double"
    return own.join(F.broadcast(pool), "panel").groupBy(by).applyInPandas(run, schema)


def random_blocks(n: int, blocks: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """A signal of n rows with blocks that don't overlap, placed at random with a bounded number of tries."""
    on = np.zeros(n, dtype=bool)
    placed = tries = 0
    while placed < blocks and tries < 50 * blocks and length and n > length:
        tries += 1
        at = int(rng.integers(0, n - length + 1))
        if not on[at : at + length].any():
            on[at : at + length] = True
            placed += 1
    return on


def random_signals(rows: DataFrame, blocks: int, length: int, trials: int, seed: int = 42) -> DataFrame:
    """rows of one panel for each trial, with a random block signal `on`; trials are seeded apart and run apart."""
    spark = rows.sparkSession
    n = rows.agg((F.max("rn") + 1).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for trial, size in zip(pdf["trial"], pdf["n"]):
            on = random_blocks(int(size), blocks, length, np.random.default_rng([seed, int(trial)]))
            out.append(pd.DataFrame({"trial": trial, "rn": np.flatnonzero(on)}))
        return pd.concat(out)

    each = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(F.broadcast(n))
    spots = each.withColumn("_g", F.col("trial") % 64).groupBy("_g").applyInPandas(lambda p: run(p), "trial long, rn long")
    every = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(F.broadcast(rows))
    return every.join(spots.withColumn("on", F.lit(True)), ["trial", "rn"], "left").fillna(False, ["on"])


def random_folds(folds: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """(trial, fold, pos): rows that a random block signal has on, for each fold (fold, first, n, blocks, length) and trial.
    Trials are seeded apart by trial and fold and run apart."""
    spark = folds.sparkSession

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"trial": [], "fold": [], "pos": []}, dtype="int64")]
        for trial, fold, first, n, blocks, length in zip(*(pdf[c] for c in ("trial", "fold", "first", "n", "blocks", "length"))):
            on = np.flatnonzero(random_blocks(int(n), int(blocks), int(length), np.random.default_rng([seed, int(trial), int(fold)])))
            out.append(pd.DataFrame({"trial": trial, "fold": fold, "pos": on + first}))
        return pd.concat(out)

    each = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(F.broadcast(folds)).withColumn("_g", F.col("trial") % 64)
    return each.groupBy("_g").applyInPandas(lambda p: run(p), "trial long, fold long, pos long")
