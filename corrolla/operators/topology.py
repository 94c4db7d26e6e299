"""Per-window topology and graph invariants: small graphs, one grouped Arrow call for each window or scenario."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

FAR = math.sqrt(2.0)


def distances(r: np.ndarray) -> np.ndarray:
    """sqrt(2 (1 - r)), a missing correlation as 0, symmetric with a zero diagonal."""
    d = np.sqrt(np.clip(2 * (1 - np.where(np.isfinite(r), r, 0.0)), 0, None))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0.0)
    return d


def barcode(d: np.ndarray, far: float = FAR) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """Vietoris-Rips bars of dimension 0 and 1 up to distance `far`; what lives on ends there. Bars without length are
    left out; the others come longest first.

    Edges in order of length build a forest; those that close a cycle give birth to one. Triangles, each as the set of
    its edges' places in one integer, are reduced in the order of their longest edges; a reduced triangle ends the
    cycle of its latest edge.
    """
    n = len(d)
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= far)
    place = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    h0, births = [], set()
    for k, (length, i, j) in enumerate(edges):
        a, b = root(i), root(j)
        if a == b:
            births.add(k)
        else:
            parent[max(a, b)] = min(a, b)
            if length > 0:
                h0.append((0.0, float(length)))
    h0 += [(0.0, far)] * sum(root(x) == x for x in range(n))
    ends: dict[int, int] = {}
    h1 = []
    near: list[set[int]] = [set() for _ in range(n)]
    for k, (length, i, j) in enumerate(edges):
        for v in sorted(near[i] & near[j]):  # the triangles that this edge completes
            column = 1 << k | 1 << place[min(i, v), max(i, v)] | 1 << place[min(j, v), max(j, v)]
            while column:
                low = column.bit_length() - 1
                if low not in ends:
                    ends[low] = column
                    births.discard(low)
                    if length > edges[low][0]:
                        h1.append((float(edges[low][0]), float(length)))
                    break
                column ^= ends[low]
        near[i].add(j)
        near[j].add(i)
    h1 += [(float(edges[k][0]), far) for k in births if edges[k][0] < far]
    longest = lambda bars: sorted(bars, key=lambda x: (x[0] - x[1], x))
    return longest(h0), longest(h1)


def bar_summary(bars: list[tuple[float, float]]) -> dict:
    p = np.array([b - a for a, b in bars])
    total = float(p.sum())
    share = p / total if total > 1e-9 else p[:0]
    share = share[share > 1e-9]
    return {
        "n_bars": len(p),
        "l1": total,
        "l2": float(np.sqrt((p * p).sum())),
        "linf": float(p.max()) if len(p) else 0.0,
        "mean": float(p.mean()) if len(p) else 0.0,
        "entropy": float(-(share * np.log(share)).sum()),
    }


def spanning_tree(near: list[list[int]]) -> tuple[list[int], list[int]]:
    """Parent and depth of every node in a spanning forest: each component is a tree from its first node, grown breadth
    first over neighbours in order; a root is its own parent. So cycles are short."""
    parent, depth = [-1] * len(near), [0] * len(near)
    for root in range(len(near)):
        if parent[root] < 0:
            parent[root], level = root, [root]
            while level:
                after = []
                for x in level:
                    for y in near[x]:
                        if parent[y] < 0:
                            parent[y], depth[y] = x, depth[x] + 1
                            after.append(y)
                level = after
    return parent, depth


def cycle_basis(near: list[list[int]]) -> list[list[int]]:
    """The fundamental cycles of the spanning forest: each edge outside it, in order of its ends, closes the two paths up
    to where they meet. This basis is this library's own: another forest gives other cycles, as many, with the same span."""
    parent, depth = spanning_tree(near)
    out = []
    for u in range(len(near)):
        for v in near[u]:
            if u < v and parent[v] != u and parent[u] != v:
                left, right = [u], [v]
                while left[-1] != right[-1]:
                    if depth[left[-1]] >= depth[right[-1]]:
                        left.append(parent[left[-1]])
                    else:
                        right.append(parent[right[-1]])
                out.append(left + right[-2::-1])
    return out


#: Fixed values. Cycles that the balance and the decomposition by length look at, at most; examples listed.
BALANCE_CYCLES, LENGTH_CYCLES, EXAMPLES = 1000, 1500, 5


def cycle_labels(cycles: list[list[int]], r: np.ndarray, k: int) -> int:
    """Cycles whose edges' labels, the correlation's place among k equal parts of [-1, 1], do not add up to 0 modulo k."""
    odd = 0
    for c in cycles:
        v = r[c, [*c[1:], c[0]]]
        odd += int(np.minimum(k - 1, np.floor((v + 1) / 2 * k)).sum()) % k != 0
    return odd


def cycle_balance(cycles: list[list[int]], r: np.ndarray) -> dict:
    """Cycles by the sign of their product (n_unb, balance_rate: of the first BALANCE_CYCLES; a zero counts as unbalanced),
    by length (of the first LENGTH_CYCLES; a zero counts as balanced), and the summed strength of the unbalanced ones."""
    by, weight, bad = {3: 0, 4: 0, 5: 0}, 0.0, 0
    products = [float(np.prod(r[c, [*c[1:], c[0]]])) for c in cycles[:LENGTH_CYCLES]]
    first = products[:BALANCE_CYCLES]
    bad = sum(p <= 0 for p in first)
    for c, p in zip(cycles, products):
        if p < 0:
            by[min(len(c), 5)] += 1
            weight -= p
    rate = (len(first) - bad) / len(first) if first else 1.0
    odd = cycle_labels(cycles[:LENGTH_CYCLES], r, 2)
    return {"n_cycles": len(cycles), "n_unb": bad, "unb_3": by[3], "unb_4": by[4], "unb_5plus": by[5], "weighted_unb": weight, "balance_rate": rate, "unb_mod2": odd}


# ---- graph invariants on a weight matrix (0 where there is no edge)


def cores(near: list[set[int]]) -> list[int]:
    deg, out, left, k = [len(x) for x in near], [0] * len(near), set(range(len(near))), 0
    while left:
        v = min(left, key=lambda x: (deg[x], x))
        k = max(k, deg[v])
        out[v] = k
        left.remove(v)
        for u in near[v] & left:
            deg[u] -= 1
    return out


def n_components(near: list[set[int]]) -> int:
    seen, n = set(), 0
    for s in range(len(near)):
        if s not in seen:
            n, todo = n + 1, [s]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x] - seen
    return n


def spectral_gap(w: np.ndarray) -> float:
    """The second smallest eigenvalue of the normalised Laplacian; 0 without edges."""
    deg = w.sum(axis=1)
    if not deg.any() or len(w) < 2:
        return 0.0
    s = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
    return float(max(0.0, np.sort(np.linalg.eigvalsh(np.diag((deg > 0).astype(float)) - s[:, None] * w * s[None, :]))[1]))


def clustering(w: np.ndarray) -> float:
    """Mean over nodes of the cube-root mean of triangle weights, scaled by the largest weight."""
    if not w.any():
        return 0.0
    c = np.cbrt(w / w.max())
    deg = (w > 0).sum(axis=1)
    tri = np.einsum("ij,jk,ki->i", c, c, c)
    return float(np.where(deg > 1, tri / np.maximum(deg * (deg - 1), 1), 0).mean())


def spanning_forest(w: np.ndarray, d: np.ndarray) -> tuple[float, int]:
    n, parent = len(w), list(range(len(w)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, used = 0.0, 0
    for length, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n) if w[i, j] > 0):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            total, used = total + float(length), used + 1
    return total, used


def maximal_cliques(near: list[set[int]]) -> int:
    """All of them; their number may grow exponentially with the nodes, which are a window's symbols."""
    count, stack = 0, [(set(range(len(near))), set())]
    while stack:
        p, x = stack.pop()
        if not p:
            count += not x
            continue
        pivot = max(p | x, key=lambda u: (len(p & near[u]), -u))
        for v in sorted(p - near[pivot]):
            stack.append((p & near[v], x & near[v]))
            p, x = p - {v}, x | {v}
    return count


def communities(w: np.ndarray) -> int:
    """Greedy modularity: the pair of communities that gains most is joined until none gains; ties to the first pair."""
    total = w.sum()
    if not total:
        return len(w)
    e, a = w / total, w.sum(axis=1) / total
    live = list(range(len(w)))
    e = e.copy()
    while len(live) > 1:
        gain = 2 * (e[np.ix_(live, live)] - np.outer(a[live], a[live]))
        gain[np.tril_indices(len(live))] = -np.inf
        k = int(gain.argmax())
        i, j = divmod(k, len(live))
        if gain[i, j] <= 1e-12:
            break
        p, q = live[i], live[j]
        e[p] += e[q]
        e[:, p] += e[:, q]
        a[p] += a[q]
        live.pop(j)
    return len(live)


def walk_balance(signed: np.ndarray, beta: float = 1.0) -> float:
    top = np.exp(beta * np.linalg.eigvalsh(np.abs(signed))).sum() if signed.any() else 0.0
    return float(np.exp(beta * np.linalg.eigvalsh(signed)).sum() / top) if top else 1.0


def frustration(signs: np.ndarray, starts: int = 5, seed: int = 42) -> int:
    """Edges that no split of the nodes in two satisfies, by flips that help most from several seeded starts."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        s = rng.choice([-1, 1], len(signs))
        while len(s):
            gain = s * (signs @ s)
            k = int(gain.argmin())
            if gain[k] >= 0:
                break
            s[k] = -s[k]
        bad = int(((signs * np.outer(s, s)) < 0).sum() // 2)
        best = bad if best is None else min(best, bad)
    return best or 0


def _simple(w: np.ndarray) -> tuple[float, float, int]:
    n, near = len(w), [set(np.flatnonzero(x).tolist()) for x in w]
    return (2 * (w > 0).sum() / 2 / (n * (n - 1)) if n > 1 else 0.0), spectral_gap(w), n_components(near)


def removal_impact(w: np.ndarray) -> np.ndarray:
    """5 |change of density| + 2 |change of the gap| + 0.3 added components, for each node taken away."""
    d, g, c = _simple(w)
    out = []
    for k in range(len(w)):
        keep = np.arange(len(w)) != k
        d2, g2, c2 = _simple(w[np.ix_(keep, keep)])
        out.append(5 * abs(d2 - d) + 2 * abs(g2 - g) + 0.3 * (c2 - c))
    return np.array(out)


FIELDS = {
    "n_symbols": "int", "n_edges": "int", "density": "double", "h0_bars": "int", "n_bars": "int", "l1": "double", "l2": "double", "linf": "double", "mean": "double",
    "entropy": "double", "n_cycles": "int", "n_unb": "int", "unb_3": "int", "unb_4": "int", "unb_5plus": "int", "weighted_unb": "double",
    "balance_rate": "double", "unb_mod2": "int", "betti0": "int", "betti1": "int", "max_core": "int", "gap": "double", "clustering": "double",
    "forest": "double", "tree_length": "double", "tree_edges": "int", "n_cliques": "int", "n_communities": "int", "walk_balance": "double",
    "frustration": "int",
}
#: What can be asked for beside the counts of symbols, edges and components.
PARTS = {"topology", "cycles", "density", "cores", "gap", "clustering", "forest", "communities", "walks", "frustration", "cliques"}
#: The graph's invariants, as one bundle.
BUNDLE = frozenset(PARTS - {"topology", "cycles", "walks", "frustration"})


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The symbols of a window's pairs in order, and their correlations; missing ones and the diagonal are NaN."""
    names = sorted({*pdf["u"], *pdf["v"]})
    at = {s: i for i, s in enumerate(names)}
    r = np.full((len(names), len(names)), np.nan)
    i, j = pdf["u"].map(at).to_numpy(), pdf["v"].map(at).to_numpy()
    r[i, j] = r[j, i] = pdf["r"].to_numpy(float)
    return names, r


def _window(pdf: pd.DataFrame, threshold: float, parts: frozenset[str], least: int) -> dict:
    names, r = _matrix(pdf)
    n = len(names)
    out: dict = {"n_symbols": n}
    if n < least:
        return out | {"n_edges": 0}
    strong = np.isfinite(r) & (np.abs(np.nan_to_num(r)) >= threshold)
    signed = np.where(strong, np.nan_to_num(r), 0.0)
    w = np.abs(signed)
    near = [set(np.flatnonzero(x).tolist()) for x in strong]
    out["n_edges"] = int(strong.sum() // 2)
    out["betti0"] = n_components(near)
    out["betti1"] = max(0, out["n_edges"] - n + out["betti0"])
    if "topology" in parts:
        h0, h1 = barcode(distances(r))
        out |= bar_summary(h1) | {"h0_bars": len(h0)}
    if "cycles" in parts:
        out |= cycle_balance(cycle_basis([sorted(x) for x in near]), signed)
    if "density" in parts:
        out["density"] = 2 * out["n_edges"] / (n * (n - 1)) if n > 1 else 0.0
    if "cores" in parts:
        out["max_core"] = max(cores(near), default=0)
    if "gap" in parts:
        out["gap"] = spectral_gap(w)
    if "clustering" in parts:
        out["clustering"] = clustering(w)
    if "forest" in parts:
        total, used = spanning_forest(w, distances(r))
        out |= {"forest": total, "tree_length": total / (n - 1) if n > 1 else 0.0, "tree_edges": used}
    if "communities" in parts:
        out["n_communities"] = communities(w)
    if "walks" in parts:
        out["walk_balance"] = walk_balance(signed)
    if "frustration" in parts:
        out["frustration"] = frustration(np.sign(signed))
    if "cliques" in parts:
        out["n_cliques"] = maximal_cliques(near)
    return out


def centrality(w: np.ndarray) -> np.ndarray:
    """The leading eigenvector, by magnitude; zeros without edges."""
    return np.abs(np.linalg.eigh(w)[1][:, -1]) if w.any() else np.zeros(len(w))


def window_invariants(pairs: DataFrame, keys: list[str], parts=frozenset({"topology", "cycles"}), threshold: float = 0.3, least: int = 5) -> DataFrame:
    """keys and FIELDS for each window of pairs (u, v, r), one group each: at most some thousand rows. Fields of parts
    not asked for, and of windows with fewer than `least` symbols, are null."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    schema = kinds + ", " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())
    asked = frozenset(parts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _window(pdf, threshold, asked, least)
        row = {k: pdf[k].iloc[0] for k in keys} | {k: found.get(k) for k in FIELDS}
        return pd.DataFrame([row], columns=[*keys, *FIELDS])

    return pairs.select(*keys, "u", "v", "r").groupBy(*keys).applyInPandas(run, schema)


def barcodes(pairs: DataFrame, keys: list[str], far: float = FAR) -> DataFrame:
    """The bars themselves: keys, dim, birth, death."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bars = barcode(distances(_matrix(pdf)[1]), far)
        rows = [(dim, a, b) for dim in (0, 1) for a, b in bars[dim]]
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"dim": x, "birth": a, "death": b} for x, a, b in rows], columns=[*keys, "dim", "birth", "death"])

    return pairs.select(*keys, "u", "v", "r").groupBy(*keys).applyInPandas(run, kinds + ", dim int, birth double, death double")


def betti_sweep(pairs: DataFrame, keys: list[str], thresholds: list[float], signed: bool = False) -> DataFrame:
    """keys, threshold, betti0, betti1 for each window and threshold, in one pass: edges are pairs whose correlation (its
    size, unless signed) is at the threshold or above."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, r = _matrix(pdf)
        strength = np.nan_to_num(r if signed else np.abs(r), nan=-np.inf)
        rows = []
        for t in thresholds:
            strong = strength >= t
            parts = n_components([set(np.flatnonzero(x).tolist()) for x in strong])
            rows.append({k: pdf[k].iloc[0] for k in keys} | {"threshold": t, "betti0": parts, "betti1": max(0, int(strong.sum() // 2) - len(names) + parts)})
        return pd.DataFrame(rows, columns=[*keys, "threshold", "betti0", "betti1"])

    return pairs.select(*keys, "u", "v", "r").groupBy(*keys).applyInPandas(run, f"{kinds}, threshold double, betti0 int, betti1 int")


def sweep_summary(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """The least threshold with one component (null if none has), the most cycles and the first threshold that has them."""
    one = F.min(F.when(F.col("betti0") == 1, F.col("threshold"))).alias("one_component")
    peak = F.max(F.struct("betti1", (-F.col("threshold")).alias("t"))).alias("m")
    return sweep.groupBy(*keys).agg(one, peak).select(*keys, "one_component", F.col("m.betti1").alias("max_betti1"), (-F.col("m.t")).alias("at_threshold"))


def node_invariants(pairs: DataFrame, keys: list[str], parts=frozenset({"core", "centrality", "removal"}), threshold: float = 0.3, least: int = 5) -> DataFrame:
    """keys, symbol and, as asked, core number, eigenvector centrality and the impact of the node's removal, for each window
    of at least `least` symbols."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, r = _matrix(pdf)
        w = np.where(np.abs(np.nan_to_num(r)) >= threshold, np.abs(np.nan_to_num(r)), 0.0)
        columns: dict = {k: pdf[k].iloc[0] for k in keys} | {"symbol": names if len(names) >= least else []}
        columns["core"] = cores([set(np.flatnonzero(x).tolist()) for x in w]) if "core" in parts else None
        columns["centrality"] = centrality(w) if "centrality" in parts else None
        columns["removal"] = removal_impact(w) if "removal" in parts else None
        if len(names) < least:
            return pd.DataFrame([], columns=[*keys, "symbol", "core", "centrality", "removal"])
        return pd.DataFrame(columns, columns=[*keys, "symbol", "core", "centrality", "removal"])

    return pairs.select(*keys, "u", "v", "r").groupBy(*keys).applyInPandas(run, f"{kinds}, symbol string, core int, centrality double, removal double")


def cycle_label_counts(pairs: DataFrame, keys: list[str], ks: list[int], threshold: float = 0.3) -> DataFrame:
    """keys, k, n_cycles and n_odd (see cycle_labels) for each window and each number of labels."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.nan_to_num(_matrix(pdf)[1])
        cycles = cycle_basis([np.flatnonzero(x).tolist() for x in np.abs(r) >= threshold])[:LENGTH_CYCLES]
        rows = [{k: pdf[k].iloc[0] for k in keys} | {"k": k, "n_cycles": len(cycles), "n_odd": cycle_labels(cycles, r, k)} for k in ks]
        return pd.DataFrame(rows, columns=[*keys, "k", "n_cycles", "n_odd"])

    return pairs.select(*keys, "u", "v", "r").groupBy(*keys).applyInPandas(run, f"{kinds}, k int, n_cycles int, n_odd int")


def gamma_series(rets: DataFrame, pairs: DataFrame, n: int, parts=frozenset({"topology", "cycles"}), include_last: bool = False, least: int = 5) -> DataFrame:
    """A row (rn, date and FIELDS) for every window of n rows that the series has, labelled by its last row: with fewer
    than `least` whole symbols there are no edges and the other fields are null. The newest row ends no window unless
    include_last. rets and pairs should be settled."""
    from corrolla.operators.panel import complete_windows, window_ends

    whole = complete_windows(rets, n).where("whole").groupBy("rn").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    found = window_invariants(pairs, ["rn"], parts, least=least)
    out = window_ends(rets, n, include_last).join(F.broadcast(whole), "rn", "left").join(found, "rn", "left")
    return out.withColumn("n_symbols", F.coalesce("_n", F.lit(0))).withColumn("n_edges", F.coalesce("n_edges", F.lit(0))).drop("_n")


def scenarios(pairs: DataFrame, symbols: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs of each scenario: all those without a symbol that it excludes (scenario, symbol). A pair's correlation does
    not depend on the universe, so nothing is computed again."""
    names = excluded.select("scenario").distinct()
    kept = names.crossJoin(F.broadcast(symbols)).join(F.broadcast(excluded), ["scenario", "symbol"], "left_anti")
    own = lambda c: F.broadcast(kept.select("scenario", F.col("symbol").alias(c)))  # noqa: E731  scenarios x symbols rows
    return pairs.join(own("u"), "u").join(own("v"), ["scenario", "v"])
