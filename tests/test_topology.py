import math

import numpy as np
import pandas as pd
import pytest

from corrolla.operators import inference as I, topology as N


def brute_h1(d, far=N.FAR):
    """Plain boundary-matrix reduction over all simplices up to triangles."""
    n = len(d)
    s = [((i,), 0.0) for i in range(n)]
    s += [((i, j), d[i, j]) for i in range(n) for j in range(i + 1, n) if d[i, j] <= far]
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                m = max(d[i, j], d[i, k], d[j, k])
                if m <= far:
                    s.append(((i, j, k), m))
    s.sort(key=lambda x: (x[1], len(x[0]), x[0]))
    at = {x[0]: i for i, x in enumerate(s)}
    low, bars, zero = {}, [], set()
    for i, (x, v) in enumerate(s):
        col = {at[x[:k] + x[k + 1 :]] for k in range(len(x))} if len(x) > 1 else set()
        while col and max(col) in low:
            col ^= low[max(col)]
        if col:
            low[max(col)] = col
            zero.discard(max(col))
            b = s[max(col)]
            if len(b[0]) == 2 and v > b[1]:
                bars.append((b[1], v))
        elif len(x) < 3:
            zero.add(i)
    bars += [(s[i][1], far) for i in zero if len(s[i][0]) == 2 and s[i][1] < far]
    return sorted(bars)


def graph(edges, n):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return [sorted(near[k]) for k in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_barcode_matches_plain_reduction(seed):
    rng = np.random.default_rng(seed)
    d = N.distances(np.corrcoef(rng.normal(size=(8, 12))))
    got = sorted(N.barcode(d)[1])
    assert np.allclose(got or np.zeros((0, 2)), brute_h1(d) or np.zeros((0, 2)))


def test_circle_has_one_long_bar():
    t = np.arange(6) * math.pi / 3
    p = np.stack([np.cos(t), np.sin(t)], 1)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    h0, h1 = N.barcode(d, far=3.0)
    assert len(h1) == 1 and len(h0) == 6
    assert h1[0] == pytest.approx((1.0, math.sqrt(3)))


def test_disconnected_parts_end_at_the_far_distance():
    r = np.full((4, 4), -1.0)
    r[:2, :2] = r[2:, 2:] = 1.0
    h0, _ = N.barcode(N.distances(r))
    assert [b for b in h0 if b[1] == N.FAR] == [(0.0, N.FAR)] * 2


@pytest.mark.parametrize("signs, unbalanced", [((1, 1, 1), 0), ((1, 1, -1), 1), ((1, -1, -1), 0)])
def test_triangle_balance(signs, unbalanced):
    r = np.zeros((3, 3))
    for (a, b), s in zip([(0, 1), (1, 2), (0, 2)], signs):
        r[a, b] = r[b, a] = s
    got = N.cycle_balance(N.cycle_basis(graph([(0, 1), (1, 2), (0, 2)], 3)), r)
    assert (got["n_cycles"], got["n_unb"]) == (1, unbalanced)


def test_no_edges_is_balanced():
    assert N.cycle_balance(N.cycle_basis(graph([], 2)), np.zeros((2, 2)))["balance_rate"] == 1.0


def test_cycle_basis_spans_the_cycles():
    """As many cycles as the cycle rank, each closed and simple, independent as sets of edges modulo 2."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(3, 14))
        edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        near = graph(edges, n)
        basis = N.cycle_basis(near)
        assert len(basis) == len(edges) - n + N.n_components([set(x) for x in near])
        rows = []
        for c in basis:
            assert len(set(c)) == len(c) >= 3
            ends = {tuple(sorted(e)) for e in zip(c, [*c[1:], c[0]])}
            assert ends <= set(edges) and len(ends) == len(c)
            rows.append(sum(1 << edges.index(e) for e in ends))
        lead = {}
        for row in rows:
            while row and row.bit_length() in lead:
                row ^= lead[row.bit_length()]
            assert row
            lead[row.bit_length()] = row


def test_cycle_counts_against_a_plain_walk():
    rng = np.random.default_rng(4)
    r = rng.uniform(-1, 1, (9, 9))
    r = np.triu(r, 1) + np.triu(r, 1).T
    near = [np.flatnonzero(np.abs(x) >= 0.3).tolist() for x in r]
    basis = N.cycle_basis(near)
    got = N.cycle_balance(basis, r)
    bad = strength = odd3 = 0
    for c in basis:
        p, label = 1.0, 0
        for a, b in zip(c, [*c[1:], c[0]]):
            p *= r[a, b]
            label += min(2, int((r[a, b] + 1) / 2 * 3))
        bad += p < 0
        strength += -p if p < 0 else 0
        odd3 += label % 3 != 0
    assert (got["n_unb"], got["n_cycles"], N.cycle_labels(basis, r, 3)) == (bad, len(basis), odd3)
    assert got["weighted_unb"] == pytest.approx(strength) and got["unb_3"] + got["unb_4"] + got["unb_5plus"] == bad


def brute_frustration(s):
    n = len(s)
    return min(sum(s[i, j] * (1 - 2 * (m >> i & 1)) * (1 - 2 * (m >> j & 1)) < 0 for i in range(n) for j in range(i + 1, n)) for m in range(1 << n))


def brute_cliques(near):
    n = len(near)
    full = [m for m in range(1, 1 << n) if all(b in near[a] for a in range(n) if m >> a & 1 for b in range(a + 1, n) if m >> b & 1)]
    return sum(not any(m != o and m & o == m for o in full) for m in full)


def test_graph_invariants_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(6):
        n = 8
        r = rng.uniform(-1, 1, (n, n))
        r = np.triu(r, 1) + np.triu(r, 1).T
        signed = np.where(np.abs(r) >= 0.3, r, 0)
        w, near = np.abs(signed), [set(np.flatnonzero(x).tolist()) for x in signed]
        assert brute_frustration(np.sign(signed)) <= N.frustration(np.sign(signed)) <= brute_frustration(np.sign(signed)) + 1
        assert N.maximal_cliques(near) == brute_cliques(near)
        from math import factorial
        walks = lambda a: sum(np.trace(np.linalg.matrix_power(a, k)) / factorial(k) for k in range(60))
        assert N.walk_balance(signed) == pytest.approx(walks(signed) / walks(w))
        lap = np.eye(n) - w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
        assert N.spectral_gap(w) == pytest.approx(max(0, np.sort(np.linalg.eigvalsh(lap))[1]), abs=1e-9)
        v = np.ones(n)
        for _ in range(4000):
            v = w @ v + v
            v /= np.linalg.norm(v)
        assert np.allclose(N.centrality(w), v, atol=1e-6)
        for k, impact in enumerate(N.removal_impact(w)):
            keep = [i for i in range(n) if i != k]
            a, b = N._simple(w), N._simple(w[np.ix_(keep, keep)])
            assert impact == pytest.approx(5 * abs(a[0] - b[0]) + 2 * abs(a[1] - b[1]) + 0.3 * (b[2] - a[2]))
        left = set(range(n))
        core = N.cores(near)
        for k in range(1, n):  # peel
            left = {i for i in range(n) if core[i] >= k}
            grown = set(range(n))
            while any(len(near[i] & grown) < k for i in grown):
                grown = {i for i in grown if len(near[i] & grown) >= k}
            assert left == grown


def test_sweep_and_summary(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 0.5), (1, "b", "c", -0.7), (1, "a", "c", 0.9)], "rn long, u string, v string, r double")
    got = {x["threshold"]: (x["betti0"], x["betti1"]) for x in N.betti_sweep(pairs, ["rn"], [0.1, 0.6, 0.95]).collect()}
    assert got == {0.1: (1, 1), 0.6: (1, 0), 0.95: (3, 0)}
    signed = {x["threshold"]: (x["betti0"], x["betti1"]) for x in N.betti_sweep(pairs, ["rn"], [0.1, 0.6], signed=True).collect()}
    assert signed == {0.1: (1, 0), 0.6: (2, 0)}
    s = N.sweep_summary(N.betti_sweep(pairs, ["rn"], [0.1, 0.2, 0.95]), ["rn"]).first()
    assert (s["one_component"], s["max_betti1"], s["at_threshold"]) == (0.1, 1, 0.1)


def test_graph_invariants_on_small_graphs():
    w = np.ones((4, 4)) - np.eye(4)
    near = [set(np.flatnonzero(x).tolist()) for x in w]
    assert N.cores(near) == [3] * 4 and N.maximal_cliques(near) == 1 and N.clustering(w) == pytest.approx(1.0)
    assert N.spectral_gap(np.zeros((3, 3))) == 0 and N.communities(np.zeros((3, 3))) == 3
    two = np.kron(np.eye(2), np.ones((3, 3))) - np.eye(6)
    assert N.communities(two) == 2 and N.spectral_gap(two) == pytest.approx(0, abs=1e-9)
    s = np.array([[0, 1, 1], [1, 0, -1], [1, -1, 0]])
    assert N.frustration(s) == 1 and N.frustration(np.abs(s)) == 0
    assert N.walk_balance(np.abs(s).astype(float)) == pytest.approx(1.0)


def test_window_gate_and_empty(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 0.5)], "rn long, u string, v string, r double")
    row = N.window_invariants(pairs, ["rn"]).first()
    assert row["n_symbols"] == 2 and row["n_edges"] == 0 and row["l1"] is None
    assert N.window_invariants(pairs.limit(0), ["rn"]).count() == 0


def test_f_tail_known_values():
    assert I.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert I.f_tail(2.978237, 10, 10) == pytest.approx(0.05, abs=1e-6)


def test_pc_finds_a_collider():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 4000))
    c = a + b + 0.3 * rng.normal(size=4000)
    got = set(I.pc_graph(np.corrcoef([a, b, c]), 4000, ["a", "b", "c"]))
    assert got == {("a", "c", "directed"), ("b", "c", "directed")}


def test_random_blocks_do_not_overlap():
    on = I.random_blocks(200, 5, 7, np.random.default_rng(1))
    assert on.sum() == 35
