"""Quality classifier: tree paths as rules over text statistics, lasso logistic weights, scores as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corrolla.llm.common import read_documents, text_or_empty

#: Labelled rows that the fit reads at most; those with the smallest hashes of their ids.
FIT_ROWS = 20_000
_SPACE_CHARS = " \t\n\x0b\f\r"
_SPACE = r"[\x20\x09-\x0D]+"


def text_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Each row of docs as a structure _row beside the statistics that rules are made of, and their names. All are
    doubles, never null; whatever docs' columns are called, they clash with nothing."""
    counted = {
        "_upper": r"\p{Lu}",
        "_digit": r"\p{Nd}",
        "_symbol": r"[#*$%&|<>_=~^{}\\\[\]]",
        "_bang": r"[!?]",
        "_stop": r"[.,;:]",
    }
    text = F.col("_stext")
    length = F.char_length(text)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_or_empty(text_col).alias("_stext"))
    df = df.withColumn("_strim", F.trim(text, F.lit(_SPACE_CHARS)))
    df = df.withColumn("_swords", F.when(F.col("_strim") == "", F.array().cast("array<string>")).otherwise(F.split("_strim", _SPACE)))
    df = df.withColumn("_slines", F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACE_CHARS)) != ""))
    df = df.withColumn("_schars", F.greatest(length, F.lit(1)).cast("double"))
    df = df.withColumn("_sn", F.greatest(F.size("_swords"), F.lit(1)).cast("double"))
    df = df.withColumn("_snl", F.greatest(F.size("_slines"), F.lit(1)).cast("double"))
    same = F.expr("zip_with(slice(_swords, 1, size(_swords) - 1), slice(_swords, 2, size(_swords)), (a, b) -> a = b)")
    again = F.when(F.size("_swords") < 2, F.lit(0)).otherwise(F.size(F.filter(same, lambda x: x)))
    statistics = {
        "s_words": F.log1p(F.size("_swords").cast("double")),
        "s_word_length": F.char_length(F.array_join("_swords", "")) / F.col("_sn"),
        "s_distinct": F.size(F.array_distinct("_swords")) / F.col("_sn"),
        "s_repeated": again / F.col("_sn"),
        "s_lines": F.log1p(F.size("_slines").cast("double")),
        "s_line_words": F.size("_swords") / F.col("_snl"),
        "s_line_copies": 1 - F.size(F.array_distinct("_slines")) / F.col("_snl"),
    }
    for name, pattern in counted.items():
        statistics[f"s{name}"] = (length - F.char_length(F.regexp_replace(text, pattern, ""))) / F.col("_schars")
    df = df.select("_row", *[x.cast("double").alias(n) for n, x in statistics.items()])
    return df, list(statistics)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, True for above or False for at most, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & (F.col(name) > at if above else F.col(name) <= at)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[n] > at) == above for n, above, at in self.terms])


@dataclass(frozen=True)
class RuleModel:
    """A sparse logistic model over rules."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(next(iter(x.values()))), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def _cuts(values: np.ndarray, most: int = 48) -> np.ndarray:
    """Thresholds halfway between neighbouring quantiles."""
    q = np.unique(np.quantile(values, np.linspace(0, 1, most + 1), method="nearest"))
    return (q[1:] + q[:-1]) / 2


def grow_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int, depth: int, rate: float, least: int, seed: int) -> list[Rule]:
    """Boost small trees on the logistic loss, each on half the rows; every path from a root to a node is a rule."""
    names = list(x)
    cuts = {n: _cuts(x[n]) for n in names}
    binned = {n: np.searchsorted(cuts[n], x[n], side="left") for n in names}  # > cuts[j] if and only if bin > j
    rng = np.random.default_rng(seed)
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p) + 1e-9
        use = rng.random(len(y)) < 0.5
        step = np.zeros(len(y))

        def split(rows: np.ndarray, inside: np.ndarray, terms: tuple, left: int):
            if terms:
                found.setdefault(tuple(sorted(terms)))
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if left and len(rows) >= 2 * least:
                for n in names:
                    if not len(cuts[n]):
                        continue
                    b, size = binned[n][rows], len(cuts[n]) + 1
                    gs, hs = np.bincount(b, g[rows], size).cumsum()[:-1], np.bincount(b, h[rows], size).cumsum()[:-1]
                    ns = np.bincount(b, minlength=size).cumsum()[:-1]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], n, j)
            if best[1] is None:
                step[inside] = rate * total_g / (total_h + 1)
                return
            _, n, j = best
            for above in (False, True):
                split(rows[(binned[n][rows] > j) == above], inside[(binned[n][inside] > j) == above], (*terms, (n, above, float(cuts[n][j]))), left - 1)

        split(np.flatnonzero(use), np.arange(len(y)), (), depth)
        z = z + step
    return [Rule(t) for t in found]


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weights of columns a (0 or 1) under an L1 penalty on the mean loss, by accelerated proximal steps; the bias is free."""
    n, m = a.shape
    mean, scale = a.mean(axis=0), np.maximum(a.std(axis=0), 1e-3)
    s = (a - mean) / scale
    rate = 4 / (np.linalg.norm(s.T @ s / n, 2) + 1)
    w = v = np.zeros(m)
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(s @ v + c))) - y
        w2 = v - rate * (s.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    w = w / scale
    return float(b - (w * mean).sum()), w


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    """A rule model of y (0 or 1). With one class only, or no rows, the score is a constant: the share of 1, or 0.5."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return RuleModel(float(np.log((share + 1e-3) / (1 - share + 1e-3))), ())
    least = max(3, len(y) // 400)
    rules = grow_rules(x, y, trees, depth, 0.3, least, seed)
    if not rules:
        share = float(y.mean())
        return RuleModel(float(np.log(share / (1 - share))), ())
    seen: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in sorted(rules, key=lambda r: (len(r.terms), r.terms)):
        holds = rule.holds(x)
        seen.setdefault(np.packbits(holds if holds[0] else ~holds).tobytes(), (rule, holds))  # rules that split the rows alike: the shortest
    kept = [v for v in seen.values() if 0 < v[1].sum() < len(y)]
    a = np.stack([h for _, h in kept], axis=1).astype(float)
    bias, w = lasso_logistic(a, y, penalty)
    return RuleModel(bias, tuple((r, float(v)) for (r, _), v in zip(kept, w) if abs(v) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> RuleModel:
    """Fit on at most fit_rows labelled rows, never on those whose crc32(id as text) mod 5 is 0. Ids with several
    different labels, null ids and null labels teach nothing."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col)
    own = own.agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z")
    own = own.select(F.col(id_col).alias("_lid"), "_y").orderBy(F.xxhash64("_lid", F.lit("fit")), "_lid").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("_dtext"))
    some, names = text_statistics(rows.join(F.broadcast(own), rows["_did"] == own["_lid"]), "_dtext")  # fit_rows ids at most
    taught = some.select("_row._did", "_row._y", *names).groupBy("_did").agg(F.first("_y").alias("_y"), *[F.min(n).alias(n) for n in names])
    pdf = taught.orderBy("_did").toPandas()
    return fit_rules({n: pdf[n].to_numpy(float) for n in names}, pdf["_y"].to_numpy(float))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, in place of a column of that name if there is one, higher where label 1 is
    likelier. Only the text counts; null counts as empty, and
    empty texts are scored by their statistics like others. An empty table gives an empty result."""
    scored, _ = text_statistics(docs, text_col)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != score_col]
    return scored.select(*kept, model.score().alias(score_col))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
