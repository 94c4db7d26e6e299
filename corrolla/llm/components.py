"""Connected components of links between documents, without gathering links anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrolla.llm.common import send_small, written


def _contract_locally(batches):
    """Links of one partition -> the same connections as links to a smallest member."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in part]), pa.array(part)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, label: for every linked node the smallest node it can reach.

    Each round hooks every node to its smallest neighbour, follows the hooks twice, and goes on with the links between
    different roots; hooks are sent to every executor while they are small, else looked up by shuffled joins. Few rounds
    are needed, as paths shrink by a constant factor.
    """
    kind = f"a {links.schema['a'].dataType.simpleString()}, b {links.schema['b'].dataType.simpleString()}"
    edges = written(links.where("a <> b").select("a", "b").mapInArrow(_contract_locally, kind), "links")
    labels = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("label"))
        hooks = written(hooks, "hooks")
        for _ in range(2):
            up = send_small(hooks).select(F.col("node").alias("label"), F.col("label").alias("_up"))
            hooks = written(hooks.join(up, "label").select("node", F.col("_up").alias("label")), "hooks")
        sent = send_small(hooks)
        if labels is None:
            labels = hooks
        else:
            up = sent.select(F.col("node").alias("label"), F.col("label").alias("_up"))
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label")), "labels")
        for side in ("a", "b"):
            at = sent.select(F.col("node").alias(side), F.col("label").alias("_up"))
            edges = edges.join(at, side).drop(side).withColumnRenamed("_up", side)
        edges = written(edges.where("a <> b").distinct().select("a", "b").mapInArrow(_contract_locally, kind), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
