"""Connected components of an edge table, by joins over tables in the shared scratch folder."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialise

#: Edges that one task may take at most; more are worked on by joins.
FEW_EDGES = 500_000


def _small(batches):
    """Union-find over all edges, the smallest node of a component as its root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["node", "label"])


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """(node, label) of every node of edges(a, b), which are longs: label is the smallest node that it reaches.

    At most `few` edges (FEW_EDGES unless given), as counted, go through one task. More are worked on in rounds: each
    lowers labels along the edges and then jumps to the label's own label, until nothing changes (labels only fall,
    so that comes).
    Nulls must not occur; repeated edges and loops do no harm."""
    pairs = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if pairs.count() <= (FEW_EDGES if few is None else few):
        return materialise(pairs.repartition(1).mapInArrow(_small, "node long, label long"), "labels")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("m", "node").alias("label")), "labels")
    for i in count():
        offers = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        lower = labels.join(offers, "node").select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        lower = materialise(lower, f"lower{i}")
        own = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        seen = Observation()
        jumped = lower.join(own, "label").select("node", "was", F.least("label", "jump").alias("label"))
        labels = materialise(jumped.observe(seen, F.count_if(F.col("label") < F.col("was")).alias("moved")), f"jumped{i}").select("node", "label")
        if not seen.get["moved"]:
            return labels
