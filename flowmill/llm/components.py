"""Connected components of a graph given as edges, without bringing edges to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.session import scratch_scope, stage

#: Edges that one task reduces to stars.
TASK_EDGES = 200_000


def _contract(batches):
    """The edges of one task as stars: every node with the smallest node that these edges reach."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                above[max(x, y)] = min(x, y)
    nodes = np.fromiter(above, np.int64, len(above))
    roots = np.fromiter((root(x) for x in list(above)), np.int64, len(above))
    far = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a staged table of edges (a, b).

    Each task first reduces its own edges to stars. Then, each round, every node takes the smallest
    label among its neighbours, and then the label of its label (pointer jumping), so long paths
    halve. Rounds are written tables; the only number that reaches the driver is whether labels changed.
    """
    with scratch_scope(edges.sparkSession) as scope:
        # the more edges a task holds, the fewer rounds are left between tasks
        dealt = edges.where("a <> b").select("a", "b").coalesce(1 + edges.count() // TASK_EDGES)
        stars = dealt.mapInArrow(_contract, "a long, b long")
        both = stage(stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
        labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
        while True:
            near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
            up = least.select(F.col("node").alias("least"), F.col("least").alias("above"))
            jumped = stage(least.join(up, "least").select("node", F.least("least", "above").alias("label"), (F.col("label") != F.least("least", "above")).alias("changed")), "labels")
            scope.free(labels)
            labels = jumped
            if not jumped.where("changed").limit(1).count():
                scope.keep(jumped)
                return jumped.select("node", F.col("label").alias("component"))


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components once more edges are known: only their own graph, of components, is worked on.

    ``labels`` are the components so far, None for none; nodes that were on no edge are their own.
    """
    if labels is None:
        return stage(components(links), "components")
    with scratch_scope(labels.sparkSession) as scope:
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        ends = ends.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        ends = stage(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "contracted")
        joined = components(ends)
        held = labels.join(joined.select(F.col("node").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left")
        held = held.select("node", F.coalesce("new", "component").alias("component"))
        # a node that had no component stands in the contracted graph itself
        fresh = joined.join(labels.select("node"), "node", "left_anti")
        return scope.keep(stage(held.union(fresh), "components"))
