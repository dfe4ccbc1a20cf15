"""Connected components by alternating large and small stars, with tables in the shared folder between the rounds; of few
edges, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize

#: So many edges (about 30 MB) are joined in one task, which takes less than the stages of a single round.
EDGES_A_TASK = 1 << 17


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (a, b) here, by union and find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], ["id", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (or other) neighbours on its smallest neighbour, or itself if that is smaller."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(turned) if large else edges
    least = materialize(both.groupBy("a").agg(F.min("b").alias("least")), "least")
    hung = both.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
    else:
        out = hung.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for all ids of edges (a, b), component being the smallest id reachable. Loops and repeated
    edges do not matter; no edges give no rows. Rounds end where EDGES_A_TASK edges are left, which one task joins. A hub's neighbours are pre-aggregated before the shuffle, and the
    join with its minimum is one that Spark splits when skewed."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new[0] <= EDGES_A_TASK:
            return now.repartition(1).mapInArrow(_united, "id long, component long")
        if new == sign:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        sign, last = new, now
        now = materialize(_star(_star(now, True), False), "stars")
        discard(last)
