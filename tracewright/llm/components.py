"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.session import materialised

LINKS_A_TASK = 1_000_000  # two numbers each: 16 MB


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least): for each node of the links (a, b), in order, the least node that they reach."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    least = np.arange(len(nodes))
    while True:
        # Every node points at the root of its tree; roots that a link joins are pointed at the smaller one.
        low, high = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        apart = low < high
        if not apart.any():
            return nodes, nodes[least]
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(least, high, low)
        while (least[least] != least).any():
            least = least[least]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b), of which there are few."""
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    arrow = to_arrow_schema(out.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, schema=arrow)
        nodes, least = least_reached(*(whole.column(c).to_numpy() for c in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], schema=arrow)

    return materialised(out.coalesce(1).mapInArrow(run, out.schema))


def components(links: DataFrame, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """(node, component): the least node that links (a, b) reach, for every node that has a link; nodes are long numbers.

    Up to links_a_task links are followed in one task. That is one job; rounds of shuffles leave some hundred threads of
    exchanges in the driver, whose memory a long session does not get back. More links take such rounds:

    Large-star and small-star steps in turn: each node's neighbours are pointed at the least of them, first the greater
    neighbours, then the smaller ones. A step is one grouping for the least neighbour, with partial aggregates, and one
    join back that adaptive execution may split, so a node with many links costs one row a link. The number of rounds
    grows with the logarithm of the longest chain. Edges are written to the checkpoint folder after each round.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialised(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    if edges.count() <= links_a_task:
        return _in_one_task(edges)
    before = None
    while True:
        # Large star: v > u is pointed at the least of u and its neighbours.
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).where("a > b")
        large = large.distinct()
        # Small star: u and its smaller neighbours are pointed at the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        edges = materialised(small)
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            return edges.select(a.alias("node"), b.alias("component")).unionByName(
                edges.select(b.alias("node"), b.alias("component")).distinct())
        before = state
