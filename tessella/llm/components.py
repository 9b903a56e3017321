"""Connected components of an edge table, by alternating large and small stars.

Each step is a grouped minimum and a join back on the vertex, so a hub's edges
are pre-aggregated before the shuffle and its join can be split by the engine.
Nothing but a count and two sums a round comes to the driver.

Up to ``ONE_TASK`` different edges are merged in one task instead: a round of stars
plans and schedules as much for a few edges as for many, and the driver keeps a
record of every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ONE_TASK = 500_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, least vertex that each reaches): greater roots hook to lesser ones until none differ."""
    ids, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return ids, ids[root]
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if held:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in least_reached(u, v)], ["id", "component"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select(F.col("u"), F.col("v"))
    if not small:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if small:  # u >= v holds: link every smaller neighbour, and u itself, to the least
        own = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        out = joined.select(F.explode(own).alias("e")).select("e.u", "e.v")
    else:  # link every greater neighbour to the least
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each vertex of an edge with the least vertex it reaches.

    Edges are undirected, may repeat and may be loops; vertices without an edge
    are not in the result.  An empty table gives an empty result.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= ONE_TASK:
        return edges.repartition(1).mapInArrow(_merge, "id long, component long")
    seen = None
    while True:
        edges = materialize(_star(_star(edges, small=False), small=True))
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
