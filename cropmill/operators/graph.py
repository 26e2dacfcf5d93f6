"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropmill.storage import release, settle

#: Edge tables up to this size are solved by one task; a few arrays of this length are what it holds.
SMALL = 1_000_000


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each component of nodes 0 to n-1 under the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _solved_at_once(live: DataFrame, kind: T.DataType) -> DataFrame:
    """``(node, root)`` of a small edge table, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ends = pa.chunked_array([c for side in (0, 1) for c in (b.column(side) for b in held)]).combine_chunks()
        nodes = ends.unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        place = pc.index_in(ends, nodes).to_numpy(zero_copy_only=False).astype(np.int64)
        root = least_members(place[: len(place) // 2], place[len(place) // 2 :], len(nodes))
        for at in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([nodes[at : at + 100_000], nodes.take(pa.array(root[at : at + 100_000]))], names=["node", "root"])

    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    return live.select("hi", "lo").coalesce(1).mapInArrow(run, schema)


def _to_roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` (parent < node) to the roots by pointer doubling."""
    before = None
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = parents.join(up, "parent", "left")
        jumped = jumped.select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
        jumped = settle(jumped, "jump")
        release(before)
        before, parents = jumped, jumped.select("node", "parent")
        if jumped.where("moved").limit(1).count() == 0:
            return jumped


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """``(node, root)`` for every endpoint of ``edges``; ``root`` is the smallest node of the component.

    Each round hangs every node below its smallest neighbour, follows the pointers to their roots and contracts the graph, so
    that rounds grow with the logarithm of the node count. Rounds are written to the shared folder and deleted once the next one is;
    nothing but counts reaches the driver. Once at most ``small`` edges are left, one task solves them. Null endpoints and self loops
    are dropped; an empty input gives an empty table.
    """
    kind = edges.schema[src].dataType
    a, b = F.col(src).cast(kind), F.col(dst).cast(kind)
    live = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null and hi <> lo")
    live = settle(live.distinct(), "edges")
    labels = None
    while live.limit(small + 1).count() > small:
        parents = _to_roots(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        below = parents.select(F.col("node").alias("k"), F.col("parent").alias("to"))
        if labels is None:  # every endpoint is its own root at first, those that nothing hangs below too
            first = live.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("root", F.col("node"))
        old, labels = labels, settle(_relabelled(first if labels is None else labels, below), "labels")
        moved = live
        for c in ("hi", "lo"):
            moved = moved.join(below, F.col(c) == F.col("k"), "left").withColumn(c, F.coalesce("to", c)).drop("k", "to")
        done, live = live, settle(moved.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi <> lo").distinct(), "edges")
        release(old, parents, done)
    roots = settle(_solved_at_once(live, kind), "roots")
    release(live)
    if labels is None:
        return roots
    out = settle(_relabelled(labels, roots.select(F.col("node").alias("k"), F.col("root").alias("to"))), "labels")
    release(labels, roots)
    return out


def _relabelled(labels: DataFrame, below: DataFrame) -> DataFrame:
    return labels.join(below, F.col("root") == F.col("k"), "left").select("node", F.coalesce("to", "root").alias("root"))
