"""Nearest neighbours by inner product: vantage-point trees, one a shard.

Largest inner product becomes smallest Euclidean distance with one more component: x is stored as (x, sqrt(M^2 - |x|^2)) / M for the
largest norm M, a query is (q, 0) / |q| (Bachrach et al. 2014); then |q' - x'|^2 = 2 - 2 q.x / (M |q|).

Every vector is put in a shard of a bounded number of rows. A shard's tree splits at the median distance from a vantage point, down to
leaves that are compared as one matrix product. A query enters a branch only if the triangle inequality allows a closer vector there:
it skips the branch when ``factor`` times the bound exceeds its k-th best distance. Factor 1 is exact; larger factors prune more and may
lose neighbours. Equal vectors stand in a tree once, with all their ids.

Queries are cut into blocks and each block meets each shard, so neither side is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A leaf holds at most this many distinct vectors.
LEAF = 256
#: Distances are compared with this slack, so that rounding loses nothing (a distance near zero is known to about 1e-8).
SLACK = 1e-7


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    return np.cumsum(q * x, axis=-1)[..., -1] if x.shape[-1] else np.zeros(np.broadcast_shapes(q.shape, x.shape)[:-1])


class Tree:
    """A vantage-point tree over distinct rows, which are reordered so that each node is a slice."""

    def __init__(self, points: np.ndarray, seed: int = 5) -> None:
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        self._build(0, len(points), rng)
        self.points = np.ascontiguousarray(points[self.order])

    def _build(self, a: int, b: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if b - a <= LEAF:
            self.nodes[me] = (a, b)
            return me
        own = self.order[a:b]
        vantage = self.points[own[rng.integers(b - a)]]
        d = np.sqrt(np.maximum(((self.points[own] - vantage) ** 2).sum(axis=1), 0))
        by = np.argsort(d, kind="stable")
        self.order[a:b] = own[by]
        d, cut = d[by], (b - a) // 2
        near, far = self._build(a, a + cut, rng), self._build(a + cut, b, rng)
        self.nodes[me] = (vantage, (d[0], d[cut - 1]), (d[cut], d[-1]), near, far)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query, positions in ``points`` that hold its ``k`` nearest (with ties, and perhaps some more)."""
        n = len(queries)
        worst = np.full(n, np.inf)
        best = np.full((n, k), np.inf)
        kept: list[list[np.ndarray]] = [[] for _ in range(n)]
        far_of: list[list[np.ndarray]] = [[] for _ in range(n)]

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            open_ = factor * bound <= worst[rows] + SLACK
            rows = rows[open_]
            if not len(rows):
                return
            at = self.nodes[node]
            if len(at) == 2:
                a, b = at
                d = np.sqrt(np.maximum(2 - 2 * (queries[rows] @ self.points[a:b].T), 0)) if b > a else np.zeros((len(rows), 0))
                hit = d <= worst[rows][:, None] + SLACK
                if b - a > k:
                    hit &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + SLACK
                both = np.concatenate([best[rows], np.where(hit, d, np.inf)], axis=1)
                best[rows] = np.partition(both, k - 1, axis=1)[:, :k]
                worst[rows] = best[rows].max(axis=1)
                for i in np.flatnonzero(hit.any(axis=1)):
                    at_hits = np.flatnonzero(hit[i])
                    kept[rows[i]].append(at_hits + a)
                    far_of[rows[i]].append(d[i, at_hits])
                return
            vantage, near_span, far_span, near, far = at
            d = np.sqrt(np.maximum(((queries[rows] - vantage) ** 2).sum(axis=1), 0))
            bound = bound[open_]
            ways = []
            for span, child in ((near_span, near), (far_span, far)):
                ways.append((np.maximum(bound, np.maximum(span[0] - d, d - span[1])), child))
            first = ways[0][0] <= ways[1][0]
            for (lower, child), mine in ((ways[0], first), (ways[1], ~first), (ways[0], ~first), (ways[1], first)):
                visit(child, rows[mine], lower[mine])

        visit(0, np.arange(n), np.zeros(n))
        out = []
        for i in range(n):
            at = np.concatenate(kept[i]) if kept[i] else np.zeros(0, np.int64)
            d = np.concatenate(far_of[i]) if far_of[i] else np.zeros(0)
            out.append(at[d <= worst[i] + SLACK])
        return out


class Shard:
    """The vectors of one shard with their ids; equal vectors are one point."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float) -> None:
        order = np.argsort(ids, kind="stable")
        self.vectors, group = np.unique(vectors[order], axis=0, return_inverse=True)
        group = group.ravel()
        by = np.argsort(group, kind="stable")
        self.ids = ids[order][by]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(self.vectors)))))
        norms = (self.vectors**2).sum(axis=1)
        extra = np.sqrt(np.maximum(largest**2 - norms, 0))
        self.tree = Tree(np.concatenate([self.vectors, extra[:, None]], axis=1) / largest)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Iterator[tuple[int, int, float]]:
        """(query id, id, score) of each query's ``k`` best in this shard, itself left out; equal scores go to smaller ids."""
        unit = queries / np.sqrt((queries**2).sum(axis=1))[:, None]
        unit = np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)
        todo, want = np.arange(len(ids)), k + 1
        while len(todo):
            again = []
            for n, at in zip(todo.tolist(), self.tree.search(unit[todo], want, factor), strict=True):
                points = self.tree.order[at]
                scores = inner_products(queries[n][None, :], self.vectors[points])
                best: dict[int, float] = {}
                for p, s in zip(points, scores.tolist(), strict=True):
                    # Of equal vectors the k + 1 smallest ids are all that can be among k.
                    for i in self.ids[self.first[p] : min(self.first[p] + k + 1, self.first[p + 1])].tolist():
                        if i != ids[n] and s > best.get(i, -math.inf):
                            best[i] = s
                if len(best) < k and want < len(self.vectors):
                    again.append(n)  # ids with several vectors took the places of others
                    continue
                for s, i in sorted((-s, i) for i, s in best.items())[:k]:
                    yield int(ids[n]), i, -s
            todo, want = np.array(again, np.int64), 2 * want


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one key after another as blocks: key, number of rows, ids and vectors as bytes. Repeated rows stand once.

    A block has ``size`` rows at most.
    """
    key, ids, vectors, last = None, [], [], None

    def out() -> Iterator[pa.RecordBatch]:
        if ids:
            body = np.array(vectors, np.float64)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([key], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vectors": pa.array([body.tobytes()], pa.binary())})

    for batch in batches:
        for k, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if (k, i, v) == last:
                continue
            last = (k, i, v)
            if k != key or len(ids) >= size:
                yield from out()
                key, ids, vectors = k, [], []
            ids.append(i)
            vectors.append(v)
    yield from out()


_BLOCK = "shard long, n long, ids binary, vectors binary"


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, factor: float = 1.0, shard_rows: int = 16_384, query_rows: int = 2_048) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` nearest rows by inner product in double precision.

    A row is not its own neighbour (rows of the query's id are left out). Ties go to smaller ids; repeated ids are one candidate if
    their vectors are equal, and the better one counts if not. Vectors that are null, empty, zero, of another length than most, or
    with null or non-finite components take no part, nor do rows of null id. With fewer candidates all are returned; empty tables
    give an empty table. ``factor`` 1 is exact. Other columns are ignored.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)

    points, asked = usable(rows), usable(queries).distinct()
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    widths = points.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(squares).alias("top")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, largest = widths.width, math.sqrt(widths.top)
    shards = max(1, math.ceil(widths.n / shard_rows))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    # Dealt by a hash of id and vector, not by vector: copies spread over all shards.
    dealt = points.where(F.size("v") == width).select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), "id", "v")
    packed = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "id", "v").mapInArrow(lambda b: _pack(b, 2 * shard_rows), _BLOCK)
    ask = asked.where(F.size("v") == width).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("shard"), "id", "v")
    ask = ask.repartition(blocks, "shard").sortWithinPartitions("shard", "id", "v").mapInArrow(lambda b: _pack(b, 2 * query_rows), _BLOCK)
    ask = ask.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    met = packed.hint("merge").join(ask, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if last != (r["shard"], r["ids"]):
                    last = (r["shard"], r["ids"])
                    shard = Shard(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(r["n"], width), largest)
                found = list(shard.search(np.frombuffer(r["qids"], np.int64), np.frombuffer(r["qvectors"]).reshape(r["qn"], width), k, factor))
                if found:
                    q, i, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
