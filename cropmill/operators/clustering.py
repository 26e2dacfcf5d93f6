"""Clusters of vectors, three-dimensional projections, cluster summaries, and overlap of classes in space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropmill.operators.curation import random_order, sample_rows
from cropmill.operators.ivf import nearest_rows
from cropmill.storage import settle

#: Rows of a scope that density clustering is fitted on.
MOST_ROWS = 10_000


def _features(rows: DataFrame, vector_col: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))


def projection(rows: DataFrame, k: int = 3, vector_col: str = "feature") -> DataFrame:
    """``rows`` and ``pc``: centred principal components, padded with zeros to ``k``; each component's largest loading is positive."""
    if rows.limit(2).count() < 2:
        return rows.withColumn("pc", F.array_repeat(F.lit(0.0), k))
    data = _features(rows, vector_col)
    dim = len(rows.select(vector_col).first()[0])
    kk = min(k, dim)
    loadings = PCA(k=kk, inputCol="features", outputCol="p").fit(data).pc.toArray()
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), range(kk)])
    means = rows.select(F.posexplode(F.col(vector_col).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    shift = np.array([r.m for r in means]) @ loadings
    v = F.col(vector_col).cast("array<double>")
    columns = [F.aggregate(F.zip_with(v, F.lit([float(x) for x in loadings[:, c]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - float(shift[c]) for c in range(kk)]
    return rows.withColumn("pc", F.array(*columns, *[F.lit(0.0)] * (k - kk)))


def absorbed(x: np.ndarray, threshold: float, weight: np.ndarray | None = None, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sub-clusters (number, sum, sum of squared lengths) that rows grow one by one: a row joins the nearest if its radius stays within ``threshold``.

    Rows may be sub-clusters themselves: ``weight`` is their number and ``spread`` their squared lengths, ``x`` their sums.
    """
    weight = np.ones(len(x)) if weight is None else weight
    spread = (x * x).sum(axis=1) if spread is None else spread
    room = 64
    n, s, q = np.zeros(room), np.zeros((room, x.shape[1])), np.zeros(room)
    c, half, k = np.zeros((room, x.shape[1])), np.full(room, np.inf), 0  # centres and half their squared lengths
    for v, w, e in zip(x, weight, spread, strict=True):
        j = k
        if k:
            near = int((half[:k] - c[:k] @ (v / w)).argmin())
            m, t = n[near] + w, s[near] + v
            if max(0.0, (q[near] + e) / m - (t / m) @ (t / m)) <= threshold**2:
                j = near
        if j == k:
            if k == room:
                room *= 2
                n, q, half = (np.concatenate([y, np.full(k, f)]) for y, f in ((n, 0.0), (q, 0.0), (half, np.inf)))
                s, c = (np.concatenate([y, np.zeros_like(y)]) for y in (s, c))
            k += 1
        n[j], s[j], q[j] = n[j] + w, s[j] + v, q[j] + e
        c[j] = s[j] / n[j]
        half[j] = (c[j] * c[j]).sum() / 2
    return n[:k], s[:k], q[:k]


def bounded(n: np.ndarray, s: np.ndarray, q: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sub-clusters merged under growing thresholds until there are ``most`` at most, as a tree is rebuilt that has no more room."""
    while len(n) > most:
        threshold = max(threshold * 1.5, 1e-6)
        n, s, q = absorbed(s, threshold, n, q)
    return n, s, q


def merged(n: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """The group of each of a few sub-clusters: centres are merged to ``k`` by the least increase of squared distances (Ward)."""
    n, c = n.astype(float).copy(), s / n[:, None]
    group, live = np.arange(len(n)), np.ones(len(n), bool)
    d = np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * c @ c.T, 0) * (n[:, None] * n[None]) / (n[:, None] + n[None])
    np.fill_diagonal(d, np.inf)
    for _ in range(len(n) - k):
        a, b = sorted(divmod(int(d.argmin()), len(n)))
        c[a] = (c[a] * n[a] + c[b] * n[b]) / (n[a] + n[b])
        n[a] += n[b]
        group[group == b] = a
        live[b] = False
        d[b], d[:, b] = np.inf, np.inf
        row = ((c - c[a]) ** 2).sum(axis=1) * (n * n[a]) / (n + n[a])
        row[~live] = np.inf
        row[a] = np.inf
        d[a], d[:, a] = row, row
    return np.unique(group, return_inverse=True)[1]


def birch(x: np.ndarray, threshold: float, k: int, most: int = 1_000) -> np.ndarray:
    """Labels of rows held by one task: those of the nearest of at most ``most`` sub-clusters, which are merged to ``k``."""
    n, s, _ = bounded(*absorbed(x, threshold), threshold, most)
    return merged(n, s, k)[nearest_rows(x, s / n[:, None])]


def hdbscan(x: np.ndarray, min_size: int, min_samples: int) -> np.ndarray:
    """Density labels, -1 for noise: minimum spanning tree of mutual reachability, condensed, clusters of most stability."""
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    squares, kth = (x**2).sum(axis=1), min(min_samples, n - 1)

    def distances(a: int, b: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[a:b, None] + squares[None] - 2 * x[a:b] @ x.T, 0))

    # Distances are computed in blocks of rows, and again row by row as the tree grows, so memory is linear.
    core = np.concatenate([np.partition(distances(a, a + 512), kth, axis=1)[:, kth] for a in range(0, n, 512)])
    inside, best, parent, links = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(distances(at, at + 1)[0], np.maximum(core[at], core))
        closer = (reach < best) & ~inside
        best[closer], parent[closer] = reach[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        links.append((best[at], parent[at], at))
    links.sort()
    root, size, child, height = list(range(2 * n)), [1] * n + [0] * n, {}, {}

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, (w, a, b) in enumerate(links):
        a, b, me = find(a), find(b), n + i
        root[a] = root[b] = me
        size[me], child[me], height[me] = size[a] + size[b], (a, b), w
    lam = lambda w: 1 / max(w, 1e-12)

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += child[v]
        return out

    stability, kids, members = {}, {}, {}
    todo = [(2 * n - 2, 0.0)]
    while todo:
        top, birth = todo.pop()
        total, v, kids[top], members[top] = 0.0, top, [], points(top)
        while v >= n:
            a, b = child[v]
            at_ = lam(height[v])
            big = [c for c in (a, b) if size[c] >= min_size]
            if len(big) == 2:
                total += (size[a] + size[b]) * (at_ - birth)
                kids[top] = [a, b]
                todo += [(a, at_), (b, at_)]
                break
            total += sum(size[c] for c in (a, b) if c not in big) * (at_ - birth)
            if not big:
                break
            v = big[0]
        stability[top] = total
    labels, chosen, value = np.full(n, -1), {}, {}
    for top in sorted(stability, key=lambda t: t):
        below = sum(value[c] for c in kids[top])
        own = stability[top] if top != 2 * n - 2 else -1.0
        value[top] = max(own, below)
        chosen[top] = own >= below if kids[top] else own >= 0
    todo, k = [2 * n - 2], 0
    while todo:
        top = todo.pop()
        if chosen[top]:
            labels[members[top]] = k
            k += 1
        else:
            todo += kids[top]
    return labels


def cluster(rows: DataFrame, method: str = "kmeans", k: int = 8, scope: str = "global", seed: int = 42, id_col: str = "record_idx", vector_col: str = "feature", most: int = MOST_ROWS) -> DataFrame:
    """``rows`` and ``cluster_label``, ``cluster_id`` (dense over sorted labels). An empty table gives an empty table.

    ``scope`` is ``global`` (labels ``Gnn``), ``per_class`` or ``class_size`` (``name / Cnn``); noise is ``noise``. Every row gets a label,
    whatever the size of its scope. Spark's own models cluster the whole table; within scopes k-means and BIRCH work on sums of all tasks.
    Density clustering is fitted on a sample of ``most`` rows of each scope (the smallest hashes of id and seed); rows that are not in it
    take the label of their nearest row there.
    """
    keys = {"global": [], "per_class": ["class_name"], "class_size": ["class_name", "size_bucket"]}[scope]
    rows = rows.withColumn("scope_name", F.concat_ws(" / ", *keys) if keys else F.lit(""))
    if rows.limit(1).count() == 0:
        return rows.drop("scope_name").withColumn("cluster_label", F.lit("")).withColumn("cluster_id", F.lit(0))
    if method in ("kmeans", "bisecting") and not keys:
        n = rows.count()
        maker = KMeans(k=max(2, min(k, n)), seed=seed, maxIter=80) if method == "kmeans" else BisectingKMeans(k=max(2, min(k, n)), seed=seed)
        labelled = maker.fit(_features(rows, vector_col)).transform(_features(rows, vector_col)).drop("features").withColumnRenamed("prediction", "raw")
    else:
        narrow = rows.select("scope_name", F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
        if method == "birch":
            models = birch_models(narrow, 0.5, k)
        elif method == "hdbscan":
            models = density_models(narrow, k, seed, most)
        else:
            models = lloyd_models(narrow, k, seed)
        labelled = rows.join(nearest_labels(narrow, models).withColumnRenamed("id", id_col), id_col)
    short = F.when(F.col("raw") < 0, "noise").otherwise(F.format_string("G%02d" if not keys else "C%02d", F.col("raw")))
    label = short if not keys else F.concat(F.col("scope_name"), F.lit(" / "), short)
    labelled = labelled.withColumn("cluster_label", label).drop("scope_name", "raw")
    ids = labelled.select("cluster_label").distinct().withColumn("cluster_id", F.row_number().over(Window.orderBy("cluster_label")) - 1)
    return labelled.join(ids, "cluster_label")


def nearest_labels(narrow: DataFrame, models: DataFrame) -> DataFrame:
    """``(id, raw)``: the label of each row's nearest point of its scope's model ``(scope_name, points, raws)``."""
    held = settle(models, "models")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: dict[str, tuple] = {}
        for batch in batches:
            frame = pd.DataFrame({"scope": batch.column(0).to_pylist(), "id": batch.column(1).to_pylist(), "v": batch.column(2).to_pylist()})
            for name, group in frame.groupby("scope", sort=False):
                if name not in points:
                    points[name] = shared.value[name]
                p, raws = points[name]
                raw = raws[nearest_rows(np.array(group["v"].tolist()), p)]
                yield pa.RecordBatch.from_arrays([pa.array(group["id"].to_numpy()), pa.array(raw.astype(np.int32))], names=["id", "raw"])

    # Scopes times points of a model (at most k, or the sample) bound what is sent.
    own = {r.scope_name: (np.array(r.points), np.array(r.raws)) for r in held.toLocalIterator()}
    shared = narrow.sparkSession.sparkContext.broadcast(own)
    return narrow.mapInArrow(run, "id long, raw int")


def lloyd_models(narrow: DataFrame, k: int, seed: int, rounds: int = 20) -> DataFrame:
    """K-means in every scope at once: each round a task adds up its rows by scope and nearest centre, and only the sums are gathered."""
    place = F.row_number().over(Window.partitionBy("scope_name").orderBy(random_order("id", seed), "id"))
    first = narrow.select("scope_name", "id").withColumn("place", place).where(F.col("place") <= k)
    start = first.join(narrow, ["scope_name", "id"]).groupBy("scope_name").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("c"))
    centers = {r.scope_name: np.array([x.v for x in r.c]) for r in start.toLocalIterator()}
    sc = narrow.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                frame = pd.DataFrame({"scope": batch.column(0).to_pylist(), "v": batch.column(1).to_pylist()})
                for name, group in frame.groupby("scope", sort=False):
                    x, c = np.array(group["v"].tolist()), shared.value[name]
                    n, s = sums.setdefault(name, (np.zeros(len(c)), np.zeros_like(c)))
                    near = nearest_rows(x, c)
                    np.add.at(s, near, x)
                    n += np.bincount(near, minlength=len(c))
            for name, (n, s) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["scope_name", "at", "n", "s"])

        parts = narrow.select("scope_name", "v").mapInArrow(run, "scope_name string, at int, n double, s array<double>")
        total = parts.groupBy("scope_name", "at").agg(F.sum("n").alias("n"), F.array_agg("s").alias("s"))
        # Sums of tasks are added in a fixed order of theirs, so that a run gives the same labels again.
        add = F.aggregate(F.slice(F.array_sort("s"), 2, F.size("s")), F.element_at("s", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        moved, new = 0.0, {name: c.copy() for name, c in centers.items()}
        for r in total.withColumn("s", F.array_sort("s")).select("scope_name", "at", "n", add.alias("s")).toLocalIterator():
            if r.n:
                new[r.scope_name][r["at"]] = np.array(r.s) / r.n
                moved = max(moved, float(np.abs(new[r.scope_name][r["at"]] - centers[r.scope_name][r["at"]]).max()))
        centers = new
        if moved < 1e-6:
            break
    rows = [(name, c.tolist(), list(range(len(c)))) for name, c in centers.items()]
    return narrow.sparkSession.createDataFrame(rows, "scope_name string, points array<array<double>>, raws array<int>")


def birch_models(narrow: DataFrame, threshold: float, k: int, most: int = 1_000) -> DataFrame:
    """Sub-clusters grown by every task over its rows in order of their ids, then by one task for each scope, and merged to ``k``."""
    parts = max(1, -(-narrow.count() // 50_000))

    def grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        for frame in frames:
            for name, group in frame.groupby("scope_name", sort=True):
                x = np.array(group["v"].tolist())
                n, s, q = held.get(name, (np.zeros(0), np.zeros((0, x.shape[1])), np.zeros(0)))
                both = absorbed(np.concatenate([s, x]), threshold, np.concatenate([n, np.ones(len(x))]), np.concatenate([q, (x * x).sum(axis=1)]))
                held[name] = bounded(*both, threshold, most)
        for name, (n, s, q) in held.items():
            yield pd.DataFrame({"scope_name": name, "n": n, "s": s.tolist(), "q": q})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "q"], ascending=False, kind="stable")
        n, s, _ = bounded(*absorbed(np.array(group["s"].tolist()), threshold, group["n"].to_numpy(), group["q"].to_numpy()), threshold, most)
        return pd.DataFrame({"scope_name": [group["scope_name"].iloc[0]], "points": [(s / n[:, None]).tolist()], "raws": [merged(n, s, min(k, len(n))).tolist()]})

    dealt = narrow.repartition(parts, "id").sortWithinPartitions("scope_name", "id").select("scope_name", "v")
    subs = dealt.mapInPandas(grown, "scope_name string, n double, s array<double>, q double")
    return subs.groupBy("scope_name").applyInPandas(joined, "scope_name string, points array<array<double>>, raws array<int>")


def density_models(narrow: DataFrame, k: int, seed: int, most: int) -> DataFrame:
    """Density labels of a sample of each scope, ``most`` rows at most."""
    place = F.row_number().over(Window.partitionBy("scope_name").orderBy(random_order("id", seed), "id"))
    chosen = narrow.select("scope_name", "id").withColumn("place", place).where(F.col("place") <= most)
    sample = chosen.join(narrow, ["scope_name", "id"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.array(group["v"].tolist())
        least = max(5, min(100, len(x) // max(2, min(k, len(x)))))
        raw = hdbscan(x, least, max(2, least // 2))
        return pd.DataFrame({"scope_name": [group["scope_name"].iloc[0]], "points": [x.tolist()], "raws": [raw.tolist()]})

    return sample.groupBy("scope_name").applyInPandas(run, "scope_name string, points array<array<double>>, raws array<int>")


def summarize(rows: DataFrame) -> DataFrame:
    """Clusters: dominant class and size with purities and mixes (commonest five; ties by name)."""
    total = rows.groupBy("cluster_label").agg(F.count("*").alias("count"), F.round(F.avg("area_ratio") * 100, 3).alias("avg_area_pct"))

    def mix(column: str, many: str, top: str, purity: str, text: str) -> DataFrame:
        n = rows.groupBy("cluster_label", column).agg(F.count("*").alias("n"))
        ranked = n.groupBy("cluster_label").agg(F.count("*").alias(many), F.sum("n").alias("s"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(column).alias("c")))).alias("l"))
        return ranked.select("cluster_label", many, F.col("l")[0]["c"].alias(top), F.round(-F.col("l")[0]["m"] / F.col("s"), 4).alias(purity), F.array_join(F.transform(F.slice("l", 1, 5), lambda x: F.concat(x["c"], F.lit(":"), (-x["m"]).cast("string"))), ", ").alias(text))

    return total.join(mix("class_name", "n_classes", "dominant_class", "class_purity", "class_mix"), "cluster_label").join(mix("size_bucket", "n_size_buckets", "dominant_size", "size_purity", "size_mix"), "cluster_label")


def sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    return sample_rows(rows, most, seed)


def nearest_other_class(neighbors: DataFrame, rows: DataFrame) -> DataFrame:
    """``(record_idx, other_idx, distance)``: the first neighbour of another class; ``neighbors`` is ranked with ``distance``."""
    sided = neighbors.join(rows.select("record_idx", "class_name"), "record_idx").join(rows.select(F.col("record_idx").alias("neighbor_idx"), F.col("class_name").alias("other")), "neighbor_idx").where("class_name <> other")
    return sided.groupBy("record_idx").agg(F.min_by(F.struct(F.col("neighbor_idx").alias("other_idx"), "distance"), "rank").alias("n")).select("record_idx", "n.*")


def overlap(near: DataFrame, percentile: float, max_points: int = 0, max_pairs: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records within the percentile of distances to another class with their partners, and the pairs, each once.

    A report asks for the nearest ``max_points`` records and ``max_pairs`` pairs, by distances of five places, then by ids.
    """
    bound = near.agg(F.expr(f"percentile(distance, {percentile / 100})").alias("bound"))
    seeds = near.join(F.broadcast(bound)).where("distance <= bound").drop("bound")
    ids = seeds.select("record_idx").union(seeds.select(F.col("other_idx").alias("record_idx"))).distinct()
    points = near.join(ids, "record_idx", "left_semi")
    pairs = seeds.groupBy(F.least("record_idx", "other_idx").alias("a"), F.greatest("record_idx", "other_idx").alias("b")).agg(F.round(F.min("distance"), 5).alias("distance"))
    if max_points:
        points = points.orderBy(F.round("distance", 5), "record_idx").limit(max_points)
    if max_pairs:
        pairs = pairs.orderBy("distance", "a", "b").limit(max_pairs)
    return points, pairs
