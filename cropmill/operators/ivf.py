"""Inverted-file index: cells of a coarse quantiser, product-quantised residuals, search by the nearest cells and exact reranking.

A query is compared with the codes of the rows of its nearest cells: the inner product is that with the cell's centre and, for each
subspace, that with the row's code word, looked up in a table of the query. Blocks of a cell's rows meet blocks of the queries that probe
it; the best by codes are scored exactly where both vectors are, so no vector is joined to a candidate. Where all rows are to be reranked,
codes decide nothing, and each pair of blocks gives a query's best by exact scores at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cropmill.functions.geometry import largest_divisor
from cropmill.operators.curation import sample_rows
from cropmill.operators.knn import knn_join, search_width, unit

#: Below this many rows an index is flat.
FLAT_BELOW = 10_000
#: Rows whose residuals fit the code books, and their values; they are held by the driver.
BOOK_ROWS, BOOK_VALUES = 20_000, 16 << 20


def plan(n: int, nlist: int = 4096, nprobe: int = 32, train: int = 200_000, kind: str = "ivfpq", dim: int = 1792, m: int = 64) -> dict:
    """Parameters of an index over ``n`` rows: small tables are flat, cells have at least 40 training rows."""
    if kind == "flat" or n < FLAT_BELOW:
        return {"type": "flat"}
    train = min(n, train)
    cells = max(1, min(nlist, train // 40))
    return {"type": "ivfpq", "nlist": cells, "nprobe": min(nprobe, cells), "train": train, "m": largest_divisor(dim, m)}


def nearest_rows(x: np.ndarray, centers: np.ndarray, step: int = 4_096) -> np.ndarray:
    """For each row of ``x`` the number of its nearest centre; by products of bounded blocks."""
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([(half - x[a : a + step] @ centers.T).argmin(axis=1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def code_books(residual: np.ndarray, m: int, seed: int, words: int = 256, rounds: int = 6) -> list[np.ndarray]:
    """One book of at most ``words`` vectors for each of ``m`` subspaces."""
    rng, books = np.random.default_rng(seed), []
    for part in np.split(residual, m, axis=1):
        book = part[rng.choice(len(part), min(words, len(part)), replace=False)]
        for _ in range(rounds):
            near = nearest_rows(part, book)
            sums = np.zeros_like(book)
            np.add.at(sums, near, part)
            n = np.bincount(near, minlength=len(book))
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books.append(book)
    return books


def packed_vectors(v: np.ndarray) -> list[bytes]:
    """Each row's bytes: as single precision where that loses nothing, else as double."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return [(x if same else y).tobytes() for x, y, same in zip(short, v, (short == v).all(axis=1), strict=True)]


def unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    """``n`` vectors of one precision, as doubles."""
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * dim else np.float64).astype(np.float64).reshape(n, dim)


def best_pairs(q: np.ndarray, b: np.ndarray, qi: np.ndarray, bi: np.ndarray, k: int, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of both and cosines: for each row of ``q`` the ``k`` best other rows of ``b``, ties to smaller ids; ``most`` scores are held at once."""
    q, b = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) for x in (q, b))
    m, step = min(k, len(b)), max(1, most // len(b))
    for start in range(0, len(q), step):
        own, ids = q[start : start + step], qi[start : start + step]
        s = own @ b.T
        s[np.isnan(s)] = np.inf  # as a descending order has them
        s[ids[:, None] == bi[None, :]] = -np.inf
        edge = np.partition(s, len(b) - m, axis=1)[:, len(b) - m]
        # Ties with the last, and what rounding might have put below it, are kept for the exact order.
        row, col = np.nonzero((s >= edge[:, None] - 1e-9) & (s > -np.inf))
        cosine = np.empty(len(row))
        for a in range(0, len(row), 100_000):
            cosine[a : a + 100_000] = np.cumsum(own[row[a : a + 100_000]] * b[col[a : a + 100_000]], axis=1)[:, -1]
        yield first(ids[row], bi[col], cosine, k)


def first(query: np.ndarray, row: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` best of these pairs, ties to smaller ids; sorted by query."""
    order = np.lexsort((row, -np.where(np.isnan(cosine), np.inf, cosine), query))
    query, row, cosine = query[order], row[order], cosine[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], row[best], cosine[best]


def merged(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The pairs of a task's blocks, each query's ``k`` best as far as ``most`` pairs are held at once."""
    held, n = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        x, y, cosine = held[0]
        for a in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in (x, y, cosine)], names=["record_idx", "neighbor_idx", "similarity"])

    for pairs in found:
        held.append(pairs)
        n += len(pairs[0])
        if n > most:
            held = [first(*map(np.concatenate, zip(*held, strict=True)), k)]
            if (n := len(held[0][0])) > most // 2:  # too many queries for one table
                yield from out()
                held, n = [], 0
    if held:
        held = [first(*map(np.concatenate, zip(*held, strict=True)), k)]
        yield from out()


@dataclass
class Index:
    """``rows`` has (id, cell, codes and v as bytes), ``size`` of them; centres and books are what search needs besides."""

    rows: DataFrame
    centers: np.ndarray
    books: list[np.ndarray]
    size: int
    id_col: str = "record_idx"

    def save(self, path: str) -> None:
        """Write rows sorted by cell, so that readers skip what they don't probe, and the quantisers; ``open_index`` reads them back."""
        self.rows.repartition("cell").sortWithinPartitions("cell").write.parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        parts = [(-1, i, [float(x) for x in c]) for i, c in enumerate(self.centers)]
        parts += [(j, i, [float(x) for x in w]) for j, book in enumerate(self.books) for i, w in enumerate(book)]
        spark.createDataFrame(parts, "part int, place int, word array<double>").coalesce(1).write.parquet(f"{path}/quantisers")
        config = json.dumps({"type": "ivfpq", "id_col": self.id_col, "nlist": len(self.centers), "m": len(self.books), "dim": self.centers.shape[1]})
        spark.createDataFrame([(config,)], "value string").coalesce(1).write.text(f"{path}/config")

    def search(self, queries: DataFrame, k: int, nprobe: int = 32, rerank_k: int = 500, vector_col: str = "feature", block_rows: int = 4_096) -> DataFrame:
        """``(record_idx, neighbor_idx, similarity, rank)``: of the ``nprobe`` nearest cells' rows the ``rerank_k`` best by codes, then the ``k`` best by cosine.

        A row is not its own neighbour; ties go to smaller ids; null vectors take no part. From each pair of blocks ``rerank_k`` rows a query
        are shuffled; if ``rerank_k`` takes in the whole index, only ``k``, and these from all blocks of a task where they fit.
        """
        width, books, centers = max(k, rerank_k), self.books, self.centers
        shared = queries.sparkSession.sparkContext.broadcast((centers, books))
        asked = queries.select(F.col(self.id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
        probes, every = min(nprobe, len(centers)), width >= self.size

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = shared.value[0]
            half = (centers**2).sum(axis=1) / 2
            for batch in batches:
                v = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, centers.shape[1])
                cells = np.argpartition(half - v @ centers.T, probes - 1, axis=1)[:, :probes]
                at = np.repeat(np.arange(batch.num_rows), probes)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array(packed_vectors(v), pa.binary()).take(pa.array(at))], names=["cell", "id", "v"])

        left = packed(asked.mapInArrow(probed, "cell int, id long, v binary"), block_rows)
        right = packed(self.rows.select("cell", F.col(self.id_col).cast("long").alias("id"), "v", "codes"), block_rows)
        met = right.join(left.select("cell", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "vectors")]), "cell")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            dim = shared.value[0].shape[1]
            for batch in batches:
                for r in batch.to_pylist():
                    yield from best_pairs(unpacked(r["q_vectors"], r["q_n"], dim), unpacked(r["vectors"], r["n"], dim), np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64), k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, books = shared.value
            if every:
                yield from merged(best(batches), k)
                return
            for batch in batches:
                for r in batch.to_pylist():
                    q, b = (unpacked(data, n, centers.shape[1]) for data, n in ((r["q_vectors"], r["q_n"]), (r["vectors"], r["n"])))
                    qi, bi = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(r["n"], len(books))
                    s = np.repeat((q @ centers[r["cell"]])[:, None], r["n"], axis=1)
                    for part, book, own in zip(np.split(q, len(books), axis=1), books, codes.T, strict=True):
                        s += (part @ book.T)[:, own]
                    s[qi[:, None] == bi[None, :]] = -np.inf
                    m = min(width, s.shape[1])
                    edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                    row, col = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
                    q, b = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) for x in (q, b))
                    for a in range(0, len(row), 100_000):
                        x, y = row[a : a + 100_000], col[a : a + 100_000]
                        cosine = np.cumsum(q[x] * b[y], axis=1)[:, -1]
                        yield pa.RecordBatch.from_arrays([pa.array(qi[x]), pa.array(bi[y]), pa.array(s[x, y]), pa.array(cosine)], names=["record_idx", "neighbor_idx", "coded", "similarity"])

        chosen = met.mapInArrow(run, "record_idx long, neighbor_idx long" + ", coded double" * (not every) + ", similarity double")
        if not every:
            by_code = Window.partitionBy("record_idx").orderBy(F.desc("coded"), "neighbor_idx")
            chosen = chosen.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= width)
        order = Window.partitionBy("record_idx").orderBy(F.desc("similarity"), "neighbor_idx")
        return chosen.select("record_idx", "neighbor_idx", "similarity", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """``(cell, n, ids, vectors, codes)``: rows of a cell in blocks of at most ``most``; large cells are dealt over many tasks."""
    coded = "codes" in rows.columns
    narrow = rows.select("cell", "id", "v", F.col("codes") if coded else F.lit(None).cast("binary").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(cell: int) -> pa.RecordBatch:
            ids, vectors, codes = zip(*held.pop(cell), strict=True)
            vectors = [v if isinstance(v, bytes) else np.array(v, np.float64).tobytes() for v in vectors]  # lists in indexes of earlier versions
            if len(widths := set(map(len, vectors))) > 1:
                vectors = [unpacked(x, 1, max(widths) // 8).tobytes() for x in vectors]
            body = [pa.array([np.array(ids, np.int64).tobytes()]), pa.array([b"".join(vectors)], pa.binary()), pa.array([b"".join(codes) if coded else None], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([len(ids)], pa.int64()), *body], names=["cell", "n", "ids", "vectors", "codes"])

        for batch in batches:
            for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(cell, []).append(row)
                if len(held[cell]) >= most:
                    yield out(cell)
        for cell in list(held):
            yield out(cell)

    # Rows of one cell stay together as far as they came together: blocks are small where a task has few rows of a cell, never wrong.
    return narrow.sortWithinPartitions("cell").mapInArrow(run, "cell int, n long, ids binary, vectors binary, codes binary")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``save`` has written."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    words = spark.read.parquet(f"{path}/quantisers").orderBy("part", "place").collect()
    own = {p: np.array([w.word for w in words if w.part == p]) for p in range(-1, config["m"])}
    rows = spark.read.parquet(f"{path}/rows")
    return Index(rows, own[-1], [own[p] for p in range(config["m"])], rows.count(), config["id_col"])


def build(base: DataFrame, nlist: int, m: int = 8, train: int = 200_000, seed: int = 42, id_col: str = "record_idx", vector_col: str = "feature") -> Index:
    """An index of all rows: their cells, and residual codes by books of at most 256 words for each subspace.

    Centres are fitted on ``train`` rows, books on ``BOOK_ROWS`` of them; every row is indexed. Null vectors are left out.
    """
    rows = base.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    sample = sample_rows(rows, train, seed, id_col).withColumn("features", array_to_vector("v"))
    centers = np.array(KMeans(k=nlist, seed=seed, maxIter=10).fit(sample).clusterCenters())
    few = min(train, BOOK_ROWS, max(256, BOOK_VALUES // centers.shape[1]))
    fitted = sample_rows(rows, few, seed, id_col).select("v").toArrow().column("v").combine_chunks().flatten().to_numpy().reshape(-1, centers.shape[1])
    books = code_books(fitted - centers[nearest_rows(fitted, centers)], largest_divisor(centers.shape[1], m), seed)
    shared = base.sparkSession.sparkContext.broadcast((centers, books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, books = shared.value
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, centers.shape[1])
            cell = nearest_rows(v, centers)
            parts = np.split(v - centers[cell], len(books), axis=1)
            codes = np.stack([nearest_rows(p, b) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(packed_vectors(v), pa.binary())], names=[id_col, "cell", "codes", "v"])

    index = rows.mapInArrow(encode, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, cell int, codes binary, v binary")
    return Index(index, centers, books, rows.count(), id_col)


def two_phase(queries: DataFrame, base: DataFrame, k: int, rerank_k: int, kind: str = "flat", **options) -> DataFrame:
    """Search as an index of ``kind`` answers it: a flat one by exact inner products, ``ivfpq`` with exact reranking if it asks for more than ``k``."""
    if kind == "flat":
        return knn_join(queries, base, k)
    n = base.count()
    index = build(base, **{a: b for a, b in options.items() if a != "nprobe"})
    return index.search(queries, k, options.get("nprobe", 32), search_width(n, k, rerank_k) if rerank_k > k else k)


def unit_rows(base: DataFrame, vector_col: str = "feature") -> DataFrame:
    return base.withColumn(vector_col, unit(F.col(vector_col)))
