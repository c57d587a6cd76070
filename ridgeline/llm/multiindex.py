"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each half quantised by its own codebook, so a vector's cell is a pair of
centroids. A query walks the pairs by summed distance with a heap (the multi-sequence walk) until the
cells it has named hold its share of all rows; those rows are reranked by exact distance.

Scale. Codebooks, the share and one upper bound per query come from a bounded sample (``sample_rows``);
every row is indexed. The number of centroids a half grows with the root of the rows, up to 256. Cells are
dealt to parts of bounded size, neighbouring cells together, a hot cell (a third of all vectors alike) to
several parts; a query is sent once to each part that holds cells it visits, and parts with many queries are
cut again. A part returns at most k rows a query, and none beyond the query's bound (its k-th nearest among
the sample's rows in the cells it visits), so little is shuffled.

What cells can prune depends on the vectors: the share of rows a query visits is calibrated on the sample, so
that spread-out vectors make it large (most rows) and clustered ones small.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a whole, finite, non-zero vector of the commonest length."""
    rows = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", sound) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(common.select("n")), F.size("v") == F.col("n"), "left_semi")


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * k + j) by first[i] + second[j], nearest first, until they hold ``wanted`` rows."""
    rows, cols = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[rows[0]] + second[cols[0]], 0, 0)], {(0, 0)}
    out, held, k = [], 0, len(second)
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(rows[i] * k + cols[j])
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(rows) and b < len(cols) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[rows[a]] + second[cols[b]], a, b))
    return out


class Codebooks:
    """Two quantisers, the share of rows that a query visits, and the sample that bounds its radius."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, centroids: int, k: int, recall: float, probes: int = 200):
        self.rows, self.sample, self.k = rows, x, k
        self.cut = x.shape[1] // 2
        self.a, self.b = kmeans(x[:, : self.cut], centroids), kmeans(x[:, self.cut :], centroids)
        self.sample_cells = self.cells(x)
        self.share = self._share(recall, probes)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = squared(x[:, : self.cut], self.a), squared(x[:, self.cut :], self.b)
        return a.argmin(1) * len(self.b) + b.argmin(1)

    def _share(self, recall: float, probes: int) -> float:
        """The least share of sample rows, in order of cell distance, that holds ``recall`` of the true k."""
        x, n = self.sample, len(self.sample)
        if n <= self.k + 1:
            return 1.0
        at = np.linspace(0, n - 1, min(probes, n)).astype(int)
        cell = self.sample_cells
        ranks = []
        for i in at:
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            true = np.argpartition(d, self.k)[: self.k]
            order = (squared(x[i : i + 1, : self.cut], self.a)[0][:, None] + squared(x[i : i + 1, self.cut :], self.b)[0][None]).ravel()
            nearer = np.sort(order[cell])
            ranks.append(np.searchsorted(nearer, order[cell[true]], side="right") / n)
        return float(np.quantile(np.concatenate(ranks), recall))

    def bound(self, rows: np.ndarray, x: np.ndarray, cells: list[list[int]]) -> np.ndarray:
        """For each query a distance (squared) within which its cells surely hold k rows, by the sample's rows there."""
        out = np.full(len(x), np.inf)
        visited = np.zeros(len(self.a) * len(self.b), dtype=bool)
        for i in range(len(x)):
            visited[:] = False
            visited[cells[i]] = True
            at = visited[self.sample_cells] & (self.rows != rows[i])
            if at.sum() >= self.k:
                d = squared(x[i : i + 1], self.sample[at])[0]
                out[i] = np.partition(d, self.k - 1)[self.k - 1] * (1 + 1e-9) + 1e-9
        return out


def nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query its k nearest rows of one part, in the cells it visits, within its bound; ties to the smaller vec_id."""
    rows = rows.sort_values(["vec_id", "row"])
    ids, own, x = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), np.stack(rows["v"].to_numpy())
    cells, of = np.unique(rows["cell"].to_numpy(), return_inverse=True)
    out = []
    qs = np.stack(queries["v"].to_numpy())
    for at in range(0, len(qs), 128):
        near = squared(qs[at : at + 128], x)
        for i, d in enumerate(near):
            q, bound, visited = queries["row"].iat[at + i], queries["bound"].iat[at + i], np.isin(cells, queries["cells"].iat[at + i])
            if not visited.all():
                d[~visited[of]] = np.inf
            if len(d) > k:
                bound = min(bound, np.partition(d, k)[k] * (1 + 1e-9) + 1e-9)  # k + 1: one may be the query
            found = np.flatnonzero((d <= bound) & (d < np.inf))
            found = found[own[found] != q]
            exact = np.sqrt(((x[found] - qs[at + i]) ** 2).sum(1))
            best = np.lexsort((own[found], ids[found], exact))[:k]
            out += [(int(q), int(queries["query_id"].iat[at + i]), int(ids[found[j]]), float(exact[j])) for j in best]
    return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])


def parts_of(counts: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first part and the number of its parts: runs of cells of at most part_rows rows, larger cells alone."""
    first, number = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    part, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > part_rows:
            part, held = part + 1, 0
        first[cell] = part
        held += n
        if n > part_rows:
            number[cell] = -(-n // part_rows)
            part, held = part + int(number[cell]), 0
    return first, number


def search(embeddings: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, recall: float = 0.96, sample_rows: int = 20_000, part_rows: int = 20_000, part_queries: int = 5_000) -> DataFrame:
    """embeddings(vec_id, embedding) -> (query_id, rank, vec_id, score): each query's k nearest found.

    ``queries`` selects the rows that ask; a row is no neighbour of itself. Vectors that are null, zero, of
    another length, or hold null or non-finite components take no part. Fewer than k candidates: all of them.
    Rows that repeat a vec_id are rows of their own: each asks, and each is a neighbour, under that id. An
    empty table gives no rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialise(usable(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so row stays the same
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample_rows).toPandas()
    centroids = int(min(256, max(2, round((total / 200) ** 0.5))))
    books = Codebooks(sample["row"].to_numpy(), np.stack(sample["v"].to_numpy()), centroids, k, recall)
    shared = spark.sparkContext.broadcast(books)  # at most sample_rows vectors

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(np.stack(v.to_numpy())).astype(np.int32) if len(v) else [], dtype="int32")

    indexed = materialise(rows.withColumn("cell", cell_of("v")), "cells")
    counts = np.zeros(len(books.a) * len(books.b), dtype=np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most 256 x 256 cells
        counts[r["cell"]] = r["count"]
    wanted = min(total, int(np.ceil(books.share * total)) + k + 1)
    first, number = parts_of(counts, part_rows)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                asking = batch.iloc[at : at + 500]
                x = np.stack(asking["v"].to_numpy())
                a, b = squared(x[:, : book.cut], book.a), squared(x[:, book.cut :], book.b)
                cells = [walk(a[i], b[i], counts, wanted) for i in range(len(x))]
                bound = book.bound(asking["row"].to_numpy(), x, cells)
                out = []
                for i, named in enumerate(cells):
                    by: dict[int, list[int]] = {}
                    for cell in named:
                        for part in range(first[cell], first[cell] + number[cell]):
                            by.setdefault(int(part), []).append(cell)
                    out += [(i, part, held) for part, held in by.items()]
                at_row = np.array([i for i, _, _ in out], dtype=int)
                yield pd.DataFrame({
                    "part": [part for _, part, _ in out], "row": asking["row"].to_numpy()[at_row], "query_id": asking["vec_id"].to_numpy()[at_row],
                    "v": asking["v"].to_numpy()[at_row], "bound": bound[at_row], "cells": [held for _, _, held in out],
                })

    asking = rows.where(queries).mapInPandas(visits, "part long, row long, query_id long, v array<double>, bound double, cells array<int>")
    asked = materialise(asking, "asked")
    asked_counts = asked.groupBy("part").count().collect()  # parts: total / part_rows, and one a cell at most
    sizes = spark.createDataFrame([(r["part"], -(-r["count"] // part_queries)) for r in asked_counts], "part long, query_parts int")
    layout = spark.createDataFrame([(int(c), int(first[c]), int(number[c])) for c in np.flatnonzero(counts)], "cell int, first long, number long")
    left = asked.join(F.broadcast(sizes), "part").withColumn("qp", F.pmod(F.xxhash64("row"), "query_parts").cast("int"))
    right = indexed.join(F.broadcast(layout), "cell").withColumn("part", F.col("first") + F.pmod(F.xxhash64("row"), "number"))
    right = right.join(F.broadcast(sizes), "part").withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    keys = ["part", "qp"]
    met = left.select(*keys, "row", "query_id", "v", "bound", "cells").groupBy(*keys).cogroup(right.select(*keys, "row", "vec_id", "v", "cell").groupBy(*keys))

    def rerank(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(q) and len(r):
            return nearest(q, r, k)
        return pd.DataFrame({c: np.zeros(0, dtype=t) for c, t in (("row", "int64"), ("query_id", "int64"), ("vec_id", "int64"), ("score", "float64"))})

    found = met.applyInPandas(rerank, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
