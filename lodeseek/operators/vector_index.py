"""Dense search without reading all vectors: an inverted file of cells with product-quantised residuals.

A vector is filed under its nearest cell and kept as one byte for each of its parts: which of the
part's code words comes nearest to what the cell's centre leaves over. A query reads the cells nearest
to it, and scores their rows from a table of its products with the code words. The best by that
are scored again on their own vectors, so scores are exact; only who comes that far is approximate.

Cells and code words are learned from SAMPLE vectors at most (chosen by a hash of the id); all rows
are filed, and the counts that steer a search are of all rows. How many cells a query must read for a
recall is measured on a sample of rows against all others (calibrated()); a query also widens until
its cells hold some times as many rows as it asks for. With as many probes as cells and a reranking of
all rows a search is exact; search.dense_scores is the exact way without an index.

Vectors count by their direction (cosine). Null, zero and non-finite ones, and those of another length
than the codebook's, aren't filed. Cells are cut into blocks of bounded size by a hash of the id, so a
cell that holds a third of all rows is many tasks. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Vectors to learn from, at most, and rounds of learning.
SAMPLE, ROUNDS = 20_000, 12
#: Rows of a block, and queries of one.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 256
#: A query's cells hold at least so many times the rows it asks for, and so many are scored again.
WIDEN, RERANK = 8, 8
#: Times the rows that are scored again, that a query's first cells hold: they tell what the other cells' rows must reach.
FIRST = 8
#: Queries whose true neighbours calibrate the probes.
CALIBRATION = 64


@dataclass(frozen=True)
class Codebook:
    """centres: a unit vector for each cell. words: part, word, components."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def encoded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors: cells and codes."""
        cells = (vectors @ self.centres.T).argmax(axis=1)
        left = (vectors - self.centres[cells]).reshape(len(vectors), len(self.words), -1)
        codes = [nearest_words(left[:, p], words) for p, words in enumerate(self.words)]
        return cells.astype(np.int32), np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Query, part, word: products."""
        return np.einsum("qpc,pwc->qpw", queries.reshape(len(queries), len(self.words), -1), self.words)

    def order(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's cells, nearest first, and their products."""
        products = queries @ self.centres.T
        return np.argsort(-products, axis=1, kind="stable"), products


def nearest_words(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (rows @ words.T - (words**2).sum(axis=1) / 2).argmax(axis=1)


def unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a usable vector, and those as unit vectors."""
    rows = [np.asarray(v if v is not None and len(v) == size and None not in v else [0.0] * size, np.float64) for v in column.to_pylist()]
    vectors = np.array(rows).reshape(len(rows), size)
    with np.errstate(invalid="ignore", over="ignore"):
        lengths = np.linalg.norm(vectors, axis=1)
    held = np.flatnonzero(np.isfinite(lengths) & (lengths > 0))
    return held, vectors[held] / lengths[held, None]


def _best(scores: np.ndarray, n: int, floor: float | None = None) -> np.ndarray:
    """Places of the n highest scores, of floor or more; those further on last among equals."""
    border = -np.partition(-scores, n - 1)[n - 1]
    border = border if floor is None else max(border, floor)
    held = np.flatnonzero(scores >= border)
    return held[np.argsort(-scores[held], kind="stable")[:n]]


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1) if spherical else nearest_words(rows, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def learned(df: DataFrame, id: str, vector: str, cells: int | None = None, parts: int | None = None, seed: int = 7) -> Codebook | None:
    """Cells (by default twice the root of the sample) and code words from at most SAMPLE rows; None without usable vectors."""
    some = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.xxhash64(F.col(id).cast("string")).alias("h")).orderBy("h", "v").limit(SAMPLE)
    held = [r.v for r in some.select("v").collect()]  # SAMPLE rows
    if not held:
        return None
    sizes = np.bincount([len(v) for v in held])
    size = int(sizes.argmax())
    rows = unit(pa.array(held), size)[1]
    if not len(rows):
        return None
    rng = np.random.default_rng(seed)
    centres = _means(rows, min(len(rows), cells or max(1, int(2 * len(rows) ** 0.5))), rng, True)
    left = rows - centres[(rows @ centres.T).argmax(axis=1)]
    n_parts = parts or next(p for p in (size // 4, size // 2, size) if p and size % p == 0)
    split = left.reshape(len(left), n_parts, -1)
    words = [_means(split[:, p], min(256, len(rows)), rng, False) for p in range(n_parts)]
    return Codebook(centres, np.stack(words))


def filed(df: DataFrame, id: str, vector: str, book: Codebook, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep's columns, cell, codes of df's usable vectors."""
    asked = df.select(F.struct(F.col(id).alias("id"), *keep).alias("row"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, vectors = unit(batch.column(1), book.size)
            cells, codes = book.encoded(vectors) if len(held) else (np.zeros(0, np.int32), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), pa.array(cells), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "cell", "codes"])

    coded = asked.mapInArrow(run, StructType([asked.schema["row"], *StructType.fromDDL("cell int, codes binary").fields]))
    return coded.select("row.*", "cell", "codes")


def cell_counts(index: DataFrame, book: Codebook) -> np.ndarray:
    counts = np.zeros(len(book.centres), np.int64)
    for r in index.groupBy("cell").count().collect():  # a row for each cell
        counts[r[0]] = r[1]
    return counts


def probed(order: np.ndarray, counts: np.ndarray, probes: int, k: int) -> np.ndarray:
    """How many of each query's cells are read: probes, and more until they hold WIDEN times k rows."""
    enough = (np.cumsum(counts[order], axis=1) < WIDEN * k).sum(axis=1) + 1
    return np.minimum(np.maximum(enough, probes), order.shape[1])


def approximate(index: DataFrame, queries: DataFrame, id: str, vector: str, book: Codebook, counts: np.ndarray, probes: int, k: int, most: int) -> DataFrame:
    """query_id, id, near: the most best rows of each query's cells by their codes.

    The nearest cells that hold FIRST times as many rows are scored first; the others then give only
    what isn't worse than the last of the best of those, so what a query's cells give grows little with their number.
    """
    asked = queries.select(F.col(id).alias("query_id"), F.col(vector).alias("v"))
    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    names = ["query_id", "cell", "centre", "q", "first"]

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, vectors = unit(batch.column(1), book.size)
            if not len(held):
                continue
            order, products = book.order(vectors)
            n = probed(order, counts, probes, k)
            n_first = np.minimum((np.cumsum(counts[order], axis=1) < FIRST * most).sum(axis=1) + 1, n)
            rows, cells = np.repeat(np.arange(len(held)), n), np.concatenate([o[:x] for o, x in zip(order, n, strict=True)])
            first = np.concatenate([np.arange(x) < y for x, y in zip(n, n_first, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held[rows])), pa.array(cells.astype(np.int32)), pa.array(products[rows, cells]), pa.array(list(vectors[rows]), pa.list_(pa.float64())), pa.array(first)], names=names)

    wants = asked.mapInArrow(cells_of, f"query_id {kind}, cell int, centre double, q array<double>, first boolean")
    block = lambda n, of: F.pmod(F.xxhash64(F.col(of).cast("string")), n).cast("int").alias("block")
    n_query_blocks = F.lit(max(1, -(-queries.count() // BLOCK_QUERIES)))
    n_blocks = F.element_at(F.array(*(F.lit(int(-(-c // BLOCK_ROWS)) or 1) for c in counts)), F.col("cell") + 1)
    held = index.select("cell", block(n_blocks, "id"), F.struct("id", "codes").alias("x")).groupBy("cell", "block").agg(F.collect_list("x").alias("rows"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, asks in zip(batch.column(0), batch.column(1), strict=True):
                rows, asks = some.values, asks.values
                rows = rows.take(pc.sort_indices(rows.field("id")))  # equal scores go to the smaller id
                codes = np.frombuffer(b"".join(rows.field("codes").to_pylist()), np.uint8).reshape(len(rows), -1)
                tables = book.tables(np.array(asks.field("q").to_pylist()))
                near = np.array(asks.field("centre"))[:, None] + sum(tables[:, p, codes[:, p]] for p in range(codes.shape[1]))
                best = [_best(row, min(most, len(rows)), floor) for row, floor in zip(near, asks.field("floor").to_pylist(), strict=True)]
                of = np.repeat(np.arange(len(best)), [len(x) for x in best])
                flat = np.concatenate(best)
                yield pa.RecordBatch.from_arrays([asks.field("query_id").take(pa.array(of)), rows.field("id").take(pa.array(flat)), pa.array(near[of, flat])], names=["query_id", "id", "near"])

    def scored(some: DataFrame) -> DataFrame:
        asking = some.select("cell", block(n_query_blocks, "query_id"), F.struct("query_id", "centre", "q", "floor").alias("x")).groupBy("cell", "block").agg(F.collect_list("x").alias("asking"))
        return held.select("cell", "rows").join(asking.select("cell", "asking"), "cell").select("rows", "asking").mapInArrow(score, f"query_id {kind}, id {id_kind}, near double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    first = best(scored(wants.where("first").withColumn("floor", F.lit(None).cast("double"))))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= most, F.min("near")).alias("floor"))
    return best(first.unionByName(scored(wants.where("NOT first").join(floors, "query_id", "left"))))


def exact_scores(pairs: DataFrame, queries: DataFrame, points: DataFrame, query_id: str, id: str, vector: str, of_query: str | None = None) -> DataFrame:
    """query_id, id, score: the cosine of pairs on their own vectors."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(of_query or vector).alias("_q"))
    both = pairs.select("query_id", "id").join(points.select(F.col(id).alias("id"), F.col(vector).alias("_v")), "id").join(asked, "query_id")

    @F.pandas_udf("double")
    def cosine(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        x, y = (np.stack(s.to_numpy()).astype(np.float64) for s in (a, b))
        return pd.Series((x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)))

    return both.select("query_id", "id", cosine("_q", "_v").alias("score"))


def search(index: DataFrame, points: DataFrame, queries: DataFrame, id: str, vector: str, book: Codebook, counts: np.ndarray, probes: int, k: int, with_self: bool = True) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest points found for each query; with_self false leaves out the point of the query's id."""
    near = approximate(index, queries, id, vector, book, counts, probes, k, RERANK * k + 1)
    if not with_self:
        near = near.where("id <> query_id")
    scored = exact_scores(near, queries, points, id, id, vector)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def calibrated(points: DataFrame, id: str, vector: str, book: Codebook, k: int, recall: float) -> int:
    """The fewest cells that hold, on the mean over CALIBRATION rows, recall of their k nearest among all others."""
    some = points.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("v")).orderBy(F.xxhash64(F.col(id).cast("string"), F.lit(1)), "id").limit(CALIBRATION).collect()
    if not some:
        return 1
    held, vectors = unit(pa.array([r.v for r in some]), book.size)
    own = [some[i].id for i in held]
    order, _ = book.order(vectors)
    ranks = np.argsort(order, axis=1)  # query, cell: how many cells come before

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in own]
        for batch in batches:
            ids, (rows, there) = batch.column(0).to_pylist(), unit(batch.column(1), book.size)
            if not len(rows):
                continue
            products, cells = vectors @ there.T, (there @ book.centres.T).argmax(axis=1)
            for q, mine in enumerate(own):
                at = np.argsort(-products[q])[: k + 1]
                best[q] = sorted([*best[q], *((float(products[q, i]), int(ranks[q, cells[i]])) for i in at if ids[rows[i]] != mine)], reverse=True)[:k]
        flat = [(q, s, r) for q, some in enumerate(best) for s, r in some]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int32()))], names=["q", "score", "cells"])

    told = points.select(F.col(id).alias("id"), F.col(vector).alias("v")).mapInArrow(nearest, "q int, score double, cells int")
    top = told.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cells"))).where(F.col("rank") <= k)
    by_rank = np.zeros(len(book.centres), np.int64)
    for r in top.groupBy("cells").count().collect():  # a row for each cell at most
        by_rank[r[0]] += r[1]
    if not by_rank.sum():
        return 1
    return int(np.searchsorted(np.cumsum(by_rank), recall * by_rank.sum()) + 1)
