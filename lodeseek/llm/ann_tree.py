"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on the driver on a bounded sample; every vector is indexed, in the leaf that it
descends to. A query walks the tree best bin first, by a priority queue over the nodes' distances,
and visits leaves in that order. How many leaves are visited is calibrated: the exact neighbours of
a few queries, found against all rows, tell how far visits must widen until TARGET_RECALL of them
lie in visited leaves. Inner product is turned into distance by one more coordinate, which gives
all vectors the length of the longest. Within the visited leaves the search is exact, in double
precision, in blocks: a leaf is dealt out by counts into chunks of vectors and blocks of queries.

Vectors that are equal are indexed once, with as many of their smallest ids as a result can hold
(one more than k, for the query's own), so copies neither crowd a leaf nor the results.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows with a null id or a length other than the most common one (of equally common
lengths the smallest). Rows that repeat count once; rows with the query's own id are never its
neighbours. Ties go to the smaller id. Fewer candidates than k: all of them. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import share_below, table, written

#: Vectors (in expectation) that the tree is fitted on, and most components in that sample.
SAMPLE_ROWS = 20_000
SAMPLE_VALUES = 4_000_000
BRANCH = 12
#: A node with fewer sampled vectors is a leaf.
LEAF_SAMPLE = 64
ITERATIONS = 12
#: Queries that calibrate the visits, and the share of their exact neighbours that the visited leaves must hold.
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.97
#: Vectors of a leaf, and queries of a leaf, that one task multiplies at a time.
CHUNK_ROWS = 4_096
QUERY_ROWS = 4_096


@dataclass
class Tree:
    """Node i has children first[i] to last[i] - 1; a leaf has none. weight is a centre's squared length with the added coordinate."""

    centre: np.ndarray
    weight: np.ndarray
    longest: float
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """With the coordinate that gives each vector the longest one's length."""
        rest = np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        at, x = np.zeros(len(x), np.int32), self.lifted(x)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            a, b = self.first[node], self.last[node]
            if a == b or not len(rows):
                at[rows] = node
                continue
            near = (self.weight[a:b] - 2 * x[rows] @ self.centre[a:b].T).argmin(axis=1)
            waiting += [(a + k, rows[near == k]) for k in range(b - a)]
        return at

    def best_bins(self, query: np.ndarray, most: int) -> list[int]:
        """Up to most leaves, by best-bin-first traversal."""
        scaled = query * (self.longest / (math.sqrt(float(query @ query)) or 1))
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            a, b = self.first[node], self.last[node]
            if a == b:
                out.append(node)
                continue
            far = self.weight[a:b] - 2 * (self.centre[a:b, :-1] @ scaled)
            for k, d in enumerate(far.tolist()):
                heapq.heappush(queue, (d, a + k))
        return out


def fit(sample: np.ndarray, longest: float, seed: int = 17) -> Tree:
    """Hierarchical k-means over the sample."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), np.zeros(1), longest, [0], [0])
    lifted = tree.lifted(sample)
    centres, waiting = [lifted.mean(axis=0) if len(lifted) else tree.centre[0]], [(0, np.arange(len(lifted)))]
    for node, rows in waiting:  # grows while it is read
        if len(rows) < 2 * LEAF_SAMPLE:
            continue
        k = min(BRANCH, len(rows) // LEAF_SAMPLE)
        means, part = _k_means(lifted[rows], k, rng)
        if len(means) < 2:
            continue
        tree.first[node] = len(centres)
        for j, mean in enumerate(means):
            waiting.append((len(centres), rows[part == j]))
            centres.append(mean)
            tree.first.append(0)
            tree.last.append(0)
        tree.last[node] = len(centres)
    tree.centre = np.array(centres)
    tree.weight = np.einsum("ij,ij->i", tree.centre, tree.centre)
    return tree


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    means = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ITERATIONS):
        part = (np.einsum("ij,ij->i", means, means) - 2 * x @ means.T).argmin(axis=1)
        used, part = np.unique(part, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, part, x)
        means = sums / np.bincount(part)[:, None]
    part = (np.einsum("ij,ij->i", means, means) - 2 * x @ means.T).argmin(axis=1)
    return means, part


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, e, and 96 bits of hash (a, b) that tell vectors apart, of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e")).where(
        F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)
        & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").head()
    rows = rows.where(F.size("e") == (lengths[0] if lengths else 0))
    return rows.select("id", "e", F.xxhash64("e").alias("a"), F.hash("e").alias("b"))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """a, b, e, ids: each vector once, with its k + 1 smallest ids. Spark limits the groups before it shuffles them."""
    once = rows.dropDuplicates(["id", "a", "b"])
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("r") <= k + 1)
    return first.groupBy("a", "b").agg(F.first("e").alias("e"), F.sort_array(F.collect_list("id")).alias("ids"))


@dataclass
class Index:
    """The written vectors (a, b, e, ids, leaf), the tree, each leaf's number of vectors, and the calibrated visits."""

    vectors: DataFrame
    tree: Tree
    sizes: dict[int, int]
    visits: int
    k: int


def build(rows: DataFrame, k: int) -> Index | None:
    """Index usable() rows; None if there are none."""
    distinct = written(_distinct(rows, k), "ann-distinct")
    about = distinct.agg(F.count("*"), F.max(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("e"))).head()
    if not about[0]:
        return None
    share = min(SAMPLE_ROWS, SAMPLE_VALUES // about[2]) / about[0]
    sample = distinct.where(share_below(F.col("a"), share, 13)).select("a", "b", "e").toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    tree = fit(_matrix(sample.column("e")) if len(sample) else np.zeros((0, about[2])), math.sqrt(about[1]))
    shared = distinct.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(_matrix(batch.column("e")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    vectors = written(distinct.mapInArrow(place, "a long, b int, e array<double>, ids array<long>, leaf int"), "ann-index")
    sizes = {r[0]: r[1] for r in vectors.groupBy("leaf").count().collect()}  # a row for each leaf
    return Index(vectors, tree, sizes, _calibrated(vectors, tree, share_below(F.col("a"), CALIBRATION_QUERIES / about[0], 29), k), k)


#: Scores of one pair by two ways of summing differ by less than this, relative to the score's scale.
SLACK = 1e-10
PAIRS_AT_A_TIME = 100_000


def _top(queries: np.ndarray, vectors: np.ndarray, k: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, vector places and scores of each query's k best, in blocks; scores are summed alike wherever a pair stands.

    Ties go to the smaller of ids (by default, the place): all that may tie with the k-th are scored before the cut.
    """
    ids = np.arange(len(vectors)) if ids is None else ids
    lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries)) * math.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0))
    who, what, score = [], [], []
    step = max(1, 4_000_000 // max(1, len(vectors)))
    for start in range(0, len(queries), step):
        block = queries[start : start + step] @ vectors.T
        n = min(k, block.shape[1])
        border = np.partition(block, block.shape[1] - n, axis=1)[:, block.shape[1] - n] - SLACK * lengths[start : start + step]
        q, v = np.nonzero(block >= border[:, None])
        q += start
        exact = np.concatenate([np.einsum("ij,ij->i", queries[q[a : a + PAIRS_AT_A_TIME]], vectors[v[a : a + PAIRS_AT_A_TIME]]) for a in range(0, len(q), PAIRS_AT_A_TIME)])
        order = np.lexsort((ids[v], -exact, q))
        q, v, exact = q[order], v[order], exact[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < n
        who.append(q[first])
        what.append(v[first])
        score.append(exact[first])
    return np.concatenate(who), np.concatenate(what), np.concatenate(score)


def _calibrated(vectors: DataFrame, tree: Tree, chosen: Column, k: int) -> int:
    """Leaves to visit, so that TARGET_RECALL of some queries' exact neighbours lie in them."""
    picked = vectors.where(chosen).select("a", "b", "e").toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    if not len(picked):
        picked = vectors.select("a", "b", "e").limit(1).toArrow()
    queries = _matrix(picked.column("e"))
    shared = vectors.sparkSession.sparkContext.broadcast(queries)  # CALIBRATION_QUERIES rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, v, score = _top(shared.value, _matrix(batch.column("e")), k + 1)
                leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(leaf[v], pa.int32()), pa.array(score)], names=["q", "leaf", "score"])

    all_best = vectors.select("leaf", "e").mapInArrow(best, "q int, leaf int, score double")
    nearest = all_best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("r") <= k + 1)
    found: dict[int, list[int]] = {}
    for r in nearest.select("q", "leaf").collect():  # k + 1 rows for each of CALIBRATION_QUERIES
        found.setdefault(r[0], []).append(r[1])
    ranks = []
    for q, leaves in found.items():
        order = {leaf: i for i, leaf in enumerate(tree.best_bins(queries[q], len(tree.first)))}
        ranks += [order[leaf] for leaf in leaves]
    ranks.sort()
    return ranks[min(len(ranks) - 1, math.ceil(TARGET_RECALL * len(ranks)) - 1)] + 1


def search(index: Index, queries: DataFrame) -> DataFrame:
    """a, b and near (id, score; best first, k + 1 at most) of each distinct vector among queries (usable() rows)."""
    spark = queries.sparkSession
    k, visits = index.k, index.visits
    tree = spark.sparkContext.broadcast(index.tree)
    asked = queries.groupBy("a", "b").agg(F.first("e").alias("e"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = [tree.value.best_bins(q, visits) for q in _matrix(batch.column("e"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    visited = written(asked.mapInArrow(walk, "a long, b int, e array<double>, leaves array<int>"), "ann-queries")
    wanted = {r[0]: r[1] for r in visited.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}  # a row for each leaf
    plan = [(leaf, -(-n // CHUNK_ROWS), -(-wanted[leaf] // QUERY_ROWS)) for leaf, n in index.sizes.items() if leaf in wanted]
    dealt = F.broadcast(spark.createDataFrame(plan, "leaf int, chunks int, blocks int"))  # a row for each leaf
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("a", F.lit(7)), F.col(n)).cast("int")
    left = visited.select("a", "b", "e", F.explode("leaves").alias("leaf")).join(dealt, "leaf").select("a", "b", "e", "leaf", own("blocks").alias("block"), each("chunks").alias("chunk"))
    right = index.vectors.join(dealt, "leaf").select("e", "ids", "leaf", own("chunks").alias("chunk"), each("blocks").alias("block"))

    def multiply(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not len(asked) or not len(there):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int32()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        least = np.array([ids[0] for ids in there.column("ids").to_pylist()])
        q, v, score = _top(_matrix(asked.column("e")), _matrix(there.column("e")), k + 1, least)
        return pa.table({"a": asked.column("a").take(q), "b": asked.column("b").take(q), "score": score, "ids": there.column("ids").take(v)})

    by = ["leaf", "chunk", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(multiply, "a long, b int, score double, ids array<long>")
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), F.element_at("ids", 1))
    few = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = few.groupBy("a", "b").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("found"))
    pairs = F.sort_array(F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["s"].alias("s"), i.alias("id"))))))
    return lists.select("a", "b", F.transform(F.slice(pairs, 1, k + 1), lambda p: F.struct(p["id"].alias("id"), (-p["s"]).alias("score"))).alias("near"))


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which is_query (over id) holds, among all others."""
    rows = usable(df, key, vector)
    index = build(rows, k)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(is_query)
    near = written(search(index, queries), "ann-near")  # so that the join below can split a vector that many queries share
    asked = queries.select("id", "a", "b").dropDuplicates()
    own = asked.join(near, ["a", "b"]).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op6_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, 20)
