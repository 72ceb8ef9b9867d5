"""The best by BM25 without scoring all that share a word with the query.

Postings are filed by term and by layer: how much a posting can give (its saturation) in LAYERS equal
steps. A block is a term's postings of one layer; what it can give at most is known from its number
alone. A search counts the blocks of its terms, scores the strongest ones, and takes the k-th best partial
sum as the bar. A block whose most, with the most of all other terms, stays under the bar is never read
again: no row of it can be among the best. Terms that together stay under the bar (frequent words)
name no candidates; their postings are read for the candidates of the others only.

Scores and ranks equal full scoring (search.stored_scores); ties go to the smaller id. Where the bar is
low, or fewer than k rows are found, more is read, up to all. The driver holds a count for each
block of the query's terms: their number times LAYERS.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.fixed_values import BM25_AVERAGE_LENGTH, BM25_B, BM25_K1
from lodeseek.functions.scoring import saturation

LAYERS = 32
#: The bar is set by blocks that hold so many times the rows asked for.
OPENING = 16


def layer_of(tf: Column, length: Column, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE_LENGTH) -> Column:
    """A posting's layer: saturation lies from 0 to k1 + 1."""
    return F.least(F.lit(LAYERS - 1), F.floor(saturation(tf, length, k1, b, average) * F.lit(LAYERS / (k1 + 1.0))).cast("int"))


def layered(postings: DataFrame, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE_LENGTH) -> DataFrame:
    return postings.withColumn("layer", layer_of(F.col("tf"), F.col("doc_len"), k1, b, average))


@dataclass(frozen=True)
class Reading:
    """What a search reads: the blocks (term, layer) that name candidates, those looked up for them, and what the latter can add to a row; rows that name candidates, rows read, and rows in all."""

    weights: dict[str, float]
    naming: list[tuple[str, int]]
    asked: list[tuple[str, int]]
    rest: float
    bar: float
    rows_naming: int
    rows_read: int
    rows_all: int


def _among(blocks: list[tuple[str, int]]) -> Column:
    by_term: dict[str, list[int]] = {}
    for term, layer in blocks:
        by_term.setdefault(term, []).append(layer)
    return reduce(lambda x, y: x | y, ((F.col("term") == t) & F.col("layer").isin(*sorted(ls)) for t, ls in by_term.items()), F.lit(False))


def _given(rows: DataFrame, weights: dict[str, float], k1: float, b: float, average: float) -> DataFrame:
    """id and what each posting gives."""
    weight = reduce(lambda x, y: x.when(F.col("term") == y[0], F.lit(y[1])), weights.items(), F.when(F.lit(False), F.lit(0.0)))
    return rows.select(F.col("chunk_id").alias("id"), (weight * saturation(F.col("tf"), F.col("doc_len"), k1, b, average)).alias("gives"))


def reading(postings: DataFrame, asked: list[str], texts: int, k: int, digits: int, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE_LENGTH) -> Reading:
    """Decide what to read of layered postings for the k best of texts texts."""
    counts = {(r.term, r.layer): r.n for r in postings.where(F.col("term").isin(*asked)).groupBy("term", "layer").agg(F.count("*").alias("n")).collect()}  # a row for each block
    held: dict[str, int] = {}
    for (term, _), n in counts.items():
        held[term] = held.get(term, 0) + n
    weights = {t: math.log((texts - n + 0.5) / (n + 0.5) + 1.0) for t, n in held.items()}
    most = {(t, layer): weights[t] * (layer + 1) * (k1 + 1.0) / LAYERS for t, layer in counts}
    top = {t: max(x for (u, _), x in most.items() if u == t) for t in held}
    opening, n = [], 0
    for block in sorted(most, key=lambda x: (-most[x], x)):
        if n >= OPENING * k:
            break
        opening.append(block)
        n += counts[block]
    bar = -math.inf
    if len(opening) < len(counts):
        sums = _given(postings.where(_among(opening)), weights, k1, b, average).groupBy("id").agg(F.sum("gives").alias("s")).orderBy(F.desc("s")).limit(k)
        found = [r.s for r in sums.collect()]  # k rows
        if len(found) == k:
            bar = min(found) - 2 * 10.0**-digits  # scores are rounded before they rank
    together = sum(top.values())
    live = [x for x in most if most[x] + together - top[x[0]] >= bar]
    silent, rest = set(), 0.0
    for term in sorted(top, key=lambda t: (top[t], t)):
        if rest + top[term] >= bar:
            break
        silent.add(term)
        rest += top[term]
    naming, later = [x for x in live if x[0] not in silent], [x for x in live if x[0] in silent]
    return Reading(weights, naming, later, rest, bar, sum(counts[x] for x in naming), sum(counts[x] for x in live), sum(counts.values()))


def best(postings: DataFrame, asked: list[str], texts: int, k: int, digits: int = 6, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE_LENGTH) -> DataFrame:
    """id and score of rows among which are the k best, with their whole scores; any row beyond those has at most its own score. postings: chunk_id, term, tf, doc_len, layer."""
    none = postings.where("false").select(F.col("chunk_id").alias("id"), F.lit(0.0).alias("score"))
    if not asked:
        return none
    plan = reading(postings, asked, texts, k, digits, k1, b, average)
    if not plan.naming:
        return none
    named = _given(postings.where(_among(plan.naming)), plan.weights, k1, b, average)
    if plan.asked:
        named = named.groupBy("id").agg(F.sum("gives").alias("gives")).where(F.col("gives") + plan.rest >= plan.bar)
        others = _given(postings.where(_among(plan.asked)), plan.weights, k1, b, average)
        named = named.unionByName(others.join(named.select("id"), "id", "left_semi"))
    return named.groupBy("id").agg(F.round(F.sum("gives"), digits).alias("score"))
