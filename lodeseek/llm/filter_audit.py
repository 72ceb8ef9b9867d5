"""How filters interact: what each removes in every order of them, and its Shapley share.

A document's outcome under five filters is a mask of the filters that it fails, so all that the orders
can tell is in the counts by mask: 32 cells a part, which Spark aggregates. The orders are then walked
by single swaps of neighbours (each next order differs from the last in two steps, whose figures are
taken anew from the cells; the other three stay), and a filter's removals are summed on the way: its
Shapley value, times the number of orders.

Copies are told by the text's SHA-256: rows are counted by text, id, part and labels before they meet
by text, so a text in a third of all rows is a row for each part and label when it does.

Defined results: a null text is an empty one; null and empty sources are one part. A null id has no
smaller ids and is smaller than none, so it neither fails E nor lets others fail; rows that repeat
an id aren't smaller than each other. A label counts if any row of labels for the id has it; null
ids have none. Texts of any length are read whole. An empty table has no parts and so no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import SPACE_CLASS, mapped, table

FILTERS = "ABCDE"
#: Figures of a cell: documents, those of quality 1, toxic ones.
FIGURES = 3
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * upper.cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the filters they fail (bit i: filter i)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), own_mask(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    told = slim.join(marks, "doc_id", "left").select("doc_id", "part", "own", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    kind = ["digest", "own", "part", "good", "bad"]
    by_id = told.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    # Rows of the smallest id are no copies of a smaller one, nor are rows without an id.
    grouped = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
    )
    least = grouped.groupBy("digest").agg(F.min("least").alias("first"))
    first = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("no_id")
    halves = F.array(F.struct(F.col("own").alias("mask"), first.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - first).alias("n")))
    split = grouped.join(least, "digest").select("part", "good", "bad", F.inline(halves))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places i so that swapping items i and i + 1, one after the other, visits every order of n items once (the first is the given one)."""
    places, ways = list(range(n)), [-1] * n  # where each item stands, and where it is heading
    while True:
        for item in reversed(range(n)):
            to = places[item] + ways[item]
            other = places.index(to) if 0 <= to < n else n
            if other < item:
                break
            ways[item] = -ways[item] if item else ways[item]
        else:
            return
        yield min(places[item], to)
        places[other], places[item] = places[item], to
        # Items above the one that moved have turned already.


def step_figures(counts: np.ndarray, before: int, bit: int) -> list[np.ndarray]:
    """Of a step of filter bit after those of before: kept, removed, redundant, unique fails, good lost, toxic lost; for each part (counts: part, mask, figure)."""
    masks = np.arange(counts.shape[1])
    untouched, fails = (masks & before) == 0, (masks & bit) != 0
    removed = counts[:, untouched & fails].sum(axis=1)
    kept = counts[:, untouched & ~fails, 0].sum(axis=1)
    return [kept, removed[:, 0], counts[:, ~untouched & fails, 0].sum(axis=1), counts[:, bit, 0], removed[:, 1], removed[:, 2]]


def walk(counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The orders visited; figures (order, step, figure, part); each filter's removals over all orders (filter, part)."""
    order = list(range(len(FILTERS)))
    at = lambda i: step_figures(counts, sum(1 << f for f in order[:i]), 1 << order[i])
    steps = [at(i) for i in range(len(order))]
    names, figures, shapley = [], [], np.zeros((len(order), len(counts)), dtype=np.int64)

    def visited() -> None:
        names.append("".join(FILTERS[f] for f in order))
        figures.append(list(steps))
        for f, step in zip(order, steps, strict=True):
            shapley[f] += step[1]

    visited()
    for i in swaps(len(order)):
        order[i], order[i + 1] = order[i + 1], order[i]
        steps[i], steps[i + 1] = at(i), at(i + 1)
        visited()
    return names, np.array(figures, dtype=np.int64), shapley


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA's columns, a row for each part, order and step."""
    entry = F.struct(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"))
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(entry).alias("cells"))  # 32 entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                some = batch.slice(begin, 64)
                counts = np.zeros((some.num_rows, 1 << len(FILTERS), FIGURES), dtype=np.int64)
                for i, row in enumerate(some.column(1).to_pylist()):
                    for x in row:
                        counts[i, x["mask"]] = x["n"], x["good"], x["toxic"]
                names, figures, shapley = walk(counts)
                of_step = np.array([[shapley[FILTERS.index(f)] for f in name] for name in names])  # order, step, part
                n_orders, n_steps, n_figures, n_parts = figures.shape
                part = np.tile(np.arange(n_parts), n_orders * n_steps)
                arrays = [some.column(0).take(pa.array(part)), pa.array(np.repeat(names, n_steps * n_parts)), pa.array(np.tile(np.repeat(np.arange(1, n_steps + 1, dtype=np.int32), n_parts), n_orders))]
                arrays += [pa.array(figures[:, :, k].reshape(-1)) for k in range(n_figures)] + [pa.array(of_step.reshape(-1))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return mapped(parts, run, SCHEMA)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of documents by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f AS f1, f AS f2, f AS f3, f AS f4, f AS f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, range(1, 6) AS r(step)),
p AS (SELECT s.*, part, mask, n, good, bad, mask & CAST(before AS INTEGER) = 0 AS fresh, mask & bit <> 0 AS fails FROM s, c),
a AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fresh AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (fresh AND fails), 0) AS removed, coalesce(sum(n) FILTER (NOT fresh AND fails), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (fresh AND fails), 0) AS good_lost, coalesce(sum(bad) FILTER (fresh AND fails), 0) AS toxic_lost FROM p GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a
"""
