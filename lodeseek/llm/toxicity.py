"""Toxicity by class-conditional Kneser-Ney models.

Two models of word pairs, toxic and ordinary, are learned from labelled texts. As Kneser and Ney have
it, a pair counts by how many different words it follows, and a word by how many different words, so
passages that are copied over and over weigh no more than one. Each model is interpolated:

    P_c(w | v) = kept_c(v w) / n_c(v) + lambda_c(v) P_c(w)
    P_c(w)     = kept_c(w) / N_c      + lambda_c    P(w)

where P is a model of words over both classes, with absolute discount DISCOUNT and an even share for
unknown words, and each lambda is the share that discounts free. The discount of a class's count is
what the shared counts predict for it, plus DISCOUNT and Z standard deviations, where the class's
share may be off by factor TOLERANCE: rare pairs and words, and those that both classes use alike,
are left to the shared counts, so that class sizes and topics don't tell classes apart.

A text's two log-likelihoods, each divided by its words, are compared; a logistic curve fitted on the
labelled texts turns the difference, beyond that of a text of unknown words, into a score.

Defined results: null, empty or wordless texts have zero words, no difference, and the score of
that point of the curve. Whole texts are read, of any length. Repeated rows give repeated results;
an empty table an empty one; without labels of both classes every score is the share of toxic labels
(0 without any). Null labels and ids don't take part in learning. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import Scratch, fold_of, mapped, share_below, table

#: Labelled rows (in expectation) that the models are learned from, whole texts, by class (0: ordinary, 1: toxic).
ROWS = {0: 20_000, 1: 5_000}
DISCOUNT = 0.75
Z = 2.0
TOLERANCE = 2.0
DOCS_AT_A_TIME = 256
#: Words whose places a task remembers before it starts afresh.
REMEMBERED_WORDS = 100_000
FOLDS, HELD_OUT = 5, 0

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    """63 bits that stand for a word; those of "" stand for the begin of a text."""
    return xxhash.xxh3_64_intdigest(word) >> 1


def discount(shared: Column, share: Column) -> Column:
    """What is taken from a class's count where both classes have shared, and the class a share of all counts there."""
    q = share * TOLERANCE / (share * TOLERANCE + 1 - share)
    return shared * q + DISCOUNT + Z * F.sqrt(shared * q * (1 - q))


def kept(count: str, shared: Column, share: Column) -> Column:
    return F.greatest(F.col(count) - discount(shared, share), F.lit(0.0))


@dataclass
class Models:
    """Words by hash (ascending; place 0 is for unknown ones, the last for the begin of a text) with their probability in each class; pairs of places with what each class keeps of them.

    Arrays of two rows have ordinary first. free: each class's lambda by the place of v. curve: of the features() of a text.
    """

    known: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    free: np.ndarray
    base: float = 0.0
    curve: np.ndarray | None = None
    prior: float = 0.0

    @classmethod
    def none(cls, prior: float) -> Models:
        return cls(np.zeros(0, np.int64), np.ones((2, 2)), np.zeros(0, np.int64), np.zeros((2, 0)), np.ones((2, 2)), prior=prior)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def rates(self, texts: list[str | None], memory: dict[str, int]) -> np.ndarray:
        """For each text: words, toxic and ordinary log-likelihood for each word (0 without words)."""
        found = [words(t) for t in texts]
        if len(memory) > REMEMBERED_WORDS:
            memory.clear()
        if new := list({w for f in found for w in f} - memory.keys()):
            memory.update(zip(new, self.places(np.array([word_hash(w) for w in new], np.int64)).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        width = len(self.known) + 2
        for i, f in enumerate(found):
            if not f:
                continue
            w = np.fromiter(map(memory.__getitem__, f), np.int64, len(f))
            v = np.concatenate([[width - 1], w[:-1]])
            p = self.free[:, v] * self.word[:, w]
            if len(self.pairs):
                at = np.minimum(np.searchsorted(self.pairs, v * width + w), len(self.pairs) - 1)
                hit = self.pairs[at] == v * width + w
                p[:, hit] += self.pair[:, at[hit]]
            ordinary, toxic = np.log(p).mean(axis=1)
            out[i] = len(f), toxic, ordinary
        return out

    def score(self, rates: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(rates), self.prior)
        return 1 / (1 + np.exp(-np.clip(features(rates, self.base) @ self.curve, -30, 30)))


def features(rates: np.ndarray, base: float) -> np.ndarray:
    """The difference of the rates beyond base, plain, against the noise of a mean of so many words, and summed up; without a difference, length says nothing."""
    n = rates[:, 0]
    gap = np.where(n > 0, rates[:, 1] - rates[:, 2] - base, 0)
    return np.stack([np.ones(len(n)), gap, gap * np.sqrt(n), np.log1p(np.maximum(gap * n, 0))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a light ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread = 0, np.where(spread > 0, spread, 1)
    a, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (y - p)) - 0.01 * w
        bend = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(len(w))
        w += np.clip(np.linalg.solve(bend, slope), -3, 3)
    out = w / spread
    out[0] -= (w * mean / spread)[1:].sum()
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """v, w (hashes of a word and the next), ordinary, toxic: different words before the pair, in each class. rows: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_A_TIME):
                part = batch.slice(start, DOCS_AT_A_TIME)
                memory: dict[str, int] = {"": word_hash("")}
                by_class: dict[int, list[np.ndarray]] = {}
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = ["", "", *words(text)]
                    for w in set(found) - memory.keys():
                        memory[w] = word_hash(w)
                    at = np.fromiter(map(memory.__getitem__, found), np.int64, len(found))
                    by_class.setdefault(toxic, []).append(np.stack([at[:-2], at[1:-1], at[2:]], axis=1))
                for toxic, some in by_class.items():
                    once = np.unique(np.concatenate(some), axis=0)
                    yield pa.RecordBatch.from_arrays([*(pa.array(once[:, i]) for i in range(3)), pa.array(np.full(len(once), toxic, np.int32))], names=["before", "v", "w", "toxic"])

    seen = mapped(rows.select("text", F.col("toxic").cast("int").alias("toxic")), run, "before long, v long, w long, toxic int").dropDuplicates()
    return seen.groupBy("v", "w").agg(F.count_if(F.col("toxic") == 0).alias("ordinary"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def build(pairs: DataFrame) -> Models | None:
    """The models from pair counts; None if a class has none. To the driver come all learned words and those pairs of which a class keeps something: both are bounded by the learned rows."""
    shared = F.col("ordinary") + F.col("toxic")
    around = pairs.groupBy("v").agg(F.sum("ordinary").alias("all_ordinary"), F.sum("toxic").alias("all_toxic"))
    whole = F.col("all_ordinary") + F.col("all_toxic")
    told = pairs.join(around, "v").select("v", "w", *(F.when(F.col(f"all_{c}") > 0, kept(c, shared, F.col(f"all_{c}") / whole) / F.col(f"all_{c}")).otherwise(0.0).alias(c) for c in ("ordinary", "toxic")))
    told = told.where("ordinary > 0 OR toxic > 0").toArrow()
    counts = pairs.groupBy("w").agg(F.count_if(F.col("ordinary") > 0).alias("ordinary"), F.count_if(F.col("toxic") > 0).alias("toxic"), F.count("*").alias("both")).toArrow().sort_by("w")
    number = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
    known, both, n = number(counts, "w"), number(counts, "both").astype(float), np.stack([number(counts, c) for c in ("ordinary", "toxic")]).astype(float)
    totals = n.sum(axis=1)
    if not totals.all():
        return None
    width = len(known) + 2
    held = np.maximum(both - DISCOUNT, 0)
    rest = 1 - held.sum() / both.sum()
    p = np.concatenate([[0], held / both.sum(), [0]]) + rest / width
    share = (totals / both.sum())[:, None]
    q = np.minimum(share, 1) * TOLERANCE / (np.minimum(share, 1) * TOLERANCE + 1 - np.minimum(share, 1))
    stays = np.maximum(n - (both * q + DISCOUNT + Z * np.sqrt(both * q * (1 - q))), 0) / totals[:, None]
    free = 1 - stays.sum(axis=1, keepdims=True)
    word = free * p
    word[:, 1:-1] += stays
    models = Models(known, word, np.zeros(0, np.int64), np.zeros((2, 0)), np.ones((2, width)), base=float(np.log(free[1, 0]) - np.log(free[0, 0])))
    v, w = models.places(number(told, "v")), models.places(number(told, "w"))
    v[number(told, "v") == word_hash("")] = width - 1
    order = np.argsort(v * width + w)
    models.pairs, models.pair = (v * width + w)[order], np.stack([number(told, c) for c in ("ordinary", "toxic")])[:, order]
    for c in range(2):
        np.subtract.at(models.free[c], v[order], models.pair[c])
    models.free = np.maximum(models.free, 1e-9)
    return models


def rate(df: DataFrame, key: str, text: str, models: Models) -> DataFrame:
    """Per row: key, words, toxic_rate, ordinary_rate, score. A narrow pass; the models' size is bounded by the learned rows."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, memory = shared.value, {}
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_A_TIME):
                part = batch.slice(start, DOCS_AT_A_TIME)
                rates = models.rates(part.column(1).to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rates[:, 0].astype(np.int64)), pa.array(rates[:, 1]), pa.array(rates[:, 2]), pa.array(models.score(rates))], names=["key", "words", "toxic_rate", "ordinary_rate", "score"])

    kind = df.schema[key].dataType.simpleString()
    out = mapped(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind}, words long, toxic_rate double, ordinary_rate double, score double")
    return out.withColumnRenamed("key", key)


def learn(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows_of: dict[int, int] | None = None) -> Models:
    """The models and their curve, from about rows_of[class] labelled rows of each class, chosen by a hash of the key."""
    most = ROWS if rows_of is None else rows_of
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Models.none(float(next(iter(sizes), 0)))
    chosen: Column = F.lit(False)
    for toxic, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == toxic) & share_below(F.col("key"), most[toxic] / n, 5))
    scratch = Scratch(documents.sparkSession)
    # The keys are bounded by ROWS (about 12 bytes each), so documents isn't shuffled; the learned texts are read once.
    rows = scratch.written(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(known.where(chosen)), "key"), "toxicity-rows")
    models = build(scratch.written(pair_counts(rows), "toxicity-pairs"))
    prior = sizes[1] / (sizes[0] + sizes[1])
    if models is None:
        scratch.close()
        return Models.none(prior)
    scored = rate(rows.withColumn("mark", F.struct("key", "toxic")), "mark", "text", models).select("mark.toxic", "words", "toxic_rate", "ordinary_rate").toArrow()  # a row for each learned one
    y = scored.column("toxic").to_numpy(zero_copy_only=False).astype(float)
    rates = np.stack([scored.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("words", "toxic_rate", "ordinary_rate")], axis=1)
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    models.curve = fit_curve(features(rates, models.base), y, weight)
    scratch.close()
    return models


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are not read."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    models = learn(documents, table(spark, sf_dir, "labels").where(~held_out), "doc_id", "text", "toxic")
    scored = rate(documents, "doc_id", "text", models)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "words", "toxic_rate", "ordinary_rate")
