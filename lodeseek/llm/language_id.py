"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes, up to ORDER bytes deep, with escape probabilities of
method C and frozen counts. A text's code length under a language is the exact sum of its bytes'
code lengths: at the longest known context a byte costs -log2(count / (total + distinct)) if seen
there, else an escape, -log2(distinct / (total + distinct)), and its cost at the next shorter
context. The shortest code wins. Each tree is compiled to an automaton (state = longest known
context), so that whole texts are scored by table look-ups over many segments at once.

Before coding, letters are lower-cased and everything between words becomes one space, so that
capitals and symbols don't hide the language.

Defined results: null text, or text without a letter: `und`, score 0. Texts of any length are coded
whole. Ties go to the language whose name is smaller. Repeated rows give repeated results and an
empty table an empty one; without labelled rows every text is `und`. A null id takes no part in
learning, and its row is predicted like any other. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import fold_of, mapped, share_below, table

UNKNOWN = "und"
ORDER = 4
#: Labelled rows for each language (in expectation) that the trees are learned from, whole texts.
ROWS_PER_LANGUAGE = 600
#: A context is known to a language if it was met this often.
MIN_CONTEXT = 6
#: Bytes that count as evidence in the score: more bytes of the same rates don't make it surer.
EVIDENCE = 64
SEGMENT = 512
#: Fills segments up; a byte that UTF-8 never has.
PADDING = 0xFF
DOCS_AT_A_TIME = 256
FOLDS, HELD_OUT = 4, 2
#: A filter keeps a text if its language is known and its score is at least this.
MIN_SCORE = 0.5

_BETWEEN = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def coded_bytes(text: str | None) -> bytes | None:
    """The bytes that are coded; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    return _BETWEEN.sub(" ", text.lower()).encode("utf-8", "replace")


def gram_codes(data: bytes) -> np.ndarray:
    """A number for each context and byte in data, orders 0 to ORDER: length << 40 | bytes. ORDER spaces stand before data."""
    padded = np.frombuffer(b" " * ORDER + data, np.uint8).astype(np.uint64)
    n = len(data)
    code = padded[ORDER : ORDER + n].copy()
    out = [code | np.uint64(1 << 40)]
    for k in range(1, ORDER + 1):
        code = code | (padded[ORDER - k : ORDER - k + n] << np.uint64(8 * k))
        out.append(code | np.uint64((k + 1) << 40))
    return np.concatenate(out)


def count_grams(rows: DataFrame, language: str, text: str) -> pa.Table:
    """language, gram, n over all rows: summed in each task, then by Spark. All come to the driver: they are bounded by the learned rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data := coded_bytes(body):
                    codes, n = np.unique(gram_codes(data), return_counts=True)
                    held.setdefault(lang, []).append(np.stack([codes.astype(np.int64), n]))
            for lang, parts in held.items():
                if len(parts) > 32:
                    held[lang] = [_summed(parts)]
        for lang, parts in held.items():
            both = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * both.shape[1], pa.string()), pa.array(both[0]), pa.array(both[1])], names=["language", "gram", "n"])

    counted = mapped(rows.select(F.col(language).alias("language"), F.col(text).alias("text")), run, "language string, gram long, n long")
    return counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(parts, axis=1)
    codes, where = np.unique(both[0], return_inverse=True)
    return np.stack([codes, np.bincount(where, both[1]).astype(np.int64)])


@dataclass
class Tree:
    """One language's context tree as an automaton (state = longest known context).

    symbol[byte] is a byte's column: bytes that the language hasn't share one, and PADDING has the
    last, which costs nothing. At cell state + column, cost has bits and follow the next state, which
    is the first cell of its row.
    """

    symbol: np.ndarray
    follow: np.ndarray
    cost: np.ndarray
    start: int

    def bits(self, columns: np.ndarray) -> np.ndarray:
        """The code length of each segment; columns[j] has the j-th byte of all, ORDER bytes before them first."""
        state = np.full(columns.shape[1], self.start, np.int32)
        total = np.zeros(columns.shape[1], np.float32)
        for j, column in enumerate(columns):
            at = state + self.symbol[column]
            if j >= ORDER:
                total += self.cost[at]
            state = self.follow[at]
        return total


@dataclass
class Model:
    """A tree for each language, by name. Its size is the sum of the trees', so a language more adds its own contexts and bytes only."""

    languages: list[str]
    trees: list[Tree]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, texts x languages."""
        sizes = np.array([len(t) for t in texts])
        per = -(-np.maximum(sizes, 1) // SEGMENT)
        first = np.concatenate([[0], np.cumsum(per)])
        # Row i: ORDER bytes before the segment (they lead to its state and cost nothing), then the segment.
        cells = np.full((first[-1], ORDER + SEGMENT), PADDING, np.uint8)
        for k, t in enumerate(texts):
            data = np.frombuffer(t, np.uint8)
            body = cells[first[k] : first[k + 1], ORDER:]
            whole = len(t) // SEGMENT
            body[:whole] = data[: whole * SEGMENT].reshape(whole, SEGMENT)
            if rest := len(t) - whole * SEGMENT:
                body[whole, :rest] = data[whole * SEGMENT :]
            cells[first[k], :ORDER] = ord(" ")
            cells[first[k] + 1 : first[k + 1], :ORDER] = body[:-1, -ORDER:]
        columns, text = np.ascontiguousarray(cells.T), np.repeat(np.arange(len(texts)), per)
        return np.stack([np.bincount(text, tree.bits(columns), len(texts)) for tree in self.trees], axis=1)


def shorter(context: int) -> int:
    """The context (length << 40 | bytes) without its first byte."""
    k = (context >> 40) - 1
    return (k << 40) | (context & ((1 << (8 * k)) - 1))


def compile_tree(length: np.ndarray, body: np.ndarray, n: np.ndarray) -> Tree:
    """The automaton of one language's counted grams (bytes in each, the bytes, how often)."""
    seen = np.unique(body[length == 1])
    width = len(seen) + 2
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    symbol[PADDING] = width - 1
    context = (body >> 8) | ((length - 1) << 40)
    order = np.argsort(context, kind="stable")
    context, count, column = context[order], n[order], symbol[(body & 255)[order]]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(context)) + 1])
    ends = np.concatenate([starts[1:], [len(context)]])
    # Ascending, so shorter contexts come first. A context's suffixes are met at least as often, so they are known too.
    known = [(int(context[a]), a, b) for a, b in zip(starts, ends, strict=True) if context[a] >> 40 == 0 or count[a:b].sum() >= MIN_CONTEXT]
    place = {c: i for i, (c, _, _) in enumerate(known)}
    follow, cost = np.zeros((len(known), width), np.int32), np.full((len(known), width), 8.0, np.float32)
    for i, (c, a, b) in enumerate(known):
        if i:
            cost[i] = cost[place[shorter(c)]]
        total, distinct = count[a:b].sum(), b - a
        cost[i] -= np.log2(distinct / (total + distinct))
        cost[i, column[a:b]] = -np.log2(count[a:b] / (total + distinct))
        cost[i, -1] = 0.0
    # One byte on: the context with that byte appended, if it is known; else as from the shorter context.
    longer: dict[int, list[tuple[int, int]]] = {}
    for c, at in place.items():
        if k := c >> 40:
            longer.setdefault(((k - 1) << 40) | ((c & ((1 << 40) - 1)) >> 8), []).append((int(symbol[c & 255]), at * width))
    for c, i in place.items():
        if c >> 40:
            follow[i] = follow[place[shorter(c)]]
        for s, cell in longer.get(c, []):
            follow[i, s] = cell
    return Tree(symbol, follow.reshape(-1), cost.reshape(-1), place[0] * width)


def compile_trees(grams: pa.Table) -> Model | None:
    """Each language's tree from the counted grams; None if there are none."""
    language, code, n = (grams.column(c).to_numpy(zero_copy_only=False) for c in ("language", "gram", "n"))
    if not len(code):
        return None
    length, body = code >> 40, code & ((1 << 40) - 1)
    names = sorted(set(language))
    return Model(names, [compile_tree(length[mine], body[mine], n[mine]) for mine in (language == name for name in names)])


def learn(rows: DataFrame, key: str, text: str, language: str, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """From rows with text and language: about rows_per_language of each, chosen by a hash of the key."""
    usable = rows.where(F.col(text).isNotNull() & F.col(language).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(language).alias("language"))
    sizes = {r[0]: r[1] for r in usable.groupBy("language").count().collect()}  # a row for each language
    chosen: Column = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("language") == name) & share_below(F.col("key"), rows_per_language / n, 3))
    return compile_trees(count_grams(usable.where(chosen), "language", "text"))


def predict(df: DataFrame, key: str, text: str, model: Model | None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, carried columns, lang_pred, score (0 to 1), bits_per_byte (null for `und`). A narrow pass without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a tree for each language, bounded by its learned rows
    kept = (key, *carried)
    at = kept.index(text) if text in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_A_TIME):
                part = batch.slice(start, DOCS_AT_A_TIME)
                coded = [coded_bytes(t) if model else None for t in part.column(at).to_pylist()]
                lang, score, rate = [UNKNOWN] * len(coded), [0.0] * len(coded), [None] * len(coded)
                there = [i for i, c in enumerate(coded) if c is not None]
                if there:
                    bits = model.bits([coded[i] for i in there])
                    sizes = np.array([len(coded[i]) for i in there], float)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(there)), best]
                    surplus = (bits - least[:, None]) * np.minimum(1, EVIDENCE / sizes)[:, None]
                    sure = 1 / np.exp2(-surplus).sum(axis=1)
                    for k, i in enumerate(there):
                        lang[i], score[i], rate[i] = model.languages[best[k]], float(sure[k]), float(least[k] / sizes[k])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*part.schema.names[: len(kept)], "lang_pred", "score", "bits_per_byte"]
                )

    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    chosen = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), *([] if text in kept else [F.col(text).cast("string").alias("text")]))
    return mapped(chosen, run, f"{kinds}, lang_pred string, score double, bits_per_byte double").toDF(*kept, "lang_pred", "score", "bits_per_byte")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document; learned from rows that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    model = learn(documents.where(~held_out), "doc_id", "text", "lang")
    return predict(documents, "doc_id", "text", model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")
