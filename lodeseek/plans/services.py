"""Embedding and explanation of texts: pluggable, with offline defaults."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.fixed_values import EMBED_BATCH, NO_DOC, VECTOR_SIZE
from lodeseek.functions.text import in_small_batches

#: From a batch of texts to a vector for each; called on executors, so it must pickle.
Embed = Callable[[list[str]], list[list[float]]]
#: From a chunk's text to an explanation.
Explain = Callable[[str], str]


class RateLimited(Exception):
    """Raised by a service that is to be asked again later."""


def with_retries(call: Callable, *args: object, tries: int = 3, least: float = 5.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(*args); after RateLimited again, up to tries times, with waits that double between least and most seconds."""
    for i in range(tries):
        try:
            return call(*args)
        except RateLimited:
            if i == tries - 1:
                raise
            sleep(min(most, least * 2**i))
    raise ValueError("tries must be 1 or more")


class Pace:
    """A bucket of tokens: at most rate calls a second on the mean, burst at once. For the threads of one task."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at, self.lock = burst, clock(), threading.Lock()

    def take(self) -> None:
        """Wait for a token, in the order of asking: one is taken at once, and what lacks is slept off."""
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
            self.at = now
            lacks = -self.tokens / self.rate
        if lacks > 0:
            self.sleep(lacks)


def paced(call: Callable, rate: float | None) -> Callable:
    """call, at most rate times a second. Made in a task, as a pace doesn't travel."""
    if not rate:
        return call
    pace = Pace(rate)

    def wait(*args: object) -> object:
        pace.take()
        return call(*args)

    return wait


def hashed_vectors(size: int = VECTOR_SIZE) -> Embed:
    """Unit vectors of signed word hashes; the same text has the same vector everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh3_64_intdigest(word)
                out[i, h % size] += 1 if h >> 63 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1)).tolist()

    return embed


def embedded(df: DataFrame, text: str, to: str, embed: Embed, batch: int = EMBED_BATCH, rate: float | None = None) -> DataFrame:
    """df with vectors of the text, asked for in batches; null for null texts. rate: calls a second of each task."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = paced(embed, rate)
        for part in parts:
            out: list = [None] * len(part)
            there = [i for i, t in enumerate(part) if t is not None]
            for k in range(0, len(there), batch):
                some = there[k : k + batch]
                for i, v in zip(some, with_retries(ask, [part.iloc[i] for i in some]), strict=True):
                    out[i] = v
            yield pd.Series(out, index=part.index)

    return in_small_batches(df).withColumn(to, vectors.asNondeterministic()(F.col(text)))  # a filter above must not ask again


def blank(doc: Column) -> Column:
    return doc.isNull() | doc.rlike(r"^[\s\p{Z}]*$")


def explained(df: DataFrame, text: str, doc: str, explain: Explain | None, parallel: int = 1, rate: float | None = None) -> DataFrame:
    """df with blank docs filled: by explain, a few calls at a time in each task, or by the default. rate: calls a second of each task."""
    if explain is None:
        return df.withColumn(doc, F.when(blank(F.col(doc)), NO_DOC).otherwise(F.col(doc)))

    @F.pandas_udf("string")
    def filled(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ask = paced(explain, rate)
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for texts, docs in parts:
                asked = [i for i, d in enumerate(docs) if d is None or not d.strip()]
                out = docs.astype(object).copy()
                for i, answer in zip(asked, pool.map(lambda i, t=texts: with_retries(ask, t.iloc[i]), asked), strict=True):
                    out.iloc[i] = answer or NO_DOC
                yield out

    return df.withColumn(doc, filled.asNondeterministic()(F.col(text), F.col(doc)))  # a filter above must not ask again


ANSWER_BUCKETS = 64


def answer_key(text: Column) -> Column:
    return F.sha2(text, 256)


def answer_bucket(key: Column) -> Column:
    return (F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % ANSWER_BUCKETS).cast("int")
