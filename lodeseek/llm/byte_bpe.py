"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a vocabulary
entry is resolved by one probe. Tier two takes the misses: a heap of candidate merges over a
doubly linked list of the pre-token's bytes, lowest rank first and leftmost among equals.

Defined results: a null or empty text has no ids and decodes to no bytes. A text of any length is
encoded whole, in pieces of bounded size. Repeated rows give repeated results, an empty table an
empty one, and columns other than the named key and text columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.common import mapped, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers (about 200 bytes each) before it starts afresh.
MEMO_ENTRIES = 300_000
#: Pre-tokens of one text that are handled at a time.
SLICE = 65_536
#: Pre-tokens longer than this many characters are not remembered.
MEMO_CHARS = 64


@dataclass
class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys take the n slots, one probe each.

    A key's 128-bit hash gives its bucket and two offsets; the bucket's displacement pair, found
    when the table is built, moves all the bucket's keys to slots of their own.
    """

    n: int
    buckets: int
    shift: np.ndarray
    stride: np.ndarray
    seed: int = 0

    @staticmethod
    def _parts(key: bytes, n: int, buckets: int, seed: int) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key, seed)
        return (h >> 96) % buckets, (h & 0xFFFFFFFF) % n, 1 + ((h >> 40) & 0xFFFFFFFF) % max(1, n - 1)

    @classmethod
    def build(cls, keys: list[bytes]) -> tuple[PerfectHash, list[int]]:
        """The hash, and for each slot the place in keys of the key that has it."""
        if len(set(keys)) != len(keys):
            raise ValueError("keys of a perfect hash must differ")
        for seed in range(1000):  # few keys may collide in all their offsets; then another seed parts them
            if found := cls._try(keys, seed):
                return found
        raise ValueError("no perfect hash found")

    @classmethod
    def _try(cls, keys: list[bytes], seed: int) -> tuple[PerfectHash, list[int]] | None:
        n = len(keys)
        buckets = max(1, n // 4)
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
        for place, key in enumerate(keys):
            bucket, start, step = cls._parts(key, n, buckets, seed)
            members[bucket].append((place, start, step))
        shift, stride = np.zeros(buckets, np.uint32), np.zeros(buckets, np.uint32)
        slots = [-1] * n
        free_from = 0
        for bucket in sorted(range(buckets), key=lambda b: -len(members[b])):
            group = members[bucket]
            if not group:
                break
            if len(group) == 1:
                while slots[free_from] >= 0:
                    free_from += 1
                place, start, _ = group[0]
                shift[bucket] = (free_from - start) % n
                slots[free_from] = place
                continue
            if not (found := cls._displace(group, slots, n)):
                return None
            a, b = found
            shift[bucket], stride[bucket] = a, b
            for place, start, step in group:
                slots[(start + a + b * step) % n] = place
        return cls(n, buckets, shift, stride, seed), slots

    @staticmethod
    def _displace(group: list[tuple[int, int, int]], slots: list[int], n: int) -> tuple[int, int] | None:
        for b in range(min(n, 4096)):
            for a in range(min(n, 256)):
                taken = {(start + a + b * step) % n for _, start, step in group}
                if len(taken) == len(group) and all(slots[t] < 0 for t in taken):
                    return a, b
        return None

    def slot(self, key: bytes) -> int:
        bucket, start, step = self._parts(key, self.n, self.buckets, self.seed)
        return (start + int(self.shift[bucket]) + int(self.stride[bucket]) * step) % self.n


@dataclass
class Vocabulary:
    """Token bytes by id, and the perfect hash that finds an id by its bytes."""

    tokens: list[bytes]
    hashed: PerfectHash
    id_at_slot: list[int]
    mark: str = ""
    ranks: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        """From rank-file lines: base64 of the bytes, a space, the rank."""
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
        tokens = [b""] * (max(ranks.values()) + 1)
        for key, rank in ranks.items():
            tokens[rank] = key
        keys = list(ranks)
        hashed, slots = PerfectHash.build(keys)
        return cls(tokens, hashed, [ranks[keys[place]] for place in slots], xxhash.xxh3_128_hexdigest(lines))

    def whole(self, piece: bytes) -> int | None:
        """The id of piece if it is a vocabulary entry."""
        found = self.id_at_slot[self.hashed.slot(piece)]
        return found if self.tokens[found] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """The ids of piece by merging neighbours, lowest rank first, leftmost among equals."""
        ranks = self.ranks or self._fill()
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := after[i]) >= n:
                continue
            both = left + parts[j]
            if ranks.get(both) != rank:  # one of the two has grown since
                continue
            parts[i], parts[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(both + parts[k])) is not None:
                    heapq.heappush(heap, (rank, i))
            if (k := before[i]) >= 0 and (rank := ranks.get(parts[k] + both)) is not None:
                heapq.heappush(heap, (rank, k))
        return [ranks[p] for p in parts if p is not None]

    def _fill(self) -> dict[bytes, int]:
        self.ranks = {token: i for i, token in enumerate(self.tokens) if token}
        return self.ranks

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "hashed": self.hashed, "id_at_slot": self.id_at_slot, "mark": self.mark, "ranks": {}}


class Encoder(dict):
    """From a pre-token to its ids as little-endian unsigned 32-bit integers; what it has met it remembers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        super().__init__()
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        found = self.vocabulary.whole(raw)
        ids = self.vocabulary.merged(raw) if found is None else [found]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        matches = (m[0] for m in self.pieces.finditer(text)) if len(text) > SLICE else iter(self.pieces.findall(text))
        out = bytearray()
        while some := list(islice(matches, SLICE)):
            out += b"".join(map(self.__getitem__, some))
        if len(self) > MEMO_ENTRIES:
            self.clear()
        return bytes(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


#: A worker process keeps the encoder of the broadcast that it last used, with what it remembers, for its next task.
_LAST: list = [None, None]


def _encoder(shared: Broadcast, pattern: str) -> Encoder:
    """The vocabulary's own mark tells broadcasts apart: a worker unpickles it anew for each task."""
    mark = (shared.value.mark, pattern)
    if _LAST[0] != mark:
        _LAST[:] = [mark, Encoder(shared.value, pattern)]
    return _LAST[1]


def load(spark: SparkSession, path: str) -> Vocabulary:
    """Read a rank file, by Spark if its path has a scheme, else from the driver's disk."""
    if "://" in path:
        lines = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    else:
        with open(path, "rb") as f:
            lines = f.read()
    return Vocabulary.parse(lines)


def encode(df: DataFrame, key: str, text: str, vocabulary: Vocabulary, pattern: str, as_array: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids and decoded (the ids' bytes again).

    ids is binary, little-endian unsigned 32-bit integers, or with as_array an array of integers.
    One narrow pass without a shuffle; the vocabulary (about 1 MB, of fixed size) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = df.schema[key].dataType
    ids_type, ids_arrow = (T.ArrayType(T.LongType()), pa.list_(pa.int64())) if as_array else (T.BinaryType(), pa.binary())
    schema = T.StructType([T.StructField("key", kept), T.StructField("n_tokens", T.LongType()), T.StructField("ids", ids_type), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                packed = [encoder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                ids = [np.frombuffer(p, "<u4").astype(np.int64) for p in packed] if as_array else packed
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(ids, ids_arrow), pa.array([encoder.decode(p) for p in packed], pa.binary())],
                    names=["key", "n_tokens", "ids", "decoded"],
                )

    return mapped(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, schema).withColumnRenamed("key", key)


def default_vocabulary() -> tuple[str, str]:
    """The public rank file's path and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents."""
    path, pattern = default_vocabulary()
    coded = encode(table(spark, sf_dir, "documents"), "doc_id", "text", load(spark, path), pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
