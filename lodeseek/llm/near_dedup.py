"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text is its lower-cased words; its shingles are runs of five words, weighted by how often the
text has them times 1 + log(min(N / df, RARE)) / log(RARE), where df counts texts with the shingle
over all documents. Counts are kept in a count-min sketch of fixed size: it can't overlook a
frequent shingle, and RARE is chosen so that its error is below what the weight distinguishes.

ICWS draws, for each of BANDS * ROWS seeds, one shingle of a text such that two texts draw alike
with probability equal to their weighted Jaccard similarity. Bands of draws make buckets. Buckets
with the same smallest text, their hub, make one group, so that a pair that shares many buckets
mostly meets once. A group is dealt into blocks of bounded size, each with the hub. In a block the
hub's similarity to all others is computed first, then that of each member that isn't connected with
the hub to all members. Where a group has several blocks, members that all links so far leave apart
from the hub ask the other blocks too, save what distances to the hub rule out. So each pair of a
group is compared, connected or ruled out, and no pairs are listed. Links are closed by pointer
jumping over tables, after each task has contracted its own links.

Texts of the same words are one text from the start, so copies cost nothing more.

Defined results: texts without words (null, empty) are each their own group. A text of fewer than
five words is one shingle. A group's id is the smallest document id in it (null only if it has no
other). Rows that repeat are members of one group. An empty table gives an empty result. Whole
texts are read, of any length, and only the named columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lodeseek.llm.common import Scratch, mapped, table, written

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: Bytes of text that a worker takes at a time (a longer text by itself), and words of it and shingles that it holds as objects or in scratch arrays.
PART_BYTES, WORDS_AT_A_TIME, DRAWN_AT_A_TIME = 1 << 20, 1 << 16, 1 << 15
#: Texts of up to so many characters are cut into words at once.
RUN_CHARS = 1 << 18
#: Words whose hashes a task remembers (about 150 bytes each) before it starts afresh.
REMEMBERED_WORDS = 100_000
#: The sketch: counters in a row, rows, counters in a block of a row, and sketches that one task sums.
SKETCH_WIDTH, SKETCH_ROWS, SKETCH_BLOCK, SKETCH_FAN = 1 << 20, 2, 1 << 15, 64
#: Texts and shingles (in expectation) of a block, into which groups of texts are dealt.
GROUP_ROWS, GROUP_SHINGLES = 256, 500_000
#: Hash values of ids that tell which texts may be asked for: a broadcast table of so many numbers at most (some 25 MB).
SLOTS = 1 << 20
#: Edges that a task contracts at a time.
EDGES_AT_A_TIME = 100_000
#: A shingle in less than one of RARE texts has full weight, twice that of one in every text.
RARE = 500
LEVELS = 200

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(text: str) -> Iterator[list[str]]:
    """The text's words, in lists of bounded length."""
    if len(text) <= RUN_CHARS:
        if found := _WORD.findall(text.lower()):
            yield found
        return
    words = _WORD.finditer(text.lower())
    while run := [m[0] for m in islice(words, WORDS_AT_A_TIME)]:
        yield run


def _digested(runs: Iterator[list[str]], out: xxhash.xxh3_128) -> Iterator[list[str]]:
    """The runs, while out takes in their words, one space between any two."""
    some = False
    for run in runs:
        out.update((" " if some else "") + " ".join(run))
        some = True
        yield run


def _digest(text: str | None) -> bytes | None:
    """The 128-bit hash of the text's words; None without any."""
    out, some = xxhash.xxh3_128(), False
    for _ in _digested(_runs(text or ""), out):
        some = True
    return out.digest() if some else None


class Shingler:
    """Shingle hashes of texts; remembers words' hashes."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes = np.zeros(1 << 12, np.uint64)

    def _codes(self, found: list[str]) -> np.ndarray:
        place = self.place
        try:
            at = [place[w] for w in found]
        except KeyError:
            if len(place) > REMEMBERED_WORDS:
                place.clear()
            for w in found:
                if w not in place:
                    if len(place) == len(self.hashes):
                        self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
                    self.hashes[len(place)] = xxhash.xxh3_64_intdigest(w)
                    place[w] = len(place)
            at = [place[w] for w in found]
        return self.hashes[np.array(at, np.int32)]

    def codes(self, text: str | None) -> np.ndarray:
        """A code for each word of the text."""
        codes = [self._codes(found) for found in _runs(text or "")]
        return np.concatenate(codes) if codes else np.zeros(0, np.uint64)

    def words(self, text: str | None) -> tuple[bytes | None, np.ndarray]:
        """The 128-bit hash of the text's words (None without any), and a code for each word; the text is read once."""
        out = xxhash.xxh3_128()
        codes = [self._codes(found) for found in _digested(_runs(text or ""), out)]
        return (out.digest(), np.concatenate(codes)) if codes else (None, np.zeros(0, np.uint64))

    @staticmethod
    def shingles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, ascending, and how often each occurs."""
        n = max(1, len(codes) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, len(codes))):
            out = out * _ODD + codes[j : j + n]
        return np.unique(_mix(out), return_counts=True)


def _places(shingles: np.ndarray) -> list[np.ndarray]:
    """A shingle's counter in each row of the sketch."""
    mask = np.uint64(SKETCH_WIDTH - 1)
    return [((shingles >> np.uint64(22 * r)) & mask).astype(np.int64) for r in range(SKETCH_ROWS)]


class Weights:
    """The weight of shingles, by the sketch turned into LEVELS steps."""

    def __init__(self, sketch: np.ndarray, texts: int) -> None:
        share = max(texts, 1) / np.maximum(sketch, 1)
        self.step = np.rint(LEVELS * np.log(np.clip(share, 1, RARE)) / np.log(RARE)).astype(np.uint8)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        a, b = (self.step[r][p] for r, p in enumerate(_places(shingles)))
        return 1 + np.maximum(a, b).astype(np.float32) / LEVELS


def _draw_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) for r and of its logarithm for c, and an odd factor for each draw."""
    def quantiles(n: int) -> np.ndarray:
        p = (np.arange(n) + 0.5) / n
        x = np.full(n, 1.7)
        for _ in range(60):  # Newton's method on 1 - (1 + x) exp(-x) = p, in safe steps
            x = np.clip(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), x / 2, x * 2)
        return x

    factors = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    return quantiles(4096).astype(np.float32), np.log(quantiles(65536)).astype(np.float32), factors


def draws(shingles: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """texts x (BANDS * ROWS) draws (32 bits each) of the texts whose shingles begin at starts.

    A shingle's hash for a draw is cut into the places of r, c and beta. Shingles are taken
    DRAWN_AT_A_TIME, so that all steps write into the same few arrays, which stay in the
    processor's cache, however long a text is.
    """
    if not _TABLES:
        _TABLES.extend(_draw_tables())
    factors = _TABLES[2]
    out = np.full((len(starts), len(factors)), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), DRAWN_AT_A_TIME):
        high = min(len(shingles), low + DRAWN_AT_A_TIME)
        first, last = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, high)
        some = _least_keys(shingles[low:high], weight[low:high], np.maximum(starts[first:last] - low, 0))
        np.minimum(out[first:last], some, out=out[first:last])
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _least_keys(shingles: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """texts x draws: the least key of each text's shingles; its upper half is ICWS's a, its lower half names what is drawn."""
    gamma, log_gamma, factors = _TABLES
    n = len(shingles)
    log_weight, name = np.log(weight), (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(starts), len(factors)), np.uint64)
    z, shifted, key = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    r, c, beta, t = (np.empty(n, np.float32) for _ in range(4))
    times = np.empty(n, np.int32)
    quarters, halves = z.view(np.uint16).reshape(-1, 4), z.view(np.uint32)  # little-endian: quarter 3 holds the highest bits
    low, high = key.view(np.uint32)[0::2], key.view(np.uint32)[1::2]
    for k, factor in enumerate(factors):
        np.multiply(shingles, factor, out=z)
        np.right_shift(z, np.uint64(32), out=shifted)
        np.bitwise_xor(z, shifted, out=z)
        np.multiply(z, _ODD, out=z)
        np.take(gamma, quarters[:, 3] >> 4, out=r, mode="clip")
        np.take(log_gamma, quarters[:, 2], out=c, mode="clip")
        np.multiply(halves[0::2], np.float32(2**-32), out=beta, casting="unsafe")
        np.divide(log_weight, r, out=t)
        t += beta
        np.floor(t, out=t)
        times[:] = t
        # The log of ICWS's a is c - r * (t + 1 - beta); 256 more moves it above 0, so that its bits sort.
        np.subtract(t, beta, out=beta)
        beta += 1
        beta *= r
        np.subtract(c, beta, out=c)
        c += np.float32(256)
        high[:] = c.view(np.uint32)
        np.bitwise_xor(name, times.view(np.uint32) * np.uint32(0x9E3779B1), out=low)
        out[:, k] = np.minimum.reduceat(key, starts)
    return out


_TABLES: list[np.ndarray] = []


def bucket_keys(drawn: np.ndarray) -> np.ndarray:
    """texts x BANDS bucket keys."""
    keys = np.zeros((len(drawn), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(drawn), b + 1, np.uint64)
        for j in range(ROWS):
            key = _mix(key * _ODD + drawn[:, b * ROWS + j])
        keys[:, b] = key
    return keys.view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PART_BYTES of the column text."""
    for batch in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


# --- statistics over all documents ---------------------------------------------------------------


def _sketch_rows(sketch: np.ndarray, slot: int) -> Iterator[pa.RecordBatch]:
    """The sketch as rows slot, block, places, counts: what isn't 0 in each block."""
    blocks = sketch.reshape(-1, SKETCH_BLOCK)
    for b, block in enumerate(blocks):
        places = np.flatnonzero(block)
        if len(places):
            yield pa.RecordBatch.from_arrays(
                [pa.array([slot], pa.int32()), pa.array([b], pa.int32()), pa.array([places.astype(np.uint16).tobytes()], pa.binary()), pa.array([block[places].tobytes()], pa.binary())], names=["slot", "block", "places", "counts"]
            )


def _read_block(rows: pa.Table) -> np.ndarray:
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for places, counts in zip(rows.column("places").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int64)
    return total


def frequencies(docs: DataFrame, text: str) -> Weights:
    """Counts of texts by shingle over all documents. Each task sums its own, and tasks of bounded fan-in sum these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch, n = Shingler(), np.zeros((SKETCH_ROWS, SKETCH_WIDTH), np.int64), 0
        for part in _parts(batches, 0):
            coded = [codes for body in part.column(0).to_pylist() if len(codes := shingler.codes(body))]
            n += len(coded)
            if coded:
                for r, places in enumerate(_places(np.concatenate([shingler.shingles(codes)[0] for codes in coded]))):
                    np.add.at(sketch[r], places, 1)
        slot = TaskContext.get().partitionId()
        yield from _sketch_rows(sketch, slot)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([-1], pa.int32()), pa.array([np.zeros(1, np.uint16).tobytes()], pa.binary()), pa.array([np.array([n]).tobytes()], pa.binary())], names=["slot", "block", "places", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        block = _read_block(rows)
        places = np.flatnonzero(block)
        return pa.table({"slot": pa.array([rows.column("slot")[0].as_py()], pa.int32()), "block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "places": pa.array([places.astype(np.uint16).tobytes()], pa.binary()), "counts": pa.array([block[places].tobytes()], pa.binary())})

    schema = "slot int, block int, places binary, counts binary"
    bodies = docs.select(F.col(text).cast("string").alias("text"))
    summed, tasks = mapped(bodies, count, schema), bodies.rdd.getNumPartitions()
    while True:
        summed = summed.withColumn("slot", F.expr(f"slot DIV {SKETCH_FAN}")).groupBy("block", "slot").applyInArrow(add, schema)
        tasks = -(-tasks // SKETCH_FAN)
        if tasks <= 1:
            break
    sketch, texts = np.zeros((SKETCH_ROWS * SKETCH_WIDTH // SKETCH_BLOCK, SKETCH_BLOCK), np.int64), 0
    rows = summed.toArrow()  # the one sketch: 16 MB at most
    for i, block in enumerate(rows.column("block").to_pylist()):
        values = _read_block(rows.slice(i, 1))
        if block < 0:
            texts += int(values[0])
        else:
            sketch[block] += values
    return Weights(sketch.reshape(SKETCH_ROWS, SKETCH_WIDTH), texts)


# --- candidates ----------------------------------------------------------------------------------


def signatures(docs: DataFrame, key: str, text: str, weights: Broadcast) -> DataFrame:
    """key, tid (the words' 128-bit hash; null without words), shingles (their number) and buckets of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in _parts(batches, 1):
            tids: list[bytes | None] = []
            sets, counts = [], []
            for body in part.column(1).to_pylist():
                tid, codes = shingler.words(body)
                tids.append(tid)
                if tid:
                    shingles, times = shingler.shingles(codes)
                    sets.append(shingles)
                    counts.append(times)
            buckets: list[np.ndarray | None] = [None] * len(tids)
            sizes: list[int | None] = [None] * len(tids)
            if sets:
                lengths = iter(map(len, sets))
                sizes = [next(lengths) if t else None for t in tids]
                shingles = np.concatenate(sets)
                weight = weights.value.of(shingles) * np.concatenate(counts).astype(np.float32)
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
                keys = iter(bucket_keys(draws(shingles, weight, starts)))
                buckets = [next(keys) if t else None for t in tids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], names=["key", "tid", "shingles", "buckets"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind}, tid binary, shingles long, buckets array<long>")


def _with_tid(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with one more column, the hash of each text's words (null without words)."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(_digest, part.column(at).to_pylist()), pa.binary())], names=[*part.schema.names, name])

    return mapped(rows, run, StructType([*rows.schema.fields, StructField(name, BinaryType())]))


def weighted_sets(candidates: DataFrame, weights: Broadcast) -> DataFrame:
    """tid and its weighted shingles (32 bits of each, ascending; weight) from those rows tid, text whose text has the hash tid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in _parts(batches, 1):
            tids, names, values = [], [], []
            for tid, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found, codes = shingler.words(body)
                if found is None or found != tid:
                    continue
                shingles, times = shingler.shingles(codes)
                short, where = np.unique((shingles >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                tids.append(tid)
                names.append(short.tobytes())
                values.append(np.bincount(where, weights.value.of(shingles) * times).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(names, pa.binary()), pa.array(values, pa.binary())], names=["tid", "shingles", "weight"])

    return mapped(candidates.select("tid", "text"), run, "tid binary, shingles binary, weight binary")


class Sets:
    """Weighted sets in memory, by shingle, and what is known of their links."""

    def __init__(self, rows: pa.Table) -> None:
        self.tid = rows.column("tid").to_pylist()
        self.names = [np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()]
        self.weight = [np.frombuffer(x, np.float32) for x in rows.column("weight").to_pylist()]
        self.total = np.array([w.sum(dtype=float) for w in self.weight])
        self.root = list(range(len(self.tid)))
        self.links: list[tuple[int, int]] = []
        owner = np.repeat(np.arange(len(self.names), dtype=np.int32), [len(x) for x in self.names])
        names = np.concatenate(self.names)
        order = np.argsort(names, kind="stable")
        self.known, self.first, self.often = np.unique(names[order], return_index=True, return_counts=True)
        self.owner, self.held = owner[order], np.concatenate(self.weight)[order]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)

    def similarities(self, i: int) -> np.ndarray:
        """Of set i and each set: what is common is summed over the lists of its shingles."""
        at = np.searchsorted(self.known, self.names[i])
        often = self.often[at]
        ends = np.cumsum(often)
        where = np.arange(ends[-1]) + np.repeat(self.first[at] - ends + often, often)
        common = np.bincount(self.owner[where], np.minimum(np.repeat(self.weight[i], often), self.held[where]), len(self.tid))
        return common / (self.total[i] + self.total - common)

    def ask(self, i: int) -> None:
        """Link i with all that are similar and not connected yet."""
        for j in np.flatnonzero(self.similarities(i) >= SIMILAR).tolist():
            if self.find(i) != self.find(j):
                self.join(i, j)
                self.links.append((i, j))

    def found(self) -> pa.Table:
        i, j = zip(*self.links, strict=True) if self.links else ((), ())
        return pa.table({"a": pa.array([self.tid[x] for x in i], pa.binary()), "b": pa.array([self.tid[x] for x in j], pa.binary())})


_LINK = "a binary, b binary"


def _blocks(rows: Column, size: Column) -> Column:
    """Into how many blocks so many texts and shingles go."""
    return F.greatest(F.ceil(rows / GROUP_ROWS), F.ceil(size / GROUP_SHINGLES), F.lit(1)).cast("int")


def _first_links(blocks: DataFrame) -> DataFrame:
    """a, b: links within blocks (hub, block, blocks, tid, size, shingles, weight). With size and sim: a member, its hub and their similarity, where a group has several blocks."""

    def resolve(rows: pa.Table) -> pa.Table:
        sets, hub = Sets(rows), rows.column("hub")[0].as_py()
        first = sets.tid.index(hub)
        for i in (first, *range(len(sets.tid))):
            if i == first or sets.find(i) != sets.find(first):
                sets.ask(i)
        links = sets.found()
        none = pa.nulls(len(links), pa.int64())
        out = links.append_column("size", none).append_column("sim", none.cast(pa.float64()))
        if rows.column("blocks")[0].as_py() == 1:
            return out
        others = np.flatnonzero(np.arange(len(sets.tid)) != first)
        sims = sets.similarities(first)[others]
        judged = pa.table({"a": rows.column("tid").take(others), "b": pa.array([hub] * len(others), pa.binary()), "size": rows.column("size").take(others), "sim": sims})
        return pa.concat_tables([out, judged.cast(out.schema)])

    return blocks.groupBy("hub", "block").applyInArrow(resolve, f"{_LINK}, size long, sim double")


def _block_links(judged: DataFrame, linked: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between members of groups of several blocks and those that linked leaves apart from the hub. judged: tid, hub, size, sim.

    Members that are apart ask all others of the group, but those that the distances to the hub rule
    out (distance is a metric). Members are dealt anew: a task has a block of those that ask and one
    of the others.
    """
    roots = components(linked, scratch)
    of = lambda node, name: roots.select(F.col("node").alias(node), F.col("root").alias(name))
    placed = judged.join(of("tid", "part"), "tid", "left").join(of("hub", "hub_part"), "hub", "left")
    known = scratch.written(placed.select("hub", "tid", "size", "sim", F.coalesce("part", "tid").alias("part"), (F.coalesce("part", "tid") != F.coalesce("hub_part", "hub")).alias("asks")), "dedup-known")
    asking, size = F.when(F.col("asks"), 1).otherwise(0), F.when(F.col("asks"), F.col("size")).otherwise(0)
    counts = known.groupBy("hub").agg(_blocks(F.count("*"), F.sum("size")).alias("ys"), _blocks(F.sum(asking), F.sum(size)).alias("xs"), F.max(F.when(F.col("asks"), F.col("sim"))).alias("nearest")).where("nearest IS NOT NULL")
    # One that is connected with the hub, and nearer to it than all that aren't are by more than 1 - SIMILAR, can't be similar to any of them.
    open_ = scratch.written(known.join(scratch.written(counts, "dedup-counts"), "hub").where(F.col("asks") | ((1 - F.col("sim")) >= (1 - F.col("nearest")) - (1 - SIMILAR))), "dedup-open")
    block = lambda n: F.pmod(F.xxhash64("tid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.where("asks").select("hub", "tid", "part", block("xs").alias("x"), each("ys").alias("y"), F.lit(True).alias("asks"))
    right = open_.select("hub", "tid", "part", each("xs").alias("x"), block("ys").alias("y"), F.lit(False).alias("asks"))
    dealt = left.unionByName(right).join(sets, "tid")

    def resolve(rows: pa.Table) -> pa.Table:
        held, first = Sets(rows), {}
        for i, part in enumerate(rows.column("part").to_pylist()):
            held.join(first.setdefault(part, i), i)
        for i, asks in enumerate(rows.column("asks").to_pylist()):
            if asks:
                held.ask(i)
        return held.found()

    return dealt.groupBy("hub", "x", "y").applyInArrow(resolve, _LINK)


def links(docs: DataFrame, signed: DataFrame, key: str, text: str, weights: Broadcast, scratch: Scratch) -> DataFrame:
    """a, b: similar pairs of different texts, enough to connect all that share a bucket and are similar."""
    texts = signed.where("tid IS NOT NULL").groupBy("tid").agg(F.min("key").alias("rep"), F.max("shingles").alias("size"), F.first("buckets").alias("buckets"))
    in_buckets = texts.select("tid", "size", F.explode("buckets").alias("bucket"))
    shared = scratch.written(in_buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("tid").alias("hub")).where("n > 1").select("bucket", "hub"), "dedup-buckets")
    members = scratch.written(in_buckets.join(shared, "bucket").select("hub", "tid", "size").dropDuplicates(), "dedup-members")
    large = scratch.written(members.groupBy("hub").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks")).where("blocks > 1"), "dedup-large")
    wanted = scratch.written(texts.join(members.select("tid").dropDuplicates(), "tid").select("tid", "rep"), "dedup-wanted")
    # The text of a tid is that of any row with its words; rows of one id may hold other texts, so the hash decides.
    body = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("text"))
    slot = F.pmod(F.xxhash64("rep"), F.lit(SLOTS))
    slots = scratch.written(wanted.where("rep IS NOT NULL").select(slot.alias("slot")).dropDuplicates(), "dedup-slots")
    asked = body.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").select("rep", "text")  # few other texts are moved while few are wanted
    bodies = asked.join(wanted, "rep").select("tid", "text")
    # Texts that only rows without an id have are found by their hash.
    nameless = _with_tid(body.where("rep IS NULL").select("text"), "text", "tid").where("tid IS NOT NULL").dropDuplicates(["tid"])
    bodies = bodies.unionByName(nameless.join(wanted.where("rep IS NULL").select("tid"), "tid").select("tid", "text"))
    sets = scratch.written(weighted_sets(bodies, weights).dropDuplicates(["tid"]), "dedup-sets")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.when(F.col("tid") == F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("tid"), blocks).cast("int")))
    dealt = members.join(large, "hub", "left").select("hub", "tid", "size", blocks.alias("blocks"), F.explode(own).alias("block"))
    first = _first_links(dealt.join(sets, "tid"))
    if large.isEmpty():
        return first.select("a", "b")
    first = scratch.written(first, "dedup-first")
    linked = first.where("sim IS NULL").select("a", "b")
    judged = first.where("sim IS NOT NULL").select(F.col("a").alias("tid"), F.col("b").alias("hub"), "size", "sim")
    return linked.unionByName(_block_links(judged, linked, sets, scratch))


# --- groups --------------------------------------------------------------------------------------


def _contracted(edges: DataFrame) -> DataFrame:
    """a, b with a > b: each EDGES_AT_A_TIME edges of a task as a forest, every node at the smallest one that they connect it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, EDGES_AT_A_TIME):
                part, root = batch.slice(start, EDGES_AT_A_TIME), {}

                def find(x: object) -> object:
                    while (up := root.setdefault(x, x)) != x:
                        root[x] = x = root[up]
                    return x

                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x, y = find(x), find(y)
                    root[max(x, y)] = min(x, y)
                nodes = [x for x in root if find(x) != x]
                kind = part.schema.types[0]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the component's smallest node) of all nodes but the roots, from edges a, b.

    In a round each node keeps the smallest of its smaller neighbours, the others are hung below
    that one, and it moves on to that one's own. Edges never become more. Each join has one row a
    key on the right, read from a written table, so that Spark can split the rows at a hub.
    """
    edges = scratch.written(_contracted(edges), "dedup-edges")
    while True:
        least = scratch.written(edges.groupBy("a").agg(F.min("b").alias("m")), "dedup-least")
        others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        jumped = least.join(least.select(F.col("a").alias("m"), F.col("m").alias("up")), "m", "left").select("a", F.coalesce("up", "m").alias("b"), F.col("up").isNotNull().alias("moved"))
        edges = scratch.written(others.unionByName(jumped), "dedup-edges")
        if edges.where("moved").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = edges.select("a", "b")


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, own (the hash of the text's words) and tid (its group's hash; both null without words) of every row of docs, written."""
    spark = docs.sparkSession
    scratch, weights = Scratch(spark), spark.sparkContext.broadcast(frequencies(docs, text))  # 2 MB
    signed = scratch.written(signatures(docs, key, text, weights), "dedup-signatures")
    roots = components(links(docs, signed, key, text, weights, scratch), scratch)
    rows = signed.select("key", F.col("tid").alias("own")).join(roots, F.col("own") == F.col("node"), "left").select("key", "own", F.coalesce("root", "own").alias("tid"))
    rows = written(rows, "dedup-rows")
    weights.destroy()
    scratch.close()
    return rows


def groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and class_id of every row of docs: the smallest key of its group of similar texts."""
    # Summed up before the shuffle, and written: joined back to a written table, a text with many copies can be split.
    rows = _grouped(docs, key, text)
    least = written(rows.where("tid IS NOT NULL").groupBy("tid").agg(F.min("key").alias("class_id")), "dedup-classes")
    return rows.join(least, "tid", "left").select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"))


def deduplicated(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with one row of each group: that of the smallest key (of rows that repeat with that key, one; without any key, one)."""
    rows = _grouped(docs, key, text)
    first = F.min(F.struct(F.col("key").isNull().alias("without"), "key", "own")).alias("first")
    least = rows.where("tid IS NOT NULL").groupBy("tid").agg(first).select(F.col("first.key").alias("key"), F.col("first.own").alias("own"))
    stay = written(least.unionByName(rows.where("tid IS NULL").select("key", "own")), "dedup-stay")
    again = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 OR key IS NULL").select("key"), "dedup-again")
    held = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"))  # names of docs can't clash in here
    single = held.join(stay.join(again, "key", "left_anti").where("key IS NOT NULL").select("key"), "key").select("row.*")
    if again.isEmpty():
        return single
    # A key that many rows have doesn't tell which of them stays: the words' hash does. Rows without words all stay.
    known = again.select(F.col("key").alias("known"))
    marked = _with_tid(held.join(known, F.col("key").eqNullSafe(F.col("known")), "left_semi").select("row", "key", F.col(f"row.`{text}`").cast("string").alias("body")), "body", "tid")
    chosen = stay.where("own IS NOT NULL").select(F.col("key").alias("chosen"), "own")
    one = marked.join(chosen, (F.col("tid") == F.col("own")) & F.col("key").eqNullSafe(F.col("chosen")), "left_semi").dropDuplicates(["key", "tid"])
    return single.unionByName(marked.where("tid IS NULL").unionByName(one).select("row.*"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id (the group's smallest doc_id) of every document."""
    return groups(table(spark, sf_dir, "documents"), "doc_id", "text")
