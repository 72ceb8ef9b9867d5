"""Benchmark decontamination by a positional inverted index of the training texts.

The index is filed by segments: a segment holds some thousand texts, laid end to end with a gap, and
for each of its words the places where that word stands, as one ascending list. So building it needs
no shuffle, a word in every text is a bounded list in every segment, and all that one text needs for
an intersection stands in one segment. No phrase matches across a gap.

Test phrases are looked up from their rarest words on. The lists of a phrase's rarest word give
candidate places of its begin (each place less the word's offset). Then come the next rarest, and then
the others: the places where candidates want the words are gathered by segment and word, and
intersected with that word's list; a candidate stays if all its words are found. Phrases that share
a rarest word share the work only in that they read the same lists; phrases equal as word sequences
are one. With a slop, a word may stand up to so many places beside where the phrase has it, as seen
from the rarest word: proximity matches. With a slop of 0, what is found is the exact phrase.

Defined results: a null text has no words; nor does an item without words have a window. Rows that
repeat are texts of their own. Item ids that repeat count once; a null id is an empty text. Texts of
any length are indexed whole (long ones are cut into words piece by piece). An empty table gives an
empty one; without items nothing is hit. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lodeseek.llm.common import Scratch, mapped, table, written

#: Words of a window.
WINDOW = 10
#: Places that a word may be off in a proximity match.
SLOP = 2
#: Of a phrase's distinct words, those after the rarest whose lists are intersected by themselves, before all the others.
NEXT_RAREST = 1
#: Words of a segment, about: a segment ends with the batch that reaches this.
SEGMENT_WORDS = 2_000_000
#: Free places between a segment's texts; a slop must be less than half of it.
GAP = 64
#: Ascending lists are stored as small differences.
STORED = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: What lies between words, once A-Z are lower-cased; CLEAN says the same of UTF-8 bytes.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII letters lower-cased, digits and all beyond ASCII kept, the rest a space: words of the contract are what lies between spaces, as UTF-8.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def numbered(text: bytes, ids: defaultdict[bytes, int]) -> np.ndarray:
    """The text's words as numbers; ids numbers new ones."""
    text, begin, out = text.translate(CLEAN), 0, []
    while begin < len(text):
        end = text.find(b" ", begin + PIECE)
        end = len(text) if end < 0 else end
        out.append(np.fromiter(map(ids.__getitem__, text[begin:end].split()), np.int64))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def segment_rows(segment: int, keys: pa.ChunkedArray, ids: defaultdict[bytes, int], coded: list[np.ndarray]) -> pa.RecordBatch:
    """index()'s rows of a segment: coded holds each text's words, ids numbers them."""
    sizes = np.array([len(c) for c in coded], np.int64)
    starts = np.cumsum(sizes + GAP) - sizes - GAP
    terms = np.concatenate(coded)
    places = np.arange(len(terms)) + np.repeat(np.arange(len(coded)) * GAP, sizes)
    places = (np.sort(terms << 32 | places) & 0xFFFFFFFF).astype(np.int32)  # by term, ascending
    n, counts = len(ids), np.bincount(terms, minlength=len(ids))
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(places))
    own = lambda values: pa.concat_arrays([pa.nulls(n, pa.list_(values.type)), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)])
    return pa.RecordBatch.from_pydict({
        "segment": pa.array(np.full(n + 1, segment)), "term": pa.concat_arrays([pa.array([w.decode("utf-8", "replace") for w in ids], pa.string()), pa.nulls(1, pa.string())]),
        "n": pa.array(np.append(counts, len(coded)).astype(np.int64)), "keys": own(pa.concat_arrays(keys.chunks)), "n_words": own(pa.array(sizes)), "starts": own(pa.array(starts)),
        "places": pa.concat_arrays([listed, pa.nulls(1, listed.type)]),
    })


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each segment and word (segment, term, n, places), and one for each segment (term null): its texts' keys, numbers of words and first places."""
    asked = df.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("body"))
    lists = {"keys": asked.schema["key"].dataType, "n_words": LongType(), "starts": LongType(), "places": IntegerType()}
    schema = StructType([*StructType.fromDDL("segment bigint, term string, n bigint").fields, *(StructField(c, ArrayType(t)) for c, t in lists.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        keys, ids, coded, n = [], defaultdict(count().__next__), [], 0
        for batch in batches:
            keys.append(batch.column(0))
            coded += [numbered(t.as_py() or b"", ids) for t in batch.column(1)]
            n += sum(map(len, coded[len(coded) - batch.num_rows :]))
            if n >= SEGMENT_WORDS:
                yield segment_rows(segment, pa.chunked_array(keys), ids, coded)
                segment, keys, ids, coded, n = segment + 1, [], defaultdict(count().__next__), [], 0
        if coded:
            yield segment_rows(segment, pa.chunked_array(keys), ids, coded)

    return mapped(asked, run, schema)


def texts(indexed: DataFrame) -> DataFrame:
    """segment, start, key, n_words of each text in the index."""
    held = indexed.where("term IS NULL").select("segment", F.explode(F.arrays_zip("keys", "n_words", "starts")).alias("x"))
    return held.select("segment", F.col("x.starts").alias("start"), F.col("x.keys").alias("key"), F.col("x.n_words").alias("n_words"))


def windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """item, phrase (words): each run of size consecutive words of an item; if it has fewer, but not none, all of them."""
    w = F.array_remove(F.split(F.translate(F.col(text), UPPER, LOWER), BETWEEN), "")
    worded = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), w.alias("w")).where(F.size("w") > 0)
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))).alias("begin")
    return worded.select("item", "w", begins).select("item", F.slice("w", F.col("begin"), size).alias("phrase")).distinct()


def _confirmed(candidates: DataFrame, wanted: DataFrame, asked: DataFrame, slop: int) -> DataFrame:
    """Those of candidates (segment, phrase_id, at, off) whose wanted words (phrase_id, term, offset) all stand within slop of their places. off grows by how far."""
    by = ["segment", "phrase_id", "at", "off"]
    wants = candidates.join(wanted, "phrase_id").select(*by, "offset", "term", (F.col("at") + F.col("offset")).alias("place"))
    beside = wants.withColumn("found", F.explode(F.sequence(F.col("place") - slop, F.col("place") + slop)) if slop else F.col("place"))
    # At most as many places as the segment's candidates want: a segment is a batch of texts.
    gathered = beside.groupBy("segment", "term").agg(F.collect_set("found").alias("wanted"))
    lists = asked.join(wanted.select("term").distinct(), "term", "left_semi")
    found = gathered.join(lists, ["segment", "term"]).select("segment", "term", F.explode(F.array_intersect("wanted", "places")).alias("found"))
    met = beside.join(found, ["segment", "term", "found"]).groupBy(*by, "offset").agg(F.min(F.abs(F.col("found") - F.col("place"))).alias("beside"))
    n_wanted = wanted.groupBy("phrase_id").agg(F.count("*").alias("n_wanted"))
    full = met.groupBy(*by).agg(F.count("*").alias("n_met"), F.sum("beside").alias("beside")).join(n_wanted, "phrase_id").where("n_met = n_wanted")
    return full.select("segment", "phrase_id", "at", (F.col("off") + F.col("beside")).cast("int").alias("off"))


def search(indexed: DataFrame, phrases: DataFrame, scratch: Scratch, slop: int = 0) -> DataFrame:
    """segment, start, phrase_id, begin, off: where phrases (phrase_id, phrase) stand in the index's texts.

    off is 0 for an exact match, else by how many places its words are off, in sum. begin is where the
    rarest word (ties: the first) would have the phrase begin; in a proximity match that may lie before the text.
    """
    if 2 * slop >= GAP:
        raise ValueError(f"a slop must be less than half of {GAP}")
    places = phrases.select("phrase_id", F.posexplode("phrase").alias("offset", "term"))
    # What the lookups read of the index: the lists of the phrases' words.
    asked = scratch.written(indexed.where("term IS NOT NULL").join(places.select("term").distinct(), "term", "left_semi").select("segment", "term", "n", "places"), "contamination-asked", **STORED)
    held = asked.groupBy("term").agg(F.sum("n").alias("n"))
    of_phrase = Window.partitionBy("phrase_id")  # a window's words
    ranks = places.join(held, "term", "left").withColumns({"rank": F.row_number().over(of_phrase.orderBy("n", "offset")), "absent": F.max(F.col("n").isNull()).over(of_phrase)})
    ranked = scratch.written(ranks.where("NOT absent").select("phrase_id", "term", "offset", "rank"), "contamination-ranks")
    begins = asked.join(ranked.where("rank = 1").select("phrase_id", "term", "offset"), "term").select("segment", "phrase_id", "offset", F.explode("places").alias("place"))
    found = begins.select("segment", "phrase_id", (F.col("place") - F.col("offset")).alias("at"), F.lit(0).alias("off"))
    for low, high in ((2, 1 + NEXT_RAREST), (2 + NEXT_RAREST, 1 << 30)):
        found = scratch.written(found, "contamination-found")
        of_rank = ranked.where(F.col("rank").between(low, high)).select("phrase_id", "term", "offset")
        without = found.join(of_rank, "phrase_id", "left_anti")  # their phrases have no more words
        found = _confirmed(found, of_rank, asked, slop).unionByName(without)
    # The text of a match is the last that starts no later than the match's words may stand.
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in found.dtypes if c != "segment"]
    starts = texts(indexed).select("segment", *nothing, "start", F.col("start").alias("place"))
    both = starts.unionByName(found.withColumns({"start": F.lit(None).cast("bigint"), "place": (F.col("at") + slop).cast("bigint")}))
    in_segment = Window.partitionBy("segment").orderBy("place", F.col("phrase_id").asc_nulls_first())  # a segment's matches and texts
    of_text = both.withColumn("start", F.last("start", ignorenulls=True).over(in_segment)).where("phrase_id IS NOT NULL")
    return of_text.select("segment", "start", "phrase_id", (F.col("at") - F.col("start")).alias("begin"), "off")


def overlap(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words inside exact matches of an item's windows), n_items, items_sha256, contaminated, n_near (items with proximity matches only)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    indexed = scratch.written(index(docs, key, text), "contamination-index", **STORED)
    listed = scratch.written(windows(items, item_key, item_text, size), "contamination-windows")
    phrases = scratch.written(listed.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "contamination-phrases")
    found = scratch.written(search(indexed, phrases, scratch, slop).join(phrases.select("phrase_id", F.size("phrase").alias("length")), "phrase_id"), "contamination-matches")
    one = ["segment", "start"]
    spans = found.where("off = 0").groupBy(*one, "begin").agg(F.max(F.col("begin") + F.col("length")).alias("end"))
    reached = F.max("end").over(Window.partitionBy(*one).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))  # a text's words, at most
    fresh = F.col("end") - F.greatest(F.col("begin"), F.least(F.col("end"), F.coalesce(reached, F.lit(0).cast("bigint"))))
    hits = spans.withColumn("fresh", fresh).groupBy(*one).agg(F.sum("fresh").alias("n_hit"))
    of_item = listed.join(phrases, "phrase").select("phrase_id", "item")
    exact = found.groupBy(*one, "phrase_id").agg(F.min("off").alias("off")).join(of_item, "phrase_id").groupBy(*one, "item").agg((F.min("off") == 0).alias("exact"))
    ids = exact.groupBy(*one).agg(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near"))
    nothing = F.array().cast("array<string>")
    out = texts(indexed).join(hits, one, "left").join(ids, one, "left").withColumn("items", F.coalesce("items", nothing)).select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
    done = written(out, "contamination")
    scratch.close()
    return done


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of documents with benchmark."""
    return overlap(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
wi AS (SELECT DISTINCT item, w[b:b + {WINDOW - 1}] AS p FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS b FROM i WHERE len(w) > 0)),
ph AS (SELECT row_number() OVER () AS id, p, len(p) AS n FROM (SELECT DISTINCT p FROM wi)),
t AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
x AS (SELECT DISTINCT r, id, pos, ph.n FROM (SELECT d.r, t.pos, l.n, d.w[t.pos:t.pos + l.n - 1] AS p FROM t JOIN d USING (r), (SELECT DISTINCT n FROM ph) AS l WHERE t.pos + l.n - 1 <= len(d.w)) AS g JOIN ph USING (p)),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS q FROM x) GROUP BY r),
pw AS (SELECT id, n, unnest(p) AS word, unnest(range(n)) AS o FROM ph),
tf AS (SELECT word, count(*) AS c FROM t GROUP BY word),
ra AS (SELECT id, word, o FROM (SELECT pw.*, row_number() OVER (PARTITION BY id ORDER BY c, o) AS k FROM pw JOIN tf USING (word)) WHERE k = 1),
ca AS (SELECT t.r, ra.id, t.pos - ra.o AS b FROM ra JOIN t USING (word)),
sl AS (SELECT unnest(range(-{SLOP}, {SLOP + 1})) AS s),
na AS (SELECT ca.r, ca.id, ca.b FROM ca JOIN pw USING (id), sl JOIN t ON t.r = ca.r AND t.pos = ca.b + pw.o + sl.s AND t.word = pw.word WHERE pw.o <> (SELECT o FROM ra WHERE ra.id = ca.id) GROUP BY ca.r, ca.id, ca.b, pw.n HAVING count(DISTINCT pw.o) = pw.n - 1),
nr AS (SELECT DISTINCT r, id FROM na UNION SELECT r, id FROM ca JOIN ph USING (id) WHERE ph.n = 1),
it AS (SELECT r, item, bool_or(e) AS e FROM (SELECT r, id, true AS e FROM x UNION ALL SELECT r, id, false FROM nr) JOIN ph USING (id) JOIN wi USING (p) GROUP BY r, item),
a AS (SELECT r, count(*) FILTER (e) AS n_items, count(*) FILTER (NOT e) AS n_near, string_agg(item, ',' ORDER BY item) FILTER (e) AS items FROM it GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hw USING (r) LEFT JOIN a USING (r)
"""
