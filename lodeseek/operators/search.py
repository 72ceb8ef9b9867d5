"""Ranked retrieval: BM25 and cosine branches, fused by reciprocal rank, with threshold and limit."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.fixed_values import BM25_AVERAGE_LENGTH, BM25_B, BM25_K1, MAX_RESULTS, RRF_K
from lodeseek.functions import stemming
from lodeseek.functions.scoring import cosine, idf, reciprocal_rank, saturation
from lodeseek.functions.text import in_small_batches
from lodeseek.operators import sparse_index

#: Scores are rounded before they rank, so that the order of a sum's terms can't change a ranking.
DIGITS = 6


def query_terms(query: str, english: bool = False) -> list[str]:
    """The query's distinct words; english: stems of those that aren't stop-words."""
    found = re.findall(r"[a-z0-9]+", query.lower())
    return list(dict.fromkeys(stemming.english(found) if english else found))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(df: DataFrame, id: str, text: str, field: str, english: bool = False) -> DataFrame:
    """chunk_id, field, term, tf, doc_len of every term; english: stems of words that aren't stop-words, which lengths leave out too."""
    words = terms(F.col(text))
    df = in_small_batches(df) if english else df
    split = df.select(F.col(id).alias("chunk_id"), F.lit(field).alias("field"), (stemming.english_terms(words) if english else words).alias("t"))
    counted = split.select("chunk_id", "field", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("chunk_id", "field", "term", "doc_len").agg(F.count("*").cast("int").alias("tf"))
    return counted.select("chunk_id", "field", "term", "tf", "doc_len")


POSTING_BUCKETS = 32


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


def filed(postings: DataFrame) -> DataFrame:
    """postings with their layer and the bucket that a store files them under."""
    return sparse_index.layered(postings).withColumn("bucket", bucket_of(F.col("term")))


def top(df: DataFrame, k: int, score: str = "score", id: str = "id") -> DataFrame:
    """The k best with rank (from 0). The limit comes first, so only k rows are numbered."""
    best = df.orderBy(F.desc(score), id).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id)) - 1)


def bm25_scores(df: DataFrame, id: str, text: str, query: str, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE_LENGTH) -> DataFrame:
    """id and score of the texts that have a term of the query.

    Only the query's terms are exploded. Their number is fixed, so term statistics are a handful of
    rows, aggregated in each task before the shuffle.
    """
    asked = query_terms(query)
    wanted = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
    split = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), terms(F.col(text)).alias("t"))
    found = split.select("id", F.size("t").alias("n"), F.explode(F.array_intersect("t", wanted)).alias("term"), "t").select("id", "n", "term", F.size(F.filter("t", lambda x: x == F.col("term"))).alias("tf"))
    texts = df.where(F.col(text).isNotNull()).agg(F.count("*").alias("texts"))
    statistics = found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(texts)).select("term", idf(F.col("texts"), F.col("df")).alias("idf"))
    weighed = found.join(F.broadcast(statistics), "term")  # a row for each term of the query
    return weighed.groupBy("id").agg(F.round(F.sum(F.col("idf") * saturation(F.col("tf"), F.col("n"), k1, b, average)), DIGITS).alias("score"))


def stored_scores(postings: DataFrame, field: str, texts: int, query: str, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE_LENGTH) -> DataFrame:
    """bm25_scores from filed postings of texts texts: only the buckets of the query's terms are read."""
    asked = query_terms(query)
    if not asked:
        return postings.where("false").select(F.col("chunk_id").alias("id"), F.lit(0.0).alias("score"))
    wanted = F.lit(False)
    for term in asked:
        wanted = wanted | ((F.col("bucket") == bucket_of(F.lit(term))) & (F.col("term") == term))
    found = postings.where(wanted & (F.col("field") == field))
    statistics = found.groupBy("term").agg(idf(F.lit(texts), F.count("*")).alias("idf"))
    weighed = found.join(F.broadcast(statistics), "term")  # a row for each term of the query
    return weighed.groupBy(F.col("chunk_id").alias("id")).agg(F.round(F.sum(F.col("idf") * saturation(F.col("tf"), F.col("doc_len"), k1, b, average)), DIGITS).alias("score"))


def stored_top(postings: DataFrame, field: str, texts: int, query: str, k: int, english: bool = False) -> DataFrame:
    """The k best (id, score, rank) of filed postings, as top() of stored_scores() has them, without scoring the rows that can't be among them."""
    asked = query_terms(query, english)
    here = reduce(lambda x, term: x | (F.col("bucket") == bucket_of(F.lit(term))), asked, F.lit(False))  # folded, so a scan skips the other folders
    return top(sparse_index.best(postings.where(here & (F.col("field") == field)), asked, texts, k, DIGITS), k)


def dense_scores(df: DataFrame, id: str, vector: str, query: Column) -> DataFrame:
    """id and cosine similarity with query, a literal array or a scalar subquery's column."""
    return df.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.round(cosine(F.col(vector), query), DIGITS).alias("score")).where("score IS NOT NULL")


def vector_literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def fuse(branches: list[DataFrame], k: int, limit: int, threshold: float = 0.0) -> DataFrame:
    """id and score: summed reciprocal ranks, at least threshold, the limit best. branches: id, rank."""
    both = branches[0].select("id", "rank")
    for other in branches[1:]:
        both = both.unionByName(other.select("id", "rank"))
    fused = both.groupBy("id").agg(F.round(F.sum(reciprocal_rank(F.col("rank"), k)), DIGITS).alias("score"))
    return fused.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(limit)


def check_arguments(query: str, top_k: int, threshold: float, hops: int | None) -> None:
    if not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= top_k <= MAX_RESULTS:
        raise ValueError(f"top_k must be from 1 to {MAX_RESULTS}")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be from 0 to 1")
    if hops is not None and hops < 1:
        raise ValueError("hops must be 1 or more")


def hybrid(points: DataFrame, query: str, query_vector: list[float], limit: int, threshold: float = 0.0, docs: bool = False, rrf_k: int = RRF_K, postings: DataFrame | None = None, texts: dict[str, int] | None = None, english: bool = False) -> DataFrame:
    """id, score over points (id, content, code[, doc, doc_vec]): two branches, four with docs. With filed postings and the number of texts by field, words (english: their stems) are looked up there."""
    literal = vector_literal(query_vector)
    words = lambda field: top(bm25_scores(points, "id", field, query), limit) if postings is None or texts is None else stored_top(postings, field, texts[field], query, limit, english)
    branches = [top(dense_scores(points, "id", "code", literal), limit), words("content")]
    if docs:
        branches += [top(dense_scores(points, "id", "doc_vec", literal), limit), words("doc")]
    return fuse(branches, rrf_k, limit, threshold)


def results(ranked: DataFrame, points: DataFrame) -> DataFrame:
    """SEARCH_RESULT rows (with id): the payload is fetched for the ranked rows only; what is missing has a default."""
    payload = {"content": F.lit(""), "relative_path": F.lit(""), "start_line": F.lit(0), "end_line": F.lit(0), "language": F.lit("unknown")}
    joined = points.join(F.broadcast(ranked), "id")  # MAX_RESULTS rows at most
    doc = F.col("doc") if "doc" in points.columns else F.lit(None).cast("string")
    return joined.select("id", *(F.coalesce(F.col(c), d).alias(c) for c, d in payload.items()), doc.alias("doc"), "score")

