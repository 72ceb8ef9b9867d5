"""The engine: index a codebase, search it, drop it."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE, NO_DOC, RRF_K, VECTOR_SIZE
from lodeseek.functions.ids import collection_name
from lodeseek.operators import chunking, diff, graph, parsing, points, references, search
from lodeseek.plans.services import ANSWER_BUCKETS, Embed, Explain, answer_bucket, answer_key, blank, embedded, explained, hashed_vectors
from lodeseek.sources import files
from lodeseek.sources.store import CONTENT, FILES, Staging, Store


@dataclass
class Settings:
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    vector_size: int = VECTOR_SIZE
    docs: bool = True
    explanation: bool = False
    parallel: int = 1
    within_files: bool = False
    rrf_k: int = RRF_K
    ids: str = "md5"
    #: Words are looked up by their English stems, without stop-words.
    english: bool = False
    ignore: tuple[str, ...] = ()
    #: Names of the models behind the services: another name asks anew.
    embed_model: str = "default"
    explain_model: str = "default"
    #: Calls a second, over all tasks; so many tasks share them.
    rate: float | None = None
    tasks: int = 8
    #: Texts that are asked for before their answers are kept.
    wave: int = 200_000

    def __post_init__(self) -> None:
        if not 0 < self.chunk_size <= 100_000 or self.chunk_size % 10:
            raise ValueError("chunk_size must be a multiple of 10 up to 100000")
        if not 0 <= self.chunk_overlap <= 3_000 or self.chunk_overlap % 10:
            raise ValueError("chunk_overlap must be a multiple of 10 up to 3000")
        if not 0 < self.vector_size <= 2_048 or self.vector_size % 2:
            raise ValueError("vector_size must be even and at most 2048")

    @property
    def doc_index(self) -> bool:
        return self.docs or self.explanation


class Engine:
    """embed and explain stand for services; the defaults need no network."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embed: Embed | None = None, explain: Explain | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()
        self.store = Store(spark, root)
        self.embed, self.explain = embed or hashed_vectors(self.settings.vector_size), explain

    @staticmethod
    def collection(path: str) -> str:
        return collection_name(os.path.realpath(os.path.expanduser(path)))

    def index(self, path: str, force: bool = False) -> dict[str, int]:
        """Bring the collection up to date; counts of changes by kind.

        Files are told apart by their snapshot: those whose metadata changed are hashed, and those
        whose content or path changed are parsed. All tables change together at the end, by rows of
        changed files only.
        """
        name, s = self.collection(path), self.settings
        self.store.create(name, {"path": path, "vector_size": s.vector_size, "docs": s.doc_index, "english": s.english}, force)
        old = self.store.read(name, "snapshot")
        with self.store.staging(name) as stage:
            meta = stage.written(files.scan(self.spark, path, s.ignore))
            new = stage.written(diff.records(meta, old, files.hashes(path, diff.unknown(meta, old))))
            found = stage.written(diff.changes(old, new))
            counts = {r[0]: r[1] for r in found.groupBy("change").count().collect()}  # a row for each kind
            told = stage.written(new.exceptAll(old.select(new.columns)))
            silent = old.select(new.columns).exceptAll(new).select("path").unionByName(told.select("path"))
            if counts:
                # A moved file has new ids, so it is parsed again under its new path.
                moved = found.where(F.col("change") == diff.RENAMED)
                changed = diff.to_add(found).unionByName(moved.select("path"))
                gone = diff.to_remove(found).unionByName(moved.select(F.col("old_path").alias("path")))
                sized = stage.written(changed.join(new.select("path", "size"), "path"))
                self.apply(name, stage, files.texts(files.contents(path, sized)), gone, told, silent)
            elif not told.isEmpty():
                self.store.change(name, {"snapshot": told}, {FILES: silent})  # only metadata changed: keep hashes from being made again
        return counts

    def apply(self, name: str, stage: Staging, changed: DataFrame, gone: DataFrame, told: DataFrame, silent: DataFrame, facts: dict | None = None) -> None:
        """Bring tables up to changed files (path, content), gone paths, and the snapshot's new rows (told) in place of those of silent paths.

        Only rows of changed files are written. What is used more than once is written to the stage
        first, so that plans stay small and the services are asked once. References are kept as
        candidates and definitions, from which a search walks them (references.Symbols): no
        edge of an unchanged file changes here, and names that all files share have no square of edges.
        """
        s = self.settings
        changed = stage.written(changed)
        away = stage.written(gone.select("path").unionByName(changed.select("path")).dropDuplicates())
        rows = stage.written(parsing.parsed(changed, ids=s.ids))
        cut = stage.written(parsing.chunks(changed, s.chunk_size, s.chunk_overlap, rows, s.ids))
        fresh = stage.written(self.points(name, stage, cut))
        asked, known = (stage.written(references.by_parts(x, rows, cut)) for x in (parsing.candidates(rows), parsing.definitions(rows)))
        in_file = cut.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_path"), F.col("file_path").alias("target_path"))
        edges = chunking.continues_edges(cut).unionByName(graph.parent_edges(cut)).join(in_file, "source_id").dropDuplicates()
        held = ["content", "doc"] if s.doc_index else ["content"]
        of_path = fresh.select(F.col("id").alias("chunk_id"), "relative_path")
        made = [search.filed(search.postings(fresh, "id", field, field, self.english(name)).join(of_path, "chunk_id")) for field in held]
        tallies = fresh.groupBy(F.col("relative_path").alias("path")).agg(F.count("content").alias("content"), F.count("doc").alias("doc"))
        out = {"points": fresh, "nodes": fresh, "edges": edges, "candidates": asked, "definitions": known, "postings": reduce(DataFrame.unionByName, made), "tallies": tallies, "snapshot": told}
        self.store.change(name, out, {CONTENT: away, FILES: silent}, facts)

    def points(self, name: str, stage: Staging, chunks: DataFrame) -> DataFrame:
        """Chunks with vectors and payload. A service is asked once for a text, whatever file or version it is in."""
        s, out = self.settings, chunks
        each = s.rate and s.rate / s.tasks
        if s.explanation and self.explain is None:
            out = explained(out, "content", "doc", None)
        elif s.explanation:
            asked = lambda some: explained(some.withColumn("answer", F.lit(None).cast("string")), "text", "answer", self.explain, s.parallel, each).where(F.col("answer") != NO_DOC)
            said = self.answers(name, stage, f"explain {s.explain_model}", out.where(blank(F.col("doc"))).select(F.col("content").alias("text")), "answer", asked)
            keyed = out.withColumn("_key", F.when(blank(F.col("doc")), answer_key(F.col("content"))))
            doc = F.when(F.col("_key").isNull(), F.col("doc")).otherwise(F.coalesce("answer", F.lit(NO_DOC)))
            out = stage.written(keyed.join(said, F.col("_key") == F.col("key"), "left").withColumn("doc", doc).select(*chunks.columns))
        fields = {"code": "content", "doc_vec": "doc"} if s.doc_index else {"code": "content"}
        texts = reduce(DataFrame.unionByName, (out.select(F.col(c).alias("text")) for c in fields.values()))
        said = self.answers(name, stage, f"embed {s.embed_model} {s.vector_size}", texts, "vector", lambda some: embedded(some, "text", "vector", self.embed, rate=each))
        for to, field in fields.items():
            of = said.select(F.col("key").alias("_key"), F.col("vector").alias(to))
            out = out.withColumn("_of", answer_key(F.col(field))).join(of, F.col("_of") == F.col("_key"), "left").drop("_of", "_key")
        if not s.doc_index:
            out = out.withColumn("doc_vec", F.lit(None).cast("array<float>"))
        return out.withColumn("relative_path", F.col("file_path")).withColumn("indexed_at", F.current_timestamp())

    def answers(self, name: str, stage: Staging, kind: str, texts: DataFrame, of: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """key and what a service says (of: vector or answer) of each text (text).

        Only what the collection doesn't know is asked for, each text once. Answers are kept wave by wave,
        apart from the rest of a change: after a failure, what was answered isn't asked for again. They
        are filed by their key, so that a few texts read few folders.
        """
        s = self.settings
        wanted = stage.written(texts.where("text IS NOT NULL").select(answer_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"]).withColumn("bucket", answer_bucket(F.col("key"))))
        buckets = [r[0] for r in wanted.select("bucket").distinct().limit(ANSWER_BUCKETS).collect()]
        known = lambda: self.store.read(name, "answers").where(F.col("bucket").isin(buckets) & (F.col("kind") == kind)).drop("bucket")
        missing = stage.written(wanted.join(known().select("key"), "key", "left_anti"))
        waves = -(-missing.count() // s.wave)
        for i in range(waves):
            some = missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == i)
            said = ask(some.repartition(s.tasks, "key") if s.rate else some)
            other = {"vector": "answer", "answer": "vector"}[of]
            self.store.change(name, {"answers": said.withColumn("kind", F.lit(kind)).withColumn(other, F.lit(None).cast({"answer": "string", "vector": "array<float>"}[other]))})
        return stage.written(known().join(wanted.select("key"), "key", "left_semi").select("key", of))

    def search(self, path: str, query: str, top_k: int = 5, threshold: float = 0.0, max_graph_hops: int | None = None, graph_limit: int | None = None) -> DataFrame:
        """SEARCH_RESULT rows with id, best first. Words are looked up in the stored postings; no text is cut up here."""
        search.check_arguments(query, top_k, threshold, max_graph_hops)
        name = self.collection(path)
        if not self.store.exists(name):
            raise RuntimeError(f"{path} isn't indexed")
        held, facts = self.store.read(name, "points"), self.store.facts(name)
        ranked = search.hybrid(held, query, self.embed([query])[0], top_k, threshold, bool(facts.get("docs")), self.settings.rrf_k, self.store.read(name, "postings"), facts.get("texts"), self.english(name))
        if max_graph_hops:
            ranked = graph.expand(ranked, self.store.read(name, "edges"), max_graph_hops, graph_limit, self.symbols(name))
            return search.results(ranked.select("id", "score"), held).join(F.broadcast(ranked.select("id", "position")), "id").orderBy("position").drop("position")
        return search.results(ranked, held).orderBy(F.desc("score"), "id")

    def english(self, name: str) -> bool:
        """How the collection's words are kept: as it was made, whatever the settings are now."""
        return bool(self.store.facts(name).get("english"))

    def symbols(self, name: str) -> references.Symbols:
        return references.Symbols(self.store.read(name, "candidates"), self.store.read(name, "definitions"), self.settings.within_files)

    def edges(self, path: str) -> DataFrame:
        """All edges of the collection, listed."""
        name = self.collection(path)
        return self.store.read(name, "edges").unionByName(self.symbols(name).edges())

    def drop(self, path: str) -> bool:
        return self.store.drop(self.collection(path))
