"""License scans by diagonal voting.

Every word position of every text gives a rolling hash of its k-gram; Spark joins these to the
positions of the same hash in the templates (a small table of fixed size). A hit votes for the
diagonal "text position minus template position". Votes are summed by diagonal, and diagonals that lie
next to each other (words inserted or left out) are merged. A merged span is verified: its hits are
aligned with the template, in order and from diagonal to neighbouring diagonal. The best alignment
covers most template words, each once and less the words inserted between them; its share of the template's
words must reach MIN_COVER. Of spans with different labels that lie on one another by more than half of the shorter, only
the best stays (cover, then the longer template), so that a licence isn't told as its sibling. Base phrases
are templates whose every k-gram must lie on one diagonal, so each such diagonal is a place; they don't compete.

Defined results: a null text counts as empty: no words, no places, null first and last word, empty
labels, score 0. Texts of any length are read whole. Rows that repeat (same id and text) each get
the same result; rows with one id and different texts are told apart by the text's hash. An empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeseek.llm.common import mapped, table

#: What lies between words; words are runs of digits, letters and anything beyond ASCII, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: k of a phrase's and of a text template's k-grams.
PHRASE_K, TEXT_K = 2, 4
#: Most words inserted or left out between two diagonals that are merged.
DIAGONAL_GAP = 4
#: Least share of a template's words in a span.
MIN_COVER = 0.6

# The phrases of the base and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public licence wording that the method recognises by itself.
LICENSE_TEXTS = {
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# The elements of Creative Commons licences, short and long, and which of them go together.
CC_ELEMENTS = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
CC_KINDS = ("", "sa", "nd", "nc", "nc sa", "nc nd")


def creative_commons() -> dict[str, str]:
    """Wording -> label of every kind, in the short and the long form."""
    out = {}
    for kind in CC_KINDS:
        parts = kind.split()
        label = "-".join(["cc-by", *parts])
        out[" ".join(["licensed under cc by", *parts, "4 0"])] = label
        out[" ".join(["this work is licensed under a creative commons attribution", *(CC_ELEMENTS[x] for x in parts), "4 0 international license"])] = label
    return out


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    base: bool

    @property
    def k(self) -> int:
        return PHRASE_K if self.base else TEXT_K

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


def templates(phrases: dict[str, str], texts: dict[str, str], forms: dict[str, str] | None = None) -> list[Template]:
    """Of phrases (wording -> label), texts (label -> wording) and forms (wording -> label, where a label has several)."""
    rows = [(label, tuple(p.split()), True) for p, label in phrases.items()] + [(label, tuple(t.split()), False) for label, t in texts.items()]
    rows += [(label, tuple(t.split()), False) for t, label in (forms or {}).items()]
    out = [Template(i, *row) for i, row in enumerate(rows)]
    if short := [t.words for t in out if t.grams < 1]:
        raise ValueError(f"templates shorter than their k: {short}")
    return out


def words(text: Column) -> Column:
    """The text's words. lower() makes the Kelvin sign an ASCII k, and A-Z only are to be lower-cased, so another letter replaces it."""
    lowered = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _template_positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """A row for each template and position: the hash of the first two words, and the k-gram's words."""
    rows = [(t.number, i, t.k, *t.words[i : i + 2], *(t.words[i + 2 : i + 4] if t.k == TEXT_K else (None, None))) for t in known for i in range(t.grams)]
    listed = spark.createDataFrame(rows, "template int, at int, k int, a string, b string, c string, d string")
    return listed.withColumn("h", F.xxhash64("a", "b"))


def votes(df: DataFrame, key: str, text: str, known: list[Template]) -> DataFrame:
    """key, text_hash, template, diagonal, at: on each diagonal the template positions, ascending, of its distinct k-grams."""
    listed = F.broadcast(_template_positions(df.sparkSession, known))  # a few hundred rows, whatever the input
    worded = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w"))
    grams = worded.where(F.size("w") >= PHRASE_K).selectExpr(
        "key", "text_hash", "posexplode(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)), slice(w, 4, size(w)))) AS (at_word, g)"
    ).selectExpr("key", "text_hash", "at_word", "g.w AS x", "g.`1` AS y", "g.`2` AS z", "g.`3` AS u").where("y IS NOT NULL")
    same = (F.xxhash64("x", "y") == F.col("h")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")) & ((F.col("k") == PHRASE_K) | ((F.col("z") == F.col("c")) & (F.col("u") == F.col("d"))))
    hits = grams.join(listed, same).select("key", "text_hash", "template", (F.col("at_word") - F.col("at")).alias("diagonal"), "at")
    by = ["key", "text_hash", "template", "diagonal"]
    return hits.groupBy(*by).agg(F.sort_array(F.collect_set("at")).alias("at"))  # as many as the template has, at most


def aligned(hits: list[tuple[int, int]], k: int) -> tuple[int, int, int]:
    """The most template words that hits (diagonal, template position) cover in order, each once, less the words inserted between them, and the text positions where that begins and ends.

    A hit may follow another if it lies further on in text and template, on the same diagonal or one
    no more than DIAGONAL_GAP away; each step to a later diagonal is an inserted word. Ties go to the later begin, then to the earlier end.
    """
    spots = sorted((diagonal + at, at) for diagonal, at in hits)
    by_at: dict[int, list[tuple[int, int, int]]] = {}  # template position -> text position, words, begin of the best alignment that ends there
    best = (0, 0, 0)
    for word, at in spots:
        covered, begin = k, word
        for before, ends in by_at.items():
            if before >= at:
                continue
            for w, n, first in reversed(ends):
                step = (word - at) - (w - before)
                if step > DIAGONAL_GAP:
                    break
                if w < word and step >= -DIAGONAL_GAP:
                    n += min(k, at - before, word - w) - max(0, step)
                    covered, begin = max((covered, begin), (n, first))
        by_at.setdefault(at, []).append((word, covered, begin))
        best = max(best, (covered, begin, -word))
    return best[0], best[1], k - best[2]


def spans(df: DataFrame, key: str, text: str, known: list[Template]) -> DataFrame:
    """Verified spans: key, text_hash, template, label, base, start (word), cover (share of the template's words, less inserted ones)."""
    facts = df.sparkSession.createDataFrame([(t.number, t.label, t.base, t.k, t.grams, len(t.words)) for t in known], "template int, label string, base boolean, k int, all_grams int, all_words int")
    voted = votes(df, key, text, known).join(F.broadcast(facts), "template")
    named = ["key", "text_hash", "template", "label"]
    places = voted.where(F.col("base") & (F.size("at") == F.col("all_grams"))).select(*named, "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("cover"))
    # A window holds one text's diagonals of one template, and so no more than that text's words.
    along = Window.partitionBy("key", "text_hash", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > DIAGONAL_GAP
    grouped = voted.where("NOT base").withColumn("apart", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("span", F.sum("apart").over(along))
    merged = grouped.groupBy(*named, "k", "all_words", "span").agg(F.collect_list(F.struct("diagonal", "at")).alias("lines"))
    positions = F.size(F.array_distinct(F.flatten("lines.at")))
    merged = merged.where(F.col("k") * positions >= MIN_COVER * F.col("all_words"))  # fewer can't cover enough

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, covers = [], [], []
            for k, all_words, lines in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                n, start, end = aligned([(x["diagonal"], at) for x in lines for at in x["at"]], k)
                starts.append(start)
                ends.append(end)
                covers.append(n / all_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(covers, pa.float64())], names=["named", "all_words", "start", "end", "cover"])

    asked = merged.select(F.struct(*named).alias("named"), "k", "all_words", "lines")
    judged = mapped(asked, verify, StructType([asked.schema["named"], *StructType.fromDDL("all_words int, start int, end int, cover double").fields])).where(F.col("cover") >= MIN_COVER)
    # A span's inserted words are fewer than its template's, so those that lie on it begin within twice the longest template; few do.
    reach = 2 * max((len(t.words) for t in known), default=0)
    near = Window.partitionBy("key", "text_hash").orderBy("start").rangeBetween(-reach, reach)
    mine = ("label", "start", "end", "cover", "all_words")
    rivals = judged.select("named.*", *mine[1:]).withColumn("rivals", F.collect_list(F.struct(*mine)).over(near))

    def beats(x: Column) -> Column:
        common = F.least(x["end"], F.col("end")) - F.greatest(x["start"], F.col("start"))
        better = F.struct(x["cover"], x["all_words"], x["label"]) > F.struct("cover", "all_words", "label")
        return (x["label"] != F.col("label")) & (2 * common > F.least(x["end"] - x["start"], F.col("end") - F.col("start"))) & better

    stay = rivals.where(~F.exists("rivals", beats))
    return places.unionByName(stay.select(*named, F.lit(False).alias("base"), "start", "cover"))


def scan(df: DataFrame, key: str, text: str, phrases: dict[str, str] | None = None, texts: dict[str, str] | None = None, forms: dict[str, str] | None = None) -> DataFrame:
    """Per row of df: key, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover). With texts of one's own, forms have to be given too."""
    if forms is None:
        forms = creative_commons() if texts is None else {}
    known = templates(BASE_PHRASES if phrases is None else phrases, LICENSE_TEXTS if texts is None else texts, forms)
    base = F.col("base")
    listed = lambda kept: F.array_join(F.array_sort(F.collect_set(kept)), ",")  # noqa: E731  at most a label for each template
    found = spans(df, key, text, known).groupBy("key", "text_hash").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("cover").alias("score"),
    )
    rows = df.select(F.col(key).alias("doc_key"), F.xxhash64(text).alias("doc_hash"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("doc_key").eqNullSafe(F.col("key")) & (F.col("doc_hash") == F.col("text_hash")), "left")
    return joined.select(
        F.col("doc_key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every document."""
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")
