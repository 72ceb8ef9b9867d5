"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the quick brown fox jumps over the lazy dog and runs away from it " * 4000


def documents(spark, rows=(), extra=True):
    """(doc_id, text[, lang[, source]]) as documents, with columns that operators might name themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    return df.withColumns({c: F.lit("clash") for c in ("key", "tid", "n_tokens", "words", "w", "score", "kept", "_text", "row", "epoch", "domain", "ids", "e", "template")}) if extra else df


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "?!"), (5, "one"), (6, LONG), (7, "same text twice over again"), (7, "same text twice over again"), (8, "é😀 ñandú straße\x00x"), (None, "no id at all here"), (9, "a\r\n\x0b\x0cb\x85c d")]
