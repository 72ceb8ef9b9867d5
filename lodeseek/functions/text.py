"""Text, path and document expressions. Lengths are in code points, as Spark counts them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, written out so that every engine agrees on it.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Where lines end besides \n, and \r\n as one end.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines(text: Column) -> Column:
    """Split at \\n only; empty lines stay."""
    return F.split(text, "\n", -1)


def split_lines(text: Column) -> Column:
    """Split at every Unicode line end; no empty line after the last end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


#: Rows in a batch of whole texts that goes to a Python worker: both sides hold a batch, whatever the table's size.
TEXT_ROWS = 512


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with batches of TEXT_ROWS rows to Python workers set for its session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def suffix(text: Column, n: int) -> Column:
    """The last n code points."""
    return F.right(text, F.lit(n)) if n > 0 else F.lit("")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end - 1 of the text's UTF-8, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def as_text(content: Column) -> Column:
    """Strict UTF-8 with universal newlines; null where the bytes aren't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n"))


# --- paths ---------------------------------------------------------------------------------------


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_hidden(path: Column) -> Column:
    """Some component starts with a dot."""
    return path.rlike(r"(^|/)\.")


def ancestors(path: Column) -> Column:
    """a/b/c -> ["", "a", "a/b"]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def id_path(path: Column) -> Column:
    """The path as ids use it: nothing up to the first ":/", no leading dots and slashes, "." if nothing is left."""
    rest = F.regexp_replace(F.regexp_replace(path, r"^(?:(?!:/)(?s:.))*:/", ""), r"^[./]+", "")
    return F.when(rest == "", ".").otherwise(rest)


def glob_regex(glob: str) -> str:
    """A case-sensitive glob as a regular expression for whole strings: * and ? also match /, [seq] and [!seq] are sets."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            inside = glob[i:end]
            out += "[" + ("^" if inside[0] == "!" else "") + re.sub(r"([\\\[\]^&~])", r"\\\1", inside.lstrip("!") if inside[0] == "!" else inside) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"^(?s:{out})$"


# --- documentation comments ----------------------------------------------------------------------

_DOC_OPEN = r"^/\*[*!]*"


def doc_lines(text: Column) -> Column:
    """Comment text without its marks: openers, closers and line prefixes go, the lines stay."""
    opened = lambda s: F.regexp_replace(s, _DOC_OPEN, "")
    closed = lambda s: F.regexp_replace(s, r"\s*\*/$", "")
    bare = lambda s: F.regexp_replace(s, r"^(?:///|//!|//|\*|##|#)\s*", "")
    stripped = F.transform(split_lines(text), strip)
    kept = F.filter(stripped, lambda s: ~s.rlike(r"^/\*[*!]*\s*$") & ~s.rlike(r"^\*/$"))
    return F.transform(kept, lambda s: bare(strip(closed(F.when(s.rlike(r"^/\*"), strip(opened(s))).otherwise(s)))))


def doc_text(text: Column) -> Column:
    """doc_lines joined; the text itself where nothing is left."""
    cleaned = strip(F.array_join(doc_lines(text), "\n"))
    return F.when(cleaned == "", text).otherwise(cleaned)


def is_doc_block(text: Column) -> Column:
    """A documentation mark on some line, or at least two lines of line comments."""
    stripped = F.transform(split_lines(text), strip)
    marked = F.exists(stripped, lambda s: s.rlike(r"^(?:/\*\*|/\*!|///|//!|##)"))
    return marked | (F.size(F.filter(stripped, lambda s: s.rlike(r"^(?://|#)"))) >= 2)
