import random

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.text import id_path, is_doc_block, doc_text, split_lines, strip
from lodeseek.operators import chunking
from lodeseek.schemas import CHUNK

TEXT = "aaaa\nbbbb\ncccc\n\ndddd"


def pack(text, size):
    """Blocks of whole lines, in plain Python."""
    lines, out, held, first = text.split("\n"), [], [], 0
    length = lambda some, last: sum(map(len, some)) + len(some) - last
    for i, line in enumerate(lines):
        last = i == len(lines) - 1
        if length(held, 0) + len(line) + (not last) > size and "".join(held).strip():
            out.append((" ".join([]) or "\n".join(held).strip(), first + 1, i))
            held, first = [], i
        held.append(line)
    if "\n".join(held).strip():
        out.append(("\n".join(held).strip(), first + 1, len(lines)))
    return out


def packed(spark, text, size):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r.content, r.start_line, r.end_line) for r in chunking.packed(df, ["id"], "text", size).orderBy("part_index").collect()]


def test_worked_case(spark):
    assert packed(spark, TEXT, 10) == [("aaaa\nbbbb", 1, 2), ("cccc\n\ndddd", 3, 5)]
    assert packed(spark, "x" * 50, 10) == [("x" * 50, 1, 1)]
    assert packed(spark, " \n\t\n", 10) == [] == packed(spark, "", 10)


def test_random_texts(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["", " ", "a" * rng.randint(1, 30), "é😀 " * rng.randint(1, 5)]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {}
    for r in chunking.packed(df, ["id"], "text", 40).orderBy("id", "part_index").collect():
        found.setdefault(r.id, []).append((r.content, r.start_line, r.end_line))
    for i, text in enumerate(texts):
        assert found.get(i, []) == pack(text, 40), repr(text)


def test_overlap_and_lines_of_a_chunk(spark):
    chunk = ("whole", TEXT, 101, 105, "python", "a.py", None, "up", "function_definition", "k", 0, "parsed")
    got = chunking.refined(spark.createDataFrame([chunk], CHUNK), 10, 4).orderBy("part_index").collect()
    assert [(r.content, r.start_line, r.end_line) for r in got] == [("aaaa\nbbbb", 101, 102), ("bbbb\ncccc\n\ndddd", 102, 105)]
    assert len({r.id for r in got}) == 2 and {r.parent_chunk_id for r in got} == {"up"}
    edges = chunking.continues_edges(chunking.refined(spark.createDataFrame([chunk], CHUNK), 10, 4)).collect()
    assert [(e.source_id, e.target_id) for e in edges] == [(got[0].id, got[1].id)]


def test_occurrence_names(spark):
    rows = [("f", "function"), ("f", "function"), ("g", "function"), (None, "arrow"), (None, "arrow")]
    df = spark.createDataFrame([(0, i, n, t) for i, (n, t) in enumerate(rows)], "parent int, at int, name string, type string")
    named = chunking.occurrence_names(df, ["parent"], "name", "type", ["at"]).orderBy("at").collect()
    assert [r.identifier for r in named] == ["f", "f#1", "g", "arrow@0", "arrow@1"]


@pytest.mark.parametrize(("path", "expected"), [("src/a.py", "src/a.py"), ("C:/x/a.py", "x/a.py"), ("../a.py", "a.py"), (".env.py", "env.py"), ("/", "."), ("a:/b:/c", "b:/c")])
def test_id_path(spark, path, expected):
    assert spark.range(1).select(id_path(F.lit(path))).head()[0] == expected


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb", "a\x0bb\x0cc\x1cd\x85e f\n\n", "\n"])
def test_split_lines_as_python_does(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t"))).head()[0] == text.splitlines()


def test_strip_unicode(spark):
    text = " 　\x1c\x85 a b \x1f\n"
    assert spark.createDataFrame([(text,)], "t string").select(strip(F.col("t"))).head()[0] == text.strip()


@pytest.mark.parametrize(("comment", "doc", "is_doc"), [("/** Foo\n * bar\n */", "Foo\nbar", True), ("// a\n// b", "a\nb", True), ("# a", "a", False), ("/*x*/", "x", False), ("/// a", "a", True), ("## a", "a", True)])
def test_docs(spark, comment, doc, is_doc):
    got = spark.createDataFrame([(comment,)], "t string").select(doc_text(F.col("t")), is_doc_block(F.col("t"))).head()
    assert tuple(got) == (doc, is_doc)
