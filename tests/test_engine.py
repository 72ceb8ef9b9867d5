import io
import json
import os
import subprocess
import sys
import time

import pytest

from lodeseek import cli
from lodeseek.operators import parsing
from lodeseek.plans import fixtures
from lodeseek.plans.engine import Engine, Settings
from lodeseek.plans.services import RateLimited, with_retries
from lodeseek.sources import sinks
from lodeseek.streaming import incremental
from tests.conftest import SMALL

STORE = '''"""Module."""
import json as j
from os import path as p


class Shop:
    """Sells things."""

    def sell(self, item):
        """Sell one item."""
        self.log(item)
        return helper(item)

    def log(self, item):
        print(item)


## Sums two numbers.
def helper(x):
    return j.dumps(x)


def helper(y):
    return Shop().sell(y)
'''


def test_python_chunks(spark):
    files = spark.createDataFrame([("m.py", STORE), ("bad.py", "def (:\n"), ("c.c", "int a;\n"), ("n.txt", "x"), ("e.py", ""), ("null.py", None)], "path string, content string")
    rows = parsing.parsed(files).persist()
    cut = {(r.file_path, r.node_type, r.start_line): r for r in parsing.chunks(files, 2500, 300, rows).collect()}
    assert {k for k in cut if k[0] == "m.py"} == {("m.py", "class_definition", 6), ("m.py", "function_definition", 9), ("m.py", "function_definition", 14), ("m.py", "function_definition", 19), ("m.py", "function_definition", 23)}
    shop, sell = cut["m.py", "class_definition", 6], cut["m.py", "function_definition", 9]
    assert shop.doc == "Sells things." and "Sells things" not in shop.content and sell.parent_chunk_id == shop.id
    assert cut["m.py", "function_definition", 19].doc == "Sums two numbers."
    assert len({r.id for r in cut.values()}) == len(cut)
    assert cut["bad.py", None, 1].parse_status == "whole, 1 lost" and cut["c.c", None, 1].parse_status == "text"
    assert cut["e.py", None, 1].content == "" and not [k for k in cut if k[0] in ("n.txt", "null.py")]
    asked = {(r.name, r.kind, r.owner) for r in parsing.candidates(rows).collect() if r.chunk_id == sell.id}
    assert ("log", "call", "Shop") in asked and ("helper", "call", None) in asked and not [a for a in asked if a[0] == "item"]


def test_decorated_definitions_are_two_chunks(spark):
    files = spark.createDataFrame([("d.py", "@wrap\ndef f():\n    pass\n")], "path string, content string")
    got = {r.node_type: r for r in parsing.chunks(files, 2500, 300).collect()}
    assert got["function_definition"].parent_chunk_id == got["decorated_definition"].id and got["decorated_definition"].content.startswith("@wrap")


def test_xxh3_ids_agree(spark):
    import xxhash

    from lodeseek.plans.catalogue import PATH

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", f"{PATH} AS path").limit(20).collect()
    found = {r.doc_id: r.id for r in fixtures.xxh3_ids(spark, SMALL).collect()}
    for d in docs:
        assert found[d.doc_id] == xxhash.xxh3_128_hexdigest(f"{d.path}\x1ftext\x1f\x1fwhole")


def engine(spark, root, **settings):
    return Engine(spark, str(root), Settings(**({"vector_size": 64} | settings)))


def test_index_search_drop(spark, tmp_path):
    code, root = tmp_path / "code", tmp_path / "store"
    (code / "sub").mkdir(parents=True)
    (code / "shop.py").write_text(STORE)
    (code / "sub" / "user.py").write_text("def buy(x):\n    return Shop.sell(x)\n")
    (code / "bytes.py").write_bytes(b"\xff\xfe")
    e = engine(spark, root)
    with pytest.raises(RuntimeError):
        e.search(str(code), "sell")
    assert e.index(str(code)) == {"added": 3}
    assert e.index(str(code)) == {}
    best = e.search(str(code), "sell one item", 3)
    first = best.head()
    assert first.relative_path == "shop.py" and "sell" in first.content
    assert json.loads(sinks.json_text(best))["total"] == best.count() and "shop.py" in sinks.plain_text(best)
    edges = {r.edge_type for r in e.edges(str(code)).collect()}
    assert edges == {"PARENT_OF", "CALLS", "USES"}
    out = io.StringIO()
    cli.serve(e, io.StringIO(json.dumps({"query": "sell", "path": str(code), "limit": 2}) + '\n\n{"query": " "}\n[\n'), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert answers[0]["total"] == 2 and [set(a) for a in answers[1:]] == [{"error"}, {"error"}]
    wider = e.search(str(code), "buy", 1, max_graph_hops=2).collect()
    assert len(wider) > 1 and wider[0].score > 0 and wider[-1].score == 0
    os.rename(code / "sub" / "user.py", code / "moved.py")
    (code / "shop.py").write_text(STORE.replace("Sell one item", "Trade one item"))
    assert e.index(str(code)) == {"modified": 1, "renamed": 1}
    held = e.store.read(e.collection(str(code)), "points")
    assert {r.relative_path for r in held.select("relative_path").distinct().collect()} == {"shop.py", "moved.py"}
    (code / "shop.py").unlink()
    assert e.index(str(code)) == {"removed": 1}
    os.utime(code / "moved.py", (time.time() + 9, time.time() + 9))
    assert e.index(str(code)) == {} and e.drop(str(code)) and not e.drop(str(code))


def tables(e, code):
    """All tables of a collection without times and embeddings' order."""
    name = e.collection(str(code))
    read = lambda table, *columns: sorted(map(str, e.store.read(name, table).select(*columns).collect()))
    return {
        "points": read("points", "id", "content", "start_line", "end_line", "language", "file_path", "relative_path", "doc", "parent_chunk_id", "node_key", "part_index", "code", "doc_vec"),
        "nodes": read("nodes", "id", "content", "relative_path", "start_line", "end_line", "doc"), "edges": sorted(map(str, e.edges(str(code)).collect())), "filed edges": read("edges", "source_id", "target_id", "edge_type"),
        "candidates": read("candidates", "*"), "definitions": read("definitions", "*"), "postings": read("postings", "*"), "snapshot": read("snapshot", "path", "size", "hash"), "texts": [e.store.facts(name)["texts"]],
    }


def test_incremental_index_equals_a_fresh_one(spark, tmp_path):
    """After edits, renames, files made anew under an old name and deletions every table is what a fresh index gives."""
    code = tmp_path / "code"
    code.mkdir()
    asked = []
    e = Engine(spark, str(tmp_path / "store"), Settings(vector_size=16, explanation=True, chunk_size=100, chunk_overlap=10), explain=lambda text: asked.append(1) or f"says {len(text)}")
    write = lambda name, text: (code / name).write_text(text)
    big = "def long(x):\n" + "".join(f"    y{i} = bar(x)\n" for i in range(12))

    def first():
        write("a.py", "def foo(x):\n    return bar(x)\n")
        write("c.py", "def bar(x):\n    return x\n")
        write("d.js", "function baz(q) { return qux(q); }\n")
        write("e.js", "class K { run(a) { return baz(a); } }\nfunction qux(w) { return w; }\n")

    steps = [
        (first, {"added": 4}),
        (lambda: write("c.py", "def bar(x):\n    return x + 1\n"), {"modified": 1}),
        (lambda: os.rename(code / "a.py", code / "b.py"), {"renamed": 1}),
        (lambda: (write("a.py", "def foo(x):\n    return bar(bar(x))\n"), write("c.py", big + "\ndef bar(x):\n    return long(x)\n")), {"added": 1, "modified": 1}),
        (lambda: ((code / "e.js").unlink(), os.rename(code / "d.js", code / "f.js")), {"removed": 1, "renamed": 1}),
    ]
    for n, (change, counts) in enumerate(steps):
        change()
        assert e.index(str(code)) == counts
        again = Engine(spark, str(tmp_path / f"fresh{n}"), e.settings, explain=e.explain)
        again.index(str(code))
        mine, theirs = tables(e, code), tables(again, code)
        for table in mine:
            assert mine[table] == theirs[table], (n, table)
    assert any("CALLS" in x for x in mine["edges"]) and any("CONTINUES" in x for x in mine["edges"])
    left = [p.name for p in (tmp_path / "store" / e.collection(str(code))).iterdir() if "staging" in p.name]
    assert not left


def test_search_reads_postings_and_agrees_with_texts(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    (code / "shop.py").write_text(STORE)
    e = engine(spark, tmp_path / "store")
    e.index(str(code))
    from lodeseek.operators import search

    name = e.collection(str(code))
    held, postings, texts = e.store.read(name, "points"), e.store.read(name, "postings"), e.store.facts(name)["texts"]
    for field in ("content", "doc"):
        want = search.bm25_scores(held, "id", field, "sell one item numbers").collect()
        assert want and sorted(search.stored_scores(postings, field, texts[field], "sell one item numbers").collect()) == sorted(want)
    plan = search.stored_scores(postings, "content", texts["content"], "sell")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_the_version_before_can_still_be_read(spark, tmp_path):
    e = engine(spark, tmp_path / "store")
    e.store.create("c", {"docs": False})
    rows = lambda *paths: spark.createDataFrame([(p, 1, 0.0, 1, "h") for p in paths], "path string, size bigint, mtime double, inode bigint, hash string")
    e.store.commit("c", {"snapshot": rows("a")})
    old = e.store.read("c", "snapshot")
    e.store.commit("c", {"snapshot": rows("a", "b")})
    assert old.count() == 1 and e.store.read("c", "snapshot").count() == 2


def test_scan_deals_one_large_directory(spark, tmp_path):
    from lodeseek.sources import files

    for i in range(30):
        (tmp_path / "src" / f"d{i}").mkdir(parents=True)
        (tmp_path / "src" / f"d{i}" / "x.py").write_text("x")
    assert len(files.FilesReader({"path": str(tmp_path)}).partitions()) > 30 and files.scan(spark, str(tmp_path)).count() == 30
    paths = files.scan(spark, str(tmp_path)).where("path LIKE '%d1/%'")
    assert [bytes(r.content) for r in files.contents(str(tmp_path), paths).collect()] == [b"x"]


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    e = engine(spark, tmp_path / "store")
    e.store.create("c", {"docs": False})
    good = spark.createDataFrame([("a", 1, 0.0, 1, "h")], "path string, size bigint, mtime double, inode bigint, hash string")
    e.store.commit("c", {"snapshot": good})
    bad = good.selectExpr("path", "size", "mtime", "inode", "raise_error('no') AS hash")
    with pytest.raises(Exception):  # noqa: B017
        e.store.commit("c", {"snapshot": bad})
    assert e.store.read("c", "snapshot").count() == 1


def test_settings_are_checked():
    for bad in ({"chunk_size": 15}, {"chunk_overlap": 5000}, {"vector_size": 7}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings(docs=False, explanation=True).doc_index and Settings(docs=True).doc_index and not Settings(docs=False).doc_index


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RateLimited
        return "ok"

    assert with_retries(call, sleep=waits.append) == "ok" and waits == [5.0, 10.0]
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), sleep=waits.append)


def test_stream_of_changes(spark, tmp_path):
    feed, e = tmp_path / "feed", engine(spark, tmp_path / "store")
    schema = "path string, content string, deleted boolean, sequence bigint"
    stream = lambda: spark.readStream.schema(schema).parquet(str(feed))

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
        q = incremental.start(e, "live", stream(), str(tmp_path / "marks"))
        q.processAllAvailable()
        q.stop()
        return sorted(r.relative_path for r in e.store.read("live", "points").collect())

    assert push([("a.py", "def a():\n    pass\n", False, 1), ("b.py", "def b():\n    pass\n", False, 2)]) == ["a.py", "b.py"]
    assert push([("a.py", None, True, 3), ("b.py", "def c():\n    pass\n", False, 4)]) == ["b.py"]
    assert e.store.read("live", "points").head().content.startswith("def c") and [r.path for r in e.store.read("live", "snapshot").collect()] == ["b.py"]
    assert {r.relative_path for r in e.store.read("live", "nodes").collect()} == {"b.py"} == {r.relative_path for r in e.store.read("live", "postings").collect()}


def test_windowed_counts(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert incremental.counts(events, "ts", ["event_type"], "1 day", "1 hour").groupBy().sum("n").head()[0] == events.count()


def test_entry_without_the_training_data_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, '.'); sys.modules['corpus_pipeline'] = None\n"
        "import importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('lodeseek.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name=name)\n"
        "del sys.modules['corpus_pipeline']; sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "score", "chunks"] and entry.entry(spark).count() > 0
