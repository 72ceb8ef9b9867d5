import json
import os
import re

import numpy as np

from lodeseek.plans import catalogue, fixtures
from tests.conftest import SMALL


def test_every_document_asks_for_references(spark, tmp_path):
    rows = [(i, f"{first} and {other} {first}", lang, source) for i, (first, other, lang, source) in enumerate([("orchard", "lantern", "en", "a"), ("lantern", "orchard", "en", "b"), ("lantern", "harvest", "en", "a"), ("harvest", "lantern", "de", "b"), ("harvest", "orchard", "en", "b"), ("orchard", "harvest", "en", "c"), ("harvest", "lantern", "en", "d"), ("short", "tiny", "en", "e")])]
    rows.append((8, None, "en", "f"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: re.findall("[a-z]{6,}", (text or "").lower()) for i, text, _, _ in rows}
    owner = lambda i: "AB"[i % 3] if i % 3 < 2 else None
    expected = {
        (f"d{i}", f"d{j}", "USES" if i % 2 else "CALLS")
        for i, _, lang, source in rows for j, _, other, place in rows
        if i != j and lang == other and source != place and words[j] and words[j][0] in words[i] and (not owner(i) or not owner(j) or owner(i) == owner(j))
    }
    found = [tuple(r) for r in catalogue.symbol_reference_join(spark, str(tmp_path)).select("source_id", "target_id", "edge_type").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert any(int(a[1:]) % 5 for a, _, _ in found)


def test_files_hold_whole_turns(spark, tmp_path):
    long = "\n".join(f"line {i}: naïve 😀 x = {{'a': \"b\"}} \\n" for i in range(90))
    texts = ["plain", None, "", long, 'ends in "', "ends in \\", '"""\\"""', "a\rb\r\nc\n", "nul \0 here \\0", "\\N{x} \\u12 \\x", "    indented\n\tтекст"]
    rows = [(i % 2, i, "user", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = fixtures.parse_python_chunks(spark, str(tmp_path)).collect()
    assert {r.parse_status for r in found} == {"parsed"}
    docs = {}
    for path, text in ((f"talk/{i}/t{i}.py", text) for i, _, _, text in rows):
        docs.setdefault(path, set()).add((text or "").strip() or None)
    for path, expected in docs.items():
        assert {r.doc for r in found if r.file_path == path and r.parent_chunk_id} == expected
    parts = [r for r in found if r.file_path == "talk/1/t1.py" and r.node_type == "class_definition"]
    assert len(parts) > 10 and {r.part_index for r in parts} == set(range(len(parts)))
    held = "\n".join(r.content for r in sorted(parts, key=lambda r: r.part_index))
    assert all(line.replace("\\", r"\\").replace('"', r"\"") in held for line in long.split("\n"))
    edges = fixtures.reference_graph(spark, str(tmp_path)).collect()
    assert sum(e.edge_type == "CONTINUES" for e in edges) >= len(parts) - 1
    # Files 1 and 8 call what the other defines, open_1: from each method, and from each part of the class.
    rows += [(8, i, "user", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = fixtures.parse_python_chunks(spark, str(tmp_path)).collect()
    edges = [(e.source_id, e.target_id) for e in fixtures.reference_graph(spark, str(tmp_path)).collect() if e.edge_type == "CALLS"]
    calling = {c: {r.id for r in found if r.file_path == f"talk/{c}/t{c}.py" and not r.content.startswith("def open_")} for c in (1, 8)}
    opened = {c: next(r.id for r in found if r.file_path == f"talk/{c}/t{c}.py" and r.content.startswith("def open_")) for c in (1, 8)}
    assert len(edges) == len(set(edges)) and set(edges) == {(id, opened[9 - c]) for c in (1, 8) for id in calling[c]}


def test_documentation_vectors_are_searched(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").where("embedding IS NOT NULL").collect()}
    held = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    asked = vectors[0]
    score = {i: round(float(v @ asked / np.linalg.norm(v) / np.linalg.norm(asked)), 6) for i, v in vectors.items() if i in held}
    documented = sorted(score, key=lambda i: (-score[i], i))[: catalogue.TOP]
    ranked = {r.id: r["rank"] for r in catalogue.dense_top(spark, SMALL, True).select("id", "rank").collect()}
    assert sorted(ranked, key=ranked.get) == documented


def test_scan_query(spark):
    root = os.path.dirname(os.path.dirname(os.path.abspath(fixtures.__file__)))
    want = {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.endswith(".py") and "__pycache__" not in d}
    got = {r.path: r.size for r in fixtures.file_scan(spark, SMALL).collect()}
    assert got == {p: os.path.getsize(os.path.join(root, p)) for p in want}


def test_broken_files_lose_no_method(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    want = {(r.conv_id, "function_definition", f"turn_{r.turn}") for r in turns} | {(r.conv_id, "class_definition", f"Talk{r.conv_id}") for r in turns} | {(r.conv_id, "function_definition", "heard") for r in turns}
    rows = fixtures.parse_broken_python(spark, SMALL).collect()
    first = [r for r in rows if r.part_index == 0]
    assert sorted((int(re.search(r"\d+", r.file_path)[0]), r.node_type, re.match(r"(?:class|def) (\w+)", r.content)[1]) for r in first) == sorted(want)
    assert {r.parse_status.split(",")[0] for r in rows} == {"parsed"}
    for r in turns:
        text = "\n        ".join(re.split(r"\r\n|\r|\n", r.text or ""))
        parts = sorted((x.part_index, x.content) for x in rows if x.file_path == f"broken/t{r.conv_id}.py" and x.parent_chunk_id)
        assert any(line.strip() in content for line in text.split("\n")[:1] for _, content in parts)


def test_result_json(spark):
    rows = [json.loads(r.json) for r in fixtures.result_json(spark, SMALL).collect()]
    assert len(rows) == catalogue.TOP and all(set(r) == {"content", "doc", "relative_path", "start_line", "end_line", "language", "score"} for r in rows)
