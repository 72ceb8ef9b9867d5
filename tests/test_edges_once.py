"""What edges and chunks cost: edges aren't shuffled, files are parsed once."""

import random

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import graph, parsing, references, search, syntax
from lodeseek.plans import catalogue, fixtures
from lodeseek.plans.services import embedded
from tests.conftest import SMALL

CANDIDATE = "chunk_id string, language string, name string, kind string, owner string, file_path string"
DEFINITION = "chunk_id string, language string, name string, owner string, file_path string"


def written_rows(spark, run):
    """Rows that run shuffles."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_listed_edges_are_not_shuffled(spark):
    """Four hundred files that define and use one name: 159,600 edges from 800 rows."""
    known = spark.range(400).selectExpr("concat('k', id) AS chunk_id", "'py' AS language", "'main' AS name", "cast(null AS string) AS owner", "concat('f', id) AS file_path")
    asked = known.selectExpr("chunk_id", "language", "name", "'call' AS kind", "owner", "file_path")
    found = []
    assert written_rows(spark, lambda: found.append(references.reference_edges(asked, known).agg(F.sum(F.length("source_id"))).collect())) < 10_000
    assert found[0][0][0] > 159_600


@pytest.mark.parametrize("within", [False, True])
def test_each_edge_comes_once(spark, within):
    """Chunks with several owners, symbols and files, against plain loops."""
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    asked = [(f"k{rng.randrange(9)}", pick("py", None), pick("a", "b", "", None), pick("call", "identifier"), pick(None, "A", "B"), pick("f", "g", None)) for _ in range(150)]
    known = [(f"k{rng.randrange(12)}", pick("py", None), pick("a", "b", "", None), pick(None, "A", "B"), pick("f", "g", None)) for _ in range(40)]
    wanted = {
        (c[0], d[0], "CALLS" if c[3] == "call" else "USES")
        for c in asked for d in known
        if c[1] and c[1] == d[1] and c[2] and c[2] == d[2] and c[0] != d[0] and (c[4] is None or d[3] is None or c[4] == d[3]) and (within or c[5] and d[4] and c[5] != d[4])
    }
    got = references.reference_edges(spark.createDataFrame(asked, CANDIDATE), spark.createDataFrame(known, DEFINITION), within).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


@pytest.mark.parametrize("within", [False, True])
def test_each_edge_comes_once_if_names_are_dealt(spark, monkeypatch, within):
    for limit, value in (("BLOCK", 3), ("GROUP", 2), ("SOURCES", 8), ("PAIRS", 16), ("SAMPLE", 2)):
        monkeypatch.setattr(references, limit, value)
    test_each_edge_comes_once(spark, within)
    rows = [(f"k{i}", "py", "ab"[i % 9 == 0], (None, "A", "B")[i % 3], f"f{i % 5}") for i in range(120)]
    asked = spark.createDataFrame([(*r[:3], "call", *r[3:]) for r in rows], CANDIDATE)
    wanted = {(c[0], d[0]) for c in rows for d in rows if c[2] == d[2] and c[0] != d[0] and (not c[3] or not d[3] or c[3] == d[3]) and (within or c[4] != d[4])}
    got = references.reference_edges(asked, spark.createDataFrame(rows, DEFINITION), within).collect()
    assert sorted((e.source_id, e.target_id) for e in got) == sorted(wanted)


def test_files_of_edges_are_small(spark, tmp_path):
    """8,000 definitions and 160 chunks that call them: 1,280,000 edges."""
    known = spark.range(8000).selectExpr("concat('k', id) AS chunk_id", "concat('py', id % 1) AS language", "'main' AS name", "cast(null AS string) AS owner", "concat('f', id) AS file_path")
    asked = known.where("file_path < 'f1143'").selectExpr("concat('c', chunk_id) AS chunk_id", "language", "name", "'call' AS kind", "owner", "concat('c', file_path) AS file_path")
    references.reference_edges(asked, known).write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges").count()
    assert edges == asked.count() * 8000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < edges * 0.3


def test_words_of_texts_are_shuffled_once(spark, tmp_path):
    """600 texts of 40 words, each of which begins some text: about 23,000 candidates, of which two thirds have an owner and so two slots."""
    spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 39), j -> concat('harvest', translate(cast((id + j) % 40 AS string), '0123456789', 'abcdefghij'))) ) AS text", "'en' AS lang", "concat('s', id % 20) AS source").write.parquet(f"{tmp_path}/documents.parquet")
    found, held = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    assert written_rows(spark, lambda: found.append(catalogue.symbol_reference_join(spark, str(tmp_path)).agg(F.sum(F.length("source_id"))).collect())) < 60_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert found[0][0][0] > 200_000


def test_files_of_the_graph_are_parsed_once(spark):
    assert "MapInArrow" not in fixtures.reference_graph(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_parsed_once(spark):
    """Chunks of each kind from one pass over the files."""
    files = spark.createDataFrame([(f"f{i}.py", "def f():\n    return 1\n") for i in range(3)] + [("t.txt", "a\n\nb")], "path string, content string")
    plan = parsing.chunks(files, 12, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("language", sorted(syntax.HEADS))
def test_what_declares_nothing_is_not_cut(language):
    assert not syntax.may_declare(language, "plain words, subclassed or prefunctional") and syntax.read(language, "p", "plain words", str) == ([], [], [])
    for head in syntax.HEADS[language]:
        assert syntax.may_declare(language, f"x; {head} A {{}}")
    if language in syntax.METHODS:
        assert syntax.may_declare(language, "a = { b() {} }")
    if language in syntax.ARROWS:
        assert syntax.may_declare(language, "x => x")


@pytest.mark.parametrize("walk", [graph.neighbour_nodes, graph.neighbour_edges, graph.hops])
def test_a_walk_shuffles_no_untouched_edges(spark, walk):
    nodes = spark.range(3000).selectExpr("concat('n', id) AS id").where("id <> 'n5'")
    new = spark.range(2999).selectExpr("concat('n', id) AS source_id", "concat('n', id + 1) AS target_id", "if(id = 2, 'LIKES', 'USES') AS edge_type")
    new, seeds, found = new.unionByName(new), spark.createDataFrame([("n3",), ("n9",), ("n5",), ("zz",)], "id string"), []
    assert written_rows(spark, lambda: found.extend(map(tuple, walk(graph.Upserted(new, nodes), seeds, 2).collect()))) < 500
    assert sorted(found) == sorted(map(tuple, walk(graph.upsert_edges(None, new, nodes), seeds, 2).collect()))


def test_symbols_shuffle_no_untouched_candidates(spark):
    known = spark.range(300).selectExpr("concat('k', id) AS chunk_id", "'py' AS language", "concat('w', id % 7) AS name", "cast(null AS string) AS owner", "concat('f', id) AS file_path")
    asked = known.crossJoin(spark.range(40)).selectExpr("chunk_id", "language", "concat('w', id) AS name", "'call' AS kind", "owner", "file_path")
    seeds, found = spark.createDataFrame([("k1",)], "id string"), []
    assert written_rows(spark, lambda: found.extend(references.Symbols(asked, known).neighbours(seeds).collect())) < 4000
    assert len(found) == 299


def test_batches_of_texts_are_small(spark):
    sizes = spark.range(2000, numPartitions=1).selectExpr("id", "concat('running ', id) AS text")
    for used in (lambda: embedded(sizes, "text", "code", lambda texts: [[float(len(texts))]] * len(texts)), lambda: search.postings(sizes, "id", "text", "text", True)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        used()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
