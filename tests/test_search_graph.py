import random

import pytest

from lodeseek.operators import graph, references, search
from lodeseek.schemas import CANDIDATE, DEFINITION, EDGE


def ranks(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "id string, rank int")


def test_fusion(spark):
    got = search.fuse([ranks(spark, "ABC"), ranks(spark, "BD")], 2, 10, 0.3).collect()
    assert [(r.id, r.score) for r in got] == [("B", 0.833333), ("A", 0.5), ("D", 0.333333)]
    again = search.fuse([ranks(spark, "BD"), ranks(spark, "ABC")], 2, 10, 0.3).collect()
    assert got == again


def test_ties_go_to_the_smaller_id(spark):
    scores = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "id string, score double")
    assert [(r.id, r["rank"]) for r in search.top(scores, 2).orderBy("rank").collect()] == [("c", 0), ("a", 1)]


def test_bm25_without_known_terms(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, None)], "id int, text string")
    assert search.bm25_scores(df, "id", "text", "beta").isEmpty()
    assert search.bm25_scores(df, "id", "text", "!!").isEmpty()


@pytest.mark.parametrize("bad", [(" ", 5, 0.0, None), ("q", 0, 0.0, None), ("q", 51, 0.0, None), ("q", 5, 1.5, None), ("q", 5, 0.0, 0)])
def test_arguments(bad):
    with pytest.raises(ValueError):
        search.check_arguments(*bad)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "USES") for a, b in pairs], EDGE)


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_expansion_case(spark):
    e = edges(spark, ["ab", "cb", "cd"])
    assert {r.id for r in graph.neighbour_nodes(e, ids(spark, "az"), 2).collect()} == {"a", "b", "c"}
    assert {(r.source_id, r.target_id) for r in graph.neighbour_edges(e, ids(spark, "az"), 2).collect()} == {("a", "b"), ("c", "b")}


def test_expansion_against_trails(spark):
    rng = random.Random(3)
    for _ in range(3):
        pairs = list({(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(9)})
        seeds, most = rng.sample("abcdefghz", 2), rng.randint(1, 3)
        nodes, used = set(), set()

        def walk(at, trail):
            for i, (x, y) in enumerate(pairs):
                if i not in trail and at in (x, y) and len(trail) < most:
                    used.add((x, y))
                    nodes.update((x, y))
                    walk(y if at == x else x, [*trail, i])

        for s in seeds:
            walk(s, [])
        e = edges(spark, pairs)
        assert {r.id for r in graph.neighbour_nodes(e, ids(spark, seeds), most).collect()} == nodes
        assert {(r.source_id, r.target_id) for r in graph.neighbour_edges(e, ids(spark, seeds), most).collect()} == used


def test_cap(spark):
    e = edges(spark, ["sa", "sb", "sc", "sd", "se"])
    ranked = spark.createDataFrame([("s", 0.9), ("t", 0.8), ("u", 0.7)], "id string, score double")
    got = graph.expand(ranked, e, 1, 4).orderBy("position").collect()
    assert [(r.id, r.score) for r in got] == [("s", 0.9), ("t", 0.8), ("u", 0.7), ("a", 0.0)]
    assert [r.id for r in graph.expand(ranked, e, 1, 2).orderBy("position").collect()] == ["s", "t"]


def test_upserts(spark):
    nodes = ids(spark, "ab")
    new = spark.createDataFrame([("a", "b", "USES"), ("a", "b", "USES"), ("a", "x", "USES"), ("a", "b", "LIKES"), ("", "b", "CALLS")], EDGE)
    once = graph.upsert_edges(None, new, nodes)
    assert [tuple(r) for r in once.collect()] == [("a", "b", "USES")]
    assert graph.upsert_edges(once, new, nodes).count() == 1
    left_nodes, left_edges = graph.remove_nodes(nodes, once, ids(spark, "b"))
    assert [r.id for r in left_nodes.collect()] == ["a"] and left_edges.isEmpty()


def test_references(spark):
    known = spark.createDataFrame([("x1", "python", "save", "A", "x.py"), ("y1", "python", "save", "B", "y.py")], DEFINITION)

    def targets(owner, path="z.py", kind="call", within=False):
        asked = spark.createDataFrame([("z1", "python", "save", kind, owner, path)] * 2, CANDIDATE)
        return sorted((r.target_id, r.edge_type) for r in references.reference_edges(asked, known, within).collect())

    assert targets("A") == [("x1", "CALLS")]
    assert targets(None, kind="identifier") == [("x1", "USES"), ("y1", "USES")]
    assert targets("A", "x.py") == [] and targets("A", "x.py", within=True) == [("x1", "CALLS")]


@pytest.mark.parametrize("within", [False, True])
def test_symbols_walk_the_listed_edges(spark, within):
    rng = random.Random(9)
    file_of = {f"k{i}": rng.choice(["f", "g", "h", "lone"]) for i in range(40)}
    row = lambda chunk, *kind: (chunk, rng.choice(["py", "js"]), rng.choice(["hot", "hot", "a", "b", "", f"n{rng.randrange(30)}"]), *kind, rng.choice([None, None, "A", "B"]), file_of[chunk])
    asked = spark.createDataFrame([row(rng.choice(list(file_of)), rng.choice(["call", "identifier"])) for _ in range(60)], CANDIDATE)
    known = spark.createDataFrame([row(rng.choice(list(file_of))) for _ in range(40)], DEFINITION)
    plain = edges(spark, [("k1", "k2"), ("k3", "x"), ("x", "y")])
    symbols = references.Symbols(asked, known, within)
    listed = references.reference_edges(asked, known, within)
    pairs = {(r.source_id, r.target_id) for r in listed.collect()}
    for some in (["k1"], ["k5", "k6"], ["none"], list(file_of)):
        mine = {r.id for r in symbols.neighbours(ids(spark, some)).collect()}
        assert mine == {b for a, b in pairs if a in some} | {a for a, b in pairs if b in some}
        assert {r.id for r in symbols.touched(ids(spark, some)).collect()} == {x for x in some if any(x in p for p in pairs)}
        assert sorted(symbols.edges_at(ids(spark, some)).collect()) == sorted(r for r in listed.collect() if r.source_id in some or r.target_id in some)
    both = plain.unionByName(listed)
    for seeds in (["k1", "z"], ["y"]):
        for f in (graph.hops, graph.neighbour_nodes, graph.neighbour_edges):
            assert sorted(f(plain, ids(spark, seeds), 2, symbols).collect()) == sorted(f(both, ids(spark, seeds), 2).collect())


def test_a_name_of_all_files_has_no_square(spark):
    """Two thousand files that define and use one name: four million edges, none of which is listed."""
    files = spark.range(2000).selectExpr("concat('k', id) AS chunk_id", "'py' AS language", "'main' AS name", "cast(null AS string) AS owner", "concat('f', id) AS file_path")
    symbols = references.Symbols(files.selectExpr("chunk_id", "language", "name", "'call' AS kind", "owner", "file_path"), files)
    reached = symbols.neighbours(ids(spark, ["k0"]))
    assert reached.count() == 1999
