from lodeseek.operators import diff
from lodeseek.schemas import FILE_RECORD

OLD = [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4), ("k", 5, 5), ("m", 6, 6), ("r", 7, 7)]


def frame(spark, rows):
    return spark.createDataFrame([(p, 1, float(t), i, h) for p, t, i, h in rows], FILE_RECORD)


def versions(spark):
    old = frame(spark, [(p, 0, i, f"h{h}") for p, i, h in OLD])
    new = frame(spark, [("a", 0, 1, "h1"), ("b", 9, 2, "h2"), ("c", 9, 3, "h3x"), ("e", 0, 4, "h4"), ("f", 0, 9, "h9"), ("p1", 0, 10, "h5"), ("p2", 0, 11, "h5"), ("s", 0, 7, "h8")])
    return old, new


def test_renames_are_told(spark):
    found = {(r.path, r.change, r.old_path) for r in diff.changes(*versions(spark)).collect()}
    assert found == {
        ("f", "added", None), ("p2", "added", None), ("s", "added", None), ("c", "modified", None), ("m", "removed", None), ("r", "removed", None), ("e", "renamed", "d"), ("p1", "renamed", "k"),
    }
    changes = diff.changes(*versions(spark))
    assert {r.path for r in diff.to_add(changes).collect()} == {"c", "f", "p2", "s"}
    assert {r.path for r in diff.to_remove(changes).collect()} == {"c", "m", "r"}


def test_suppressed_drops_all_moved_content(spark):
    found = {(r.path, r.change) for r in diff.suppressed(*versions(spark)).collect()}
    assert found == {("f", "added"), ("s", "added"), ("c", "modified"), ("m", "removed"), ("r", "removed")}


def test_unknown_inodes_are_equal(spark):
    old, new = frame(spark, [("a", 0, None, "h")]), frame(spark, [("a", 0, None, "other")])
    assert diff.changes(old, new).isEmpty()


def test_records_keep_known_hashes(spark):
    old = frame(spark, [("a", 0, 1, "known"), ("b", 0, 2, "old")])
    meta = frame(spark, [("a", 0, 1, "")]).unionByName(frame(spark, [("b", 5, 2, ""), ("c", 0, 3, ""), ("gone", 0, 4, "")])).drop("hash")
    content = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y")), ("c", bytearray(b"")), ("gone", None)], "path string, content binary")
    found = {r.path: r.hash for r in diff.records(meta, old, content).collect()}
    assert found == {"a": "known", "b": "415290769594460e2e485922904f345d", "c": "d41d8cd98f00b204e9800998ecf8427e"}


def test_empty_versions(spark):
    none = frame(spark, [])
    old, _ = versions(spark)
    assert diff.changes(none, none).isEmpty()
    assert {r.change for r in diff.changes(old, none).collect()} == {"removed"}
    assert {r.change for r in diff.changes(none, old).collect()} == {"added"}
