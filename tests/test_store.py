"""The store: changes against a plain model, bytes written, segments kept."""

import os
import random

from lodeseek.sources.store import CONTENT, FILES, Store

EDGES = "source_id string, target_id string, edge_type string, source_path string, target_path string"
SNAPSHOT = "path string, size bigint, mtime double, inode bigint, hash string"


def test_changes_by_a_model(spark, tmp_path):
    store, rng = Store(spark, str(tmp_path)), random.Random(4)
    store.create("c", {})
    edges, snapshot, most = [], {}, 0
    for step in range(14):
        away = rng.sample([f"p{i}" for i in range(30)], rng.choice([0, 1, 2, 12]))
        some = [(f"s{step}.{i}", f"t{i}", "CALLS", rng.choice(away or ["q"]), f"p{rng.randrange(30)}") for i in range(rng.choice([0, 3, 40]))]
        files = [(p, step, 0.0, None, f"h{step}") for p in away if rng.random() < 0.7]
        edges = [e for e in edges if e[3] not in away and e[4] not in away] + some
        snapshot = {p: h for p, h in snapshot.items() if p not in away} | {f[0]: f[4] for f in files}
        gone = spark.createDataFrame([(p,) for p in away], "path string")
        store.change("c", {"edges": spark.createDataFrame(some, EDGES), "snapshot": spark.createDataFrame(files, SNAPSHOT)}, {CONTENT: gone, FILES: gone}, {"step": step})
        if step % 3 == 2 or step > 11:
            assert sorted(tuple(r) for r in store.read("c", "edges").collect()) == sorted(e[:3] for e in edges)
            assert {r.path: r.hash for r in store.read("c", "snapshot").collect()} == snapshot
        assert store.facts("c")["step"] == step
        most = max(most, *(len(x) for x in store._pointer("c")["segments"].values()))
    assert most <= 6
    held = {os.path.relpath(d, tmp_path / "c") for d, _, names in os.walk(tmp_path / "c") if any(n.endswith(".parquet") for n in names)}
    pointer = store._pointer("c")
    assert held == {f"{t}/{x['path']}" for t, some in pointer["segments"].items() for x in some} | set(pointer["left"])


def test_a_change_writes_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("c", {})
    rows = lambda low, high: spark.range(low, high).selectExpr("concat('p', id) AS path", "id AS size", "0D AS mtime", "id AS inode", "md5(cast(id AS string)) AS hash")
    store.change("c", {"snapshot": rows(0, 200_000)})

    def sizes():
        return {p: os.path.getsize(p) for d, _, names in os.walk(tmp_path / "c") for p in [os.path.join(d, n) for n in names]}

    before = sizes()
    for i in range(3):
        store.change("c", {"snapshot": rows(i, i + 1)}, {FILES: rows(i, i + 1)})
        after = sizes()
        assert sum(n for p, n in after.items() if p not in before) < sum(before.values()) / 50
        before |= after
    assert store.read("c", "snapshot").count() == 200_000


def test_one_edit_among_many_files(spark, tmp_path):
    from lodeseek.plans.engine import Engine, Settings

    code = tmp_path / "code"
    code.mkdir()
    for i in range(150):
        (code / f"f{i}.py").write_text(f"def f{i}(x):\n    return f{i * 7 % 150}(x)\n" + f"# {i}\n" * 40 + "".join(f"def g{i}_{k}(y):\n    return f{k}(y)\n" for k in range(20)))
    e = Engine(spark, str(tmp_path / "store"), Settings(vector_size=64))
    e.index(str(code))
    size = lambda: {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(tmp_path / "store") for n in names}
    before = size()
    (code / "f3.py").write_text("def f3(x):\n    return f4(x)\n")
    assert e.index(str(code)) == {"modified": 1}
    fresh = {p: n for p, n in size().items() if p not in before}
    assert sum(fresh.values()) < sum(before.values()) / 8  # a footer for each table, mostly
    name = e.collection(str(code))
    assert e.store.read(name, "points").where("relative_path = 'f3.py'").count() == 1 and e.store.facts(name)["texts"]["content"] == e.store.read(name, "points").count() == 149 * 21 + 1
