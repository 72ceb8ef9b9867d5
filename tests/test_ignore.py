import os

from lodeseek.operators import ignore
from lodeseek.sources import files

RULES = ["*.gen.py", "!keep.gen.py", "/foo.py", "lib/", "# note", "", "  "]
CASES = {
    "a.py": True, "b.gen.py": False, "keep.gen.py": True, "foo.py": False, "sub/foo.py": True, "lib/x.py": False, ".hid/x.py": False, "build/x.py": False, "p/build/y.py": False, "notes.txt": False, "deep/lib/z.py": False, "A.PY": True,
}


def test_rules_over_paths(spark):
    rules = ignore.default_rules() + ignore.rules_of(RULES)
    kept = ignore.listed(spark.createDataFrame([(p,) for p in CASES], "path string"), ignore.rules_frame(spark, rules))
    assert {r.path for r in kept.collect()} == {p for p, keep in CASES.items() if keep}


def test_scan_agrees_with_rules(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("\n".join(RULES))
    for p in CASES:
        if p != "A.PY":
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).write_text("x")
    (tmp_path / "sub" / ".gitignore").write_text("*.js\n!ok.js\n")
    (tmp_path / "sub" / "no.js").write_text("")
    (tmp_path / "sub" / "ok.js").write_text("")
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    found = files.scan(spark, str(tmp_path)).collect()
    assert {r.path for r in found} == {p for p, keep in CASES.items() if keep and p != "A.PY"} | {"sub/ok.js"}
    assert {r.path: r.size for r in found}["a.py"] == 1


def test_directory_rule_spares_files(spark):
    rules = ignore.rules_frame(spark, ignore.rules_of(["docs.py/"]))
    paths = spark.createDataFrame([("docs.py",), ("docs.py/a.py",)], "path string")
    assert [r.path for r in ignore.ignored_paths(paths, rules).collect()] == ["docs.py/a.py"]


def test_sets_and_question_marks(spark):
    rules = ignore.rules_frame(spark, ignore.rules_of(["[ab]?.py", "x[!0-9].py"]))
    paths = spark.createDataFrame([(p,) for p in ("a1.py", "c1.py", "xa.py", "x1.py")], "path string")
    assert {r.path for r in ignore.ignored_paths(paths, rules).collect()} == {"a1.py", "xa.py"}
