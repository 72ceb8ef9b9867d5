"""Services are asked once for a text, at a bounded rate, and what they said outlasts a failure."""

import os

import pytest

from lodeseek.plans.engine import Engine, Settings
from lodeseek.plans.services import Pace


def test_pace():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    pace = Pace(4, 2, lambda: now[0], sleep)
    for _ in range(6):
        pace.take()
    assert slept == [0.25] * 4 and now[0] == 1.0
    now[0] += 100  # no more than the burst is saved up
    for _ in range(3):
        pace.take()
    assert slept[4:] == [0.25]


def test_texts_are_asked_for_once(spark, tmp_path):
    code, log, stop = tmp_path / "code", str(tmp_path / "log"), str(tmp_path / "stop")
    code.mkdir()

    def embed(texts):
        if os.path.exists(stop) and any("gamma" in t for t in texts):
            raise ValueError("no more")
        with open(log, "a") as f:
            f.writelines(f"e {t.split('(')[0]}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    def explain(text):
        with open(log, "a") as f:
            f.write(f"x {text.split('(')[0]}\n")
        return "" if "beta" in text else f"about {len(text)}"

    def asked():
        found = sorted(open(log).read().splitlines()) if os.path.exists(log) else []
        open(log, "w").close()
        return found

    settings = {"vector_size": 2, "explanation": True, "rate": 1000.0, "tasks": 2, "wave": 3}
    e = Engine(spark, str(tmp_path / "store"), Settings(**settings), embed, explain)
    alpha, beta = "def alpha(x):\n    return x\n", "def beta(x):\n    return 'beta'\n"
    (code / "a.py").write_text(alpha + beta)
    (code / "b.py").write_text(alpha)
    (code / "c.py").write_text('def doc(x):\n    """Says."""\n    return 1\n')
    e.index(str(code))
    # Two files hold one text; a doc is embedded too, a blank answer stands as unknown.
    assert asked() == ["e Says.", "e about 26", "e def alpha", "e def beta", "e def doc", "e unknown", "x def alpha", "x def beta"]
    name = e.collection(str(code))
    points = {(r.relative_path, r.content.split("(")[0][4:]): r for r in e.store.read(name, "points").collect()}
    assert points["a.py", "alpha"].doc == points["b.py", "alpha"].doc == "about 26" and points["a.py", "beta"].doc == "unknown"
    assert all(r.code == [len(r.content), 1.0] and r.doc_vec == [len(r.doc), 1.0] for r in points.values()) and len(points) == 4

    os.rename(code / "c.py", code / "d.py")
    (code / "b.py").unlink()
    (code / "e.py").write_text("# moved\n" + alpha)
    assert e.index(str(code)) == {"renamed": 1, "removed": 1, "added": 1} and asked() == []  # moved code asks for nothing

    open(stop, "w").close()
    (code / "f.py").write_text("".join(f"def {n}(x):\n    return '{n}' * {i}\n" for i, n in enumerate(["gamma", "delta", "eta", "theta", "iota", "kappa", "mu"])))
    with pytest.raises(Exception, match="no more"):
        e.index(str(code))
    before = asked()
    assert e.store.read(name, "points").where("relative_path = 'f.py'").isEmpty() and len([x for x in before if x[0] == "x"]) == 7
    os.remove(stop)
    assert e.index(str(code)) == {"added": 1}
    again = asked()
    assert [x for x in again if x[0] == "x"] == [] and "e def gamma" in again  # explanations outlast the failure

    other = Engine(spark, str(tmp_path / "store"), Settings(**settings, embed_model="other"), embed, explain)
    (code / "d.py").write_text('def doc(x):\n    """Says."""\n    return 1\n# changed\n')
    assert other.index(str(code)) == {"modified": 1} and asked() == ["e Says.", "e def doc"]
