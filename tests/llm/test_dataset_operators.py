"""Manifest, decontamination and filter audit: awkward rows and brute force. Their SQL is tested with the other queries'."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeseek.llm import contamination, filter_audit, merkle
from lodeseek.llm.common import Scratch
from tests.llm.helpers import AWKWARD, documents

# --- manifest --------------------------------------------------------------------------------------


def H(parts):
    return hashlib.sha256("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts).encode()).hexdigest()


def brute_tree(digests):
    """The root, and each leaf's list of (run, slot)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, place in enumerate(at):
            paths[leaf].append((runs[place // 16], place % 16))
        at, level = [p // 16 for p in at], [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
    return (level or [None])[0], paths


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text), sorted as texts."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = brute_tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            siblings, found = "", leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                found = H((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for run, slot in path + above:
                siblings += "".join(run[:slot] + run[slot + 1 :])
                found = hashlib.sha256("".join([*run[:slot], found, *run[slot + 1 :]]).encode()).hexdigest()
            out.append((r[0], leaf, trees[g][0], root, hashlib.sha256(siblings.encode()).hexdigest(), found, found == root))
    return sorted(map(str, out))


def checked(df):
    folded = merkle.folded(F.coalesce("altered", "leaf"), F.col("path"))
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.digest([F.translate(c, merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS]))
    told = merkle.manifest(df, "doc_id", "source", merkle.digest([F.col(c) for c in merkle.FIELDS]), {"altered": altered}).withColumn("folded", folded)
    rows = told.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), "folded", F.col("folded") == F.col("root")).collect()
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_manifest_by_brute_force(spark, n):
    rng = random.Random(n)
    text = lambda: rng.choice([None, "", "Aé😀 Zß", "x" * rng.randrange(50), "Many Words " * rng.randrange(9)])
    rows = [(rng.choice([None, i, i, i, -i, 7]), rng.choice([None, "", "hot", "hot", "hot", "hot", "ü", "z", f"s{i % 30}"]), rng.choice(["en", None]), rng.choice([None, i]), text()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert checked(df.withColumns({c: F.lit("clash") for c in ("grp", "key", "digest", "place", "size", "path", "_row")})) == brute_manifest(rows)


def test_manifest_awkward_rows(spark):
    rows = [(r[0], "src1", "en", None if r[1] is None else len(r[1]), r[1]) for r in AWKWARD]
    assert checked(documents(spark, AWKWARD)) == brute_manifest(rows)


def test_manifest_rounds_meet_in_any_order(spark):
    """Events of one task in any order give the parents, and what can't be closed is handed on."""
    import pyarrow as pa

    size, rng = 16**3 + 5, random.Random(3)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(size)]
    order = rng.sample(range(size), size - 1)
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(["g"] * len(some)), pa.array([size] * len(some)), pa.array([0] * len(some)), pa.array(some), pa.array([digests[i] for i in some])], names=list("abcde"))
    rows = [r for b in merkle.arrivals(iter([batch(order[:99]), batch(order[99:])]), 9) for r in b.to_pylist()]
    left = set(range(size)) - set(order)
    assert not any(r["run"] and r["level"] == merkle.depth(size) for r in rows)
    assert {r["place"] for r in rows if r["run"] is None and r["level"] == 0} == set(range(min(left) // 16 * 16, min(min(left) // 16 * 16 + 16, size))) - left
    whole = [r for b in merkle.arrivals(iter([batch(order + list(left))]), 9) for r in b.to_pylist()]
    assert [r["digest"] for r in whole if r["level"] == merkle.depth(size)] == [brute_tree(digests)[0]] and all(r["run"] for r in whole)


# --- decontamination -------------------------------------------------------------------------------


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_overlap(docs, items, size):
    windows = {}
    for item, text in items:
        w = cut(text)
        for b in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[b : b + size]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(p) for p in windows}:
            for b in range(len(w) - n + 1):
                if at := windows.get(tuple(w[b : b + n])):
                    hit.update(range(b, b + n))
                    found |= at
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def overlapped(spark, docs, items, size=10, slop=2):
    df = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("clash") for c in ("item", "w", "phrase", "key")})
    made = documents(spark, docs).repartition(3)
    return contamination.overlap(made, "doc_id", "text", df, "item_id", "text", size, slop)


@pytest.mark.parametrize("slop", [0, 2])
def test_overlap_by_brute_force(spark, slop):
    rng = random.Random(slop)
    words = ["a", "b", "the", "é", "É", "Ünder", "x1", "99", "KelvinK"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_! "]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(300)] + [(None, "a the b a"), (7, "a b the a b"), (7, "a b the a b")]
    items = [(i % 40, text(rng.choice([0, 1, 2, 3, 4, 5, 6, 9]))) for i in range(60)] + [(None, "x1 99"), (3, None), (4, "never seen words"), (5, "a a a a a a")]
    told = overlapped(spark, docs, items, 4, slop).collect()
    assert sorted(str(tuple(r)[:6]) for r in told) == brute_overlap(docs, items, 4)
    assert slop or not any(r.n_near for r in told)


def test_overlap_awkward_rows(spark):
    docs = [*AWKWARD, (20, "same text twice over again and more words to fill a window of ten")]
    items = [(1, "jumps over the lazy dog and runs away from it"), (2, "same text twice over again"), (3, ""), (None, None)]
    assert sorted(str(tuple(r)[:6]) for r in overlapped(spark, docs, items).collect()) == brute_overlap(docs, items, 10)
    assert overlapped(spark, [], items).count() == 0
    assert not any(r.contaminated for r in overlapped(spark, docs, []).collect())


def test_proximity_by_brute_force(spark):
    """Every word of the phrase within slop of its place, as seen from the rarest word."""
    rng = random.Random(5)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(40))] for _ in range(200)]
    phrases = [tuple(rng.choice("abcdefghz") for _ in range(rng.randrange(1, 6))) for _ in range(20)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(map(list, dict.fromkeys(phrases)))), "phrase_id bigint, phrase array<string>")
    scratch, n = Scratch(spark), Counter(w for d in docs for w in d)
    indexed = scratch.written(contamination.index(df, "doc_id", "text"), "index")
    of = {(r.segment, r.start): r.key for r in contamination.texts(indexed).collect()}
    found = {(of[r.segment, r.start], r.phrase_id, r.begin, r.off) for r in contamination.search(indexed, asked, scratch, 1).collect()}
    expected = set()
    for p, phrase in enumerate(dict.fromkeys(phrases)):
        if not all(n[w] for w in phrase):
            continue
        anchor = min(range(len(phrase)), key=lambda o: (n[phrase[o]], o))
        for d, w in enumerate(docs):
            for at in (i - anchor for i, x in enumerate(w) if x == phrase[anchor]):
                off = [0 if o == anchor else min((abs(s) for s in (-1, 0, 1) if 0 <= at + o + s < len(w) and w[at + o + s] == x), default=None) for o, x in enumerate(phrase)]
                if at >= -1 and None not in off:
                    expected.add((d, p, at, sum(off)))
    assert found == expected


# --- filter audit ----------------------------------------------------------------------------------


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), [tuple(range(n))]
        for i in filter_audit.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def brute_audit(docs, labels):
    """docs: (doc_id, text, source)."""
    good, bad = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails, parts = [], {}
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > first[text]]
        fails.append(({f for f, failed in zip("ABCDE", tests, strict=True) if failed}, i in good, i in bad))
        parts.setdefault(source or "", []).append(fails[-1])
    out = []
    for part, rows in parts.items():
        shapley, figures = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [r for r in rows if f in r[0] and not r[0] & before]
                figures.append((part, order, step, sum(not r[0] & (before | {f}) for r in rows), len(removed), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed)))
                shapley[f] += len(removed)
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in figures]
    return sorted(out)


def test_audit_by_brute_force(spark):
    rng = random.Random(1)
    long = lambda: " ".join(rng.choice(["Word", "b", "c%", "dé", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([3, 199, 200, 230])))
    pool = [long() for _ in range(30)]
    docs = [(rng.choice([i, i, None, 5]), rng.choice([rng.choice(pool), long(), None, ""]), rng.choice([None, "", "a", "b"])) for i in range(200)] + [(i, "a copy in all parts #", rng.choice("ab")) for i in range(300, 500)]
    labels = [(rng.choice([i, None, 5]), rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 500, 2)]
    df = documents(spark, [(i, text, "en", source) for i, text, source in docs]).withColumns({c: F.lit("clash") for c in ("part", "own", "digest", "good", "bad", "mask", "n")})
    told = filter_audit.audit(df.repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(map(tuple, told.collect())) == brute_audit(docs, labels)


def test_audit_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    told = filter_audit.audit(documents(spark, AWKWARD), labels).collect()
    assert sorted(map(tuple, told)) == brute_audit([(r[0], r[1], "src1") for r in AWKWARD], [])
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
