"""Tokens, languages, toxicity, quality and licences: awkward rows, brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import byte_bpe, language_id, license_scan, quality_rules, toxicity
from tests.conftest import SMALL
from tests.llm.helpers import AWKWARD, documents

MIDDLE = "/root/testdata/sf0.01"


def table(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_query(spark, reference):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    got = byte_bpe.op10_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_awkward_rows(spark, reference):
    path, pattern = byte_bpe.default_vocabulary()
    got = byte_bpe.encode(documents(spark, AWKWARD), "doc_id", "text", byte_bpe.load(spark, path), pattern, as_array=True).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted((str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in AWKWARD)
    assert byte_bpe.encode(documents(spark), "doc_id", "text", byte_bpe.load(spark, path), pattern).count() == 0


def test_bpe_random_texts(reference):
    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        encoder = byte_bpe.Encoder(byte_bpe.Vocabulary.parse(f.read()), pattern)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "\n", "é", "😀", "1", "'s", "\x1c", "　", "漢", "x" * rng.randint(1, 40), chr(rng.randint(0, 0xD7FF))]) for _ in range(rng.randint(0, 60)))
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text) and encoder.decode(packed) == text.encode()


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 7, 1000):
        keys = [str(i).encode() for i in range(n)]
        hashed, slots = byte_bpe.PerfectHash.build(keys)
        assert sorted(slots) == list(range(n)) and all(slots[hashed.slot(k)] == i for i, k in enumerate(keys))


# --- language ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    got = language_id.op1_language_id(spark, MIDDLE).join(table(spark, "documents", MIDDLE).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_counts_hold_all_grams(spark):
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, 200_000).astype(np.uint8)).decode() for _ in range(2)] + ["a few words"]
    counts = language_id.count_grams(spark.createDataFrame(list(zip(["aa", "bb", "cc"], texts, strict=True)), "language string, text string"), "language", "text")
    want = [len(np.unique(language_id.gram_codes(language_id.coded_bytes(t)))) for t in texts]
    assert Counter(counts.column("language").to_pylist()) == dict(zip(["aa", "bb", "cc"], want, strict=True)) and sum(want) > 300_000


def test_language_code_lengths_by_brute_force():
    """The automaton's bits equal a direct walk down the context trees."""
    import pyarrow as pa

    data = {"x": b"abracadabra abracadabra", "y": b"banana bandana banana"}
    rows = []
    for lang, body in data.items():
        codes, n = np.unique(language_id.gram_codes(body), return_counts=True)
        rows += [(lang, int(c), int(k)) for c, k in zip(codes, n, strict=True)]
    grams = pa.table({"language": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]})
    model = language_id.compile_trees(grams)
    counts = {lang: Counter() for lang in data}
    for lang, code, n in rows:
        k = code >> 40
        counts[lang][(code & ((1 << 40) - 1)).to_bytes(5, "big")[5 - k :]] += n

    def cost(lang, before, byte):
        total = 0.0
        for k in range(language_id.ORDER, -1, -1):
            context = before[len(before) - k :]
            here = {g[-1]: n for g, n in counts[lang].items() if len(g) == k + 1 and g[:-1] == context}
            size = sum(here.values())
            if not here or (k and size < language_id.MIN_CONTEXT):
                continue
            if byte in here:
                return total - np.log2(here[byte] / (size + len(here)))
            total -= np.log2(len(here) / (size + len(here)))
        return total + 8

    text = b"cabana dab " * 60
    padded = b" " * language_id.ORDER + text
    for j, lang in enumerate(model.languages):
        want = sum(cost(lang, padded[i : i + language_id.ORDER], text[i]) for i in range(len(text)))
        assert abs(model.bits([b"ab", text])[1, j] - want) < 1e-2


def test_language_awkward_rows(spark):
    model = language_id.learn(documents(spark, [(i, t, lang) for i, (t, lang) in enumerate([("der die und das ist", "de"), ("the and that is of", "en"), ("x", None)] * 20)]), "doc_id", "text", "lang")
    got = language_id.predict(documents(spark, AWKWARD), "doc_id", "text", model).collect()
    assert len(got) == len(AWKWARD) and {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 4}
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and {r.lang_pred for r in got if r.doc_id == 6} == {"en"}
    empty = language_id.learn(documents(spark), "doc_id", "text", "lang")
    assert empty is None and {r.lang_pred for r in language_id.predict(documents(spark, AWKWARD), "doc_id", "text", None).collect()} == {"und"}
    assert language_id.predict(documents(spark), "doc_id", "text", model).count() == 0


# --- toxicity ------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    got = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "labels", "/root/testdata/sf0.1"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def kneser_ney(rows, text):
    """Both classes' mean log-likelihoods of a text (ordinary, toxic), straight from the definition."""
    triples = {c: {t for body, y in rows if y == c for w in [["", "", *toxicity.words(body)]] for t in zip(w, w[1:], w[2:], strict=False)} for c in (0, 1)}
    pair = {c: Counter((v, w) for _, v, w in triples[c]) for c in (0, 1)}
    after = {c: Counter() for c in (0, 1)}
    for c in (0, 1):
        for (v, _), n in pair[c].items():
            after[c][v] += n
    every = set(pair[0]) | set(pair[1])
    cont = {c: Counter(w for _, w in pair[c]) for c in (0, 1)}
    both = Counter(w for _, w in every)
    totals, whole = {c: sum(cont[c].values()) for c in (0, 1)}, sum(both.values())

    def kept(n, shared, share):
        q = share * toxicity.TOLERANCE / (share * toxicity.TOLERANCE + 1 - share)
        return max(0.0, n - (shared * q + toxicity.DISCOUNT + toxicity.Z * (shared * q * (1 - q)) ** 0.5))

    rest = 1 - sum(max(n - toxicity.DISCOUNT, 0) for n in both.values()) / whole
    word_keeps = {c: {w: kept(cont[c][w], n, totals[c] / whole) / totals[c] for w, n in both.items()} for c in (0, 1)}
    free = {c: 1 - sum(word_keeps[c].values()) for c in (0, 1)}

    def unigram(c, w):
        return word_keeps[c].get(w, 0) + free[c] * (max(both[w] - toxicity.DISCOUNT, 0) / whole + rest / (len(both) + 2))

    def keeps(c, v, w):
        return kept(pair[c][v, w], pair[0][v, w] + pair[1][v, w], after[c][v] / (after[0][v] + after[1][v])) / after[c][v] if after[c][v] else 0

    def likelihood(c, v, w):
        return keeps(c, v, w) + (1 - sum(keeps(c, v, x) for u, x in every if u == v)) * unigram(c, w)

    found = toxicity.words(text)
    return [np.mean([np.log(likelihood(c, v, w)) for v, w in zip(["", *found], found, strict=False)]) for c in (0, 1)]


def test_toxicity_likelihoods_by_brute_force(spark):
    rng = random.Random(4)
    plain = "the a of and to road house river stone cloud".split()
    rows = []
    for i in range(300):
        body = [rng.choice(plain) for _ in range(rng.randint(0, 25))]
        if i % 4 == 0:
            body[rng.randint(0, len(body)) : 0] = ["you", rng.choice(["fool", "moron"])]
        elif rng.random() < 0.5:
            body[rng.randint(0, len(body)) : 0] = [rng.choice(["you", "dear"]), "friend"]
        rows.append((" ".join(body), int(i % 4 == 0)))
    rows += [(None, 0), ("", 1), rows[0], rows[0]]
    models = toxicity.build(toxicity.pair_counts(spark.createDataFrame(rows, "text string, toxic int")))
    texts = ["you fool", "the road of stone and you moron", "unseen words here", "friend", "you friend fool the a"]
    got = models.rates(texts, {})
    for text, (n, toxic, ordinary) in zip(texts, got, strict=True):
        assert n == len(text.split()) and np.allclose((ordinary, toxic), kneser_ney(rows, text))
    assert len(models.pairs) and got[0][1] > got[0][2]  # by pairs alone: a word that follows a single other one counts once
    assert np.array_equal(models.rates([None, "", "!"], {}), np.zeros((3, 3)))


def test_toxicity_tells_multi_word_expressions(spark):
    """Words that both classes use alike, in an order that only one has."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        body = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + rng.choice("xyz") for _ in range(12)]
        pair = ["get", "lost"] if i % 2 else ["lost", "get"]
        body[rng.randint(0, 12) : 0] = pair
        rows.append((i, " ".join(body)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    models = toxicity.learn(documents(spark, rows), labels, "doc_id", "text", "toxic")
    got = {r.doc_id: r.score for r in toxicity.rate(documents(spark, [(1, "road get lost house tree"), (2, "road lost get house tree")]), "doc_id", "text", models).collect()}
    assert got[1] > 0.5 > got[2]


def test_toxicity_awkward_rows(spark):
    docs = documents(spark, [(i, f"w{i} awful thing" if i % 2 else f"w{i} nice thing") for i in range(60)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (999, 1)], "doc_id bigint, toxic int")
    models = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
    got = toxicity.rate(documents(spark, [*AWKWARD, (50, "awful awful")]), "doc_id", "text", models).collect()
    assert len(got) == len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3, 4)}) == 1 and max(got, key=lambda r: r.score).doc_id == 50
    one_class = toxicity.learn(docs, labels.where("toxic = 1"), "doc_id", "text", "toxic")
    assert {r.score for r in toxicity.rate(docs, "doc_id", "text", one_class).collect()} == {1.0}
    none = toxicity.learn(docs, labels.where("false"), "doc_id", "text", "toxic")
    assert {r.score for r in toxicity.rate(docs, "doc_id", "text", none).collect()} == {0.0}
    assert toxicity.rate(documents(spark), "doc_id", "text", models).count() == 0


# --- quality -------------------------------------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in quality_rules.op4_quality_rules(spark, SMALL).collect():
        n, chars, symbols, lines, repeat = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)


def test_quality_awkward_rows(spark):
    rows = [*AWKWARD, (20, "a b c a b c a b c"), (21, "x\nx\n\n \nx"), (22, "a b a b a")]
    got = quality_rules.judge(documents(spark, rows), "text", ["doc_id"], [])
    assert by_id(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == sorted(((i, *base_counts(t)) for i, t in rows), key=str)
    assert quality_rules.judge(documents(spark), "text", ["doc_id"], []).count() == 0


def test_quality_list_is_learned(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join((word().upper() + "!!") if i % 3 == 0 else word() for _ in range(80))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(None, 0), (1, None)], "doc_id bigint, quality int")
    rules = quality_rules.learn(documents(spark, rows), labels, "doc_id", "text", "quality")
    assert rules and all(len(r.conditions) <= quality_rules.MAX_CONDITIONS for r in rules)
    got = quality_rules.judge(documents(spark, rows), "text", ["doc_id"], rules).collect()
    assert all(r.kept == (r.doc_id % 3 != 0) for r in got)
    assert quality_rules.learn(documents(spark, rows), labels.where("false"), "doc_id", "text", "quality") == []
    assert quality_rules.learn(documents(spark, rows), labels.where("quality = 1"), "doc_id", "text", "quality") == []


# --- licences ------------------------------------------------------------------------------------

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    found = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_license_base_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents", MIDDLE).collect()}
    got = license_scan.op7_license_scan(spark, MIDDLE).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_awkward_rows(spark):
    permission = license_scan.LICENSE_TEXTS["mit"].split()
    edited = " ".join(permission[:12] + ["really", "and", "truly"] + permission[12:])
    rows = [*AWKWARD, (30, "MIT License mit-license (Mit) LICENSE"), (31, "general public licence, GENERAL public license"), (32, edited), (33, " ".join(permission[:8])), (34, "mit license"), (34, "mit license"), (34, "apache license apache license"), (35, "mit éclicense mit Kelvin license"), (36, "mit\x00license")]
    got = license_scan.scan(documents(spark, rows), "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *base_places(t)) for i, t in rows), key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[32][0] == "mit" and labels[32][1] >= license_scan.MIN_COVER and labels[33] == ("", 0.0) and labels[30] == ("mit", 1.0)
    assert license_scan.scan(documents(spark), "doc_id", "text").count() == 0


def best_chains(found, template, k=license_scan.TEXT_K, gap=license_scan.DIAGONAL_GAP):
    """(cover, start, end) of each group of neighbouring diagonals: the chain of k-grams that text and template have in common with most words, less inserted ones, tried one by one."""
    words = template.split()
    hits = sorted((p, a) for p in range(len(found) - k + 1) for a in range(len(words) - k + 1) if found[p : p + k] == words[a : a + k])
    diagonals, group = sorted({p - a for p, a in hits}), {}
    for i, d in enumerate(diagonals):
        group[d] = group[diagonals[i - 1]] if i and d - diagonals[i - 1] <= gap else d
    best = {}
    for p, a in hits:
        steps = [(best[q, b], (p - a) - (q - b), min(k, a - b, p - q)) for q, b in hits if q < p and b < a and abs((p - a) - (q - b)) <= gap]
        best[p, a] = max([(k, p), *((n + new - max(0, step), first) for (n, first), step, new in steps)])
    out = {}
    for (p, a), (n, first) in best.items():
        out[group[p - a]] = max(out.get(group[p - a], (0, 0, 0)), (n, first, -p))
    return [(n / len(words), first, k - p) for n, first, p in out.values()]


def licensed(found):
    """Label -> best cover, of spans that no better one of another label lies on."""
    known = [(label, t) for label, t in license_scan.LICENSE_TEXTS.items()] + [(label, t) for t, label in license_scan.creative_commons().items()]
    spans = [(cover, len(t.split()), label, start, end) for label, t in known for cover, start, end in best_chains(found, t) if cover >= license_scan.MIN_COVER]
    stay = [x for x in spans if not any(y[2] != x[2] and y[:3] > x[:3] and 2 * (min(x[4], y[4]) - max(x[3], y[3])) > min(x[4] - x[3], y[4] - y[3]) for y in spans)]
    return {label: max(x[0] for x in stay if x[2] == label) for label in {x[2] for x in stay}}


def test_license_siblings_are_told_apart(spark):
    forms = license_scan.creative_commons()
    assert len(forms) == 12 and len(set(forms.values())) == 6
    rows = [(i, f"some words {text} and more of them") for i, text in enumerate(forms)] + [(99, "licensed under cc by nc nd 4 0"), (98, "this work is licensed under a creative commons attribution sharealike 4 0 international license")]
    want = dict(enumerate(forms.values())) | {99: "cc-by-nc-nd", 98: "cc-by-sa"}
    assert {r.doc_id: (r.labels, r.score) for r in license_scan.scan(documents(spark, rows), "doc_id", "text").collect()} == {i: (label, 1.0) for i, label in want.items()}


def test_license_inserted_words_count(spark):
    bsd = license_scan.LICENSE_TEXTS["bsd"].split()
    rows = [(n, " ".join(bsd[:10] + ["odd"] * n + bsd[10:])) for n in range(6)]
    got = {r.doc_id: r.score for r in license_scan.scan(documents(spark, rows), "doc_id", "text").collect()}
    assert [round(got[n] * len(bsd)) for n in range(5)] == [len(bsd) - n for n in range(5)] and got[5] < got[4]  # five are more than diagonals may lie apart


def test_license_labels_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, "licensed under cc by " * 3), (2, "licensed under cc by nc 4 0"), (3, "licensed under cc by then licensed under cc by nc 4 0")]
    for i in range(120):
        out = []
        for _ in range(rng.randint(1, 3)):
            some = rng.choice([*license_scan.LICENSE_TEXTS.values(), *license_scan.creative_commons()]).split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(some))
                some[at : at + rng.randint(0, 2)] = [rng.choice(["x", "the", "software"])] * rng.randint(0, 2)
            if rng.random() < 0.2:
                half = len(some) // 2
                some = some[half:] + some[:half]
            out += some + ["filler"] * rng.randint(0, 5)
        rows.append((10 + i, " ".join(out)))
    texts, labelled = dict(rows), 0
    for r in license_scan.scan(documents(spark, rows), "doc_id", "text").collect():
        good = licensed(texts[r.doc_id].split())
        base = set(filter(None, base_places(texts[r.doc_id])[4].split(",")))
        assert r.labels == ",".join(sorted({*good, *base})) and abs(r.score - max([1.0] * bool(base) + list(good.values()), default=0)) < 1e-9
        labelled += bool(good)
    assert labelled > 60


def test_license_many_equal_hits(spark):
    got = license_scan.scan(documents(spark, [(1, "mit license " * 500)]), "doc_id", "text").head()
    assert (got.n_base, got.first_word, got.last_word) == (500, 0, 998)


def test_types_of_contracts(spark):
    assert dict(license_scan.op7_license_scan(spark, SMALL).dtypes)["n_base"] == "bigint"
    assert dict(quality_rules.op4_quality_rules(spark, SMALL).dtypes)["n_repeat_words"] == "bigint"
    assert dict(toxicity.op2_toxicity(spark, SMALL).select(F.col("predicted")).dtypes)["predicted"] == "int"
