import random

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import stemming
from lodeseek.operators import search, sparse_index
from lodeseek.plans import catalogue, fixtures
from tests.conftest import SMALL
from tests.test_engine import STORE, engine

# Stems as the algorithm's authors publish them.
STEMS = """caresses caress|flies fli|dies die|ties tie|cries cri|gas gas|this this|gaps gap|kiwis kiwi|agreed agre|feed feed|hopping hop|hoping hope|luxuriating luxuri|cry cri|by by|say say
consistency consist|consignment consign|conspicuously conspicu|knightly knight|generously generous|communication communic|nationalization nation|relational relat|knackeries knackeri|rationally ration|adjustable adjust
controlled control|rolling roll|youth youth|boyish boyish|happily happili|abilities abil|generate generat|general general|succeeding succeed|bed bed|shed shed|shred shred|licenses licens|apologies apolog|hopefulness hope
possibly possibl|electrical electr|formative format|adoption adopt|herrings herring|singing sing|used use|bias bias|skies sky|arsenal arsenal|knives knive|yellowing yellow|x9s x9s|a1 a1"""


def test_stems():
    for pair in STEMS.replace("\n", "|").split("|"):
        word, want = pair.split()
        assert stemming.stem(word) == want, (word, stemming.stem(word), want)
    assert stemming.english("the licenses of all licensed".split()) == ["licens", "licens"]


def test_terms_in_batches(spark):
    rows = [(1, ["the", "licenses", "licensed"]), (2, []), (3, None), (4, ["of"]), (5, ["runs"] * 3)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, w array<string>").select("i", stemming.english_terms(F.col("w")).alias("t")).collect()}
    assert got == {1: ["licens", "licens"], 2: [], 3: None, 4: [], 5: ["run"] * 3}


def corpus(spark, rng, texts):
    words, shares = [f"w{i}" for i in range(30)], [1 / (i + 1) ** 1.3 for i in range(30)]
    rows = [(f"d{i:04}", " ".join(rng.choices(words, shares, k=rng.choice([1, 5, 30, 300])))) for i in range(texts)]
    return spark.createDataFrame([*rows, ("d0000x", rows[0][1]), ("none", None), ("empty", "")], "id string, text string")


@pytest.mark.parametrize("seed", range(3))
def test_the_best_are_those_of_full_scoring(spark, seed):
    rng = random.Random(seed)
    docs = corpus(spark, rng, 400)
    filed = search.filed(search.postings(docs, "id", "text", "text")).cache()
    for words, k in [("w0 w9 w25", 5), ("w29", 3), ("w0 w1 w2", 10), ("w3 w3 nothing", 1000), ("nothing at all", 4), ("w12 w28 w0 w1", 1), ("w0", 2)]:
        want = search.top(search.stored_scores(filed, "text", 402, words), k).orderBy("rank").collect()
        assert search.stored_top(filed, "text", 402, words, k).orderBy("rank").collect() == want
    filed.unpersist()


def test_blocks_under_the_bar_are_not_read(spark):
    docs = corpus(spark, random.Random(9), 3000)
    held = search.filed(search.postings(docs, "id", "text", "text")).cache()
    rare = sparse_index.reading(held, ["w0", "w1", "w29"], 3002, 5, search.DIGITS)
    assert rare.bar > 0 and {t for t, _ in rare.naming} == {"w29"} and {t for t, _ in rare.asked} == {"w0", "w1"} and rare.rows_naming < rare.rows_all / 5
    alone = sparse_index.reading(held, ["w2"], 3002, 5, search.DIGITS)
    assert alone.rows_read == alone.rows_naming < alone.rows_all / 2
    every = sparse_index.reading(held, ["w2"], 3002, 10_000, search.DIGITS)
    assert every.rows_read == every.rows_all
    held.unpersist()


def test_no_postings_and_no_words(spark):
    none = search.filed(search.postings(corpus(spark, random.Random(1), 1).where("false"), "id", "text", "text"))
    assert search.stored_top(none, "text", 0, "w0", 5).count() == 0 and search.stored_top(none, "text", 0, "", 5).count() == 0


def test_queries_over_documents(spark):
    plain = catalogue.bm25_layers_topk(spark, SMALL).orderBy("rank").collect()
    assert plain == catalogue.bm25_topk(spark, SMALL).orderBy("rank").collect() and len(plain) == catalogue.TOP
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    import math
    import re
    from collections import Counter

    counted = {i: Counter(stemming.english(re.findall("[a-z0-9]+", t.lower()))) for i, t in docs.items()}
    scores, asked = Counter(), search.query_terms(catalogue.QUERY, True)
    for term in asked:
        n = sum(term in c for c in counted.values())
        for i, c in counted.items():
            if c[term]:
                scores[i] += math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * c.total() / 256))
    want = sorted(((-round(s, 5), i) for i, s in scores.items()))[: catalogue.TOP]
    got = fixtures.bm25_english_topk(spark, SMALL).orderBy("rank").collect()
    assert [-round(r.score, 5) for r in got] == [s for s, _ in want]


def test_a_collection_of_stems(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    (code / "shop.py").write_text(STORE)
    e = engine(spark, tmp_path / "store")
    e.settings.english = True
    e.index(str(code))
    terms = {r.term for r in e.store.read(e.collection(str(code)), "postings").collect()}
    assert terms and all(x not in terms for x in stemming.STOP_WORDS) and {stemming.stem(x) for x in terms} & terms
    e.settings.english = False  # a collection stays as it was made
    assert e.search(str(code), "selling items", 3).count() > 0
    postings, texts = e.store.read(e.collection(str(code)), "postings"), e.store.facts(e.collection(str(code)))["texts"]
    word = min(x for x in terms if stemming.stem(x + "s") == x and len(x) > 3)
    assert search.stored_top(postings, "content", texts["content"], word + "s", 5, True).count() > 0
