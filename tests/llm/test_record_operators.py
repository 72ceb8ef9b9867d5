"""HTML, WARC, near-duplicates, neighbours, mixing and the pipeline: awkward rows and brute force."""

import base64
import gzip
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm import ann_tree, html_text, mixing, near_dedup, warc
from lodeseek.llm.common import Scratch
from lodeseek.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL, rows_of
from tests.llm.helpers import AWKWARD, LONG, documents

MIDDLE = "/root/testdata/sf0.01"


def table(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows_of(mine) == rows_of(theirs)


# --- HTML ----------------------------------------------------------------------------------------


def test_html_query_by_another_way(spark):
    import html

    pages = {r.page_id: r for r in table(spark, "pages", MIDDLE).collect()}
    for r in html_text.op3_html_text(spark, MIDDLE).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="main">
<header><div>Site name and motto</div></header><nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to improve your experience on this site and on others.</p></div>
<main><article><header><h1>Big &amp; title</h1></header><p class=lead>First with <a href="x">one link</a> &copy here
and <b>bold</b>.<p>Second.<aside class="related"><h3>Read on</h3><a href=1>x y</a></aside><ul><li>one<li>two</ul>
<table><tr><td>cell a<td>cell b</table><div class="advert">Buy now and save a lot of money today with us</div>
<form><label>Email</label><input><button>Go</button></form><!-- <p>hidden</p> --><script>var a = "<p>no</p>"</script>
<p>Last &lt;p&gt; one.</article><section id=comments><p>Great article, thanks so much for writing all of it down.</p></section></main>
<footer><p>All of the small print that nobody reads at the bottom of the page.</p></footer></body></html>"""


def test_html_page_with_everything():
    tree = html_text.train(html_text.labelled())
    assert html_text.main_text(PAGE, tree).split("\n\n") == ["Big & title", "First with one link © here and bold.", "Second.", "one", "two", "cell a", "cell b", "Last <p> one."]


def test_html_tree_fits_its_table():
    rows = html_text.labelled()
    tree = html_text.train(rows)
    assert all(html_text.is_main(tree, x) == bool(y) for x, y in rows)


def test_html_neighbours_decide():
    """Words and link density of neighbours tell blocks that are alike in themselves, on pages that say nothing."""
    tree, used, waiting = html_text.train(html_text.labelled()), set(), []
    waiting.append(tree)
    for node in waiting:
        if node.feature >= 0:
            used.add(html_text.FEATURES[node.feature])
            waiting += [node.low, node.high]
    assert used >= {"words", "link_density", "words_before", "words_after"} and used & {"link_density_before", "link_density_after"}
    long, link = "<p>" + "word " * 60 + "</p>", "<div><a href=x>one two</a></div>"
    short = "<div>three short words</div>"
    got = html_text.main_text(long + short + long + link * 3 + short + link * 3, tree)
    assert got.split("\n\n") == [" ".join(["word"] * 60), "three short words", " ".join(["word"] * 60)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>before <svg/> after</p><p>last</p>", ["before after", "last"]), ("<p>a <svg><text>t</text></svg> b</p><p>c</p>", ["a b", "c"]), ("<p>a <svg><path> b</p><p>c d</p>", ["a", "c d"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>5</mn></math> hold</p>", ["Let x=5 hold"]), ("<p>one</p><video><source src=x>instead</video><p>two</p>", ["one", "instead", "two"]),
        ("<p>a <button>Go<p>more text</p><p>x y z</p>", ["a", "more text", "x y z"]), ("<p>t</p><select><option>a<option>b</select><p>u</p><form><label>q</label><input></form><p>v</p>", ["t", "u", "v"]),
        ('<h1 class="article-header">Title here</h1><div class="search-algorithms"><p>Some text</p></div><div class="post-comments"><p>Nice one</p></div>', ["Title here", "Some text"]),
        ('<div class="header"><p>Own title</p></div><div class="share-buttons">Share this now</div><p>t</p>', ["Own title", "t"]), ("<p>t<script/>x</script>u</p>", ["tu"]),
    ],
)
def test_html_elements_end_as_in_html(page, want):
    assert html_text.main_text(f"<article>{page}</article>", html_text.train(html_text.labelled())).split("\n\n") == want


WORDS40 = "<p>" + "word " * 40 + "</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>Short news</h1><p>The bridge was closed again on Monday morning.</p></article>", ["Short news", "The bridge was closed again on Monday morning."]),
        *((f"<article><p>{'w ' * n}</p></article>", [" ".join("w" * n)]) for n in range(1, 30)),
        (f"<article>{WORDS40}<h2>References</h2><ul><li><a href=a>First ref</a><li><a href=b>Second</a></ul></article><footer><a href=c>Imprint</a></footer>", [" ".join(["word"] * 40), "References", "First ref", "Second"]),
        (f'<article>{WORDS40}<p class="widget">Kept</p>{WORDS40}<div class="widget">Gone</div><p class="advert">Buy</p></article>', [" ".join(["word"] * 40), "Kept", " ".join(["word"] * 40)]),
        ("A page that is plain text.", ["A page that is plain text."]), ("<body><p>One short paragraph here.</p><p>And a second of them.</p></body>", ["One short paragraph here.", "And a second of them."]),
        ('<nav><a href=a>Home</a></nav><p class="widget">Weather today</p><article><p>Text</p></article>', ["Text"]),
    ],
)
def test_html_short_articles_and_lists_of_links(page, want):
    assert html_text.main_text(page, html_text.train(html_text.labelled())).split("\n\n") == want


def test_html_surroundings_outweigh_form():
    tree, rng = html_text.train(html_text.labelled()), random.Random(3)
    for _ in range(20_000):
        form = [rng.choice([0.0, 1.0, 7.0, 15.0, 60.0, 900.0]) if i % 2 == 0 else rng.random() for i in range(6)] + [float(rng.random() < 0.2)]
        assert html_text.is_main(tree, (*form, 0.0, 1.0)) and not html_text.is_main(tree, (*form, 1.0, 0.0)) and not html_text.is_main(tree, (*form, 1.0, 1.0))


def test_html_takes_time_in_proportion():
    tree = html_text.train(html_text.labelled())

    def seconds(n):
        began = time.perf_counter()
        html_text.main_text("<div>" * n + "</p>" * n + "<a " * n, tree)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000)


def test_html_awkward_rows(spark):
    paragraph = "<p>" + "word " * 40 + "</p>"
    rows = [(1, None), (2, ""), (3, "<html><body></body></html>"), (4, "<article><p>open"), (5, "<article>" + "<p>x y z</p>" * 20000 + "</article>"), (6, paragraph * 3), (7, "<article><p>a<script>never ends"), (8, "<article><p>a <b class='x>quote</b> z"), (9, "< > && &#; <<p>>"), (10, "<article><p>same</p></article>"), (10, "<article><p>same</p></article>"), (None, "<article><p>n</p></article>"), (11, "<article><p>ok</p><!-- open")]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in rows], "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = html_text.extract(df, "page_id", "html", ("url",)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == texts[2] == texts[3] == "" and texts[4] == "open" and texts[5].count("x y z") == 20000
    assert texts[6] == "\n\n".join([" ".join(["word"] * 40)] * 3) and texts[7] == "a" and texts[10] == "same" and texts[11] == "ok" and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.where("false"), "page_id", "html").count() == 0


# --- WARC ----------------------------------------------------------------------------------------

PAGES = [(1, "http://a/x", "same"), (2, "http://b/y?q=é\r\nX: 1", "same"), (3, None, None), (4, "u", ""), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (6, "u", "z" * 3_000_000), (None, "u", "same"), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (7, "u", "only")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).withColumn("hex", F.lit("clash"))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    warc.write_pages(pages(spark).repartition(3), str(tmp_path / "w"), compression=compression)
    got = warc.read_pages(spark, str(tmp_path / "w")).collect()
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keeper = {"same": 2, "": 4, "only": 7, PAGES[4][2]: 5, PAGES[5][2]: 6}
    want = sorted(((i, len((h or "").encode()), b32(h), "response" if i == keeper[h or ""] else "revisit", None if i == keeper[h or ""] else keeper[h or ""]) for i, _, h in PAGES), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {2: "same", 4: "", 5: PAGES[4][2], 6: PAGES[5][2], 7: "only"}


def test_warc_threshold_keeps_small_payloads(spark, tmp_path):
    warc.write_pages(pages(spark), str(tmp_path / "w"), min_bytes=5)
    got = warc.read_pages(spark, str(tmp_path / "w"), payload=False).collect()
    assert Counter(r.record_type for r in got) == {"response": 9} and all(r.payload is None for r in got)


def test_warc_pushes_predicates_down(spark, tmp_path):
    warc.write_pages(pages(spark), str(tmp_path / "w"))
    warc.register(spark)
    records = spark.read.format(warc.NAME).load(str(tmp_path / "w"))
    asked = records.where((F.col("record_type") == "revisit") & F.col("record_id").isin("<urn:page:1>", "<urn:page:4>") & F.col("target_uri").startswith("http"))
    assert [r.record_id for r in asked.collect()] == ["<urn:page:1>"]
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 1)]))
    assert len(left) == 1 and len(reader.tests) == 1
    taken = [0]
    stream = warc._Bytes.take
    try:
        warc._Bytes.take = lambda self, n: (taken.__setitem__(0, taken[0] + n), stream(self, n))[1]
        rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    finally:
        warc._Bytes.take = stream
    assert {r["record_type"] for r in rows} == {"revisit"} and taken[0] == 0  # no byte of an unwanted payload was read


def test_warc_reads_other_writers_and_refuses_broken_files(spark, tmp_path):
    warc.register(spark)
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nwarc-record-id: <urn:x>\r\nContent-Type: text/plain\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.warc").write_bytes(record * 2)
    (tmp_path / "one" / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "one" / "skipped.txt").write_bytes(b"x")
    got = spark.read.format(warc.NAME).load(str(tmp_path / "one")).collect()
    assert len(got) == 4 and {bytes(r.payload) for r in got} == {b"hello"} and {r.record_id for r in got} == {"<urn:x>"}
    (tmp_path / "one" / "c.warc").write_bytes(record[:-6])
    with pytest.raises(Exception, match="ends within a record"):
        spark.read.format(warc.NAME).load(str(tmp_path / "one")).collect()


def test_warc_long_headers_and_many_small_members(spark, tmp_path):
    rows = [(1, "http://a/" + "x" * 3_000_000, "body"), *((i, f"http://a/{i}", f"page {i}") for i in range(2, 400))]
    for compression in ("none", "gzip"):
        warc.register(spark)
        warc.write_pages(pages(spark, rows).coalesce(1), str(tmp_path / compression), compression=compression)
        got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_pages(spark, str(tmp_path / compression)).collect()}
        assert got == {i: (u, h) for i, u, h in rows}


def test_warc_files_are_bounded_and_leave_nothing(spark, tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path), "file_bytes": "1000"})
    batch = pa.RecordBatch.from_pylist([dict(zip(warc.WRITE_COLUMNS, ("response", f"<{i}>", None, "u", None, 500, b"x" * 500), strict=True)) for i in range(7)])
    done, lost = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([done, None])
    assert len(done.names) == 4 == len(lost.names) and sorted(p.name for p in tmp_path.iterdir()) == sorted(done.names)
    other = warc.WarcWriter({"path": str(tmp_path)})
    other.write(iter([batch]))
    other.abort([None])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(done.names)


def test_warc_empty_table(spark, tmp_path):
    warc.write_pages(pages(spark, PAGES[:1]).where("false"), str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 0


# --- near-duplicates -----------------------------------------------------------------------------


def weighted(texts):
    """Each text's weighted shingles, counted exactly."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    sets = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    n, df = sum(map(bool, sets)), Counter(s for x in sets for s in x)
    step = lambda s: round(near_dedup.LEVELS * np.log(min(max(n / df[s], 1), near_dedup.RARE)) / np.log(near_dedup.RARE)) / near_dedup.LEVELS
    return [{s: k * (1 + step(s)) for s, k in x.items()} for x in sets]


def exact_groups(texts, similar=near_dedup.SIMILAR):
    sets, root = weighted(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = []
    for i in range(len(texts)):
        for j in range(i):
            shared = sets[i].keys() & sets[j].keys()
            if shared:
                common = sum(min(sets[i][s], sets[j][s]) for s in shared)
                sim = common / (sum(sets[i].values()) + sum(sets[j].values()) - common)
                close.append(abs(sim - similar) < 0.01)
                if sim >= similar:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], sum(close)


def copies(seed=4, families=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
            if rng.random() < 0.4:
                base = edited
    return texts


def test_near_duplicates_by_brute_force(spark):
    texts = copies()
    want, close = exact_groups(texts)
    got = dict(near_dedup.groups(documents(spark, list(enumerate(texts))), "doc_id", "text").collect())
    assert sum(got[i] != w for i, w in enumerate(want)) <= 2 * close and len(set(want)) < len(texts) - 10


def test_near_duplicates_in_large_families(spark, monkeypatch):
    """The way of large groups (distances to the hub, and blocks) gives what groups in one task give."""
    docs = documents(spark, list(enumerate(copies(9, 8))))
    one = dict(near_dedup.groups(docs, "doc_id", "text").collect())
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 2)
    assert dict(near_dedup.groups(docs, "doc_id", "text").collect()) == one


def test_draws_collide_as_often_as_sets_are_similar():
    rng, gaps = np.random.default_rng(3), []
    for _ in range(40):
        x, w = rng.integers(0, 2**63, 300).astype(np.uint64), rng.uniform(1, 3, 300).astype(np.float32)
        keep, w2 = rng.random(300) < 0.9, w * rng.choice([1.0, 1.5], 300).astype(np.float32)
        a, b = near_dedup.draws(x, w, np.array([0])), near_dedup.draws(x[keep], w2[keep], np.array([0]))
        similar = np.minimum(w, np.where(keep, w2, 0)).sum() / np.maximum(w, np.where(keep, w2, 0)).sum()
        gaps.append((a == b).mean() - similar)
    assert abs(np.mean(gaps)) < 0.03


def test_near_duplicates_awkward_rows(spark):
    rows = [*AWKWARD, (10, LONG + "x"), (11, "ONE!"), (12, "one two"), (13, "Same text, twice over -- again")]
    got = [tuple(r) for r in near_dedup.groups(documents(spark, rows), "doc_id", "text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (7, 7), (8, 8), (None, None), (9, 9), (10, 6), (11, 5), (12, 12), (13, 7)]))
    assert near_dedup.groups(documents(spark), "doc_id", "text").count() == 0
    kept = near_dedup.deduplicated(documents(spark, rows).withColumns({c: F.lit("clash") for c in ("key", "own", "tid", "row", "body", "n", "_n", "_key")}), "doc_id", "text")
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, None, 9, 12])) and "clash" in {r.tid for r in kept.collect()}


def test_near_duplicates_without_ids(spark):
    """Rows without an id group and stay like others; so do rows of one id with other texts."""
    word = lambda family, i: f"w{family}x{i}"
    base = lambda family, *edits: " ".join(f"edit{family}" if i in edits else word(family, i) for i in range(120))
    rows = [
        (1, base(1)), (None, base(1)), (None, base(1, 60)), (2, base(2)), (None, base(2, 40)), (None, base(3)), (None, base(3)), (None, base(3, 70)), (None, base(4)), (None, None), (None, "!"),
        (5, base(5)), (5, base(1, 80)), (6, base(6)), (6, base(6, 50)), (7, None), (7, "")
    ]
    got = sorted(map(str, map(tuple, near_dedup.groups(documents(spark, rows), "doc_id", "text").collect())))
    assert got == sorted(map(str, [(1, 1), (None, 1), (None, 1), (2, 2), (None, 2), *[(None, None)] * 6, (5, 5), (5, 1), (6, 6), (6, 6), (7, 7), (7, 7)]))
    kept = [(r.doc_id, r.text) for r in near_dedup.deduplicated(documents(spark, rows), "doc_id", "text").collect()]
    family = lambda text: text.split("x")[0] if text and text[0] == "w" else text
    assert sorted(str((i, family(t))) for i, t in kept) == sorted(map(str, [(1, "w1"), (2, "w2"), (None, "w3"), (None, "w4"), (None, None), (None, "!"), (5, "w5"), (6, "w6"), (7, None), (7, "")]))


def test_components_by_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a int, b int").repartition(5), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# --- neighbours ----------------------------------------------------------------------------------


def exact_nearest(rows, k, is_query):
    usable = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(usable)
    x = np.array([usable[i] for i in ids])
    out = {}
    for i in filter(is_query, ids):
        score = x @ usable[i]
        out[i] = [ids[j] for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
    return out


def test_neighbours_recall_on_all_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "embeddings", "/root/testdata/sf0.1").collect()]
    want = exact_nearest(rows, 20, lambda i: i % 20 == 0)
    got = {}
    for r in ann_tree.op6_ann_tree(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_neighbours_ties_go_to_smaller_ids():
    rng = np.random.default_rng(6)
    vectors, queries, ids = rng.integers(0, 2, (500, 12)).astype(float), rng.integers(0, 2, (40, 12)).astype(float), rng.permutation(500)
    q, v, score = ann_tree._top(queries, vectors, 21, ids)
    for i, asked in enumerate(queries):
        exact = vectors @ asked
        best = np.lexsort((ids, -exact))[:21]
        assert v[q == i].tolist() == best.tolist() and np.array_equal(score[q == i], exact[best])


def test_neighbours_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(1, 60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    odd = [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 2.0, 3.0]), (280, [float("nan"), 1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (20, rows[19][1])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "e", "a", "b", "leaf", "ids")})
    got = {}
    for r in ann_tree.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and abs(r.score - np.dot(dict(rows)[r.query_id], dict(rows)[r.vec_id])) < 1e-12
    assert got == exact_nearest(rows, 5, lambda i: i % 20 == 0)
    few = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann_tree.nearest(few, "vec_id", "embedding", F.col("id") % 20 == 0, 5).collect()] == [(20, 21)]
    assert ann_tree.nearest(few.where("false"), "vec_id", "embedding", F.col("id") % 20 == 0, 5).count() == 0


def test_best_bins_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    tree = ann_tree.fit(x, float(np.linalg.norm(x, axis=1).max()))
    leaves = {i for i in range(len(tree.first)) if tree.first[i] == tree.last[i]}
    order = tree.best_bins(x[0], 10**6)
    assert len(order) == len(set(order)) and set(order) == leaves and set(tree.leaf_of(x).tolist()) <= leaves and len(leaves) > 10


# --- mixing --------------------------------------------------------------------------------------


def test_fill_redistributes_shortages():
    assert mixing.fill(100, {"a": (1, 10), "b": (1, 1000), "c": (2, 1000)}) == {"a": 10, "b": 30, "c": 60}
    assert mixing.fill(100, {"a": (1, 10), "b": (3, 20)}) == {"a": 10, "b": 20} and mixing.fill(5, {}) == {}


def test_mix_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "en", "en", "de", "xx", None]), rng.choice(["src0"] * 6 + ["src1", "src7", "src19", None, "odd"])) for i in range(400)]
    mix = mixing.Mix(share=0.7, max_epochs=2)
    got = Counter((r.doc_id) for r in mixing.mixed(documents(spark, rows), mix).collect())
    number = lambda s: int(m[0]) // 5 if (m := re.findall(r"\d+$", s or "")) else None
    leaf = {i: ({0: "web", 1: "forum", 2: "books", 3: "reference"}.get(number(s), "other"), g if g in ("en", "de", "fr", "es") else "other", s or "") for i, _, g, s in rows}
    size = {i: len(t.split()) for i, t, _, _ in rows}
    caps = Counter()
    for i in size:
        caps[leaf[i]] += size[i]
    total = sum(caps.values())
    domains = mixing.fill(float(int(mix.share * total)), {d: (mix.domains[d], 2 * sum(c for x, c in caps.items() if x[0] == d)) for d in {x[0] for x in caps}})
    for d, b in domains.items():
        groups = mixing.fill(b, {g: (mix.languages[g], 2 * sum(c for x, c in caps.items() if x[:2] == (d, g))) for g in {x[1] for x in caps if x[0] == d}})
        for g, b2 in groups.items():
            for s, b3 in mixing.fill(b2, {x[2]: (1, 2 * c) for x, c in caps.items() if x[:2] == (d, g)}).items():
                mine, budget = [i for i in size if leaf[i] == (d, g, s)], int(b3 + 1e-6)
                tokens = caps[d, g, s]
                whole = budget // tokens if tokens else 0
                rest, taken = budget - whole * tokens, set()
                run = 0
                for i in sorted(mine, key=lambda i: hashlib.md5(f"{mix.seed}:{whole}:{i}".encode()).hexdigest()):
                    run += size[i]
                    if rest > 0 and run <= rest:
                        taken.add(i)
                assert all(got[i] == whole + (i in taken) for i in mine), (d, g, s)


def test_mix_buckets_change_nothing(spark, monkeypatch):
    docs = table(spark, "documents", MIDDLE)
    whole = sorted(map(str, mixing.mixed(docs).select("doc_id", "_epoch").collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert sorted(map(str, mixing.mixed(docs).select("doc_id", "_epoch").collect())) == whole


def test_mix_awkward_rows(spark):
    got = mixing.mixed(documents(spark, AWKWARD), mixing.Mix(share=1.0)).collect()
    assert {r.doc_id for r in got} >= {6} and all(r.kept == "clash" for r in got)
    assert mixing.mixed(documents(spark), mixing.Mix()).count() == 0 and mixing.mixed(documents(spark, AWKWARD), mixing.Mix(share=0.0)).count() == 0
    repeated = Counter(r.doc_id for r in mixing.mixed(documents(spark, [(1, "a b c d")] * 3 + [(2, "x")]), mixing.Mix(share=1.0)).collect())
    assert repeated[1] % 3 == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "mixing to target weights", "byte-level BPE"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    from lodeseek.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        rows = docs.collect()
        assert rows and all(r.text == texts[r.doc_id] for r in rows), name
        if name != "mixing to target weights":
            assert len({r.doc_id for r in rows}) == len(rows) <= len(texts)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.columns == ["doc_id", "n_tokens", "ids", "decodes"] and last.count() == docs.count() and last.where("NOT decodes OR size(ids) <> n_tokens").isEmpty()


def test_pipeline_takes_awkward_and_empty_tables(spark):
    rows = documents(spark, AWKWARD, extra=False)
    for some in (rows, rows.where("false")):
        docs = some
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        assert docs.count() <= some.count() * 2
