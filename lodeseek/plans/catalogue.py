"""Queries over the test tables, one or more for each family of operators, and SQL that must agree.

No test table holds file paths, so documents stand in for files: PATH makes a path from each row,
and an older version of the table is derived by rule (some rows left out, some texts and paths
changed). embeddings and documents have separate ids; pairing them by number is for exercise only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.fixed_values import LANGUAGE_OF_EXTENSION, RRF_K
from lodeseek.functions import text as tx
from lodeseek.functions.ids import chunk_id
from lodeseek.operators import chunking, diff, graph, ignore, points, references, search, sparse_index

Query = Callable[[SparkSession, str], DataFrame]

#: The stand-in path, in SQL that Spark and DuckDB share.
PATH = "concat(lang, '/', source, '/', CASE WHEN doc_id % 11 = 0 THEN '.cfg/' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN 'build/' ELSE '' END, 'doc_', doc_id, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.txt' ELSE '.RB' END)"
QUERY = "the license of version error that shall"
SIZE, OVERLAP, TOP = 500, 50, 20
RULES = ["*.rb", "*.RB", "!doc_4*.RB", "build/", "/en/src3", "src1[0-2]", "!doc_?.RB"]
NESTED = {"en": ["src5/*.go"], "de/src2": ["*.py", "!doc_20.py"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("path", F.expr(PATH))


def _rules() -> list[ignore.Rule]:
    out = ignore.rules_of(RULES)
    for i, (dir, lines) in enumerate(NESTED.items(), 1):
        out += ignore.rules_of(lines, dir, 100 * i)
    return out


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new FILE_RECORD rows."""
    docs = _docs(spark, sf_dir)
    new = docs.select("path", F.length("text").cast("bigint").alias("size"), F.col("doc_id").cast("double").alias("mtime"), F.col("doc_id").alias("inode"), F.md5("text").alias("hash"))
    edited = docs.where("doc_id % 10 <> 3").withColumn("text", F.expr("CASE WHEN doc_id % 10 = 5 THEN concat(text, ' old') ELSE text END"))
    moved = edited.withColumn("path", F.expr("CASE WHEN doc_id % 10 = 7 THEN concat('old/', path) ELSE path END"))
    old = moved.select("path", F.length("text").cast("bigint").alias("size"), F.col("doc_id").cast("double").alias("mtime"), F.col("doc_id").alias("inode"), F.md5("text").alias("hash"))
    return old, new


# The same versions for DuckDB.
_VERSIONS = f"""
n AS (SELECT {PATH} AS path, length(text) AS size, CAST(doc_id AS DOUBLE) AS mtime, doc_id AS inode, md5(text) AS hash FROM documents),
o AS (SELECT CASE WHEN doc_id % 10 = 7 THEN concat('old/', path) ELSE path END AS path, length(text) AS size, CAST(doc_id AS DOUBLE) AS mtime, doc_id AS inode, md5(text) AS hash
  FROM (SELECT doc_id, {PATH} AS path, CASE WHEN doc_id % 10 = 5 THEN concat(text, ' old') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3)),
added AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM o)),
removed AS (SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)),
modified AS (SELECT n.path FROM n JOIN o ON n.path = o.path WHERE (n.size <> o.size OR n.mtime <> o.mtime OR n.inode IS DISTINCT FROM o.inode) AND n.hash <> o.hash)"""

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{_WS}+|{_WS}+$', '', 'g')"


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- scans and ignore rules ----------------------------------------------------------------------

_EXTENSIONS = ", ".join(f"'{e}'" for e in LANGUAGE_OF_EXTENSION)


@query(f"SELECT doc_id, path, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS extension, regexp_extract(path, '[^/]*$') AS name FROM (SELECT doc_id, {PATH} AS path FROM documents) WHERE NOT regexp_matches(path, '(^|/)\\.') AND lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ({_EXTENSIONS})")
def scan_filter_ext_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _docs(spark, sf_dir).where(~tx.is_hidden(path) & ignore.supported(path)).select("doc_id", "path", tx.extension(path).alias("extension"), tx.base_name(path).alias("name"))


@query(f"WITH p AS (SELECT doc_id, string_split({PATH}, '/') AS parts FROM documents) SELECT doc_id, CAST(i AS INT) AS depth, array_to_string(parts[1:i], '/') AS ancestor FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM p)")
def ancestors_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.ancestors(F.col("path"))).alias("depth", "ancestor"))


def _rules_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(r.dir)}, {r.ordinal}, {quoted(r.regex)}, {r.negated}, {r.dir_only})" for r in _rules())


@query(f"""
WITH rules(dir, ordinal, regex, negated, dir_only) AS (VALUES {_rules_sql()}),
p AS (SELECT doc_id, {PATH} AS path FROM documents),
x AS (SELECT doc_id, path, array_to_string(string_split(path, '/')[1:i], '/') AS prefix FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p)),
m AS (SELECT x.doc_id, x.path, x.prefix, arg_max(r.negated, r.ordinal) AS negated FROM x JOIN rules r
  ON (r.dir = '' OR starts_with(x.prefix, concat(r.dir, '/'))) AND (NOT r.dir_only OR x.prefix <> x.path) AND regexp_matches(CASE WHEN r.dir = '' THEN x.prefix ELSE substr(x.prefix, length(r.dir) + 2) END, r.regex)
  GROUP BY ALL)
SELECT doc_id, path FROM p WHERE path NOT IN (SELECT path FROM m WHERE NOT negated)""")
def ignore_last_match_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "path")
    return docs.join(ignore.ignored_paths(docs, ignore.rules_frame(spark, _rules())), "path", "left_anti").select("doc_id", "path")


@query(f"SELECT CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in LANGUAGE_OF_EXTENSION.items()) + f" END AS language, count(*) AS files FROM (SELECT {PATH} AS path FROM documents) GROUP BY ALL")
def language_of_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(ignore.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


# --- snapshot diff -------------------------------------------------------------------------------


@query(f"WITH {_VERSIONS} SELECT path FROM added")
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.path_changes(*_versions(spark, sf_dir)).where(F.col("change") == diff.ADDED).select("path")


@query(f"WITH {_VERSIONS} SELECT path FROM removed")
def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.path_changes(*_versions(spark, sf_dir)).where(F.col("change") == diff.REMOVED).select("path")


@query(f"WITH {_VERSIONS} SELECT path FROM modified")
def diff_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.path_changes(*_versions(spark, sf_dir)).where(F.col("change") == diff.MODIFIED).select("path")


@query(f"""WITH {_VERSIONS},
gone AS (SELECT max(path) AS path FROM removed WHERE hash IN (SELECT hash FROM added) GROUP BY hash)
SELECT path, 'added' AS change FROM added WHERE hash NOT IN (SELECT hash FROM removed)
UNION ALL SELECT path, 'removed' FROM removed WHERE path NOT IN (SELECT path FROM gone)
UNION ALL SELECT path, 'modified' FROM modified""")
def diff_rename_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.suppressed(*_versions(spark, sf_dir))


_RENAMES = """
e0 AS (SELECT a.path, min(r.path) AS old_path, a.hash FROM added a JOIN removed r ON a.hash = r.hash AND a.inode = r.inode GROUP BY ALL),
e AS (SELECT min(path) AS path, old_path FROM e0 GROUP BY old_path, hash),
ra AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM added WHERE path NOT IN (SELECT path FROM e)),
rr AS (SELECT path AS old_path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM removed WHERE path NOT IN (SELECT old_path FROM e)),
renamed AS (SELECT path, old_path FROM e UNION ALL SELECT ra.path, rr.old_path FROM ra JOIN rr USING (hash, k))"""


@query(f"""WITH {_VERSIONS}, {_RENAMES}
SELECT path, 'renamed' AS change, old_path FROM renamed
UNION ALL SELECT path, 'added', NULL FROM added WHERE path NOT IN (SELECT path FROM renamed)
UNION ALL SELECT path, 'removed', NULL FROM removed WHERE path NOT IN (SELECT old_path FROM renamed)
UNION ALL SELECT path, 'modified', NULL FROM modified""")
def diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changes(*_versions(spark, sf_dir))


@query(f"""WITH {_VERSIONS}, {_RENAMES}
SELECT path, 'add' AS action FROM (SELECT path FROM added WHERE path NOT IN (SELECT path FROM renamed) UNION SELECT path FROM modified)
UNION ALL SELECT path, 'remove' FROM (SELECT path FROM removed WHERE path NOT IN (SELECT old_path FROM renamed) UNION SELECT path FROM modified)""")
def diff_to_add_to_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.changes(*_versions(spark, sf_dir))
    return diff.to_add(found).withColumn("action", F.lit("add")).unionByName(diff.to_remove(found).withColumn("action", F.lit("remove")))


@query(f"""WITH {_VERSIONS}
SELECT n.path, n.size, n.mtime, n.inode, CASE WHEN n.size = o.size AND n.mtime = o.mtime AND n.inode IS NOT DISTINCT FROM o.inode THEN o.hash ELSE n.hash END AS hash FROM n LEFT JOIN o ON n.path = o.path""")
def snapshot_records_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    content = _docs(spark, sf_dir).select("path", F.encode("text", "UTF-8").alias("content"))
    return diff.records(new.drop("hash"), old, content)


# --- chunking ------------------------------------------------------------------------------------

_BLOCKS = f"""
l AS (SELECT doc_id, {PATH} AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents),
m AS (SELECT *, length(line) + CASE WHEN i < n - 1 THEN 1 ELSE 0 END AS len, {_stripped('line')} = '' AS blank FROM l),
r(doc_id, i, len, blank, block) AS (
  SELECT doc_id, i, len, blank, 0 FROM m WHERE i = 0
  UNION ALL
  SELECT m.doc_id, m.i, CASE WHEN r.len + m.len > {SIZE} AND NOT r.blank THEN m.len ELSE r.len + m.len END,
    CASE WHEN r.len + m.len > {SIZE} AND NOT r.blank THEN m.blank ELSE r.blank AND m.blank END, CASE WHEN r.len + m.len > {SIZE} AND NOT r.blank THEN r.block + 1 ELSE r.block END
  FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1),
b AS (SELECT m.doc_id, m.path, CAST(r.block AS INT) AS part_index, {_stripped("string_agg(m.line, chr(10) ORDER BY m.i)")} AS content, CAST(min(m.i) + 1 AS INT) AS start_line, CAST(max(m.i) + 1 AS INT) AS end_line
  FROM m JOIN r ON m.doc_id = r.doc_id AND m.i = r.i GROUP BY ALL),
blocks AS (SELECT * FROM b WHERE content <> '')"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.packed(_docs(spark, sf_dir), ["doc_id", "path"], "text", SIZE)


@query(f"WITH RECURSIVE {_BLOCKS} SELECT doc_id, part_index, content, start_line, end_line FROM blocks")
def chunk_greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).drop("path")


@query(f"""WITH RECURSIVE {_BLOCKS}, p AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY part_index) AS before FROM blocks)
SELECT doc_id, part_index, CASE WHEN before IS NULL THEN content ELSE concat(right(before, {OVERLAP}), chr(10), content) END AS content,
  CASE WHEN before IS NULL THEN start_line ELSE CAST(greatest(1, start_line - len(string_split(right(before, {OVERLAP}), chr(10))) + CASE WHEN right(before, 1) = chr(10) THEN 1 ELSE 0 END) AS INT) END AS start_line, end_line FROM p""")
def chunk_overlap_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlapped(_blocks(spark, sf_dir).drop("path"), ["doc_id"], OVERLAP)


@query(f"WITH RECURSIVE {_BLOCKS} SELECT doc_id, part_index, md5(concat_ws(chr(31), path, 'text', '', concat('text-block-', part_index))) AS id FROM blocks")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("doc_id", "part_index", chunking.text_block_id(F.col("path"), F.col("part_index")).alias("id"))


@query("""SELECT source_id, target_id, 'CONTINUES' AS edge_type FROM (SELECT concat(conv_id, ':', turn) AS source_id, lead(concat(conv_id, ':', turn)) OVER (PARTITION BY conv_id ORDER BY turn) AS target_id FROM conversations) WHERE target_id IS NOT NULL""")
def continues_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.expr("concat(conv_id, ':', turn)").alias("id"), F.col("conv_id").alias("node_key"), F.col("turn").alias("part_index"))
    return chunking.continues_edges(turns)


@query("""SELECT event_id, CASE WHEN k = 0 THEN event_type ELSE concat(event_type, '#', k) END AS identifier FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS k FROM events)""")
def occurrence_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.occurrence_names(_table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_type", ["ts", "event_id"]).select("event_id", "identifier")


@query(f"""SELECT lang, count(*) AS texts, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(*) FILTER (WHERE {_stripped('text')} = '') AS blank,
  CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '#') OR starts_with(x, '//')))) AS BIGINT) AS comment_lines FROM documents GROUP BY lang""")
def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = tx.lines(F.col("text"))
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("texts"), F.sum(F.size(each)).alias("lines"), F.count_if(tx.is_blank(F.col("text"))).alias("blank"),
        F.sum(F.size(F.filter(each, lambda x: x.rlike("^(?:#|//)")))).alias("comment_lines"),
    )


# --- search --------------------------------------------------------------------------------------

_TERMS = ", ".join(f"'{t}'" for t in search.query_terms(QUERY))


def _bm25_sql(text: str = "text", source: str = "documents", name: str = "bm25") -> str:
    return f"""
{name}_d AS (SELECT doc_id AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS t FROM {source} WHERE {text} IS NOT NULL),
{name}_p AS (SELECT id, len(t) AS n, term, len(list_filter(t, lambda x: x = term)) AS tf FROM (SELECT id, t, unnest([{_TERMS}]) AS term FROM {name}_d) WHERE list_contains(t, term)),
{name}_s AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_n AS (SELECT count(*) AS texts FROM {name}_d),
{name} AS (SELECT id, round(sum(ln((texts - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 256.0::DOUBLE)))), 6) AS score
  FROM {name}_p JOIN {name}_s USING (term), {name}_n GROUP BY id),
{name}_top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM {name} ORDER BY score DESC, id LIMIT {TOP})"""


_DENSE = f"""
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
dense AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q),
dense_top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM dense ORDER BY score DESC, id LIMIT {TOP})"""


def _bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.bm25_scores(_table(spark, sf_dir, "documents"), "doc_id", "text", QUERY), TOP)


def dense_top(spark: SparkSession, sf_dir: str, documented: bool = False) -> DataFrame:
    """The best of the vectors, or of those that stand for documented chunks: labels has their ids."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select("embedding").head()  # the query's vector: one row
    held = vectors.join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi") if documented else vectors
    return search.top(search.dense_scores(held, "vec_id", "embedding", search.vector_literal(asked[0])), TOP)


@query(f"WITH {_bm25_sql()} SELECT id, score, CAST(rank AS INT) AS rank FROM bm25_top")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25_top(spark, sf_dir)


@query(f"WITH {_DENSE} SELECT id, score, CAST(rank AS INT) AS rank FROM dense_top")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_top(spark, sf_dir)


@query("SELECT doc_id AS chunk_id, 'text' AS field, term, CAST(count(*) AS INT) AS tf, doc_len FROM (SELECT doc_id, unnest(t) AS term, CAST(len(t) AS INT) AS doc_len FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)) GROUP BY ALL")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_table(spark, sf_dir, "documents"), "doc_id", "text", "text")


def layers_top(spark: SparkSession, sf_dir: str, english: bool) -> DataFrame:
    """The best of all documents from postings in layers; those of the query's words are kept in the session's shared folder while the search reads them."""
    docs, asked = _table(spark, sf_dir, "documents"), search.query_terms(QUERY, english)
    held = sparse_index.layered(search.postings(docs, "doc_id", "text", "text", english).where(F.col("term").isin(*asked)))
    if spark.conf.get("spark.checkpoint.dir", None):
        held = held.checkpoint()
    return search.top(sparse_index.best(held, asked, docs.where("text IS NOT NULL").count(), TOP, search.DIGITS), TOP)


@query(f"WITH {_bm25_sql()} SELECT id, score, CAST(rank AS INT) AS rank FROM bm25_top")
def bm25_layers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers_top(spark, sf_dir, False)


def _fused_sql(branches: list[str], threshold: float) -> str:
    rows = " UNION ALL ".join(f"SELECT id, rank FROM {b}" for b in branches)
    return f"fused AS (SELECT id, round(sum(1.0::DOUBLE / ({RRF_K} + rank)), 6) AS score FROM ({rows}) GROUP BY id HAVING round(sum(1.0::DOUBLE / ({RRF_K} + rank)), 6) >= {threshold} ORDER BY score DESC, id LIMIT {TOP})"


@query(f"WITH {_DENSE}, {_bm25_sql()}, {_fused_sql(['dense_top', 'bm25_top'], 0.05)} SELECT id, score FROM fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse([dense_top(spark, sf_dir), _bm25_top(spark, sf_dir)], RRF_K, TOP, 0.05)


_FIRST_LINES = "(SELECT doc_id, string_split(text, chr(10))[1] AS doc FROM documents)"


@query(f"WITH {_DENSE}, {_bm25_sql()}, {_bm25_sql('doc', _FIRST_LINES, 'bm25_doc')}, dense_doc_top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM dense WHERE id IN (SELECT doc_id FROM labels) ORDER BY score DESC, id LIMIT {TOP}), {_fused_sql(['dense_top', 'bm25_top', 'dense_doc_top', 'bm25_doc_top'], 0.0)} SELECT id, score FROM fused")
def hybrid_rrf_4way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and words of texts, and those of documentation, each ranked by itself."""
    firsts = _table(spark, sf_dir, "documents").select("doc_id", F.element_at(tx.lines(F.col("text")), 1).alias("doc"))
    docs = search.top(search.bm25_scores(firsts, "doc_id", "doc", QUERY), TOP)
    return search.fuse([dense_top(spark, sf_dir), _bm25_top(spark, sf_dir), dense_top(spark, sf_dir, True), docs], RRF_K, TOP)


@query(f"""WITH {_bm25_sql()} SELECT coalesce(d.text, '') AS content, d.lang AS language, {PATH} AS relative_path, b.score FROM bm25_top b JOIN documents d ON d.doc_id = b.id""")
def result_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("content", "language", "relative_path", "score")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEARCH_RESULT rows of the best texts."""
    held = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("path").alias("relative_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return search.results(_bm25_top(spark, sf_dir).select("id", "score"), held)


@query("SELECT d.doc_id, coalesce(d.text, '') AS content, CASE WHEN l.quality IS NULL THEN 'unknown' ELSE concat('quality ', l.quality) END AS doc, coalesce(l.toxic, 0) AS flag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def payload_projection_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    filled = points.with_default_doc(joined.withColumn("doc", F.expr("concat('quality ', quality)")))
    return filled.select("doc_id", F.coalesce("text", F.lit("")).alias("content"), "doc", F.coalesce("toxic", F.lit(0)).alias("flag"))


# --- tables and graph ----------------------------------------------------------------------------


@query("SELECT doc_id AS id, source, md5(text) AS content FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, source, md5(concat(text, '!')) FROM documents WHERE doc_id % 4 = 0")
def point_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    new = docs.where("id % 4 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return points.upserted(docs.where("id % 8 <> 0"), new).select("id", "source", F.md5("text").alias("content"))


@query(f"SELECT doc_id, {PATH} AS relative_path FROM documents WHERE doc_id % 6 <> 1")
def point_delete_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return points.without_paths(docs.select("doc_id", F.col("path").alias("relative_path")), docs.where("doc_id % 6 = 1").select("path"))


@query("""SELECT concat('r', r_regionkey) AS source_id, concat('n', n_nationkey) AS target_id, 'PARENT_OF' AS edge_type FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('n', n_nationkey), concat('c', c_custkey), 'PARENT_OF' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent_chunk_id")
    nation = _table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent_chunk_id")
    customer = _table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS parent_chunk_id")
    return graph.parent_edges(region.unionByName(nation).unionByName(customer))


def _sales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, content) and edges: customers use orders, orders call parts."""
    customer = _table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS id", "c_name AS content")
    orders = _table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) AS id", "o_orderstatus AS content")
    part = _table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr("concat('p', p_partkey) AS id", "p_name AS content")
    uses = _table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) AS source_id", "concat('o', o_orderkey) AS target_id", "'USES' AS edge_type")
    calls = _table(spark, sf_dir, "lineitem").selectExpr("concat('o', l_orderkey) AS source_id", "concat('p', l_partkey) AS target_id", "'CALLS' AS edge_type")
    return customer.unionByName(orders).unionByName(part), uses.unionByName(calls)


_SALES = """
nodes AS (SELECT concat('c', c_custkey) AS id FROM customer UNION ALL SELECT concat('o', o_orderkey) FROM orders UNION ALL SELECT concat('p', p_partkey) FROM part WHERE p_partkey % 3 <> 0),
edges AS (SELECT DISTINCT source_id, target_id, edge_type FROM (
  SELECT concat('c', o_custkey) AS source_id, concat('o', o_orderkey) AS target_id, 'USES' AS edge_type FROM orders
  UNION ALL SELECT concat('o', l_orderkey), concat('p', l_partkey), 'CALLS' FROM lineitem) WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes))"""


@query(f"WITH {_SALES} SELECT * FROM edges")
def edge_upsert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sales(spark, sf_dir)
    return graph.upsert_edges(None, edges, nodes)


@query("SELECT id, event_type, event_id FROM (SELECT concat('u', user_id) AS id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def node_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _table(spark, sf_dir, "events").selectExpr("concat('u', user_id) AS id", "event_type", "event_id", "ts")
    return graph.last_by_id(seen, F.struct("ts", "event_id")).drop("ts")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN concat('new ', c_name) ELSE c_name END AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, concat('new ', c_name), NULL FROM customer WHERE c_custkey % 50 = 0")
def node_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    new = old.where("id % 2 = 0").selectExpr("id", "concat('new ', name) AS name").unionByName(old.where("id % 50 = 0").selectExpr("id + 1000000 AS id", "concat('new ', name) AS name"))
    return graph.upsert_nodes(old, new)


@query(f"WITH {_SALES}, gone AS (SELECT id FROM nodes WHERE id LIKE '%7') SELECT source_id, target_id, edge_type FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def node_detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sales(spark, sf_dir)
    return graph.remove_nodes(nodes, graph.upsert_edges(None, edges, nodes), nodes.where("id LIKE '%7'"))[1]


@query("SELECT concat('c', c_custkey) AS id, c_name AS content FROM customer WHERE c_custkey % 25 = 0")
def node_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _sales(spark, sf_dir)
    return graph.get_nodes(nodes, _table(spark, sf_dir, "customer").where("c_custkey % 25 = 0").selectExpr("concat('c', c_custkey) AS id"))


_HOPS = f"""{_SALES},
seeds AS (SELECT id FROM nodes WHERE id IN ('c7', 'c11', 'p4')),
pairs AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
h1 AS (SELECT DISTINCT b AS id FROM pairs WHERE a IN (SELECT id FROM seeds)),
h2 AS (SELECT DISTINCT b AS id FROM pairs WHERE a IN (SELECT id FROM h1)),
dist AS (SELECT id, CAST(min(d) AS INT) AS distance FROM (SELECT id, 0 AS d FROM seeds WHERE id IN (SELECT a FROM pairs) UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id)"""


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c7",), ("c11",), ("p4",)], "id string")


@query(f"WITH {_HOPS} SELECT * FROM dist")
def neighbors_nodes_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sales(spark, sf_dir)
    return graph.neighbour_nodes(graph.Upserted(edges, nodes), _seeds(spark), 2)


@query(f"WITH {_HOPS} SELECT source_id, target_id, edge_type FROM edges WHERE source_id IN (SELECT id FROM dist WHERE distance <= 1) OR target_id IN (SELECT id FROM dist WHERE distance <= 1)")
def neighbors_edges_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sales(spark, sf_dir)
    return graph.neighbour_edges(graph.Upserted(edges, nodes), _seeds(spark), 2)


@query(f"""WITH {_HOPS},
ranked(id, score) AS (VALUES ('c7', 0.5::DOUBLE), ('c11', 0.25::DOUBLE), ('p4', 0.125::DOUBLE)),
u AS (SELECT id, score, 0 AS distance FROM ranked UNION ALL SELECT id, 0.0::DOUBLE, distance FROM dist WHERE id NOT IN (SELECT id FROM ranked))
SELECT id, score, CAST(row_number() OVER (ORDER BY distance, score DESC, id) AS INT) AS position FROM u ORDER BY distance, score DESC, id LIMIT 25""")
def expand_with_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sales(spark, sf_dir)
    ranked = spark.createDataFrame([("c7", 0.5), ("c11", 0.25), ("p4", 0.125)], "id string, score double")
    return graph.expand(ranked, graph.Upserted(edges, nodes), 2, 25)


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts as chunks: candidates and definitions."""
    docs = _docs(spark, sf_dir).selectExpr("concat('d', doc_id) AS chunk_id", "lang AS language", "source AS file_path", "regexp_extract_all(lower(text), '[a-z]{6,}', 0) AS w", "doc_id")
    owner = "CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 3 = 1 THEN 'B' END AS owner"
    # The first word by itself, so that a text is read up to it only.
    first = "regexp_extract(lower(text), '[a-z]{6,}', 0)"
    known = _docs(spark, sf_dir).where(f"{first} <> ''").selectExpr("concat('d', doc_id) AS chunk_id", "lang AS language", f"{first} AS name", owner, "source AS file_path")
    asked = docs.selectExpr("chunk_id", "language", "explode(array_distinct(w)) AS name", "CASE WHEN doc_id % 2 = 0 THEN 'call' ELSE 'identifier' END AS kind", owner, "file_path")
    return asked, known


@query("""WITH d AS (SELECT concat('d', doc_id) AS chunk_id, lang, source, regexp_extract_all(lower(text), '[a-z]{6,}') AS w, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 3 = 1 THEN 'B' END AS owner FROM documents),
k AS (SELECT chunk_id, lang, w[1] AS name, owner, source FROM d WHERE len(w) > 0),
a AS (SELECT DISTINCT chunk_id, lang, unnest(w) AS name, CASE WHEN doc_id % 2 = 0 THEN 'CALLS' ELSE 'USES' END AS edge_type, owner, source FROM d)
SELECT DISTINCT a.chunk_id AS source_id, k.chunk_id AS target_id, edge_type FROM a JOIN k ON a.lang = k.lang AND a.name = k.name AND a.chunk_id <> k.chunk_id AND a.source <> k.source AND (a.owner IS NULL OR k.owner IS NULL OR a.owner = k.owner)""")
def symbol_reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's rarer words refer to the texts whose first word they are."""
    # A text's words are made distinct where they are read.
    return references.reference_edges(*_named(spark, sf_dir), once=True)


_SYMBOLS = """docs AS (SELECT concat('d', doc_id) AS chunk_id, lang, source, regexp_extract_all(lower(text), '[a-z]{6,}') AS w, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 3 = 1 THEN 'B' END AS owner FROM documents),
k AS (SELECT chunk_id, lang, w[1] AS name, owner, source FROM docs WHERE len(w) > 0),
a AS (SELECT DISTINCT chunk_id, lang, unnest(w) AS name, owner, source FROM docs),
e AS (SELECT DISTINCT a.chunk_id AS x, k.chunk_id AS y FROM a JOIN k ON a.lang = k.lang AND a.name = k.name AND a.chunk_id <> k.chunk_id AND a.source <> k.source AND (a.owner IS NULL OR k.owner IS NULL OR a.owner = k.owner)),
p AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
seeds AS (SELECT chunk_id AS id FROM docs WHERE doc_id IN (3, 7))"""


@query(f"""WITH {_SYMBOLS},
h1 AS (SELECT DISTINCT y AS id FROM p WHERE x IN (SELECT id FROM seeds)),
h2 AS (SELECT DISTINCT y AS id FROM p WHERE x IN (SELECT id FROM h1))
SELECT id, CAST(min(d) AS INT) AS distance FROM (SELECT id, 0 AS d FROM seeds WHERE id IN (SELECT x FROM p) UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""")
def symbol_neighbors_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops over the references of symbol_reference_join, factored by names: no edge is listed."""
    asked, known = _named(spark, sf_dir)
    none = spark.createDataFrame([], "source_id string, target_id string, edge_type string")
    seeds = spark.createDataFrame([("d3",), ("d7",)], "id string")
    return graph.neighbour_nodes(none, seeds, 2, references.Symbols(asked, known))


@query(f"SELECT doc_id, md5(concat_ws(chr(31), {PATH}, 'text', '', 'whole')) AS id FROM documents")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunk_id(F.col("path"), F.lit("text"), F.lit(None).cast("string"), F.lit("whole")).alias("id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents searched by words, embeddings by vector, fused: hybrid_rrf with the chunk count of each hit."""
    counted = _blocks(spark, sf_dir).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunks"))
    return hybrid_rrf(spark, sf_dir).join(counted, "id", "left").orderBy(F.desc("score"), "id")
