"""A Merkle manifest of a dataset: digests up to one root, a proof for every row, and its check.

Leaves stand in order in groups, ARITY consecutive nodes have one parent, and the groups' roots are
the leaves of one more tree. Places in a group are found without sorting it in one task: rows are
dealt by ranges of (group, order), numbered within a range, and shifted by what lies before.

The trees are built by events, as combineByKey does it. A digest that arrives at its parent is put
into one of the parent's slots; how many children it has follows from the size of its level alone, so
a parent knows when the last has come, gives its own digest, and that arrives at its parent in turn.
Rows are dealt by the ancestor LEVELS_A_ROUND levels up, so a task carries each run of leaves that far;
the frontier it leaves open is dealt anew by an ancestor as many levels further up. Rounds grow with
the logarithm of the rows, each on a few thousandths of the round before.

Nodes keep their children's digests (the reverse links). Paths go down along them from the root, a join
for each level on a sixteenth of the rows of the next, and meet the leaves at their parents.

Defined results: nulls are written "-". Rows order by key, nulls first, and by leaf where keys are
equal. A null group comes first and differs from an empty one. A group of one leaf has that leaf as
its root; an only group's root is the root. A row without siblings has the proof of an empty text.
Rows that repeat are leaves of their own. An empty table gives an empty one. Texts of any length are
hashed whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import Scratch, fold_of, mapped, table, written

ARITY, BITS = 16, 4
#: Levels that a task may carry a digest up; ARITY to this power are the events that must meet in one task.
LEVELS_A_ROUND = 3
#: Rows that a task sorts, at most (more tasks are used where the session has more shuffle partitions).
RANGE_ROWS = 2_000_000
HEX = 64  # digits of a digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: run: the children's digests, one after the other; null for a digest that waits for its parent.
NODE = "grp string, size bigint, level int, place bigint, digest string, run string"
PATH = "array<struct<run:string,slot:int>>"


def digest(parts: list[Column]) -> Column:
    """H of the parts, each "-" if null, else its count of UTF-8 bytes, ":" and itself."""
    texts = [p.cast("string") for p in parts]
    told = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in texts]
    return F.sha2(F.concat(*told), 256)


def level_size(size: int, level: int) -> int:
    return -(-size // ARITY**level)


def depth(size: int) -> int:
    """Levels above the leaves of a group of so many."""
    level = 0
    while level_size(size, level) > 1:
        level += 1
    return level


def placed(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """df with place (from 0, by order within grp, nulls first) and size (of grp)."""
    n_ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS + 1)
    by = [F.col(c).asc_nulls_first() for c in ["grp", *order]]
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n_ranges, *by).sortWithinPartitions(*by).select("*", F.shiftright(at, 33).alias("_range"), at.alias("_at"))
    rows = scratch.written(ranged, "merkle-ranges")
    # A row for each range and for each group, about; a group's window holds its ranges.
    counts = rows.groupBy("grp", "_range").agg(F.min("_at").alias("_from"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("_range")) - F.col("n")
    shifts = counts.select(F.col("grp").alias("_grp"), F.col("_range").alias("_r"), (before - F.col("_from")).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("size"))
    found = rows.join(shifts, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_range") == F.col("_r")))
    return found.withColumn("place", F.col("_at") + F.col("shift")).drop("_grp", "_r", "shift", "_range", "_at")


def arrivals(batches: Iterator[pa.RecordBatch], upto: int) -> Iterator[pa.RecordBatch]:
    """NODE rows of the digests (grp, size, level, place, digest) that arrive: parents of level upto or below that have all their children, and, with a null run, the digests that still wait for a parent."""
    names = [x.split()[0] for x in NODE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    waiting: dict[tuple[str | None, int, int, int], dict[int, str]] = {}
    out: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for grp, size, level, place, told in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            while level_size(size, level) > 1:
                if level >= upto:
                    out.append((grp, size, level, place, told, None))
                    break
                parent = (grp, size, level, place // ARITY)
                slots = waiting.setdefault(parent, {})
                slots[place % ARITY] = told
                if len(slots) < min(ARITY, level_size(size, level) - parent[3] * ARITY):
                    break
                del waiting[parent]
                run = "".join(slots[i] for i in sorted(slots))
                level, place, told = level + 1, parent[3], hashlib.sha256(run.encode()).hexdigest()
                out.append((grp, size, level, place, told, run))
        if len(out) >= 4096:
            yield packed()
    out += [(grp, size, level, place * ARITY + slot, told, None) for (grp, size, level, place), slots in waiting.items() for slot, told in slots.items()]
    yield packed()


def tree(leaves: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """NODE rows of all parents over leaves (grp, size, place, digest); most: the largest size."""
    events = leaves.select("grp", "size", F.lit(0).alias("level"), "place", "digest").where("size > 1")
    rounds, upto = [], 0
    while upto < depth(most):
        upto += LEVELS_A_ROUND
        ancestor = F.expr(f"shiftright(place, {BITS} * ({upto} - level))")
        dealt = events.repartition("grp", ancestor).sortWithinPartitions("grp", "level", "place")
        done = scratch.written(mapped(dealt, lambda batches, upto=upto: arrivals(batches, upto), NODE), "merkle-nodes")
        rounds.append(done.where("run IS NOT NULL"))
        events = done.where("run IS NULL").drop("run")
    if not rounds:
        return leaves.sparkSession.createDataFrame([], NODE)
    return reduce(DataFrame.unionByName, rounds)


def is_root(level: int) -> Column:
    return F.col("size") <= ARITY**level


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """grp, digest of each group's root."""
    top = F.expr(f"size <= shiftleft(1L, {BITS} * level)")
    return nodes.where(top).select("grp", "digest").unionByName(leaves.where("size = 1").select("grp", "digest"))


def with_paths(leaves: DataFrame, nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """leaves with what above (grp, path, and more) holds of their group, and path: the run and slot at each level up to the group's root, then those of above."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumnRenamed("grp", "_grp")
    same = F.col("grp").eqNullSafe(F.col("_grp"))
    step = F.array(F.struct(F.col("_run").alias("run"), (F.col("place") % ARITY).cast("int").alias("slot")))

    def down(rows: DataFrame, level: int, parents: DataFrame | None) -> DataFrame:
        own = [c for c in rows.columns if c != "level"]
        at_top = rows.where(is_root(level)).join(above, same).select(*own, "path", *more)
        if parents is None:
            return at_top
        up = parents.select(F.col("grp").alias("_grp"), F.col("place").alias("_place"), F.col("run").alias("_run"), F.col("path").alias("_path"), *more)
        joined = rows.where(~is_root(level)).join(up, same & (F.shiftright("place", BITS) == F.col("_place")))
        return at_top.unionByName(joined.select(*own, F.concat(step, F.col("_path")).alias("path"), *more))

    parents = None
    for level in range(depth(most), 0, -1):
        parents = down(nodes.where(F.col("level") == level).select("grp", "size", "place", "run"), level, parents)
    return down(leaves, 0, parents)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from leaf and its path's siblings."""
    cut = lambda x, found: F.concat(F.substring(x["run"], F.lit(1), HEX * x["slot"]), found, F.substring(x["run"], HEX * (x["slot"] + 1) + 1, F.lit(HEX * ARITY)))
    return F.aggregate(path, leaf, lambda found, x: F.sha2(cut(x, found), 256))


def proof(path: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    others = F.transform(path, lambda x: F.concat(F.substring(x["run"], F.lit(1), HEX * x["slot"]), F.substring(x["run"], HEX * (x["slot"] + 1) + 1, F.lit(HEX * ARITY))))
    return F.sha2(F.array_join(others, ""), 256)


def manifest(df: DataFrame, key: str, group: str, leaf: Column, more: dict[str, Column] | None = None) -> DataFrame:
    """Per row of df: key, leaf, more's columns, subroot, root, path (for folded() and proof())."""
    scratch = Scratch(df.sparkSession)
    named = {f"_{i}": c for i, c in enumerate((more or {}).values())}
    slim = df.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), leaf.alias("digest"), *(c.alias(n) for n, c in named.items()))
    slim = scratch.written(slim.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    # _row tells equal rows apart, so that many of them don't make one range; which is which doesn't show.
    leaves = written(placed(slim, ["key", "digest", "_row"], scratch).drop("_row"), "merkle-placed")
    most = leaves.agg(F.max("size")).head()[0] or 0
    kept = Scratch(df.sparkSession)  # the result reads these, and they go with the session
    nodes = tree(leaves, most, kept)
    none = F.lit(None).cast("string")
    tops = kept.written(placed(scratch.written(roots(leaves, nodes).select(none.alias("grp"), F.col("grp").alias("key"), "digest"), "merkle-roots"), ["key"], scratch), "merkle-tops")
    n_groups = tops.count()
    upper = tree(tops, n_groups, kept)
    root = roots(tops, upper).select("grp", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = with_paths(tops.select("grp", "size", "place", "key", F.col("digest").alias("subroot")), upper, root, n_groups).select(F.col("key").alias("grp"), "path", "subroot", "root")
    above = kept.written(above, "merkle-above")
    scratch.close()
    out = with_paths(leaves, nodes, above, most)
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), *(F.col(n).alias(c) for n, c in zip(named, more or {}, strict=True)), "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by source, and the check of rows some of which were altered."""
    altered = F.when(fold_of(F.col("doc_id"), 5) == 0, digest([F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]))
    told = manifest(table(spark, sf_dir, "documents"), "doc_id", "source", digest([F.col(c) for c in FIELDS]), {"altered": altered})
    checked = told.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, leaves: str, n: int) -> str:
    """CTEs of a tree over leaves (grp, place, size, d): {name}{k} its nodes of level k, {name}r{k} runs of level k by parent."""
    out = [f"{name}0 AS (SELECT grp, place, size, d FROM {leaves})"]
    for k in range(n):
        out.append(f"{name}r{k} AS (SELECT grp, place // {ARITY} AS place, (size + {ARITY - 1}) // {ARITY} AS size, string_agg(d, '' ORDER BY place) AS run FROM {name}{k} WHERE size > 1 GROUP BY grp, place // {ARITY}, size)")
        out.append(f"{name}{k + 1} AS (SELECT grp, place, size, sha256(run) AS d FROM {name}r{k})")
    out.append(f"{name}t AS (" + " UNION ALL ".join(f"SELECT grp, d FROM {name}{k} WHERE size = 1" for k in range(n + 1)) + ")")
    return ",\n".join(out)


def oracle(levels: int = 6, upper_levels: int = 4) -> str:
    """DuckDB SQL for op11_merkle_manifest, for groups of ARITY ** levels rows at most."""
    h = lambda text: "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END" for c in [*FIELDS[:-1], text]) + "))"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    table_value = "list_reduce(list_prepend(i, range(8)), LAMBDA c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    cut = lambda run, slot, with_what: f"concat(left({run}, CAST({HEX} * ({slot}) AS INTEGER)), {with_what}, substr({run}, CAST({HEX} * ({slot} + 1) + 1 AS INTEGER)))"
    joins, sib, steps, found = "", [], [], "given"
    runs = [(f"g{k}", f"gr{k}", "b.grp", f"b.place // {ARITY ** k}") for k in range(levels)] + [(f"u{k}", f"ur{k}", "NULL", f"b.top // {ARITY ** k}") for k in range(upper_levels)]
    for i, (alias, cte, grp, place) in enumerate(runs):
        joins += f" LEFT JOIN {cte} AS {alias} ON {alias}.grp IS NOT DISTINCT FROM {grp} AND {alias}.place = ({place}) // {ARITY}"
        sib.append(f"CASE WHEN {alias}.run IS NULL THEN '' ELSE {cut(f'{alias}.run', f'({place}) % {ARITY}', chr(39) * 2)} END")
        steps.append(f"s{i} AS (SELECT *, CASE WHEN run{i} IS NULL THEN {found} ELSE sha256({cut(f'run{i}', f'slot{i}', found)}) END AS f{i} FROM {f's{i - 1}' if i else 'p'})")
        found = f"f{i}"
    held = ", ".join(f"{alias}.run AS run{i}, ({place}) % {ARITY} AS slot{i}" for i, (alias, _, _, place) in enumerate(runs))
    return f"""
WITH RECURSIVE t8 AS (SELECT i, {table_value} AS v FROM range(256) AS r(i)),
ids AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT id, CAST(id AS VARCHAR) AS s, 1 AS pos, 4294967295 AS c FROM ids
  UNION ALL SELECT id, s, pos + 1, xor(c >> 8, v) FROM crc JOIN t8 ON t8.i = xor(c & 255, ord(s[pos])) WHERE pos <= length(s)),
hit AS (SELECT id FROM crc WHERE pos = length(s) + 1 AND xor(c, 4294967295) % 5 = 0),
l AS (SELECT doc_id, source, {h('text')} AS leaf, CASE WHEN hit.id IS NULL THEN {h('text')} ELSE {h(lowered)} END AS given FROM documents LEFT JOIN hit ON doc_id = hit.id),
g AS (SELECT source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size, leaf AS d, doc_id, given FROM l),
{_levels('g', 'g', levels)},
tops AS (SELECT CAST(NULL AS VARCHAR) AS grp, grp AS name, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, count(*) OVER () AS size, d FROM gt),
{_levels('u', 'tops', upper_levels)},
b AS (SELECT g.*, tops.d AS subroot, tops.place AS top FROM g JOIN tops ON g.grp IS NOT DISTINCT FROM tops.name),
p AS (SELECT b.doc_id, b.d AS leaf, b.given, b.subroot, ut.d AS root, sha256(concat({', '.join(sib)})) AS proof_sha256, {held} FROM b CROSS JOIN ut{joins}),
{', '.join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {found} AS folded_root, {found} = root AS verified FROM s{len(runs) - 1}
"""
