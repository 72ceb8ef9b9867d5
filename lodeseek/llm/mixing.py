"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down the tree domain - language - source by the weights of siblings. A node
that can't use its share (a source is read MAX_EPOCHS times at most) leaves the rest to its
siblings, by their weights, and only what a whole subtree can't use goes to the siblings of its
ancestors. A leaf's budget is met by whole epochs and then a prefix of one more, in an order that
the seed and the epoch fix: documents are taken while their tokens sum to what is left or less.

Everything is DataFrame functions. Domains and languages are listed in the weights (all others are
one), so their table is small and the driver deals it out; sources may be many: their level is
filled by rounds of one aggregation over the table of sources each. The prefix of a leaf is cut
without sorting the leaf: the order's keys are hashes, their first digits make buckets of bounded
size, and only the bucket in which the budget ends is sorted.

Defined results: null or blank texts have no tokens; a document without tokens is taken with the
prefix that it lies in. A null id, source or language counts as an empty one or as "other". Rows
that repeat share an order key and are taken or left together. Nothing is taken from an empty
table, or by a budget of 0. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import SPACE_CLASS, table, written

OTHER = "other"
#: Documents of a leaf that one task sorts, about.
BUCKET_ROWS = 4_096


@dataclass(frozen=True)
class Mix:
    """Weights need not sum to 1; they hold among the siblings that are there. All sources of a language weigh alike."""

    domains: dict[str, float] = field(default_factory=lambda: {"web": 0.30, "forum": 0.15, "books": 0.25, "reference": 0.28, OTHER: 0.02})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.40, "de": 0.20, "fr": 0.20, "es": 0.15, OTHER: 0.05})
    #: SQL for a row's domain; a stand-in, as documents has no such column: five sources in a row are a domain.
    domain: str = "CASE CAST(nullif(regexp_extract(source, '([0-9]{1,6})$', 1), '') AS INT) DIV 5 WHEN 0 THEN 'web' WHEN 1 THEN 'forum' WHEN 2 THEN 'books' WHEN 3 THEN 'reference' ELSE 'other' END"
    #: Tokens to take, as a share of all tokens.
    share: float = 0.5
    max_epochs: int = 2
    seed: int = 2024


LEAF = ["domain", "language", "leaf_source"]


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), f"[{SPACE_CLASS}]+"), "")).cast("long")


def with_leaf(df: DataFrame, mix: Mix, prefix: str = "") -> DataFrame:
    """df with its leaf's three columns, named with prefix."""
    listed = [x for x in mix.languages if x != OTHER]
    return df.withColumns({
        f"{prefix}domain": F.coalesce(F.expr(mix.domain), F.lit(OTHER)),
        f"{prefix}language": F.when(F.col("lang").isin(listed), F.col("lang")).otherwise(OTHER),
        f"{prefix}leaf_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
    })


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def fill(budget: float, siblings: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Deal budget to siblings (weight, capacity): by weight, what one can't hold goes to the others by weight."""
    out, left, free = {}, min(budget, sum(c for _, c in siblings.values())), dict(siblings)
    while free:
        level = left / (sum(w for w, _ in free.values()) or 1)
        full = [x for x, (w, c) in free.items() if c <= level * w]
        if not full:
            return out | {x: level * w for x, (w, _) in free.items()}
        for x in full:
            out[x] = free.pop(x)[1]
            left -= out[x]
    return out


def _literal_map(values: dict[tuple[str, str], float], name: str) -> Column:
    """Column: values by (domain, language); their number is bounded by the listed weights."""
    pairs = [x for (d, g), v in sorted(values.items()) for x in (F.lit(f"{d}\x1f{g}"), F.lit(float(v)))]
    return F.element_at(F.create_map(*pairs), F.concat_ws("\x1f", "domain", "language")).alias(name)


def budgets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """LEAF, tokens, rows, budget (long) from LEAF, tokens, rows (a row for each leaf)."""
    held = {(r[0], r[1]): float(r[2]) * mix.max_epochs for r in sizes.groupBy("domain", "language").agg(F.sum("tokens")).collect()}
    total = sum(held.values()) / mix.max_epochs
    domains = sorted({d for d, _ in held})
    by_domain = fill(float(int(mix.share * total)), {d: (mix.domains.get(d, mix.domains[OTHER]), sum(c for (x, _), c in held.items() if x == d)) for d in domains})
    groups = {(d, g): b for d in domains for g, b in fill(by_domain[d], {g: (mix.languages[g], c) for (x, g), c in sorted(held.items()) if x == d}).items()}
    capacity = F.col("tokens") * mix.max_epochs
    # Sources of a group fill up to a common level; each round finds those that are full below the level and raises it.
    level = dict.fromkeys(groups, 0.0)
    while groups:
        at = _literal_map(level, "level")
        full = capacity <= at
        sums = sizes.groupBy("domain", "language").agg(F.sum(F.when(full, capacity).otherwise(0)), F.count_if(~full)).collect()
        raised = {(d, g): (groups[d, g] - (held_full or 0)) / free if free else level[d, g] for d, g, held_full, free in sums}
        if all(raised[x] <= level[x] * (1 + 1e-12) for x in groups):
            break
        level = {x: max(level[x], raised[x]) for x in groups}
    if not groups:
        return sizes.withColumn("budget", F.lit(0).cast("long"))
    return sizes.withColumn("budget", F.floor(F.least(capacity.cast("double"), _literal_map(level, "level")) + 1e-6).cast("long"))


def plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """LEAF, tokens, budget, epochs (whole ones), cut: documents with an order key of cut or less are taken once more."""
    slim = written(with_leaf(docs.select("doc_id", "lang", "source", tokens(F.col("text")).alias("n_tokens")), mix).select("doc_id", "n_tokens", *LEAF), "mix-slim")
    sizes = written(slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    most = sizes.agg(F.max("rows")).head()[0] or 0
    digits = 0
    while most > BUCKET_ROWS * 16**digits:
        digits += 1
    epochs = F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(F.lit(0))
    leaves = written(budgets(sizes, mix).withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-budgets")
    # Spark broadcasts the leaves if the table is small, else it shuffles and splits skewed leaves.
    keyed = slim.join(leaves.where("rest > 0").select(*LEAF, "epochs", "rest"), LEAF).withColumn("key", order_key(mix, F.col("epochs"), F.col("doc_id")))
    bucket = F.substring("key", 1, digits) if digits else F.lit("")
    sums = keyed.groupBy(*LEAF, "rest", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    through = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    last = sums.withColumn("through", through).where(F.col("through") > F.col("rest")).groupBy(*LEAF).agg(F.min_by(F.struct("bucket", (F.col("through") - F.col("n")).alias("before")), "bucket").alias("b")).select(*LEAF, "b.bucket", "b.before")
    inside = keyed.withColumn("bucket", bucket).join(last, [*LEAF, "bucket"])
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key"))
    fits = inside.withColumn("running", running).groupBy(*LEAF).agg(F.max(F.when(F.col("running") <= F.col("rest"), F.col("key"))).alias("cut"))
    cuts = last.join(fits, LEAF, "left").select(*LEAF, F.coalesce("cut", "bucket").alias("cut"))
    return written(leaves.join(cuts, LEAF, "left").select(*LEAF, "tokens", "budget", "epochs", "cut"), "mix-plan")


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """docs' rows as often as the mix takes them, with _epoch (from 0) and the leaf's columns prefixed by _mix_."""
    mix = mix or Mix()
    leaves = plan(docs, mix).select(*(F.col(c).alias(f"_mix_{c}") for c in [*LEAF, "epochs", "cut"]))
    joined = with_leaf(docs, mix, "_mix_").join(leaves, [f"_mix_{c}" for c in LEAF])
    more = F.coalesce(order_key(mix, F.col("_mix_epochs"), F.col("doc_id")) <= F.col("_mix_cut"), F.lit(False)).cast("long")
    times = F.col("_mix_epochs") + more
    return joined.withColumn("_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>")))).drop("_mix_epochs", "_mix_cut")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, language, source, epoch of each document and time that the mix takes it."""
    taken = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return taken.select("doc_id", F.col("_mix_domain").alias("domain"), F.col("_mix_language").alias("language"), F.col("_mix_leaf_source").alias("source"), F.col("_epoch").alias("epoch"))


def _filled(name: str, source: str, parent: str, child: str, budget: str) -> str:
    """CTE: source (parent, child, w, cap, budget column of the parent) with got, each child's share. A child is full if the siblings, filled to its level, hold no more than the budget."""
    over = f"PARTITION BY {parent} ORDER BY cap / w"
    return f"""{name}_r AS (SELECT *, cap / w AS r, sum(cap) OVER ({over}) AS below, sum(w) OVER (PARTITION BY {parent}) - sum(w) OVER ({over}) AS above FROM {source}),
{name}_f AS (SELECT *, below + r * above <= least({budget}, sum(cap) OVER (PARTITION BY {parent})) * (1 + 1e-12) AS is_full FROM {name}_r),
{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE w * ({budget} - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {parent}), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY {parent}) END AS got FROM {name}_f)"""


def oracle(mix: Mix | None = None, documents: str = "documents", columns: str = "d.doc_id, d.domain, d.language, d.source, e AS epoch", words: str = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))") -> str:
    """DuckDB SQL for op8_mixing; each level is filled by a closed formula over sorted siblings."""
    mix = mix or Mix()
    case = lambda column, weights: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {weights[OTHER]} END"
    listed = ", ".join(f"'{x}'" for x in mix.languages if x != OTHER)
    domain = mix.domain.replace(" DIV ", " // ")
    return f"""
WITH t AS (SELECT *, CAST({words} AS BIGINT) AS n_tokens, {domain} AS domain, CASE WHEN lang IN ({listed}) THEN lang ELSE '{OTHER}' END AS language, coalesce(source, '') AS leaf FROM (SELECT * REPLACE (coalesce(source, '') AS source) FROM {documents})),
leaf AS (SELECT domain, language, leaf, sum(n_tokens) AS n, CAST(sum(n_tokens) * {mix.max_epochs} AS DOUBLE) AS cap, CAST(1 AS DOUBLE) AS w FROM t GROUP BY ALL),
g AS (SELECT domain, language, sum(cap) AS cap, CAST({case('language', mix.languages)} AS DOUBLE) AS w FROM leaf GROUP BY ALL),
d AS (SELECT domain, sum(cap) AS cap, CAST({case('domain', mix.domains)} AS DOUBLE) AS w, 1 AS root, CAST(floor({mix.share} * (SELECT sum(n) FROM leaf)) AS DOUBLE) AS b FROM g GROUP BY ALL),
{_filled('df', 'd', 'root', 'domain', 'b')},
g2 AS (SELECT g.*, df.got AS b FROM g JOIN df USING (domain)),
{_filled('gf', 'g2', 'domain', 'language', 'b')},
leaf2 AS (SELECT leaf.*, gf.got AS b FROM leaf JOIN gf USING (domain, language)),
{_filled('lf', 'leaf2', 'domain, language', 'leaf', 'b')},
b AS (SELECT domain, language, leaf, n, CAST(floor(least(got, cap) + 1e-6) AS BIGINT) AS budget FROM lf),
p AS (SELECT *, CASE WHEN n > 0 THEN budget // n ELSE 0 END AS whole FROM b),
k AS (SELECT t.*, p.whole, p.budget - p.whole * p.n AS rest, md5(concat('{mix.seed}:', p.whole, ':', coalesce(CAST(t.doc_id AS VARCHAR), ''))) AS key FROM t JOIN p USING (domain, language, leaf)),
d2 AS (SELECT *, CAST(whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, language, leaf ORDER BY key) <= rest THEN 1 ELSE 0 END AS BIGINT) AS times FROM k)
SELECT {columns} FROM (SELECT *, unnest(range(times)) AS e FROM d2) AS d
"""
