"""Quality rules: a decision list learned by sequential covering, run as ordered Spark conditionals.

Everything on the rows is DataFrame functions. Learning reads labelled statistics: counts of good
and bad rows by the bins of their features, aggregated by Spark. Rules (conjunctions of
thresholds, each saying "reject") are grown by information gain on one part of the counts, pruned
on the other, and kept only while they are precise; what no rule takes is kept.

Defined results: a null or blank text has no words (all counts 0) and fails the base rules. Texts
of any length are measured whole. Repeated rows give repeated results; an empty table gives an
empty one; without usable labels the list is empty and the base rules decide. Columns other than
the named ones are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import SPACE_CLASS, share_below, table, written

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Most labelled rows (in expectation) that the rules are learned from.
LABELLED_ROWS = 20_000
#: Thresholds tried for a feature.
CUTS = 24
MAX_RULES = 12
MAX_CONDITIONS = 3
#: Least share of rejected rows among those that a rule takes, and least rows that it takes, on the pruning part.
MIN_PRECISION = 0.9
MIN_TAKEN = 3

#: Feature name -> expression over the measures; ratios are to the words, lines or code points of the text.
FEATURES: dict[str, str] = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / word_chars",
    "digit_share": "n_digits / word_chars",
    "distinct_share": "n_distinct / n_words",
    "words": "n_words",
}


def _removed(text: str, pattern: str) -> str:
    return f"length({text}) - length(regexp_replace({text}, '{pattern}', ''))"


def measures(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep's columns, and the whole text's counts.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_upper,
    n_marks, n_digits, n_distinct, all long. No shuffle and no Python: a row's three-word windows
    are sorted within the row, so equal windows meet as neighbours.
    """
    space = "[" + SPACE_CLASS.replace("\\", "\\\\") + "]"
    worded = "[^" + SPACE_CLASS.replace("\\", "\\\\") + "]"
    base = df.select(*(F.col(k) for k in keep), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    split = base.selectExpr(
        *keep, "_text", f"array_remove(split(_text, '{space}+', -1), '') AS _w", f"filter(split(_text, '\\n', -1), x -> x RLIKE '{worded}') AS _lines"
    )
    # The k-th window is (word k, word k+1, word k+2, k); sorted, equal windows are neighbours.
    windows = split.selectExpr(
        *keep, "_text", "_w", "_lines",
        "sort_array(IF(size(_w) < 3, array(), arrays_zip(slice(_w, 1, greatest(size(_w) - 2, 0)), slice(_w, 2, greatest(size(_w) - 2, 0)), slice(_w, 3, greatest(size(_w) - 2, 0)), sequence(0, greatest(size(_w) - 3, 0))))) AS _s",
    )
    same = " AND ".join(f"p.`0`.`{i}` = p.`1`.`{i}`" for i in range(WINDOW))
    twice = windows.selectExpr(
        *keep, "_text", "_w", "_lines",
        f"filter(arrays_zip(slice(_s, 1, greatest(size(_s) - 1, 0)), slice(_s, 2, greatest(size(_s) - 1, 0))), p -> {same}) AS _twice",
    )
    starts = f"sort_array(array_distinct(flatten(transform(_twice, p -> array(p.`0`.`{WINDOW}`, p.`1`.`{WINDOW}`)))))"
    # Starts ascending: each covers WINDOW words, less what the one before has covered.
    covered = f"aggregate({starts}, named_struct('last', -{WINDOW}, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least({WINDOW}, x - a.last)), a -> a.n)"
    counts = {
        "n_words": "size(_w)", "word_chars": "length(array_join(_w, ''))", "n_symbols": _removed("_text", "[" + SYMBOLS + "]+"),
        "n_lines": "size(_lines)", "n_dup_lines": "size(_lines) - size(array_distinct(_lines))", "n_repeat_words": covered,
        "n_upper": _removed("_text", "\\\\p{Lu}+"), "n_marks": _removed("_text", "[!?]+"), "n_digits": _removed("_text", "[0-9]+"), "n_distinct": "size(array_distinct(_w))",
    }
    # A generator of one row: filters on the measures stay above it. Moved below, they would measure each text once more for each place where a measure is used.
    one = ", ".join(f"'{name}', CAST({x} AS BIGINT)" for name, x in counts.items())
    return twice.selectExpr(*keep, f"inline(array(named_struct({one})))")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def feature(name: str) -> Column:
    """The feature as a double; 0 where its denominator is 0."""
    return F.expr(f"CAST(coalesce(try_divide({', '.join(FEATURES[name].split(' / '))}), 0) AS DOUBLE)" if "/" in FEATURES[name] else f"CAST({FEATURES[name]} AS DOUBLE)")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # feature > cut, else feature <= cut
    cut: float

    def column(self) -> Column:
        return feature(self.name) > self.cut if self.above else feature(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def labelled_counts(measured: DataFrame, label: str, key: str) -> tuple[dict[str, list[float]], list[tuple]]:
    """The features' cuts, and rows (bin of each feature, grow bad, grow good, prune bad, prune good).

    At most one row for each labelled one, of which there are LABELLED_ROWS in expectation.
    """
    names = list(FEATURES)
    usable = measured.where(~base_failed() & F.col(label).isin(0, 1)).select(label, key, *(feature(n).alias(f"f_{n}") for n in names))
    shares = [(i + 0.5) / CUTS for i in range(CUTS)]
    # Cuts come from both classes, as the rare one may lie in a tail.
    quantiles = usable.groupBy(label).agg(*(F.percentile_approx(f"f_{n}", shares, 1000).alias(n) for n in names)).collect()
    cuts = {n: sorted({x for row in quantiles for x in (row[n] or [])}) for n in names}
    bins = [sum(((F.col(f"f_{n}") > c).cast("int") for c in cuts[n]), F.lit(0)).alias(n) for n in names]
    prune = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(3)) == 0
    count = lambda bad, part: F.count_if((F.col(label) == (0 if bad else 1)) & part)
    grouped = usable.select(*bins, label, key).groupBy(*names).agg(count(True, ~prune).alias("gb"), count(False, ~prune).alias("gg"), count(True, prune).alias("pb"), count(False, prune).alias("pg"))
    return cuts, [tuple(r) for r in grouped.collect()]


def cover(cuts: dict[str, list[float]], rows: list[tuple]) -> list[Rule]:
    """Sequential covering: grow a rule, prune it, drop what it takes, until a rule isn't good enough."""
    names = list(cuts)
    n = len(names)
    rules: list[Rule] = []

    def taken(row: tuple, tests: list[tuple[int, bool, int]]) -> bool:
        return all((row[f] > b) == above for f, above, b in tests)

    def grow(rows: list[tuple]) -> list[tuple[int, bool, int]]:
        tests: list[tuple[int, bool, int]] = []
        inside = rows
        while len(tests) < MAX_CONDITIONS:
            bad, good = sum(r[n] for r in inside), sum(r[n + 1] for r in inside)
            if not bad or not good:
                break
            before = math.log2(bad / (bad + good))
            best, gain = None, 1e-9
            for f, name in enumerate(names):
                per = [[0, 0] for _ in range(len(cuts[name]) + 1)]
                for r in inside:
                    per[r[f]][0] += r[n]
                    per[r[f]][1] += r[n + 1]
                low_bad = low_good = 0
                for b in range(len(cuts[name])):
                    low_bad, low_good = low_bad + per[b][0], low_good + per[b][1]
                    for above, p, q in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                        if p and (g := p * (math.log2(p / (p + q)) - before)) > gain:
                            best, gain = (f, above, b), g
            if not best:
                break
            tests.append(best)
            inside = [r for r in inside if taken(r, [best])]
        return tests

    def worth(rows: list[tuple], tests: list[tuple[int, bool, int]]) -> tuple[float, int, int]:
        bad = sum(r[n + 2] for r in rows if taken(r, tests))
        good = sum(r[n + 3] for r in rows if taken(r, tests))
        return (bad - good) / max(1, bad + good), bad, good

    while rows and len(rules) < MAX_RULES:
        tests = grow(rows)
        if not tests:
            break
        tests = max((tests[:k] for k in range(len(tests), 0, -1)), key=lambda t: worth(rows, t)[0])
        _, bad, good = worth(rows, tests)
        if bad + good < MIN_TAKEN or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[names[f]][b]) for f, above, b in tests)))
        rows = [r for r in rows if not taken(r, tests)]
    return rules


def learn(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = LABELLED_ROWS) -> list[Rule]:
    """The decision list, learned from about rows labelled documents at most (a hash of the key chooses them)."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    n = known.count()
    if not n:
        return []
    chosen = known.where(share_below(F.col("_key"), rows / n, 11))
    # Bounded by rows (about 16 bytes each), so the larger side isn't shuffled.
    joined = documents.select(F.col(key).alias("_key"), F.col(text).alias("_body")).join(F.broadcast(chosen), "_key")
    measured = written(measures(joined, "_body", ["_key", "_label"]), "quality")  # read twice: for the cuts, then the counts
    return cover(*labelled_counts(measured, "_label", "_key"))


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that takes the row, else null."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(), F.lit(i)).otherwise(out)
    return out


def judge(df: DataFrame, text: str, keep: list[str], rules: list[Rule]) -> DataFrame:
    """keep's columns, the measures, base_failed, rule (the rule that rejects) and kept."""
    return measures(df, text, keep).withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rejecting rule of every document."""
    documents = table(spark, sf_dir, "documents")
    rules = learn(documents, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return judge(documents, "text", ["doc_id"], rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
