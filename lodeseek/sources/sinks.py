"""Search results as text and JSON. Results are few (MAX_RESULTS, or the expansion's limit)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import strip

FIELDS = ["content", "doc", "relative_path", "start_line", "end_line", "language", "score"]


def as_json_rows(results: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return results.select(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("json"))


def json_text(results: DataFrame) -> str:
    rows = [r.asDict() for r in results.select(*FIELDS).collect()]
    return json.dumps({"total": len(rows), "results": rows}, indent=2, ensure_ascii=False)


def contents_text(results: DataFrame) -> str:
    """Contents only, trimmed."""
    return json.dumps([r[0] for r in results.select(strip(F.col("content"))).collect()], indent=2, ensure_ascii=False)


def plain_text(results: DataFrame) -> str:
    out = []
    for i, r in enumerate(results.select(*FIELDS).collect(), 1):
        out += [f"[{i}] {r.relative_path}:{r.start_line}-{r.end_line} ({r.language}, {r.score:.4f})", r.content.strip(), ""]
    return "\n".join(out) or "No results."
