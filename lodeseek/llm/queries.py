"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm import contamination, filter_audit, merkle, mixing, warc
from lodeseek.llm.ann_tree import op6_ann_tree
from lodeseek.llm.byte_bpe import op10_byte_bpe
from lodeseek.llm.html_text import op3_html_text
from lodeseek.llm.language_id import op1_language_id
from lodeseek.llm.license_scan import op7_license_scan
from lodeseek.llm.near_dedup import op5_near_dedup
from lodeseek.llm.quality_rules import op4_quality_rules
from lodeseek.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_dedup": op5_near_dedup,
    "op6_ann_tree": op6_ann_tree,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_decontamination": contamination.op12_decontamination,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": mixing.oracle(),
    "op9_warc": warc.ORACLE,
    "op11_merkle_manifest": merkle.oracle(),
    "op12_decontamination": contamination.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
