"""Keyed changes of point tables, as whole-table expressions that a store commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.fixed_values import NO_DOC
from lodeseek.functions.text import is_blank


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new, allowMissingColumns=True)


def without_paths(points: DataFrame, paths: DataFrame, column: str = "relative_path") -> DataFrame:
    """One anti join for all paths."""
    return points.join(paths.select(F.col("path").alias(column)).dropDuplicates(), column, "left_anti").select(points.columns)


def needs_doc(df: DataFrame) -> DataFrame:
    return df.where(is_blank(F.col("doc")))


def with_default_doc(df: DataFrame, doc: str = "doc") -> DataFrame:
    return df.withColumn(doc, F.when(F.col(doc).isNull() | (F.col(doc) == ""), NO_DOC).otherwise(F.col(doc)))
