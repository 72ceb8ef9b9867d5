"""Snapshot diff: what was added, modified, renamed and removed between two tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, MODIFIED, REMOVED, RENAMED = "added", "modified", "removed", "renamed"


def same_metadata(a: str, b: str) -> Column:
    """Size, time and inode agree (an unknown inode with an unknown one)."""
    return (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.mtime") == F.col(f"{b}.mtime")) & F.col(f"{a}.inode").eqNullSafe(F.col(f"{b}.inode"))


def path_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, hash, inode: added, modified and removed by path alone. One full outer join serves all three."""
    joined = old.alias("o").join(new.alias("n"), F.col("o.path") == F.col("n.path"), "full_outer")
    change = (
        F.when(F.col("o.path").isNull(), ADDED)
        .when(F.col("n.path").isNull(), REMOVED)
        .when(~same_metadata("o", "n") & (F.col("o.hash") != F.col("n.hash")), MODIFIED)
    )
    return joined.select(F.coalesce("n.path", "o.path").alias("path"), change.alias("change"), F.coalesce("n.hash", "o.hash").alias("hash"), F.when(F.col("n.path").isNull(), F.col("o.inode")).otherwise(F.col("n.inode")).alias("inode")).where("change IS NOT NULL")


def renames(changes: DataFrame) -> DataFrame:
    """path, old_path: added files that are removed ones moved.

    Files pair up on content: within a hash the n-th added path (by name) takes the n-th removed
    one, after those whose inode also agrees. Groups are files of one content that moved at once.
    """
    from pyspark.sql import Window

    added = changes.where(F.col("change") == ADDED).select("path", "hash", "inode")
    removed = changes.where(F.col("change") == REMOVED).select(F.col("path").alias("old_path"), "hash", F.col("inode").alias("old_inode"))
    exact = added.join(removed, (added["hash"] == removed["hash"]) & (added["inode"] == removed["old_inode"])).select(added["path"], "old_path", added["hash"])
    once = exact.groupBy("path", "hash").agg(F.min("old_path").alias("old_path")).groupBy("old_path", "hash").agg(F.min("path").alias("path"))
    rest_added = added.join(once, "path", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("path")))
    rest_removed = removed.join(once, "old_path", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("old_path")))
    return once.select("path", "old_path").unionByName(rest_added.join(rest_removed, ["hash", "n"]).select("path", "old_path"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, old_path: a renamed file is one row under its new path, and no added or removed one."""
    by_path = path_changes(old, new)
    moved = renames(by_path)
    rest = by_path.join(moved, "path", "left_anti").join(moved.select(F.col("old_path").alias("path")).withColumn("change", F.lit(REMOVED)), ["path", "change"], "left_anti")
    return rest.select("path", "change", F.lit(None).cast("string").alias("old_path")).unionByName(moved.select("path", F.lit(RENAMED).alias("change"), "old_path"))


def suppressed(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change where content that only moved is left out: every added file of a removed content, and of each such content the last removed path."""
    by_path = path_changes(old, new)
    added = by_path.where(F.col("change") == ADDED)
    removed = by_path.where(F.col("change") == REMOVED)
    moved = removed.join(added.select("hash").dropDuplicates(), "hash", "left_semi").groupBy("hash").agg(F.max("path").alias("path"))
    return (
        added.join(removed.select("hash").dropDuplicates(), "hash", "left_anti").select("path", "change")
        .unionByName(removed.join(moved, ["hash", "path"], "left_anti").select("path", "change"))
        .unionByName(by_path.where(F.col("change") == MODIFIED).select("path", "change"))
    )


def to_add(found: DataFrame) -> DataFrame:
    return found.where(F.col("change").isin(ADDED, MODIFIED)).select("path").dropDuplicates()


def to_remove(found: DataFrame) -> DataFrame:
    return found.where(F.col("change").isin(MODIFIED, REMOVED)).select("path").dropDuplicates()


def unknown(meta: DataFrame, old: DataFrame) -> DataFrame:
    """path, size of the current files whose content has to be read: those that aren't known with the same metadata."""
    return meta.alias("n").join(old.alias("o"), (F.col("n.path") == F.col("o.path")) & same_metadata("n", "o"), "left_anti").select("path", "size")


def records(meta: DataFrame, old: DataFrame, content: DataFrame) -> DataFrame:
    """path, size, mtime, inode, hash of the current files: a file whose metadata didn't change keeps its hash, the others are hashed.

    The others are told apart first, so that only they are read; files that can't be read drop out.
    content: path and hash, or path and content.
    """
    joined = meta.alias("n").join(old.alias("o"), (F.col("n.path") == F.col("o.path")) & same_metadata("n", "o"), "left")
    known = joined.where(F.col("o.path").isNotNull()).select("n.path", "n.size", "n.mtime", "n.inode", "o.hash")
    fresh = joined.where(F.col("o.path").isNull()).select("n.path", "n.size", "n.mtime", "n.inode")
    hashed = fresh.join(content.select("path", "hash" if "hash" in content.columns else F.md5("content").alias("hash")), "path").where("hash IS NOT NULL")
    return known.unionByName(hashed)
