"""Recursive file scan as a Python data source: stat only, ignored directories are never entered.

Format "lodeseek_files", option path, optional options ignore (patterns, one a line) and content
("true" adds the bytes). The walk is planned on the driver until there are PARTS subtrees or SPREAD
directories were listed; each subtree is walked by the task that lists it, so a large tree is listed
in parallel, also where one directory holds it all.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeseek.fixed_values import LANGUAGE_OF_EXTENSION
from lodeseek.functions.text import as_text
from lodeseek.operators.ignore import Rule, default_rules, rules_of

NAME = "lodeseek_files"
#: Subtrees that the driver aims at, and directories that it lists at most to find them.
PARTS, SPREAD = 256, 512
#: Bytes of content in one batch.
BATCH_BYTES = 8 << 20
#: Bytes that are hashed at once, that a task reads, about, and that a row's content has at most.
BLOCK_BYTES, TASK_BYTES, ROW_BYTES = 64 << 10, 128 << 20, 1 << 30
#: Files of a range that is sorted by size.
RANGE_FILES = 100_000
IGNORE_FILE = ".gitignore"


@dataclass
class _Subtree(InputPartition):
    """A directory relative to the root, with the rules from above it; deep: with all below it."""

    relative: str
    rules: list[Rule]
    deep: bool


def is_ignored(relative: str, is_dir: bool, rules: list[Rule]) -> bool:
    """The last rule that matches decides. Rules are in order, those of deeper directories last."""
    for r in reversed(rules):
        if r.dir and not relative.startswith(r.dir + "/"):
            continue
        if (is_dir or not r.dir_only) and re.match(r.regex, relative[len(r.dir) + 1 :] if r.dir else relative):
            return not r.negated
    return False


def entries(root: str, relative: str, rules: list[Rule]) -> tuple[list[tuple[str, os.stat_result]], list[str], list[Rule]]:
    """Files and directories of one directory that count, and the rules that hold below it. What can't be read is left out."""
    here = os.path.join(root, relative) if relative else root
    try:
        with os.scandir(here) as listing:
            found = sorted(listing, key=lambda e: e.name)
    except OSError:
        return [], [], rules
    if any(e.name == IGNORE_FILE for e in found):
        try:
            with open(os.path.join(here, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
                rules = [*rules, *rules_of(f.read().splitlines(), relative)]
        except OSError:
            pass
    files, dirs = [], []
    for e in found:
        path = f"{relative}/{e.name}" if relative else e.name
        if e.name.startswith("."):
            continue
        try:
            is_dir = e.is_dir(follow_symlinks=False)
            if is_dir:
                if not is_ignored(path, True, rules):
                    dirs.append(path)
            elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1].lower() in LANGUAGE_OF_EXTENSION and not is_ignored(path, False, rules):
                files.append((path, e.stat(follow_symlinks=False)))
        except OSError:
            continue
    return files, dirs, rules


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.realpath(os.path.expanduser(re.sub(r"^file:(//)?(?=/)", "", options["path"])))
        self.content = options.get("content", "false") == "true"
        self.first = default_rules(x for x in options.get("ignore", "").split("\n") if x)

    def partitions(self) -> list[InputPartition]:
        shallow, waiting = [], deque([("", self.first)])
        while waiting and len(shallow) < SPREAD and len(shallow) + len(waiting) < PARTS:
            relative, rules = waiting.popleft()
            shallow.append(_Subtree(relative, rules, False))
            _, dirs, below = entries(self.root, relative, rules)
            waiting += [(d, below) for d in dirs]
        return shallow + [_Subtree(relative, rules, True) for relative, rules in waiting]

    def read(self, part: _Subtree) -> Iterator[tuple]:
        waiting = [(part.relative, part.rules)]
        while waiting:
            relative, rules = waiting.pop()
            files, dirs, rules = entries(self.root, relative, rules)
            for path, stat in files:
                yield (path, stat.st_size, stat.st_mtime, stat.st_ino, *self._body(path))
            if part.deep:
                waiting += [(d, rules) for d in reversed(dirs)]

    def _body(self, path: str) -> tuple:
        if not self.content:
            return ()
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return (f.read(),)
        except OSError:
            return (None,)


class FilesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, size bigint, mtime double, inode bigint" + (", content binary" if self.options.get("content") == "true" else "")

    def reader(self, schema: object) -> FilesReader:
        return FilesReader(self.options)


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """FILE_META rows (with content) of the files below root that count."""
    spark.dataSource.register(FilesDataSource)
    return spark.read.format(NAME).option("ignore", "\n".join(ignore)).option("content", str(content).lower()).load(root)


def dealt(paths: DataFrame) -> DataFrame:
    """path, dealt to tasks by the files' bytes (size, if paths have it; else each counts alike).

    Tasks are as many as the bytes take (TASK_BYTES each), or the session's shuffle partitions. Paths
    are sorted by size in ranges, and each range is dealt out in turn, the largest first: a task's
    share is like any other's. The number of tasks is given, so nothing merges them by the bytes of the paths.
    """
    spark = paths.sparkSession
    size = F.col("size").cast("bigint") if "size" in paths.columns else F.lit(0).cast("bigint")
    told = paths.select("path", F.coalesce(size, F.lit(0)).alias("size"))
    n_bytes, n_files = told.agg(F.sum("size"), F.count("*")).head()
    if not n_files:
        return paths.select("path")
    tasks = min(n_files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES)))
    ranges = min(tasks, n_files // RANGE_FILES + 1)
    at = F.monotonically_increasing_id()
    ordered = told.repartitionByRange(ranges, F.desc("size"), "path").sortWithinPartitions(F.desc("size"), "path")
    turn = F.pmod(at.bitwiseAND((1 << 33) - 1) + F.shiftright(at, 33) * F.lit(7919), F.lit(tasks)).cast("int")
    return ordered.select("path", turn.alias("task")).repartitionById(tasks, "task").select("path")


def _base(root: str) -> str:
    return os.path.realpath(os.path.expanduser(re.sub(r"^file:(//)?(?=/)", "", root)))


def block_hash(path: str) -> str | None:
    """The md5 of a file, read in blocks; None if it can't be read."""
    told = hashlib.md5()
    try:
        with open(path, "rb", buffering=0) as f:
            while block := f.read(BLOCK_BYTES):
                told.update(block)
    except OSError:
        return None
    return told.hexdigest()


def hashes(root: str, paths: DataFrame) -> DataFrame:
    """path, hash of the files with these paths below root; null if one can't be read. No content leaves the reading task, which holds a block of it."""
    base = _base(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([block_hash(os.path.join(base, p)) for p in batch.column(0).to_pylist()], pa.string())], names=["path", "hash"])

    return dealt(paths).mapInArrow(run, "path string, hash string")


def contents(root: str, paths: DataFrame) -> DataFrame:
    """path, content of the files with these paths below root, and of no others; null content if it can't be read or is too long for a row."""
    base = _base(root)

    def read(path: str) -> bytes | None:
        try:
            with open(os.path.join(base, path), "rb") as f:
                return f.read() if os.fstat(f.fileno()).st_size <= ROW_BYTES else None
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, bytes | None]] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows.append((path, read(path)))
                held += len(rows[-1][1] or b"") + 100
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return dealt(paths).mapInArrow(run, "path string, content binary")


def _batch(rows: list[tuple[str, bytes | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])


def texts(files: DataFrame) -> DataFrame:
    """path, content as text; files that aren't UTF-8 or can't be read have null content."""
    return files.select("path", as_text(F.col("content")).alias("content"))
