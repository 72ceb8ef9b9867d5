"""A versioned table store on plain Parquet, in which a change writes what changed.

A collection is a folder of tables, each a list of segments: folders of rows that were added together
and don't change any more. A pointer file names the current segments. A change adds a segment to
each table, and the paths whose earlier rows are gone; a row counts if nothing that it belongs to went
after it was added. So a change's bytes grow with the change, not with the collection. Segments are
merged, without the rows that are gone, as soon as one isn't twice as large as all that came after it:
there are no more of them than the logarithm of the collection's size, and over time each row is
written again as often.

The pointer is flipped last: readers see the old version or the new one, and a crash in between loses
nothing. What a version no longer names stays until the change after the next, so that readers
which began with it can end. Points, snapshot and graph of a codebase are one version, so they can't
disagree. All file operations go through Hadoop's file system, so the root may be on any store
that Spark reaches.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek import schemas

TABLES = {
    "points": schemas.POINT, "snapshot": schemas.FILE_RECORD, "nodes": schemas.NODE, "edges": schemas.EDGE, "candidates": schemas.CANDIDATE, "definitions": schemas.DEFINITION, "postings": schemas.FILED_POSTING,
    "tallies": schemas.TALLY, "answers": schemas.ANSWER,
}
#: Tables that are dealt into folders by a column.
FOLDERS = {"postings": "bucket", "answers": "bucket"}
#: Tables whose files are sorted, so that a scan skips parts of them.
SORTED = {"postings": ["bucket", "term", "layer"]}
#: The paths that a table's rows belong to, and whether their files' content or their snapshot is meant. What is kept belongs to none.
CONTENT, FILES, KEPT = "content", "files", "kept"
BELONGS = {
    "points": (CONTENT, ["relative_path"]), "nodes": (CONTENT, ["relative_path"]), "edges": (CONTENT, ["source_path", "target_path"]), "candidates": (CONTENT, ["file_path"]), "definitions": (CONTENT, ["file_path"]),
    "postings": (CONTENT, ["relative_path"]), "tallies": (CONTENT, ["path"]), "snapshot": (FILES, ["path"]), "answers": (KEPT, []),
}
#: Segments of paths that are gone, by what is meant.
GONE = {CONTENT: "gone_content", FILES: "gone_files"}
#: A segment of less than this many times the bytes that came after it is merged with them.
GROWTH = 2
FORMAT = 4


def names(schema: str) -> list[str]:
    """The columns of a schema's text."""
    return [c.strip().split(" ")[0] for c in schema.split(", ")]


class Staging:
    """Tables that are written while a change is worked out, and deleted at its end."""

    def __init__(self, store: Store, collection: str) -> None:
        self.store, self.parts = store, (collection, f"staging-{uuid.uuid4().hex}")
        self.tables = 0

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_: object) -> None:
        self.store._files.delete(self.store._path(*self.parts), True)

    def written(self, df: DataFrame) -> DataFrame:
        """df, written and read back: computed once, and with a plan of one scan."""
        self.tables += 1
        path = "/".join((self.store.root, *self.parts, f"t{self.tables}"))
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):  # noqa: ANN202  a Hadoop path
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    @property
    def _files(self):  # noqa: ANN202  a Hadoop file system
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointer(self, collection: str) -> dict | None:
        """What the pointer says; None if it is missing, broken or of another format."""
        where = self._path(collection, "CURRENT.json")
        if not self._files.exists(where):
            return None
        stream = self._files.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if found.get("format") == FORMAT else None

    def exists(self, collection: str) -> bool:
        return self._pointer(collection) is not None

    def facts(self, collection: str) -> dict:
        return (self._pointer(collection) or {}).get("facts", {})

    def read(self, collection: str, table: str) -> DataFrame:
        """The table's current rows; empty if the collection or the table isn't there."""
        return self._rows(collection, self._pointer(collection) or {}, table).select(*names(TABLES[table]))

    def _segments(self, collection: str, table: str, schema: str, found: list[dict]) -> DataFrame | None:
        """The rows of segments, with when they were added."""
        if not found:
            return None
        where = f"{self.root}/{collection}/{table}"
        reader = self.spark.read.schema(f"{schema}, added int, attempt string").option("basePath", where)
        return reader.parquet(*(f"{where}/{x['path']}" for x in found)).drop("attempt")

    def _rows(self, collection: str, pointer: dict, table: str, only: list[dict] | None = None) -> DataFrame:
        """Rows that count, with the columns that tell their paths; of some segments only."""
        what, columns = BELONGS[table]
        schema = TABLES[table] + "".join(f", {c} string" for c in columns if c not in names(TABLES[table]))
        held = pointer.get("segments", {}).get(table, []) if only is None else only
        rows = self._segments(collection, table, schema, held)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        gone = [x for x in pointer["segments"].get(GONE.get(what), []) if x["last"] > min(s["added"] for s in held)]
        if went := self._segments(collection, GONE.get(what), "path string, at int", gone):
            last = went.groupBy("path").agg(F.max("at").alias("_at"))
            for i, c in enumerate(columns):
                rows = rows.join(last.select(F.col("path").alias(f"_path{i}"), F.col("_at").alias(f"_at{i}")), F.col(c) == F.col(f"_path{i}"), "left")
                rows = rows.where(F.col(f"_at{i}").isNull() | (F.col("added") >= F.col(f"_at{i}"))).drop(f"_path{i}", f"_at{i}")
        return rows.drop("added")

    def staging(self, collection: str) -> Staging:
        return Staging(self, collection)

    def _write(self, collection: str, table: str, rows: DataFrame, version: int) -> dict:
        folder = FOLDERS.get(table)
        path = f"added={version}/attempt={uuid.uuid4().hex}"
        rows = rows.hint("rebalance", folder) if folder else rows
        rows = rows.sortWithinPartitions(*SORTED[table]) if table in SORTED else rows
        writer = rows.write.partitionBy(folder) if folder else rows.write
        writer.mode("errorifexists").parquet(f"{self.root}/{collection}/{table}/{path}")
        n_bytes = self._files.getContentSummary(self._path(collection, table, path)).getLength()
        return {"added": version, "last": version, "path": path, "bytes": n_bytes}

    def change(self, collection: str, added: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, facts: dict | None = None) -> None:
        """Add rows to tables; rows that were there count no more if a path that they belong to is gone (by CONTENT or FILES: path)."""
        old = self._pointer(collection) or {"format": FORMAT, "version": 0, "segments": {}, "left": [], "facts": {}}
        version, passing = old["version"] + 1, []
        segments = {t: list(x) for t, x in old["segments"].items()}
        pointer = old | {"version": version, "segments": segments, "facts": old["facts"] | (facts or {})}
        for what, paths in (gone or {}).items():
            went = self._write(collection, GONE[what], paths.select("path", F.lit(version).alias("at")).dropDuplicates(["path"]), version)
            segments.setdefault(GONE[what], []).append(went)
            passing.append(f"{GONE[what]}/{went['path']}")
        for table, rows in added.items():
            columns = dict.fromkeys([*names(TABLES[table]), *BELONGS[table][1]])
            fresh = self._write(collection, table, rows.select(*columns), version)
            held = segments.setdefault(table, [])
            n_bytes, merged = fresh["bytes"], []
            while held and held[-1]["bytes"] < GROWTH * n_bytes:
                merged.insert(0, held.pop())
                n_bytes += merged[0]["bytes"]
            if merged:
                parts = [self._rows(collection, pointer, table, merged), self._rows(collection, pointer, table, [fresh])]
                passing.append(f"{table}/{fresh['path']}")
                fresh = self._write(collection, table, reduce(DataFrame.unionByName, parts).select(*columns), version)
            held.append(fresh)
        for what, table in GONE.items():
            self._merge_gone(collection, segments, what, table, version)
        if "tallies" in added or "tallies" in segments and CONTENT in (gone or {}):
            pointer["facts"]["texts"] = self._rows(collection, pointer, "tallies").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("content", "doc"))).head().asDict()
        self._settle(collection, old, pointer, passing)

    def _merge_gone(self, collection: str, segments: dict[str, list[dict]], what: str, table: str, version: int) -> None:
        """Merge segments of gone paths as those of rows; what no row is older than needs no longer be told."""
        oldest = min((x["added"] for t, (kind, _) in BELONGS.items() if kind == what for x in segments.get(t, [])), default=version)
        held = segments[table] = [x for x in segments.get(table, []) if x["last"] > oldest]
        n_bytes, merged = 0, []
        while held and (not merged or held[-1]["bytes"] < GROWTH * n_bytes):
            merged.insert(0, held.pop())
            n_bytes += merged[0]["bytes"]
        if len(merged) > 1:
            paths = self._segments(collection, table, "path string, at int", merged)
            one = self._write(collection, table, paths.groupBy("path").agg(F.max("at").alias("at")), version)
            merged = [one | {"last": max(x["last"] for x in merged)}]
        held += merged

    def commit(self, collection: str, tables: dict[str, DataFrame], facts: dict | None = None) -> None:
        """Write tables anew, and make that the current version; tables that aren't named stay as they are."""
        old = self._pointer(collection) or {"format": FORMAT, "version": 0, "segments": {}, "left": [], "facts": {}}
        version = old["version"] + 1
        written = {t: [self._write(collection, t, df.select(*dict.fromkeys([*names(TABLES[t]), *BELONGS[t][1]])), version)] for t, df in tables.items()}
        self._settle(collection, old, old | {"version": version, "segments": old["segments"] | written, "facts": old["facts"] | (facts or {})})

    def _settle(self, collection: str, old: dict, now: dict, passing: list[str] = ()) -> None:
        """Make now the current version. What the version before old named, and no later one does, is deleted, and so are those of passing that now doesn't name."""
        paths = lambda pointer: {f"{t}/{x['path']}" for t, some in pointer["segments"].items() for x in some}
        left = paths(old) - paths(now)
        self._flip(collection, json.dumps(now | {"left": sorted(left)}))
        for path in {*old.get("left", []), *passing} - left - paths(now):
            self._files.delete(self._path(collection, path), True)

    def _flip(self, collection: str, text: str) -> None:
        fresh, where = self._path(collection, f".CURRENT-{uuid.uuid4().hex}.json"), self._path(collection, "CURRENT.json")
        out = self._files.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        onto = gateway.new_array(kind, 1)
        onto[0] = kind.OVERWRITE
        qualified = self._files.makeQualified(fresh)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark._jsc.hadoopConfiguration()).rename(qualified, self._files.makeQualified(where), onto)

    def create(self, collection: str, facts: dict, force: bool = False) -> bool:
        """Make an empty collection where there is none, or anew with force; whether it was made."""
        if self.exists(collection) and not force:
            return False
        self.drop(collection)
        self.commit(collection, {}, facts)
        return True

    def drop(self, collection: str) -> bool:
        """Delete the collection; whether it was there."""
        was = self._files.exists(self._path(collection))
        self._files.delete(self._path(collection), True)
        return was
