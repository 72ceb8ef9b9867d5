"""Command line: python -m lodeseek.cli index|search|drop|serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from lodeseek.plans.engine import Engine, Settings
from lodeseek.sources.sinks import contents_text, json_text, plain_text


def load_settings(path: str | None) -> Settings:
    """Settings from a JSON file; missing keys have their defaults."""
    if not path or not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as f:
        values = json.load(f)
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def serve(engine: Engine, asked: TextIO, out: TextIO) -> None:
    """A search tool over lines of JSON: {"query", "path", "limit"?, "threshold"?, "hops"?} in, results or {"error"} out."""
    for line in asked:
        if not line.strip():
            continue
        try:
            a = json.loads(line)
            found = engine.search(a.get("path", "."), a["query"], int(a.get("limit", 5)), float(a.get("threshold", 0.0)), a.get("hops"))
            answer = json.loads(json_text(found))
        except (KeyError, ValueError, RuntimeError) as e:
            answer = {"error": str(e)}
        print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodeseek")
    parser.add_argument("--root", default=os.path.expanduser("~/.lodeseek"))
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("path", nargs="?", default=".")
    index.add_argument("--force", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("path", nargs="?", default=".")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--threshold", type=float, default=0.0)
    search.add_argument("--hops", type=int)
    search.add_argument("--output", choices=["text", "json", "contents"], default="text")
    commands.add_parser("serve")
    commands.add_parser("drop").add_argument("path", nargs="?", default=".")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodeseek").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.root, load_settings(args.config))
    if args.command == "index":
        print(json.dumps(engine.index(args.path, args.force)))
    elif args.command == "search":
        found = engine.search(args.path, args.query, args.limit, args.threshold, args.hops)
        print({"text": plain_text, "json": json_text, "contents": contents_text}[args.output](found))
    elif args.command == "serve":
        serve(engine, sys.stdin, sys.stdout)
    else:
        print("dropped" if engine.drop(args.path) else "not indexed")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
