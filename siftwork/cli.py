"""python -m siftwork.cli search|overview|cleanup"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .functions.render import json_lines, overview_json, overview_lines, parse_report_lines, text_line
from .functions.text import validate_query
from .operators.search import Filters
from .plans.engine import Engine, stored_engine
from .sources import artifacts, clone


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwork", description="Ranked search and overviews of source trees.")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="the best matches of a query")
    s.add_argument("source", help="a folder, or owner/repo[@ref] of a clone in the cache")
    s.add_argument("query")
    s.add_argument("-n", "--limit", type=int, default=10)
    s.add_argument("-f", "--format", choices=("json", "text"), default="json")
    s.add_argument("--dir", action="append", default=[])
    s.add_argument("--ext", action="append", default=[])
    s.add_argument("--type", choices=("code", "doc"))
    s.add_argument("--verbose", action="store_true")
    o = sub.add_parser("overview", help="the public surface")
    o.add_argument("source")
    o.add_argument("-f", "--format", choices=("json", "text"), default="json")
    o.add_argument("--verbose", action="store_true")
    c = sub.add_parser("cleanup", help="deletes the cache, or what it holds of one repository")
    c.add_argument("source", nargs="?")
    return p


def engine_of(spark: SparkSession, source: str, with_index: bool) -> Engine:
    """The engine of a folder, parsed anew, or of a repository: its clone (made from its public
    address if it is missing) and the stored corpus and index of it, while they fit."""
    if os.path.isdir(source):
        return Engine.from_dir(spark, source)
    spec = artifacts.Spec.parse(source)
    root = clone.clone(f"https://github.com/{spec.owner}/{spec.repo}.git", artifacts.artifact_dir(spec) / "clone", spec.ref)
    return stored_engine(spark, str(root), spec, with_index=with_index)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = _parser().parse_args(argv)
    if args.command == "cleanup":
        spec = artifacts.Spec.parse(args.source) if args.source else None
        gone = artifacts.cleanup(artifacts.artifact_dir(spec).parent if spec else artifacts.cache_root())
        print("removed" if gone else "nothing to remove", file=out)
        return 0
    if args.command == "search":
        validate_query(args.query)
    spark = spark or SparkSession.builder.appName("siftwork").getOrCreate()
    engine = engine_of(spark, args.source, args.command == "search")
    if args.verbose:
        report = engine.report().first() if engine.fresh else None
        print("\n".join(parse_report_lines(report)), file=sys.stderr)
    if args.command == "search":
        found = engine.search(args.query, args.limit, Filters.of(args.dir, args.ext, args.type and args.type.capitalize()))
        for row in (json_lines(found) if args.format == "json" else found.select(text_line())).collect():
            print(row[0], file=out)
    else:
        o = engine.overview()
        for row in overview_json(o.meta, o.shown, o.tests, o.hints, args.source, "repo_id").collect():
            print(row["value"] if args.format == "json" else "\n".join(overview_lines(json.loads(row["value"]))), file=out)
    artifacts.evict(artifacts.cache_root())
    return 0


if __name__ == "__main__":
    sys.exit(main())
