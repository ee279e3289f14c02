"""Command line: analyze, query, report, diff."""

from __future__ import annotations

import argparse
import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom.engine import Engine


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphloom", description="Code graph analytics on Spark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "query", "report"):
        p = sub.add_parser(name)
        p.add_argument("path")
    p = sub.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    for p in sub.choices.values():
        p.add_argument("--language", action="append", default=None, help="may be repeated; the dominant one if left out")
        p.add_argument("--cache", help="folder of parsed facts")
    for name in ("analyze", "query", "report"):
        sub.choices[name].add_argument("--compile-commands", help="compilation database; only the files it names are read")
    q = sub.choices["query"]
    for flag in ("functions", "unused", "dot", "cycles", "dead-code", "complexity"):
        q.add_argument(f"--{flag}", action="store_true")
    q.add_argument("--callers")
    q.add_argument("--callees")
    q.add_argument("--entries", default="main")
    q.add_argument("--threshold", type=int, default=0)
    sub.choices["analyze"].add_argument("--save", help="folder for the graph")
    for name in ("report", "diff"):
        sub.choices[name].add_argument("--output", required=True)
    sub.choices["report"].add_argument("--entries", default="main")
    return parser


def _show(title: str, rows: DataFrame) -> None:
    print(f"== {title}")
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    build = lambda path: Engine.from_path(spark, path, args.language, args.cache and f"{args.cache}/{hashlib.sha256(path.encode()).hexdigest()[:16]}")
    if args.command == "diff":
        Path(args.output).write_text(build(args.old).html_diff(build(args.new)), encoding="utf-8")
        return 0
    engine = Engine.from_commands(spark, args.compile_commands, args.path, args.cache) if args.compile_commands else build(args.path)
    if args.command == "analyze":
        _show("nodes, edges", engine.stats())
        if args.save:
            engine.save(args.save)
    elif args.command == "report":
        Path(args.output).write_text(engine.html_report(entries=args.entries), encoding="utf-8")
    else:
        asked = [
            (args.functions, "functions", lambda: engine.nodes.where("kind = 'Function'").select("name", "start_line").orderBy("name")),
            (args.callers, "callers", lambda: engine.callers(args.callers).select("caller", "callee")),
            (args.callees, "callees", lambda: engine.callees(args.callees).select("callee", "line")),
            (args.unused, "unused", lambda: engine.unused().select("name", "start_line").orderBy("name")),
            (args.dot, "dot", lambda: engine.dot().orderBy("part", "id", "other").select("line")),
            (args.cycles, "cycles", lambda: engine.cycles().select("length", "functions")),
            (args.dead_code, "dead code", lambda: engine.dead_code(args.entries).select("name", "start_line").orderBy("name")),
            (args.complexity, "complexity", lambda: engine.complexity(args.threshold).select("function_name", "ast_node_count").orderBy("function_name")),
        ]
        for wanted, title, rows in asked:
            if wanted:
                _show(title, rows())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
