"""Command lines: flags, single commands, batches and graphs.

``python -m lodestone.plans.cli -w <work tree> [--store <folder>] <command> [arguments] [flags]``
"""

from __future__ import annotations

import argparse
import json
import shlex
import sys
import time
from collections.abc import Iterable
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from ..diagrams import draw, graph, read
from ..sources.ingest import Tables, index_work_tree
from .commands import Context, Flags, run
from .render import render

#: Flags whose names differ from their field, and short forms.
_NAMES = {"inside": ["--in"], "with_imports": ["--imports"], "context": ["-C", "--context"], "patterns": ["-e"], "body": ["--body", "--with-bodies"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", add_help=False)
    for f in fields(Flags):
        names = _NAMES.get(f.name, [f"--{f.name.replace('_', '-')}"])
        if f.name == "patterns":
            p.add_argument(*names, dest=f.name, action="append", default=[])
        elif f.name == "expand":
            p.add_argument(*names, dest=f.name, nargs="?", const=1, default=0, type=lambda x: int(x) if x.isdigit() and int(x) else 1)
        elif f.type == "bool":
            p.add_argument(*names, dest=f.name, action="store_true")
        else:
            p.add_argument(*names, dest=f.name, type=int if str(f.type).startswith("int") else str, default=f.default)
    p.add_argument("-c", "--categorize", action="store_true")  # the default; kept so that old calls work
    p.add_argument("words", nargs="*")
    return p


def parse(args: list[str]) -> tuple[Flags, list[str]]:
    found = vars(parser().parse_intermixed_args(args))
    words = found.pop("words")
    found.pop("categorize")
    return Flags(**{**found, "patterns": tuple(found["patterns"])}), words


def answer(ctx: Context, args: list[str]) -> str:
    """One command with its own flags."""
    flags, words = parse(args)
    ctx = replace(ctx, flags=flags)
    began = time.perf_counter()
    text = render(run(ctx, words[0], words[1:]), ctx) if words else "Usage: <command> [arguments]"
    if flags.timings:
        print(f"Timings:\n  {'query and output':<22} {(time.perf_counter() - began) * 1000:8.1f} ms", file=sys.stderr)
    return text


def batch(ctx: Context, commands: Iterable[str]) -> list[str]:
    """Many commands over one index, whose tables stay in memory. ``--max-output`` and ``--in-package`` of the outer call hold unless a line sets its own."""
    outer = ctx.flags
    cached = replace(ctx, tables=Tables(ctx.tables.index.persist()))
    out = []
    for line in commands:
        args = shlex.split(line)
        if not args:
            continue
        if args[0] == "graph":
            out.append(graph_command(args[1:]))
            continue
        flags, words = parse(args)
        flags = replace(flags, max_output=flags.max_output or outer.max_output, in_package=flags.in_package or outer.in_package)
        own = replace(cached, flags=flags)
        out.append(render(run(own, words[0], words[1:]), own))
    cached.tables.index.unpersist()
    return out


def graph_command(args: list[str], stdin: str = "") -> str:
    """``--render "A->B, B->C"`` draws a graph; ``--parse`` reads a diagram (from the input or an argument)."""
    p = argparse.ArgumentParser(prog="graph", add_help=False)
    p.add_argument("--render")
    p.add_argument("--parse", nargs="?", const="")
    for name in ("ascii", "rounded", "double", "horizontal", "json", "no-straighten", "no-compact"):
        p.add_argument(f"--{name}", action="store_true")
    a = p.parse_args(args)
    if a.render is not None:
        prefs = draw.Preferences(unicode=not a.ascii, rounded=a.rounded, double=a.double, vertical=not a.horizontal, straighten=not a.no_straighten, compact=not a.no_compact)
        text = draw.render(graph.parse_edges(a.render), prefs)
        return json.dumps({"rendered": text}, ensure_ascii=False) if a.json else text
    if a.parse is not None:
        d = read.read(a.parse or stdin)
        if a.json:
            rows = [{k: r[k] for k in ("from", "to", "directed")} | ({"label": r["label"]} if r["label"] else {}) for r in d.rows()]
            return json.dumps({"boxes": [b.text for b in d.boxes], "edges": rows}, ensure_ascii=False)
        lines = ["Boxes:", *(f"  {b.text.replace(chr(10), ' ')}" for b in d.boxes), "Edges:"]
        return "\n".join([*lines, *(f"  {r['from']} {r['sign']} {r['to']}" + (f" [{r['label']}]" if r["label"] else "") for r in d.rows())])
    return "Usage: graph --render <edges> | --parse"


def main(args: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    if args[:1] == ["graph"]:
        print(graph_command(args[1:], "" if sys.stdin.isatty() else sys.stdin.read()))
        return 0
    p = argparse.ArgumentParser(add_help=False)
    p.add_argument("-w", "--workspace", default=".")
    p.add_argument("--store")
    known, rest = p.parse_known_args(args)
    from ..session import local_session, ship

    spark: SparkSession = local_session()
    ship(spark)
    index, stats = index_work_tree(spark, known.workspace, known.store or f"{known.workspace.rstrip('/')}/.lodestone")
    ctx = Context(Tables(index), root=known.workspace, stats=stats)
    if rest[:1] == ["batch"]:
        flags, _ = parse(rest)
        for text in batch(replace(ctx, flags=flags), sys.stdin.read().splitlines()):
            print(text)
    else:
        print(answer(ctx, rest))
    return 0


if __name__ == "__main__":
    sys.exit(main())
