"""Command line: ls, search, show, export, stats, sources; probe for compressed files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from skein.engine import Engine
from skein.functions.display import format_count, human_bytes
from skein.functions.render import load_session, print_json, to_json, to_markdown, to_text
from skein.plans import commands
from skein.session import local_session
from skein.sources.stores import ROOTS, probe

ALIASES = {"list": "ls", "grep": "search", "cat": "show"}


# The commands with their own options; all but ``probe`` and ``help`` have the common ones, too.
COMMANDS: dict[str, dict[str, dict]] = {
    "ls": {"--no-title": {"action": "store_true"}},
    "search": {"--context": {"type": int, "default": 0}, "--turns": {"action": "store_true"}, "--prefilter": {"action": "store_true"}, "query": {"nargs": "+"}},
    "show": {"--full": {"action": "store_true"}, "--no-tools": {"action": "store_true"}, "id": {"nargs": "?"}},
    "export": {"--full": {"action": "store_true"}, "--format": {"default": "md", "type": str.lower}, "--out": {}, "id": {"nargs": "?"}},
    "stats": {"--by": {"default": "source"}},
    "sources": {},
    "probe": {"files": {"nargs": "+"}},
}


def _parser(command: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"skein {command}")
    if command != "probe":
        p.add_argument("--source")
        p.add_argument("--limit", type=int, default=0 if command == "search" else commands.LIMIT)
        p.add_argument("--json", action="store_true")
        p.add_argument("--root", action="append", default=[], metavar="STORE=DIR")
    for name, how in COMMANDS[command].items():
        p.add_argument(name, **how)
    return p


def main(argv: list[str] | None = None) -> int:
    name, *rest = (sys.argv[1:] if argv is None else argv) or ["help"]
    command = ALIASES.get(name, name)
    if command in ("help", "-h", "--help"):
        print("usage: skein COMMAND [OPTIONS] [WORDS]\n\n" + "\n".join(_parser(c).format_usage().strip() for c in COMMANDS))
        return 0
    if command not in COMMANDS:
        print(f"skein: unknown command {name!r}", file=sys.stderr)
        return 2
    try:
        args = _parser(command).parse_intermixed_args(rest)  # options may stand on either side of words
    except SystemExit as e:
        return int(e.code or 0)
    if command == "probe":
        rows = probe(local_session(), args.files).orderBy("path").collect()
        for r in rows:
            print(f"{r.path}\t{r.status}\t{r.bytes or 0}\t{r.sha256 or ''}")
        return int(any(r.status != "OK" for r in rows))
    if command == "export" and args.format not in ("md", "markdown", "json"):
        print(f"skein: unknown format {args.format!r}", file=sys.stderr)
        return 2
    engine = Engine(local_session(), dict(ROOTS) | dict(r.split("=", 1) for r in args.root), args.source)
    return globals()[f"_{command}"](engine, args)


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _sources(engine: Engine, args) -> int:
    engine.names = None
    rows = {r["source"]: r for r in _rows(commands.sources(engine.sessions))}
    full = [{"name": n, "found": n in rows, "count": rows.get(n, {}).get("sessions", 0), "newest": str(rows[n]["newest"]) if n in rows else ""} for n in ROOTS]
    if args.json:
        print(print_json(full))
    else:
        for r in full:
            print(f"{r['name']:<8} {r['count']:>7}  {r['newest'] if r['found'] else 'not found'}")
    return 0


def _ls(engine: Engine, args) -> int:
    top = commands.newest(engine.sessions, args.limit)
    plain = args.json or args.no_title
    rows = _rows(commands.ls(top, None if plain else engine.only(top).transcripts, 0))
    if args.json:
        print(print_json(rows))
        return 0
    for r in rows:
        print(f"{r['modified'][:16].replace('T', ' ')}  {r['source']:<6} {r['id'].removeprefix('session-')[:9]:<9} {human_bytes(r['bytes']):>8}  {r['title'][:60]}")
    return 0 if rows else 1


def _search(engine: Engine, args) -> int:
    query = " ".join(args.query)
    kept, counts = engine.narrowed(query, args.prefilter)
    rows = _rows(commands.search(kept.turns, kept.sessions, kept.transcripts, query, args.limit, args.context, args.turns))
    if args.json:
        print(print_json(rows))
        return 0
    for r in rows:
        print(f"{r['time']}  {r['source']:<6} {r['session']:<9} {r['role']:<9} {r['title'][:40]}\n    {r['snippet']}")
    found = f"{len(rows)} match(es)" if rows else "skein: no matches"
    print(f"\n{found}, {counts['scanned']} session(s) scanned, {counts['skipped']} skipped, {counts['unreadable']} unreadable", file=sys.stderr)
    return 0 if rows else 1


def _stats(engine: Engine, args) -> int:
    some = engine.only(commands.newest(engine.sessions, args.limit))
    if args.json:
        print(print_json([{k: v for k, v in r.items() if k not in ("first", "last")} for r in _rows(commands.stats(some.transcripts, args.by))]))
        return 0
    print(f"{args.by.upper():<28} {'SESSIONS':>8} {'MSGS':>8} {'TOOLS':>7} {'TOKENS':>10} {'CHARS':>12}")
    for r in _rows(commands.stats(some.transcripts, args.by, total=True)):
        tail = "" if r["key"] == "TOTAL" else f"{format_count(r['chars']):>12}"
        print(f"{r['key'][:28]:<28} {r['sessions']:>8} {r['messages']:>8} {'' if r['key'] == 'TOTAL' else r['tool_calls']:>7} {format_count(r['total_tokens']):>10} {tail}")
    if failed := some.unreadable().count():
        print(f"skein: {failed} session(s) could not be read", file=sys.stderr)
    return 0


def _one(engine: Engine, args):
    one = engine.only(commands.resolve(engine.sessions, args.id))
    path = one.sessions.first()
    if path is None:
        raise commands.Unresolved("no sessions found")
    return one, path["path"]


def _show(engine: Engine, args) -> int:
    try:
        one, path = _one(engine, args)
    except commands.Unresolved as e:
        print(f"skein: {e}", file=sys.stderr)
        return 1
    t = load_session(one.transcripts, one.turns, path)
    print(to_json(t) if args.json else to_text(t, args.full, args.no_tools), end="")
    return 0


def _export(engine: Engine, args) -> int:
    try:
        one, path = _one(engine, args)
    except commands.Unresolved as e:
        print(f"skein: {e}", file=sys.stderr)
        return 1
    if args.format == "json":
        text = to_json(load_session(one.transcripts, one.turns, path)) + "\n"
    else:
        text = to_markdown(one.transcripts.where(F.col("path") == path), one.turns, args.full)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
