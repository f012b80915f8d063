"""Records to typed rows: what one line contributes to its session.

Input: ``source, path, line_no, raw``. Output, one row for each line that is not
blank: ``source, path, line_no, malformed, ts, cwd, id, title, model, usage, turns`` where
``turns`` is an array of (role, model, tool_calls, blocks, titles), empty for most record
types. A field of the wrong type makes its record, or its payload, undecodable, as the
stores' own readers have it; nothing is cast on the way.

A line is read once, in Arrow batches: telling a missing field from one of a wrong type takes several calls
for each field by expressions over VARIANT, which made them some four times slower. Times are
parsed and everything behind is folded by expressions.

Defined results: of lines that stand at one place and differ, the smallest text counts; of a key
that a record repeats the last value counts, whatever its depth; sources without a reader give nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.json_text import read, write
from skein.functions.text import ELLIPSIS, SUMMARY_CHARS, from_millis, parse_time
from skein.operators.parse_rows import MALFORMED, SKIPPED, by_source, white_only, whole_text

BLOCK = "struct<kind:string,text:string,name:string,input:string,is_error:boolean>"
TURN = f"struct<role:string,model:string,tool_calls:int,blocks:array<{BLOCK}>,titles:boolean>"
USAGE = "struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint,reasoning:bigint>"

#: A block is (kind, text, name, input, is_error), a turn (role, model, tool_calls, blocks, titles).
Block = tuple[str, str, str, str, bool]
Turn = tuple[str, str, int, list[Block], bool]
_LONG = 1 << 63


def _is_int(v: Any) -> bool:
    return type(v) is int and -_LONG <= v < _LONG


_KINDS: dict[str, Callable[[Any], bool]] = {"string": lambda v: type(v) is str, "int": _is_int, "bool": lambda v: type(v) is bool, "array": lambda v: type(v) is list, "object": lambda v: type(v) is dict}


def fits(v: dict, **wanted: str) -> bool:
    """Whether every named field (``a__b`` for a.b) is missing, null or of its kind."""
    for name, kind in wanted.items():
        at: Any = v
        for part in name.split("__"):
            at = at.get(part) if type(at) is dict else None
        if at is not None and not _KINDS[kind](at):
            return False
    return True


def all_fit(items: list, **wanted: str) -> bool:
    """Whether all elements are null, or objects whose named fields fit."""
    return all(x is None or type(x) is dict and fits(x, **wanted) for x in items)


def field(v: Any, name: str, empty: Any) -> Any:
    """A field's value if it is of the kind of ``empty``, else that."""
    got = v.get(name) if type(v) is dict else None
    return got if type(got) is type(empty) and (type(got) is not int or _is_int(got)) else empty


def said(text: str) -> bool:
    """Has a character that is no white space."""
    return bool(text.strip()) or not white_only(text)


def summarise(value: Any) -> str:
    """A JSON value as one line of at most 200 code points: keys sorted, ``<``, ``>`` and ``&`` escaped."""
    if value is None:
        return ""
    text = write(value, compact=True)
    for c in "&<>  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    line = " ".join(text.split())
    return line if len(line) <= SUMMARY_CHARS else line[:SUMMARY_CHARS] + ELLIPSIS


def text_block(text: str, kind: str = "text") -> Block:
    return kind, text, "", "", False


def texts(items: list, kinds: dict[str, str]) -> list[Block]:
    """Non-blank texts of content items as blocks; ``kinds`` maps item types to block kinds."""
    return [text_block(x["text"], kinds[x["type"]]) for x in items if type(x) is dict and x.get("type") in kinds and type(x.get("text")) is str and said(x["text"])]


class Line:
    """What a line contributes; empty texts stand for nothing."""

    __slots__ = ("time", "millis", "cwd", "id", "title", "model", "usage", "turns")

    def __init__(self):
        self.time, self.millis, self.cwd, self.id, self.title, self.model = "", 0, "", "", "", ""
        self.usage: tuple[int, ...] | None = None
        self.turns: list[Turn] = []

    def turn(self, role: str, blocks: list[Block], model: str = "", calls: int = 0, titles: bool = False) -> None:
        if blocks:
            self.turns.append((role, model, calls, blocks, titles))


# The stores' record types and field names, and the usage they count, in the order of ``USAGE``.
CLAUDE_USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
CODEX_USAGE = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")
DSH_USAGE = ("inputTokens", "outputTokens", "cacheReadTokens", "reasoningTokens")


def claude_blocks(m: dict) -> list[Block]:
    content = m.get("content")
    if type(content) is str:
        return [text_block(content)] if said(content) else []
    if type(content) is not list or not all_fit(content, type="string", text="string", thinking="string", name="string", is_error="bool"):
        return []
    out = []
    for x in content:
        kind = field(x, "type", "")
        if kind in ("text", "thinking"):
            if said(shown := field(x, kind, "")):
                out.append(text_block(shown, kind))
        elif kind == "tool_use":
            out.append((kind, "", field(x, "name", ""), summarise(x.get("input")), False))
        elif kind == "tool_result":
            out.append((kind, summarise(x.get("content")), "", "", field(x, "is_error", False)))
    return out


def claude(v: dict, out: Line) -> None:
    out.time, out.cwd = field(v, "timestamp", ""), field(v, "cwd", "")
    role, m = field(v, "type", ""), v.get("message")
    if role not in ("user", "assistant") or type(m) is not dict:
        return
    counts = {f"usage__{k}": "int" for k in CLAUDE_USAGE}
    if not fits(m, role="string", model="string", usage="object", **counts, usage__output_tokens_details="object", usage__output_tokens_details__thinking_tokens="int"):
        return
    blocks = claude_blocks(m)
    if role == "user":
        out.turn(role, blocks, titles=True)
    elif blocks:
        out.turn(role, blocks, field(m, "model", ""), sum(b[0] == "tool_use" for b in blocks))
        u = field(m, "usage", {})
        out.usage = (*(field(u, k, 0) for k in CLAUDE_USAGE), field(u.get("output_tokens_details"), "thinking_tokens", 0))


def codex(v: dict, out: Line) -> None:
    out.time = field(v, "timestamp", "")
    p = v.get("payload")
    counts = {f"info__total_token_usage__{k}": "int" for k in CODEX_USAGE}
    texts_of = ("type", "cwd", "id", "role", "name", "input")
    if type(p) is not dict or not fits(p, **dict.fromkeys(texts_of, "string"), content="array", info="object", info__total_token_usage="object", **counts):
        return
    content = field(p, "content", [])
    if not all_fit(content, type="string", text="string"):
        return
    record, kind, role = field(v, "type", ""), field(p, "type", ""), field(p, "role", "")
    if record == "session_meta":
        out.cwd, out.id = field(p, "cwd", ""), field(p, "id", "")
    elif record == "event_msg" and kind == "token_count" and type(p.get("info")) is dict:
        u = field(p["info"], "total_token_usage", {})
        out.usage = tuple(field(u, k, 0) for k in CODEX_USAGE)
    elif record == "response_item":
        if kind == "message" and role in ("user", "assistant", "system"):
            out.turn(role, texts(content, dict.fromkeys(("input_text", "output_text", "text"), "text")), titles=role == "user")
        elif kind == "reasoning" and fits(p, summary="array") and all_fit(field(p, "summary", []), text="string"):
            thoughts = [t for x in field(p, "summary", []) if said(t := field(x, "text", ""))]
            out.turn("assistant", [text_block("\n".join(thoughts), "thinking")] if thoughts else [])
        elif kind in ("function_call", "custom_tool_call"):
            out.turn("assistant", [("tool_use", "", field(p, "name", ""), field(p, "input", ""), False)], calls=1)
        elif kind in ("function_call_output", "custom_tool_call_output"):
            out.turn("tool", [text_block(field(p, "input", ""), "tool_result")])


def dsh(v: dict, out: Line) -> None:
    out.millis = field(v, "time", 0)
    d, record = v.get("data"), field(v, "type", "")
    if type(d) is not dict:
        return
    inner = {"type": "string", "text": "string"}
    message = field(d, "message", {})
    parts = field(message, "content", [])
    if record in ("user/message", "agent/inbox/spliced"):
        own = field(d, "content", [])
        if record == "user/message" and fits(d, content="array") and all_fit(own, **inner):
            out.turn("user", texts(own, {"text": "text"}), titles=True)
        elif fits(d, inserted="array") and all_fit(some := field(d, "inserted", []), content="array") and all(all_fit(field(x, "content", []), **inner) for x in some):
            for x in some:
                out.turn("user", texts(field(x, "content", []), {"text": "text"}))
    elif record == "assistant/message":
        counts = {f"usage__{k}": "int" for k in DSH_USAGE}
        if fits(d, message="object", message__role="string", message__content="array", usage="object", **counts) and all_fit(parts, **inner):
            out.turn("assistant", texts(parts, {"text": "text", "reasoning": "thinking"}))
            if type(u := d.get("usage")) is dict:
                spent = [field(u, k, 0) for k in DSH_USAGE]
                out.usage = (*spent[:3], 0, spent[3])
    elif record == "tool/call":
        if fits(d, name="string", arguments="string"):
            out.turn("assistant", [("tool_use", "", field(d, "name", ""), field(d, "arguments", ""), False)], calls=1)
    elif record == "tool/result":
        if fits(d, message="object", message__content="array") and all_fit(parts, type="string", content="array") and all(all_fit(field(x, "content", []), **inner) for x in parts):
            shown = "".join(field(y, "text", "") for x in parts for y in field(x, "content", []) if field(y, "type", "") == "text")
            out.turn("tool", [text_block(shown, "tool_result")] if shown else [])
    elif record == "assistant/attempt":
        stream = field(d, "stream", [])
        if fits(d, stream="array") and all_fit(stream, chunk="object", chunk__type="string", chunk__usage="object", chunk__usage__inputTokens="int", chunk__usage__outputTokens="int"):
            used = [field(c, "usage", {}) for x in stream if field(c := field(x, "chunk", {}), "type", "") == "usage"]
            # sums wrap as 64-bit numbers do
            total = [(sum(field(u, k, 0) for u in used) + _LONG) % (2 * _LONG) - _LONG for k in DSH_USAGE[:2]]
            out.usage = (*total, 0, 0, 0)
    elif record == "session":
        out.cwd = field(d, "cwd", "")
    elif record == "session/title":
        out.title = field(d, "title", "")
    elif record == "request/header":
        if fits(d, header="object", header__config="object", header__config__provider="string", header__config__model="string"):
            out.model = field(field(field(d, "header", {}), "config", {}), "model", "")


READERS: dict[str, Callable[[dict, Line], None]] = {"claude": claude, "codex": codex, "dsh": dsh}
_COLUMNS = f"source string, path string, line_no bigint, malformed boolean, time string, millis bigint, cwd string, id string, title string, model string, usage {USAGE}, turns array<{TURN}>"
_NAMES = ["source", "path", "line_no", "malformed", "time", "millis", "cwd", "id", "title", "model", "usage", "turns"]


def _strings(values: list[str]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # a lone surrogate
        return pa.array([whole_text(v) for v in values], pa.string())


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _turns(lines: list[Line]) -> pa.Array:
    flat = [t for x in lines for t in x.turns]
    blocks = [b for t in flat for b in t[3]]
    columns = [_strings([b[k] for b in blocks]) for k in range(4)]
    block = pa.StructArray.from_arrays([*columns, pa.array([b[4] for b in blocks], pa.bool_())], ["kind", "text", "name", "input", "is_error"])
    turn = pa.StructArray.from_arrays(
        [_strings([t[0] for t in flat]), _strings([t[1] for t in flat]), pa.array([t[2] for t in flat], pa.int32()), _lists([len(t[3]) for t in flat], block), pa.array([t[4] for t in flat], pa.bool_())],
        ["role", "model", "tool_calls", "blocks", "titles"],
    )
    return _lists([len(x.turns) for x in lines], turn)


def _usage(lines: list[Line]) -> pa.Array:
    none = (0,) * 5
    columns = [pa.array([(x.usage or none)[k] for x in lines], pa.int64()) for k in range(5)]
    return pa.StructArray.from_arrays(columns, ["input", "output", "cache_read", "cache_write", "reasoning"], mask=pa.array([x.usage is None for x in lines], pa.bool_()))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for whole in batches:
        for lo in range(0, whole.num_rows, 4000):
            b = whole.slice(lo, 4000)
            places = list(zip(*(b.column(c).to_pylist() for c in ("source", "path", "line_no"))))
            # equal places are neighbours, the smallest text first
            new = np.array([p != q for p, q in zip(places, [last, *places])], dtype=bool)
            last = places[-1]
            b = b.filter(pa.array(new))
            status, _, _ = by_source(b)
            at = np.flatnonzero(status != SKIPPED)
            b, bad = b.take(pa.array(at)), (status[at] == MALFORMED).tolist()
            lines = []
            for source, raw, broken in zip(b.column("source").to_pylist(), b.column("raw").to_pylist(), bad):
                lines.append(out := Line())
                if not broken:
                    READERS[source](read(raw), out)
            texts_ = [pa.array([whole_text(v) or None for v in (getattr(x, k) for x in lines)], pa.string()) for k in ("time", "cwd", "id", "title", "model")]
            millis = pa.array([x.millis for x in lines], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("source", "path", "line_no")), pa.array(bad, pa.bool_()), texts_[0], millis, *texts_[1:], _usage(lines), _turns(lines)], _NAMES)


def decode(records: DataFrame) -> DataFrame:
    """All sources together, each line once. One shuffle by place, so that a path with a third of all lines is
    spread, brings lines that were read twice together before they are parsed."""
    known = records.where(F.col("source").isin(list(READERS)) & (F.col("raw") != "")).select("source", "path", "line_no", "raw")
    placed = known.repartition(F.xxhash64("path", "line_no")).sortWithinPartitions("source", "path", "line_no", "raw")
    rows = placed.mapInArrow(_run, _COLUMNS)
    ts = F.when(F.col("source") == "dsh", from_millis(F.col("millis"))).otherwise(parse_time(F.col("time")))
    return rows.select("source", "path", "line_no", "malformed", ts.alias("ts"), "cwd", "id", "title", "model", "usage", "turns")
