"""Rows that fail to parse: load the good lines, set the bad ones apart with a reason.

Lines are parsed in blocks by Arrow's columnar JSON and CSV readers. A block that
the reader refuses is halved until the bad lines stand alone; only those reach the
strict, line-at-a-time diagnosis that names the reason.

Defined results for odd input (all covered by tests): a null or empty record line
is ``skipped``; the literal ``null`` is ``skipped``; white space alone is
``malformed`` for claude and codex and ``skipped`` for dsh; a null or unknown source
is checked for its ``type`` only; lines may be nested to any depth; of a key that a record repeats every
value must be of its type; repeated rows are classified alike.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
import pyarrow.json as pjson
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.json_text import BLANKS, read, read_deep
from skein.session import spread

RECORD, MALFORMED, SKIPPED = 0, 1, 2
STATUS = np.array(["record", "malformed", "skipped"], dtype=object)
BLOCK_LINES = 128
#: A line of more opening brackets goes to the strict parser at once, as Arrow's reader has a limit to its depth.
DEEP = 800

# The envelope fields of each source and their JSON types.
ENVELOPE = {
    "claude": {"type": "string", "timestamp": "string", "cwd": "string"},
    "codex": {"type": "string", "timestamp": "string"},
    "dsh": {"type": "string", "seq": "int", "time": "int"},
    None: {"type": "string"},
}
INDEX_FIELDS = ["source", "id", "path", "cwd", "bytes", "mod_time"]

_ARROW = {"string": pa.string(), "int": pa.int64()}
#: Arrow's reader takes these words as numbers, RFC 8259 doesn't.
_NOT_FINITE = r"[\[:,\s-](?:NaN|Inf|Infinity)[\s,\]}]"
#: Unicode White_Space.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")


def white_only(text: str) -> bool:
    return _WHITE.fullmatch(text) is not None


class _Pairs(list):
    """A JSON object as its key-value pairs, so that repeated keys stay visible."""


def whole_text(value):
    """A decoded JSON string that Arrow can hold: lone surrogates become U+FFFD."""
    if isinstance(value, str) and not value.isascii():
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return value


def _refuse(name: str):
    raise ValueError(f"constant {name}")


#: An integer's type matters here, not its value, so any number of digits is fine.
_STRICT = json.JSONDecoder(object_pairs_hook=_Pairs, parse_constant=_refuse, parse_int=lambda s: 0, parse_float=lambda s: 0.5)


def json_type(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, (dict, _Pairs)) else "array"


def diagnose(line: str | None, source: str | None) -> tuple[int, str | None]:
    """Status and reason of one line by RFC 8259 and the envelope's types."""
    if line is None or line == "":
        return SKIPPED, None
    if white_only(line):
        return (SKIPPED, None) if source == "dsh" else (MALFORMED, "blank_line")
    try:
        try:
            value = _STRICT.decode(line.strip(BLANKS))
        except RecursionError:
            value = read_deep(line.strip(BLANKS), _Pairs, lambda s: 0)
    except ValueError as e:
        text = line.strip(BLANKS)
        if text.startswith("\ufeff"):
            return MALFORMED, "byte_order_mark"
        at = getattr(e, "pos", None)
        if at is None:
            return MALFORMED, "not_a_json_number"
        if e.msg == "Extra data":
            return MALFORMED, "trailing_data"
        if e.msg.startswith("Unterminated string") or at >= len(text):
            return MALFORMED, "truncated"
        if e.msg.startswith("Invalid control character"):
            return MALFORMED, "control_character"
        if e.msg.startswith("Invalid \\"):
            return MALFORMED, "bad_escape"
        return MALFORMED, "not_json" if at == 0 else "bad_syntax"
    if value is None:
        return SKIPPED, None
    if not isinstance(value, _Pairs):
        return MALFORMED, "not_an_object"
    wanted = ENVELOPE.get(source, ENVELOPE[None])
    for key, v in value:
        if key in wanted and v is not None and json_type(v) != wanted[key]:
            return MALFORMED, f"wrong_type:{key}"
    return RECORD, None


def _read_json(lines: list[bytes], schema: pa.Schema) -> pa.Table | None:
    data = b"\n".join(lines)
    try:
        got = pjson.read_json(
            io.BytesIO(data),
            read_options=pjson.ReadOptions(use_threads=False, block_size=len(data) + 64),
            parse_options=pjson.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore"),
        )
    except pa.ArrowInvalid:
        return None
    # every line starts with { and ends with }, so two lines can't have been read as one value;
    # a line that holds two values makes a row too many
    return got if got.num_rows == len(lines) else None


def _bisect(read, lines: list, lo: int, hi: int, good: list, bad: list) -> None:
    """Parse lines[lo:hi]; on failure halve until single bad lines are left."""
    got = read(lines[lo:hi])
    if got is not None:
        good.append((lo, got))
    elif hi - lo == 1:
        bad.append(lo)
    else:
        mid = (lo + hi) // 2
        _bisect(read, lines, lo, mid, good, bad)
        _bisect(read, lines, mid, hi, good, bad)


def parse_lines(raw: pa.Array, source: str | None, wanted: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Status code, reason and the wanted envelope fields of the lines of one source."""
    n = len(raw)
    status = np.full(n, RECORD, dtype=np.int8)
    reason = np.full(n, None, dtype=object)
    fields = {k: np.full(n, None, dtype=object) for k in wanted}
    kinds = ENVELOPE.get(source, ENVELOPE[None])
    schema = pa.schema([(k, _ARROW[v]) for k, v in kinds.items()])
    trimmed = pc.utf8_trim(raw, characters=BLANKS)
    framed = pc.and_(pc.starts_with(trimmed, "{"), pc.ends_with(trimmed, "}"))
    depth = pc.add(pc.count_substring(trimmed, "{"), pc.count_substring(trimmed, "["))
    plain = pc.and_(pc.less(depth, DEEP), pc.invert(pc.match_substring_regex(trimmed, _NOT_FINITE)))
    bulk = pc.and_(framed, plain).fill_null(False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(bulk)
    lines = [x.encode() for x in trimmed.take(pa.array(at)).to_pylist()]
    good: list[tuple[int, pa.Table]] = []
    bad: list[int] = []
    for lo in range(0, len(lines), BLOCK_LINES):
        _bisect(lambda part: _read_json(part, schema), lines, lo, min(lo + BLOCK_LINES, len(lines)), good, bad)
    for lo, got in good:
        for k in wanted:
            if k in kinds:
                fields[k][at[lo : lo + got.num_rows]] = got.column(k).to_pylist()
    alone = np.concatenate([at[bad], np.flatnonzero(~bulk)]).astype(np.int64)
    for i in alone:
        line = raw[int(i)].as_py()
        status[i], reason[i] = diagnose(line, source)
        if status[i] == RECORD and wanted:  # e.g. a lone surrogate, which Arrow refuses and RFC 8259 allows
            value = read(line)
            for k in wanted:
                fields[k][i] = whole_text(value.get(k))
    return status, reason, fields


def by_source(batch: pa.RecordBatch, wanted: tuple[str, ...] = ()):
    """Status, reason and fields of a batch with columns ``source`` and ``raw``."""
    n = batch.num_rows
    status, reason = np.zeros(n, dtype=np.int8), np.full(n, None, dtype=object)
    fields = {k: np.full(n, None, dtype=object) for k in wanted}
    raw = batch.column("raw").cast(pa.string())
    source = np.array(batch.column("source").to_pylist(), dtype=object)
    for s in set(source.tolist()):
        at = np.flatnonzero(np.array([x == s for x in source], dtype=bool))
        st, re_, fl = parse_lines(raw.take(pa.array(at)), s, wanted)
        status[at], reason[at] = st, re_
        for k in wanted:
            fields[k][at] = fl[k]
    return status, reason, fields


def classify_records(records: DataFrame) -> DataFrame:
    """``path, line_no, source, status, reason, rtype`` for every line of ``records``.

    ``status`` is ``record``, ``malformed`` or ``skipped``. Extra columns of the input
    are ignored, so their names can't clash. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, reason, fields = by_source(b, ("type",))
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), b.column("line_no"), b.column("source"), pa.array(STATUS[status], pa.string()), pa.array(reason, pa.string()), pa.array(fields["type"], pa.string())],
                ["path", "line_no", "source", "status", "reason", "rtype"],
            )

    return spread(records.select("path", "line_no", "source", "raw")).mapInArrow(run, "path string, line_no bigint, source string, status string, reason string, rtype string")


def load_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: the valid lines with their raw text, and the bad ones with place and reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, _, fields = by_source(b, ("type",))
            keep = pa.array(status == RECORD)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("source", "path", "line_no", "raw")), pa.array(fields["type"], pa.string())], ["source", "path", "line_no", "raw", "rtype"])
            yield out.filter(keep)

    valid = spread(records.select("source", "path", "line_no", "raw")).mapInArrow(run, "source string, path string, line_no bigint, raw string, rtype string")
    rejected = classify_records(records).where("status = 'malformed'").select("path", "line_no", "source", "reason")
    return valid, rejected


# --- comma-separated listings -------------------------------------------------------------

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_SIX = f"^{_FIELD}(?:,{_FIELD}){{5}}$"
_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"
SOURCES = ("claude", "codex", "dsh")


def split_row(line: str) -> list[str] | None:
    """The fields of one line by RFC 4180, or None where its quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, part = i + 1, []
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                part.append(line[i:j])
                if j + 1 < n and line[j + 1] == '"':
                    part.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            out.append("".join(part))
            if i < n and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


def diagnose_row(line: str | None) -> tuple[int, str | None]:
    """Status and reason of one listing line; an empty or null one has too few fields."""
    fields = split_row(line or "")
    if fields is None:
        return MALFORMED, "broken_quoting"
    if len(fields) != len(INDEX_FIELDS):
        return MALFORMED, "wrong_column_count"
    if fields[0] not in SOURCES:
        return MALFORMED, "unknown_source"
    if not re.fullmatch("[0-9]+", fields[4]):
        return MALFORMED, "invalid_bytes"
    if not re.fullmatch(_TIME, fields[5], re.ASCII):
        return MALFORMED, "invalid_mod_time"
    try:
        np.datetime64(fields[5][:-1], "s")
    except ValueError:
        return MALFORMED, "no_such_time"
    return RECORD, None


def _read_csv(lines: list[str]) -> pa.Table | None:
    arr = pa.array(lines, pa.string())
    if not pc.all(pc.match_substring_regex(arr, _SIX)).as_py():
        return None
    try:
        got = pcsv.read_csv(
            io.BytesIO("\n".join(lines).encode()),
            read_options=pcsv.ReadOptions(column_names=INDEX_FIELDS, use_threads=False),
            parse_options=pcsv.ParseOptions(double_quote=True, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={c: pa.string() for c in INDEX_FIELDS}, strings_can_be_null=False),
        )
        if got.num_rows != len(lines):
            return None
        ok = pc.and_(pc.is_in(got["source"], pa.array(SOURCES)), pc.and_(pc.match_substring_regex(got["bytes"], "^[0-9]+$"), pc.match_substring_regex(got["mod_time"], _TIME)))
        if not pc.all(ok).as_py():
            return None
        pc.cast(got["mod_time"], pa.timestamp("s", "UTC"))
    except pa.ArrowInvalid:
        return None
    return got


def load_index(index_lines: DataFrame) -> DataFrame:
    """Every listing line after the header: ``path_of_index, line_no, status, reason`` and the six
    fields (null on malformed lines). Line 1 is the header; rows with a null line_no count as data."""
    names = ["index_path", "line_no", "status", "reason", *INDEX_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw").to_pylist()
            whole = [i for i, x in enumerate(raw) if x and "\n" not in x and "\r" not in x]
            lines = [raw[i] for i in whole]
            good: list[tuple[int, pa.Table]] = []
            bad: list[int] = []
            for lo in range(0, len(lines), BLOCK_LINES):
                _bisect(_read_csv, lines, lo, min(lo + BLOCK_LINES, len(lines)), good, bad)
            status, reason = np.full(len(raw), MALFORMED, dtype=np.int8), np.full(len(raw), None, dtype=object)
            cols = {c: np.full(len(raw), None, dtype=object) for c in INDEX_FIELDS}
            at = np.array(whole, dtype=np.int64)
            for lo, got in good:
                rows = at[lo : lo + got.num_rows]
                status[rows] = RECORD
                for c in INDEX_FIELDS:
                    cols[c][rows] = got.column(c).to_pylist()
            for i in np.flatnonzero(status != RECORD):
                status[i], reason[i] = diagnose_row(raw[i])
                if status[i] == RECORD:
                    for c, v in zip(INDEX_FIELDS, split_row(raw[i])):
                        cols[c][i] = v
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), b.column("line_no"), pa.array(STATUS[status], pa.string()), pa.array(reason, pa.string()), *(pa.array(cols[c], pa.string()) for c in INDEX_FIELDS)], names
            )

    data = index_lines.where("line_no is null or line_no > 1").select("path", "line_no", "raw")
    out = spread(data).mapInArrow(run, "index_path string, line_no bigint, status string, reason string, " + ", ".join(f"{c} string" for c in INDEX_FIELDS))
    return out.withColumn("bytes", F.expr("try_cast(bytes as bigint)")).withColumn("mod_time", F.expr("try_cast(mod_time as timestamp)"))


def find_malformed(records: DataFrame, index_lines: DataFrame) -> DataFrame:
    """``path, line_no`` of every bad line of both tables, once each."""
    a = classify_records(records).where("status = 'malformed'").select("path", "line_no")
    b = load_index(index_lines).where("status = 'malformed'").select(F.col("index_path").alias("path"), "line_no")
    return a.unionByName(b).distinct()
