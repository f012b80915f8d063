"""Deeply nested records as flat, linked tables.

A depth-first walk gives every JSON object of a record a pre-order and a post-order
number. Object a contains object d exactly if ``a.pre < d.pre and a.post > d.post``, so
any two of the flat tables join on ``(path, line_no)`` and that interval test; the
nearest container is also kept as ``parent``.

Defined results: lines that are no records give no rows; repeated lines give one set of
rows; reading and walking use stacks of their own, so any depth will do; JSON text inside strings
stays text; numbers and booleans appear as JSON text in ``scalars``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.json_text import read, write
from skein.operators.parse_rows import RECORD, by_source, whole_text
from skein.session import spread, written

NODE_SCHEMA = "path string, line_no bigint, source string, rtype string, pre int, post int, parent int, depth int, item string, node_type string, in_array boolean, scalars map<string,string>"


#: From this length on places are kept as links and only put together when written, so that a record of any
#: depth needs memory in proportion to its length.
LONG_PLACE = 2000
#: Characters of places after which rows are handed on.
FLUSH_CHARS = 4_000_000


def _add(place, piece: str):
    return place + piece if type(place) is str and len(place) < LONG_PLACE else (place, piece)


def place_text(place) -> str:
    parts = []
    while type(place) is tuple:
        place, piece = place
        parts.append(piece)
    return place + "".join(reversed(parts))


def walk(value: dict) -> list[list]:
    """``[pre, post, parent, depth, item, node_type, in_array, object]`` of every object, in pre-order; items and
    types are for :func:`place_text`."""
    nodes = [[0, -1, None, 0, "", "", False, value]]
    post = 0
    # entries: a value to look into, or the index of a node whose content is finished
    stack: list = [0]
    todo = [(v, 0, 1, k, k, False) for k, v in reversed(value.items()) if type(v) in (dict, list)]
    stack.extend(todo)
    while stack:
        entry = stack.pop()
        if type(entry) is int:
            nodes[entry][1] = post
            post += 1
            continue
        v, parent, depth, item, kind, in_array = entry
        if type(v) is dict:
            at = len(nodes)
            nodes.append([at, -1, parent, depth, item, kind, in_array, v])
            stack.append(at)
            for k, x in reversed(v.items()):
                if type(x) in (dict, list):
                    stack.append((x, at, depth + 1, _add(item, f".{k}"), _add(kind, f".{k}"), False))
        else:
            for i in range(len(v) - 1, -1, -1):
                if type(v[i]) in (dict, list):
                    stack.append((v[i], parent, depth, _add(item, f"[{i}]"), _add(kind, "[]"), True))
    return nodes


def _scalar(v) -> str | None:
    if v is None:
        return None
    return whole_text(v) if isinstance(v, str) else write(v)


def nodes(records: DataFrame, elements_only: bool = False, scalars: bool = True, with_copy: bool = False) -> DataFrame:
    """The node table of all records (columns of ``NODE_SCHEMA``); repeated lines repeat.

    ``elements_only`` keeps objects that stand in an array; ``scalars=False`` leaves the
    map of plain fields null; ``with_copy`` adds ``copy``, a hash of the line and its source.
    """
    schema = NODE_SCHEMA + ", copy bigint" * with_copy
    names = [c.split()[0] for c in NODE_SCHEMA.replace("map<string,string>", "map").split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string())]
    if with_copy:
        names, types = [*names, "copy"], [*types, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, _, fields = by_source(b, ("type",))
            keep = np.flatnonzero(status == RECORD)
            rows: list[list] = [[] for _ in names]
            put = [c.append for c in rows]
            paths, lines, sources, raws = (b.column(c).to_pylist() for c in ("path", "line_no", "source", "raw"))
            copies = b.column("copy").to_pylist() if with_copy else None
            size = 0
            for i in keep.tolist():
                more = (copies[i],) if with_copy else ()
                for pre, post, parent, depth, item, kind, in_array, obj in walk(read(raws[i])):
                    if elements_only and not in_array:
                        continue
                    plain = [(whole_text(k), _scalar(v)) for k, v in obj.items() if type(v) not in (dict, list)] if scalars else None
                    for p, v in zip(put, (paths[i], lines[i], sources[i], fields["type"][i], pre, post, parent, depth, item := whole_text(place_text(item)), whole_text(place_text(kind)), in_array, plain, *more)):
                        p(v)
                    size += len(item)
                    if len(rows[0]) > 20_000 or size > FLUSH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
                        size = 0
                        for c in rows:
                            c.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    copy = [F.xxhash64("source", "raw").alias("copy")] if with_copy else []
    return spread(records.select("path", "line_no", "source", "raw", *copy)).mapInArrow(run, schema)


def node_tables(node_rows: DataFrame, node_types: list[str]) -> dict[str, DataFrame]:
    """One flat table for each asked node type (``""`` is the record itself)."""
    return {t: node_rows.where(F.col("node_type") == t) for t in node_types}


def contained(outer: DataFrame, inner: DataFrame, keys: Sequence[str] = ("path", "line_no")) -> DataFrame:
    """Pairs of an outer node and the nodes inside it, by interval containment within a record.

    The equality on the keys that tell a record makes this a hash or merge join on records, whose
    node counts bound the pairs. Columns: ``path, line_no, outer_item, item``.
    """
    o = outer.select(*keys, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.col("item").alias("outer_item"))
    i = inner.select(*keys, "pre", "post", "item")
    return o.join(i, list(keys)).where("o_pre < pre and o_post > post").select("path", "line_no", "outer_item", "item")


def linked_nodes(records: DataFrame) -> DataFrame:
    """The node tables of all records (told apart by ``node_type``), each line once, with the parent's number:
    ``path, line_no, source, rtype, pre, post, parent, depth, item, node_type, in_array, scalars``. Of the nodes whose
    interval holds a node's, ``parent`` is the one that begins last; a record itself has none."""
    return nodes(records.select("path", "line_no", "source", "raw").distinct())


def item_links(records: DataFrame) -> DataFrame:
    """``path, line_no, outer_item, item``: every element of an array with the elements around it, by interval
    containment, once each. Only numbers and places are joined; lines of one place that differ stay apart."""
    found = written(nodes(records, elements_only=True, scalars=False, with_copy=True).select("path", "line_no", "copy", "pre", "post", "item").distinct())
    return contained(found, found, ["path", "line_no", "copy"]).distinct()


def find_array_objects(records: DataFrame) -> DataFrame:
    """``path, line_no, item`` of every object that is an element of an array, once each."""
    return nodes(records, elements_only=True, scalars=False).select("path", "line_no", "item").distinct()
