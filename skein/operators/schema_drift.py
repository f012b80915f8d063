"""Schemas that drift between files: one consistent table and a report of every change.

1. *Profile.* Every record is laid over the catalogue of expected fields. The values of
   catalogued fields feed column sketches; fields that are missing or unlisted are noted
   with sketches of their own. Sketches are small, mergeable and made in the scan, so only
   they are shuffled.
2. *Match.* Where an object lacks required fields and has unlisted ones, a maximum-weight
   bipartite matching between the two sets, scored by type, values and name, decides which
   are renames.
3. *Unify.* :func:`unified_records` applies the matching and yields one table.

Defined results: lines that are no records and records without a string type are left
out; a null value is always of a listed type; a null object has no fields to miss; an
empty catalogue makes every record type ``added``; repeated lines report once.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.json_text import read, write
from skein.operators.parse_rows import RECORD, by_source, json_type, whole_text
from skein.session import spread, written

#: Values kept of a column: the K smallest hashes of distinct values, an unbiased sample of them.
SKETCH_K = 64
#: Distinct values of a known column, often repeated, at which they and their shapes weigh the same; the fewer there
#: are, and the more they repeat, the more the values count.
EVEN_VALUES = 48
MATCH_LEAST = 0.5


class Catalog:
    """Expected fields by (source, rtype), each object's fields grouped under its place."""

    def __init__(self, rows: list[tuple[str, str, str, str, bool]]):
        self.objects: dict[tuple[str, str], dict[str, dict[str, tuple[frozenset[str], bool]]]] = {}
        for source, rtype, field, kinds, required in rows:
            parent, _, name = field.rpartition(".")
            places = self.objects.setdefault((source, rtype), {"": {}})
            places.setdefault(parent, {})[name] = (frozenset((kinds or "any").split("|")), bool(required))

    @classmethod
    def of(cls, field_catalog: DataFrame) -> "Catalog":
        """Reads the catalogue to the driver: one row for each field of the schema, not of the data."""
        return cls([(r.source, r.rtype, r.field, r.json_type, r.required) for r in field_catalog.collect() if r.field is not None and r.rtype is not None])


def rtype_of(source: str | None, record: dict) -> str | None:
    rtype = record.get("type")
    if not isinstance(rtype, str):
        return None
    if source == "codex":
        payload = record.get("payload")
        if isinstance(payload, dict) and isinstance(payload.get("type"), str):
            return f"{rtype}/{payload['type']}"
    return rtype


#: Classes of characters. A text's shape is a set of them and one of six lengths, so there are at most
#: 6 x 2^8 shapes of texts, however many values a column has, and all are counted.
_CLASSES = ("digit", "lower", "upper", "letter", "space", "joint", "slash", "sign")
_HEX = frozenset("0123456789abcdef-")


@lru_cache(maxsize=1 << 16)
def _class_of(c: str) -> int:
    if c.isdigit():
        name = "digit"
    elif c.isalpha():
        name = "letter" if not c.isascii() else "lower" if c.islower() else "upper"
    else:
        name = "space" if c.isspace() else "joint" if c in "-_" else "slash" if c in "/\\" else "sign"
    return 1 << _CLASSES.index(name)


def shape(value) -> str:
    """What a value looks like: character classes and length of a text (all hexadecimal ids of a length
    are alike), magnitude of a number, keys of an object."""
    kind = json_type(value)
    if kind == "string":
        seen = set(value)
        has = 0
        for c in seen:
            has |= _class_of(c)
        if seen <= _HEX and has & 3 == 3:
            has = 3
        return f"s{has:x}~{min(5, int(math.log(len(value) + 1, 4)))}"
    if kind in ("int", "float"):
        return f"n{min(99, int(math.log2(abs(value) + 1) / 2)) if math.isfinite(value) else 99}"
    return kind


def digest(value) -> int:
    if isinstance(value, dict):
        value = "\0".join(sorted(value))
    return xxhash.xxh64_intdigest(value if isinstance(value, str) else write(value), seed=7)


class Sketch:
    """Count, JSON types, all shapes, and the K smallest hashes of the values and of the object keys of a column."""

    __slots__ = ("n", "kinds", "low", "shapes", "keys")

    def __init__(self):
        self.n, self.kinds, self.low, self.shapes, self.keys = 0, {}, set(), {}, set()

    def add(self, value) -> None:
        self.n += 1
        kind = json_type(value)
        self.kinds[kind] = self.kinds.get(kind, 0) + 1
        self.low.add(digest(value))
        s = shape(value)
        self.shapes[s] = self.shapes.get(s, 0) + 1
        inside = value if kind == "object" else {j for x in value if isinstance(x, dict) for j in x} if kind == "array" else ()
        self.keys.update(xxhash.xxh64_intdigest(k, seed=7) for k in inside)
        if len(self.low) > 8 * SKETCH_K or len(self.keys) > 8 * SKETCH_K:
            self.trim()

    def trim(self) -> "Sketch":
        self.low, self.keys = set(heapq.nsmallest(SKETCH_K, self.low)), set(heapq.nsmallest(SKETCH_K, self.keys))
        return self

    def merge(self, o: "Sketch") -> "Sketch":
        self.n += o.n
        self.low |= o.low
        self.keys |= o.keys
        for mine, other in ((self.kinds, o.kinds), (self.shapes, o.shapes)):
            for k, v in other.items():
                mine[k] = mine.get(k, 0) + v
        return self.trim()

    def dump(self) -> str:
        self.trim()
        return json.dumps([self.n, self.kinds, sorted(self.low), self.shapes, sorted(self.keys)])

    @classmethod
    def load(cls, text: str) -> "Sketch":
        self = cls()
        self.n, self.kinds, low, self.shapes, keys = json.loads(text)
        self.low, self.keys = set(low), set(keys)
        return self

    def distinct(self) -> float:
        """Estimated number of distinct values: exact below K, else by the K-th smallest hash."""
        self.trim()
        return float(len(self.low)) if len(self.low) < SKETCH_K else (SKETCH_K - 1) * 2.0**64 / max(self.low)


def _covered(found: dict[str, int], known: dict[str, int]) -> float:
    """Share of the found shapes that the known column also shows; holds for few values, too."""
    return sum(v for k, v in found.items() if k in known) / (sum(found.values()) or 1)


def _contained(found: set[int], known: set[int]) -> float | None:
    """Estimated share of the found hashes that the known column has: among those up to the largest hash
    that a full sketch keeps, as of others nothing is known. None if there is none to tell by."""
    top = heapq.nsmallest(SKETCH_K, known)[-1] if len(known) >= SKETCH_K else math.inf
    told = [h for h in found if h <= top]
    return sum(h in known for h in told) / len(told) if told else None


def name_similarity(a: str, b: str) -> float:
    def grams(s: str) -> set[str]:
        s = re.sub(r"[^a-z0-9]", "", s.lower())
        return {s[i : i + 2] for i in range(len(s) - 1)} or {s}

    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def score(known: Sketch, found: Sketch, field: str, name: str, kinds: frozenset[str]) -> float:
    """How well an unlisted column continues a known one, 0 to 1."""
    total = max(1, sum(v for k, v in found.kinds.items() if k != "null"))
    fit = 1.0 if "any" in kinds else sum(v for k, v in found.kinds.items() if k in kinds) / total
    if fit < 0.5:
        return 0.0
    if {"object", "array"} & set(found.kinds):
        shared = _contained(found.keys, known.keys)
        content = 0.3 if shared is None else shared
    else:
        # one score at every size: a column of few values is known by them, one of ids or texts by their look
        covered, shared = _covered(found.shapes, known.shapes), _contained(found.low, known.low)
        distinct = known.distinct()
        repeats = max(0.0, 1 - (distinct - 1) / max(1, known.n))
        by_value = repeats * EVEN_VALUES / (EVEN_VALUES + distinct)
        content = covered if shared is None else by_value * shared + (1 - by_value) * covered
    return fit * (0.75 * content + 0.25 * name_similarity(field, name))


def best_matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight matching of rows to columns (shortest augmenting paths with potentials)."""
    n, m = weights.shape
    if not n or not m:
        return []
    turned = n > m
    cost = -(weights.T if turned else weights)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, via, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            seen[j0] = True
            free = np.flatnonzero(~seen[1:]) + 1
            slack = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = slack < least[free]
            least[free[better]], via[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            for j in np.flatnonzero(seen):
                u[owner[j]] += delta
                v[j] -= delta
            least[~seen] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[via[j0]]
            j0 = via[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) if turned else (a, b) for a, b in pairs]


def differences(record: dict, places: dict) -> Iterator[tuple]:
    """Outermost differences of a record: ``("retyped", field)``, ``("gap", parent, missing, extra_names)``
    and, for every catalogued value, ``("value", parent, name, value)``."""
    todo: list[tuple[dict, str]] = [(record, "")]
    while todo:
        obj, place = todo.pop()
        known = places.get(place, {})
        missing = tuple(k for k, (_, required) in known.items() if required and k not in obj)
        extra = tuple(sorted(k for k in obj if k not in known))
        if missing or extra:
            yield "gap", place, missing, extra, obj
        for name, (kinds, required) in known.items():
            value = obj.get(name)
            if value is None:
                continue
            kind = json_type(value)
            here = f"{place}.{name}" if place else name
            if "any" not in kinds and kind not in kinds:
                yield "retyped", here
                continue
            if required:
                yield "value", place, name, value
            if kind == "object" and here in places:
                todo.append((value, here))
            elif kind == "array":
                inner = f"{here}[]"
                # an array of arrays is followed as deep as the catalogue names it
                while inner in places or any(p.startswith(inner) for p in places):
                    if inner in places:
                        todo.extend((x, inner) for x in value if isinstance(x, dict))
                        break
                    value = [y for x in value if isinstance(x, list) for y in x]
                    inner += "[]"


_PROFILE = "kind string, source string, path string, rtype string, place string, missing array<string>, extra array<string>, name string, sketch string"
_NAMES = ["kind", "source", "path", "rtype", "place", "missing", "extra", "name", "sketch"]
_TYPES = [pa.string()] * 5 + [pa.list_(pa.string())] * 2 + [pa.string()] * 2


def profile(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Profiles of the scan's batches, not merged yet. ``kind`` is ``known`` (sketch of a required
    field, for a whole source), ``gap`` (an object with missing or unlisted fields; the sketch is of one
    unlisted field), ``retyped`` or ``new_type``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, _, _ = by_source(b)
            sketches: dict[tuple, Sketch | None] = {}
            source, path, raw = (b.column(c).to_pylist() for c in ("source", "path", "raw"))
            for i in np.flatnonzero(status == RECORD).tolist():
                record, s, p = read(raw[i]), source[i], path[i]
                rtype = rtype_of(s, record)
                if rtype is None:
                    continue
                places = catalog.objects.get((s, rtype))
                if places is None:
                    sketches.setdefault(("new_type", s, p, rtype, "", None, None, "type"))
                    continue
                for what, *d in differences(record, places):
                    if what == "retyped":
                        sketches.setdefault(("retyped", s, p, rtype, "", None, None, d[0]))
                    elif what == "value":
                        place, name, value = d
                        key = ("known", s, None, rtype, place, None, None, name)
                        if (k := sketches.get(key)) is None:
                            k = sketches[key] = Sketch()
                        k.add(value)
                    else:
                        place, missing, extra, obj = d
                        for name in extra or (None,):
                            key = ("gap", s, p, rtype, place, missing, extra, name)
                            if (k := sketches.get(key)) is None:
                                k = sketches[key] = Sketch()
                            if name is not None:
                                k.add(obj[name])
            rows = [[*key, None if k is None else k.dump()] for key, k in sketches.items()]
            plain = [[[whole_text(y) for y in x] if isinstance(x, tuple) else whole_text(x) for x in r] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in plain], t) for c, t in enumerate(_TYPES)], _NAMES)

    return spread(records.select("source", "path", "raw")).mapInArrow(run, _PROFILE)


def _merged(sketches) -> str | None:
    out = None
    for x in sketches:
        if x is not None:
            out = Sketch.load(x) if out is None else out.merge(Sketch.load(x))
    return None if out is None else out.dump()


def _merge_rows(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merges neighbouring rows of equal keys; the input is sorted by them, the state is one sketch."""
        key, sketch, out = None, None, []
        schema = None
        for b in batches:
            schema = b.schema
            for row in b.to_pylist():
                k = tuple(tuple(x) if isinstance(x := row[c], list) else x for c in keys)
                if k != key:
                    if key is not None:
                        out.append((*key, None if sketch is None else sketch.dump()))
                    key, sketch = k, None
                if row["sketch"] is not None:
                    got = Sketch.load(row["sketch"])
                    sketch = got if sketch is None else sketch.merge(got)
            if len(out) > 5000:
                yield _batch(out, keys, schema)
                out = []
        if key is not None:
            out.append((*key, None if sketch is None else sketch.dump()))
        if schema is not None:
            yield _batch(out, keys, schema)

    return run


def _batch(rows: list[tuple], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(c).type) for i, c in enumerate([*keys, "sketch"])], [*keys, "sketch"])


#: Second-level groups of a key's sketches.
SALTS = 256


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One row and sketch for each key, in three levels: within a scan partition, then of one salt, then all. A
    key that every record has gets one sketch from each scan partition into ``SALTS`` tasks, and so many into one."""
    keys = [c for c in _NAMES if c != "sketch"]
    shuffle = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = lambda rows: rows.sortWithinPartitions(*keys).mapInArrow(_merge_rows(keys), _PROFILE)
    salted = level(profiles).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return level(level(salted.repartition(shuffle, *keys, "salt").drop("salt")).repartition(shuffle, *keys))


def changes(records: DataFrame, field_catalog: DataFrame) -> DataFrame:
    """``source, path, rtype, field, change, new_name`` (new_name for renames only)."""
    catalog = Catalog.of(field_catalog)
    merged = written(merge_profiles(profile(records, catalog)))
    # sketches of the catalogue's required fields: bounded by the schema, some kB each
    known = {(r.source, r.rtype, r.place, r.name): Sketch.load(r.sketch) for r in merged.where("kind = 'known'").select("source", "rtype", "place", "name", "sketch").collect()}
    keys = ["source", "path", "rtype", "place", "missing", "extra"]
    gaps = merged.where("kind = 'gap'").groupBy(*keys).agg(F.collect_list(F.struct("name", "sketch")).alias("cols"))
    names = ["source", "path", "rtype", "field", "change", "new_name"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g in b.to_pylist():
                place = g["place"]
                fields = catalog.objects[(g["source"], g["rtype"])][place]
                extra = [(c["name"], Sketch.load(c["sketch"])) for c in g["cols"] if c["name"] is not None]
                missing = g["missing"]
                weights = np.zeros((len(missing), len(extra)))
                for i, field in enumerate(missing):
                    for j, (name, found) in enumerate(extra):
                        have = known.get((g["source"], g["rtype"], place, field)) or Sketch()
                        weights[i, j] = score(have, found, field, name, fields[field][0])
                renamed = {i: j for i, j in best_matching(weights) if weights[i, j] >= MATCH_LEAST}
                at = lambda name: f"{place}.{name}" if place else name
                for i, field in enumerate(missing):
                    j = renamed.get(i)
                    out.append((g["source"], g["path"], g["rtype"], at(field), "removed" if j is None else "renamed", None if j is None else at(extra[j][0])))
                taken = set(renamed.values())
                out.extend((g["source"], g["path"], g["rtype"], at(name), "added", None) for j, (name, _) in enumerate(extra) if j not in taken)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.string()) for c in range(6)], names)

    gap_rows = gaps.mapInArrow(decide, ", ".join(f"{c} string" for c in names))
    plain = merged.where("kind in ('retyped', 'new_type')").select(
        "source", "path", "rtype", F.col("name").alias("field"), F.when(F.col("kind") == "retyped", "retyped").otherwise("added").alias("change"), F.lit(None).cast("string").alias("new_name")
    )
    return gap_rows.unionByName(plain).distinct()


def find_changes(records: DataFrame, field_catalog: DataFrame) -> DataFrame:
    """``path, rtype, field, change``: the differences between each path's records and the catalogue."""
    return changes(records, field_catalog).select("path", "rtype", "field", "change").distinct()


def unified_records(records: DataFrame, field_catalog: DataFrame, change_rows: DataFrame) -> DataFrame:
    """``source, path, line_no, rtype, doc``: every typed record as JSON text under the catalogue's names.

    Renamed fields get their listed name back, values of an unlisted type are cast where the
    text allows it (digits to int, scalars to string) and else moved into ``_other`` beside
    unlisted fields, so that nothing is lost and each listed field has one type.
    ``change_rows`` comes from :func:`changes`. A rename holds for its path only; if there one new name
    stands for several fields, it is taken for the first by name that a record lacks. The renames are
    joined on the path, one row each: Spark broadcasts them as long as their size allows it.
    """
    catalog = Catalog.of(field_catalog)
    renames = change_rows.where("change = 'renamed'").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("source", "rtype", "new_name", "field"))).alias("renames"))

    def fit(obj: dict, place: str, places: dict, back: dict[str, list[str]]) -> dict:
        known, out, other = places.get(place, {}), {}, {}
        for k, v in obj.items():
            here = f"{place}.{k}" if place else k
            if k not in known and (old := next((x for x in back.get(here, ()) if x not in obj), None)) is not None:
                k, here = old, f"{place}.{old}" if place else old
            if k not in known:
                other[k] = v
                continue
            kinds, kind = known[k][0], json_type(v)
            if kind == "null" or "any" in kinds or kind in kinds:
                if kind == "object" and here in places:
                    v = fit(v, here, places, back)
                elif kind == "array" and f"{here}[]" in places:
                    v = [fit(x, f"{here}[]", places, back) if isinstance(x, dict) else x for x in v]
                out[k] = v
            elif "int" in kinds and kind == "string" and re.fullmatch(r"-?[0-9]{1,18}", v):
                out[k] = int(v)
            elif "string" in kinds and kind in ("int", "float", "bool"):
                out[k] = json.dumps(v)
            else:
                out[k], other[k] = None, v
        if other:
            out["_other"] = other
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, _, _ = by_source(b)
            cols = [b.column(c).to_pylist() for c in ("source", "path", "line_no", "raw", "renames")]
            out = []
            for i in np.flatnonzero(status == RECORD).tolist():
                s, p, n, raw, renamed = (c[i] for c in cols)
                record = read(raw)
                rtype = rtype_of(s, record)
                if rtype is not None:
                    back: dict[str, list[str]] = {}
                    for x in renamed or ():
                        if x["source"] == s and x["rtype"] == rtype:
                            back.setdefault(x["new_name"], []).append(x["field"].rpartition(".")[2])
                    out.append((s, p, n, rtype, write(fit(record, "", catalog.objects.get((s, rtype), {"": {}}), back))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate([pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()])], ["source", "path", "line_no", "rtype", "doc"])

    lines = spread(records.select("source", "path", "line_no", "raw")).join(renames, "path", "left")
    return lines.select("source", "path", "line_no", "raw", "renames").mapInArrow(run, "source string, path string, line_no bigint, rtype string, doc string")
