"""Mixed timestamp formats and zones: one instant in Unix milliseconds for each record.

A time text is turned into its shape mask (digits become 9, letters A). Each distinct
mask is mapped to a parser once; all texts of a mask are then cut at fixed places and
converted together. Wall-clock times go through zone transition tables, built once on
the driver from a named version of the IANA data and sent to all tasks.

Defined results: missing, null, blank or unreadable times, times of no existing date
and instants at or before the epoch give no instant (null ``utc_ms``); a wall-clock time
on a machine without a known zone gives none either; fractions are rounded down. Wall
times before 1850 count with the zone's first offset, those from 2500 on by the rules of 400 years
before. Bare digits of fewer than 9 or more than 19 places are no time.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.parse_rows import RECORD, by_source
from skein.session import spread

#: Years of the tables. Behind them the rules of a zone repeat as the calendar does, every 400 years; to that end the
#: tables span 400 years without a change of rules.
FIRST_YEAR, RULES_YEAR, LAST_YEAR = 1850, 2100, 2500
_ERA = 146_097 * 86_400

# Offsets in minutes of abbreviations that the machine's own zone doesn't use.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BRT": -180,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _second(year: int) -> int:
    return int((datetime(year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())


_LAST_SECOND = _second(LAST_YEAR)


@dataclass(frozen=True)
class Zone:
    """Wall seconds from which each offset holds, the offsets, and the zone's abbreviations."""

    switch: np.ndarray
    offset: np.ndarray
    names: dict[str, int]

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        beyond = np.maximum(0, (wall - _LAST_SECOND) // _ERA + 1)
        return wall - self.offset[np.searchsorted(self.switch, wall - beyond * _ERA, side="right")]


def tzdata_version() -> str:
    """The version of the IANA data in use, or ``unknown``."""
    for place in TZPATH:
        listing = Path(place, "tzdata.zi")
        if listing.exists():
            return listing.open().readline().removeprefix("# version").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1)
def zone_files() -> dict[str, bytes]:
    """The compiled rules of all zones on this machine, by name: some 600 of a few kB, whatever the data. They are read
    on the driver and sent to all tasks, which thus use one version."""
    out: dict[str, bytes] = {}
    for name in sorted(available_timezones()):
        for place in TZPATH:
            if (file := Path(place, name)).is_file():
                out[name] = file.read_bytes()
                break
        else:
            package, _, leaf = f"tzdata.zoneinfo/{name}".rpartition("/")
            out[name] = resources.files(package.replace("/", ".")).joinpath(leaf).read_bytes()
    return out


def zone(name: str) -> Zone | None:
    """Transition table of a zone of this machine, or None for a name that is none."""
    rules = zone_files().get(name)
    return None if rules is None else table_of(rules)


@lru_cache(maxsize=1024)
def table_of(rules: bytes) -> Zone:
    """Transition table by compiled rules. At a change from offset a to b at instant t the new offset
    holds from wall time t + max(a, b) on: a skipped wall time then counts with the offset
    before the change, and of a repeated one the earlier instant is taken."""
    tz = ZoneInfo.from_file(io.BytesIO(rules))

    def at(second: int) -> tuple[int, str]:
        local = (_EPOCH + timedelta(seconds=second)).astimezone(tz)
        return int(local.utcoffset().total_seconds()), local.tzname()

    start, week = _second(FIRST_YEAR), 7 * 86400
    switch, offsets, names = [], [at(start)[0]], {}
    before, now = start, offsets[0]
    # rules of this century may change offsets for some days; later on they do so for months
    for t in [*range(start + week, _second(RULES_YEAR), week), *range(_second(RULES_YEAR), _LAST_SECOND + 4 * week, 4 * week)]:
        o, abbr = at(t)
        if abbr.isalpha():
            names[abbr] = o
        if o != now:
            lo, hi = before, t
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if at(mid)[0] == now:
                    lo = mid
                else:
                    hi = mid
            switch.append(hi + max(now, o))
            offsets.append(o)
            now = o
        before = t
    return Zone(np.array(switch, dtype=np.int64), np.array(offsets, dtype=np.int64), names)


_CLASSES = {**{c: "9" for c in "0123456789"}, **{chr(c): "A" for c in [*range(65, 91), *range(97, 123)]}}
_TO_MASK = str.maketrans(_CLASSES)
_CLOCK = r"(?P<H>9{1,2}):(?P<M>99):(?P<S>99)(?:[.,](?P<f>9+))?"
_ZONE = r"(?P<z> ?(?:A{1,5}|[+-]99(?::?99)?))?"
_SHAPES = [
    re.compile(p + "$")
    for p in (
        rf"(?P<Y>9999)[-/](?P<m>99)[-/](?P<d>99)(?P<t>[A ]){_CLOCK}{_ZONE}",
        rf"(?P<d>99)\.(?P<m>99)\.(?P<Y>9999)(?P<t> ){_CLOCK}{_ZONE}",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<t>A)(?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9+))?{_ZONE}",
        rf"(?:AAA, )?(?P<d>9{{1,2}}) (?P<b>AAA) (?P<Y>9999) {_CLOCK}{_ZONE}",
        rf"(?P<b>AAA) (?P<d>9{{1,2}}), (?P<Y>9999),? {_CLOCK} (?P<p>AA)(?P<z> (?:A{{3,5}}|[+-]99(?::?99)?))?",
        rf"(?P<b>AAA) (?P<d>9{{1,2}}), (?P<Y>9999),? {_CLOCK}{_ZONE}",
    )
]
#: Factor to milliseconds by the number of digits (negative: to divide by): the unit under which an instant lies
#: nearest to now, so 9 to 11 digits are seconds, 12 to 14 milliseconds, 15 to 17 micro- and 18 or 19 nanoseconds.
_EPOCH_DIGITS = {n: unit for unit, sizes in ((1000, (9, 10, 11)), (1, (12, 13, 14)), (-1000, (15, 16, 17)), (-1_000_000, (18, 19))) for n in sizes}
#: Masks are remembered up to this many; beyond it the oldest are found anew, with the same result.
MASKS_KEPT = 4096


@lru_cache(maxsize=MASKS_KEPT)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Where the parts of all texts of this mask stand, or None for a mask that is no time."""
    if mask.strip("9") == "" and len(mask) in _EPOCH_DIGITS:
        return {"epoch": (0, len(mask))}
    for shape in _SHAPES:
        if found := shape.match(mask):
            return {k: found.span(k) for k, v in found.groupdict().items() if v is not None}
    return None


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (codes[:, k].astype(np.int64) - 48)
    return out


def _convert(texts: np.ndarray, parts: dict[str, tuple[int, int]], zones: np.ndarray, named: dict[str, Zone]) -> tuple[np.ndarray, np.ndarray]:
    """(milliseconds, ok) of texts that share a mask."""
    n = len(texts)
    wide = np.array(texts, dtype="U")
    codes = wide.view(np.uint32).reshape(n, -1)
    if "epoch" in parts:
        value, unit = _number(codes, parts["epoch"]), _EPOCH_DIGITS[parts["epoch"][1]]
        ms = value * unit if unit > 0 else value // -unit
        return ms, np.ones(n, dtype=bool)
    year, day, hour, minute, second = (_number(codes, parts[k]) for k in "YdHMS")
    if "b" in parts:
        a, b = parts["b"]
        names = [t[a:b].lower() for t in texts]
        known = {m: i + 1 for i, m in enumerate(MONTHS)}
        month = np.array([known.get(m, 0) for m in names], dtype=np.int64)
    else:
        month = _number(codes, parts["m"])
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (minute < 60) & (second < 60) & (year >= 1)
    if "t" in parts:
        ok &= np.isin(codes[:, parts["t"][0]], [ord("T"), ord("t"), ord(" ")])
    if "p" in parts:
        a, b = parts["p"]
        half = np.array([t[a:b].lower() for t in texts], dtype=object)
        ok &= np.isin(half, ["am", "pm"]) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * (half == "pm")
    ok &= hour < 24
    first = ((year - 1970).astype("datetime64[Y]").astype("datetime64[M]").astype(np.int64) + np.where(ok, month - 1, 0)).astype("datetime64[M]")
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    ok &= day <= length
    wall = (first.astype("datetime64[D]").astype(np.int64) + day - 1) * 86400 + hour * 3600 + minute * 60 + second
    ms = np.zeros(n, dtype=np.int64)
    if "f" in parts:
        a, b = parts["f"]
        ms = _number(codes, (a, min(b, a + 3))) * 10 ** max(0, 3 - (b - a))
    utc = np.array(wall)
    done = np.zeros(n, dtype=bool)
    if "z" in parts:
        a, b = parts["z"]
        marks = np.array([t[a:b].strip() for t in texts], dtype=object)
        for mark in set(marks.tolist()):
            at = np.flatnonzero(marks == mark)
            if mark[0] in "+-":
                digits = mark[1:].replace(":", "")
                h, m = int(digits[:2]), int(digits[2:] or 0)
                if h > 23 or m > 59:
                    ok[at] = False
                utc[at] = wall[at] - (1 if mark[0] == "+" else -1) * (h * 3600 + m * 60)
            else:
                for name in set(zones[at].tolist()):
                    own = at[zones[at] == name] if name is not None else at[[z is None for z in zones[at]]]
                    here = named.get(name)
                    sec = 0 if mark in ("Z", "z") else here.names.get(mark) if here is not None and mark in here.names else ABBREVIATIONS[mark] * 60 if mark in ABBREVIATIONS else None
                    if sec is None:
                        ok[own] = False
                    else:
                        utc[own] = wall[own] - sec
        done[:] = True
    if not done.all():
        for name in set(zones.tolist()):
            own = np.flatnonzero(np.array([z == name for z in zones], dtype=bool))
            here = named.get(name)
            if here is None:
                ok[own] = False
            else:
                utc[own] = here.to_utc(wall[own])
    return utc * 1000 + ms, ok


_BRACKET = re.compile(r"\[([A-Za-z0-9_+/-]+)\]$")


def to_utc_ms(texts: list[str | None], zones: list[str | None], named: dict[str, Zone], rules: dict[str, bytes] | None = None) -> tuple[list[int | None], list[str | None]]:
    """Instant and shape mask of each text; ``zones`` are the names of the wall clocks. ``rules`` are those of zones
    that texts may name; tables made of them are added to ``named``."""
    n = len(texts)
    out: list[int | None] = [None] * n
    masks: list[str | None] = [None] * n
    groups: dict[str, list[int]] = {}
    cut = list(texts)
    zone_of = np.array(zones, dtype=object)
    for i, t in enumerate(texts):
        if t is None:
            continue
        t = t.strip()
        if t.endswith("]") and (found := _BRACKET.search(t)):
            t = t[: found.start()]
            masks[i] = t.translate(_TO_MASK) + "[zone]"
            if found[1] not in named and (rules or {}).get(found[1]) is not None:
                named[found[1]] = table_of(rules[found[1]])
            zone_of[i] = found[1]
            mask = masks[i][:-6]
        else:
            mask = masks[i] = t.translate(_TO_MASK)
        cut[i] = t
        groups.setdefault(mask, []).append(i)
    for mask, at in groups.items():
        parts = parser_of(mask)
        if parts is None:
            continue
        ms, ok = _convert(np.array([cut[i] for i in at], dtype=object), parts, zone_of[at], named)
        for i, v, good in zip(at, ms.tolist(), ok.tolist()):
            if good and v > 0:
                out[i] = v
    return out, masks


def record_times(records: DataFrame, machines: DataFrame) -> DataFrame:
    """``path, line_no, source, time_text, shape, utc_ms, canonical, tz_version`` for every record.

    ``canonical`` tells that the time is already written as the source prescribes. Lines
    that are no records are left out; a repeated line gives a repeated row. No shuffle:
    ``machines`` is a lookup of zone names, bounded by the number of machines.
    """
    # one row for each machine that writes sessions; the IANA list has some 600 zones
    zone_by_machine = {r.machine: r.tz_name for r in machines.select("machine", "tz_name").collect() if r.machine is not None}
    tables = {name: zone(name) for name in set(zone_by_machine.values()) if name is not None}
    version = tzdata_version()
    sent = records.sparkSession.sparkContext.broadcast(zone_files())
    fixed = "9999-99-99A99:99:99.999A"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, _, fields = by_source(b, ("timestamp", "time"))
            keep = np.flatnonzero(status == RECORD)
            b = b.take(pa.array(keep))
            source, paths = b.column("source").to_pylist(), b.column("path").to_pylist()
            own = [(fields["time"] if s == "dsh" else fields["timestamp"])[i] for s, i in zip(source, keep.tolist())]
            texts = [None if v is None else str(v) for v in own]
            zones = [zone_by_machine.get(p.split("/", 1)[0]) if p is not None else None for p in paths]
            utc, masks = to_utc_ms(texts, zones, tables, sent.value)
            canonical = [
                (t is not None and len(t) in (12, 13, 14) and t.isdigit()) if s == "dsh" else (m == fixed and t == t.strip() and t[10] == "T" and t[-1] == "Z") for s, t, m in zip(source, texts, masks)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("path"), b.column("line_no"), b.column("source"), pa.array(texts, pa.string()), pa.array(masks, pa.string()),
                    pa.array(utc, pa.int64()), pa.array(canonical, pa.bool_()), pa.array([version] * len(texts), pa.string()),
                ],
                ["path", "line_no", "source", "time_text", "shape", "utc_ms", "canonical", "tz_version"],
            )

    return spread(records.select("path", "line_no", "source", "raw")).mapInArrow(
        run, "path string, line_no bigint, source string, time_text string, shape string, utc_ms bigint, canonical boolean, tz_version string"
    )


def find_odd_times(records: DataFrame, machines: DataFrame) -> DataFrame:
    """``path, line_no, utc_ms`` of records whose time is an instant written in another way."""
    return record_times(records, machines).where(F.col("utc_ms").isNotNull() & ~F.col("canonical")).select("path", "line_no", "utc_ms").distinct()
