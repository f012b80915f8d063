"""JSON text of any depth: the interpreter's own reader and writer, with an explicit stack beyond its limit."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from json.decoder import scanstring
from typing import Any

BLANKS = " \t\r\n"
_SPACE = re.compile(r"[ \t\r\n]*").match
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?").match
_WORDS = {"n": ("null", None), "t": ("true", True), "f": ("false", False)}


def long_int(digits: str) -> int | float:
    """An integer; one of more digits than the interpreter converts counts as infinite."""
    return int(digits) if len(digits) < 4000 else float("-inf" if digits[0] == "-" else "inf")


def read_deep(text: str, build: Callable[[list[tuple[str, Any]]], Any] = dict, parse_int: Callable[[str], Any] = long_int) -> Any:
    """The value of a JSON text by RFC 8259, read with a stack of its own. ``build`` makes an object of its
    pairs; of repeated keys the last one wins in a dict. Raises ``json.JSONDecodeError``."""
    fail = json.JSONDecodeError
    open_: list[list] = []
    keys: list[str | None] = []  # None for an array

    def key_at(i: int) -> int:
        if text[i : i + 1] != '"':
            raise fail("Expecting property name enclosed in double quotes", text, i)
        key, i = scanstring(text, i + 1, True)
        i = _SPACE(text, i).end()
        if text[i : i + 1] != ":":
            raise fail("Expecting ':' delimiter", text, i)
        keys[-1] = key
        return _SPACE(text, i + 1).end()

    i = _SPACE(text, 0).end()
    while True:
        c = text[i : i + 1]
        if c == "{" or c == "[":
            i = _SPACE(text, i + 1).end()
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                open_.append([])
                keys.append(None)
                if c == "{":
                    i = key_at(i)
                continue
            value, i = build([]) if c == "{" else [], i + 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif c in _WORDS and text.startswith(_WORDS[c][0], i):
            value, i = _WORDS[c][1], i + len(_WORDS[c][0])
        elif found := _NUMBER(text, i):
            value, i = float(found[0]) if found[1] or found[2] else parse_int(found[0]), found.end()
        else:
            raise fail("Expecting value", text, i)
        # the value is whole: it goes into what is open, which may be whole by that, too
        while True:
            i = _SPACE(text, i).end()
            if not open_:
                if i != len(text):
                    raise fail("Extra data", text, i)
                return value
            c, key = text[i : i + 1], keys[-1]
            open_[-1].append(value if key is None else (key, value))
            if c == ",":
                i = _SPACE(text, i + 1).end()
                if key is not None:
                    i = key_at(i)
                break
            if c != ("]" if key is None else "}"):
                raise fail("Expecting ',' delimiter", text, i)
            inner = open_.pop()
            value, i = inner if keys.pop() is None else build(inner), i + 1


_TOLERANT = json.JSONDecoder(parse_int=long_int)


def read(text: str) -> Any:
    """The value of a text already found good."""
    try:
        return json.loads(text)
    except RecursionError:
        return read_deep(text.strip(BLANKS))
    except ValueError:
        return _TOLERANT.decode(text.strip(BLANKS))


class _Done(str):
    """Text that is written as it stands."""


def _number(x: float) -> str:
    """A double in the fewest digits, without an exponent from 1e-6 up to 1e21."""
    if not math.isfinite(x):
        return "null"
    shortest = repr(x)
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        if "e" not in shortest:
            return shortest.removesuffix(".0")
        digits, _, power = shortest.partition("e")
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        whole, _, part = digits.partition(".")
        places, all_digits = int(power) + len(whole), whole + part
        if places <= 0:
            return f"{sign}0.{'0' * -places}{all_digits}"
        return sign + all_digits[:places].ljust(places, "0") + ("." + all_digits[places:] if len(all_digits) > places else "")
    digits, _, power = shortest.partition("e")
    return f"{digits.removesuffix('.0')}e{'-' if power[0] == '-' else '+'}{abs(int(power))}"


def write(value: Any, compact: bool = False) -> str:
    """JSON text of a value of any depth. ``compact`` sorts keys, leaves out blanks, writes doubles in the fewest
    digits and other characters than ASCII as they are; else the look is that of ``json.dumps``."""
    if not compact:
        try:
            return json.dumps(value)
        except RecursionError:
            pass
    comma, colon = (",", ":") if compact else (", ", ": ")
    out: list[str] = []
    todo: list[Any] = [value]
    while todo:
        x = todo.pop()
        if type(x) is _Done:
            out.append(x)
        elif isinstance(x, dict) and x:
            items: list[Any] = [_Done("{")]
            for n, k in enumerate(sorted(x) if compact else x):
                items += [_Done((comma if n else "") + json.dumps(k, ensure_ascii=not compact) + colon), x[k]]
            todo.extend(reversed([*items, _Done("}")]))
        elif isinstance(x, list) and x:
            items = [_Done("[")]
            for n, y in enumerate(x):
                items += [_Done(comma), y] if n else [y]
            todo.extend(reversed([*items, _Done("]")]))
        else:
            out.append(_number(x) if compact and isinstance(x, float) else json.dumps(x, ensure_ascii=not compact))
    return "".join(out)
