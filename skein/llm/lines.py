"""The lines of many texts at once: features by array operations, then a form for each line.

All texts of a portion are laid end to end as one array of code points. What a line or a word
is made of (letters, cells, code signs, common words, the end of a sentence) comes from sums over that array;
regular expressions only see lines that those leave open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

# The endings of sentences, and what may stand behind one.
ENDS = ".!?…。！？｡"
CLOSERS = "\"'”’»)]"
# Characters of which rules between rows and sections are drawn.
RULES = "|+:=-_~*#.─━┄┈═│┃┼├┤┬┴╔╗╚╝╠╣╦╩╬"
_STOP = re.compile(r"[.!?…][\"'”’»)]*\s+|[。！？｡][\"'”」』]*\s*")
MARK = re.compile(r"\s*(?:[-*+•‣◦▪·–—]\s+|\[[ xX✓]?\]\s+|☐\s*|☑\s*|✓\s*|✔\s*|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][.)]\s+|\(?[ivxIVX]{1,5}[.)]\s+|[①-⑳]\s*|#\d+\s+|→\s*|>>\s+)")
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_IN_CODE = re.compile(r"\w[/_\\]\w|\w\.[a-z]{1,5}\b|\S::\S|\w\(")
#: Any match of ``_IN_CODE`` holds one of these.
_CODE_SIGNS = frozenset("/_\\.:(")
_LOG = re.compile(
    r"\s*(?:\[?\d{1,3}/\d{1,4}\]|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE|NOTICE)\b|---\s|===\s|\+\+\+\s|[-dl][rwx-]{9}\s|\$ |> ?\$|>>> |Traceback|at \S+\(|ok\s{2,}|FAIL\b|PASS\b|\S+:\d+(?::\d+)?:|\d+ passed\b|[0-9a-fA-F]{6,}\s)"
)
_CODE_START = re.compile(
    r"\s*(?:def |class |import |from \S+ import|return\b|assert |for .+:$|for \(|while .+:$|if .+:$|elif |else:|try:|except|with .+:$|func |fn |let |const |var |public |private |static |#include|package |use \S+;|struct |SELECT |INSERT |UPDATE |@\w+)"
)
_CODE_CLOSE = re.compile(r"\s*[}\])]+[,;]?\s*$")
_CODE_CALL = re.compile(r"\w+\(.*\)\s*[;{]?$")
_CODE_SET = re.compile(r"\s*[\w.\[\]\"']+\s*(?:=|\+=|:=)\s*\S")
_CODE_KEY = re.compile(r"\s*[\"']?\w+[\"']?\s*:\s*[\"\[{0-9]")
#: A character that shows: no separator, control or format character, and none of the blank letters.
_VISIBLE = regex.compile(r"[^\p{Z}\p{C}\u115f\u1160\u2800\u3164\uffa0]")

# flags of a character; LETTER is what words are made of, WORD also counts digits and the underscore
VISIBLE, ALNUM, SPACE, DIGIT, UPPER, ALPHA, LETTER, WORD, IDEOGRAM, CLOSER, RULE, ABC = (1 << k for k in range(12))

#: Characters that are looked at together, which bounds the working memory; a longer text makes a portion alone.
PORTION = 400_000


def _flags(c: str) -> int:
    return (
        VISIBLE * bool(_VISIBLE.match(c)) | ALNUM * c.isalnum() | SPACE * c.isspace() | DIGIT * c.isdigit() | UPPER * c.isupper() | ALPHA * c.isalpha()
        | LETTER * (c.isalnum() and not c.isdecimal()) | WORD * (c.isalnum() or c == "_") | IDEOGRAM * bool(CJK.match(c)) | CLOSER * (c in CLOSERS) | RULE * (c.isspace() or c in RULES) | ABC * ("a" <= c <= "z")
    )


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Flags and lower case of the basic plane's characters, made once for each worker."""
    low = [chr(i).lower() for i in range(0x10000)]
    return np.array([_flags(chr(i)) for i in range(0x10000)], dtype=np.uint16), np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], dtype=np.uint32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def flags(codes: np.ndarray) -> np.ndarray:
    """The flags of every character."""
    out = _tables()[0][np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        out[i] = _flags(chr(codes[i]))
    return out


_P = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _P, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(10, int(n).bit_length()))


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each of the non-empty, ascending, disjoint runs of values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        terms = (values[at + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at]
        return np.add.reduceat(terms, np.cumsum(size) - size)


def mixed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are told apart by their owner, too."""
    with np.errstate(over="ignore"):
        return hashes * np.uint64(0xBF58476D1CE4E5B9) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def first_places(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of one of each distinct hash of every owner."""
    return np.unique(mixed(hashes, owner), return_index=True)[1]


def distinct_counts(hashes: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    bits = np.uint64(max(1, n_owners).bit_length())
    own = np.sort(owner.astype(np.uint64) << (np.uint64(64) - bits) | (hashes * np.uint64(0xBF58476D1CE4E5B9)) >> bits)
    first = np.ones(len(own), dtype=bool)
    first[1:] = own[1:] != own[:-1]
    return np.bincount((own[first] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n_owners)


class Words:
    """The common words, split into space-separated ones and pieces of unspaced scripts."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.spaced = frozenset(w.lower() for _, w in rows if w and not CJK.search(w))
        pieces = sorted({w for _, w in rows if w and CJK.search(w)}, key=lambda w: (-len(w), w))
        self.pieces = re.compile("|".join(map(re.escape, pieces))) if pieces else re.compile("(?!)")
        #: language votes of each word
        self.langs: dict[str, list[str]] = {}
        for lang, w in rows:
            if w:
                self.langs.setdefault(w.lower(), []).append(lang)
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(hash_runs(c, np.array([0]), np.array([len(c)])) for w in self.spaced for c in [codes_of(w)])]))

    @classmethod
    def of(cls, common_words: DataFrame) -> "Words":
        """Reads the word list to the driver: it is a fixed list, not data that grows."""
        return cls([(r.lang, r.word) for r in common_words.select("lang", "word").collect()])


def split_sentences(line: str) -> list[str]:
    """The line cut behind its stops; closing signs and white space behind a stop are left out."""
    out, at = [], 0
    for m in _STOP.finditer(line):
        out.append(line[at : m.start() + 1])
        at = m.end()
    out.append(line[at:])
    return out


def without_code(line: str) -> str:
    """The line's words that don't look like paths, names or calls in code."""
    return " ".join([w for w in line.split() if _CODE_SIGNS.isdisjoint(w) or not _IN_CODE.search(w)])


def looks_code(x: str) -> bool:
    """A line of a program: a statement's first word, an open or closed bracket at its end, an assignment, a call."""
    end = x.rstrip()
    last = end[-1:]
    return bool(
        last in ";{}" and last
        or _CODE_START.match(x)
        or last in ")],;" and _CODE_CLOSE.match(x)
        or last in ");{" and "(" in x and _CODE_CALL.search(x)
        or "=" in x and ("=>" in x or _CODE_SET.match(x))
        or "->" in x
        or ":" in x and _CODE_KEY.match(x)
    )


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts that are looked at together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > PORTION:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Lines:
    """The lines of some texts. Arrays have one value a line, in the order of texts and lines; null texts are empty."""

    def __init__(self, texts: list[str | None], words: Words):
        self.words = words
        self.n_docs = len(texts)
        size = np.array([len(t or "") for t in texts], dtype=np.int64)
        self.text = "\n".join(t or "" for t in texts)
        self.codes = codes_of(self.text)
        self.flags = flags(self.codes)
        self.doc_end = np.cumsum(size + 1) - 1
        self.doc_start = self.doc_end - size
        c = self.codes
        breaks = np.flatnonzero((c == 10) | (c == 13) | ((c & 0xFFFFFFFE) == 0x2028))
        joins = np.zeros(len(c) + 2, dtype=bool)
        joins[self.doc_end[:-1]] = True
        # \r\n is one break, unless the \n is what joins two texts
        double = (c[breaks] == 13) & (np.append(c, 0)[breaks + 1] == 10) & ~joins[breaks + 1]
        first = np.ones(len(breaks), dtype=bool)
        first[1:] = ~(double[:-1] & (breaks[1:] == breaks[:-1] + 1))
        breaks, double = breaks[first], double[first]
        self.start = np.concatenate([[0], breaks + 1 + double])
        self.end = np.concatenate([breaks, [len(c)]])
        self.n = len(self.start)
        #: first line of each text, and one past the last
        self.first = np.searchsorted(self.start, self.doc_start)
        self.last = np.append(self.first[1:], self.n) if self.n_docs else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(self.n_docs), self.last - self.first)
        self._sums: dict[int, np.ndarray] = {}
        shown = np.flatnonzero(~self.has(SPACE))
        a, b = np.searchsorted(shown, self.start), np.searchsorted(shown, self.end)
        #: without white space at the ends; start equals end where nothing is left
        self.left, self.right = self.end.copy(), self.end.copy()
        some = b > a
        self.left[some], self.right[some] = shown[a[some]], shown[b[some] - 1] + 1

    def has(self, flag: int) -> np.ndarray:
        return (self.flags & flag) != 0

    def sums(self, flag: int) -> np.ndarray:
        """How many characters of a flag stand before each place."""
        if flag not in self._sums:
            self._sums[flag] = self._upto(self.has(flag))
        return self._sums[flag]

    @staticmethod
    def _upto(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, dtype=np.int32)
        np.cumsum(mask, out=out[1:], dtype=np.int32)
        return out

    def count(self, flag: int) -> np.ndarray:
        s = self.sums(flag)
        return s[self.end] - s[self.start]

    def in_docs(self, flag: int) -> np.ndarray:
        s = self.sums(flag)
        return s[self.doc_end] - s[self.doc_start]

    @cached_property
    def low(self) -> np.ndarray:
        """The characters in lower case."""
        return np.where(self.codes < 0x10000, _tables()[1][np.minimum(self.codes, 0xFFFF)], self.codes)

    @cached_property
    def lines(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]

    def _line_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, side="right") - 1

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        return edge[::2], edge[1::2]

    @cached_property
    def tokens(self) -> dict[str, np.ndarray]:
        """Runs without white space: ``start, end, line, code`` (looks like a path, a name or a call in code)."""
        start, end = self._runs(~self.has(SPACE))
        c = np.append(self.codes, [32, 32, 32])
        word = np.append(self.has(WORD), [False] * 3)
        near = lambda at, k: word[at + k] & (at + k >= 0)
        sign = np.flatnonzero((self.codes == 47) | (self.codes == 95) | (self.codes == 92))
        found = [sign[near(sign, -1) & near(sign, 1)]]
        dot = np.flatnonzero(self.codes == 46)
        dot = dot[near(dot, -1) & near(dot, 1)]
        outside = np.append(np.flatnonzero(~word[: len(self.codes)]), len(self.codes))
        stop = outside[np.searchsorted(outside, dot + 1)]
        abc = self.sums(ABC)
        found.append(dot[(stop - dot <= 6) & (abc[stop] - abc[dot + 1] == stop - dot - 1)])
        colon = np.flatnonzero((self.codes == 58) & (c[1 : len(self.codes) + 1] == 58))
        space = np.append(self.has(SPACE), [True] * 3)
        found.append(colon[(colon > 0) & ~space[colon - 1] & ~space[colon + 2]])
        call = np.flatnonzero(self.codes == 40)
        found.append(call[near(call, -1)])
        code = np.zeros(len(start), dtype=bool)
        code[np.searchsorted(start, np.concatenate(found), side="right") - 1] = True
        return {"start": start, "end": end, "line": self._line_of(start), "code": code}

    @cached_property
    def word_runs(self) -> dict[str, np.ndarray]:
        """Words (letters, with single apostrophes inside): ``start, end, line, code, common``."""
        letter = self.has(LETTER)
        tick = np.flatnonzero((self.codes == 0x27) | (self.codes == 0x2019))
        tick = tick[(tick > 0) & (tick + 1 < len(letter))]
        inside = letter.copy()
        inside[tick[letter[tick - 1] & letter[np.minimum(tick + 1, len(letter) - 1)]]] = True
        start, end = self._runs(inside)
        t = self.tokens
        hashes = hash_runs(self.low, start, end)
        known = self.words.hashes
        common = np.zeros(len(start), dtype=bool)
        if len(known):
            common = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        return {"start": start, "end": end, "line": self._line_of(start), "code": t["code"][np.searchsorted(t["start"], start, side="right") - 1] if len(start) else np.zeros(0, bool), "common": common}

    def _per_line(self, line: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(line, weights, minlength=self.n).astype(np.int64)

    @cached_property
    def ended(self) -> np.ndarray:
        """Lines that end like a sentence: a mark, then only closing signs."""
        solid = np.flatnonzero((self.flags & CLOSER) == 0)
        k = np.searchsorted(solid, self.right) - 1
        at = np.where(k >= 0, solid[np.maximum(k, 0)] if len(solid) else 0, -1)
        ok = (self.right > self.left) & (at >= self.left)
        ends = np.isin(self.codes[np.maximum(at, 0)], codes_of(ENDS)) if len(self.codes) else np.zeros(self.n, bool)
        return ok & ends

    @cached_property
    def plain(self) -> dict[str, np.ndarray]:
        """Per line, leaving out tokens of code: ``words, common, letters, shown, alpha, cjk``; ``codes`` counts those tokens."""
        t, w = self.tokens, self.word_runs
        keep = ~t["code"]
        own = t["line"][keep]
        of = lambda flag: self._per_line(own, (self.sums(flag)[t["end"]] - self.sums(flag)[t["start"]])[keep])
        use = ~w["code"]
        mine = w["line"][use]
        return {
            "words": self._per_line(mine), "common": self._per_line(mine, w["common"][use]), "letters": self._per_line(mine, (w["end"] - w["start"])[use]),
            "shown": self._per_line(own, (t["end"] - t["start"])[keep]), "alpha": of(ALPHA), "cjk": of(IDEOGRAM), "codes": self._per_line(t["line"][t["code"]]),
        }

    @cached_property
    def prose(self) -> np.ndarray:
        """Running text: enough words, some of them common, few symbols."""
        p = self.plain
        spaced = (p["words"] >= 4) & (p["common"] * 7 >= p["words"]) & (p["letters"] * 10 >= p["shown"] * 7) & (p["letters"] <= 14 * p["words"])
        wide = (p["cjk"] >= 6) & (p["cjk"] * 3 >= p["alpha"])
        out = spaced & ~wide
        for i in np.flatnonzero(wide).tolist():
            x = self.text[self.start[i] : self.end[i]]
            out[i] = len(self.words.pieces.findall(without_code(x) if p["codes"][i] else x)) * 14 >= p["cjk"][i]
        return out

    @cached_property
    def longest(self) -> np.ndarray:
        """Length of the longest token of each line."""
        t = self.tokens
        out = np.zeros(self.n, dtype=np.int64)
        if len(t["line"]):
            begins = np.flatnonzero(np.diff(t["line"], prepend=-1))
            out[t["line"][begins]] = np.maximum.reduceat(t["end"] - t["start"], begins)
        return out

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Divider (an index into ``DIVIDERS``) and number of cells of each line."""
        c = self.codes
        inside = lambda s: s[self.right] - s[self.left]
        bars = (c == 124) | (c == 0x2502)
        head, tail = np.append(c, 0)[self.left], c[np.maximum(self.right - 1, 0)] if len(c) else np.zeros(self.n)
        full = self.right > self.left
        one, two = inside(self._upto(c == 124)), inside(self._upto(c == 0x2502))
        barred = full & ((head == 124) | (tail == 124) | (one >= 2) | (two >= 2))
        rest = np.flatnonzero(~bars)
        a = np.searchsorted(rest, self.left)
        b = np.searchsorted(rest, self.right)
        n_bars = self._upto(bars)
        inner = np.ones(self.n, dtype=np.int64)
        some = barred & (b > a)
        inner[some] = n_bars[rest[b[some] - 1]] - n_bars[rest[a[some]]] + 1
        space = self.has(SPACE)
        after = np.append(space[1:], False)
        tabs, semis, commas = (inside(self._upto(c == k)) for k in (9, 59, 44))
        loose = inside(self._upto((c == 44) & after)) > 0
        gap = space & after & ~np.append([False], space[:-1])
        gaps = inside(self._upto(gap)) + 1
        kind, n = np.zeros(self.n, np.int64), np.ones(self.n, np.int64)
        for k, where, cells in (
            (5, commas >= 1, commas + 1), (4, gaps >= 2, gaps), (3, (commas >= 1) & ~loose, commas + 1), (2, semis >= 1, semis + 1), (1, tabs >= 1, tabs + 1), (6, barred, inner),
        ):
            kind[where], n[where] = k, cells[where]
        return kind, n

    def variety(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of units of repetition, and of distinct ones, in the kept lines of each text."""
        unit, _, line = self.units(kept)
        owner = self.doc[line]
        return np.bincount(owner, minlength=self.n_docs), distinct_counts(unit, owner, self.n_docs)

    @cached_property
    def token_hashes(self) -> np.ndarray:
        """Hashes of the tokens in lower case."""
        return hash_runs(self.low, self.tokens["start"], self.tokens["end"])

    @cached_property
    def wide(self) -> np.ndarray:
        """Texts of which half the visible characters belong to an unspaced script."""
        return self.in_docs(IDEOGRAM) * 2 >= self.in_docs(VISIBLE)

    def units(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``hash, characters, line`` of what repetition is counted in: tokens, or the characters of an unspaced
        script, of the kept lines, in order."""
        t = self.tokens
        own = np.flatnonzero(kept[t["line"]] & ~self.wide[self.doc[t["line"]]]) if self.n_docs else np.zeros(0, np.int64)
        char = np.flatnonzero(self.has(IDEOGRAM))
        line = self._line_of(char)
        use = kept[line] & self.wide[self.doc[line]] if len(char) else np.zeros(0, bool)
        char, line = char[use], line[use]
        order = np.argsort(np.concatenate([t["start"][own], char]), kind="stable")
        unit = np.concatenate([self.token_hashes[own], self.codes[char].astype(np.uint64)])
        return unit[order], np.concatenate([(t["end"] - t["start"])[own], np.ones(len(char), np.int64)])[order], np.concatenate([t["line"][own], line])[order]

    def forms(self) -> list[str]:
        """The form of each line: ``prose``, ``list``, ``table``, ``junk`` or ``blank``."""
        blank = self.count(VISIBLE) == 0
        c = np.append(self.codes, [0, 0, 0])
        fence = ((c[self.left] == 96) | (c[self.left] == 126)) & (c[self.left] == c[self.left + 1]) & (c[self.left] == c[self.left + 2]) & (self.right - self.left >= 3)
        # lines between an odd and the next fence of a text are code
        fences = self._upto(fence)
        fenced = (fences[1:] - fences[self.first[self.doc]]) % 2 == 1 if self.n_docs else np.zeros(self.n, bool)
        forms = np.where(fence | fenced & ~blank, "junk", np.where(blank, "blank", "")).tolist()
        open_ = np.array([f == "" for f in forms], dtype=bool)
        # blocks of lines without a blank one or code between
        begins = open_.copy()
        begins[1:] &= ~open_[:-1] | (self.doc[1:] != self.doc[:-1])
        lo = np.flatnonzero(begins)
        hi = np.minimum(np.append(lo[1:], self.n), np.append(np.flatnonzero(~open_), self.n)[np.searchsorted(np.flatnonzero(~open_), lo)])
        block = _Block(self, forms)
        for a, b in zip(lo.tolist(), hi.tolist()):
            block.settle(a, b)
        return forms


#: What divides cells, by the index of ``Lines.cells``.
DIVIDERS = ("", "\t", ";", ",", "  ", ", ", "|")


class _Block:
    """Gives forms to the lines of a block, by their own look and that of their neighbours."""

    def __init__(self, lines: Lines, forms: list[str]):
        kind, n = lines.cells
        size = lines.right - lines.left
        shown = lines.count(VISIBLE)
        alpha, words, cjk = lines.count(ALPHA), lines._per_line(lines.word_runs["line"]), lines.count(IDEOGRAM)
        solid = lines.end - lines.start - lines.count(SPACE)
        readable = (alpha * 10 >= solid * 6) & (lines.longest <= 60)
        item = ~lines.ended & (size <= 90) & (words > 0) & ((words <= 12) | (cjk > 0) & (cjk <= 34)) & readable
        self.words, self.lines, self.forms = lines.words, lines.lines, forms
        self.kind, self.cells = kind.tolist(), n.tolist()
        self.ruled = ((lines.count(RULE) == lines.end - lines.start) & (lines.end > lines.start)).tolist()
        self.ended, self.prose, self.readable, self.item = lines.ended.tolist(), lines.prose.tolist(), readable.tolist(), item.tolist()
        self.marked = (2 * lines.count(ALNUM) >= shown).tolist()
        self.ordinary = (lines.ended | (lines.plain["common"] > 0)).tolist()
        self.cjk = cjk.tolist()

    def settle(self, lo: int, hi: int) -> None:
        x, forms, kind, cells, ruled = self.lines, self.forms, self.kind, self.cells, self.ruled
        if hi - lo > 1:
            self._tables(lo, hi)
        for k in range(lo, hi):
            if ruled[k] and forms[k] == "":
                near = [r for r in (k - 1, k + 1) if lo <= r < hi]
                forms[k] = "table" if any(forms[r] == "table" or kind[r] == 6 and not ruled[r] for r in near) else "junk"
        open_ = []
        for k in range(lo, hi):
            if forms[k] == "":
                if _LOG.match(x[k]):
                    forms[k] = "junk"
                elif self.marked[k] and MARK.match(x[k]):
                    forms[k] = "list"
                else:
                    open_.append(k)
        if not open_:
            return self._rest(lo, hi)
        # short lines without an end are unmarked items if several stand together
        code = {k for k in open_ if looks_code(x[k])}
        short = {k for k in open_ if self.item[k] and k not in code}
        ended = sum(self.ended[k] for k in open_)
        items = len(short) >= 3 and len(short) * 2 > len(open_) and ended * 2 < len(open_)
        for k in open_:
            if k in code and not (self.prose[k] and self.ended[k]):
                forms[k] = "junk"
            elif items and k in short:
                forms[k] = "list"
            elif self.prose[k]:
                forms[k] = "prose"
            elif k + 1 < hi and forms[k + 1] == "list" and x[k].rstrip().endswith((":", "：")):
                forms[k] = "list"
            else:
                forms[k] = "short" if self.readable[k] else "junk"
        self._rest(lo, hi)

    def _rest(self, lo: int, hi: int) -> None:
        """A heading, or a rest too short to judge, goes with its neighbours."""
        forms = self.forms
        for k in range(lo, hi):
            if forms[k] == "short":
                near = [forms[r] for r in (k + 1, k - 1) if lo <= r < hi and forms[r] != "short"]
                ordinary = self.ordinary[k] or self.cjk[k] and self.words.pieces.search(self.lines[k])
                forms[k] = near[0] if near else "prose" if ordinary else "junk"

    def _tables(self, lo: int, hi: int) -> None:
        """Neighbouring rows with the same divider and number of cells."""
        kind, cells, ruled = self.kind, self.cells, self.ruled
        k = lo
        while k < hi:
            sep, n = kind[k], cells[k]
            m = k
            while m < hi and (kind[m] == sep and cells[m] == n or ruled[m] and (sep in (4, 6) or cells[m] >= 2)):
                m += 1
            if n >= 2 and m - k >= 2:
                rows = [r for r in range(k, m) if not ruled[r]]
                if len(rows) >= 2 and self._is_table(rows, DIVIDERS[sep], n):
                    self.forms[k:m] = ["table"] * (m - k)
                    k = m
                    continue
            k += 1

    def _is_table(self, rows: list[int], sep: str, n: int) -> bool:
        x = self.lines
        if sep != "|" and 2 * sum(self.prose[r] and (self.ended[r] or len(x[r]) > 80) for r in rows) >= len(rows):
            return False  # sentences that happen to share their punctuation
        if sep == ", ":  # prose has commas, too: rows need short cells and no sentence
            return n >= 3 and not any(self.prose[r] or self.ended[r] for r in rows)
        if sep == "  ":
            return sum(_LOG.match(x[r]) is not None or looks_code(x[r]) for r in rows) * 2 < len(rows)
        if sep == ";":
            return sum(x[r].rstrip().endswith(";") for r in rows) * 2 < len(rows)
        if sep == ",":
            return sum(x[r].rstrip().endswith(",") or x[r].lstrip()[:1] in '[{"' and x[r].rstrip()[-1:] in "]}," for r in rows) * 2 < len(rows)
        return True


def line_forms(text: str, words: Words) -> list[tuple[str, str]]:
    """Each line of one text with its form."""
    lines = Lines([text], words)
    return list(zip(lines.lines, lines.forms()))
