"""Interpolated Kneser-Ney character language models, kept as sorted hash arrays.

One sorted array for each order holds the hashes of all n-grams of all languages, each with
a row of interpolated log probabilities (one column a language) and, as n-grams are the contexts of the next
order, a row of back-off weights. Scoring looks all positions of a batch of texts up in the highest order, and
only those not found there in the next one; a jump table by the leading bits leads to within some
places of a hash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

ORDER = 4
#: Characters that the lowest order takes for possible.
ALPHABET = 12_000
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Characters scored together, which bounds the working memory.
CHUNK = 150_000

_CODE = re.compile(r"\w[/_\\]\w|\w\.[a-zA-Z]{1,5}\b|`|://")
#: Any match of ``_CODE`` holds one of these, and a point not at the end.
_CODE_SIGNS = frozenset("/_\\.`:")
_DIGITS = re.compile(r"\d+")


def normalise(text: str) -> str:
    """Lower case, without code-like words and digits, one space between words and around all."""
    words = text.lower().split()
    if ("." in text[:-1] or "/" in text or "_" in text or "`" in text or "\\" in text) and _CODE.search(text):
        words = [w for w in words if _CODE_SIGNS.isdisjoint(w) or not _CODE.search(w)]
    plain = " ".join(words)
    if _DIGITS.search(plain):
        plain = " ".join(_DIGITS.sub(" ", plain).split())
    return f" {plain} "


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """h[k-1][i] is the hash of the k characters that end at i (positions before k-1 are not used)."""
    out = [codes + np.uint64(1)]
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            h = np.zeros_like(codes)
            h[k - 1 :] = out[-1][k - 2 : -1] * _P + codes[k - 1 :] + np.uint64(k)
            out.append(h)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


def count_grams(texts: list[str], begins: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the highest order, one row of characters each, and how often the texts have them. Counts of
    several lists of texts can be added, if just one of them ``begins``."""
    pad = " " * ORDER
    codes = _codes(pad + "".join(normalise(t) + pad for t in texts))
    ends = np.arange(ORDER - 1 if begins else ORDER, len(codes))
    _, first, counts = np.unique(_hashes(codes, ORDER)[ORDER - 1][ends], return_index=True, return_counts=True)
    return codes[ends[first][:, None] + np.arange(1 - ORDER, 1)].astype(np.uint32), counts


def _train_one(grams: np.ndarray, counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each order: n-gram hashes with discounted ratio, and contexts with back-off weight."""
    h = _hashes(grams.astype(np.uint64).reshape(-1), ORDER)
    ends = np.arange(ORDER - 1, grams.size, ORDER)
    kinds, first = np.unique(h[ORDER - 1][ends], return_index=True)
    at, counts = ends[first], counts[first]
    levels: list[dict[str, np.ndarray]] = []
    for k in range(ORDER, 0, -1):
        # kinds, at, counts: distinct k-grams, where one ends, and their (continuation) counts
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context = h[k - 2][at - 1] if k > 1 else np.zeros(len(at), dtype=np.uint64)
        ctx, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=counts)
        types = np.bincount(inverse)
        levels.append({"gram": kinds, "prefix": context, "suffix": h[k - 2][at] if k > 1 else context, "ratio": np.maximum(counts - d, 0) / total[inverse], "context": ctx, "weight": d * types / total})
        if k > 1:
            kinds, first, counts = np.unique(h[k - 2][at], return_index=True, return_counts=True)
            at = at[first]
    return levels[::-1]


class Table:
    """The sorted hashes of one order's n-grams with their rows of bits; the last row is for unseen ones."""

    def __init__(self, keys: np.ndarray, chance: np.ndarray, weight: np.ndarray):
        # multiplied by an odd number, hashes spread over all leading bits
        mixed = keys * _MIX
        order = np.argsort(mixed)
        self.keys, rows = mixed[order], np.append(order, len(keys))
        self.bits, self.step_bits = -np.log2(chance[rows]).astype(np.float32), -np.log2(weight[rows]).astype(np.float32)
        bits = max(1, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.jump = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.jump).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash; the last one for hashes that aren't there."""
        n = len(self.keys)
        if not n:
            return np.zeros(len(hashes), np.int32)
        wanted = hashes * _MIX
        at = self.jump[(wanted >> self.shift).astype(np.int64)]
        out = np.full(len(wanted), n, np.int32)
        left = np.arange(len(wanted))
        for _ in range(self.steps):
            key = self.keys[np.minimum(at, n - 1)]
            hit = key == wanted
            out[left[hit]] = at[hit]
            # sorted keys: only those below the wanted one have it behind them
            more = key < wanted
            left, at, wanted = left[more], at[more] + 1, wanted[more]
            if not len(left):
                break
        return out


class CharModels:
    """Models of several languages with a shared table, a rejection bound and a confidence curve."""

    def __init__(self, langs: list[str], tables: list[Table]):
        self.langs, self.tables = langs, tables
        self.reject = np.full(len(langs), np.inf)
        self.slope, self.offset = 1.0, 0.0
        self.sentence_chars = np.full(len(langs), 80.0)

    @classmethod
    def train(cls, texts: dict[str, list[str]]) -> "CharModels":
        return cls.of_counts({k: count_grams(v, begins=True) for k, v in texts.items() if v})

    @classmethod
    def of_counts(cls, grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> "CharModels":
        """Models of each language's n-grams of the highest order (see :func:`count_grams`), each given once."""
        langs = sorted(grams)
        parts = [_train_one(*grams[x]) for x in langs]
        tables = []
        lowest = np.array([p[0]["weight"][0] if len(p[0]["weight"]) else 1.0 for p in parts]) / ALPHABET
        for k in range(ORDER):
            grams = np.concatenate([np.zeros(0, np.uint64), *(p[k]["gram"] for p in parts)])
            keys, one = np.unique(grams, return_index=True)
            prefix, suffix = (np.concatenate([np.zeros(0, np.uint64), *(p[k][x] for p in parts)])[one] for x in ("prefix", "suffix"))
            chance = np.zeros((len(keys) + 1, len(langs)))
            for j, p in enumerate(parts):
                chance[np.searchsorted(keys, p[k]["gram"]), j] = p[k]["ratio"]
            # what the order below gives, by the weight of the context; both are n-grams of that order
            chance[:-1] += above[below(prefix)] * known[below(suffix)] if k else lowest
            chance[-1] = lowest
            above, known = np.ones((len(keys) + 1, len(langs))), chance
            below = lambda wanted, keys=keys: np.searchsorted(keys, wanted)
            for j, p in enumerate(parts):
                if k + 1 < ORDER:
                    above[below(p[k + 1]["context"]), j] = p[k + 1]["weight"]
            tables.append(Table(keys, chance, above))
        return cls(langs, tables)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each normalised text in each language; inf where nothing is left to score."""
        out = np.full((len(texts), len(self.langs)), np.inf)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK):
                size += len(texts[hi])
                hi += 1
            self._bits(texts[lo:hi], out[lo:hi])
            lo = hi
        return out

    def _bits(self, texts: list[str], out: np.ndarray) -> None:
        pad = " " * (ORDER - 1)
        codes = _codes("".join(pad + t for t in texts))
        total = np.zeros(out.shape)
        size = np.array([len(t) for t in texts])
        starts = np.cumsum(size + len(pad)) - size - len(pad)
        # very long texts are scored in pieces, each with its left context
        h = _hashes(codes, ORDER)
        skip = np.zeros(len(codes), dtype=bool)
        for s in starts:
            skip[s : s + len(pad)] = True
        owner = np.repeat(np.arange(len(texts)), size + len(pad))
        for a in range(0, len(codes), CHUNK):
            part = np.arange(a, min(a + CHUNK, len(codes)))
            part = part[~skip[part]]
            if not len(part):
                continue
            got = np.zeros((len(part), len(self.langs)), dtype=np.float32)
            left = np.arange(len(part))
            for k in range(ORDER - 1, -1, -1):
                at = self.tables[k].find(h[k][part[left]])
                hit = at < len(self.tables[k].keys) if k else np.ones(len(at), dtype=bool)
                got[left[hit]] += self.tables[k].bits[at[hit]]
                left = left[~hit]
                if not len(left):
                    break
                got[left] += self.tables[k - 1].step_bits[self.tables[k - 1].find(h[k - 1][part[left] - 1])]
            own = owner[part]
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[begins]] += np.add.reduceat(got, begins, axis=0)
        seen = size > 2
        out[seen] = total[seen] / size[seen, None]

    def confidence(self, margin, size):
        """Calibrated chance that a language is right which beats the next by so many bits a character."""
        return 1 / (1 + np.exp(-np.clip(self.slope * margin * size**0.5 + self.offset, -50, 50)))

    def classify(self, texts: list[str], reject: bool = True) -> list[tuple[str | None, float]]:
        """(language or None, confidence) of each text. None: too little text, or rejected as unlike
        every language. The confidence is the calibrated chance that the best language is right."""
        plain = [normalise(t) for t in texts]
        if not self.langs:
            return [(None, 0.0)] * len(texts)
        known: dict[str, int] = {}
        for t in plain:
            known.setdefault(t, len(known))
        bits = self.bits(list(known))
        result = []
        for t, row in zip(known, bits):
            letters = sum(c.isalpha() for c in t)
            if letters < 2 or not np.isfinite(row).any():
                result.append((None, 0.0))
                continue
            order = np.argsort(row, kind="stable")
            best = int(order[0])
            confidence = float(self.confidence(row[order[1]] - row[best] if len(order) > 1 else 1.0, len(t)))
            ok = not reject or row[best] <= self.reject[best] * (1 + 2.0 / len(t) ** 0.5)
            result.append((self.langs[best] if ok else None, confidence if ok else 1 - confidence))
        return [result[known[t]] for t in plain]

    def take_calibration(self, other: "CharModels") -> None:
        at = [other.langs.index(x) if x in other.langs else -1 for x in self.langs]
        usual = float(np.median(other.sentence_chars)) if other.langs else 80.0
        self.reject = np.array([other.reject[j] if j >= 0 else np.inf for j in at])
        self.sentence_chars = np.array([other.sentence_chars[j] if j >= 0 else usual for j in at])
        self.slope, self.offset = other.slope, other.offset

    def calibrate(self, held: dict[str, list[str]]) -> None:
        """Sets the rejection bounds and the confidence curve on sentences that weren't trained on."""
        margins, right = [], []
        for j, lang in enumerate(self.langs):
            whole = [normalise(t) for t in held.get(lang, []) if t.strip()]
            if whole:
                self.sentence_chars[j] = float(np.median([len(t) for t in whole]))
                bits = self.bits(whole)[:, j]
                self.reject[j] = float(np.quantile(bits[np.isfinite(bits)], 0.98)) * 1.15 if np.isfinite(bits).any() else np.inf
            x, y = self.margins(lang, whole)
            margins += x.tolist()
            right += y.tolist()
        # a bound lies between what held-out sentences need and what their letters, shuffled, get
        found = self.reject[np.isfinite(self.reject)]
        rng = np.random.default_rng(11)
        for j, lang in enumerate(self.langs):
            if not len(found):
                break
            if not np.isfinite(self.reject[j]) or self.reject[j] < np.median(found):
                self.reject[j] = float(np.median(found))
            noise = [" " + "".join(rng.permutation(list(t.replace(" ", "")))) + " " for t in map(normalise, held.get(lang, [])[:400]) if len(t) > 20]
            if noise:
                self.reject[j] = min(self.reject[j], float(np.quantile(self.bits(noise).min(axis=1), 0.05)))
        self.fit_curve(np.array(margins), np.array(right), np.ones(len(margins)))

    def margins(self, lang: str, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For the beginnings of normalised sentences of a language, by how much the best language beats the next
        one, and whether it is the right one."""
        pieces = [p for t in whole for w in (8, 16, 40) for p in (f" {t.strip()[:w].strip()} ",) if len(p) > 4]
        if not pieces:
            return np.zeros(0), np.zeros(0)
        row = self.bits(pieces)
        order = np.argsort(row, axis=1)
        first = np.take_along_axis(row, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(row, order[:, 1:2], 1)[:, 0] if len(self.langs) > 1 else first + 1
        return (second - first) * np.array([len(p) for p in pieces]) ** 0.5, (order[:, 0] == self.langs.index(lang)).astype(float)

    def fit_curve(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Sets the confidence curve by margins, whether they were right, and how often each was seen."""
        if not len(x):
            return
        a, b = 1.0, 0.0
        for _ in range(200):  # logistic regression by Newton's method with a small ridge
            z = np.clip(a * x + b, -30, 30)
            p = 1 / (1 + np.exp(-z))
            w = n * p * (1 - p)
            g = np.array([(n * (p - y) * x).sum() + 1e-3 * a, (n * (p - y)).sum() + 1e-3 * b])
            hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
            if abs(step).max() < 1e-6:
                break
        self.slope, self.offset = float(max(a, 0.05)), float(b)


def word_votes(sentence: str, votes: dict[str, list[str]], pieces: re.Pattern) -> Counter:
    """Hits of the common words of each language."""
    got: Counter = Counter()
    for w in re.findall(r"[^\W\d_]+", sentence.lower()):
        for lang in votes.get(w, ()):
            got[lang] += 1
    for w in pieces.findall(sentence):
        for lang in votes.get(w, ()):
            got[lang] += 1
    return got
