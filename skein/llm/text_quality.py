"""Per-document text statistics, and the form of a document: prose, list, table or junk.

Every line is first put into a form by its own look and that of its neighbours (``lines``). The document
starts from the form that holds most of its visible characters; then combined rules over the
statistics (``judge``) tell prose and lists from boilerplate, noise and symbols: duplicate lines, paragraphs and
sentences, coverage by one n-gram, share of common words, ratio of symbols. Whole texts are read; the
cost is linear in their length, sorting aside.

Defined results: a null text gives null statistics and no form; an empty text, or one
without a visible character, gives zeros and the form ``empty``; repeated documents are
judged alike; lines and paragraphs that differ in case or spacing only are duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.lines import ALNUM, CJK, DIGIT, IDEOGRAM, SPACE, UPPER, VISIBLE, Lines, Words, distinct_counts, first_places, hash_runs, portions, split_sentences
from skein.session import spread

STATS = [
    ("n_chars", "bigint"), ("n_words", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("digit_ratio", "double"), ("upper_ratio", "double"),
    ("n_lines", "bigint"), ("end_punct_share", "double"), ("common_word_share", "double"), ("dup_line_share", "double"), ("dup_paragraph_share", "double"),
    ("top_ngram_cover", "double"), ("prose_share", "double"), ("list_share", "double"), ("table_share", "double"), ("junk_share", "double"),
]
FORMS = ("prose", "list", "table", "junk")

#: Bounds of the combined rules, chosen on the test tables and checked there against the annotators' labels.
MOST_REPEATED, LEAST_COVER, MUCH_COVER = 0.6, 0.25, 0.5
LEAST_COMMON, MOST_SYMBOLS = 0.08, 0.5
#: Prose and list whose shares differ by less than this are told apart by how many lines end like sentences.
EVEN, MOSTLY_ENDED = 0.1, 0.5


def top_cover(units: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
    """For each owner (ascending) the most characters that the copies of one n-gram of 2 to 4 units cover.

    Overlapping copies count once; an n-gram that occurs once covers nothing.
    """
    best = np.zeros(n_owners, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        mixed = units.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        for n in (2, 3, 4):
            if len(units) < n:
                break
            at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
            if not len(at):
                continue
            gram = mixed[at]
            for k in range(1, n):
                gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + mixed[at + k]
            gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            order = np.argsort(gram, kind="stable")
            gram, at = gram[order], at[order]
            same = gram[1:] == gram[:-1]
            # a copy covers its units up to where the next copy begins
            stop = at + n
            stop[:-1] = np.where(same, np.minimum(stop[:-1], at[1:]), stop[:-1])
            covered = upto[stop] - upto[at]
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            total = np.add.reduceat(covered, begins)
            many = np.diff(np.append(begins, len(gram))) > 1
            np.maximum.at(best, owner[at[begins[many]]], total[many])
    return best


def duplicate_share(hashes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
    """Share of each owner's characters that stand in repetitions of an earlier run."""
    first = first_places(hashes, owner)
    total = np.bincount(owner, sizes, minlength=n_owners)
    kept = np.bincount(owner[first], sizes[first], minlength=n_owners)
    return np.where(total > 0, 1 - kept / np.maximum(total, 1), 0.0)


def repeated_sentences(sentences: list[str]) -> float:
    """Share of the characters of four or more sentences that repeat an earlier one."""
    plain = [s.strip().lower() for s in sentences]
    return 1 - sum(map(len, set(plain))) / max(1, sum(map(len, plain))) if len(plain) >= 4 else 0.0


def is_boilerplate(repeated: float, cover: float, n_units: int, n_distinct: int) -> bool:
    """The same few sentences, or the same few words, over and over, by the share of repeated sentences (or
    lines, or paragraphs), the coverage by one n-gram, and the number of tokens and of distinct ones."""
    if repeated > MOST_REPEATED:
        return cover > LEAST_COVER
    return n_distinct * 10 <= n_units * 3 and cover > MUCH_COVER and n_units >= 20


def repeats_itself(sentences: list[str], n_units: int, n_distinct: int, wide: bool) -> bool:
    """Whether the sentences of one text, with so many units of repetition, are boilerplate."""
    repeated = repeated_sentences(sentences)
    if repeated <= MOST_REPEATED and n_distinct * 10 > n_units * 3:
        return False
    joined = " ".join(sentences)
    tokens = CJK.findall(joined) if wide else joined.lower().split()
    ids = np.unique(np.array(tokens, dtype=object), return_inverse=True)[1]
    cover = top_cover(ids, np.array([len(t) for t in tokens], dtype=np.int64), np.zeros(len(tokens), np.int64), 1)[0] / max(1, len(joined))
    return is_boilerplate(repeated, float(cover), n_units, n_distinct)


class Portion:
    """Statistics and forms of some texts."""

    def __init__(self, texts: list[str | None], words: Words):
        self.lines = Lines(texts, words)
        self.forms = self.lines.forms()
        ls, n = self.lines, self.lines.n_docs
        self.visible, self.cjk = ls.in_docs(VISIBLE), ls.in_docs(IDEOGRAM)
        self.wide = ls.wide
        t = ls.tokens
        t_doc, t_size, t_hash = ls.doc[t["line"]], t["end"] - t["start"], ls.token_hashes
        unit, size, line = ls.units(np.ones(ls.n, dtype=bool))
        owner = ls.doc[line]
        self.n_units, self.n_distinct = np.bincount(owner, minlength=n), distinct_counts(unit, owner, n)
        self.cover = np.minimum(1.0, top_cover(unit, size, owner, n) / np.maximum(1, self.visible))
        self.dup_lines = self._duplicates(t_hash, t_size, t["line"], t_doc, n)
        # paragraphs are runs of lines without one of white space between
        bare = ls.right == ls.left
        begins = ~bare
        begins[1:] &= bare[:-1] | (ls.doc[1:] != ls.doc[:-1])
        self.dup_paragraphs = self._duplicates(t_hash, t_size, np.cumsum(begins)[t["line"]] if len(begins) else t["line"], t_doc, n)

    @staticmethod
    def _duplicates(hashes: np.ndarray, sizes: np.ndarray, run: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if not len(run):
            return np.zeros(n)
        begins = np.flatnonzero(np.diff(run, prepend=-1))
        return duplicate_share(hash_runs(hashes, begins, np.append(begins[1:], len(run))), np.add.reduceat(sizes, begins), doc[begins], n)

    def sentences(self, i: int) -> list[str]:
        ls = self.lines
        return [s for x in ls.lines[ls.first[i] : ls.last[i]] for s in split_sentences(x.strip()) if s.strip()]

    def describe(self) -> tuple[dict[str, np.ndarray], list[str]]:
        """The values of ``STATS`` and the form of each text; null texts count as empty."""
        ls, n = self.lines, self.lines.n_docs
        w = ls.word_runs
        w_doc = ls.doc[w["line"]]
        n_words, letters = np.bincount(w_doc, minlength=n), np.bincount(w_doc, w["end"] - w["start"], minlength=n)
        common = np.bincount(w_doc, w["common"], minlength=n) / np.maximum(1, n_words)
        for i in np.flatnonzero(self.wide & (self.visible > 0)).tolist():
            common[i] = sum(map(len, ls.words.pieces.findall(ls.text[ls.doc_start[i] : ls.doc_end[i]]))) / self.cjk[i]
        kind = np.array([FORMS.index(f) if f != "blank" else 4 for f in self.forms])
        shown = ls.count(VISIBLE)
        parts = np.bincount(ls.doc * 5 + kind, shown, minlength=5 * n).reshape(n, 5)[:, :4] if n else np.zeros((0, 4))
        share = parts / np.maximum(1, parts.sum(axis=1, keepdims=True))
        filled = kind != 4
        n_lines = np.bincount(ls.doc[filled], minlength=n)
        size, some = ls.doc_end - ls.doc_start, self.visible > 0
        visible = np.maximum(1, self.visible)
        stats = {
            "n_chars": size, "n_words": np.where(self.wide, self.cjk, n_words), "mean_word_length": letters / np.maximum(1, n_words),
            "symbol_ratio": (size - ls.in_docs(ALNUM | SPACE)) / visible, "digit_ratio": ls.in_docs(DIGIT) / visible, "upper_ratio": ls.in_docs(UPPER) / visible, "n_lines": n_lines,
            "end_punct_share": np.bincount(ls.doc, ls.ended & filled, minlength=n) / np.maximum(1, n_lines), "common_word_share": common, "dup_line_share": self.dup_lines,
            "dup_paragraph_share": self.dup_paragraphs, "top_ngram_cover": self.cover, **{f"{f}_share": share[:, k] for k, f in enumerate(FORMS)},
        }
        stats = {k: v if k == "n_chars" else np.where(some, v, 0) for k, v in stats.items()}
        top = share.argmax(axis=1) if n else []
        return stats, [self.judge(i, FORMS[k], stats, int(n_words[i])) if ok else "empty" for i, (k, ok) in enumerate(zip(top, some.tolist()))]

    def judge(self, i: int, form: str, stats: dict[str, np.ndarray], n_words: int) -> str:
        """The form of a text whose characters are mostly of ``form``, by all its statistics."""
        if form not in ("prose", "list"):
            return form
        at = {k: float(v[i]) for k, v in stats.items()}
        if abs(at["prose_share"] - at["list_share"]) < EVEN:
            form = "prose" if at["end_punct_share"] >= MOSTLY_ENDED else "list"
        # boilerplate: lines, paragraphs or sentences over again, or one n-gram that covers the text
        if at["top_ngram_cover"] > LEAST_COVER:
            repeated = max(at["dup_line_share"], at["dup_paragraph_share"]) if at["n_lines"] >= 4 else 0.0
            if repeated <= MOST_REPEATED:
                repeated = max(repeated, repeated_sentences(self.sentences(i)))
            if is_boilerplate(repeated, at["top_ngram_cover"], int(self.n_units[i]), int(self.n_distinct[i])):
                return "junk"
        # noise: hardly a common word among many, or mostly symbols
        if form == "prose" and not self.wide[i] and n_words >= 20 and at["common_word_share"] < LEAST_COMMON or at["symbol_ratio"] > MOST_SYMBOLS:
            return "junk"
        return form


def describe(texts: list[str | None], words: Words) -> tuple[dict[str, np.ndarray], list[str | None]]:
    """``Portion.describe`` of any number of texts; null texts have no form."""
    parts = [Portion(texts[lo:hi], words).describe() for lo, hi in portions(texts)]
    stats = {k: np.concatenate([p[0][k] for p in parts]) if parts else np.zeros(0) for k, _ in STATS}
    return stats, [None if t is None else f for t, f in zip(texts, [f for p in parts for f in p[1]])]


def text_stats(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id``, the statistics of ``STATS`` and ``form`` for every document. No shuffle."""
    words = Words.of(common_words)
    kinds = [pa.int64() if t == "bigint" else pa.float64() for _, t in STATS]
    names = ["doc_id", *(n for n, _ in STATS), "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            stats, forms = describe(texts, words)
            null = np.array([t is None for t in texts], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(stats[k].astype(t.to_pandas_dtype()), t, mask=null) for (k, _), t in zip(STATS, kinds)), pa.array(forms, pa.string())], names)

    schema = "doc_id bigint, " + ", ".join(f"{n} {t}" for n, t in STATS) + ", form string"
    return spread(documents.select("doc_id", "text")).mapInArrow(run, schema)


def find_not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, form`` of documents that are mostly list, table or junk."""
    return text_stats(documents, common_words).where("form in ('list', 'table', 'junk')").select("doc_id", "form")
