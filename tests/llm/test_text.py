import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.char_models import CharModels, normalise
from skein.llm.language import code_of, find_unnamed_languages, fit, label_documents, label_segments, segments_of, smallest
from skein.llm.lines import CJK, VISIBLE, Lines, Words, codes_of, flags, line_forms, portions, split_sentences, without_code
from skein.llm.text_quality import STATS, describe, find_not_prose, text_stats, top_cover

COMMON = {
    "en": "the of and to in is that it was for on are with as be this have from or by not", "de": "der die das und ist nicht ich ein eine den dass mit auf für von zu es sich wenn",
    "fr": "le la les de des et est que qui dans un une pour pas ne plus avec sur ce il", "es": "el la los las de y es que en un una para no se con por lo como más pero", "zh": "的 了 是 在 我 有 和 就 不", "ru": "и в не на что я с как это но он по все",
}
WORDS = Words([(lang, w) for lang, ws in COMMON.items() for w in ws.split()])
SENTENCES = {
    "en": ["The {} of the house is open to all who come in the evening.", "It was not easy to find that {} with the old map from the office.", "We have to wait for the {} that is on the way to this town."],
    "de": ["Der {} ist nicht mit dem Zug gefahren, und das war auch gut so.", "Wenn es sich um den {} handelt, dann ist die Sache für uns klar.", "Ich habe die Nachricht von dem {} auf dem Tisch nicht gesehen."],
    "fr": ["Le {} est dans la maison et il ne veut pas sortir avec les autres.", "On ne sait pas qui est le {} que les voisins ont vu sur la place.", "La ville a besoin de plus de temps pour le {} des rues et des ponts."],
    "es": ["El {} no se ve desde la ventana, pero es más grande que los otros.", "Los vecinos dicen que el {} es un problema para la gente del barrio.", "En la plaza hay un {} que no funciona y por eso se ha cerrado."],
    "ru": ["Этот {} не был на столе, и я не знаю, что с ним стало.", "Он не хотел говорить, но все знали, что {} уже в пути.", "Я думаю, что это не {} и не на что смотреть по пути."],
    "zh": ["我们在河边看见了一个很大的东西，是不是{}还不知道。", "这里的人不喜欢{}，就是因为我有太多的事情和问题。", "他说的{}在学校里，我不知道有没有人看见了。"],
}
FILL = {"en": ["door", "garden", "letter"], "de": ["Vater", "Garten", "Brief"], "fr": ["chat", "jardin", "livre"], "es": ["perro", "jardín", "libro"], "ru": ["дом", "сад", "письмо"], "zh": ["书", "花园", "信"]}


def prose(lang, n, seed=0):
    rng = random.Random(f"{lang}{seed}")
    return ("" if lang == "zh" else " ").join(rng.choice(SENTENCES[lang]).format(rng.choice(FILL[lang])) for _ in range(n))


@pytest.fixture(scope="module")
def models():
    rng = random.Random(1)
    pool = []
    for lang in SENTENCES:
        for i in range(60):
            label = lang if rng.random() < 0.85 else rng.choice(list(SENTENCES))
            pool += [(label, prose(lang, 1, i))]
    return fit(pool, WORDS)


def test_models_give_probabilities(models):
    one = CharModels.train({"en": ["abab abba"], "de": ["zzzz"]})
    # over all continuations of a context the probabilities sum to one, up to the share kept for unseen characters
    total = sum(2.0 ** -(one.bits([" ab" + c])[0, 1] * 4 - one.bits([" ab"])[0, 1] * 3) for c in " abz")
    assert 0.8 < total <= 1.0001
    assert one.bits(["", " a "]).shape == (2, 2) and normalise("A  b\n12 lib/x.py é") == " a b é "


def test_held_out_accuracy(models):
    cases = [(lang, prose(lang, 1, 1000 + i)) for lang in SENTENCES for i in range(30)]
    got = models.classify([t for _, t in cases])
    assert sum(g == lang for (g, _), (lang, _) in zip(got, cases)) >= 0.97 * len(cases)
    assert [x[0] for x in models.classify(["", "12 34", "}{][", "qxz wvk jjq zzx kqv xwj"])][:3] == [None, None, None]


def test_labels_in_any_spelling():
    assert [code_of(x) for x in ("en", "EN_us", " de-AT ", "Spanish", "fra", "und", "", None, "xx", "pt.BR", "日本語")] == ["en", "en", "de", "es", "fr", None, None, None, None, "pt", "ja"]


def test_segments(models):
    text = prose("en", 4) + " " + prose("de", 3) + "\n\n- der die das\n- und ist nicht\n- ein eine den\n"
    assert [(s[0], round(s[2])) for s in segments_of([text], WORDS, models)[0]] == [("en", 4), ("de", 3)]
    lost = prose("fr", 6).replace(".", "").replace(",", "")
    (lang, _, n, _, _), *rest = segments_of([lost], WORDS, models)[0]
    assert lang == "fr" and not rest and 4 < n < 9


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, label int, langs int")


def common(spark):
    return spark.createDataFrame([(lang, w) for lang, ws in COMMON.items() for w in ws.split()], "lang string, word string")


def test_unnamed_languages(spark, models):
    rows = [(prose("en", 5), "English"), (prose("en", 5), "de"), (prose("fr", 3), None), (prose("fr", 5) + "\n\n" + prose("ru", 3), "fr_CA"), (prose("fr", 5) + "\n\n" + prose("ru", 2), "fr"), (None, "en"), ("", None), ("a\tb\n1\t2\n3\t4", None), (prose("zh", 3), "und"), (prose("en", 3000), "es")]
    got = {tuple(r) for r in find_unnamed_languages(docs(spark, rows), common(spark), models).collect()}
    assert got == {(1, "en"), (2, "fr"), (3, "ru"), (8, "zh"), (9, "en")}
    main = {r.doc_id: r for r in label_documents(docs(spark, rows), common(spark), models).collect()}
    assert main[3].lang == "fr" and main[3].mixed and main[5].lang is None and main[0].confidence > 0.9 and len(main) == len(rows)
    assert label_segments(docs(spark, rows), common(spark), models).where("doc_id = 3").count() == 2


def test_lists_tables_and_titles_have_a_language(spark, models):
    items = {lang: [s.format(FILL[lang][0]).rstrip(".。") for s in SENTENCES[lang]] for lang in SENTENCES}
    rows = [("\n".join(f"- {x}" for x in items[lang]), None, lang) for lang in ("de", "ru", "zh")]
    rows += [("| " + " | ".join(x.split()[:6]) + " |\n| " + " | ".join(x.split()[6:12]) + " |", None, "fr") for x in (" ".join(items["fr"]),)]
    rows += [("The door is open to all.\n" * 12, None, "en"), ("x = 1;\ny = f(x);\n", items["de"][0], "de"), (None, items["ru"][0], "ru"), ("7 8 9", None, None), (prose("en", 4), items["de"][0], "en")]
    df = spark.createDataFrame([(i, t, None, title) for i, (t, title, _) in enumerate(rows)], "doc_id bigint, text string, lang string, title string")
    main = {r.doc_id: r for r in label_documents(df, common(spark), models).collect()}
    assert {i: r.lang for i, r in main.items()} == {i: lang for i, (*_, lang) in enumerate(rows)}
    assert all((r.confidence is None) == (r.lang is None) for r in main.values())
    got = {(r.doc_id, r.lang, r.part) for r in label_segments(df, common(spark), models).where("lang is not null").collect()}
    assert got == {(i, lang, "title" if i in (5, 6) else "text") for i, (*_, lang) in enumerate(rows) if lang}
    assert {r.doc_id for r in find_unnamed_languages(df, common(spark), models).collect()} == {8}


def test_training_from_tables(spark):
    rows = [(prose(lang, 6, i), lang) for lang in ("en", "de", "fr") for i in range(8)]
    assert find_unnamed_languages(docs(spark, rows), common(spark)).count() == 0
    assert find_unnamed_languages(docs(spark, []), common(spark)).count() == 0


FORMS = [
    (prose("en", 6), "prose"), (prose("de", 5).lower(), "prose"), (prose("zh", 5), "prose"), (prose("fr", 4).upper(), "prose"), (prose("en", 4) + "\n\n- one\n- two\n\n" + prose("en", 3), "prose"), (prose("es", 4) + "\n```\nx = 1\n```\n" + prose("es", 2), "prose"),
    (prose("en", 1, 1)[:-1] + "; " + prose("en", 2, 2) + "\n" + prose("en", 1, 3)[:-1] + "; " + prose("en", 2, 4), "prose"), (prose("de", 1)[:-1] + "\t" + prose("de", 1, 2) + "\n" + prose("de", 1, 3)[:-1] + "\t" + prose("de", 2, 4), "prose"),
    ("- buy the milk\n- call home\n- write to Anna", "list"), ("1. one thing\n2. another\n3. the third", "list"), ("add a test\nremove the cache\nwrite docs\nmove the lock file", "list"), ("[ ] add\n[x] remove\n[ ] rename", "list"),
    ("a,b,c\n1,2,3\n4,5,6", "table"), ("a\tb\n1\t2\n3\t4", "table"), ("| a | b |\n|---|---|\n| 1 | 2 |", "table"), ("+---+---+\n| a | b |\n+---+---+\n| 1 | 2 |\n+---+---+", "table"), ("name    size  n\nfoo     12    3\nbar     7     44", "table"), ("a;b\n1;2\n3;4", "table"),
    ("def f(x):\n    return x + 1\nassert f(1) == 2", "junk"), ("Session restored.\n" * 12, "junk"), ("copied to clipboard " * 15, "junk"), ("DEBUG a: b took 5ms\n--- FAIL: test_x (0.1s)\n12 passed, 0 failed in 3s", "junk"), ("qwrt zxcv bnmk plkj hgfd " * 8, "junk"),
    ('[{"id": "a", "v": [1, 2]}, {"id": "b", "v": [3]}]', "junk"), ("=====\n-----\n*****", "junk"), ("00000000  0f cb d7 4d\n00000010  f8 89 52 21", "junk"), ("", "empty"), (" ​\n", "empty"), (None, None),
]


@pytest.mark.parametrize("text,form", FORMS, ids=[str(i) for i in range(len(FORMS))])
def test_forms(text, form):
    assert describe([text], WORDS)[1] == [form]


def test_statistics():
    got, _ = describe(["", "The cat is 7.\nthe  cat is 7.", None], WORDS)
    stats = {k: v[1] for k, v in got.items()}
    assert list(got) == [k for k, _ in STATS] and (stats["n_chars"], stats["n_words"], stats["mean_word_length"], stats["n_lines"], stats["end_punct_share"]) == (28, 6, 8 / 3, 2, 1.0)
    assert stats["common_word_share"] == 4 / 6 and stats["digit_ratio"] == 2 / 20 and stats["dup_line_share"] == 0.5 and stats["dup_paragraph_share"] == 0.0
    assert np.count_nonzero(flags(codes_of("a ​ㅤ😀é")) & VISIBLE) == 3 and [f for _, f in line_forms("x\r\n\r\ny", WORDS)][1] == "blank"


def cover_by_hand(tokens):
    best = 0
    for n in (2, 3, 4):
        at = {}
        for i in range(len(tokens) - n + 1):
            at.setdefault(tuple(tokens[i : i + n]), []).append(i)
        best = max([best] + [sum(len(tokens[k]) for k in {i + j for i in places for j in range(n)}) for places in at.values() if len(places) > 1])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc", "d"]), max_size=14), min_size=1, max_size=4))
def test_cover_by_one_ngram(texts):
    units, sizes, owner = (np.array(x, dtype=np.int64) for x in ([hash(t) & 0xFFFF for ts in texts for t in ts], [len(t) for ts in texts for t in ts], [i for i, ts in enumerate(texts) for _ in ts]))
    assert top_cover(units, sizes, owner, len(texts)).tolist() == [cover_by_hand(ts) for ts in texts]
    assert top_cover(*(np.array(x) for x in ([1] * 3 + list(range(2, 9)), [1] * 10, [0] * 10)), 1).tolist() == [3]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aZé7 \t\r\n.,;:|│/_(\"'’`~-我の。\u2028\u3000😀", max_size=60), min_size=1, max_size=5))
def test_line_features_by_hand(texts):
    got = Lines(texts, WORDS)
    lines = [x for t in texts for x in re.split(r"\r\n|\n|\r|\u2028|\u2029", t)]
    assert got.lines == lines and len(got.forms()) == len(lines)
    word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
    assert got._per_line(got.word_runs["line"]).tolist() == [len(word.findall(x)) for x in lines]
    assert got.plain["words"].tolist() == [len(word.findall(without_code(x))) for x in lines] and got.plain["cjk"].tolist() == [len(CJK.findall(without_code(x))) for x in lines]
    assert got.ended.tolist() == [bool(re.search(r"[.!?…。！？｡][\"'”’»)\]]*\s*$", x)) for x in lines]
    assert got.longest.tolist() == [max(map(len, x.split()), default=0) for x in lines]
    cut = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？｡])[\"'”」』]*\s*")
    assert [split_sentences(x) for x in lines] == [cut.split(x) for x in lines]
    whole = [f for a, b in portions(texts) for f in Lines(texts[a:b], WORDS).forms()]
    assert whole == [f for t in texts for _, f in line_forms(t, WORDS)]


def test_smallest_hashes_of_each_code(spark):
    rows = [("a" if i % 3 else "b", i, (i * 7919) % 1009 - 500) for i in range(900)]
    want = {(c, d) for c in "ab" for d in [d for _, d in sorted((h, d) for x, d, h in rows if x == c)[:50]]}
    df = spark.createDataFrame(rows, "code string, doc_id bigint, h bigint").repartition(5)
    assert {tuple(r) for r in smallest(df, 50).collect()} == want and smallest(df.limit(0), 5).count() == 0


TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_against_the_annotators(spark):
    """Where annotators agree by majority, at least 95 of 100 forms and main languages are theirs; where two or more do, 99 forms."""
    docs_, words, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "common_words", "labels"))
    opinions = labels.collect()
    ids = sorted({r.doc_id for r in opinions})
    some = docs_.join(spark.createDataFrame([(i,) for i in ids], "doc_id bigint"), "doc_id").collect()
    forms = dict(zip([r.doc_id for r in some], describe([r.text for r in some], Words.of(words))[1]))
    votes, n = {}, {}
    for r in opinions:
        if r.form in ("prose", "list", "table", "junk"):
            votes.setdefault(r.doc_id, Counter())[r.form] += 1
    clear = {d: c.most_common(1)[0][0] for d, c in votes.items() if len(c) == 1 or c.most_common(2)[0][1] > c.most_common(2)[1][1]}
    n = {d: sum(c.values()) for d, c in votes.items()}
    right = {d for d, f in clear.items() if forms.get(d) == f}
    assert len(clear) > 300 and len(right) >= 0.95 * len(clear)
    sure = {d for d in clear if n[d] >= 2}
    assert len(sure) > 50 and len(right & sure) >= 0.99 * len(sure)


def test_tables(spark):
    df = docs(spark, [(t, None) for t, _ in FORMS] + [(prose("en", 20_000), "x")])
    got = {r.doc_id: r.form for r in find_not_prose(df, common(spark)).collect()}
    assert got == {i: f for i, (_, f) in enumerate(FORMS) if f in ("list", "table", "junk")}
    assert text_stats(df, common(spark)).count() == len(FORMS) + 1 and text_stats(df.limit(0), common(spark)).count() == 0
