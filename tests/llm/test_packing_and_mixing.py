import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm.mixing import allot, entropy, find_exponent, mix, temperature_weights
from skein.llm.packing import count_tokens, fill_report, pack, pack_histogram, packing_checks


def one_by_one(lengths, capacity, shortest):
    """The same rule, item by item."""
    packs = []
    for x in sorted(lengths, reverse=True):
        fit = [p for p in packs if sum(p) + x <= capacity]
        if fit:
            (min if shortest else max)(fit, key=sum).append(x)
        else:
            packs.append([x])
    return packs


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 40), st.booleans())
def test_every_item_has_its_place(lengths, capacity, shortest):
    got = pack_histogram(dict(Counter(lengths)), capacity, shortest)
    placed = Counter()
    for pattern, times in got:
        assert sum(pattern) <= capacity and times > 0
        for x in pattern:
            placed[x] += times
    assert placed == Counter(lengths)
    used = sum(n for _, n in got)
    # by groups, items of one length are spread or doubled up in another order than one by one
    assert used <= 1.25 * len(one_by_one(lengths, capacity, shortest)) + 2


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "web", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, tokens string")


def test_documents_to_containers(spark):
    texts = ["word " * n for n in (5, 5, 5, 9, 3, 1, 1, 40)] + [None, "", "a b"]
    df = docs(spark, texts)
    sizes = {r.doc_id: r.tokens for r in count_tokens(df, ["doc_id"]).collect()}
    assert sizes[8] == 0 and sizes[9] == 0 and sizes[0] >= 5
    out = pack(df, 16).collect()
    by = Counter()
    for r in out:
        by[r.container] += r.tokens
    assert max(by.values()) <= 16 and sorted(by) == list(range(len(by)))
    pieces = Counter(r.doc_id for r in out)
    assert {d for d, n in pieces.items() if n > 1} == {d for d, n in sizes.items() if n > 16} and set(pieces) == {d for d, n in sizes.items() if n}
    for d, n in sizes.items():
        assert sum(r.tokens for r in out if r.doc_id == d) == n
    assert pack(df.limit(0), 16).count() == 0


def test_a_length_shared_by_many(spark):
    df = docs(spark, ["one two three"] * 3000 + ["a b c d e f g"] * 500)
    packed = pack(df, 20)
    assert packed.count() == 3500 and packed.select("doc_id").distinct().count() == 3500
    assert packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= 20 and fill_report(packed, 20).first().fill > 0.9


def test_temperature():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0}
    assert temperature_weights(sizes, 0) == pytest.approx(dict.fromkeys(sizes, 1 / 3)) and temperature_weights(sizes, 1)["a"] == pytest.approx(1000 / 1110)
    x = find_exponent(sizes, target_entropy=0.8)
    assert entropy(temperature_weights(sizes, x)) == pytest.approx(0.8, abs=1e-6)
    y = find_exponent(sizes, max_repeats={"a": 1, "b": 1, "c": 4}, budget=500)
    assert temperature_weights(sizes, y)["c"] * 500 <= 40 * (1 + 1e-6) and temperature_weights(sizes, max(0, y - 0.01))["c"] * 500 > 40 or temperature_weights(sizes, y)["b"] * 500 <= 100 * (1 + 1e-6)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 1000), min_size=1), st.integers(1, 5), st.integers(0, 9000))
def test_allotment(sizes, repeats, budget):
    shares = {s: 0.25 for s in "abcd"}
    got = allot(sizes, shares, dict.fromkeys("abcd", repeats), budget)
    assert all(0 <= got[s] <= sizes.get(s, 0) * repeats for s in shares)
    assert sum(got.values()) <= budget and (sum(got.values()) >= budget - 4 or all(got[s] == sizes.get(s, 0) * repeats for s in shares))


def test_mix(spark):
    texts = [("big ", i, "Big ") for i in range(400)] + [("small", i, "small") for i in range(40)] + [("other", 1, "zzz")]
    df = spark.createDataFrame([(k, f"{t} text number {i} with some words", s) for k, (t, i, s) in enumerate(texts)] + [(9001, None, "big"), (9002, "big  text number 5 with some words", "big"), (9003, "x", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    selection, report = mix(df, targets)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].share - r["small"].share) < 0.02 and r["small"].most_times == 3 and r["none"].tokens == 0 and r["big"].most_times == 1
    got = selection.collect()
    assert len({x.doc_id for x in got}) == len(got) and sum(x.tokens * x.times for x in got) == sum(x.tokens for x in r.values())
    assert [x.doc_id for x in mix(df, targets)[0].orderBy("doc_id").collect()] == sorted(x.doc_id for x in got)
    assert mix(df.limit(0), targets)[0].count() == 0
    hot = mix(df, targets, target_entropy=math.log(2) * 0.9)[1].collect()
    assert abs(sum(x.share for x in hot) - 1) < 1e-9


def test_exponents_above_one_and_any_size():
    x = find_exponent({"a": 3, "b": 1}, 0.3)
    assert x > 1 and abs(entropy(temperature_weights({"a": 3, "b": 1}, x)) - 0.3) < 1e-6
    assert temperature_weights({"a": 1e300, "b": 1e-300}, 900.0) == {"a": 1.0, "b": 0.0}


def test_checks_find_what_is_broken(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, "d")], "doc_id bigint, text string")
    packed = spark.createDataFrame([(1, 0, 5, 0), (1, 0, 5, 3), (2, 0, 9, 0)], "doc_id bigint, piece int, tokens bigint, container bigint")
    assert packing_checks(docs, packed, 10).first().asDict() == {"documents": 2, "missing": 1, "twice": 1, "needlessly_split": 1, "overfull": 1, "gaps": 2}
