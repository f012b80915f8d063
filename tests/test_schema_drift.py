import itertools
import json
import random
import uuid

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators.schema_drift import MATCH_LEAST, Catalog, Sketch, _contained, best_matching, changes, find_changes, merge_profiles, name_similarity, profile, score, shape, unified_records

CATALOG = [
    ("dsh", "a", "type", "string", True), ("dsh", "a", "data", "object", True), ("dsh", "a", "data.role", "string", True), ("dsh", "a", "data.n", "int", True), ("dsh", "a", "data.opt", "any", False),
    ("dsh", "a", "data.list", "array", False), ("dsh", "a", "data.list[].k", "string", False), ("codex", "x/y", "type", "string", True), ("codex", "x/y", "payload", "object", True), ("codex", "x/y", "payload.type", "string", True),
]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 10**6))
def test_matching_against_all_permutations(n, m, seed):
    w = np.random.default_rng(seed).random((n, m))
    got = sum(w[i, j] for i, j in best_matching(w))
    small, large = min(n, m), max(n, m)
    t = w if n <= m else w.T
    want = max((sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small)), default=0)
    assert abs(got - want) < 1e-9


def test_sketches_merge():
    a, b, whole = Sketch(), Sketch(), Sketch()
    for i in range(1000):
        (a if i % 3 else b).add(f"v{i}")
        whole.add(f"v{i}")
    merged = Sketch.load(a.dump()).merge(Sketch.load(b.dump()))
    assert merged.n == whole.n and merged.dump() == whole.dump()
    assert name_similarity("model", "model_name") > 0.5 > name_similarity("role", "author")


def test_all_shapes_are_counted():
    rng = random.Random(3)
    a, b = Sketch(), Sketch()
    for i in range(4000):
        (a if i % 2 else b).add("".join(rng.choices("aZé7 -_/.\\u00a0", k=rng.randint(0, 40))))
    merged = Sketch.load(a.dump()).merge(Sketch.load(b.dump()))
    assert sum(merged.shapes.values()) == 4000 and 64 < len(merged.shapes) <= 6 * 2**8


def table(spark, rows):
    return spark.createDataFrame([(s, p, i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, (s, p, r) in enumerate(rows)], "source string, path string, line_no bigint, raw string")


def catalog(spark, rows=CATALOG):
    return spark.createDataFrame(rows, "source string, rtype string, field string, json_type string, required boolean")


def good(**more):
    return {"type": "a", "data": {"role": "user", "n": 5} | more}


def test_changes(spark):
    rows = [("dsh", f"g{i}", {"type": "a", "data": {"role": ["user", "bot"][i % 2], "n": 40 + i, "opt": [1]}}) for i in range(40)]
    rows += [
        ("dsh", "renamed", {"type": "a", "data": {"author": "user", "n": 50}}), ("dsh", "removed", {"type": "a", "data": {"n": 50, "stop": "end"}}), ("dsh", "added", good(extra={"deep": 1})), ("dsh", "retyped", {"type": "a", "data": {"role": "user", "n": "5"}}),
        ("dsh", "null", {"type": "a", "data": None}), ("dsh", "outer", {"type": "a", "data": "x"}), ("dsh", "new", {"type": "b", "z": 1}), ("dsh", "untyped", {"q": 1}), ("dsh", "elem", good(list=[{"k": 1, "j": 2}, 7])), ("dsh", "bad", "{"), (None, None, None),
        ("codex", "c", {"type": "x", "payload": {"type": "y"}}), ("codex", "c2", {"type": "x", "payload": {}}), ("dsh", "both", {"type": "a", "data": {"author": "bot", "n": 44, "phase": 2}}),
    ]
    df = table(spark, rows).unionByName(table(spark, rows[-3:]))
    got = {tuple(r) for r in find_changes(df, catalog(spark)).collect()}
    assert got == {
        ("renamed", "a", "data.role", "renamed"), ("removed", "a", "data.role", "removed"), ("removed", "a", "data.stop", "added"), ("added", "a", "data.extra", "added"), ("retyped", "a", "data.n", "retyped"), ("outer", "a", "data", "retyped"), ("new", "b", "type", "added"),
        ("elem", "a", "data.list[].k", "retyped"), ("elem", "a", "data.list[].j", "added"), ("c2", "x", "type", "added"), ("both", "a", "data.role", "renamed"), ("both", "a", "data.phase", "added"),
    }
    one = {r.path: json.loads(r.doc) for r in unified_records(df, catalog(spark), changes(df, catalog(spark))).collect()}
    assert one["renamed"]["data"] == {"role": "user", "n": 50} and one["retyped"]["data"]["n"] == 5 and one["added"]["data"]["_other"] == {"extra": {"deep": 1}}


def test_one_new_name_for_two_fields(spark):
    cat = [("dsh", "a", "type", "string", True), ("dsh", "a", "data", "object", True), ("dsh", "a", "data.role", "string", True), ("dsh", "a", "data.id", "string", True)]
    rng = random.Random(2)
    ids = [f"{rng.getrandbits(64):016x}" for _ in range(60)]
    rows = [("dsh", f"g{i}", {"type": "a", "data": {"role": ["user", "bot"][i % 2], "id": x}}) for i, x in enumerate(ids[:40])]
    rows += [("dsh", "r", {"type": "a", "data": {"key": "user", "id": x}}) for x in ids[40:50]] + [("dsh", "s", {"type": "a", "data": {"role": "bot", "key": x}}) for x in ids[50:]]
    df, c = table(spark, rows), catalog(spark, cat)
    found = changes(df, c)
    assert {(r.path, r.field, r.new_name) for r in found.collect()} == {("r", "data.role", "data.key"), ("s", "data.id", "data.key")}
    docs = [json.loads(r.doc)["data"] for r in unified_records(df, c, found).collect()]
    assert len(docs) == len(rows) and all(set(d) == {"role", "id"} and d["role"] in ("user", "bot") for d in docs)


def test_the_score_changes_smoothly_with_size():
    """No number of distinct values flips a score: neighbours differ by little."""
    scores = []
    for n in range(1, 400):
        known, found = Sketch(), Sketch()
        for i in range(n):
            known.add(f"/home/dev/project{i:03}")
        for i in range(5):
            found.add(f"/home/dev/project{(i * 7) % 900:03}")
        scores.append(score(known, found, "cwd", "workdir", frozenset(["string"])))
    assert max(abs(a - b) for a, b in zip(scores[36:], scores[37:])) < 0.03 and min(scores[60:]) >= MATCH_LEAST


def test_sketches_estimate():
    full = Sketch()
    for i in range(20_000):
        full.add(f"v{i}")
    assert 12_000 < full.distinct() < 30_000
    part = Sketch()
    for i in range(0, 40_000, 2):
        part.add(f"v{i}")
    assert 0.3 < _contained(part.low, full.low) < 0.7 and _contained(set(), full.low) is None


def test_depth_and_merging_levels(spark):
    deep = '{"type":"a","data":{"role":"user","n":1,"opt":' + '{"x":[' * 30_000 + "]}" * 30_000 + "}}"
    rows = [("dsh", "d", i, deep) for i in range(2)] + [("dsh", "e", 1, deep.replace('"role"', '"author"'))]
    df = spark.createDataFrame(rows, "source string, path string, line_no bigint, raw string")
    got = changes(df, catalog(spark))
    assert {(r.path, r.field, r.change) for r in got.collect()} == {("e", "data.role", "renamed")}
    docs = {r.path: r.doc for r in unified_records(df, catalog(spark), got).collect()}
    assert docs["d"].replace(" ", "") == deep and docs["e"].replace(" ", "") == deep
    many = [("dsh", f"p{i % 3}", {"type": "a", "data": {"role": f"r{i}", "n": i}}) for i in range(300)]
    one = {(r.kind, r.name): Sketch.load(r.sketch).n for r in merge_profiles(profile(table(spark, many).repartition(7), Catalog.of(catalog(spark)))).collect()}
    assert one[("known", "role")] == 300 and one[("known", "n")] == 300


def test_renamed_ids(spark):
    rng = random.Random(5)
    ids = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(640)]
    assert len({shape(x) for x in ids}) == 1
    cat = catalog(spark, [("codex", "s", "type", "string", True), ("codex", "s", "payload", "object", True), ("codex", "s", "payload.id", "string", True)])
    rows = [("codex", f"g{i}", {"type": "s", "payload": {"id": x}}) for i, x in enumerate(ids[:600])]
    rows += [("codex", f"r{i}", {"type": "s", "payload": {"ref": x, "note": "see the notes"}}) for i, x in enumerate(ids[600:])]
    got = [(r.path, r.field, r.change) for r in find_changes(table(spark, rows), cat).collect()]
    assert sorted(got) == sorted(x for i in range(40) for x in ((f"r{i}", "payload.id", "renamed"), (f"r{i}", "payload.note", "added")))


def test_empty_tables(spark):
    assert find_changes(table(spark, []), catalog(spark)).count() == 0
    assert {tuple(r) for r in find_changes(table(spark, [("dsh", "p", {"type": "a"})]), catalog(spark, [])).collect()} == {("p", "a", "type", "added")}
