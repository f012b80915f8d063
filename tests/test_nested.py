from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from skein.operators.parse_rows import find_malformed
from skein.operators.nested import contained, find_array_objects, item_links, linked_nodes, node_tables, nodes, walk

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abcd"), x, max_size=3), max_leaves=25)


def brute(v, item="", top=True):
    """Places of all objects, in the order of their first mention."""
    out = []
    if isinstance(v, dict):
        out.append(item)
        for k, x in v.items():
            out += brute(x, f"{item}.{k}" if item else k, False)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out += brute(x, f"{item}[{i}]", False)
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), JSON, max_size=4))
def test_walk_against_recursion(value):
    got = walk(value)
    assert [n[4] for n in got] == brute(value)
    assert [n[0] for n in got] == list(range(len(got))) and sorted(n[1] for n in got) == list(range(len(got)))
    for pre, post, parent, *_ in got:
        inside = [o[0] for o in got if o[0] < pre and o[1] > post]
        assert (max(inside) if inside else None) == parent  # the nearest container is the parent


def test_depth_does_not_matter():
    v = {}
    for _ in range(50_000):
        v = {"a": [v]}
    assert len(walk(v)) == 50_001


def test_tables(spark):
    raw = '{"type":"t","m":{"c":[{"x":1,"d":[{"y":"é"},5,[{"z":null}]]},{"x":true}]}}'
    rows = [("claude", "p", 1, raw), ("claude", "p", 1, raw), ("claude", "p", 2, "{"), (None, None, None, None), ("dsh", "p", 3, '{"s":"[{}]"}')]
    df = spark.createDataFrame(rows, "source string, path string, line_no bigint, raw string").selectExpr("*", "1 as pre", "2 as item")
    assert {tuple(r) for r in find_array_objects(df).collect()} == {("p", 1, i) for i in ("m.c[0]", "m.c[1]", "m.c[0].d[0]", "m.c[0].d[2][0]")}
    all_nodes = nodes(df).dropDuplicates(["path", "line_no", "pre"])
    t = node_tables(all_nodes, ["m.c[]", "m.c[].d[]"])
    assert {r.scalars["x"] for r in t["m.c[]"].collect()} == {"1", "true"}
    assert {(r.outer_item, r.item) for r in contained(t["m.c[]"], t["m.c[].d[]"]).collect()} == {("m.c[0]", "m.c[0].d[0]")}
    assert find_array_objects(df.limit(0)).count() == 0


def test_linked_tables(spark):
    raw = '{"type":"t","m":{"c":[{"x":1,"d":[{"y":"é"},5,[{"z":null}]]},{"x":true}]}}'
    rows = [("claude", "p", 1, raw)] * 4 + [("claude", "p", 2, "{"), (None, None, None, None), ("dsh", "p", 3, '{"s":"[{}]"}')]
    df = spark.createDataFrame(rows, "source string, path string, line_no bigint, raw string")
    got = {(r.line_no, r.pre): r for r in linked_nodes(df).collect()}
    assert sorted((n, r.item, got[n, r.parent].item if r.parent is not None else None, r.scalars.get("x")) for (n, _), r in got.items()) == sorted([
        (1, "", None, None), (1, "m", "", None), (1, "m.c[0]", "m", "1"), (1, "m.c[0].d[0]", "m.c[0]", None), (1, "m.c[0].d[2][0]", "m.c[0]", None), (1, "m.c[1]", "m", "true"), (3, "", None, None)])
    # the parent is the nearest node by interval containment
    for (n, _), r in got.items():
        around = [o for (m, _), o in got.items() if m == n and o.pre < r.pre and o.post > r.post]
        assert r.parent == max((o.pre for o in around), default=None)
    assert {tuple(r) for r in item_links(df).collect()} == {("p", 1, "m.c[0]", "m.c[0].d[0]"), ("p", 1, "m.c[0]", "m.c[0].d[2][0]")}
    assert item_links(df.limit(0)).count() == 0 and {"p7_nodes", "p7_links"} <= set(entry.queries())


def test_any_depth(spark):
    objects, items = '{"a":' * 100_000 + "1" + "}" * 100_000, '{"a":[' * 1500 + "]}" * 1500
    df = spark.createDataFrame([("dsh", "p", 1, objects), ("dsh", "p", 2, items)], "source string, path string, line_no bigint, raw string")
    got = find_array_objects(df)
    assert got.count() == 1499 and got.agg({"item": "max"}).first()[0] == "a[0]" + ".a[0]" * 1498
    assert find_malformed(df, spark.createDataFrame([], "path string, line_no bigint, raw string")).count() == 0
