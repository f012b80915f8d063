import random

import duckdb
import pytest

from skein.llm.conversations import checked, conversation_paths, conversations, find_broken, jump, pointers
from skein.llm.oracles import P2

SCHEMA = "row_id bigint, source string, session_id string, seq bigint, time_ms bigint, role string, text string, arrived timestamp"


def messages(spark, rows):
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], SCHEMA)


def talk(session, *turns, source="claude"):
    return [(source, session, i + 1 if source == "dsh" else None, 1000 + i, role, text) for i, (role, text) in enumerate(turns)]


U, A = ("user", "q"), ("assistant", "a")
CASES = [
    ("good", talk("s", U, A, U, A), False), ("good_dsh", talk("s", U, A, source="dsh"), False), ("tool_between", talk("s", U, ("tool", "x"), A), False), ("spelled", talk("s", (" Human", "q"), ("AI", "a")), False), ("no_answer", talk("s", U), True),
    ("empty_answer", talk("s", U, ("assistant", "​ 　")), True), ("null_text", talk("s", U, ("assistant", None)), True), ("starts", talk("s", A, U, A), True), ("between", talk("s", U, U, A), True), ("open_end", talk("s", U, A, U), True), ("two_answers", talk("s", U, A, A), False),
    ("only_system", talk("s", ("system", "x")), True), ("gap", [x for x in talk("s", U, A, ("tool", "t"), U, A, source="dsh") if x[2] != 3], True), ("from_two", talk("s", ("tool", "t"), U, A, source="dsh")[1:], True), ("null_seq", talk("s", U, A, source="dsh") + [("dsh", "s", None, 5, "tool", "x")], True),
    ("null_role", talk("s", U, (None, "x"), A), False),
]


def test_each_defect(spark):
    rows = [(s, name, *rest) for name, part, _ in CASES for s, _, *rest in part]
    got = {r.session_id for r in find_broken(messages(spark, rows + rows[:20] + [("claude", None, None, 1, "user", "x")])).collect()}
    assert got == {name for name, _, bad in CASES if bad}


def test_random_sessions_against_sql(spark):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        source, n = rng.choice(["claude", "dsh"]), rng.choice([1, 2, 3, 5, 9]) if k else 700
        for i in range(n):
            seq = i + 1 + (rng.random() < 0.03) if source == "dsh" else None
            row = (source, f"s{k}", seq, 1000 + i * rng.choice([1, 1, 1, 0]), rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[i % 2], rng.choice(["x", "y", " ", None]) if rng.random() < 0.1 else f"t{i}")
            rows += [row] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    df = messages(spark, rows)
    con = duckdb.connect()
    con.register("messages", df.toPandas().astype({"seq": "Int64"}))
    assert {r.session_id for r in find_broken(df).collect()} == {r[0] for r in con.execute(P2).fetchall()}


def test_predecessors_cross_partitions(spark):
    rows = [("hot", "claude", None, i // 3, i) for i in range(500)] + [(f"k{i}", "codex", None, i, 1000 + i) for i in range(50)]
    rows += [("hot", "dsh", 1 + i // 2, 7, 2000 + i) for i in range(400) if i not in (100, 101)] + [("d", "dsh", None, 7, 5000), ("d", "dsh", 1, 7, 5001), ("d", "dsh", 0, 7, 5002)]
    got = {r.id: (r.parent, r.orphan) for r in pointers(spark.createDataFrame(rows, "session_id string, source string, seq bigint, time_ms bigint, id bigint")).collect()}
    want = {i: (i - 1 if 0 < i < 500 else None, False) for *_, i in rows if i < 2000}
    want |= {2000 + i: (None, i in (102, 103)) if i in (0, 1, 102, 103) else (2000 + (i // 2 - 1) * 2, False) for i in range(400) if i not in (100, 101)}
    assert got == want | {5000: (None, True), 5001: (None, False), 5002: (None, True)}


def test_jump_finds_roots_orphans_and_cycles(spark):
    rows = [(i, i - 1 if i else None, "user" if i % 3 == 0 else None) for i in range(100)] + [(200, 999, None), (201, 200, "user"), (300, 301, None), (301, 300, None)]
    got = {r.id: r for r in jump(checked(spark.createDataFrame(rows, "id bigint, parent bigint, speaks string")))[0].collect()}
    assert all(got[i].root == 0 and got[i].depth == i for i in range(100)) and got[1].spoke_before == "user" and got[0].spoke_before is None
    assert got[200].orphan and got[201].root == 200 and not got[201].orphan and got[300].in_cycle and got[301].in_cycle and not got[5].in_cycle


def test_a_branching_tree_gives_one_path_a_leaf(spark):
    rng = random.Random(8)
    parent = {0: None} | {i: rng.randrange(max(0, i - 6), i) for i in range(1, 60)} | {100: 999, 101: 100, 200: 201, 201: 200}
    rows = [(i, "claude", "s", None, i, ("user", "assistant", "tool")[i % 3], f"m{i}", None, up) for i, up in parent.items()]
    df = spark.createDataFrame(rows, SCHEMA + ", up bigint")
    got = {}
    for r in conversation_paths(df, "up").orderBy("leaf", "position").collect():
        got.setdefault(r.leaf, []).append((r.position, r.text, r.speaker))
    want = {}
    for leaf in set(parent) - set(parent.values()) - {200, 201}:
        path, at = [], leaf
        while at in parent:
            path.append(at)
            at = parent[at]
        want[leaf] = [(k, f"m{i}", ("user", "assistant", None)[i % 3]) for k, i in enumerate(reversed(path))]
    assert got == want and len(want) > 10
    assert [(r.leaf, r.text) for r in conversation_paths(messages(spark, talk("s", U, A))).orderBy("position").collect()] == [(1, "q"), (1, "a")]


def test_order_and_empty(spark):
    rows = talk("s", ("user", "1"), ("tool", "-"), ("assistant", "2"), ("user", "3"), ("assistant", "4"))
    out = conversations(messages(spark, rows[::-1])).orderBy("position").collect()
    assert [(r.speaker, r.text) for r in out] == [("user", "1"), ("assistant", "2"), ("user", "3"), ("assistant", "4")]
    assert find_broken(messages(spark, [])).count() == 0 and conversations(messages(spark, [])).count() == 0


@pytest.mark.parametrize("extra", ["id", "depth"])
def test_clashing_columns(spark, extra):
    from pyspark.sql import functions as F

    assert find_broken(messages(spark, talk("s", U, A)).withColumn(extra, F.lit(1))).count() == 0
