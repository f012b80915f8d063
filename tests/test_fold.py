import json

import pytest

from skein.operators.fold import fold_transcripts, fold_turns, number_turns, running_clock
from skein.sources.decode import READERS, Line, decode


def fold(spark, source, lines, sessions=None):
    raws = [x if isinstance(x, str) else json.dumps(x) for x in lines]
    df = spark.createDataFrame([(source, "p", i + 1, r) for i, r in enumerate(raws)], "source string, path string, line_no bigint, raw string")
    d = decode(df.unionByName(df.limit(1)))  # a repeated line counts once
    turns = fold_turns(d).cache()
    return fold_transcripts(d, turns, sessions).first(), turns.orderBy("turn_idx").collect()


def usage(t):
    return tuple(t.usage[k] for k in ("input", "output", "cache_read", "cache_write", "reasoning"))


def only(source, record):
    """What one record contributes."""
    READERS[source](json.loads(record) if isinstance(record, str) else record, out := Line())
    return out


def msg(role="user", **message):
    return {"type": role, "message": message}


def item(kind, **payload):
    return {"type": "response_item", "payload": {"type": kind} | payload}


def event(kind, data):
    return {"type": kind, "data": data}


def piece(text, kind="text"):
    return {"type": kind, "text": text}


# one rule a row: a record, and its turns as (role, [(kind, shown)])
RULES = [
    ("claude", msg(content="Water the beans at dawn."), [("user", [("text", "Water the beans at dawn.")])]),
    ("claude", msg(content="\u3000\n"), []), ("claude", msg(content=None), []), ("claude", {"type": "user"}, []), ("claude", {"type": "user", "message": "Water"}, []), ("claude", msg("progress", content="x"), []),
    ("claude", msg(content=[piece("Plum"), None, piece(" "), {"type": "image"}, {"text": "no type"}]), [("user", [("text", "Plum")])]), ("claude", msg(content=[piece("Plum"), piece(7)]), []), ("claude", msg(content=[piece("Plum"), "bare"]), []),
    ("claude", msg("assistant", content=[{"type": "thinking", "thinking": "soil is dry"}, {"type": "tool_use", "name": "Valve", "input": {"open": True, "bed": 4, "by": 1.50}}]), [("assistant", [("thinking", "soil is dry"), ("tool_use", 'Valve {"bed":4,"by":1.5,"open":true}')])]),
    ("claude", msg(content=[{"type": "tool_result", "content": "a <b> & c"}]), [("user", [("tool_result", '"a \\u003cb\\u003e \\u0026 c"')])]), ("claude", msg(content=[{"type": "tool_result", "content": "ok", "is_error": "no"}]), []),
    ("claude", msg(model=3, content="Water"), []), ("claude", msg("assistant", content="Done", usage={"input_tokens": 2.0}), []), ("claude", '{"type":"user","type":"assistant","message":{"content":"old","content":"new"}}', [("assistant", [("text", "new")])]),
    ("codex", item("message", role="system", content=[piece("Rain is due", "input_text"), piece("soon", "output_text"), piece("x", "image")]), [("system", [("text", "Rain is due"), ("text", "soon")])]), ("codex", item("message", role="critic", content=[piece("Rain")]), []),
    ("codex", item("message", role="user", content="Rain"), []), ("codex", item("message", role="user", content=[{"type": "text", "text": ["Rain"]}]), []), ("codex", {"type": "response_item", "payload": 4}, []), ("codex", {"type": "other", "payload": {"type": "message", "role": "user", "content": [piece("Rain")]}}, []),
    ("codex", item("reasoning", summary=[{"text": "cloudy"}, {"text": "\t"}, {}, {"text": "cold"}]), [("assistant", [("thinking", "cloudy\ncold")])]), ("codex", item("reasoning", summary=[]), []), ("codex", item("reasoning", summary=[{"text": 1}]), []),
    ("codex", item("function_call", name="gauge", input="mm"), [("assistant", [("tool_use", "gauge mm")])]), ("codex", item("custom_tool_call", name="gauge", input=None), [("assistant", [("tool_use", "gauge ")])]), ("codex", item("function_call", name="gauge", input={"unit": "mm"}), []),
    ("codex", item("custom_tool_call_output", input="12 mm"), [("tool", [("tool_result", "12 mm")])]), ("codex", item("function_call_output"), [("tool", [("tool_result", "")])]),
    ("dsh", event("user/message", {"content": [piece("Prune the vines"), piece("x", "file")]}), [("user", [("text", "Prune the vines")])]), ("dsh", event("user/message", {"content": 1, "inserted": [{"content": [piece("Mulch")]}]}), [("user", [("text", "Mulch")])]), ("dsh", event("user/message", "Prune"), []),
    ("dsh", event("agent/inbox/spliced", {"inserted": [{"content": [piece("Mulch")]}, None, {"content": []}, {"content": [piece("Rake")]}]}), [("user", [("text", "Mulch")]), ("user", [("text", "Rake")])]), ("dsh", event("agent/inbox/spliced", {"inserted": [{"content": "Mulch"}]}), []),
    ("dsh", event("assistant/message", {"message": {"content": [piece("frost tonight", "reasoning"), piece("Cover them.")]}}), [("assistant", [("thinking", "frost tonight"), ("text", "Cover them.")])]), ("dsh", event("assistant/message", {"message": {"role": 1, "content": [piece("Cover")]}}), []),
    ("dsh", event("tool/call", {"name": "shears", "arguments": "--fine"}), [("assistant", [("tool_use", "shears --fine")])]), ("dsh", event("tool/call", {"name": "shears", "arguments": {}}), []), ("dsh", event("tool/call", {}), [("assistant", [("tool_use", " ")])]),
    ("dsh", event("tool/result", {"message": {"content": [{"content": [piece("cut "), piece("9"), piece("!", "icon")]}, {"type": "x", "content": [piece(" vines")]}]}}), [("tool", [("tool_result", "cut 9 vines")])]), ("dsh", event("tool/result", {"message": {"content": [{"content": []}]}}), []),
]


@pytest.mark.parametrize("source,record,turns", RULES, ids=[str(i) for i in range(len(RULES))])
def test_one_record(source, record, turns):
    got = only(source, record).turns
    assert [(role, [(kind, text or (f"{name} {given}" if kind == "tool_use" else "")) for kind, text, name, given, _ in blocks]) for role, _, _, blocks, _ in got] == turns
    assert all(calls == sum(b[0] == "tool_use" for b in blocks) for _, _, calls, blocks, _ in got)


def counted(n, **more):
    return {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n} | more}}}


def test_usage_of_one_record():
    spent = {"input_tokens": 31, "output_tokens": 8, "cache_creation_input_tokens": 5, "cache_read_input_tokens": 77, "output_tokens_details": {"thinking_tokens": 3}}
    assert only("claude", msg("assistant", content="Dig.", usage=spent)).usage == (31, 8, 77, 5, 3) and only("claude", msg("assistant", content="Dig.")).usage == (0,) * 5
    assert only("claude", msg("assistant", content=" ", usage=spent)).usage is None and only("claude", msg("user", content="Dig.", usage=spent)).usage is None
    assert only("codex", counted(64, cached_input_tokens=16, reasoning_output_tokens=2)).usage == (64, 0, 16, 0, 2) and only("codex", {"type": "event_msg", "payload": {"type": "token_count", "info": None}}).usage is None
    assert only("codex", counted(1 << 63)).usage is None and only("codex", counted((1 << 63) - 1)).usage[0] == (1 << 63) - 1
    assert only("dsh", event("assistant/message", {"message": {}, "usage": {"inputTokens": 40, "reasoningTokens": 6}})).usage == (40, 0, 0, 0, 6)
    chunk = lambda n, kind="usage": {"chunk": {"type": kind, "usage": {"inputTokens": n, "outputTokens": 1}}}
    assert only("dsh", event("assistant/attempt", {"stream": [chunk(5), chunk(9, "text"), None, chunk(6)]})).usage == (11, 2, 0, 0, 0)
    assert only("dsh", event("assistant/attempt", {"stream": [chunk((1 << 63) - 1), chunk(1)]})).usage[0] == -(1 << 63) and only("dsh", event("assistant/attempt", {"stream": [{"chunk": 2}]})).usage is None


def test_names_and_places_of_one_record():
    meta = only("codex", {"type": "session_meta", "timestamp": "t", "payload": {"id": "plot-9", "cwd": "/garden"}})
    assert (meta.id, meta.cwd, meta.time) == ("plot-9", "/garden", "t") and only("codex", {"type": "turn_context", "payload": {"cwd": "/garden"}}).cwd == ""
    assert only("dsh", event("session", {"cwd": "/shed"})).cwd == "/shed" and only("dsh", event("session/title", {"title": "Vines"})).title == "Vines"
    assert only("dsh", event("request/header", {"header": {"config": {"model": "fern-2"}}})).model == "fern-2" and only("dsh", event("request/header", {"header": {"config": {"provider": 1, "model": "fern-2"}}})).model == ""
    assert only("claude", {"type": "summary", "cwd": "/field", "timestamp": "t"}).cwd == "/field"


def test_sessions_fold_by_their_own_rules(spark):
    t, turns = fold(spark, "codex", [counted(900), counted(30, output_tokens=4), item("message", role="assistant", content=[piece("Ready.")]), item("function_call", name="gauge"), counted(450, output_tokens=70)])
    assert usage(t) == (450, 70, 0, 0, 0) and (t.messages, t.tool_calls, t.title, t.model) == (2, 1, "", "") and [x.turn_idx for x in turns] == [0, 1]
    t, _ = fold(spark, "dsh", [event("session/title", {"title": "Old vines"}), event("user/message", {"content": [piece("Prune")]}), event("session/title", {"title": "New\nvines"}), event("request/header", {"header": {"config": {"model": "fern-1"}}}), event("request/header", {"header": {"config": {"model": "fern-2"}}}),
        event("assistant/message", {"message": {}, "usage": {"inputTokens": 40}}), event("assistant/attempt", {"stream": [{"chunk": {"type": "usage", "usage": {"inputTokens": 2}}}]}), "  "])
    assert (t.title, t.model, t.malformed) == ("New vines", "fern-2", 0) and usage(t) == (42, 0, 0, 0, 0)


def test_the_clock_runs_on_over_every_record(spark):
    at = lambda minute, r: r | {"timestamp": f"2031-06-02T07:{minute:02}:30+02:00"}
    t, turns = fold(spark, "claude", [at(20, msg(content="Sow")), at(12, msg(content="Hoe")), msg(content="Rake"), at(44, {"type": "note"}), at(31, msg(content="Pick")), {"type": "note", "timestamp": "noon"}])
    assert [(x.text, x.ts.minute) for x in turns] == [("Sow", 20), ("Hoe", 20), ("Rake", 20), ("Pick", 44)] and (t.started.minute, t.ended.minute, t.started.hour) == (12, 44, 5)
    t, turns = fold(spark, "dsh", [event("user/message", {"content": [piece(w)]}) | {"time": ms} for w, ms in (("a", 60_000), ("b", -5), ("c", 0), ("d", 180_000))])
    assert [int(x.ts.timestamp()) for x in turns] == [60, 60, 60, 180] and (int(t.started.timestamp()), int(t.ended.timestamp())) == (60, 180)


def test_damaged_lines_count_and_titles_are_found(spark):
    t, _ = fold(spark, "claude", ['{"type":', "true", " ", "null", msg(content=[{"type": "tool_result", "content": "x"}]), msg(content="\n Two beds\nof leeks ")])
    assert t.malformed == 3 and t.title == "Two beds of leeks"
    t, _ = fold(spark, "dsh", [event("agent/inbox/spliced", {"inserted": [{"content": [piece("\n Leeks first\nthen kale")]}]})])
    assert t.title == "Leeks first"


def test_lines_at_one_place(spark):
    rows = [("claude", "p", 1, json.dumps(msg(content=w))) for w in ("b", "a", "b")] + [("claude", "q", 1, json.dumps(msg(content="a"))), ("other", "p", 2, "{}"), ("claude", "p", 3, ""), ("claude", None, None, None)]
    df = spark.createDataFrame(rows, "source string, path string, line_no bigint, raw string")
    assert sorted((r.path, r.text) for r in fold_turns(decode(df)).collect()) == [("p", "a"), ("q", "a")] and decode(df.limit(0)).count() == 0
    deep = '{"type":"user","message":{"content":[{"type":"tool_result","content":' + "[" * 60_000 + "]" * 60_000 + "}]}}"
    assert [len(r.all_text) for r in fold_turns(decode(spark.createDataFrame([("claude", "p", 1, deep)], df.schema))).collect()] == [201]


def test_equal_models(spark):
    say = lambda m: {"type": "assistant", "message": {"model": m, "content": "x"}}
    assert fold(spark, "claude", [say("b"), say("a"), say("c"), say("b"), say("a")])[0].model == "a"


@pytest.mark.parametrize("step", [1, 1500])
def test_two_levels_equal_one(spark, step):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = [("p" if i % 3 else "q", i * step, (i * 7919) % 101 if i % 5 else None, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, line_no bigint, n int, pos int").withColumn("ts", F.timestamp_seconds("n"))
    w = Window.partitionBy("path").orderBy("line_no")
    assert running_clock(df).where(~F.col("clock").eqNullSafe(F.col("ts"))).count() > 0
    a = {(r.path, r.line_no): (r.clock, r.turn_idx) for r in number_turns(running_clock(df)).collect()}
    b = {(r.path, r.line_no): (r.c, r.k) for r in df.select("path", "line_no", F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), (F.row_number().over(w) - 1).alias("k")).collect()}
    assert a == b
