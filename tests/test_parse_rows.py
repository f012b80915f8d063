import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions.json_text import read, read_deep, write
from skein.operators.parse_rows import MALFORMED, RECORD, SKIPPED, _refuse, classify_records, diagnose, diagnose_row, find_malformed, load_index, load_records, parse_lines, split_row

LINES = [
    ("{}", "claude", RECORD, None), ('{"type":"a"}{"type":"b"}', "claude", MALFORMED, "trailing_data"), ('{"type":1}', "claude", MALFORMED, "wrong_type:type"),
    ('{"type":"\\ud800"}', "claude", RECORD, None), ("null", "claude", SKIPPED, None), (" null ", "dsh", SKIPPED, None), ("[1]", "codex", MALFORMED, "not_an_object"), ("3", "codex", MALFORMED, "not_an_object"),
    ("  ", "claude", MALFORMED, "blank_line"), ("  ", "dsh", SKIPPED, None), ("", "claude", SKIPPED, None), (None, "codex", SKIPPED, None), ('{"a":NaN}', "claude", MALFORMED, "not_a_json_number"),
    ('{"a":[Infinity]}', "dsh", MALFORMED, "not_a_json_number"), ('{"type":"x"},', "claude", MALFORMED, "trailing_data"), ('{"a":01}', "claude", MALFORMED, "bad_syntax"), ('{"a":1,}', "claude", MALFORMED, "bad_syntax"),
    ("﻿{}", "claude", MALFORMED, "byte_order_mark"), ("{'a':1}", "dsh", MALFORMED, "bad_syntax"), ('{"a":"x\ty"}', "dsh", MALFORMED, "control_character"), ('{"a":"\\x41"}', "dsh", MALFORMED, "bad_escape"),
    ('{"a":"b', "dsh", MALFORMED, "truncated"), ("hello", "dsh", MALFORMED, "not_json"), ('{"seq":1.0}', "dsh", MALFORMED, "wrong_type:seq"), ('{"seq":null,"time":12345678901234567890123}', "dsh", RECORD, None),
    ('{"seq":"1"}', "claude", RECORD, None), ('{"timestamp":5}', "dsh", RECORD, None), ('{"timestamp":5}', "codex", MALFORMED, "wrong_type:timestamp"), ('{"cwd":[]}', "claude", MALFORMED, "wrong_type:cwd"), ('{"cwd":[]}', "codex", RECORD, None),
    ('{"type":"a","type":2}', "codex", MALFORMED, "wrong_type:type"), ('{"type":5}', None, MALFORMED, "wrong_type:type"), ("[" * 100_000, "dsh", MALFORMED, "truncated"), ('{"a":' * 100_000 + "1" + "}" * 100_000, "dsh", RECORD, None), ('{"a":' * 100_000 + "1" + "}" * 99_999, "dsh", MALFORMED, "truncated"),
    ('{"type":5,"a":' + "[" * 30_000 + "]" * 30_000 + "}", "dsh", MALFORMED, "wrong_type:type"), ("[" * 20_000 + "]" * 20_000, "dsh", MALFORMED, "not_an_object"), ('{"a":' + "[" * 20_000 + "01" + "]" * 20_000 + "}", "dsh", MALFORMED, "bad_syntax"),
]


@pytest.mark.parametrize("line,source,status,reason", LINES, ids=[str(i) for i in range(len(LINES))])
def test_one_line_by_both_ways(line, source, status, reason):
    assert diagnose(line, source) == (status, reason)
    got, why, _ = parse_lines(pa.array([line], pa.string()), source)
    assert got[0] == status and (status != MALFORMED or why[0] == reason)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_blocks_agree_with_the_strict_parser(seed):
    rng = random.Random(seed)
    good = [json.dumps({"type": rng.choice(["a", None, "é"]), "seq": rng.choice([1, None]), "x": [rng.random(), {"y": "q\n"}]}) for _ in range(rng.randint(0, 300))]
    junk = ['"', ",", "{", "}", "[", "]", ":", "\\", "0", "-", "\t", "NaN", "-Infinity", "true", "\\ud83d", "'", "\n"]
    lines = []
    for x in good:
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(len(x) + 1)
            x = x[:i] + rng.choice(junk) + x[i:] if rng.random() < 0.6 else x[:i] + x[i + 2 :]
        lines.append(x)
    status, _, _ = parse_lines(pa.array(lines, pa.string()), "dsh")
    assert status.tolist() == [diagnose(x, "dsh")[0] for x in lines]


def records(spark, rows):
    return spark.createDataFrame(rows, "source string, path string, line_no bigint, raw string, status string, reason int")


def test_tables_with_nulls_repeats_and_clashing_columns(spark):
    rows = [("dsh", "p", 1, '{"type":"a"}', "x", 1), ("dsh", "p", 2, "{", "x", 1), ("dsh", "p", 2, "{", "y", 2), (None, None, None, None, None, None), ("claude", "q", 1, "x" * 300_000, None, 3)]
    df = records(spark, rows)
    got = {(r.path, r.line_no, r.status) for r in classify_records(df).collect()}
    assert got == {("p", 1, "record"), ("p", 2, "malformed"), (None, None, "skipped"), ("q", 1, "malformed")}
    index = spark.createDataFrame([("i", 1, "source,id,path,cwd,bytes,mod_time"), ("i", 2, "dsh,a,b,,5,2025-03-01T10:00:00Z"), ("i", 3, ""), ("i", 4, None)], "path string, line_no bigint, raw string")
    assert {tuple(r) for r in find_malformed(df, index).collect()} == {("p", 2), ("q", 1), ("i", 3), ("i", 4)}
    valid, rejected = load_records(df)
    assert [r.raw for r in valid.collect()] == ['{"type":"a"}'] and rejected.count() == 3
    assert find_malformed(df.limit(0), index.limit(0)).count() == 0


CSV = [
    ("dsh,a,b,c,5,2025-03-01T10:00:00Z", None), ('"dsh","a","b","c,""d""","5","2025-03-01T10:00:00Z"', None), ("dsh,a,b,c,5", "wrong_column_count"), ('dsh,a"b,c,d,5,2025-03-01T10:00:00Z', "broken_quoting"),
    ('dsh,"a" x,b,c,5,2025-03-01T10:00:00Z', "broken_quoting"), ('dsh,"a,b,c,5,2025-03-01T10:00:00Z', "broken_quoting"), ("x,a,b,c,5,2025-03-01T10:00:00Z", "unknown_source"), ("dsh,a,b,c,-5,2025-03-01T10:00:00Z", "invalid_bytes"),
    ("dsh,a,b,c,,2025-03-01T10:00:00Z", "invalid_bytes"), ("dsh,a,b,c,٣,2025-03-01T10:00:00Z", "invalid_bytes"), ("dsh,a,b,c,5,2025-02-30T10:00:00Z", "no_such_time"), ("dsh,a,b,c,5,2025-03-01T24:00:00Z", "no_such_time"), ("dsh,a,b,c,5,today", "invalid_mod_time"),
]


def test_listing_rows(spark):
    for line, reason in CSV:
        assert diagnose_row(line)[1] == reason, line
    df = spark.createDataFrame([("i", n + 2, line) for n, (line, _) in enumerate(CSV)], "path string, line_no bigint, raw string")
    got = {r.line_no: r for r in load_index(df).collect()}
    assert {n + 2: reason for n, (_, reason) in enumerate(CSV)} == {n: r.reason for n, r in got.items()}
    assert got[3].cwd == 'c,"d"' and got[3].bytes == 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab,"; é', max_size=6), min_size=1, max_size=8))
def test_quoting_round_trip(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' if set(f) & set(',"') or len(f) % 2 else f for f in fields)
    assert split_row(line) == fields


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_deep_reader_agrees_with_the_plain_one(seed):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind > 5:
            return {rng.choice("abc"): value(depth - 1) for _ in range(rng.randint(0, 3))} if kind == 6 else [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return [None, True, rng.randint(-9, 9), rng.random() * 1e3, "é\n\"x", ""][kind]

    text = json.dumps(value(4), indent=rng.choice([None, 1]))
    for _ in range(rng.choice([0, 0, 1, 2])):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice('",:{}[]01-.e\\tfn ') + text[i + rng.choice([0, 1]) :]

    def outcome(f):
        try:
            return f(text)
        except ValueError:
            return ValueError

    assert outcome(read_deep) == outcome(json.JSONDecoder(parse_constant=_refuse).decode if text == text.strip() else lambda t: json.JSONDecoder(parse_constant=_refuse).decode(t.strip(" \t\r\n")))
    if (got := outcome(read_deep)) is not ValueError:
        assert json.loads(write(got, compact=True)) == got


def test_numbers_and_depth_in_compact_text():
    assert write({"b": [1.0, 1e21, 1e-7, 123456789012345680000.0, 0.1, -0.000001, 5e-324, 12], "a": "é<"}, compact=True) == '{"a":"é<","b":[1,1e+21,1e-7,123456789012345680000,0.1,-0.000001,5e-324,12]}'
    deep = read('{"a":[' * 50_000 + "]}" * 50_000)
    assert write(deep) == '{"a": [' * 50_000 + "]}" * 50_000
