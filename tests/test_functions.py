from datetime import datetime

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.display import format_count, format_duration, human_bytes


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "s string").select(*columns).first())


def test_white_space_and_cuts(spark):
    s = F.col("s")
    assert one(spark, "  a　\u0085b\n c ", X.collapse(s), X.nonblank(s)) == ("a b c", True)
    assert one(spark, "  ", X.nonblank(s)) == (False,) and one(spark, None, X.nonblank(s), X.collapse(s)) == (False, None)
    for n, char in ((100, "x"), (101, "é"), (200, "字"), (201, "x"), (2000, "x"), (2001, "😀")):
        t = char * n
        got = one(spark, t, X.one_line(s), X.summary(s), X.truncate(s, 60), X.truncate_lines(s))
        assert got == (t if n <= 100 else char * 99 + "…", t if n <= 200 else char * 200 + "…", char * 59 + "…", t if n <= 2000 else char * 2000 + "\n… (truncated)")
    assert one(spark, "  first line\nsecond", X.first_line(s)) == ("first line",)


def test_names(spark):
    s = F.col("s")
    assert one(spark, "-work-a-b", X.claude_cwd(s), X.dsh_cwd(s)) == ("/work/a/b", "/work/a/b")
    assert one(spark, "~work-a", X.claude_cwd(s), X.dsh_cwd(s)) == ("", "/work/a")
    assert one(spark, "--", X.claude_cwd(s), X.dsh_cwd(s)) == ("//", "")
    assert one(spark, "rollout-2025-01-07T06-00-00-e220a839-7b1d.jsonl", X.codex_id(s)) == ("e220a839-7b1d",)
    assert one(spark, "session-12345678901", X.short_id(s), X.short_id(s, 9)) == ("12345678", "123456789")


def test_times(spark):
    s = F.col("s")
    when = lambda t: one(spark, t, X.format_time(X.parse_time(s)))[0]
    assert when("2025-03-01T10:00:00Z") == "2025-03-01 10:00" and when("2025-03-01T10:00:00.123456789+02:00") == "2025-03-01 08:00"
    assert [when(t) for t in ("2025-03-01", "2025-03-01T10:00:00", "2025-02-30T10:00:00Z", "", None)] == ["-"] * 5
    got = spark.createDataFrame([(0,), (-5,), (1740823200000,), (1740823200000123456,), (None,)], "t bigint").select(X.from_millis(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, None, datetime(2025, 3, 1, 10), None, None]


def test_snippets(spark):
    s = F.col("s")
    text = "the quick brown fox jumps over the lazy dog"
    assert one(spark, text, X.byte_index(s, "FOX"), X.snippet(s, X.byte_index(s, "fox"), 3, 5)) == (16, "…rown fox jump…")
    assert one(spark, "ééé fox", X.byte_index(s, "fox"), X.snippet(s, X.byte_index(s, "fox"), 3, 2)) == (7, "…� fox")
    assert one(spark, "abc", X.byte_index(s, ""), X.byte_index(s, "z"), X.snippet(s, X.byte_index(s, ""), 0, 0)) == (0, None, "abc")


def test_display():
    assert [format_count(n) for n in (999, 1000, 1250, 999_950, 1_000_000)] == ["999", "1.0k", "1.2k", "1000.0k", "1.0M"]
    assert [human_bytes(n) for n in (1023, 1024, 1024**2 * 3 // 2, 1024**5)] == ["1023B", "1.0K", "1.5M", "1.0P"]
    assert [format_duration(s) for s in (0.4, 59.5, 2214, 3600)] == ["0s", "1m0s", "36m54s", "1h0m0s"]
