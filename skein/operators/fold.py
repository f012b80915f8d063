"""The ordered fold of records into turns and transcripts.

What depends on a line's place (the running clock, the ordinal of a turn) is computed in
two levels: inside blocks of line numbers, then over one row a block, so that a session
with a third of all records is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import all_text, first_line, nonblank, one_line, turn_text

BLOCK_LINES = 4096
_USAGE = ("input", "output", "cache_read", "cache_write", "reasoning")


def running(rows: DataFrame, order: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """Adds running aggregates over the lines of a path: ``name=("max" or "sum", column)``, each up to and including its row.

    They run inside blocks of line numbers, then over one row a block, which is made of the aggregated columns alone.
    """
    function = {"max": F.max, "sum": F.sum}
    rows = rows.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    inside = Window.partitionBy("path", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(*(function[f](c).alias(f"{k}_of") for k, (f, c) in wanted.items()))
    blocks = blocks.select("path", "block", *(function[f](f"{k}_of").over(before).alias(f"{k}_before") for k, (f, _) in wanted.items()))
    within = rows.withColumns({k: function[f](c).over(inside) for k, (f, c) in wanted.items()})
    whole = {k: F.greatest(k, f"{k}_before") if f == "max" else F.col(k) + F.coalesce(f"{k}_before", F.lit(0)) for k, (f, _) in wanted.items()}
    return within.join(blocks, ["path", "block"]).withColumns(whole).drop("block", *(f"{k}_before" for k in wanted))


def running_clock(rows: DataFrame) -> DataFrame:
    """Adds ``clock``: the latest ``ts`` of the path up to and including the line. Null times don't count."""
    return running(rows, ["line_no"], clock=("max", F.col("ts")))


def number_turns(turns: DataFrame) -> DataFrame:
    """Adds ``turn_idx``, from 0 in the order of (line_no, pos) within a path."""
    return running(turns, ["line_no", "pos"], turn_idx=("sum", F.lit(1))).withColumn("turn_idx", (F.col("turn_idx") - 1).cast("int"))


def fold_turns(decoded: DataFrame) -> DataFrame:
    """``source, path, line_no, turn_idx, role, ts, model, tool_calls, blocks, text, all_text, titles``.

    The clock and the number of turns so far come from one pass over blocks. ``decoded`` is read twice, so it should
    be a written table.
    """
    rows = decoded.select("source", "path", "line_no", "ts", "turns")
    timed = running(rows, ["line_no"], clock=("max", F.col("ts")), upto=("sum", F.size("turns")))
    each = timed.select("source", "path", "line_no", F.col("clock").alias("ts"), (F.col("upto") - F.size("turns")).alias("first"), F.posexplode("turns").alias("pos", "t"))
    return each.select(
        "source", "path", "line_no", (F.col("first") + F.col("pos")).cast("int").alias("turn_idx"), "t.role", "ts", "t.model", "t.tool_calls", "t.blocks",
        turn_text(F.col("t.blocks")).alias("text"), all_text(F.col("t.blocks")).alias("all_text"), "t.titles",
    )


def most_common(rows: DataFrame, value: str) -> DataFrame:
    """``path`` and the commonest non-empty value, the smallest of equally common ones."""
    counts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy("path", value).count()
    return counts.groupBy("path").agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value))


def turn_totals(turns: DataFrame) -> DataFrame:
    """``path, messages, tool_calls, chars``: turns of the two speakers, calls, and bytes of searchable text."""
    speaks = F.col("role").isin("user", "assistant")
    return turns.groupBy("path").agg(F.count_if(speaks).alias("messages"), F.sum("tool_calls").alias("tool_calls"), F.sum(F.octet_length("all_text")).alias("chars"))


def fold_transcripts(decoded: DataFrame, turns: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row a path, with the columns of the transcripts table and ``chars``.

    ``sessions`` gives the file id and the guessed working directory; where it lacks a path, or is
    not given, both are empty. claude usage and dsh usage are sums, codex usage is the last total.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    by_line = decoded.groupBy("source", "path").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if("malformed").alias("malformed"),
        last("cwd").alias("own_cwd"), last("id").alias("own_id"), last("title").alias("given_title"), last("model").alias("given_model"),
        F.struct(*(F.coalesce(F.sum(f"usage.{k}"), F.lit(0)).alias(k) for k in _USAGE)).alias("summed"), last("usage").alias("final"),
    )
    # turns are numbered in order within a path; only texts that a user may have titled the session with are moved
    is_title = F.col("titles") & nonblank(F.col("text"))
    opening = first_line(F.col("text"))
    titles = turns.where("role = 'user'").groupBy("path").agg(F.min_by("text", F.when(is_title, F.col("turn_idx"))).alias("first_text"), F.min_by(opening, F.when(opening != "", F.col("turn_idx"))).alias("opening"))
    models = most_common(turns.where("source = 'claude'"), "model").withColumnRenamed("model", "usual_model")
    files = (
        sessions.groupBy("path").agg(F.max("id").alias("file_id"), F.max("cwd").alias("file_cwd"))
        if sessions is not None
        else by_line.select("path", F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("file_cwd"))
    )
    t = by_line.join(turn_totals(turns), "path", "left").join(titles, "path", "left").join(models, "path", "left").join(files, "path", "left")
    empty, zero = F.lit(""), F.lit(0).cast("bigint")
    no_usage = F.struct(*(zero.alias(k) for k in _USAGE))
    title = F.coalesce("given_title", "first_text", empty)
    return t.select(
        "source", F.coalesce("own_id", "file_id", empty).alias("id"), F.coalesce("file_id", empty).alias("file_id"), "path", F.coalesce("own_cwd", "file_cwd", empty).alias("cwd"),
        one_line(F.when(nonblank(title), title).otherwise(F.coalesce("opening", empty))).alias("title"), "started", "ended",
        F.when(F.col("source") == "claude", F.coalesce("usual_model", empty)).when(F.col("source") == "dsh", F.coalesce("given_model", empty)).otherwise(empty).alias("model"),
        F.col("malformed").cast("bigint").alias("malformed"), F.coalesce("messages", zero).alias("messages"), F.coalesce("tool_calls", zero).alias("tool_calls"),
        F.when(F.col("source") == "codex", F.coalesce("final", no_usage)).otherwise(F.col("summed")).alias("usage"), F.coalesce("chars", zero).alias("chars"),
    )
