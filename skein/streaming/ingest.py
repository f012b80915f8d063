"""Incremental ingestion: only files that are new or have changed are parsed again.

A file source of Structured Streaming reads each path once, but session files grow; so
changes are found by (path, mod_time, bytes) against what is stored, and the affected
sessions are folded anew. :func:`stream_new_files` covers stores whose files never change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.fold import fold_transcripts, fold_turns
from skein.session import written
from skein.sources.decode import decode
from skein.sources.stores import exists, plain_path, scan, whole_lines


def changed(sessions: DataFrame, known: DataFrame | None) -> DataFrame:
    """Sessions whose (path, mod_time, bytes) isn't known yet."""
    return sessions if known is None else sessions.join(known.select("path", "mod_time", "bytes").distinct(), ["path", "mod_time", "bytes"], "left_anti").select(sessions.columns)


def refresh(spark: SparkSession, sessions: DataFrame, store: str) -> int:
    """Folds changed sessions and adds them under ``store``; returns how many there were.

    Rows are written under the name of this run; ``sessions``, written last, tells which runs count and in what order,
    so what a run left that ended before is never read.
    """
    known = spark.read.parquet(f"{store}/sessions") if exists(spark, f"{store}/sessions") else None
    todo = written(changed(sessions, known))
    n = todo.count()
    if n:
        turn = 1 + (known.agg(F.max("turn")).first()[0] or 0 if known is not None else 0)
        run = uuid.uuid4().hex
        decoded = written(decode(scan(todo)))
        turns = written(fold_turns(decoded))
        for name, df in (("turns", turns), ("transcripts", fold_transcripts(decoded, turns, todo)), ("sessions", todo.withColumn("turn", F.lit(turn)))):
            df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("source").parquet(f"{store}/{name}")
    return n


def latest(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The rows of every path's newest finished run."""
    rows = spark.read.parquet(f"{store}/{name}")
    top = spark.read.parquet(f"{store}/sessions").groupBy("path").agg(F.max_by("run", "turn").alias("run"))
    return rows.join(top, ["path", "run"], "left_semi").drop("run", "turn")


def stream_new_files(spark: SparkSession, source: str, pattern: str, out: str, checkpoint: str) -> StreamingQuery:
    """Folds whatever files are there and not seen before, plain or compressed, then stops (``availableNow``).

    Each batch overwrites its own part of ``out``, so one that is run again after a failure adds nothing twice.
    """
    files = spark.readStream.text(pattern, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")

    def fold(batch: DataFrame, number: int) -> None:
        records = whole_lines(batch).select(F.lit(source).alias("source"), "path", "line_no", F.regexp_replace("line", "\r$", "").alias("raw")).where("raw <> ''")
        fold_turns(written(decode(records))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
