"""The questions that can be asked of sessions, turns and transcripts, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import byte_index, format_time, one_line, short_id, snippet, usage_total

LIMIT = 20
_USAGE = ("input", "output", "cache_read", "cache_write", "reasoning")


def _newest() -> list[Column]:
    return [F.desc_nulls_last("mod_time"), F.asc("path")]


def distinct_sessions(sessions: DataFrame) -> DataFrame:
    """A session that is listed twice counts once."""
    return sessions.select("source", "id", "path", "cwd", "bytes", "mod_time").distinct()


def newest(sessions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest sessions; all of them for a limit of 0 or less."""
    rows = distinct_sessions(sessions).orderBy(*_newest())
    return rows.limit(limit) if limit > 0 else rows


def ls(sessions: DataFrame, transcripts: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """``source, id, title, cwd, bytes, modified, path`` of the newest sessions. The titles are empty
    unless transcripts are given; a session without a transcript keeps an empty one."""
    top = newest(sessions, limit)
    if transcripts is None:
        rows = top.withColumn("title", F.lit(""))
    else:
        rows = top.join(transcripts.select("path", "title").dropDuplicates(["path"]), "path", "left").withColumn("title", F.coalesce("title", F.lit("")))
    return rows.orderBy(*_newest()).select("source", "id", "title", "cwd", "bytes", F.date_format(F.col("mod_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified"), "path")


def sources(sessions: DataFrame) -> DataFrame:
    """``source, sessions, newest``."""
    return distinct_sessions(sessions).groupBy("source").agg(F.count("*").alias("sessions"), F.max("mod_time").alias("newest"))


def search(turns: DataFrame, sessions: DataFrame, transcripts: DataFrame, query: str, limit: int = 0, context: int = 80, turns_only: bool = False, prefilter: DataFrame | None = None) -> DataFrame:
    """``source, session, title, role, time, turn, snippet`` of turns that contain the query, in any case.

    A limit takes the first hits by session (newest first) and turn; the result is ordered by time.
    ``prefilter`` (rows with ``path``) keeps the search to some sessions. Repeated turns count once.
    """
    needle = query.lower()
    rows = turns.where(F.col("role").isin("user", "assistant")) if turns_only else turns
    if prefilter is not None:
        rows = rows.join(prefilter.select("path").distinct(), "path", "left_semi")
    at = byte_index(F.col("all_text"), needle)
    hits = rows.where(F.contains(F.lower("all_text"), F.lit(needle))).select("source", "path", "turn_idx", "role", "ts", "all_text").distinct().withColumn("at", at)
    info = distinct_sessions(sessions).groupBy("path").agg(F.max("mod_time").alias("mod_time"))
    named = transcripts.select("path", "id", "title").dropDuplicates(["path"])
    joined = hits.join(info, "path", "left").join(named, "path", "left")
    order = [F.desc_nulls_last("mod_time"), F.asc("path"), F.asc("turn_idx")]
    if limit > 0:
        joined = joined.orderBy(*order).limit(limit)
    shown = joined.withColumns({"time": format_time(F.col("ts")), "session": short_id(F.col("id")), "snippet": snippet(F.col("all_text"), F.col("at"), len(needle.encode()), context)})
    # a dash (unknown time) sorts behind all times
    ordered = shown.orderBy(F.desc(F.when(F.col("time") == "-", "").otherwise(F.col("time"))), *order)
    return ordered.select("source", "session", F.coalesce("title", F.lit("")).alias("title"), "role", "time", F.col("turn_idx").alias("turn"), "snippet")


def containing(records: DataFrame, query: str) -> DataFrame:
    """Paths of which some raw line holds the query, in any case: a pre-filter for :func:`search`."""
    return records.where(F.contains(F.lower("raw"), F.lit(query.lower()))).select("path").distinct()


def stats(transcripts: DataFrame, by: str = "source", total: bool = False) -> DataFrame:
    """``key, sessions, messages, tool_calls, chars, input, …, reasoning, total_tokens, first, last``.

    ``by`` is ``model`` (an empty one counts as ``(unknown)``), anything else groups by source.
    ``total`` adds a row with the key ``TOTAL``.
    """
    key = F.when(F.coalesce(F.col("model"), F.lit("")) == "", "(unknown)").otherwise(F.col("model")) if by == "model" else F.col("source")
    rows = transcripts.withColumn("key", key)
    aggs = [
        F.count("*").alias("sessions"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "tool_calls", "chars")),
        *(F.coalesce(F.sum(f"usage.{k}"), F.lit(0)).alias(k) for k in _USAGE), F.sum(usage_total(F.col("usage"))).alias("total_tokens"), F.min("started").alias("first"), F.max("ended").alias("last"),
    ]
    if not total:
        return rows.groupBy("key").agg(*aggs).orderBy(F.desc("total_tokens"), "key")
    rolled = rows.rollup("key").agg(F.grouping("key").alias("g"), *aggs)
    return rolled.withColumn("key", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("key"))).orderBy("g", F.desc("total_tokens"), "key").drop("g")


def with_chars(transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds ``chars``: the bytes of each session's searchable text. Repeated turns and transcripts count once."""
    sizes = turns.select("path", "turn_idx", F.octet_length("all_text").alias("n"), F.xxhash64("role", "all_text").alias("h")).distinct().groupBy("path").agg(F.sum("n").alias("chars"))
    return transcripts.dropDuplicates(["path"]).join(sizes, "path", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))


class Unresolved(Exception):
    """No session, or more than one, answers to a fragment."""


def matching(sessions: DataFrame, fragment: str) -> DataFrame:
    """Sessions whose id or path contains the fragment, in any case."""
    f = F.lit(fragment.lower())
    return distinct_sessions(sessions).where(F.contains(F.lower("id"), f) | F.contains(F.lower("path"), f))


def resolve(sessions: DataFrame, fragment: str | None = None) -> DataFrame:
    """The one session that is meant: the newest without a fragment, else the only match, or the only
    match whose id equals the fragment."""
    if not fragment:
        return newest(sessions, 1)
    found = matching(sessions, fragment)
    few = found.limit(2).collect()
    if not few:
        raise Unresolved(f"no session matches {fragment!r}")
    if len(few) == 1:
        return found
    exact = found.where(F.lower("id") == fragment.lower())
    if len(exact.limit(2).collect()) == 1:
        return exact
    raise Unresolved(f"several sessions match {fragment!r}; use a longer id")


def titles(turns: DataFrame) -> DataFrame:
    """``path, title``: the first non-blank text of a user in each session, on one line."""
    spoken = turns.where("role = 'user'").where(F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)))
    return spoken.groupBy("path").agg(one_line(F.min_by("text", F.struct("turn_idx", "text"))).alias("title"))
