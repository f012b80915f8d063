"""Queries of the general operators over a folder of tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.render import header_markdown, turn_markdown
from skein.operators.fold import fold_transcripts, fold_turns, most_common, number_turns, running_clock, turn_totals
from skein.operators.nested import find_array_objects, item_links, linked_nodes
from skein.operators.parse_rows import classify_records, find_malformed, load_index, load_records
from skein.operators.schema_drift import changes, find_changes, unified_records
from skein.operators.timestamps import find_odd_times, record_times
from skein.plans import commands, core_oracles, fold_oracles
from skein.session import table, written
from skein.sources.decode import decode
from skein.sources.stores import DSH_FILES, preferred, selected

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES = {**core_oracles.ORACLES, **fold_oracles.ORACLES}
NEEDLE = "nightly build"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- the operators for general data problems ------------------------------------------------


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_malformed(table(spark, d, "records"), table(spark, d, "index_lines"))


@query
def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    bad = classify_records(table(spark, d, "records")).where("status = 'malformed'")
    # every way to break JSON's syntax counts as one here; ``p1_rejected`` tells them apart
    reason = F.when(F.col("reason").isin("blank_line", "not_an_object") | F.startswith("reason", F.lit("wrong_type")), F.col("reason")).otherwise("syntax")
    return bad.withColumn("reason", reason).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query
def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    return load_records(table(spark, d, "records"))[1].distinct()


@query
def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_records(table(spark, d, "records"))[0]


@query
def p1_index(spark: SparkSession, d: str) -> DataFrame:
    return load_index(table(spark, d, "index_lines")).where("status = 'record'").select("index_path", "line_no", "source", "id", "path", "cwd", "bytes", "mod_time")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return find_changes(table(spark, d, "records"), table(spark, d, "field_catalog"))


@query
def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    records, catalog = table(spark, d, "records"), table(spark, d, "field_catalog")
    return unified_records(records, catalog, written(changes(records, catalog)))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_odd_times(table(spark, d, "records"), table(spark, d, "machines"))


@query
def p6_times(spark: SparkSession, d: str) -> DataFrame:
    return record_times(table(spark, d, "records"), table(spark, d, "machines")).select("path", "line_no", "utc_ms", "shape", "tz_version").distinct()


@query
def p6_shapes(spark: SparkSession, d: str) -> DataFrame:
    times = record_times(table(spark, d, "records"), table(spark, d, "machines"))
    return times.groupBy("source", "shape").agg(F.count("*").alias("n"), F.count("utc_ms").alias("instants"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_array_objects(table(spark, d, "records"))


@query
def p7_nodes(spark: SparkSession, d: str) -> DataFrame:
    return linked_nodes(table(spark, d, "records"))


@query
def p7_links(spark: SparkSession, d: str) -> DataFrame:
    return item_links(table(spark, d, "records"))


# --- records to turns and transcripts -------------------------------------------------------


@query
def fold_records_turns(spark: SparkSession, d: str) -> DataFrame:
    return fold_turns(written(decode(table(spark, d, "records")))).select(
        "source", "path", "line_no", "turn_idx", "role", "ts", "model", "tool_calls", F.array_join(F.transform("blocks", lambda b: F.concat(b["kind"], F.when(b["is_error"], "!").otherwise(""))), " ").alias("block_kinds"), "text", "all_text"
    )


@query
def decoded_records(spark: SparkSession, d: str) -> DataFrame:
    lines = decode(table(spark, d, "records"))
    usage = [F.coalesce(f"usage.{k}", F.lit(-1)).alias(k) for k in ("input", "output", "cache_read", "cache_write", "reasoning")]
    return lines.select("source", "path", "line_no", "malformed", "ts", "cwd", "id", "title", "model", *usage, F.size("turns").alias("turns"))


@query
def fold_records_transcripts(spark: SparkSession, d: str) -> DataFrame:
    decoded = written(decode(table(spark, d, "records")))
    return fold_transcripts(decoded, written(fold_turns(decoded)), table(spark, d, "sessions")).select("*", "usage.*").drop("usage")


@query
def malformed_count(spark: SparkSession, d: str) -> DataFrame:
    seen = classify_records(table(spark, d, "records")).select("path", "line_no", "status").distinct()
    return seen.groupBy("path").agg(F.count_if(F.col("status") == "malformed").alias("malformed"))


# --- commands ---------------------------------------------------------------------------------


@query
def ls_newest(spark: SparkSession, d: str) -> DataFrame:
    return commands.ls(table(spark, d, "sessions"))


@query
def ls_titles(spark: SparkSession, d: str) -> DataFrame:
    return commands.ls(table(spark, d, "sessions"), table(spark, d, "transcripts"), 0)


@query
def sources_summary(spark: SparkSession, d: str) -> DataFrame:
    return commands.sources(table(spark, d, "sessions"))


@query
def resolve_fragment(spark: SparkSession, d: str) -> DataFrame:
    return commands.matching(table(spark, d, "sessions"), "Tidepool")


@query
def resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "sessions")
    return commands.resolve(sessions, sessions.agg(F.min("id")).first()[0].upper())


@query
def newest_session(spark: SparkSession, d: str) -> DataFrame:
    return commands.resolve(table(spark, d, "sessions"))


@query
def sessions_selected(spark: SparkSession, d: str) -> DataFrame:
    return commands.distinct_sessions(table(spark, d, "sessions").where(F.col("source").isin(selected(" DSH,claude, other"))))


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return commands.with_chars(table(spark, d, "transcripts"), table(spark, d, "turns"))


@query
def stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    return commands.stats(_transcripts(spark, d))


@query
def stats_by_model(spark: SparkSession, d: str) -> DataFrame:
    return commands.stats(_transcripts(spark, d), "model")


@query
def stats_total_rollup(spark: SparkSession, d: str) -> DataFrame:
    return commands.stats(_transcripts(spark, d), total=True)


def _search(spark: SparkSession, d: str, **more) -> DataFrame:
    return commands.search(*(table(spark, d, t) for t in ("turns", "sessions", "transcripts")), NEEDLE, **more)


@query
def search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d)


@query
def search_turns_only(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, turns_only=True)


@query
def search_capped(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, limit=50).drop("snippet")


@query
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "turns")
    return turns.withColumn("byte_index", X.byte_index(F.col("all_text"), NEEDLE).cast("bigint")).where("byte_index is not null").select("path", "turn_idx", "role", "byte_index").distinct()


@query
def search_prefilter(spark: SparkSession, d: str) -> DataFrame:
    turns, some = table(spark, d, "turns"), commands.containing(table(spark, d, "records"), NEEDLE)
    return turns.select("path", "turn_idx", "role").distinct().join(some, "path", "left_semi")


# --- folds and windows over turns ----------------------------------------------------------------


def _turns(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "turns").select("path", "turn_idx", *more).distinct()


@query
def session_titles(spark: SparkSession, d: str) -> DataFrame:
    return commands.titles(table(spark, d, "turns"))


@query
def turn_texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns")
    return t.select("path", "turn_idx", X.turn_text(F.col("blocks")).alias("text"), X.all_text(F.col("blocks")).alias("all_text")).distinct()


@query
def visible_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").select("path", "turn_idx", "role", F.size(X.visible_blocks(F.col("blocks"), full=False, no_tools=True)).alias("plain"), F.size(X.visible_blocks(F.col("blocks"), full=True, no_tools=False)).alias("full"))
    return t.distinct()


@query
def turn_counts(spark: SparkSession, d: str) -> DataFrame:
    return turn_totals(table(spark, d, "turns").select("path", "turn_idx", "role", "tool_calls", "all_text").distinct())


@query
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("path", X.usage_total(F.col("usage")).alias("total")).distinct()


@query
def running_clock_turns(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d, "ts").withColumn("line_no", F.col("turn_idx").cast("bigint"))
    return running_clock(t.groupBy("path", "line_no").agg(F.max("ts").alias("ts"))).select("path", "line_no", "clock")


@query
def turn_ordinals(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).select("path", F.col("turn_idx").cast("bigint").alias("line_no"), F.lit(0).alias("pos"))
    return number_turns(t).select("path", "line_no", "turn_idx")


@query
def usual_model(spark: SparkSession, d: str) -> DataFrame:
    return most_common(_turns(spark, d, "model"), "model")


@query
def format_times(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, "ts").select("path", "turn_idx", X.format_time(F.col("ts")).alias("time")).distinct()


@query
def turns_markdown(spark: SparkSession, d: str) -> DataFrame:
    return turn_markdown(table(spark, d, "turns"), full=True)


@query
def turns_markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    return turn_markdown(table(spark, d, "turns"))


@query
def headers_markdown(spark: SparkSession, d: str) -> DataFrame:
    return header_markdown(table(spark, d, "transcripts"))


# --- paths, texts, sets ------------------------------------------------------------------------------


@query
def path_names(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("path", "/")
    slug, name = F.element_at(parts, 3), F.element_at(parts, -1)
    return table(spark, d, "sessions").select(
        "path", F.when(F.col("source") == "claude", X.claude_cwd(slug)).when(F.col("source") == "dsh", X.dsh_cwd(slug)).otherwise("").alias("slug_cwd"),
        F.when(F.col("source") == "codex", X.codex_id(name)).otherwise(F.col("id")).alias("file_id"), X.short_id(F.col("id")).alias("short8"), X.short_id(F.col("id"), 9).alias("short9"),
    ).distinct()


@query
def version_pick(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions").where("source = 'dsh' and bytes > 0").select("path").distinct().withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]+$", 1))
    return preferred(s, "dir", F.array_position(F.array(*map(F.lit, DSH_FILES)), F.element_at(F.split("path", "/"), -1))).select("dir", "path")


@query
def text_cuts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", X.collapse(t).alias("collapsed"), X.one_line(t).alias("title"), X.summary(t).alias("summary"), X.truncate(t, 60).alias("short"), X.truncate_lines(t).alias("long"), X.first_line(t).alias("line")
    )
