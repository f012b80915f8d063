"""The three session stores on disk: discovery, line scans and a probe of their files.

``discover_*`` give one row a session file without reading its content; ``scan`` gives the
``records`` table of discovered sessions. Compressed files are decoded by Spark's codec.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import claude_cwd, codex_id, dsh_cwd

# Where the stores lie under a home directory, and the dsh file names by preference.
ROOTS = {"claude": "~/.claude/projects", "codex": "~/.codex/sessions", "dsh": "~/.dsh/sessions"}
DSH_FILES = ["session.v3.jsonl.zstd", "session.jsonl.zstd"]
SESSION = "source string, id string, path string, cwd string, bytes bigint, mod_time timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that the session knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def plain_path(path) -> Column:
    """Local paths without their scheme, others as they are."""
    return F.regexp_replace(path, "^file:/*", "/")


def _files(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = False, name_filter: str | None = None) -> DataFrame:
    """``path, bytes, mod_time`` of matching files; the content column is never read."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    found = reader.load(f"{root.rstrip('/')}/{pattern}" if pattern else root)
    return found.select(plain_path("path").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mod_time"))


def _part(path: str, from_end: int):
    return F.element_at(F.split(path, "/"), -from_end)


def _session(files: DataFrame, source: str, id_, cwd) -> DataFrame:
    return files.select(F.lit(source).alias("source"), id_.alias("id"), "path", cwd.alias("cwd"), "bytes", "mod_time")


def discover_claude(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<slug>/<id>.jsonl``, at exactly this depth."""
    return _session(_files(spark, root, "*/*.jsonl"), "claude", F.regexp_replace(_part("path", 1), r"\.jsonl$", ""), claude_cwd(_part("path", 2)))


def discover_codex(spark: SparkSession, root: str) -> DataFrame:
    """``rollout-*.jsonl`` at any depth."""
    return _session(_files(spark, root, recursive=True, name_filter="rollout-*.jsonl"), "codex", codex_id(_part("path", 1)), F.lit(""))


def discover_dsh(spark: SparkSession, root: str) -> DataFrame:
    """One non-empty session file a directory, the newer format first."""
    files = _files(spark, root, "*/*/session*.jsonl.zstd").where(_part("path", 1).isin(DSH_FILES) & (F.col("bytes") > 0))
    best = preferred(files.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]+$", 1)), "dir", F.array_position(F.array(*map(F.lit, DSH_FILES)), _part("path", 1)))
    return _session(best, "dsh", _part("path", 2), dsh_cwd(_part("path", 3)))


def preferred(rows: DataFrame, key: str, rank) -> DataFrame:
    """The row of the lowest rank for each key (ties by path)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(rank, "path"))).where("__n = 1").drop("__n")


ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"claude": discover_claude, "codex": discover_codex, "dsh": discover_dsh}


def selected(names: str | None) -> list[str]:
    """The stores that a comma-separated list names, in fixed order; unknown names yield nothing."""
    wanted = {n.strip().lower() for n in names.split(",")} if names and names.strip() else set(ADAPTERS)
    return [n for n in ADAPTERS if n in wanted]


def discover(spark: SparkSession, roots: dict[str, str] | None = None, names: str | None = None) -> DataFrame:
    """Sessions of the selected stores; a store whose folder is missing or empty adds none."""
    found = spark.createDataFrame([], SESSION)
    for name in selected(names):
        root = os.path.expanduser((roots or ROOTS).get(name, ""))
        if root and exists(spark, root):
            try:
                found = found.unionByName(ADAPTERS[name](spark, root))
            except AnalysisException as e:  # a pattern that matches no file
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
    return found


#: Up to so many sessions are read by a list of their paths; of more, whole stores are read by pattern and joined.
LISTED = 10_000
#: A plain file larger than this is read in splits, a smaller or compressed one as a whole.
WHOLE_BYTES = 64 << 20
# The files of each store, at any depth.
PATTERNS = {"claude": "*.jsonl", "codex": "rollout-*.jsonl", "dsh": "session*.jsonl.zstd"}


def whole_lines(texts: DataFrame) -> DataFrame:
    """``path, line_no, line`` of whole files (``path, value``)."""
    lines = texts.select("path", F.posexplode(F.split("value", "\n", -1)).alias("n", "line"))
    return lines.select("path", (F.col("n") + 1).cast("bigint").alias("line_no"), "line")


def split_lines(rows: DataFrame) -> DataFrame:
    """``path, line_no, line`` of files read in splits: lines are numbered within a split (``path, start, value`` and
    ``m``, which grows in reading order), then the splits of a file one after the other."""
    sizes = rows.groupBy("path", "start").count()
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("path", "start", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("path", "start").orderBy("m")))
    return numbered.join(firsts, ["path", "start"]).select("path", (F.col("before") + F.col("n")).alias("line_no"), F.col("value").alias("line"))


def scan(sessions: DataFrame, roots: dict[str, str] | None = None, listed: int = LISTED, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``source, path, line_no, raw`` of every line of the sessions' files.

    Lines end at a line feed; one carriage return before it is dropped; lines may have any length. A file that can't
    be decoded gives no line; :func:`unreadable` finds it. ``roots`` says where the stores are, so that many
    sessions needn't be listed on the driver.
    """
    spark = sessions.sparkSession
    reader = lambda **more: spark.read.options(ignoreCorruptFiles=True, ignoreMissingFiles=True, **more)
    path = plain_path(F.col("_metadata.file_path")).alias("path")
    place = [path, F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("m")]
    wanted = sessions.select("source", "path", (F.col("path").endswith(".zstd") | (F.col("bytes") <= whole_bytes)).alias("whole")).distinct()
    few = wanted.limit(listed + 1).collect()
    parts = []
    if len(few) <= listed or not roots:
        few = few if len(few) <= listed else wanted.collect()
        if whole := sorted({r.path for r in few if r.whole}):
            parts.append(whole_lines(reader().text(whole, wholetext=True).select(path, "value")))
        if large := sorted({r.path for r in few if not r.whole}):
            parts.append(split_lines(reader().text(large, lineSep="\n").select(*place)))
    else:
        for name, pattern in PATTERNS.items():
            if (root := os.path.expanduser(roots.get(name, ""))) and exists(spark, root):
                files = {"recursiveFileLookup": True, "pathGlobFilter": pattern}
                own = wanted.where(F.col("source") == name)
                parts.append(whole_lines(reader(**files).text(root, wholetext=True).select(path, "value").join(own.where("whole"), "path", "left_semi")))
                if name != "dsh":
                    parts.append(split_lines(reader(**files).text(root, lineSep="\n").select(*place).join(own.where("not whole"), "path", "left_semi")))
    if not parts:
        return spark.createDataFrame([], "source string, path string, line_no bigint, raw string")
    lines = reduce(DataFrame.unionByName, parts)
    kept = lines.select("path", "line_no", F.regexp_replace("line", "\r$", "").alias("raw")).where("raw <> ''")
    return kept.join(wanted.select("source", "path"), "path").select("source", "path", "line_no", "raw")


def unreadable(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """Sessions with a non-empty file of which no line could be read."""
    return sessions.where("bytes > 0").join(records.select("path").distinct(), "path", "left_anti")


def probe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, status, bytes, sha256`` of each file's decoded content; a broken file has status ERROR."""
    full = [p if "://" in p else os.path.abspath(p) for p in paths]
    listed = spark.createDataFrame([(p,) for p in full], "path string").select(plain_path("path").alias("path"))
    there = [p for p in full if exists(spark, p)]
    empty = spark.createDataFrame([], "path string, bytes bigint, sha256 string")
    if not there:
        return listed.join(empty, "path", "left").select("path", F.lit("ERROR").alias("status"), "bytes", "sha256")
    text = spark.read.options(ignoreCorruptFiles=True, ignoreMissingFiles=True).text(there, wholetext=True)
    got = text.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.octet_length("value").cast("bigint").alias("bytes"), F.sha2("value", 256).alias("sha256"))
    return listed.join(got, "path", "left").select("path", F.when(F.col("sha256").isNull(), "ERROR").otherwise("OK").alias("status"), "bytes", "sha256")
