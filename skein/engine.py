"""One object for a set of stores: discovery, parsing (once) and the commands over it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.fold import fold_transcripts, fold_turns
from skein.plans import commands
from skein.session import written, ship
from skein.sources.decode import decode
from skein.sources.stores import ROOTS, discover, scan, unreadable


class Engine:
    def __init__(self, spark: SparkSession, roots: dict[str, str] | None = None, sources: str | None = None, limit: int = 0):
        ship(spark)
        self.spark, self.roots, self.names, self.limit = spark, roots, sources, limit

    @cached_property
    def sessions(self) -> DataFrame:
        found = discover(self.spark, self.roots, self.names)
        return commands.newest(found, self.limit) if self.limit > 0 else found

    @cached_property
    def records(self) -> DataFrame:
        return scan(self.sessions, ROOTS | (self.roots or {}))

    @cached_property
    def decoded(self) -> DataFrame:
        return written(decode(self.records))

    @cached_property
    def turns(self) -> DataFrame:
        return written(fold_turns(self.decoded))

    @cached_property
    def transcripts(self) -> DataFrame:
        return fold_transcripts(self.decoded, self.turns, self.sessions)

    def register_views(self) -> None:
        """Temporary views ``sessions``, ``records``, ``turns``, ``blocks`` and ``transcripts`` for ``spark.sql``."""
        blocks = self.turns.select("source", "path", "turn_idx", "role", "ts", F.posexplode("blocks").alias("pos", "b")).select("source", "path", "turn_idx", "role", "ts", "pos", "b.*")
        for name, df in (("sessions", self.sessions), ("records", self.records), ("turns", self.turns), ("blocks", blocks), ("transcripts", self.transcripts)):
            df.createOrReplaceTempView(name)

    def only(self, sessions: DataFrame) -> "Engine":
        """The same engine over some of the sessions."""
        other = Engine(self.spark, self.roots, self.names)
        other.__dict__["sessions"] = sessions
        return other

    def unreadable(self) -> DataFrame:
        return unreadable(self.sessions, self.records)

    def narrowed(self, query: str, prefilter: bool = True) -> tuple["Engine", dict[str, int]]:
        """The engine over sessions of which some raw line holds the query, and how many were ``scanned`` (are parsed),
        ``skipped`` (hold it nowhere) and ``unreadable``. The filter reads lines without parsing them; it misses text
        that is escaped in the file, so without ``prefilter`` all readable sessions are kept."""
        total, broken = self.sessions.count(), self.unreadable().count()
        if not prefilter:
            return self, {"scanned": total - broken, "skipped": 0, "unreadable": broken}
        hits = written(commands.containing(self.records, query))
        some = self.only(written(self.sessions.join(hits, "path", "left_semi")))
        n = some.sessions.count()
        return some, {"scanned": n, "skipped": total - n - broken, "unreadable": broken}
