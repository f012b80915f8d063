"""Rebuilding conversations from message rows.

Every message gets a pointer to its parent: for dsh the message of the preceding ``seq``,
else the preceding message of the session by time. Pointer jumping, log2(depth) rounds of
joins on the message id, then finds each message's root, its place on the path from the
root and the speaker before it, and the paths from roots to leaves. Orphans are messages whose parent is missing, cycles show
by pointers that never end. Joins are on message ids and aggregates are small, so a session
that holds a third of all rows is spread like any other.

Defined results: rows equal in all but ``row_id`` and ``arrived`` are one; a null
session_id belongs to no conversation; null times come first; equal times are ordered by
the smaller row_id; null and blank texts say nothing; roles are read in any case and
spelling of ``ROLES``; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import written

# Spellings of the two speakers.
ROLES = {
    "user": ["user", "human", "usr", "customer", "client", "prompter", "person"],
    "assistant": ["assistant", "ai", "model", "bot", "chatbot", "agent", "gpt", "llm", "aiassistant"],
}
#: A character that shows: no separator, control or format character, and none of the blank letters.
VISIBLE = r"[^\p{Z}\p{C}\x{115f}\x{1160}\x{2800}\x{3164}\x{ffa0}]"


def speaker(role: Column) -> Column:
    """user, assistant or null for a role that doesn't speak."""
    plain = F.regexp_replace(F.lower(role), r"[^\p{L}]", "")
    return F.when(plain.isin(ROLES["user"]), "user").when(plain.isin(ROLES["assistant"]), "assistant")


def distinct_messages(messages: DataFrame, parent: str | None = None) -> DataFrame:
    """``id, session_id, source, seq, time_ms, speaks`` (and ``parent``): one row for each message, under its smallest
    row_id. Texts are told apart by 128 bits of hashes and stay behind; whether they say something is known before."""
    says = F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False))
    keys = ["source", "session_id", "seq", "time_ms", "role"]
    same = [F.col("text").isNull().alias("t0"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2")]
    more = [F.col(parent).cast("bigint").alias("parent")] if parent else []
    narrow = messages.where("session_id is not null").select("row_id", *keys, *same, *more, F.when(says, speaker(F.col("role"))).alias("speaks"))
    one = narrow.groupBy(*keys, "t0", "t1", "t2", "speaks", *(["parent"] if parent else [])).agg(F.min("row_id").alias("id"))
    return one.select("id", "session_id", "source", "seq", "time_ms", "speaks", *(["parent"] if parent else []))


_WALKED = "part int, id bigint, parent bigint, edge string, key string, ord bigint, numbered boolean, head bigint"


def pointers(rows: DataFrame) -> DataFrame:
    """``id, parent, orphan``: for dsh the message of the preceding seq (the first, if several share it), else
    the message before by time. Number 1 begins a conversation; a numbered message other than 1 without such a one is an orphan.

    Rows are range-partitioned by session and place, so one session may fill many partitions; each is
    walked once. The first place of a partition may belong to messages of the one before, which is told by
    one row for each partition.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = F.coalesce(F.col("source") == "dsh", F.lit(False))
    # messages that share a number stay together, those that share a time need not
    places = rows.where(~numbered | F.col("seq").isNotNull()).select(
        F.concat(F.when(numbered, "n").otherwise("t"), "session_id").alias("key"), F.when(numbered, F.col("seq")).otherwise(F.col("time_ms")).alias("ord"), F.when(numbered, F.lit(0)).otherwise(F.col("id")).alias("tie"), "id", numbered.alias("numbered")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key = order = None
        last = head = before = None  # the row before, the first row of this place and of the place before
        places_seen = 0
        step = False
        for b in batches:
            out: list[tuple] = []
            for k, o, i, num in zip(*(b.column(c).to_pylist() for c in ("key", "ord", "id", "numbered"))):
                if k != key or places_seen == 0:
                    places_seen, before, step = places_seen + 1, None, False
                    last, head = None, i
                elif not num or o != order:
                    places_seen += 1
                    before, step, head = head, num and o == order + 1, i
                first = places_seen == 1
                parent = (before if step and o != 1 else None) if num else last
                out.append((part, i, parent, "first" if first else None, k if first else None, o, num, None))
                key, order, last = k, o, i
            yield _table(out)
        if key is not None:
            yield _table([(part, last, None, "last", key, order, num, head)])

    walked = written(places.repartitionByRange(n, "key", "ord", "tie").sortWithinPartitions("key", "ord", "id").select("key", "ord", "id", "numbered").mapInArrow(run, _WALKED))
    # one row for each partition, whatever the data's size
    ends = sorted(walked.where("edge = 'last'").select("part", "id", "key", "ord", "numbered", "head").collect(), key=lambda r: r.part)
    filled = [r.part for r in ends]
    previous = [(q, r.key, r.ord, r.id, r.head) for r, q in zip(ends, filled[1:])]
    before = F.broadcast(spark.createDataFrame(previous, "part int, b_key string, b_ord bigint, b_last bigint, b_head bigint"))
    inner = walked.where("edge is null or edge = 'first'").join(before, "part", "left")
    crossed = F.when(F.col("edge").isNotNull() & (F.col("key") == F.col("b_key")), F.when(~F.col("numbered"), F.col("b_last")).when((F.col("ord") == F.col("b_ord") + 1) & (F.col("ord") != 1), F.col("b_head")))
    parent = F.coalesce("parent", crossed)
    linked = inner.select("id", parent.alias("parent"), (F.col("numbered") & (F.col("ord") != 1) & parent.isNull()).alias("orphan"))
    lost = rows.where(numbered & F.col("seq").isNull()).select("id", F.lit(None).cast("bigint").alias("parent"), F.lit(True).alias("orphan"))
    return linked.unionByName(lost)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["part", "id", "parent", "edge", "key", "ord", "numbered", "head"])


def checked(nodes: DataFrame) -> DataFrame:
    """``id, speaks, parent, orphan`` of nodes with given parents: a parent that is no node makes an orphan."""
    there = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    found = nodes.join(there, "parent", "left")
    return found.select("id", "speaks", F.when(F.col("there"), F.col("parent")).alias("parent"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("orphan"))


def jump(nodes: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer jumping over ``id, speaks, parent, orphan``: ``id, root, depth, spoke_before, orphan, in_cycle``, and for
    each round k the ancestors ``id, up`` at 2^k steps.

    ``spoke_before`` is the speaker of the nearest speaking message above; an orphan counts as a root. Ids must be
    unique. Each round doubles the steps; rows that have reached their root are written once and only looked up
    from then on.
    """
    code = F.when(F.col("speaks") == "user", 1).when(F.col("speaks") == "assistant", 2).otherwise(0).cast("byte")
    zero = F.lit(0).cast("byte")
    state = written(nodes.select("id", code.alias("speaks"), F.col("parent").alias("ptr"), zero.alias("above"), "orphan", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent", "id").alias("root")))
    total = max(2, state.count())
    done = [state.where("ptr is null")]
    state, ups = state.where("ptr is not null"), []
    for _ in range(min(most_rounds, total.bit_length() + 2)):
        if state.isEmpty():
            break
        ups.append(state.select("id", F.col("ptr").alias("up")))
        known = reduce(DataFrame.unionByName, [*done, state])
        p = known.select(F.col("id").alias("ptr"), F.when(F.col("speaks") != 0, F.col("speaks")).otherwise(F.col("above")).alias("p_above"), F.col("ptr").isNull().alias("p_ended"), F.col("depth").alias("p_depth"), F.col("root").alias("p_root"))
        # an unfinished row's root so far is what it points to
        moved = written(state.drop("root").join(p, "ptr").select(
            "id", "speaks", F.when(~F.col("p_ended"), F.col("p_root")).alias("ptr"), F.when(F.col("above") != 0, F.col("above")).otherwise(F.col("p_above")).alias("above"), "orphan", (F.col("depth") + F.col("p_depth")).alias("depth"), F.col("p_root").alias("root")
        ))
        done.append(moved.where("ptr is null"))
        state = moved.where("ptr is not null")
    out = reduce(DataFrame.unionByName, [*done, state])
    spoke = F.when(F.col("above") == 1, "user").when(F.col("above") == 2, "assistant")
    placed = out.select("id", F.when(F.col("ptr").isNull(), F.col("root")).alias("root"), F.col("depth").cast("bigint").alias("depth"), spoke.alias("spoke_before"), "orphan", F.col("ptr").isNotNull().alias("in_cycle"))
    return placed, ups


def root_to_leaf(placed: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """``leaf, id``: every message on the path from its root to each leaf, one path a leaf.

    The ancestors of a leaf at all distances are the sums of steps of 2^k, each taken or not, so the rounds'
    pointers give every one of them once, in as many joins. Cycles have no leaf of theirs.
    """
    whole = placed.where("not in_cycle").select("id")
    parents = ups[0].select(F.col("up").alias("id")).distinct() if ups else whole.limit(0)
    rows = whole.join(parents, "id", "left_anti").select(F.col("id").alias("leaf"), "id")
    for up in reversed(ups):
        rows = written(rows.unionByName(rows.join(up, "id").select("leaf", F.col("up").alias("id"))))
    return rows


def rebuild(messages: DataFrame, parent: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Every distinct message with its place: ``id, session_id, source, seq, speaks, root, position,
    spoke_before, orphan, in_cycle``, and the rounds' pointers. ``position`` counts from 0 at the root. ``parent`` names a
    column with the row_id of each message's parent; without it the order tells the parents."""
    rows = written(distinct_messages(messages, parent))
    nodes = checked(rows.select("id", "speaks", "parent")) if parent else rows.select("id", "speaks").join(pointers(rows), "id")
    placed, ups = jump(nodes)
    places = placed.withColumnRenamed("depth", "position")
    return rows.select("id", "session_id", "source", "seq", "speaks").join(places, "id"), ups


def judge(placed: DataFrame) -> DataFrame:
    """``session_id, defects``: an array of what is wrong with each conversation, empty if it is whole."""
    says = F.col("speaks").isNotNull()
    facts = placed.groupBy("session_id").agg(
        F.coalesce(F.max(F.col("speaks") == "user"), F.lit(False)).alias("u"),
        F.coalesce(F.max(F.col("speaks") == "assistant"), F.lit(False)).alias("a"),
        F.max(says & F.col("spoke_before").isNull() & (F.col("speaks") == "assistant")).alias("starts"),
        F.max(says & (F.col("speaks") == "user") & F.col("spoke_before").eqNullSafe("user")).alias("between"),
        F.max_by("speaks", F.when(says, F.struct("position", "id"))).alias("last"),
        F.max(F.col("orphan") | F.col("in_cycle")).alias("torn"),
        F.max((F.col("source") == "dsh") & F.col("seq").isNull()).alias("unnumbered"),
        F.count(F.when(F.col("source") == "dsh", F.col("id"))).alias("n"),
        F.max(F.when(F.col("source") == "dsh", F.col("seq"))).alias("top"),
    )
    defects = {
        "no_user": ~F.col("u"),
        "no_assistant": ~F.col("a"),
        "assistant_first": F.col("starts"),
        "unanswered": F.col("between") | (F.col("last") == "user"),
        "torn": F.col("torn") | F.col("unnumbered"),
        "numbered_twice": (F.col("n") > 0) & (F.col("top") != F.col("n")) & ~F.col("torn"),
    }
    return facts.select("session_id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in defects.items()])).alias("defects"))


def conversations(messages: DataFrame) -> DataFrame:
    """``session_id, position, speaker, text`` of the speaking messages of whole conversations, numbered in order."""
    placed = written(rebuild(messages)[0])
    good = judge(placed).where(F.size("defects") == 0).select("session_id")
    spoken = placed.where("speaks is not null").join(good, "session_id", "left_semi").select("id", "session_id", "position", F.col("speaks").alias("speaker"))
    return spoken.join(messages.select(F.col("row_id").alias("id"), "text"), "id").select("session_id", "position", "speaker", "text")


def conversation_paths(messages: DataFrame, parent: str | None = None) -> DataFrame:
    """``session_id, leaf, position, speaker, text``: one ordered conversation for each leaf of the message trees,
    from its root on. Orphans begin paths of their own; messages in cycles have none; messages that say nothing
    keep their position and a null speaker."""
    placed, ups = rebuild(messages, parent)
    placed = written(placed)
    paths = root_to_leaf(placed, ups)
    rows = paths.join(placed.select("id", "session_id", "position", F.col("speaks").alias("speaker")), "id")
    return rows.join(messages.select(F.col("row_id").alias("id"), "text"), "id").select("session_id", "leaf", "position", "speaker", "text")


def find_broken(messages: DataFrame) -> DataFrame:
    """``session_id`` of the conversations to drop."""
    return judge(rebuild(messages)[0]).where(F.size("defects") > 0).select("session_id")
