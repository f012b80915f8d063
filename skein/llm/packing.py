"""Filling fixed-capacity containers: shortest-pack-first over the histogram of lengths.

Lengths are counted in tokens; only the histogram (one row for each length up to the
capacity, so its size is bounded by the capacity) comes to the driver. There, lengths are
placed longest first: each goes to the open packs with the least room that still fits,
whole groups of equal packs at a time. The patterns are then joined back to the documents
by their rank within their length.

Defined results: a document longer than the capacity, and only such a one, is split into
full pieces and a rest; null and empty texts have no tokens and get no place; repeated
documents are placed one by one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut, spread, written

#: Default vocabulary; any file of the installed public tokenizers may be named instead.
TOKENIZER = "byte_bpe_50k.json"
TOKENIZER_DIR = "/opt/tokenizers"
#: Bits for the rank of a piece within its length, beside those for the length.
RANK_BITS = 44


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def count_tokens(documents: DataFrame, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """The kept columns and ``tokens`` of each document's whole text (0 for null)."""
    path = tokenizer or f"{TOKENIZER_DIR}/{TOKENIZER}"
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            texts = [x or "" for x in b.column("__text").to_pylist()]
            sizes: list[int] = []
            for i in range(0, len(texts), 64):
                sizes += [len(e.ids) for e in t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sizes, pa.int64())], [*keep, "tokens"])

    return spread(documents.select(*keep, F.col("text").alias("__text"))).mapInArrow(run, f"{fields}, tokens bigint")


def pack_histogram(lengths: dict[int, int], capacity: int, shortest: bool = True) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used: ``[((lengths, longest first), times), ...]``.

    Lengths are placed longest first. Packs of one content are a group with a count, and a
    length goes to as many packs of a group at once as there are items. ``shortest`` takes
    the group with the most room (shortest-pack-first), else the one with the least room that
    fits. Each step uses up the items of a length or a group, so there are about as many
    patterns as distinct lengths.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # distinct rooms of open packs, ascending

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = {}
            bisect.insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + times

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left > 0:
            k = len(rooms) - 1 if shortest else bisect.bisect_left(rooms, length)
            if k < 0 or k == len(rooms) or rooms[k] < length:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    put((length,) * per, full, capacity - per * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            room = rooms[k]
            pattern, times = by_room[room].popitem()
            use = min(times, left)
            put(pattern + (length,), use, room - length)
            left -= use
            if times > use:
                by_room[room][pattern] = times - use
            elif not by_room[room]:
                del by_room[room]
                rooms.remove(room)
    groups: dict[tuple[int, ...], int] = {}
    for room in by_room.values():
        for pattern, times in room.items():
            key = tuple(sorted(pattern, reverse=True))
            groups[key] = groups.get(key, 0) + times
    return sorted(groups.items(), reverse=True)


def pack(documents: DataFrame, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, tokens, container`` : every piece of a document with tokens and its container.

    ``piece`` is 0 for a whole document; a document beyond the capacity has pieces 0, 1, ...
    """
    spark = documents.sparkSession
    sized = written(count_tokens(documents, ["doc_id"], tokenizer).where("tokens > 0"))
    over = F.floor((F.col("tokens") - 1) / capacity)
    pieces = sized.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("bigint"), over), lambda i: F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - i * capacity))).alias("piece", "size"))
    # documents of one length are numbered within hashed lots, so that a length that many share isn't one task
    lots = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lotted = cut(pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lots)).cast("int")))
    counts = lotted.groupBy("size", "lot").count()
    # at most capacity rows
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    # both are computed from the histogram alone; the one that needs fewer containers is used
    patterns = min((pack_histogram(histogram, capacity, shortest) for shortest in (True, False)), key=lambda p: sum(n for _, n in p))
    # places: for each length, runs of containers that hold it k times each
    rows, first_container, taken = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in patterns:
        for length in dict.fromkeys(pattern):
            per = pattern.count(length)
            rows.append((length, taken[length], taken[length] + per * times, first_container, per))
            taken[length] += per * times
        first_container += times
    start = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = lotted.withColumn("in_lot", F.row_number().over(Window.partitionBy("size", "lot").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(start.select("size", "lot", "start"), ["size", "lot"]).withColumn("rank", F.col("start") + F.col("in_lot")).select("doc_id", "piece", "size", "rank")
    # the runs of a length are disjoint and sorted: a rank's run is found by binary search, for whole batches at once
    sizes = np.array(sorted(histogram), dtype=np.int64)
    rows.sort()
    table_ = np.array(rows, dtype=np.int64).reshape(-1, 5)
    keys = np.searchsorted(sizes, table_[:, 0]) << RANK_BITS | table_[:, 1]
    sent = spark.sparkContext.broadcast((sizes, keys, table_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, keys, table_ = sent.value
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            own = table_[np.searchsorted(keys, np.searchsorted(sizes, size) << RANK_BITS | rank, side="right") - 1] if len(keys) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("size"), pa.array(own[:, 3] + (rank - own[:, 1]) // own[:, 4])], ["doc_id", "piece", "tokens", "container"])

    return ranked.mapInArrow(run, "doc_id bigint, piece int, tokens bigint, container bigint")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """``containers, tokens, fill`` of a packing."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))


def packing_checks(documents: DataFrame, packed: DataFrame, capacity: int) -> DataFrame:
    """One row of what must hold for a packing: ``documents`` with text that are placed, ``missing`` ones, ``overfull``
    containers, ``twice`` placed pieces, ``needlessly_split`` documents and ``gaps`` in the containers' numbers."""
    placed = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece").alias("kinds"), F.sum("tokens").alias("tokens"))
    wanted = documents.where(F.coalesce(F.col("text"), F.lit("")) != "").select("doc_id")
    both = wanted.join(placed, "doc_id", "full")
    by_doc = both.agg(
        F.count("pieces").alias("documents"), F.count_if(F.col("pieces").isNull()).alias("missing"), F.count_if(F.col("pieces") != F.col("kinds")).alias("twice"),
        F.count_if(F.col("pieces") != F.ceil(F.col("tokens") / capacity)).alias("needlessly_split"),
    )
    fill = packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > capacity).alias("overfull"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count("*")).alias("gaps"))
    one = F.lit(1).alias("one")  # one row each
    return by_doc.withColumn("one", one).join(fill.withColumn("one", one), "one").drop("one")
