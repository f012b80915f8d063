"""Mixing sources to target weights.

The size of each source is counted in tokens, with every distinct text counted once.
Temperature mixing raises the sources' shares to an exponent, which a bisection moves
until either the entropy of the weights reaches a target or a source would have to be
repeated more often than allowed; given target shares take the place of the exponentiated
ones. The weights become whole epochs and one partial epoch of each source, the partial one
cut from a random permutation of its texts in blocks.

Defined results: source names are read without regard to case and outer blanks; documents
of a null or unlisted source, and null or empty texts, take no part; texts repeated within
a source are used once an epoch; a target whose source has no text gets nothing, and the
other targets share the rest as far as their repetition limits go.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.packing import count_tokens
from skein.session import cut, written

#: The permutation of a source is ranked and cut in blocks, in parallel: at least so many, and so many that a block of
#: a source that has every text holds about so many of them.
LEAST_BLOCKS, BLOCK_ROWS = 256, 100_000
#: Passes over the permutation that fill the partial epoch.
PASSES = 2
MOST_EXPONENT = 1024.0


def temperature_weights(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised shares raised to an exponent: 1 leaves them, 0 makes them equal."""
    top = max(sizes.values(), default=0)
    raised = {s: (v / top) ** exponent for s, v in sizes.items() if v > 0}
    total = sum(raised.values())
    return {s: raised.get(s, 0.0) / total if total else 0.0 for s in sizes}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def find_exponent(sizes: dict[str, float], target_entropy: float | None = None, max_repeats: dict[str, int] | None = None, budget: float | None = None) -> float:
    """The exponent that meets the entropy, or the lowest one up to 1 under which no source has to be
    repeated beyond its limit for ``budget`` tokens. Entropy falls and small sources shrink as it grows; an entropy below
    that of the sources' own shares takes an exponent above 1, looked for up to ``MOST_EXPONENT``."""
    lo, hi = 0.0, 1.0
    if target_entropy is not None:
        while hi < MOST_EXPONENT and entropy(temperature_weights(sizes, hi)) > target_entropy:
            hi *= 2

    def fits(a: float) -> bool:
        w = temperature_weights(sizes, a)
        if target_entropy is not None and entropy(w) > target_entropy:
            return False
        return all(w[s] * (budget or sum(sizes.values())) <= sizes[s] * max_repeats.get(s, 1) * (1 + 1e-12) for s in sizes if sizes[s] > 0) if max_repeats else True

    if fits(lo):
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def allot(sizes: dict[str, int], shares: dict[str, float], max_repeats: dict[str, int], budget: int | None = None) -> dict[str, int]:
    """Tokens wanted of each source. Without a budget the largest one is taken under which every
    share can be met exactly; with a larger budget the sources at their limit give what they have
    and the others take over the rest in proportion."""
    room = {s: sizes.get(s, 0) * max_repeats.get(s, 1) for s in shares}
    live = {s: w for s, w in shares.items() if w > 0 and room[s] > 0}
    if not live:
        return dict.fromkeys(shares, 0)
    if budget is None:
        scale = sum(live.values())
        budget = math.floor(min(room[s] * scale / w for s, w in live.items()))
    wanted: dict[str, int] = dict.fromkeys(shares, 0)
    rest = float(budget)
    while live and rest > 0:
        scale = sum(live.values())
        full = [s for s, w in live.items() if rest * w / scale > room[s] - 1]
        if not full:
            for s, w in live.items():
                wanted[s] = math.floor(rest * w / scale)
            break
        for s in full:
            wanted[s] = room[s]
            rest -= room[s]
            del live[s]
    return wanted


def _gaps(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, gap``: tokens that the partial epoch still lacks; one row a source."""
    taken = rows.where("used").groupBy("source").agg(F.sum("tokens").alias("taken"))
    return plan.join(taken, "source", "left").select("source", (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("gap"))


def _take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Marks unused texts as used that end within the gap, in the permutation's order, counting only texts
    that aren't larger than the gap themselves. Sums run inside blocks, then over one row a block."""
    open_ = rows.join(F.broadcast(_gaps(rows, plan)), "source").withColumn("size", F.when(~F.col("used") & (F.col("tokens") <= F.col("gap")), F.col("tokens")).otherwise(0))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = open_.groupBy("source", "block").agg(F.sum("size").alias("n")).select("source", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    inside = F.sum("size").over(Window.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = open_.withColumn("end", inside).join(starts, ["source", "block"])
    return ended.select("source", "block", "key", "doc_id", "tokens", (F.col("used") | ((F.col("size") > 0) & (F.col("start") + F.col("end") <= F.col("gap")))).alias("used"))


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, target_entropy: float | None = None, seed: int = 17, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(selection, report)``.

    selection: ``source, doc_id, tokens, times`` - how often each document is used. report:
    ``source, target_share, share, tokens, available, most_times, max_repeats, exponent, entropy``, the last being that of
    the shares reached. The targets' shares are used as given; where ``target_entropy`` is set, they come from the
    exponent instead, which is null else. Each source stays below
    its part of the budget by less than the smallest text it doesn't use in its last epoch.
    """
    spark = documents.sparkSession
    # one row a source: a configuration, not data
    wanted_rows = [(r.source.strip().lower(), float(r.target_share or 0), int(r.max_repeats or 1)) for r in targets.collect() if r.source is not None]
    shares, limits = {s: w for s, w, _ in wanted_rows}, {s: m for s, _, m in wanted_rows}
    named = documents.withColumn("__source", F.lower(F.trim("source"))).where(F.col("__source").isin(list(shares)) & F.col("text").isNotNull())
    sized = written(count_tokens(named.select("doc_id", F.col("__source").alias("source"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), "text"), ["doc_id", "source", "h1", "h2"], tokenizer).where("tokens > 0"))
    once = cut(sized.groupBy("source", "h1", "h2", "tokens").agg(F.min("doc_id").alias("doc_id")).withColumn("key", F.xxhash64(F.lit(seed), "h1", "h2")))
    blocks = max(LEAST_BLOCKS, once.count() // BLOCK_ROWS)
    blocked = once.withColumn("block", F.pmod(F.shiftright("key", 24), F.lit(blocks)).cast("int"))
    block_sizes = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    sizes = dict.fromkeys(shares, 0) | {r.source: r.t for r in block_sizes.groupBy("source").agg(F.sum("block_tokens").alias("t")).collect()}
    exponent = None
    if target_entropy is not None:
        own = {s: float(v) for s, v in sizes.items()}
        exponent = find_exponent(own, target_entropy, limits, budget)
        shares = temperature_weights(own, exponent)
    wanted = allot(sizes, shares, limits, budget)
    plan = spark.createDataFrame(
        [(s, sizes[s], wanted[s] // sizes[s] if sizes[s] else 0, wanted[s] % sizes[s] if sizes[s] else 0) for s in sorted(shares)] or [("", 0, 0, 0)], "source string, available bigint, epochs bigint, rest bigint"
    )
    # the partial epoch is cut from the permutation in the order (block, key). A text that doesn't fit any more
    # is skipped, which the second pass makes up for with later, smaller texts, and the largest fitting text at last
    rows = blocked.select("source", "block", "key", "doc_id", "tokens", F.lit(False).alias("used"))
    for _ in range(PASSES):
        rows = cut(_take(rows, plan))
    left = F.broadcast(_gaps(rows, plan))
    fits = rows.join(left, "source").where(~F.col("used") & (F.col("tokens") <= F.col("gap")))
    filler = F.broadcast(fits.groupBy("source").agg(F.max_by("doc_id", F.struct("tokens", -F.col("doc_id"))).alias("filler")))
    used = F.col("used") | F.coalesce(F.col("doc_id") == F.col("filler"), F.lit(False))
    chosen = rows.join(F.broadcast(plan.select("source", "epochs")), "source").join(filler, "source", "left").withColumn("times", F.col("epochs") + used.cast("bigint"))
    selection = chosen.where("times > 0").select("source", "doc_id", "tokens", "times")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times"))
    config = spark.createDataFrame([(s, shares[s], limits[s], sizes[s]) for s in sorted(shares)] or [("", 0.0, 1, 0)], "source string, target_share double, max_repeats int, available bigint")
    report = config.join(F.broadcast(got), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy())  # one row a source
    report = report.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("share"), "tokens", "available", F.coalesce("most_times", F.lit(0)).alias("most_times"), "max_repeats")
    spread_ = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share")).otherwise(0.0)).over(Window.partitionBy())
    report = report.withColumns({"exponent": F.lit(exponent).cast("double"), "entropy": spread_})
    return selection, report


def mixing_checks(selection: DataFrame, report: DataFrame, documents: DataFrame) -> DataFrame:
    """``source`` and what must hold for it: ``share_met`` (but for one text, whose tokens are no more than its bytes), ``within_repeats``, and ``one_text_once``:
    no text of the source is selected under two documents."""
    texts = selection.join(documents.select("doc_id", F.md5("text").alias("h")), "doc_id").groupBy("source", "h").count().groupBy("source").agg((F.max("count") == 1).alias("one_text_once"))
    one = documents.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("largest")).first()["largest"]
    rows = report.join(texts, "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    return rows.select("source", (F.abs(F.col("share") - F.col("target_share")) * F.col("total") <= one).alias("share_met"), (F.col("most_times") <= F.col("max_repeats")).alias("within_repeats"), F.coalesce("one_text_once", F.lit(True)).alias("one_text_once"))
