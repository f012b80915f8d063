"""Text and time functions as Column expressions, evaluated inside the JVM.

"Blank" and "white space" mean Unicode white space; lengths count code points unless a
name says bytes. Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
TITLE_CHARS, SUMMARY_CHARS, LONG_CHARS = 100, 200, 2000
#: Context of a search hit on either side, in bytes.
CONTEXT_BYTES = 80


def nonblank(c: Column) -> Column:
    """Has a character that is no white space; false for null."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cut_to(c: Column, limit: int, kept: int, mark: str = ELLIPSIS) -> Column:
    """The first ``kept`` code points and a mark, where there are more than ``limit``."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(kept)), F.lit(mark))).otherwise(c)


def one_line(c: Column) -> Column:
    """A title: one line of at most 100 code points, the mark included."""
    return cut_to(collapse(c), TITLE_CHARS, TITLE_CHARS - 1)


def summary(c: Column) -> Column:
    """A summary: one line of at most 200 code points, then the mark."""
    return cut_to(collapse(c), SUMMARY_CHARS, SUMMARY_CHARS)


def truncate(c: Column, n: int) -> Column:
    return cut_to(collapse(c), n, n - 1)


def truncate_lines(c: Column, n: int = LONG_CHARS) -> Column:
    return cut_to(c, n, n, "\n… (truncated)")


def first_line(c: Column) -> Column:
    return trim_white(F.split_part(trim_white(c), F.lit("\n"), F.lit(1)))


def claude_cwd(slug: Column) -> Column:
    """Working directory that a folder name stands for; empty if it doesn't begin with a dash."""
    return F.when(F.startswith(slug, F.lit("-")), F.replace(slug, F.lit("-"), F.lit("/"))).otherwise("")


def dsh_cwd(slug: Column) -> Column:
    inner = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(inner == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(F.translate(inner, "~-", "//"), "^/+", "")))


def codex_id(name: Column) -> Column:
    """Session id in a rollout file's name: what follows its five dashed date parts."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.jsonl$", ""), "^rollout-", "")
    parts = F.split(stem, "-")
    return F.when(F.size(parts) > 5, F.array_join(F.slice(parts, F.lit(6), F.size(parts)), "-")).otherwise(stem)


def short_id(c: Column, n_bytes: int = 8) -> Column:
    """The first bytes of an id without its ``session-`` prefix."""
    plain = F.encode(F.regexp_replace(c, "^session-", ""), "UTF-8")
    return F.make_valid_utf8(F.substring(plain, 1, n_bytes).cast("string"))


def format_time(c: Column) -> Column:
    """Minutes in the session's time zone; a dash for an unknown time."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("-"))


def parse_time(c: Column) -> Column:
    """An RFC 3339 text with its zone, else null."""
    shape = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:\d\d)$"
    return F.when(c.rlike(shape), F.try_to_timestamp(F.replace(c, F.lit(","), F.lit("."))))


def from_millis(c: Column) -> Column:
    """Unix milliseconds as a time; null for zero, negative and years beyond 9999."""
    return F.when((c > 0) & (c < 253_402_300_800_000), F.timestamp_millis(F.when(c < 253_402_300_800_000, c)))


def byte_index(text: Column, needle: str) -> Column:
    """Byte offset of the first match in the lower-cased text, null without one. An empty needle is at 0."""
    low = F.lower(text)
    at = F.instr(low, needle.lower()) if needle else F.when(text.isNotNull(), F.lit(1))
    return F.when(at > 0, F.octet_length(F.left(low, at - 1)))


def snippet(text: Column, at: Column, match_bytes: int, context: int = CONTEXT_BYTES) -> Column:
    """One line around a match, cut by bytes (a broken character becomes U+FFFD), marked where it is cut."""
    around = context if context > 0 else CONTEXT_BYTES
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    # lower-casing may change lengths, so the start is kept inside the text
    start = F.greatest(F.lit(0), F.least(at - around, size))
    end = F.least(at + match_bytes + around, size)
    body = collapse(F.make_valid_utf8(F.substring(raw, start + 1, F.greatest(end - start, F.lit(0))).cast("string")))
    return F.concat(F.when(start > 0, ELLIPSIS).otherwise(""), body, F.when(end < size, ELLIPSIS).otherwise(""))


# --- content blocks -----------------------------------------------------------------------


def turn_text(blocks: Column) -> Column:
    """The non-blank text blocks, one a line."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["kind"] == "text") & nonblank(b["text"])), lambda b: b["text"]), "\n")


def all_text(blocks: Column) -> Column:
    """Everything that can be searched: texts, thoughts, tool calls with their input, tool results."""

    def shown(b: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        return F.when(b["kind"] == "tool_use", F.concat(F.coalesce(b["name"], F.lit("")), F.lit(" "), F.coalesce(b["input"], F.lit("")))).otherwise(text)

    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"].isin("text", "thinking", "tool_use", "tool_result")), shown), "\n")


def hidden_kinds(full: bool, no_tools: bool) -> set[str]:
    """Kinds of blocks that a view leaves out."""
    return (set() if full else {"thinking", "tool_result"}) | ({"tool_use", "tool_result"} if no_tools else set())


def visible_blocks(blocks: Column, full: bool, no_tools: bool) -> Column:
    """The blocks that a plain (or full) view shows."""
    hidden = sorted(hidden_kinds(full, no_tools))
    return F.filter(blocks, lambda b: ~b["kind"].isin(hidden)) if hidden else blocks


def usage_total(usage: Column) -> Column:
    return sum((F.coalesce(usage[k], F.lit(0)) for k in ("output", "cache_read", "cache_write", "reasoning")), F.coalesce(usage["input"], F.lit(0)))
