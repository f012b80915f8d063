"""Formatting on the driver, of single values that are about to be shown."""

from __future__ import annotations


def format_count(n: int) -> str:
    if n >= 1_000_000:
        return f"{n / 1e6:.1f}M"
    return f"{n / 1e3:.1f}k" if n >= 1000 else str(n)


def human_bytes(n: int) -> str:
    if n < 1024:
        return f"{n}B"
    size = float(n)
    for unit in "KMGTPE":
        size /= 1024
        if size < 1024 or unit == "E":
            return f"{size:.1f}{unit}"
    raise AssertionError


def format_duration(seconds: float) -> str:
    """Whole seconds as hours, minutes and seconds, without leading zero parts."""
    s = int(seconds + 0.5)
    h, m, s = s // 3600, s // 60 % 60, s % 60
    return f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s"
