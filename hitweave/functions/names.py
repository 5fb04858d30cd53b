"""Column names that don't clash."""

from __future__ import annotations


def free_name(wanted: str, taken) -> str:
    """wanted, or wanted with as many underscores as make it differ from taken (case doesn't count, as in Spark)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted
