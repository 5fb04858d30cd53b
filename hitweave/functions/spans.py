"""Sets of intervals, asked for overlaps."""

from __future__ import annotations

from bisect import bisect_left


class Taken:
    """Intervals (a, b), of which only those are kept that can decide whether another one overlaps: by rising start, each
    with a later end than all before."""

    def __init__(self):
        self.a: list[int] = []
        self.b: list[int] = []

    def meets(self, s: int, e: int, buffer: int) -> bool:
        """Whether an interval begins before e and ends behind s, by more than buffer."""
        i = bisect_left(self.a, e - buffer)
        return i > 0 and self.b[i - 1] > s + buffer

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.a, a)
        if (i and self.b[i - 1] >= b) or (i < len(self.a) and self.a[i] == a and self.b[i] >= b):
            return
        j = i
        while j < len(self.b) and self.b[j] <= b:
            j += 1
        self.a[i:j], self.b[i:j] = [a], [b]
