"""Cells that pack several values behind inconsistent delimiters, split in the Arrow buffers of a batch.

All cells of a batch lie end to end in one byte buffer. Masks over its bytes (escapes, quote parity, ids, delimiters)
are made by numpy for all cells at once; the runs of bytes that no delimiter covers are the values, and their lengths
and counts are the offsets of the list array. No cell is looked at in Python by itself.

How a cell is read
  * A delimiter counts outside of quotes and not behind a backslash. White space counts as one only beside an id or a
    quoted value.
  * A soft delimiter between words whose next word starts in lower case belongs to a name ("Relay, drift type"), if the
    value it lies in, back to the last other delimiter, starts otherwise; values that all start in lower case are apart.
  * Quotes with an odd count in the cell are characters without meaning that are only trimmed off.
  * A cell that is quoted as a whole and holds an id is a list: its quotes are taken off and it is read again.
  * Values lose white space, quotes around them, backslashes and the doubling of quotes; a cell loses its brackets.
  * Values that are empty or say "nothing" (NOTHING) are no values; repeated values stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 0x1F
#: Spellings of "nothing", in lower case.
NOTHING = ("-", "--", ".", "?", "na", "n/a", "n.a.", "n.a", "nan", "none", "null", "nil")
DELIMITERS = (";", ",", "|", "/", "+", "¦", "；", "，", "、", "<br>", "<br/>", "\n", "\r", "\t")
#: Delimiters that may stand inside of a name.
SOFT = (";", ",", "|", "/")


@dataclass(frozen=True)
class Packing:
    """id_form: template of the ids, 0 standing for any digit and other characters for themselves; id_prefix: what may
    stand before an id and stays part of it."""

    id_form: str = "K00000"
    id_prefix: str = "ko:"
    delimiters: tuple[str, ...] = DELIMITERS
    soft: tuple[str, ...] = SOFT
    nothing: tuple[str, ...] = NOTHING


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_WS = _table(b" \t\n\r")
_DIGIT = _table(b"0123456789")
_LOWER = _table(bytes(range(97, 123)))
_ALNUM = _DIGIT | _LOWER | _table(bytes(range(65, 91))) | _table(bytes(range(128, 256)))


def _shift(m: np.ndarray, k: int) -> np.ndarray:
    """m[i + k], false beyond the ends."""
    out = np.zeros_like(m)
    if k > 0:
        out[:-k] = m[k:]
    elif k < 0:
        out[-k:] = m[:k]
    else:
        out[:] = m
    return out


def _find(b: np.ndarray, word: bytes) -> np.ndarray:
    """True at the first byte of each occurrence."""
    m = b == word[0]
    for k, c in enumerate(word[1:], 1):
        m &= _shift(b == c, k)
    return m


def _cover(first: np.ndarray, length: int) -> np.ndarray:
    m = first.copy()
    for k in range(1, length):
        m |= _shift(first, -k)
    return m


def _escaped(b: np.ndarray) -> np.ndarray:
    """Bytes behind an odd run of backslashes."""
    slash = b == 0x5C
    if not slash.any():
        return slash
    i = np.arange(len(b))
    last = np.maximum.accumulate(np.where(~slash, i, -1))
    run = np.where(slash, i - last, 0)
    return _shift(run % 2 == 1, -1)


class _Scan:
    """The masks of one buffer of cells, each ended by END."""

    def __init__(self, cells: pa.Array, p: Packing):
        joined = pc.binary_join_element_wise(cells, pa.scalar(""), pa.scalar(chr(END)))
        size = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        # the buffer as it lies, cut to this array's share
        o = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
        b = self.b = np.frombuffer(joined.buffers()[2], np.uint8)[o[0] : o[-1]] if len(joined) and o[-1] > o[0] else np.zeros(0, np.uint8)
        n = len(b)
        self.cell = np.repeat(np.arange(len(cells)), size)
        self.end = np.zeros(n, dtype=bool)
        self.end[self.stop - 1] = True
        self.ws = _WS[b] | _cover(_find(b, " ".encode()), 2)
        self.escaped = _escaped(b)
        self.hits = [(d, _find(b, d.encode())) for d in p.delimiters]
        self.word = _ALNUM[b] & ~self.ws
        for d, hit in self.hits:
            self.word &= ~_cover(hit, len(d.encode()))
        i = np.arange(n)
        solid = ~self.ws
        before = np.maximum.accumulate(np.where(solid, i, -1))
        after = np.minimum.accumulate(np.where(solid, i, n)[::-1])[::-1]
        self.prev = np.concatenate([[-1], before[:-1]]) if n else i  # nearest solid byte on the left, may be of the cell before
        self.next = np.concatenate([after[1:], [n]]) if n else i

        dq = (b == 0x22) & ~self.escaped
        dq &= ~self._odd(dq)[self.cell]
        self.in_double = self._parity(dq) | dq
        # a single quote is one only at the edge of a value: letters on both sides make it an apostrophe
        sq = (b == 0x27) & ~self.escaped & ~self.in_double & ~(_shift(self.word, -1) & _shift(self.word, 1))
        sq &= ~self._odd(sq)[self.cell]
        self.in_single = self._parity(sq) | sq
        self.quoted = self.in_double | self.in_single
        self.quote = dq | sq
        self._ids(p)
        self._delimiters(p)

    def _sum(self, m: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(m)])
        return c[self.stop] - c[self.start]

    def _odd(self, m: np.ndarray) -> np.ndarray:
        return self._sum(m) % 2 == 1

    def _parity(self, m: np.ndarray) -> np.ndarray:
        c = np.cumsum(m)
        base = np.concatenate([[0], c])[self.start]
        return (c - base[self.cell]) % 2 == 1

    def _ids(self, p: Packing) -> None:
        b, form = self.b, p.id_form.encode()
        m = np.ones(len(b), dtype=bool)
        for k, c in enumerate(form):
            m &= _shift(_DIGIT[b] if c == 0x30 else b == c, k)
        m &= ~_shift(self.word, len(form))
        prefix = p.id_prefix.encode()
        prefixed = np.zeros_like(m)
        if prefix:
            at = _shift(_find(b, prefix), -len(prefix))
            prefixed = m & at & ~_shift(self.word, -len(prefix) - 1)
        self.id_start = (m & ~prefixed & ~_shift(self.word, -1)) | _shift(prefixed, len(prefix))
        self.id_end = _shift(m & (prefixed | ~_shift(self.word, -1)), -(len(form) - 1))

    def _at(self, m: np.ndarray, i: np.ndarray) -> np.ndarray:
        """m at the indices i, false outside."""
        ok = (i >= 0) & (i < len(m))
        return ok & m[np.where(ok, i, 0)] if len(m) else ok

    def _delimiters(self, p: Packing) -> None:
        b = self.b
        free = ~self.quoted & ~self.escaped
        delim = np.zeros(len(b), dtype=bool)
        soft = np.zeros(len(b), dtype=bool)
        for d, found in self.hits:
            hit = found & free
            if d in p.soft:
                word_after = self._at(_LOWER[b] & ~self.id_start, self.next)
                word_before = self._at(self.word & ~self.id_end, self.prev)
                soft |= hit & word_after & word_before
            delim |= _cover(hit, len(d.encode()))
        beside = self._at(self.id_end | self.quote, self.prev) | self._at(self.id_start | self.quote, self.next)
        hard = (delim & ~soft) | (self.ws & free & beside)
        if soft.any():
            # where the value around a soft delimiter starts: behind the last hard one, or at the start of the cell
            i = np.arange(len(b))
            behind = np.concatenate([[0], np.maximum.accumulate(np.where(hard | self.end, i + 1, 0))[:-1]])
            first = np.where(self.ws[behind], self.next[behind], behind)
            soft &= ~self._at(_LOWER[b] & ~self.id_start, first)
        delim = (delim & ~soft) | hard
        # brackets around a whole cell
        first = self._first_solid()
        last = self._last_solid()
        ok = (first < last) & (first >= 0)
        f, e = first[ok], last[ok]
        pair = (b[f] == 0x5B) & (b[e] == 0x5D)
        delim[f[pair]] = True
        delim[e[pair]] = True
        self.delim = delim | self.end

    def _first_solid(self) -> np.ndarray:
        if not len(self.b):
            return np.zeros(0, np.int64)
        s = self.start
        return np.where(self.ws[s], np.minimum(self.next[s], self.stop - 1), s)

    def _last_solid(self) -> np.ndarray:
        if not len(self.b):
            return np.zeros(0, np.int64)
        return np.maximum(self.prev[self.stop - 1], self.start)

    def wrapped(self) -> np.ndarray:
        """Cells in quotes as a whole that hold an id."""
        first, last = self._first_solid(), self._last_solid()
        outside = self._sum(~self.quoted & ~self.ws & ~self.end)
        same = (self.b[first] == self.b[last]) & (first < last) & self.quote[first] & self.quote[last]
        return same & (outside == 0) & (self._inner_edges() == 0) & (self._sum(self.id_start) > 0)

    def _inner_edges(self) -> np.ndarray:
        """Solid or white bytes between two quoted parts: the parity is 0 there."""
        gap = ~self.quoted & self.ws
        inner = gap & (np.arange(len(self.b)) > self._first_solid()[self.cell]) & (np.arange(len(self.b)) < self._last_solid()[self.cell])
        return self._sum(inner)


def _unwrap(cells: pa.Array) -> pa.Array:
    t = pc.utf8_trim_whitespace(cells)
    double = pc.starts_with(t, '"')
    inner = pc.utf8_slice_codeunits(t, 1, -1)
    return pc.if_else(double, pc.replace_substring(inner, '""', '"'), inner)


def split_cells(cells: pa.Array, p: Packing = Packing()) -> pa.ListArray:
    """The values of each cell, in order; null and blank cells have none."""
    cells = pc.fill_null(cells.cast(pa.string()), "")
    low = pc.utf8_lower(pc.utf8_trim_whitespace(cells))
    cells = pc.if_else(pc.is_in(low, pa.array(p.nothing)), "", cells)
    n = len(cells)
    if n == 0:
        return pa.array([], pa.list_(pa.string()))
    scan = _Scan(cells, p)
    while (w := scan.wrapped()).any():  # quotes around quotes; each round shortens its cells
        cells = pc.if_else(pa.array(w), _unwrap(cells), cells)
        scan = _Scan(cells, p)
    keep = ~scan.delim
    starts = np.flatnonzero(keep & ~_shift(keep, -1))
    stops = np.flatnonzero(keep & ~_shift(keep, 1)) + 1
    bytes_kept = scan.b[keep]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    items = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(bytes_kept.tobytes()))
    owner = scan.cell[starts]
    items = pc.utf8_trim_whitespace(items)
    for q in ('"', "'"):
        around = pc.and_(pc.and_(pc.starts_with(items, q), pc.ends_with(items, q)), pc.greater(pc.utf8_length(items), 1))
        inner = pc.replace_substring(pc.utf8_slice_codeunits(items, 1, -1), q + q, q)
        items = pc.utf8_trim_whitespace(pc.if_else(around, inner, items))
        odd = pc.equal(pc.count_substring(items, q), 1)
        items = pc.if_else(odd, pc.utf8_trim(items, q), items)
    if pc.any(pc.match_substring(items, "\\")).as_py():
        items = pc.if_else(pc.match_substring(items, "\\"), pc.replace_substring_regex(items, r"\\(.)", r"\1"), items)
    items = pc.utf8_trim_whitespace(items)
    drop = pc.is_in(pc.utf8_lower(items), pa.array([*p.nothing, "", '"', "'", '""', "''", "[", "]", "[]"]))
    live = ~drop.to_numpy(zero_copy_only=False)
    counts = np.bincount(owner[live], minlength=n)
    list_offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(list_offsets, pa.int32()), items.filter(pa.array(live)))


def split_packed(rows: DataFrame, key_col: str, cell_col: str, packing: Packing = Packing(), names: tuple[str, str, str] | None = None) -> DataFrame:
    """One row for each value of each cell: (key, item_pos, item), item_pos counted from 1 in the cell.

    A null or blank cell and one that holds no value give no row. Rows that are repeated count each; keys need not be
    unique and may be null. Cells of any length are split whole. Columns beside the two named ones are ignored. ``names``
    renames the three columns of the result.
    """
    key, pos, item = names or (key_col, "item_pos", "item")
    picked = rows.select(F.col(key_col).alias("k"), F.col(cell_col).cast("string").alias("c")).where("c is not null")
    key_type = picked.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_cells(batch.column(1), packing)
            parent = pc.list_parent_indices(lists)
            first = np.asarray(lists.offsets)[np.asarray(parent)]
            values = pc.list_flatten(lists)
            position = pa.array((np.arange(len(values)) - (first - np.asarray(lists.offsets)[0]) + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(parent), position, values], ["k", "p", "v"])

    out = picked.mapInArrow(run, f"k {key_type}, p int, v string")
    return out.select(F.col("k").alias(key), F.col("p").alias(pos), F.col("v").alias(item))
