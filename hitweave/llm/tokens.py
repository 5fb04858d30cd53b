"""Encoding of texts by a public byte-level tokenizer.

Ordinary texts are encoded where they lie, one Arrow batch after the other, with no shuffle. A text longer than ``chunk``
characters is cut into segments that are encoded in parallel tasks and put together again as a tree. Cuts are made where
any text has a boundary of words (white space behind something else, a letter run's end); there the ids of both sides
simply follow each other. In text that has no such place for thousands of characters the cut goes through a word. The
ids of the two parts are then joined by encoding a growing window around the join, until the ids at both of its edges fit
their neighbours: two ids fit if their joined bytes are encoded as just these two. Ids that fit pairwise are the
encoding of their bytes, so the result is exactly that of the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.session import cut as write_out

#: Fixed value: the pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Characters of a segment: texts of more are encoded as trees, about a sixth of an archive of mails.
CHUNK = 3 << 10
#: Characters before the end of a segment in which a boundary of words is looked for, nearest first.
REACH = 4096
NEAR = 64
LEAF = 4096


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Place of a public vocabulary file on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class Encoder:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN)
        self.edges = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")
        self.runs = regex.compile(r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+")

    def ids(self, text: str, chunk: int = CHUNK) -> list[int]:
        """Ids of a text, as a tree of segments if it is long."""
        if len(text) <= chunk:
            return self.enc.encode_ordinary(text)
        parts = list(self.segments(text, chunk))
        return self.tree([self.part(p) for p, _ in parts], [g for _, g in parts])

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.enc.decode_single_token_bytes, ids))

    def _word(self, word: bytes) -> list[int]:
        return self.enc._encode_single_piece(word)

    def _fit(self, a: int, b: int) -> bool:
        return self._word(self._bytes([a, b])) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one word from the ids of its two parts."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self._word(self._bytes(a + b))
            if (k >= len(left) or self._fit(left[-k - 1], window[0])) and (k >= len(right) or self._fit(window[-1], right[k])):
                return left[: max(0, len(left) - k)] + window + right[k:]
            k *= 2

    def word(self, data: bytes, leaf: int = LEAF) -> list[int]:
        """Ids of one word of any length, as a tree of halves."""
        if len(data) <= leaf:
            return self._word(data)
        half = len(data) // 2
        return self.join(self.word(data[:half], leaf), self.word(data[half:], leaf))

    def segments(self, text: str, chunk: int) -> Iterator[tuple[str, bool]]:
        """Consecutive parts of text of about chunk characters at most, each with whether it begins inside of a word."""
        at, glued = 0, False
        while len(text) - at > chunk:
            stop = at + chunk
            low = max(at + 1, stop - REACH)
            cut, inside = self.edge(text, low, stop), False
            if cut is None:  # no boundary: the longest run of the stretch is cut in its middle
                run = max(self.runs.finditer(text, low, stop), key=lambda m: m.end() - m.start())
                cut, inside = (run.start() + run.end()) // 2, True
                while cut > run.start() + 1 and text[cut] == "'":
                    cut -= 1
            yield text[at:cut], glued
            at, glued = cut, inside
        yield text[at:], glued

    def edge(self, text: str, low: int, stop: int) -> int | None:
        """The last place between low and stop at which any text has a boundary of words."""
        reach = NEAR
        while True:
            at = max(low, stop - reach)
            last = None
            for m in self.edges.finditer(text, at, stop):
                last = m.start()
            if last is not None or at == low:
                return last
            reach *= 4

    def part(self, text: str) -> tuple[list[int], int, int]:
        """Ids of a segment, how many of them its first word has, and its last."""
        m = self.words.match(text)
        if not m:
            return [], 0, 0
        e = m.end()
        if e == len(text):
            ids = self.word(text.encode())
            return ids, len(ids), len(ids)
        first = self.word(text[:e].encode())
        # only the words from the last certain boundary on are looked at one by one, to find the last of them
        q = self.edge(text, e + 1, len(text))
        q = e if q is None else q
        middle = self.enc.encode_ordinary(text[e:q])
        tail = [self.word(w[0].encode()) for w in self.words.finditer(text, q)]
        return first + middle + [i for w in tail for i in w], len(first), len(tail[-1])

    def merge(self, a: tuple[list[int], int, int], b: tuple[list[int], int, int], glued: bool) -> tuple[list[int], int, int]:
        """Two neighbouring parts as one."""
        (x, xf, xl), (y, yf, yl) = a, b
        if not x or not y:
            return b if not x else a
        if not glued:
            return x + y, xf, yl
        word = self.join(x[len(x) - xl :], y[:yf])
        ids = x[: len(x) - xl] + word + y[yf:]
        first = len(word) if xl == len(x) else xf
        last = len(word) if yf == len(y) else yl
        if xl == len(x) and yf == len(y):
            first = last = len(ids)
        return ids, first, last

    def tree(self, parts: list[tuple[list[int], int, int]], glued: list[bool]) -> list[int]:
        """Ids of the whole text from those of its segments; glued[i]: part i begins inside of a word."""
        while len(parts) > 1:
            pairs = range(0, len(parts) - 1, 2)
            odd = len(parts) % 2
            parts, glued = [self.merge(parts[i], parts[i + 1], glued[i + 1]) for i in pairs] + parts[len(parts) - odd :] * odd, [glued[i] for i in pairs] + glued[len(glued) - odd :] * odd
        return parts[0][0] if parts else []


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def encode_batches(path: str, text_at: int = -1):
    """A function for mapInArrow that replaces the text, the column at text_at, by its ids, put last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = batch.num_columns
            at = text_at % n
            ids = [np.array(enc.ids(t.as_py()) if t.is_valid else [], dtype=np.int32) for t in batch.column(at)]
            keep = [i for i in range(n) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), _lists(ids)], [*(batch.schema.names[i] for i in keep), "ids"])

    return run


def encode(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep..., ids ARRAY<INT>), one row for each row of docs, without special tokens.

    A null text and an empty text have an empty list. Text that spells a special token is ordinary text. Every text is
    encoded whole; ids need not be unique and may be null, repeated rows count each. Other columns are ignored; a column
    named in ``keep`` may not be called ``ids``. ``path``: the vocabulary file, at the same place on every machine.
    """
    path = path or tokenizer_path()
    if "ids" in (id_col, *keep):
        raise ValueError("the result has a column ids of its own: rename that of the input")
    fields = [id_col, *keep]
    # the columns travel under names of their own, so that those of the input can't clash with the work's
    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(fields)], F.col(text_col).cast("string").alias("t"))
    kinds = ", ".join(f"k{i} {picked.schema[i].dataType.simpleString()}" for i in range(len(fields)))
    long = F.coalesce(F.length("t") > chunk, F.lit(False))
    short = picked.where(~long).mapInArrow(encode_batches(path), f"{kinds}, ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                for seg, (text, glued) in enumerate(enc.segments(one.column(batch.num_columns - 1)[0].as_py(), chunk)):
                    yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([seg], pa.int32()), pa.array([glued]), pa.array([text])], [*batch.schema.names[:-1], "seg", "glued", "t"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            done = [enc.part(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = [*batch.columns[:-1], _lists([np.array(d[0], dtype=np.int32) for d in done]), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "ids", "f", "l"])

    names = [f"k{i}" for i in range(len(fields))]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted segments to texts; of a text only its segments are in memory."""
        enc = encoder(path)
        head, row, mine, glued = None, None, [], []

        def put(heads: list[pa.RecordBatch], texts: list[np.ndarray]) -> pa.RecordBatch:
            keys = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*keys.columns, _lists(texts)], [*names, "ids"])

        for batch in batches:
            keys = batch.select(names)
            rows, g, f, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "glued", "f", "l"))
            lists = batch.column("ids")
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            heads, texts = [], []
            for i in range(batch.num_rows):
                if mine and rows[i] != row:
                    heads.append(keys.slice(i - 1, 1) if i else head)
                    texts.append(np.array(enc.tree(mine, glued), np.int32))
                    mine, glued = [], []
                row = rows[i]
                mine.append((values[offsets[i] : offsets[i + 1]].tolist(), int(f[i]), int(n[i])))
                glued.append(bool(g[i]))
            if batch.num_rows:
                head = keys.slice(batch.num_rows - 1, 1)
            if texts:
                yield put(heads, texts)
        if mine:
            yield put([head], [np.array(enc.tree(mine, glued), np.int32)])

    # the rows' numbers are written down before they are used, so that a task that is run again finds the same
    rows = write_out(picked.where(long).withColumn("row", F.monotonically_increasing_id()), "longtexts")
    segments = rows.select(*names, "row", "t").mapInArrow(cut, f"{kinds}, row long, seg int, glued boolean, t string")
    encoded = segments.repartition("row", "seg").mapInArrow(parts, f"{kinds}, row long, seg int, glued boolean, ids array<int>, f int, l int")
    long_docs = encoded.repartition("row").sortWithinPartitions("row", "seg").mapInArrow(stitch, f"{kinds}, ids array<int>")
    out = short.unionByName(long_docs)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(fields)], "ids")


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """encoded with the text that its ids stand for, in place of the ids. Ids are decoded to bytes before these are read as
    text, so that a character may lie across ids; bytes that are no text come out as replacement characters. A null list
    has a null text."""
    path = path or tokenizer_path()
    others = [c for c in encoded.columns if c != ids_col]
    picked = encoded.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(others)], F.col(ids_col).alias("ids"))
    kinds = "".join(f"k{i} {picked.schema[i].dataType.simpleString()}, " for i in range(len(others)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).enc
        for batch in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "t"])

    out = picked.mapInArrow(run, f"{kinds}t string")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(others)], F.col("t").alias(text_col))
