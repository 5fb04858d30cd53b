"""Mixtures of sources with target shares of the tokens.

  1. The documents are brought into the order of source and id, by ranges, and encoded where they lie; their tokens are
     written once. The tokens of a source are thought of as one string, cut into blocks of fixed length; only the last
     block of a source is shorter. What a block holds depends on the documents alone, not on how they are stored.
  2. From the tokens of each source comes how many blocks each has to give. They are dealt to the output shards by
     multinomial draws that are conditioned on these totals (multivariate hypergeometric), so that the shares of the whole
     are reached and not only expected.
  3. Slot k of a source takes block permutation(k mod blocks) of its round k div blocks. The permutation, a Feistel
     network with cycle walking, differs by source and round, and needs no table. A round uses every block once, so that
     no token is drawn more often than max_repeats times.
  4. Permutations can be turned round: each task works out, from the index of a block it holds, the slots that the block
     fills. So slots and blocks are joined by index without moving any tokens; only blocks that lie across the end of a
     task's batch are put together in a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.tokens import encoder, tokenizer_path
from hitweave.session import cut

BLOCK_TOKENS = 256
#: Blocks per output shard, and at most so many shards (their plan is made on the driver).
SHARD_BLOCKS, MOST_SHARDS = 1024, 4096
#: Most sources that a target table may have; it is read by the driver.
MOST_SOURCES = 10_000
#: Most entries of the plan (shards times sources), which every task gets.
MOST_PLAN = 1 << 22
_TOKENS = "source string, d long, part int, at long, n int, ids array<int>"
_PIECES = "source string, no long, at int, n_tokens int, ids array<int>, docs array<struct<doc_id:bigint,start:int,n:int>>, draws array<struct<repeat:int,shard:int,slot:bigint>>"


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit hash of x and key (the finaliser of splitmix64)."""
    x = x + key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(k: np.ndarray, size, key, back: bool = False) -> np.ndarray:
    """The images of k under a pseudorandom permutation of range(size), or with back what they are images of. size and
    key may differ for each k."""
    out = np.asarray(k).astype(np.uint64)
    size = np.broadcast_to(np.asarray(size).astype(np.uint64), out.shape)
    key = np.broadcast_to(np.asarray(key).astype(np.uint64), out.shape)
    bits = np.frexp(np.maximum(size, 2).astype(np.float64) - 1)[1]
    half = np.maximum(1, (bits + 1) // 2).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, shift, ks = out[todo], half[todo], key[todo]
        mask = (np.uint64(1) << shift) - np.uint64(1)
        left, right = x >> shift, x & mask
        for r in range(6):
            turn = ks * np.uint64(1000003) + np.uint64((5 - r if back else r) * 7919)
            if back:
                left, right = right ^ (_mix(left, turn) & mask), left
            else:
                left, right = right, left ^ (_mix(right, turn) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), values)


def encode_in_order(docs: DataFrame, id_col: str, source_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """Tokens of every document, written to the shared folder: (source, d, part, at, n, ids), at being the tokens of the
    source before it in its part; parts are ranges of (source, d). Null and empty texts have no tokens."""
    path = path or tokenizer_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = docs.select(F.col(source_col).cast("string").alias("s"), F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    # documents of one id are ordered by their texts; rows that are equal in all are the same to us, and may be parted
    x = x.withColumn("h", F.xxhash64("t")).withColumn("e", F.monotonically_increasing_id() % 997)
    order = ["s", "d", "h", "t", "e"]
    x = x.repartitionByRange(parts, "s", "d", "h", "e").sortWithinPartitions(*order).select("s", "d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = [np.array(enc.ids(t) if t else [], dtype=np.int32) for t in batch.column(2).to_pylist()]
            n = np.array([len(i) for i in ids], dtype=np.int64)
            at = np.zeros(len(n), np.int64)
            for i, s in enumerate(batch.column(0).to_pylist()):
                at[i] = before.get(s, 0)
                before[s] = at[i] + n[i]
            lists = _lists(np.concatenate([[0], np.cumsum(n)]), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(at), pa.array(n, pa.int32()), lists], ["source", "d", "part", "at", "n", "ids"])

    return cut(x.mapInArrow(run, _TOKENS), "tokens")


def quotas(sources: list[tuple[str, float, int, int, int]], total_tokens: int | None = None, exact: bool = False) -> tuple[dict[str, int], float]:
    """From (source, weight, max_repeats, blocks, tokens) to the number of blocks that each source gives, and the total
    of tokens planned.

    Without total_tokens the total is that of all tokens of these sources, with exact it is the largest at which every
    source that has any tokens reaches its weight. A source that can't give its share of the total gives all it may, and
    the rest is shared by the others in proportion to their weights."""
    live = [s for s in sources if s[3] and s[1] > 0 and s[2] > 0]
    most = {s[0]: float(s[4]) * s[2] for s in live}
    weight = {s[0]: s[1] for s in live}
    mean = {s[0]: s[4] / s[3] for s in live}
    if not live:
        return {}, 0.0
    full = sum(weight.values())
    if exact:
        total = min(most[s] * full / weight[s] for s in most)
    else:
        total = float(sum(s[4] for s in live) if total_tokens is None else total_tokens)
    give: dict[str, float] = {}
    rest, left = dict(weight), total
    while rest:
        scale = left / sum(rest.values())
        short = [s for s in rest if scale * rest[s] > most[s] * (1 + 1e-12)]
        if not short:
            give |= {s: scale * w for s, w in rest.items()}
            break
        for s in short:
            give[s] = most[s]
            left -= most[s]
            del rest[s]
    blocks = {s[0]: s[3] * s[2] for s in live}
    return {s: min(blocks[s], max(1, round(t / mean[s]))) for s, t in give.items()}, total


def deal(counts: dict[str, int], seed: int) -> list[tuple[int, str, int, int]]:
    """(shard, source, first slot of the source, slots): every shard's number of slots of each source."""
    names, left = list(counts), np.array(list(counts.values()), dtype=np.int64)
    total = int(left.sum())
    shards = max(1, min(MOST_SHARDS, MOST_PLAN // max(1, len(names)), -(-total // SHARD_BLOCKS)))
    rng = np.random.default_rng(seed)
    first, out = np.zeros(len(names), dtype=np.int64), []
    for shard in range(shards):
        size = total * (shard + 1) // shards - total * shard // shards
        drawn = np.zeros(len(names), dtype=np.int64)
        pool, want = int(left.sum()), size
        for i in range(len(names)):
            good, bad = int(left[i]), pool - int(left[i])
            n = min(good, want) if not bad else _hyper(rng, good, bad, want)
            drawn[i] = n
            pool, want = bad, want - n
        for i in np.flatnonzero(drawn):
            out.append((shard, names[i], int(first[i]), int(drawn[i])))
        first += drawn
        left -= drawn
    return out


def _hyper(rng, good: int, bad: int, want: int) -> int:
    """Hypergeometric draw; beyond numpy's range the normal approximation, within the bounds."""
    if want == 0 or good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, want))
    p = good / (good + bad)
    sd = (want * p * (1 - p) * (good + bad - want) / (good + bad - 1)) ** 0.5
    return int(min(good, want, max(0, want - bad, round(rng.normal(want * p, sd)))))


class _Draws:
    """The slots that blocks fill. A slot's place in its shard is permuted too, so that sources lie mixed."""

    def __init__(self, plan: list[tuple[int, str, int, int]], blocks: dict[str, int], counts: dict[str, int], seed: int):
        self.blocks, self.counts, self.seed = blocks, counts, seed
        fill: dict[int, int] = {}
        rows: dict[str, list] = {}
        for shard, source, first, n in plan:
            rows.setdefault(source, []).append((first, shard, fill.get(shard, 0)))
            fill[shard] = fill.get(shard, 0) + n
        self.at = {s: np.array(r, np.int64).T for s, r in rows.items()}
        self.shard_size = np.array([fill[i] for i in range(len(fill))], np.int64)

    def of(self, source: str, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the block in no, repeat, shard, slot) of each draw of these blocks."""
        size, count = self.blocks.get(source, 0), self.counts.get(source, 0)
        out = []
        for r in range(-(-count // size) if size else 0):
            k = r * size + permute(no, size, zlib.crc32(source.encode()) * 65537 + r * 257 + self.seed, back=True)
            i = np.flatnonzero(k < count)
            first, shard, start = self.at[source]
            j = np.searchsorted(first, k[i], "right") - 1
            within = start[j] + k[i] - first[j]
            slot = permute(within, self.shard_size[shard[j]], shard[j] * 8191 + self.seed)
            out.append((i, np.full(len(i), r), shard[j], slot))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _cut_blocks(source: str, total: int, size: int, start: np.ndarray, d: pa.Array, values: np.ndarray, draws: _Draws, whole: bool) -> pa.RecordBatch:
    """Blocks, or if not whole those that are only begun or ended here, of documents that follow each other."""
    low, high = int(start[0]), int(start[0]) + len(values)
    edge = np.unique(np.concatenate([start, np.arange(low // size + 1, (high - 1) // size + 1) * size]))
    n = np.diff(edge, append=high)
    doc = np.searchsorted(start, edge, "right") - 1
    no = edge // size
    first = np.flatnonzero(np.diff(no, prepend=-1))
    blocks = no[first]
    tokens = np.add.reduceat(n, first)
    full = tokens == np.minimum(size, total - blocks * size)
    place, repeat, shard, slot = draws.of(source, blocks)
    order = np.argsort(place, kind="stable")
    n_draws = np.bincount(place, minlength=len(blocks))
    drawn = _lists(np.concatenate([[0], np.cumsum(n_draws)]), pa.StructArray.from_arrays([pa.array(repeat[order], pa.int32()), pa.array(shard[order], pa.int32()), pa.array(slot[order], pa.int64())], ["repeat", "shard", "slot"]))
    docs = pa.StructArray.from_arrays([d.take(pa.array(doc)), pa.array(edge - start[doc], pa.int32()), pa.array(n, pa.int32())], ["doc_id", "start", "n"])
    keep = pa.array(np.flatnonzero((full == whole) & (n_draws > 0)))
    cols = [
        pa.array(np.full(len(blocks), source, object), pa.string()), pa.array(blocks), pa.array(edge[first] - blocks * size, pa.int32()), pa.array(tokens, pa.int32()),
        _lists(np.append(edge[first], high) - low, pa.array(values, pa.int32())), _lists(np.append(first, len(edge)), docs), drawn,
    ]
    return pa.RecordBatch.from_arrays([c.take(keep) for c in cols], ["source", "no", "at", "n_tokens", "ids", "docs", "draws"])


def mixture(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", path: str | None = None, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, exact: bool = False, seed: int = 0
) -> DataFrame:
    """The drawn blocks: (shard, slot, source, repeat, no, n_tokens, ids, docs), one row per slot; no is the block of the
    source, docs names the documents in it with their first token and the number of tokens.

    targets: (source, weight, max_repeats), one row for each source, weights of any sum. As many tokens are drawn as the
    sources have together, or total_tokens, or with exact as many as leave every weight reached. ``repeat`` is the round
    of the source, from 0, and stays below max_repeats. Documents of a source that targets don't name, or with a null
    source, take no part; a source without tokens gives none. Empty targets or documents give an empty result. A target
    table of more than MOST_SOURCES rows is refused. The same documents, targets, block length and seed give the same
    mixture, however the documents are stored and partitioned.
    """
    want = targets.select(F.col("source").cast("string").alias("source"), F.col("weight").cast("double"), F.col("max_repeats").cast("int")).where("source is not null and weight > 0 and max_repeats > 0").limit(MOST_SOURCES + 1).collect()
    if len(want) > MOST_SOURCES or len({r.source for r in want}) < len(want):
        raise ValueError(f"targets need one row for each source, {MOST_SOURCES} at most")
    named = docs.where(F.col(source_col).isin([r.source for r in want]) if want else F.lit(False))
    tokens = encode_in_order(named, id_col, source_col, text_col, path)
    # as parts are ranges, no more rows than parts and sources together
    spans = cut(tokens.groupBy("source", "part").agg(F.sum("n").alias("tokens")), "spans")
    size = {r.source: r.tokens for r in spans.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if r.tokens}
    blocks = {s: -(-n // block_tokens) for s, n in size.items()}
    counts, _ = quotas([(r.source, r.weight, r.max_repeats, blocks.get(r.source, 0), size.get(r.source, 0)) for r in want], total_tokens, exact)
    shared = docs.sparkSession.sparkContext.broadcast(_Draws(deal(counts, seed), blocks, counts, seed))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = spans.select("source", "part", before.alias("base"))
    x = tokens.where("n > 0").join(F.broadcast(base), ["source", "part"]).select("source", "d", (F.col("base") + F.col("at")).alias("start"), "n", "ids")

    def pieces(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                start, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                sources = batch.column(0).to_numpy(zero_copy_only=False)
                lists = batch.column(4)
                offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
                # stretches of documents that follow each other
                new = np.flatnonzero(np.concatenate([[True], (sources[1:] != sources[:-1]) | (start[1:] != start[:-1] + n[:-1])]))
                for a, b in zip(new, np.append(new[1:], len(n))):
                    s = sources[a]
                    if s in shared.value.counts:
                        yield _cut_blocks(s, size[s], block_tokens, start[a:b], batch.column(1).slice(a, b - a), values[offsets[a] : offsets[b]], shared.value, whole)

        return x.mapInArrow(run, _PIECES)

    parts = F.sort_array(F.collect_list(F.struct("at", "ids", "docs")))
    split = pieces(False).groupBy("source", "no").agg(parts.alias("p"), F.sum("n_tokens").cast("int").alias("n_tokens"), F.first("draws").alias("draws"))
    split = split.select("source", "no", "n_tokens", F.flatten("p.ids").alias("ids"), F.flatten("p.docs").alias("docs"), "draws")
    out = pieces(True).drop("at").unionByName(split).select("source", "no", "n_tokens", "ids", "docs", F.explode("draws").alias("x"))
    return out.select("x.shard", "x.slot", "source", "x.repeat", "no", "n_tokens", "ids", "docs")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source of targets: (source, weight, max_repeats, n_blocks, n_tokens, share, repeats), share being that of
    all tokens drawn and repeats how often its most used block was drawn."""
    per = drawn.groupBy("source").agg(F.count("*").alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat") + 1).alias("repeats"))
    out = targets.select("source", "weight", "max_repeats").join(per, "source", "left").na.fill(0, ["n_blocks", "n_tokens", "repeats"])
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row per source
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("n_tokens"), total), F.lit(0.0)))


def usage(drawn: DataFrame) -> DataFrame:
    """How often each drawn document is used: (doc_id, source, uses, n_tokens), uses being the most draws that any block
    with a part of it has."""
    # rows of one id count once for each draw of a block
    mine = F.expr("transform(array_distinct(docs.doc_id), i -> named_struct('doc_id', i, 'n', aggregate(filter(docs, d -> d.doc_id <=> i), 0L, (t, d) -> t + d.n)))")
    x = drawn.select("source", "no", F.explode(mine).alias("d"))
    per_block = x.groupBy("d.doc_id", "source", "no").agg(F.count("*").alias("uses"), F.sum("d.n").alias("n"))
    return per_block.groupBy("doc_id", "source").agg(F.max("uses").alias("uses"), F.sum("n").alias("n_tokens"))
