"""Subject areas of documents: term weighting, truncated singular value decomposition, refined seed centroids.

  1. The sender's own words (mail.own_words) become terms, single words and pairs within a sentence. Counts of
     documents by term and group (a language, say) cover the whole collection. A term weighs by its rarity within the
     group where it is most common, so that the everyday words of a small language aren't taken for subject words; terms
     of very many documents weigh little, those of very few are left out, which bounds the vocabulary whatever the size of the collection.
  2. Subspace iteration finds the leading singular directions of the document-term matrix: each pass multiplies the
     matrix by a small dense one, task by task, and sums blocks of rows in a shuffle. Documents are embedded in these.
  3. Documents with one known subject are the seeds. Those of a subject are gathered into a few centroids, as it may be
     written about in several languages; one amid labelled documents of other subjects is left out; the centroids are refined by the documents near them, over several passes.
  4. A document gets the subjects whose nearest centroid it projects on by more than a threshold, fitted to the known
     subjects, and with a least weight of subject words. It can get several subjects, or none.

Fitted on a bounded sample are only the seeds and the threshold: MOST_SEEDS labelled documents, chosen by hash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.mail import own_words
from hitweave.session import cut

MOST_SEEDS = 20_000
#: Bound on the vocabulary: a term must occur in this share of all documents, so there are no more terms than distinct
#: terms in an average document divided by it.
LEAST_SHARE, LEAST_DOCS = 5e-4, 3
MOST_TERMS = 2_000_000
#: Rows of the dense matrix that are summed in one group, and what a task holds of it.
ROWS, TASK_MB = 2048, 128
#: Documents that are multiplied at once: their rows stay in a processor's cache.
PIECE = 64


@dataclass(frozen=True)
class Settings:
    dims: int = 64
    passes: int = 3
    refinements: int = 5
    #: share of the documents of a group above which a term loses weight
    most_rate: float = 0.12
    #: share of all documents from which on a group counts as one
    group_share: float = 0.02
    #: cosine from which on two seeds share a centroid, and a document refines one
    same_seed: float = 0.5
    near: float = 0.4
    #: least projection of the unscaled term weights: about one subject word
    least_mass: float = 2.5
    seed: int = 0


_WORD = re.compile(r"[^\W\d_]{3,}")
_SENTENCE = re.compile(r"[.!?;:,\n(){}«»\"]\s|\n\n")


def terms(text: str) -> Counter:
    out: Counter = Counter()
    for s in _SENTENCE.split(text.lower()):
        w = _WORD.findall(s)
        out.update(w)
        out.update(map(" ".join, zip(w, w[1:])))
    return out


def _lists(parts: list, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = pa.array(np.concatenate(parts), kind) if kind != pa.string() and parts else pa.array([x for p in parts for x in p], kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _words(docs: DataFrame, id_col: str, text_col: str, group_col: str | None, reader: Callable[[str | None], str]) -> DataFrame:
    group = F.coalesce(F.lower(F.trim(F.col(group_col).cast("string"))), F.lit("")) if group_col else F.lit("")
    picked = docs.select(F.col(id_col).alias("id"), group.alias("g"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                found = [terms(reader(t)) for t in b.column(2).to_pylist()]
                counts = _lists([np.fromiter(c.values(), np.int32, len(c)) for c in found], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists([list(c) for c in found], pa.string()), counts], ["id", "g", "terms", "tf"])

    return cut(picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, g string, terms array<string>, tf array<int>"), "words")


def _vocabulary(words: DataFrame, s: Settings) -> list[tuple[str, float]]:
    """The terms in use with their weights, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for g in pc.unique(batch.column(1)).to_pylist():
                mine = pc.list_flatten(batch.filter(pc.equal(batch.column(1), g)).column(2))
                for x in pc.value_counts(mine).to_pylist():
                    total.setdefault(g, Counter())[x["values"]] += x["counts"]
            if sum(map(len, total.values())) > 200_000:
                yield from flush(total)
                total = {}
        yield from flush(total)

    def flush(total: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        rows = [(t, g, n) for g, c in total.items() for t, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["term", "g", "n"])

    n = words.count()
    # groups of at least the share, so no more than 1 / group_share; the others and the unnamed one are rated as one group
    large = words.where("g <> ''").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= s.group_share * n)
    groups = {r.g: r.n for r in large.collect()}
    if not n:
        return []
    rest = n - sum(groups.values())
    rates = F.when(F.lit(False), F.lit(0.0))
    for g, k in groups.items():
        rates = rates.when(F.col("g") == g, F.col("n") / k)
    df = words.select("id", "g", "terms").mapInArrow(count, "term string, g string, n long").groupBy("term", "g").agg(F.sum("n").alias("n"))
    rated = df.groupBy("term").agg(F.sum("n").alias("docs"), F.coalesce(F.max(rates), F.try_divide(F.sum("n"), F.lit(rest))).alias("rate"))
    least = max(LEAST_DOCS, LEAST_SHARE * n)
    # above most_rate the weight is lowered by the rate: small for everyday words, some for those of a hot subject
    rarity = F.log(1 / F.greatest("rate", F.lit(1e-4)))
    weight = rarity * F.least(F.lit(1.0), s.most_rate / F.col("rate"))
    kept = rated.where((F.col("docs") >= least) & (F.col("rate") < 1)).select("term", weight.alias("w"))
    rows = kept.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError("documents of too many distinct terms")
    return sorted((r.term, r.w) for r in rows)


def _vectors(words: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """(id, idx, w, mass): w scaled to length 1, mass the length before."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([t for t, _ in shared.value], pa.string())
        weight = np.array([w for _, w in shared.value])
        for batch in batches:
            lists = batch.column(1)
            idx = pc.index_in(pc.list_flatten(lists), known)
            tf = np.asarray(pc.list_flatten(batch.column(2)))
            owner = np.asarray(pc.list_parent_indices(lists)) if len(idx) else np.zeros(0, np.int64)
            ok = np.asarray(pc.is_valid(idx))
            i, owner = np.asarray(idx.filter(pa.array(ok))).astype(np.int32), owner[ok]
            w = (1 + np.log(tf[ok])) * weight[i]
            mass = np.sqrt(np.bincount(owner, w * w, batch.num_rows))
            w = w / mass[owner]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
            o = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(o, pa.array(i, pa.int32())), pa.ListArray.from_arrays(o, pa.array(w, pa.float32())), pa.array(mass, pa.float32())], ["id", "idx", "w", "mass"])

    kind = words.schema["id"].dataType.simpleString()
    return cut(words.select("id", "terms", "tf").mapInArrow(run, f"id {kind}, idx array<int>, w array<float>, mass float"), "vectors")


def _pieces(batch: pa.RecordBatch, idx_at: int = 1, w_at: int = 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, term indices, weights, row of each weight) of small stretches of a batch."""
    for start in range(0, batch.num_rows, PIECE):
        b = batch.slice(start, PIECE)
        i = np.asarray(pc.list_flatten(b.column(idx_at)))
        w = np.asarray(pc.list_flatten(b.column(w_at)))
        n = pc.list_value_length(b.column(idx_at)).to_numpy(zero_copy_only=False)
        yield start, b.num_rows, i, w, np.repeat(np.arange(b.num_rows), n)


def _times(i: np.ndarray, w: np.ndarray, owner: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """Rows of the sparse matrix times q."""
    out = np.zeros((n, q.shape[1]), np.float32)
    if len(i):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = np.add.reduceat(q[i] * w[:, None], first, axis=0)
    return out


class _Sums:
    """Rows of a matrix of n rows that are added to; only those in use take room."""

    def __init__(self, n: int, width: int):
        self.slot, self.used = np.full(n, -1, np.int32), 0
        self.rows = np.zeros((min(n, ROWS), width), np.float32)

    def add(self, at: np.ndarray, rows: np.ndarray) -> None:
        """Add rows at distinct places."""
        new = at[self.slot[at] < 0]
        if len(new):
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            if self.used > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(self.used, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]), np.float32)])
        self.rows[self.slot[at]] += rows

    def flush(self) -> pa.RecordBatch:
        """(block, places in the block, data) of the rows in use, and an empty matrix again."""
        at = np.flatnonzero(self.slot >= 0)
        edge = np.append(np.flatnonzero(np.diff(at // ROWS, prepend=-1)), len(at))
        out = [(int(at[a] // ROWS), (at[a:b] % ROWS).astype(np.int32).tobytes(), self.rows[self.slot[at[a:b]]].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
        self.slot[at], self.used, self.rows[:] = -1, 0, 0
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "at", "data"])


def _sum_rows(df: DataFrame, shape: tuple[int, int], partial) -> np.ndarray:
    """Sum over tasks of the rows that partial(batch, sums) adds for each batch, added up by blocks in a shuffle. Only rows
    that a task has touched leave it, and it holds TASK_MB of them at most."""
    most = TASK_MB * 2**20 // (shape[1] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(*shape)
        for batch in batches:
            partial(batch, sums)
            if sums.used > most:
                yield sums.flush()
        yield sums.flush()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((ROWS, shape[1]), np.float64)
        for at, x in zip(pdf["at"], pdf["data"]):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(x, np.float32).reshape(-1, shape[1])
        at = np.flatnonzero(total.any(1)).astype(np.int32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "at": [at.tobytes()], "data": [total[at].astype(np.float32).tobytes()]})

    out = np.zeros(shape, np.float32)
    kind = "block int, at binary, data binary"
    for r in df.mapInArrow(run, kind).groupBy("block").applyInPandas(add, kind).collect():
        out[r.block * ROWS + np.frombuffer(r.at, np.int32)] = np.frombuffer(r.data, np.float32).reshape(-1, shape[1])
    return out


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """Columns of unit length, at right angles, that span those of y, by way of the small matrix of their products; done
    twice, as once is not exact. Columns that depend on the others become 0."""
    for _ in range(2):
        values, u = np.linalg.eigh(sum(p.astype(np.float64).T @ p for p in np.array_split(y, max(1, len(y) // 65536))))
        scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
        y = y @ (u * scale).astype(np.float32)
    return y


def directions(vectors: DataFrame, n_terms: int, s: Settings) -> np.ndarray:
    """The leading right singular vectors, as columns."""
    sc = vectors.sparkSession.sparkContext
    width = min(s.dims + 8, n_terms)
    q = _orthonormal(np.random.default_rng(s.seed).standard_normal((n_terms, width), np.float32))
    x = vectors.select("id", "idx", "w")
    for p in range(s.passes + 1):
        shared = sc.broadcast(q)

        def gram(batch: pa.RecordBatch, sums: _Sums, shared=shared) -> None:
            for _, n, i, w, owner in _pieces(batch):
                if len(i):
                    y = _times(i, w, owner, n, shared.value)
                    order = np.argsort(i, kind="stable")
                    at = i[order]
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    sums.add(at[first], np.add.reduceat(y[owner[order]] * w[order, None], first, axis=0))

        g = _sum_rows(x, (n_terms, width), gram)
        if p < s.passes:
            q = _orthonormal(g)
    values, v = np.linalg.eigh(q.T.astype(np.float64) @ g)
    return (q @ v[:, np.argsort(-values)[: s.dims]]).astype(np.float32)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-9)


def _embed(vectors: DataFrame, v: np.ndarray) -> DataFrame:
    """(id, z, mass): the projection of each document on the directions."""
    shared = vectors.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.concatenate([_times(i, w, owner, n, shared.value) for _, n, i, w, owner in _pieces(batch)] or [np.zeros((0, v.shape[1]), np.float32)])
            offsets = np.arange(0, z.size + 1, v.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(z.ravel(), pa.float32())), batch.column(3)], ["id", "z", "mass"])

    return cut(vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, z array<float>, mass float"), "embedded")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column)).reshape(-1, width)


def _gather(z: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """Seeds to centroids: a seed joins the nearest centroid of at least that cosine, or begins one. Sums and numbers."""
    sums, n = np.zeros((0, z.shape[1]), np.float64), np.zeros(0)
    for x in z:
        cos = _unit(sums) @ x if len(sums) else np.zeros(0)
        j = int(cos.argmax()) if len(cos) else -1
        if j >= 0 and cos[j] >= same:
            sums[j] += x
            n[j] += 1
        else:
            sums, n = np.vstack([sums, x]), np.append(n, 1)
    return sums, n


def _trusted(c: np.ndarray, of: np.ndarray, z: np.ndarray, truth: np.ndarray, same: float) -> np.ndarray:
    """Which centroids to keep: those of whose labelled neighbours, of at least that cosine, no fewer than half have the
    centroid's subject. A single odd seed amid those of another subject would draw that subject's documents to its own;
    one that is far from all others stays."""
    near = _unit(z) @ c.T >= same
    right = np.stack([truth[near[:, j], k].sum() for j, k in enumerate(of)])
    return 2 * right >= near.sum(0)


def _scores(z: np.ndarray, c: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Largest projection on a centroid of each subject."""
    p = z @ c.T
    return np.stack([p[:, of == j].max(1) if (of == j).any() else np.zeros(len(z)) for j in range(k)], 1)


def _threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The threshold of the best F1 on documents of known subjects."""
    best, at = -1.0, 0.125
    for t in np.arange(0.08, 0.3, 0.005):
        p = scores > t
        f = 2 * (p & truth).sum() / max(1, p.sum() + truth.sum())
        if f > best + 1e-9:
            best, at = f, float(t)
    return at


def assign(docs: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang", reader: Callable[[str | None], str] = own_words, settings: Settings = Settings()) -> DataFrame:
    """(id_col, subject, score), one row for each subject of each document, also of those in labels.

    labels: (id_col, subject), the known subjects of some documents, each of them completely; subjects: (subject,
    description). A subject that no labelled document has alone is seeded by its description. Null and empty texts have
    no subject. Ids need not be unique: repeated rows are judged alike. A null group is a group of no name. Columns beside
    the named ones are ignored. Without documents, labels or subjects the result is empty. Texts are read whole.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    nothing = spark.createDataFrame([], f"`{id_col}` {kind}, subject string, score double")
    listed = sorted((r.subject, r.description or "") for r in subjects.select("subject", "description").where("subject is not null").distinct().collect())
    names = [n for n, _ in listed]
    s = settings
    words = _words(docs, id_col, text_col, group_col, reader)
    vocabulary = _vocabulary(words, s)
    if not vocabulary or not names:
        return nothing
    vectors = _vectors(words, vocabulary)
    v = directions(vectors, len(vocabulary), s)
    embedded = _embed(vectors, v)
    width = v.shape[1]

    known = labels.select(F.col(id_col).alias("id"), "subject").where(F.col("subject").isin(names)).groupBy("id").agg(F.collect_set("subject").alias("s"))
    sample = F.broadcast(cut(known.orderBy(F.xxhash64("id"), "id").limit(MOST_SEEDS), "seeds"))  # MOST_SEEDS rows
    rows = embedded.join(sample, "id").select("id", "z", "s").orderBy("id").limit(2 * MOST_SEEDS).collect()
    seeds = np.array([r.z for r in rows], np.float64).reshape(-1, width)
    truth = np.array([[n in r.s for n in names] for r in rows], bool).reshape(-1, len(names))
    sums, of = [], []
    place = {t: i for i, (t, _) in enumerate(vocabulary)}
    for j, (_, description) in enumerate(listed):
        mine = _unit(seeds[truth[:, j] & (truth.sum(1) == 1)]) if len(seeds) else seeds
        if not len(mine):
            i = [place[t] for t in terms(description) if t in place]
            mine = _unit((v[i] * np.array([[vocabulary[x][1]] for x in i])).sum(0, keepdims=True)) if i else np.zeros((0, width))
        if len(mine):
            c, _ = _gather(mine, s.same_seed)
            sums.append(c)
            of += [j] * len(c)
    if not sums:
        return nothing
    base, of = np.vstack(sums), np.array(of)
    if len(seeds):
        keep = _trusted(_unit(base), of, seeds, truth, s.same_seed)
        base, of = base[keep], of[keep]
    c = _unit(base).astype(np.float32)
    for _ in range(s.refinements):

        def near(batch: pa.RecordBatch, sums: _Sums, c=c) -> None:
            z = _unit(_matrix(batch.column(0), width))
            cos = z @ c.T
            best = cos.argmax(1)
            total = np.zeros(c.shape, np.float64)
            ok = cos.max(1) > s.near if len(z) else np.zeros(0, bool)
            np.add.at(total, best[ok], z[ok])
            sums.add(np.arange(len(c)), total)

        c = _unit(_sum_rows(embedded.select("z"), c.shape, near) + 2 * base).astype(np.float32)
    at = _threshold(_scores(seeds, c, of, len(names)), truth) if len(seeds) else 0.125

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(_matrix(batch.column(1), width), c, of, len(names))
            mass = np.asarray(batch.column(2))[:, None]
            i, j = np.nonzero((p > at) & (p * mass >= s.least_mass))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array([names[x] for x in j], pa.string()), pa.array(p[i, j].astype(np.float64))], ["id", "subject", "score"])

    return embedded.mapInArrow(score, f"id {kind}, subject string, score double").withColumnRenamed("id", id_col)


def composition(assigned: DataFrame, docs: DataFrame, subjects: DataFrame, id_col: str = "doc_id", size_col: str = "n_chars") -> DataFrame:
    """(subject, n_docs, size, share) over all documents; those of no subject come under a null subject. A document of
    several subjects counts under each; share is that of n_docs among all documents."""
    ids = assigned.select(id_col, "subject")
    all_docs = docs.select(id_col, F.coalesce(F.col(size_col), F.lit(0)).alias("size"))
    total = docs.agg(F.count("*").alias("total"))  # one row
    counted = all_docs.join(ids, id_col, "left").groupBy("subject").agg(F.countDistinct(id_col).alias("n_docs"), F.sum("size").alias("size"))
    listed = subjects.select("subject").unionByName(docs.sparkSession.createDataFrame([(None,)], "subject string")).distinct()
    named = listed.join(counted.withColumnRenamed("subject", "s"), F.col("subject").eqNullSafe(F.col("s")), "left").drop("s").na.fill(0, ["n_docs", "size"])
    return named.crossJoin(F.broadcast(total)).select("subject", "n_docs", "size", F.coalesce(F.try_divide(F.col("n_docs"), F.col("total")), F.lit(0.0)).alias("share"))
