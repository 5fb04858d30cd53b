"""Parent-child rows to full paths, by repeated contraction of partition-local chains.

The forest is cut into blocks of bounded size, at first by ranges of ids, as nodes that are loaded together have ids near
each other. Within a block every chain of parents is contracted: a node that other blocks ask for keeps the fragment of
path up to the next such node above, or to the exit of the chain, which is a root, a cycle or a parent in another block.
Only these nodes make up the smaller quotient forest, whose labels are the fragments; it is solved by the same routine,
and its paths are handed back to the blocks that asked, once per block and parent. From the first quotient on, blocks are
by hash, and a node that is its parent's only child is moved to the parent's block for about a quarter of such pairs, by
coins, so that long chains shrink by a constant factor at every level whatever the ids are. A quotient of no more than a
block's nodes is solved at once. Nothing is grouped by parent with its rows, so a parent of a third of all nodes makes no
large task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.session import cut

BLOCK_ROWS = 50_000
SEP = "/"


def _resolve(ids: np.ndarray, parents: np.ndarray, has_parent: np.ndarray):
    """For rows of one block: index of the parent in the block (-1: none here), the top of the local chain, the distance
    to it, and whether the chain runs into a local cycle."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], parents)
    at = np.minimum(at, n - 1)
    local = np.where(has_parent & (ids[order[at]] == parents), order[at], -1)
    top = np.where(local >= 0, local, np.arange(n))
    dist = (local >= 0).astype(np.int64)
    for _ in range(max(1, n).bit_length() + 1):
        dist = dist + dist[top]
        top = top[top]
    return local, top, dist, local[top] >= 0


def _columns(pdf: pd.DataFrame):
    has = pdf["parent"].notna().to_numpy()
    parents = pdf["parent"].fillna(0).to_numpy(dtype=np.int64)
    return pdf["id"].to_numpy(dtype=np.int64), parents, has


def _opened(ids: np.ndarray, parents: np.ndarray, has: np.ndarray) -> np.ndarray:
    """has, but without the parent of the smallest node of each ring in the block: the ring's paths begin there."""
    local, top, _, cyclic = _resolve(ids, parents, has)
    has, seen = has.copy(), set()
    for t in np.unique(top[cyclic]).tolist():
        if t in seen:
            continue
        ring = [t]
        while (j := int(local[ring[-1]])) != t:
            ring.append(j)
        seen.update(ring)
        has[min(ring, key=lambda i: ids[i])] = False
    return has


def _requests(pdf: pd.DataFrame) -> pd.DataFrame:
    """The parents outside of the block that its chains end at, each once."""
    ids, parents, has = _columns(pdf)
    local, _, _, _ = _resolve(ids, parents, has)
    asked = np.unique(parents[has & (local < 0)])
    return pd.DataFrame({"pid": np.full(len(asked), pdf["pid"].iloc[0] if len(pdf) else 0, dtype=np.int32), "id": asked})


def _fragments(nodes: pd.DataFrame, entries: pd.DataFrame, opened: bool) -> pd.DataFrame:
    """For the nodes that other blocks ask for: the next of them above, or the exit of their chain, and the fragment of
    path down from it. A chain that never leaves a cycle becomes a node that is its own parent."""
    out: list[tuple] = []
    if len(nodes) and len(entries):
        ids, parents, has = _columns(nodes)
        has = _opened(ids, parents, has) if opened else has
        local, top, _, cyclic = _resolve(ids, parents, has)
        labels, hops = nodes["label"].to_numpy(object), nodes["hops"].to_numpy(np.int64)
        at = dict(zip(ids.tolist(), range(len(ids))))
        asked = [at[e] for e in entries["id"].tolist()]
        stays = set(asked)
        for i in asked:
            e = int(ids[i])
            if cyclic[i]:
                out.append((e, e, None, 1))
                continue
            parts, k, j = [labels[i]], int(hops[i]), i
            while local[j] >= 0 and local[j] not in stays:
                j = local[j]
                parts.append(labels[j])
                k += int(hops[j])
            above = int(ids[local[j]]) if local[j] >= 0 else int(parents[j]) if has[j] else None
            out.append((e, above, SEP.join(reversed(parts)), k))
    frame = pd.DataFrame(out, columns=["id", "parent", "label", "hops"])
    return frame.astype({"id": "int64", "parent": "Int64", "hops": "int64", "label": object})


def _expand(nodes: pd.DataFrame, answers: pd.DataFrame, opened: bool) -> pd.DataFrame:
    """Paths of all nodes of a block, from the paths of the outside parents. An outside parent without an answer is no
    node: the node below it is a root."""
    if not len(nodes):
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "path": pd.Series(dtype=object), "depth": pd.Series(dtype="int64")})
    ids, parents, has = _columns(nodes)
    has = _opened(ids, parents, has) if opened else has
    local, _, dist, cyclic = _resolve(ids, parents, has)
    labels, hops = nodes["label"].to_numpy(object), nodes["hops"].to_numpy(np.int64)
    known = {i: (p, d) for i, p, d in zip(answers["id"], answers["path"], answers["depth"])}
    path: list = [None] * len(ids)
    depth = np.zeros(len(ids), dtype=np.int64)
    for i in np.argsort(dist, kind="stable").tolist():
        if cyclic[i]:
            continue
        j = local[i]
        if j >= 0:
            above, d = path[j], depth[j]
        elif has[i] and int(parents[i]) in known:
            above, d = known[int(parents[i])]
        else:
            path[i], depth[i] = labels[i], hops[i]
            continue
        if isinstance(above, str):
            path[i], depth[i] = above + SEP + labels[i], d + hops[i]
    return pd.DataFrame({"id": ids, "path": pd.Series(path, dtype=object), "depth": depth})


def _solve(nodes: DataFrame, block_rows: int, level: int, opened: bool = False) -> DataFrame:
    """nodes (id, parent, label, hops) with unique ids -> (id, path, depth); path null: the parents never end. opened:
    each ring is opened at one of its nodes, and no path is null."""
    spark = nodes.sparkSession
    nodes = cut(nodes, f"forest{level}")
    n = nodes.count()
    if level == 0:
        # as many blocks as the session has tasks, more if they would be large; ranges are written down, to be final
        blocks = min(max(1, n), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / block_rows)))
        placed = cut(nodes.repartitionByRange(blocks, "id").withColumn("pid", F.spark_partition_id()), "blocks0")
    else:
        blocks = max(1, math.ceil(n / block_rows))
        placed = nodes.withColumn("pid", F.lit(0)) if blocks == 1 else _tossed(nodes, blocks, level)
    if blocks == 1:
        answers = spark.createDataFrame([], "at int, id long, path string, depth long")
    else:
        asked = cut(placed.groupBy("pid").applyInPandas(_requests, "pid int, id long"), f"asked{level}")
        entries = asked.select("id").distinct().join(placed.select("id", "pid"), "id").select("id", F.col("pid").alias("at"))
        quotient = placed.groupBy("pid").cogroup(entries.groupBy("at")).applyInPandas(lambda a, b: _fragments(a, b, opened), "id long, parent long, label string, hops long")
        solved = _solve(quotient, block_rows, level + 1, opened)
        answers = asked.join(solved, "id").select(F.col("pid").alias("at"), "id", "path", "depth")
    return placed.groupBy("pid").cogroup(answers.groupBy("at")).applyInPandas(lambda a, b: _expand(a, b, opened), "id long, path string, depth long")


def _tossed(nodes: DataFrame, blocks: int, level: int) -> DataFrame:
    """nodes with their block pid: by hash of the id, or of the parent for some only children."""

    def home(c: str):
        return F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(blocks)).cast("int")

    def coin(c: str):
        return F.xxhash64(F.lit("coin"), F.col(c), F.lit(level)) % 2 == 0

    only = nodes.where("parent is not null and parent <> id").groupBy("parent").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id", F.lit(True).alias("only"))
    move = F.coalesce("only", F.lit(False)) & coin("id") & ~coin("parent")
    return cut(nodes.join(only, "id", "left").withColumn("pid", F.when(move, home("parent")).otherwise(home("id"))).drop("only"), f"blocks{level}")


def _nodes(rows: DataFrame, id_col: str, parent_col: str, order_col: str | None) -> DataFrame:
    order = F.col(order_col) if order_col else F.lit(0)
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"), order.alias("o"))
    last = picked.where("id is not null").groupBy("id").agg(F.max(F.struct("o", "parent")).alias("m"))
    return last.select("id", F.expr("nullif(m.parent, id)").alias("parent"), F.col("id").cast("string").alias("label"), F.lit(1).cast("long").alias("hops"))


def hierarchy(rows: DataFrame, id_col: str, parent_col: str, order_col: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Full path, depth and root of each distinct id of rows.

    Result: (id BIGINT, path STRING, depth BIGINT, root BIGINT), one row per distinct id. ``path`` holds the ids from the
    root down, joined by ``/``; a root has depth 1. If the parents of a node run into a cycle, path, depth and root are
    null.

    Several rows of one id: the one with the highest ``order_col`` holds, equal ones are decided by the higher parent (a
    null parent is lowest); without order_col the highest parent holds. A null id is no node. A parent that is null, the
    id itself or no id of the table makes a root. Columns beside the three named ones are ignored, whatever they are
    called. An empty table gives an empty result.
    """
    solved = _solve(_nodes(rows, id_col, parent_col, order_col), block_rows, 0)
    return solved.select("id", "path", F.when(F.col("path").isNotNull(), F.col("depth")).alias("depth"), F.substring_index("path", SEP, 1).cast("long").alias("root"))


def descendants(paths: DataFrame) -> DataFrame:
    """All pairs of a node and a node below it, from hierarchy()'s result: (id, descendant, distance). Nodes on or under
    a cycle have no path and take no part."""
    up = paths.where("path is not null").select(F.col("id").alias("descendant"), F.col("depth"), F.posexplode(F.split("path", SEP)).alias("pos", "a"))
    return up.where("pos < depth - 1").select(F.col("a").cast("long").alias("id"), "descendant", (F.col("depth") - 1 - F.col("pos")).alias("distance"))


def subtree_sizes(paths: DataFrame) -> DataFrame:
    """Number of descendants of each node with a path: (id, n_descendants)."""
    counted = descendants(paths).groupBy("id").agg(F.count("*").alias("n"))
    return paths.where("path is not null").select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_descendants"))


def opened_hierarchy(rows: DataFrame, id_col: str, parent_col: str, order_col: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """hierarchy() in which nodes on or below a cycle have paths too: (id, path, depth, root, last).

    Each cycle is opened above one of its nodes, the root of these paths; last is the parent of that node, where the cycle
    ends. In trees last is null."""
    nodes = _nodes(rows, id_col, parent_col, order_col)
    solved = _solve(nodes, block_rows, 0, True).select("id", "path", F.substring_index("path", SEP, 1).alias("root"))
    # a ring of several blocks is opened above a fragment; nodes asked for within it have gone round, to their root again
    rest = F.expr(f"substring_index(concat('{SEP}', path, '{SEP}'), concat('{SEP}', root, '{SEP}'), -1)")
    solved = solved.withColumn("path", F.rtrim(F.concat("root", F.lit(SEP), rest), F.lit(SEP)))
    solved = cut(solved.select("id", "path", F.size(F.split("path", SEP)).cast("long").alias("depth"), F.col("root").cast("long").alias("root")), "opened")
    tops = solved.where("id = root").select("id").join(nodes.select("id", "parent"), "id").select(F.col("id").alias("root"), F.col("parent").alias("last"))
    tops = tops.join(solved.select(F.col("id").alias("last")), "last", "left_semi")
    return solved.join(tops, "root", "left").select("id", "path", "depth", "root", "last")


def all_descendants(paths: DataFrame) -> DataFrame:
    """All pairs of a node and another node below it, from opened_hierarchy()'s result: (id, descendant, distance). The
    nodes of a cycle are below each other, and what hangs off a cycle is below all of its nodes; the distance is the
    shortest."""
    rings = paths.where("id = last").select("root", F.split("path", SEP).alias("ring"), F.col("depth").alias("size"))
    x = paths.where("last is not null").select(F.col("id").alias("descendant"), F.split("path", SEP).alias("mine"), "depth", "root").join(rings, "root")
    off = F.expr("filter(transform(ring, (x, i) -> struct(i as pos, x as a)), s -> s.pos >= size(mine) or get(mine, s.pos) <> s.a)")
    round_ = x.select("descendant", "depth", "size", F.explode(off).alias("s"))
    return descendants(paths).unionByName(round_.select(F.col("s.a").cast("long").alias("id"), "descendant", (F.col("depth") + F.col("size") - 1 - F.col("s.pos")).alias("distance")))


def all_subtree_sizes(paths: DataFrame) -> DataFrame:
    """Number of descendants of each node, from opened_hierarchy()'s result: (id, n_descendants)."""
    counted = all_descendants(paths).groupBy("id").agg(F.count("*").alias("n"))
    return paths.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_descendants"))
