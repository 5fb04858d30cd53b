"""The scoring of linking.py for lists too long to broadcast, as joins on grams.

A name whose cosine reaches the threshold shares one of the rarest grams of the mention: those that are left when as many
of its common grams are taken away as have, together, a norm below the threshold's share. Only these grams are joined;
the exact cosine is then computed for the pairs that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.linking import Mention, Names, Rules, grams, probes, resolve, spellings
from hitweave.session import cut


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(w, c, t, s) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w, c, s in spellings(n)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.bool_()))], ["spelling", "code", "taxid", "brief"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column(0).to_pylist()
        sets = [sorted(grams(w)) for w in words]
        at = pa.array([i for i, g in enumerate(sets) for _ in g], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([x for g in sets for x in g], pa.string())], ["w", "gram"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What resolve() asks for: the whole name, and the first word among single words."""
    for b in batches:
        out = []
        for k in b.column(0).to_pylist():
            m = Mention.of(k)
            out += [(k, w, False) for w in probes(m)] + [(k, m.words if m.genus else m.words.partition(" ")[0], True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))], ["mention", "w", "single"])


def by_join(distinct: DataFrame, listed: DataFrame, rules: Rules) -> DataFrame:
    """(mention, taxid, score) of the mentions that name an entry, as in linking._by_broadcast()."""
    pair = F.struct("code", "taxid")
    spelled = listed.mapInArrow(_spell, "spelling string, code string, taxid int, brief boolean").groupBy("spelling")
    spelled = spelled.agg(F.collect_set(F.when(~F.col("brief"), pair)).alias("f"), F.collect_set(F.when(F.col("brief"), pair)).alias("s"))
    spelled = cut(spelled.select("spelling", F.when(F.size("f") > 0, F.col("f")).otherwise(F.col("s")).alias("entries")), "spellings")
    of_names = cut(spelled.select("spelling").mapInArrow(_grams, "w string, gram string"), "grams")
    total = spelled.agg(F.count("*").alias("total"))  # one row
    weights = cut(of_names.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("gram", F.log(1 + F.col("total") / F.col("df")).alias("weight")), "weights")
    named = of_names.join(weights, "gram").groupBy(F.col("w").alias("spelling")).agg(F.map_from_entries(F.collect_list(F.struct("gram", "weight"))).alias("nw"))
    named = cut(named.withColumn("norm", F.expr("sqrt(aggregate(map_values(nw), 0D, (a, x) -> a + x * x))")), "named")
    looked = cut(distinct.mapInArrow(_asked, "mention string, w string, single boolean"), "probes")
    asked = looked.select("w").distinct().mapInArrow(_grams, "w string, gram string").join(weights, "gram", "left").crossJoin(F.broadcast(total))
    asked = cut(asked.select("w", "gram", F.coalesce("weight", F.log(1.0 + F.col("total"))).alias("weight")), "asked")
    # rarest grams first; a gram is needed as long as it and the more common ones have a norm of the threshold's share
    rest = F.sum(F.col("weight") ** 2).over(Window.partitionBy("w").orderBy("weight", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum(F.col("weight") ** 2).over(Window.partitionBy("w"))
    needed = asked.withColumn("rest", rest).withColumn("whole", whole).where(F.col("rest") >= rules.cosine**2 * F.col("whole") * (1 - 1e-9))
    met = needed.select("w", "gram").join(of_names.select(F.col("w").alias("spelling"), "gram"), "gram").select("w", "spelling").distinct()
    norms = asked.groupBy("w").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("qnorm"), F.collect_list("gram").alias("qg"))
    scored = met.join(norms, "w").join(named, "spelling")
    dot = F.expr("aggregate(qg, 0D, (a, g) -> a + coalesce(nw[g] * nw[g], 0D))")
    scored = scored.select("w", "spelling", (dot / (F.col("norm") * F.col("qnorm"))).alias("cosine")).where(F.col("cosine") >= rules.cosine)
    both = looked.join(scored, "w").where("not single or instr(spelling, ' ') = 0")
    # only spellings within the edits allowed are gathered, by their letters and by whether they begin with an initial
    letters = {c: F.length(F.replace(F.col(c), F.lit(" "))) for c in ("w", "spelling")}
    allowed = F.when(letters["w"] >= 4, F.least(F.lit(rules.most_edits), F.greatest(F.lit(1), F.floor(letters["w"] / rules.per_edit)))).otherwise(0)
    initial = {c: F.length(F.substring_index(c, " ", 1)) == 1 for c in ("w", "spelling")}
    near = both.where((F.abs(letters["w"] - letters["spelling"]) <= allowed) & (initial["w"] == initial["spelling"])).join(spelled, "spelling")
    found = near.groupBy("mention").agg(F.collect_list(F.struct("w", "single", "spelling", "cosine", "entries")).alias("found"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, rows in zip(pdf["mention"], pdf["found"]):
                rows = sorted(rows, key=lambda r: (r["single"], -r["cosine"], r["spelling"]))
                names = Names({r["spelling"]: {(e["code"], int(e["taxid"])) for e in r["entries"]} for r in rows})
                hit = resolve(Mention.of(key), names, lambda w, single: [(r["spelling"], r["cosine"]) for r in rows if r["single"] == single and r["w"] == w], rules)
                if hit:
                    out.append((key, *hit))
            yield pd.DataFrame(out, columns=["mention", "taxid", "score"]).astype({"mention": object, "taxid": "int32", "score": "float64"})

    return found.mapInPandas(decide, "mention string, taxid int, score double")
