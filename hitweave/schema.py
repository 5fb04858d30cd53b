"""The hit table that all formats are read into, and the order of ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
HIT_COLUMNS = {
    "read": _S, "read_desc": _S, "hit": _S, "hit_desc": _S, "pctid": _D, "mlen": _I, "qstart": _I, "qend": _I, "hstart": _I, "hend": _I,
    "score": _D, "evalue": _D, "aln": _D, "qlen": _I, "hlen": _I, "strand": _S, "mismatch": _I, "gaps": _I, "matches": _I, "cigar": _S,
    "source": _S, "hit_type": _S, "line": _S,
}
HIT_SCHEMA = T.StructType([T.StructField(k, t) for k, t in HIT_COLUMNS.items()])

#: Ranks from the lowest up.
RANKS = (
    "forma", "varietas", "subspecies", "species", "species subgroup", "species group", "subgenus", "genus", "subtribe", "tribe", "subfamily", "family",
    "superfamily", "parvorder", "infraorder", "suborder", "order", "superorder", "infraclass", "subclass", "class", "superclass", "subphylum", "phylum",
    "superphylum", "subkingdom", "kingdom", "superkingdom", "domain",
)
#: Taxa without a rank that count as families.
FAMILY_TAXIDS = (54526, 62654, 131190, 62672, 62680, 648176, 655184, 745004, 744996)


def rank_index(rank: Column) -> Column:
    """Place of a rank in RANKS, domain being superkingdom; null for none and unknown ranks."""
    at = {r: i for i, r in enumerate(RANKS)} | {"domain": RANKS.index("superkingdom")}
    return F.create_map(*[x for r, i in at.items() for x in (F.lit(r), F.lit(i))])[F.lower(F.trim(rank))]
