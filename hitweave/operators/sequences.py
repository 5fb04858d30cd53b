"""Sequences as columns, and records in fragments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.operators.folds import fold
from hitweave.operators.places import previous, running
from hitweave.operators.taxonomy import numbered

_BASES = "TCAG"
#: Amino acids of the standard code, codons in the order TTT, TTC, TTA, TTG, TCT ... GGG.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}


def reverse_complement(seq: Column) -> Column:
    """Also of ambiguity codes."""
    return F.translate(F.reverse(seq), "ACGTUacgtuRYSWKMBDHVNryswkmbdhvn", "TGCAAtgcaaYRSWMKVHDBNyrswmkvhdbn")


def gc_percent(seq: Column) -> Column:
    """Share of G, C and S, in percent; 0 for an empty sequence."""
    return F.coalesce(F.try_divide(100.0 * F.length(F.regexp_replace(seq, "[^GCSgcs]", "")), F.length(seq)), F.lit(0.0))


def translated(seq: Column, code: str = _AMINO) -> Column:
    """Amino acids of the codons from the first base on, by a code of 64 letters (codons in the order TTT, TTC ... GGG); X for codons that aren't of plain bases, * for stops. Bases
    after the last whole codon are left out."""
    # bases as digits to the base of 4, so that a codon is the place of its amino acid; a dot stands for any other letter
    s = F.regexp_replace(F.translate(F.upper(seq), "UTCAG", "00123"), "[^0-3]", ".")
    codons = F.regexp_extract_all(s, F.lit("..."), 0)
    acid = lambda c: F.when(F.instr(c, ".") > 0, "X").otherwise(F.substring(F.lit(code), F.conv(c, 4, 10).cast("int") + 1, F.lit(1)))
    return F.array_join(F.transform(codons, acid), "")


def region(seq: Column, start: Column, stop: Column) -> Column:
    """Bases start to stop, from 1, both included; reverse complement if start > stop."""
    lo, hi = F.least(start, stop), F.greatest(start, stop)
    part = F.substring(seq, lo, hi - lo + 1)
    return F.when(start > stop, reverse_complement(part)).otherwise(part)


def extract_regions(seqs: DataFrame, regions: DataFrame, least: int = 0) -> DataFrame:
    """The regions (id, start, stop) of the sequences (id, seq), of at least least bases: (id, region_id, seq). Sequences
    without regions give nothing."""
    x = regions.where(F.abs(F.col("stop") - F.col("start")) + 1 >= least).join(seqs.select("id", "seq"), "id")
    return x.select("id", F.concat_ws("_", "id", "start", "stop").alias("region_id"), region(F.col("seq"), F.col("start"), F.col("stop")).alias("seq"))


def fragments_by_count(records: DataFrame, size: int, order: str) -> DataFrame:
    """records with the number of their fragment of size records, from 0, in order."""
    return numbered(records, order).withColumn("fragment", F.floor((F.col("n") - 1) / size).cast("int")).drop("n")


def fragments_by_size(records: DataFrame, chunk: float, file: str, order: str, size: Column) -> DataFrame:
    """(file, order, fragment): a fragment closes before the record with which it would exceed chunk. Where a fragment
    ends depends on all before it, so a file is one task's work, but only its sizes go there."""
    small = records.select(F.col(file).alias("f"), F.col(order).alias("o"), size.cast("double").alias("s"))

    def number(key: tuple, rows):
        at, total = 0, 0.0
        for _, o, s in rows:
            s = s or 0.0
            if total > 0 and total + s > chunk:
                at, total = at + 1, 0.0
            total += s
            yield (*key, o, at)

    kinds = f"f {records.schema[file].dataType.simpleString()}, o {records.schema[order].dataType.simpleString()}, fragment int"
    return fold(small, 1, ["o"], number, kinds).select(F.col("f").alias(file), F.col("o").alias(order), "fragment")


def chunk_size(total: float, records: int, splits: int) -> int:
    """Size of a chunk if total is cut into splits, in whole average records."""
    average = total / records
    return math.floor(math.ceil(total / (splits * average)) * average)


def even_chunk(total: float, chunk: float) -> int:
    """A chunk no larger than chunk such that all chunks are about equal."""
    return math.ceil(total / math.ceil(total / chunk))


def record_totals(records: DataFrame, size: Column) -> DataFrame:
    """(records, size) of all."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(size), F.lit(0)).alias("size"))


def islands(rows: DataFrame, column: str, order: str, file: str | None = None) -> DataFrame:
    """rows with the number of their run of equal values in file order: a value that comes again later begins a new run.
    Without a file the whole table is one sequence. Ranges of the order are worked on apart."""
    keys = [file] if file else []
    x = previous(rows, keys, [order], column, "before_row")
    new = (F.col("before_row").isNull() | ~F.col("before_row.value").eqNullSafe(F.col(column))).cast("long")
    return running(x, keys, [order], new, "island").drop("before_row")
