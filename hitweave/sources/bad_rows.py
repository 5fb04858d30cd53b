"""Delimited text with bad rows: the valid rows are loaded, the others come out with the reason.

Records are assembled with a view to quotes (or each line is a record), every record is parsed by Python's strict csv
reader, and its structural exceptions are caught before the typed constructors of the fields run. A parse that the csv
reader accepts is then held against the exact form of a cell, since the reader also takes quotes inside of bare fields.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.names import free_name


def assemble_records(lines: DataFrame, file_col: str, order_col: str, line_col: str, quote: str = '"', block: int = 100_000) -> DataFrame:
    """Join the lines of records whose quotes span lines: (file, first, n_lines, record).

    A line starts a record if an even number of quotes precedes it in its file. The parity is a prefix sum in two steps,
    within blocks of order_col and over the blocks of a file, so that a file of any length is no single task. A record that
    the file ends within has a quote too many: its lines stand for themselves, so that the one at fault is found by the
    parser and the valid ones behind it are loaded, and no task gets the rest of the file. Null lines count as empty.
    order_col must order the lines of a file.
    """
    x = lines.select(F.col(file_col).alias("file"), F.col(order_col).cast("long").alias("pos"), F.coalesce(F.col(line_col), F.lit("")).alias("line"))
    x = x.withColumn("b", F.floor(F.col("pos") / block)).withColumn("q", F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit(""))))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = x.groupBy("file", "b").agg(F.sum("q").alias("s")).select("file", "b", (before % 2).alias("odd"), (F.sum("s").over(Window.partitionBy("file")) % 2).alias("torn"))
    w = Window.partitionBy("file", "b").orderBy("pos")
    x = x.join(starts, ["file", "b"]).withColumn("open", (F.col("odd") + F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2)
    x = x.withColumn("start", F.when(F.col("open") == 0, F.col("pos")))
    last = x.groupBy("file", "b").agg(F.max("start").alias("m")).select("file", "b", F.max("m").over(Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("m").over(Window.partitionBy("file")).alias("final"))
    x = x.join(last, ["file", "b"]).withColumn("first", F.coalesce(F.last("start", True).over(w), "carry"))
    x = x.withColumn("first", F.when((F.col("torn") == 1) & (F.col("first") == F.col("final")), F.col("pos")).otherwise(F.col("first")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    return x.groupBy("file", "first").agg(F.count("*").alias("n_lines"), joined.alias("record"))


def _parser(names: list[str], patterns: list[str], delimiter: str, quote: str, comment: str | None):
    """A function of one record: None if it's no record, else (reason or None, the fields or None)."""
    csv.field_size_limit(sys.maxsize)
    q, d = re.escape(quote), re.escape(delimiter)
    cell = re.compile(f"{q}(?:[^{q}]|{q}{q})*{q}|[^{q}{d}]*")
    ends = re.compile(f"(?:{cell.pattern})(?:{d}(?:{cell.pattern}))*")
    forms = [re.compile(p) for p in patterns]
    options = {"delimiter": delimiter, "quotechar": quote, "doublequote": True, "strict": True}

    def parse(text: str | None):
        if text is None:
            return None
        if text.endswith("\r"):
            text = text[:-1]
        if not text.strip() or comment and text.startswith(comment):
            return None
        try:
            found = list(csv.reader([text], **options))
        except csv.Error as e:
            return f"structure: {e}", None
        if len(found) != 1:
            return "structure: line break in a bare field", None
        fields = found[0]
        if len(fields) != len(names):
            return f"columns: {len(fields)} instead of {len(names)}", None
        if not ends.fullmatch(text) or "\r" in text:
            return "structure: quote or line break in a bare field", None
        quoted, at = [], 0
        for _ in names:
            m = cell.match(text, at)
            quoted.append(m.group().startswith(quote))
            at = m.end() + len(delimiter)
        values = [v if bare else v.strip(" ") for v, bare in zip(fields, quoted)]
        for name, form, value in zip(names, forms, values):
            if not form.fullmatch(value):
                return f"value: {name} is {'empty' if not value else 'malformed'}", None
        return None, values

    return parse


def parse_rows(records: DataFrame, record_col: str, fields: dict[str, str], keep: list[str] = (), header=None, delimiter: str = "\t", quote: str = '"', comment: str | None = "#") -> DataFrame:
    """Parse every record; one row each for records that are data: the columns ``keep``, the fields (null if bad) and
    ``reason`` (null if valid).

    ``fields`` maps the names of the fields, in order, to the regular expression that the whole value must match.
    ``header``: a boolean Column that is true for header records. Header records, null and blank records and those that
    start with ``comment`` give no row. One carriage return at the end of a record is not part of it. Repeated records
    count each; records of any length are parsed whole. If a kept column has the name of a field or ``reason``, it comes
    out as ``in_`` and that name; other columns of the input are ignored. No input rows: no result rows.
    """
    names = list(fields)
    kept = {k: free_name(f"in_{k}" if k in (*names, "reason") else k, [*names, "reason"]) for k in keep}
    text = free_name("record", [*kept.values(), *names, "reason"])
    source = (records if header is None else records.where(~F.coalesce(header, F.lit(False)))).select(*[F.col(k).alias(v) for k, v in kept.items()], F.col(record_col).cast("string").alias(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text), *(f"`{n}` string" for n in names), "reason string"])
    patterns = list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = _parser(names, patterns, delimiter, quote, comment)
        for batch in batches:
            parsed = [parse(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            at = pa.array([i for i, p in enumerate(parsed) if p is not None], pa.int64())
            parsed = [p for p in parsed if p is not None]
            cols = [batch.column(i).take(at) for i, f in enumerate(batch.schema) if f.name != text]
            cols += [pa.array([p[1] and p[1][i] for p in parsed], pa.string()) for i in range(len(names))]
            cols.append(pa.array([p[0] for p in parsed], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in batch.schema if f.name != text), *names, "reason"])

    return source.mapInArrow(run, schema)


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def rejected(parsed: DataFrame, names: list[str]) -> DataFrame:
    return parsed.where("reason is not null").drop(*names)
