"""Operators on streams of hits: what needs one row or running sums. What needs all reads before the first can be decided
(top hits by abundance) runs on a stream only with counts given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hitweave.operators.filters import FilterParams, row_predicate
from hitweave.operators.sampling import sample_n
from hitweave.sources.hits import parse_hits


def stream_lines(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(line, file, label) of text files as they come into a folder."""
    df = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    file = F.col("_metadata.file_path")
    return df.select(F.col("value").alias("line"), file.alias("file"), F.element_at(F.split(file, "/"), -1).alias("label"))


def stream_hits(spark: SparkSession, folder: str, fmt: str = "gene", max_files: int = 100) -> DataFrame:
    return parse_hits(stream_lines(spark, folder, max_files), fmt)


def filter_rows(hits: DataFrame, p: FilterParams, fmt: str | None = None) -> DataFrame:
    """The filters that look at one row. Limits per read need its whole group: see each_batch()."""
    if p.top_pct >= 0 or p.hits_per_read or p.hsps_per_hit or p.nonoverlapping >= 0:
        raise ValueError("filters by read need whole reads: use each_batch()")
    return hits.where(row_predicate(p, hits.columns, fmt))


def running_counts(hits: DataFrame, value: str = "hit") -> DataFrame:
    """(label, value, n), to be written in update or complete mode."""
    return hits.groupBy("label", F.col(value).alias("value")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by key in windows of event time; rows later than ``late`` are left out."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def each_batch(hits: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Any batch operator on files that hold whole reads, one micro-batch after the other, written as Parquet. A batch
    that is run again after a loss replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sample_stream(rows: DataFrame, n: int, order: str, path: str, checkpoint: str, seed: int = 0) -> StreamingQuery:
    """A sample of n rows of all that the stream has brought so far, under path/sample=number of the batch; the last one
    holds. It is the n rows of the least hashes of ``order`` and seed, so it is the sample that sample_n() draws of all
    rows at once. A batch that is run again after a loss starts from the sample before it and replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName().removeprefix("sample=")) for s in fs.listStatus(root)] if fs.exists(root) else []
        earlier = max((k for k in done if k < number), default=None)
        both = batch if earlier is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/sample={earlier}"))
        sample_n(both, n, order, seed).write.mode("overwrite").parquet(f"{path}/sample={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
