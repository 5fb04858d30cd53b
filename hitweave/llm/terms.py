"""Counts of every distinct term, kept up to date by signed changes.

A change is a row (field, record, term, delta): +1 for a row that was added, -1 for one that was deleted, both for one
whose term changed. Changes are summed before the shuffle to one row for each (record, term) pair. The state of pairs is
partitioned by hash of the record, and only the buckets that a batch touches are read, to see which records gain or lose a
term altogether. From that come the changes of rows and records of each term. Both levels are written as a run of their
own; a manifest that is written last makes the run part of the state, so that a batch that fails leaves nothing behind.
The current counts are the sums over the runs, which compact() makes one again. A term of a third of all rows is no hot
key: its pairs are spread by record, and its changes are summed in every task before they meet.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.session import cut, new_path

#: Pairs of a bucket when a store is begun, and bounds on the number of buckets, which is one of folders.
BUCKET_PAIRS, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 16, 1 << 14
#: Runs from which on apply() makes them one.
MOST_RUNS = 12
#: The characters that Unicode calls white space, and the separators that Python's strip() also takes for it.
WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"
RECORD, PAIR = ["field", "record"], ["field", "record", "term"]
_PAIRS = "field string, record string, term string, d long, bucket int"
_TERMS = "field string, term string, n_rows long, n_records long, bucket int"


def clean_term(value: Column) -> Column:
    """Without white space around it and in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(value.cast("string"), f"^{WHITE}+|{WHITE}+$", "")), F.lit(""))


def changes(rows: DataFrame, field: str, record: str, term: Column, delta: int = 1) -> DataFrame:
    """Rows as changes. Rows without a term (null) are none; a null record is a record of its own."""
    return rows.select(F.lit(field).alias("field"), F.col(record).cast("string").alias("record"), term.cast("string").alias("term"), F.lit(delta).cast("long").alias("delta")).where("term is not null")


def corrections(rows: DataFrame, field: str, record: str, old: Column, new: Column) -> DataFrame:
    """Rows whose term has changed as changes: the old one removed, the new one added, both from one pass over the rows.
    Rows whose terms are equal are none."""
    two = F.array(F.struct(old.cast("string").alias("term"), F.lit(-1).cast("long").alias("delta")), F.struct(new.cast("string").alias("term"), F.lit(1).cast("long").alias("delta")))
    x = rows.select(F.lit(field).alias("field"), F.col(record).cast("string").alias("record"), two.alias("two")).where("not two[0].term <=> two[1].term")
    return x.select("field", "record", F.inline("two")).where("term is not null")


class TermCounts:
    """Persistent counts in a folder that all executors share. One writer at a time. buckets: of a new store; by default
    as many as its first batch asks for."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "terms")
        self.runs: list[str] = []
        self.version = 0
        self._load()

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _load(self) -> None:
        """The state that the last manifest names."""
        fs, root = self._file("")
        if not fs.exists(root):
            return
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        versions = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            return
        self.version = versions[-1]
        fs, at = self._file(f"manifest-{self.version:08d}.json")
        stream = fs.open(at)
        state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        self.runs, self.buckets = state["runs"], state["buckets"]

    def _publish(self, runs: list[str]) -> None:
        """Make runs the state: a manifest is whole when it gets its name."""
        fs, draft = self._file(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps({"runs": runs, "buckets": self.buckets}).encode())
        out.close()
        _, name = self._file(f"manifest-{self.version + 1:08d}.json")
        if not fs.rename(draft, name):
            raise RuntimeError("another writer has changed the counts")
        self.version += 1
        self.runs = runs

    def _remove(self, runs: list[str]) -> None:
        for r in runs:
            fs, at = self._file(r)
            fs.delete(at, True)

    def _read(self, level: str, schema: str) -> DataFrame:
        out = None
        for r in self.runs:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/{r}/{level}")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _write(self, df: DataFrame, run: str, level: str, keys: list[str]) -> None:
        """Every task writes into one bucket; a bucket has as many tasks as the session has for it."""
        share = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        place = F.col("bucket") * share + F.pmod(F.xxhash64(F.lit("place"), *df.columns), F.lit(share)).cast("int")
        x = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
        x.repartitionById(self.buckets * share, place).write.partitionBy("bucket").parquet(f"{self.path}/{run}/{level}")

    def apply(self, batch: DataFrame) -> None:
        """Merge a batch of changes (field, record, term, delta). A batch that removes rows that were never added makes
        the job fail, and leaves the counts as they were."""
        summed = batch.groupBy(*PAIR).agg(F.sum("delta").alias("d")).where("d <> 0")
        if self.buckets is None:
            summed = cut(summed, "firstbatch")
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (summed.count() // BUCKET_PAIRS).bit_length()))
        run = f"run-{uuid.uuid4().hex}"
        try:
            self._write(summed, run, "pairs", RECORD)
            delta = self.spark.read.schema(_PAIRS).parquet(f"{self.path}/{run}/pairs")
            self._write(self._moved(delta), run, "terms", ["field", "term"])
        except Exception:
            self._remove([run])
            raise
        self._publish([*self.runs, run])
        if len(self.runs) >= MOST_RUNS:
            self.compact()

    def _moved(self, delta: DataFrame) -> DataFrame:
        """Changes of rows and records of each term: (field, term, n_rows, n_records). A record as such is the pair without
        a term: its transitions count the records that hold any term."""
        both = delta.select(*PAIR, F.lit(0).cast("long").alias("old"), "d")
        if self.runs:
            touched = [r.bucket for r in delta.select("bucket").distinct().collect()]  # as many as buckets at most
            state = self._read("pairs", _PAIRS)
            state = state if len(touched) == self.buckets else state.where(F.col("bucket").isin(touched))
            both = both.unionByName(state.select(*PAIR, F.col("d").alias("old"), F.lit(0).cast("long").alias("d")))
            both = both.groupBy(*PAIR).agg(F.sum("old").alias("old"), F.sum("d").alias("d"))
        pairs = both  # one row for each pair, as delta has
        records = pairs.groupBy(*RECORD).agg(F.sum("old").alias("old"), F.sum("d").alias("d")).withColumn("term", F.lit(None).cast("string"))
        new = F.col("old") + F.col("d")
        checked = F.when(new < 0, F.raise_error(F.lit("rows are removed that were never added")).cast("long")).otherwise(F.signum(new).cast("long"))
        r = checked - F.signum("old").cast("long")
        moved = pairs.unionByName(records).where("d <> 0").select("field", "term", "d", r.alias("r"))
        return moved.groupBy("field", "term").agg(F.sum("d").alias("n_rows"), F.sum("r").alias("n_records"))

    def compact(self) -> None:
        """One run instead of many, with the same counts; the old ones are deleted."""
        run, old = f"run-{uuid.uuid4().hex}", self.runs
        if not old:
            return
        try:
            self._write(self._read("pairs", _PAIRS).groupBy(*PAIR).agg(F.sum("d").alias("d")).where("d <> 0"), run, "pairs", RECORD)
            self._write(self._sums(), run, "terms", ["field", "term"])
        except Exception:
            self._remove([run])
            raise
        self._publish([run])
        self._remove(old)

    def _sums(self) -> DataFrame:
        return self._read("terms", _TERMS).groupBy("field", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records")).where("n_rows <> 0")

    def counts(self) -> DataFrame:
        """(field, term, n_rows, n_records), one row for each term that occurs."""
        return self._sums().where("term is not null")

    def marked(self, min_records: int, max_share: dict[str, float]) -> DataFrame:
        """counts() with ``mark``: rare (fewer records than min_records), common (more than the field's share of the
        records that hold any term of the field), both, or null. A field that max_share doesn't name has no common
        terms."""
        sums = self._sums()
        limit = F.lit(None).cast("double")
        for field, share in max_share.items():
            limit = F.when(F.col("field") == field, F.lit(share)).otherwise(limit)
        # one row for each field: as few as there are columns whose values are counted
        totals = sums.where("term is null").select("field", F.col("n_records").alias("total"))
        x = sums.where("term is not null").join(totals, "field")
        rare, common = F.col("n_records") < min_records, F.coalesce(F.col("n_records") > limit * F.col("total"), F.lit(False))
        mark = F.when(rare & common, "both").when(rare, "rare").when(common, "common")
        return x.select("field", "term", "n_rows", "n_records", mark.alias("mark"))
