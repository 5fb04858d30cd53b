"""Where intermediate tables live, and how long lineages are cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A folder of this machine is made only where the
    session names none, as in tests in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hitweave-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/hitweave-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that cut() has written in this session; results still based on them can't be read after."""
    jvm = spark._jvm
    for s, path in [x for x in _made if x[0] is spark]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove((s, path))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="hitweave-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "hitweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The named tables of a folder of Parquet tables."""
    ship(spark)
    dfs = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return dfs[0] if len(dfs) == 1 else dfs
