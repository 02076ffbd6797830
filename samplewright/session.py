"""Session helpers: table access, lineage cuts in the shared folder, size-checked lookups."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, unless they find it by themselves.

    Workers of a local session see the driver's folder and PYTHONPATH; those of a cluster may have neither.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    home = os.path.dirname(package)
    seen = {os.path.abspath(p) for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]}
    if context.master.startswith("local") and not context.master.startswith("local-cluster") and home in seen:
        return
    made = tempfile.mkdtemp(prefix="samplewright-code-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(f"{made}/samplewright.zip", "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), home))
    context.addPyFile(f"{made}/samplewright.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster the setting is required, because a machine-local folder dies with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # set on the context by setCheckpointDir
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        made = tempfile.mkdtemp(prefix="samplewright-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL_DIRS[app] = f"file://{made}"
    return _LOCAL_DIRS[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for what this application stores; :func:`release` deletes it."""
    return f"{shared_dir(spark)}/samplewright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage once, computes the plan once (``checkpoint`` computes it twice), keeps column
    pruning and filter pushdown for later readers, and survives the loss of any executor.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let the shuffle files of finished queries go now: Spark deletes them when the driver collects what refers to them, which otherwise is when its heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every settled table of this application; results that read them are gone then."""
    path = f"{shared_dir(spark)}/samplewright/{spark.sparkContext.applicationId}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def arrow_files(folder: str) -> tuple[object, str]:
    """Arrow's file system and path for a folder that Spark names by a URI or a plain path; for tasks that read or write single files."""
    from pyarrow import fs

    if ":/" in folder:
        return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, counting no further than that."""
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, for sides that grow with the input.

    The planner goes by the size of compressed files and counts neither exploded rows nor those that ``mapInArrow`` adds, so
    what it takes for less than the threshold may be gigabytes when it reaches the driver.
    """
    return df.hint("merge")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join a table with hot keys to one row per key.

    The small side is broadcast only after its rows were counted; a larger one is repeated under
    ``salts`` salts and the big side spread over them by ``spread``, so no key meets one task.
    """
    if at_most(small, rows):
        return big.join(F.broadcast(small), list(on), how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


def parallel(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Spread rows for CPU-heavy Python stages when the scan gave fewer tasks than cores can use."""
    ship(df.sparkSession)
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
