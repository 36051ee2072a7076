"""Session building, shared scratch space and parallelism helpers."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SCRATCH: list[str] = []
_SHIPPED: dict[str, str] = {}


def build_session(app: str = "knowloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; `conf` overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they needn't have it on their path."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="knowloom-code-")  # on the driver only; Spark copies the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/knowloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(f"{folder}/knowloom.zip")
    _SHIPPED["app"] = sc.applicationId


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where that is unset on a single machine (local masters, as in tests) a temporary folder of this process is used instead.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH["dir"] = tempfile.mkdtemp(prefix="knowloom-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH["dir"], True)
    return "file://" + _LOCAL_SCRATCH["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/knowloom-{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(clean_scratch, spark)
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this process. Runs at its end; call it earlier once results were read."""
    try:
        for path in _SCRATCH:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _SCRATCH.clear()
    except Exception:  # noqa: BLE001
        pass  # the session is gone already


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once into the shared folder and read it back: later passes and lost executors don't recompute it.

    With partition_by, rows are rebalanced first: few files per value, and a value with many rows is split over several tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def row_count(df: DataFrame) -> int:
    """Row count; over a bare Parquet scan Spark answers it from the file footers."""
    return df.count()


def scan_partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, key: str, rows_per_task: int, rows: int | None = None) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks when a table is stored in few files.

    Leaves the plan alone when the scan has a partition for every core: texts aren't shuffled to make tasks smaller.
    """
    spark = df.sparkSession
    rows = row_count(df) if rows is None else rows
    want = max(min(2 * cores(spark), math.ceil(rows / 500)), math.ceil(rows / rows_per_task), 1)
    return df if scan_partitions(df) >= min(want, cores(spark)) else df.repartition(want, key)
