"""Session construction and shared-storage locations.

Everything that has to be written by a job (CSV sinks, partitioned tables, saved models,
checkpoints that cut lineage) goes below the folder the cluster names in
``spark.checkpoint.dir``. Where that setting is absent, a local session (unit tests) gets a
temporary folder, which goes when the driver ends; any other master is refused.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def _local_heap(limit_gb: int = 8) -> str:
    """About 60 % of this machine's memory, capped, for a local-mode driver."""
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("MemTotal"))
        return f"{max(1, min(limit_gb, int(kb * 0.6 / 1024 / 1024)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def build_session(master: str | None = None, app: str = "tidemark",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Session with the settings this library is tuned for.

    * AQE on: coalesces small shuffle partitions, turns sort-merge joins into broadcast
      joins when a side is measured below ``autoBroadcastJoinThreshold`` at run time,
      and splits skewed join partitions.
    * UTC session time zone, so that any ``timestamp`` (with time zone) column renders the
      same everywhere; the driver tables use ``timestamp_ntz`` and are unaffected.
    * UI off (no server is opened).

    Series operators range-partition with the width that adaptive execution starts from,
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` (the shuffle width unless
    set): AQE merges ranges to its advisory size, and it can't split them, so on larger inputs
    raise it until ``input bytes / width`` is below what a task can hold.

    Sizing: locally the shuffle width follows the cores. On a cluster the shuffle starts
    wide (``TIDEMARK_SHUFFLE_PARTITIONS``, default 16000) and AQE coalesces it down to
    ~256 MB partitions; file splits are 512 MB, so a 100 TB scan is ~200k tasks rather
    than ~800k.
    """
    master = master or os.environ.get("TIDEMARK_MASTER") or "local[8]"
    local = master.startswith("local")
    if shuffle_partitions is None:
        default = "8" if local else "16000"
        shuffle_partitions = int(os.environ.get("TIDEMARK_SHUFFLE_PARTITIONS", default))
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # Checkpoint files of intermediate results are removed once unreferenced.
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if local:
        heap = driver_memory or os.environ.get("TIDEMARK_DRIVER_MEMORY") or _local_heap()
        b = b.config("spark.driver.memory", heap)
    else:
        b = (b.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256m")
              .config("spark.sql.files.maxPartitionBytes", "512m"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring one only when none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        # A folder of this machine will do only where every executor is on it.
        if not _one_machine(sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def fit_parts(spark: SparkSession, rows: int, least: int = 10_000) -> int:
    """Parts for rows that are fitted on many times: one for each core, of ``least`` rows or more.
    Adaptive execution merges a table of few bytes into a part or two, and then one core works.
    More parts would not help: each hands on sums of the size of the model."""
    return max(min(spark.sparkContext.defaultParallelism, -(-rows // least)), 1)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path in shared storage for a table or model written by a job."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tidemark-scratch/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written table or model that is no longer needed, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that ``scratch_path`` named in this application. Call it when the results
    that read from there have been used; each application has a folder of its own."""
    drop_path(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-scratch")
