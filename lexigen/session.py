"""Session helpers: a local session for tests and bench, the shared checkpoint
folder, and shipping this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PKG_DIR = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lexigen") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Unset, a local session (one machine) gets a fresh temporary folder; on a cluster
    that would scatter the files over the machines, so it is an error there."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lexigen-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a DataFrame over the cluster's cores when it has fewer
    partitions than that (a small file read as one split); a no-op for
    inputs that already split into enough tasks, as large inputs do.

    Meant for scans: counting the partitions of a plan that contains a
    shuffle would run that shuffle early."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


TASK_ROWS = 4000  # rows of text that one task works on


def dealt(df: DataFrame, n_rows: int) -> DataFrame:
    """``df``, with about ``n_rows`` rows, dealt evenly over tasks of at most ``TASK_ROWS``; up to that many rows stay where they are.

    What a join leaves in a task goes by bytes and by how its sides were read, so costly work on each row may
    end up in one task. Here the number of tasks grows with the input and a task's time and memory do not."""
    if n_rows <= TASK_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/lexigen/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage so an expensive or non-deterministic step (generation)
    never reruns when a later stage or a lost executor replays the plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexigen`` importable in Python workers (once per SparkContext)."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="lexigen-pkg-"), "lexigen.zip")
    root = os.path.dirname(_PKG_DIR)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(_PKG_DIR):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
