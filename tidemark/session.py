"""Session helpers: shared storage for intermediate tables, and size-checked joins."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Most bytes of an Arrow batch. Spark's own limit suits short rows; here one row may hold a long document.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once, unless they find it by themselves, and bound their Arrow batches.

    They do if it is installed, on PYTHONPATH, or in the folder that the application started in.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if spark.conf.get(_BATCH, None) == "67108864b":  # as Spark has it, not set by the user
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if root in [Path(p).resolve() for p in known if p] or root.is_relative_to(sys.prefix):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    sc.addPyFile(shutil.make_archive(f"{folder}/tidemark", "zip", root, "tidemark"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs one task and not the jobs before it, and
    gives the planner exact sizes for the joins that follow.
    """
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input up to which a table may have fewer row groups than there are cores.
SMALL_BYTES = 128 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """A small table over all cores, for work that is heavy per row; a large one comes in enough splits by itself."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df
