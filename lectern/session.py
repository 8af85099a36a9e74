"""Session plumbing: table loading, shared checkpoints and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] in ("local", "local-cluster")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is named, a private one in local mode (tests), an error on a cluster, whose executors share no private folder.

    What was checkpointed is removed once nothing refers to it any more."""
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table read in fewer parts than there are cores, for functions that take long per row. A larger table is read in more parts and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of executors that don't share the driver's PYTHONPATH."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_lectern_shipped", False):
        return
    fd, archive = tempfile.mkstemp(prefix="lectern-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_ROOT.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(_ROOT.parent))
    sc.addPyFile(archive)
    sc._lectern_shipped = True
