"""Parquet generations: every run writes a new folder and is published by renaming a pointer; while it is replaced, the previous one holds.

A generation counts only if the pointer names it, so a run that fails leaves the published one as it was; recover() removes what no pointer names. Written tables are
partitioned or clustered by the caller. Paths may be on any file system Hadoop knows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

POINTER, PREVIOUS = "current.json", "previous.json"


def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def reserve(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/generation={uuid.uuid4().hex}"


def write(df: DataFrame, generation: str, name: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{generation}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    fs, Path = _fs(spark, path)
    fs.delete(Path(path), True)


def write_json(spark: SparkSession, path: str, value) -> None:
    """Replace a small JSON file: written beside it first, so a reader finds the old or the new one."""
    fs, Path = _fs(spark, path)
    work = Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(work, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs.delete(Path(path), False)
    if not fs.rename(work, Path(path)):
        raise OSError(f"{path} could not be replaced")


def read_json(spark: SparkSession, path: str):
    """None where there is none or it can't be read; one that can't be read is set aside, not overwritten."""
    fs, Path = _fs(spark, path)
    if not fs.exists(Path(path)):
        return None
    try:
        return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    except (ValueError, PySparkException, Py4JJavaError):
        fs.rename(Path(path), Path(f"{path}.quarantined-{uuid.uuid4().hex}"))
        return None


def token(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()


def publish(spark: SparkSession, root: str, generation: str, required: dict[str, int]) -> dict:
    """Validate that every required table has at least so many rows, then point to the generation."""
    for name, least in required.items():
        n = spark.read.parquet(f"{generation}/{name}").limit(max(1, least)).count() if least else 0
        if n < least:
            raise ValueError(f"{name} has {n} rows, {least} are required")
    manifest = {"generation": generation, "tables": sorted(required)}
    manifest["token"] = token(manifest)
    fs, Path = _fs(spark, root)
    work = Path(f"{root}/.{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(work, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    target = Path(f"{root}/{POINTER}")
    if fs.exists(target):  # two renames: between them the previous pointer stands for the missing one, see current()
        fs.delete(Path(f"{root}/{PREVIOUS}"), False)
        fs.rename(target, Path(f"{root}/{PREVIOUS}"))
    if not fs.rename(work, target):
        raise OSError("the pointer could not be replaced")
    return manifest


def _read(spark: SparkSession, path: str) -> dict | None:
    """A manifest; None if it is missing, can't be read or isn't what was written."""
    fs, Path = _fs(spark, path)
    if not fs.exists(Path(path)):
        return None
    try:
        m = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
        return m if m["token"] == token({k: m[k] for k in ("generation", "tables")}) else None
    except (ValueError, KeyError, TypeError, PySparkException, Py4JJavaError):  # a checksum that doesn't fit comes as either of the last two
        return None


def current(spark: SparkSession, root: str) -> dict | None:
    """The published manifest; the previous one where the pointer is missing or damaged; None if there is none."""
    return _read(spark, f"{root}/{POINTER}") or _read(spark, f"{root}/{PREVIOUS}")


def recover(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove generations that no pointer names; the published one and the last before it stay."""
    fs, Path = _fs(spark, root)
    found = [current(spark, root), _read(spark, f"{root}/{PREVIOUS}") if keep else None]
    named = {m["generation"].rstrip("/").rsplit("/", 1)[-1] for m in found if m}
    gone = []
    for s in fs.listStatus(Path(root)):
        name = s.getPath().getName()
        if name.startswith("generation=") and name not in named:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone


def change_report(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, deleted, modified or unchanged."""
    a, b = before.select(F.col(key).alias("key"), F.col(value).alias("a"), F.lit(1).alias("in_a")), after.select(F.col(key).alias("key"), F.col(value).alias("b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("modified")
    return a.join(b, "key", "full").select("key", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of new; where key and version are as in old, the old row, so its computed columns are kept. Keys that new lacks go."""
    same = new.select(key, version)
    kept = old.join(same, [key, version], "left_semi")
    changed = new.join(old.select(key, version), [key, version], "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


def prune(history: DataFrame, key: str, at: str, keep: int = 100, days: int = 180, now: str | None = None) -> DataFrame:
    """The newest `keep` rows not older than `days`."""
    ref = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return history.filter(F.col(at) >= ref - F.make_dt_interval(F.lit(days))).orderBy(F.desc(at), F.desc(key)).limit(keep)
