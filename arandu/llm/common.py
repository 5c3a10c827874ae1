"""Helpers shared by the operators: shared-folder tables, bounded samples, guarded broadcasts, what a worker holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where tables of a run in local mode go if spark.checkpoint.dir is unset.
LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local run gets a folder
    of this machine; a cluster has none that all its machines see, so that the setting is asked for."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master})")
        where = LOCAL_DIR
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path)."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder. It is deleted when the driver ends, also after a
    failure; clean() deletes it earlier."""
    where = f"{shared_dir(spark)}/arandu-{spark.sparkContext.applicationId}"
    fs, path = _path(spark, where)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return where


def clean(spark: SparkSession) -> None:
    """Delete all tables that stored() has left. Call it once the results read from them have been written."""
    fs, path = _path(spark, f"{shared_dir(spark)}/arandu-{spark.sparkContext.applicationId}")
    fs.delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing reads any more."""
    for t in tables:
        fs, path = _path(t.sparkSession, t._stored_path)
        fs.delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % folds


def sample_hash(*keys: Column) -> Column:
    """A hash of the keys, uniform on 0 .. 2**63 - 1, always the same; nulls count as one key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *keys), 1)


def hash_fraction(fraction: float | Column, *keys: Column) -> Column:
    """True for about that fraction of keys, always the same ones. Fractions as small as 1e-18 still choose their share."""
    if isinstance(fraction, Column):
        return sample_hash(*keys) < F.least(fraction * float(1 << 63), F.lit(float(1 << 63)))
    return F.lit(True) if fraction >= 1 else sample_hash(*keys) < F.lit(int(fraction * (1 << 63)))


def bounded(df: DataFrame, most: int, *keys: Column) -> DataFrame:
    """At most `most` rows of df: all if there are no more, else those of the smallest hashes of the keys.

    Rows with equal keys have equal hashes; of those at the limit as many stay as there is room for, so that the bound
    holds however often a key repeats. Give all columns as keys where which of them stay must not matter.
    """
    n = df.count()
    if n <= most:
        return df
    name = free_name(df, "sample_hash")
    hashes = df.select(sample_hash(*keys).alias(name)).where(F.col(name) < F.lit(int(min(1, 4 * (most + 100) / n) * ((1 << 63) - 1))))
    limit = hashes.orderBy(name).limit(most).agg(F.max(name)).first()[0]
    if limit is None:  # one key with nearly all rows, beyond the first share
        limit = df.select(sample_hash(*keys).alias(name)).agg(F.min(name)).first()[0]
    rows = df.withColumn(name, sample_hash(*keys))
    below = rows.where(F.col(name) < limit)
    room = most - below.count()
    return below.unionByName(rows.where(F.col(name) == limit).limit(max(0, room))).drop(name)


def small_side(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if its rows, as counted or as bounded() holds them, are at most `most` narrow ones; else df for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


#: What this process holds, and the task that used it last (None: the driver).
_held: dict[Hashable, Any] = {}
_used_by: dict[Hashable, int | None] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, made once in a worker process and held from task to task.

    A task lets go of what only earlier tasks have used, so that a worker that serves one operator after another holds
    what the running one has learned, not the sum of all.
    """
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if key not in _held or _used_by[key] != task:
        for k in [k for k, t in _used_by.items() if t != task and k != key]:
            del _held[k], _used_by[k]
        if key not in _held:
            _held[key] = make()
        _used_by[key] = task
    return _held[key]
