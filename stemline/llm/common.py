"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids, digests and counts that may be broadcast: 80 bytes each, so 20 MB at most; and copies of each where there are more.
BROADCAST_ROWS, SALT = 250_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a worker made under this key before; it keeps one such thing, so that operators of a pipeline don't pile up their models."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what the worker holds for other operators, and give its memory back: freed blocks of the C heap and of Arrow's pool otherwise stay with the worker."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def placed(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df written by checkpoint, dealt out and sorted by key, so that joins with it leave it where it is.

    What an adaptive plan's partitioning will be isn't known when it is written, so this one isn't adaptive.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpoint(df.repartition(parts, key).sortWithinPartitions(key))
    finally:
        conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share: the one the session names in spark.checkpoint.dir.

    Only where driver and executors are one process (tests) may it be unset, and a temporary folder is chosen; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stemline-"))
    return sc.getCheckpointDir()


def meet(rows: DataFrame, few: DataFrame, on: list[tuple[str, str]], how: str = "left") -> DataFrame:
    """rows joined to few, whose keys are unique, when any key may be a third of all rows.

    Up to BROADCAST_ROWS rows of few are broadcast. More are repeated SALT times and met by key and salt, so that no
    key is one task's. few should be written already; how: left, left_anti or left_semi.
    """
    if few.count() <= BROADCAST_ROWS:
        few, same = F.broadcast(few), F.lit(True)
    else:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALT))
        rows = rows.withColumn("_salt", salt)
        few = few.withColumn("_salted", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        same = F.col("_salt") == F.col("_salted")
    for left, right in on:
        same = same & F.col(left).eqNullSafe(F.col(right))
    return rows.join(few, same, how).drop("_salt", "_salted")


def row_id(id_col: str, text: Column) -> Column:
    """The id; where it is null, one behind all others that only equal texts share."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def drop_rows(docs: DataFrame, row: Column, digest: Column, dropped: DataFrame, again: DataFrame) -> DataFrame:
    """docs without the rows whose (row, digest) is in dropped(row, digest), and with one of those in again(row, digest), which occur several times.

    A row goes by its id and its text: another text of the same id stays.
    """
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # whatever the columns are called
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], row, digest).toDF(*inner, "_row", "_digest")
    gone = checkpoint(dropped.select(F.col("row").alias("_r"), F.col("digest").alias("_d")).distinct())
    kept = meet(keyed, gone, [("_row", "_r"), ("_digest", "_d")], "left_anti")
    again = checkpoint(again.select(F.col("row").alias("_r"), F.col("digest").alias("_d")).distinct())
    if not again.isEmpty():
        once = meet(kept, again, [("_row", "_r"), ("_digest", "_d")], "left_semi").dropDuplicates(["_row", "_digest"])
        kept = meet(kept, again, [("_row", "_r"), ("_digest", "_d")], "left_anti").unionByName(once)
    return kept.select(*inner).toDF(*names)


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
