"""Sinks of one file a scan: arrays, metric logs, and the split of what is assigned from what is left over.

All files go to a file system that driver and executors share. A file is written under a name of its own attempt and then
given its own; lost executors and second attempts leave no mixed files. Rows are streamed, a batch at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.sources.store import store


def _npy_head(rows: int, columns: int, dtype: str) -> bytes:
    import io

    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": (rows, columns)})
    return out.getvalue()


def write_arrays(rows: DataFrame, folder: str, columns: list[str], by: str = "scan_id", order: str = "point_id", kind: str = "npy", dtype: str = "<f4") -> DataFrame:
    """A .npy or .bin file for each value of `by`, its rows in the given order; returns (file, rows)."""
    n = rows.groupBy(F.col(by).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    slim = rows.select(F.col(by).cast("string").alias("_by"), F.col(order).alias("_order"), F.col(by).alias("_raw"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    dealt = slim.join(n, F.col("_raw") == F.col("_of")).drop("_of", "_raw").repartition("_by").sortWithinPartitions("_by", "_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, to = store(folder)
        out, name, temp, count, done = None, None, "", 0, []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(temp, f"{to}/{name}.{kind}")
                done.append((f"{name}.{kind}", count))

        for batch in batches:
            keys = batch["_by"].to_pylist()
            data = np.column_stack([batch[f"c{k}"].to_numpy(zero_copy_only=False).astype(dtype) for k in range(len(columns))])
            at = 0
            while at < len(keys):
                upto = next((k for k in range(at, len(keys)) if keys[k] != keys[at]), len(keys))
                if keys[at] != name:
                    close()
                    name, temp, count = keys[at], f"{to}/.{keys[at]}-{uuid.uuid4().hex}", 0
                    out = system.open_output_stream(temp)
                    if kind == "npy":
                        out.write(_npy_head(batch["_n"][at].as_py(), len(columns), dtype))
                out.write(data[at:upto].tobytes())
                count += upto - at
                at = upto
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["file", "rows"])

    system, to = store(folder)
    system.create_dir(to, recursive=True)
    written = dealt.mapInArrow(run, "file string, rows bigint").collect()  # a row a file
    return rows.sparkSession.createDataFrame([tuple(r) for r in written], "file string, rows bigint")


def write_metric_logs(per_scan: DataFrame, total: DataFrame, folder: str, by: str = "scan_id") -> None:
    """A log for each scan, written anew, and a line of the totals (one row) at the end of total.txt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, to = store(folder)
        n = 0
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_output_stream(f"{to}/{r[by]}.txt") as f:
                    f.write("".join(f"{k}: {v}\n" for k, v in r.items() if k != by).encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    system, to = store(folder)
    system.create_dir(to, recursive=True)
    per_scan.mapInArrow(run, "n bigint").collect()
    line = (json.dumps(total.first().asDict()) + "\n").encode()
    from pyarrow import fs

    if system.get_file_info(f"{to}/total.txt").type == fs.FileType.File:
        with system.open_input_stream(f"{to}/total.txt") as f:
            line = f.read() + line
    with system.open_output_stream(f"{to}/total.txt") as f:
        f.write(line)


def write_split(points: DataFrame, folder: str, turn: int, columns: list[str], base: str = "scan_id", before: DataFrame | None = None) -> None:
    """Points of trees and ground to <base>_<turn>.ply, what is left over (no tree, not ground) to <base>_bluepoints_<turn>.ply, in one pass.

    before: (scan_id, point_id, semantic_pred) of the round before, which goes over the points' own.
    """
    if before is not None:
        old = before.select("scan_id", "point_id", F.col("semantic_pred").alias("_old"))
        points = points.join(old, ["scan_id", "point_id"], "left").withColumn("semantic_pred", F.coalesce("_old", "semantic_pred")).drop("_old")
    left = (F.col("instance_pred") < 0) & (F.col("semantic_pred") != 0)
    file = F.concat_ws("_", F.col(base).cast("string"), F.when(left, F.lit("bluepoints")), F.lit(str(turn)))
    points.select(file.alias("file"), *columns).write.format("ply").option("by", "file").mode("append").save(folder)
