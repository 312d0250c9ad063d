"""Scans as raw arrays: .npy files, and .bin files of little-endian floats or labels."""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _rows(path: str, data: np.ndarray, columns: list[str]) -> pd.DataFrame:
    data = data.reshape(len(data), -1)
    out = {"scan_id": os.path.basename(path).rsplit(".", 1)[0], "point_id": np.arange(len(data))}
    return pd.DataFrame(out | {c: data[:, k] for k, c in enumerate(columns)})


def read_npy(spark: SparkSession, path: str, columns: list[str], kind: str = "double") -> DataFrame:
    """One row for each row of the arrays at path."""

    def run(parts):
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield _rows(name, np.load(io.BytesIO(content), allow_pickle=False), columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(["scan_id string", "point_id bigint", *(f"{c} {kind}" for c in columns)]))


def read_bin(spark: SparkSession, path: str, columns: list[str], dtype: str = "<f4", use: list[int] | None = None, load: int | None = None) -> DataFrame:
    """Rows of `load` values each, of which the places in `use` are kept."""
    width, kind = load or len(columns), "bigint" if dtype.endswith("i8") else "float"

    def run(parts):
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"]):
                data = np.frombuffer(content, dtype).reshape(-1, width)
                yield _rows(name, data[:, use] if use else data, columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(["scan_id string", "point_id bigint", *(f"{c} {kind}" for c in columns)]))


def read_superpoints(spark: SparkSession, path: str, fallback: str | None = None, dtype: str = "<i8") -> DataFrame:
    """(scan_id, point_id, superpoint) from .bin files at path; where there are none, from those at fallback."""
    from stemline.sources.store import listing

    found = bool(listing(path, "*.bin"))
    if not found and fallback is None:
        raise FileNotFoundError(f"no superpoint files at {path}")
    return read_bin(spark, path if found else fallback, ["superpoint"], dtype)


def with_superpoints(points: DataFrame, superpoints: DataFrame) -> DataFrame:
    """points with the superpoint of each as one more column."""
    return points.join(superpoints, ["scan_id", "point_id"], "left")
