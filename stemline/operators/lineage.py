"""Cutting the lineage of iterations."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def hold(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, which the session names in spark.checkpoint.dir; a cluster has to name one, a single process may go without."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stemline-"))
    return df.checkpoint()
