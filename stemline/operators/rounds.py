"""Rounds over what is left without an instance, and a scoring model as a plug-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.operators.lineage import hold


def score_with(points: DataFrame, model: Callable, by: list[str], schema: str) -> DataFrame:
    """What model(pdf) -> pdf returns for each group of points: a tile, a scan. Any network hides behind such a function."""
    return points.groupBy(*by).applyInPandas(model, schema)


def iterate(points: DataFrame, assign: Callable[[DataFrame, int], DataFrame], rounds: int = 2) -> DataFrame:
    """(scan_id, point_id, instance): assign(leftovers, round) gives instances (-1: none) round after round, to what is still left.

    Ids of a round start after the largest of the rounds before. It ends early when nothing is left or nothing new is found. Each round is written
    to the checkpoint folder, so that a lost executor repeats one round at most.
    """
    left, done, base = points, None, 0
    for k in range(rounds):
        got = hold(assign(left, k).select("scan_id", "point_id", F.when(F.col("instance") >= 0, F.col("instance") + base).otherwise(-1).cast("bigint").alias("instance")))
        new = got.where("instance >= 0")
        top = new.agg(F.max("instance")).first()[0]
        if top is None:
            break
        done, base = (new if done is None else done.unionByName(new)), top + 1
        left = hold(left.join(new, ["scan_id", "point_id"], "left_anti"))
        if left.isEmpty():
            break
    rest = left.select("scan_id", "point_id", F.lit(-1).cast("bigint").alias("instance"))
    return rest if done is None else done.unionByName(rest)
