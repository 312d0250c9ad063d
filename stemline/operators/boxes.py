"""Boxes: range and name filters, points between a box and a larger one, sampled boxes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.operators.geo import points_in_rotated_box


def in_range(boxes: DataFrame, low=(1000, 1000), high=(5000, 5000)) -> DataFrame:
    """Boxes whose centre lies in a range seen from above, their yaw brought into -pi..pi."""
    yaw = F.pmod(F.col("yaw") + math.pi, F.lit(2 * math.pi)) - math.pi
    return boxes.where((F.col("cx") > low[0]) & (F.col("cx") < high[0]) & (F.col("cy") > low[1]) & (F.col("cy") < high[1])).withColumn("yaw", F.round(yaw, 6))


def of_classes(boxes: DataFrame, classes) -> DataFrame:
    return boxes.where(F.col("class").isin(*classes))


def enlarged(boxes: DataFrame, by: float) -> DataFrame:
    return boxes.withColumns({f"d{a}": F.col(f"d{a}") + 2 * by for a in "xyz"})


def without_margin(points: DataFrame, boxes: DataFrame, by: float = 50.0) -> DataFrame:
    """points without those in an enlarged box but in no box itself."""
    key = ["scan_id", "point_id"]
    near = points_in_rotated_box(points, enlarged(boxes, by)).select(*key).distinct()
    inside = points_in_rotated_box(points, boxes).select(*key).distinct()
    return points.join(near.join(inside, key, "left_anti"), key, "left_anti")


def without_inside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points without those in any box (room for sampled objects)."""
    key = ["scan_id", "point_id"]
    return points.join(points_in_rotated_box(points, boxes).select(*key).distinct(), key, "left_anti")


def with_objects(points: DataFrame, boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """A scene with sampled objects put in: what stands in their boxes goes, their points come."""
    return without_inside(points, boxes).select("scan_id", "point_id", "instance_gt").unionByName(objects.select("scan_id", "point_id", "instance_gt"))


def route(rows: DataFrame, name: str, prefixes: dict[str, str], into: str = "head") -> DataFrame:
    """The head that a row's name calls for, by the first prefix that the name contains; rows without one are an error's name."""
    out = F.lit("unknown dataset")
    for prefix, head in reversed(list(prefixes.items())):
        out = F.when(F.col(name).contains(prefix), head).otherwise(out)
    return rows.withColumn(into, out)


def region_merge(tiles: DataFrame, least: float = 0.3) -> DataFrame:
    """(scan_id, point_id, label) from tiles(scan_id, region_id, point_id, local): tile after tile, a local instance takes the label of the one so far with which it shares most, if
    over `least` of either, else a new label. Each tile hangs on those before it, so a scan is one task's.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label: dict[int, int] = {}
        size: dict[int, int] = {}
        fresh = 0
        for _, rows in pdf.sort_values(["region_id", "local", "point_id"]).groupby(["region_id", "local"], sort=False):
            held = rows["point_id"].tolist()
            shared: dict[int, int] = {}
            for p in held:
                if p in label:
                    shared[label[p]] = shared.get(label[p], 0) + 1
            best = max(shared, key=lambda k: (max(shared[k] / size[k], shared[k] / len(held)), -k), default=None)
            if best is None or max(shared[best] / size[best], shared[best] / len(held)) <= least:
                best, fresh = fresh, fresh + 1
            for p in held:
                if p not in label:
                    label[p] = best
                    size[best] = size.get(best, 0) + 1
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "point_id": list(label), "label": list(label.values())})

    return tiles.groupBy("scan_id").applyInPandas(run, "scan_id int, point_id bigint, label bigint")


def chain(df: DataFrame, steps: list[tuple[str, dict]], known: dict[str, Callable]) -> DataFrame:
    """A pipeline named by strings: each step a registered function and its arguments."""
    for name, how in steps:
        if name not in known:
            raise KeyError(f"{name} is not registered")
        df = df.transform(known[name], **how)
    return df
