"""Batches, patches, pooled features and reductions of training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemline.operators.geo import with_voxels


def batch_offsets(points: DataFrame, size: int = 20) -> DataFrame:
    """Voxels of each scan and where its voxels start when scans are laid end to end."""
    n = with_voxels(points, size).groupBy("scan_id").agg(F.count_distinct("vx", "vy", "vz").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("scan_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a scan
    return n.select("scan_id", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def pooled(points: DataFrame, features: list[F.Column], size: int = 100) -> DataFrame:
    """Means f0, f1, ... of features over a voxel."""
    cell = with_voxels(points, size).groupBy("scan_id", "vx", "vy", "vz")
    return cell.agg(*[F.round(F.sum(f) / F.count(F.lit(1)), 6).alias(f"f{k}") for k, f in enumerate(features)])


def padded_voxel_sample(points: DataFrame, size: int = 300, voxels: int = 40, per_voxel: int = 5) -> DataFrame:
    """per_voxel points of each of the first `voxels` voxels of a scan; too few voxels are made up by the first one."""
    p = with_voxels(points, size)
    key = ["scan_id", "vx", "vy", "vz"]
    cells = p.select(*key).distinct().withColumn("slot", F.row_number().over(Window.partitionBy("scan_id").orderBy("vx", "vy", "vz")) - 1)
    kept = cells.where(F.col("slot") < voxels)
    have = kept.groupBy("scan_id").agg(F.count(F.lit(1)).alias("have"))
    first = kept.where("slot = 0").join(have, "scan_id").where(F.col("have") < voxels)
    pad = first.withColumn("slot", F.explode(F.sequence(F.col("have"), F.lit(voxels - 1).cast("bigint")))).select(*key, F.col("slot").cast("int").alias("slot"))
    ranked = p.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("point_id"))).where(F.col("k") <= per_voxel).select(*key, "point_id")
    return kept.unionByName(pad).join(ranked, key).select("scan_id", "slot", "point_id")


def patches(points: DataFrame, size: int = 800, least_occupied: int = 20, least_labelled: float = 0.7) -> DataFrame:
    """Square patches with enough occupied 50 cm voxels and a large enough share of points of a tree or ground class."""
    p = points.select("scan_id", F.floor(F.col("x_cm") / size).alias("px"), F.floor(F.col("y_cm") / size).alias("py"), "instance_gt", *[F.floor(F.col(f"{a}_cm") / 50).alias("v" + a) for a in "xyz"])
    one = p.groupBy("scan_id", "px", "py").agg(F.count_distinct("vx", "vy", "vz").alias("occupied"), F.round(F.count_if(F.col("instance_gt") > 0) / F.count(F.lit(1)), 6).alias("labelled"))
    return one.where((F.col("occupied") >= least_occupied) & (F.col("labelled") >= least_labelled))


def instance_ordinals(masks: DataFrame, least: int = 20) -> DataFrame:
    """masks(scan_id, mask_id, label, score_pct) that are saved on their own: score at least `least`, numbered within their label."""
    some = masks.where(F.col("score_pct") >= least)
    order = Window.partitionBy("scan_id", "label").orderBy("mask_id")
    return some.select("scan_id", "mask_id", "label", (F.row_number().over(order) - 1).alias("ordinal"))


def loss_sum(losses: DataFrame) -> DataFrame:
    """losses(step, key, value): the mean of each key's values, and their sum over the keys that name a loss."""
    one = losses.groupBy("step", "key").agg(F.avg("value").alias("v"))
    return one.groupBy("step").agg(F.round(F.sum(F.when(F.col("key").contains("loss"), F.col("v"))), 6).alias("total"), F.count(F.lit(1)).alias("keys"))


def mask_loss(mask_points: DataFrame, matches: DataFrame, points: DataFrame) -> DataFrame:
    """Cross-entropy of mask values, the probabilities p of mask_points, against the best true tree, over masks whose best IoU exceeds one half."""
    best = matches.groupBy("scan_id", "mask_id").agg(F.max_by(F.struct("instance_gt", "iou"), F.struct(F.col("iou"), -F.col("instance_gt"))).alias("b")).select("scan_id", "mask_id", F.col("b.instance_gt").alias("best"), F.col("b.iou").alias("iou")).where("iou > 0.5")
    p = F.col("p") * 0.99
    rows = mask_points.join(best, ["scan_id", "mask_id"]).join(points.select("scan_id", "point_id", "instance_gt"), ["scan_id", "point_id"])
    return rows.groupBy("scan_id").agg(F.round(F.avg(F.when(F.col("instance_gt") == F.col("best"), -F.log(p)).otherwise(-F.log(1 - p))), 5).alias("loss"), F.count(F.lit(1)).alias("n"))


def semantic_decode(points: DataFrame, values: list[str]) -> DataFrame:
    """Number of the largest of a point's class values (columns); ties go to the smaller class."""
    best = F.greatest(*values)
    return points.select("scan_id", "point_id", F.coalesce(*[F.when(F.col(v) == best, k) for k, v in enumerate(values)]).alias("semantic"))
