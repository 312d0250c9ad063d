"""Majorities, votes and relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemline.operators.geo import tile_membership, with_voxels
from stemline.operators.metrics import most_frequent

VOXEL = ["scan_id", "vx", "vy", "vz"]


def voxel_majority(points: DataFrame, label: str, size: int = 20) -> DataFrame:
    """The most frequent label of each voxel, the smaller on a tie."""
    return most_frequent(with_voxels(points, size), VOXEL, label, label).select(*VOXEL, label)


def voxel_instance_halves(points: DataFrame, size: int = 20) -> DataFrame:
    """(voxel, instance): true trees that hold more than half of a voxel's points."""
    cell = with_voxels(points, size).groupBy(*VOXEL, "instance_gt").agg(F.count(F.lit(1)).alias("n"))
    total = cell.groupBy(*VOXEL).agg(F.sum("n").alias("n_all"), F.max_by("instance_gt", "n").alias("instance_gt"), F.max("n").alias("n"))
    # only the largest can hold more than half
    return total.where((2 * F.col("n") > F.col("n_all")) & (F.col("instance_gt") > 0)).select(*VOXEL, "instance_gt")


def foreground_voxels(points: DataFrame, size: int = 20) -> DataFrame:
    cell = with_voxels(points, size).groupBy(*VOXEL).agg(F.count_if(F.col("instance_gt") > 0).alias("fg"), F.count(F.lit(1)).alias("n"))
    return cell.select(*VOXEL, (2 * F.col("fg") > F.col("n")).alias("foreground"))


def semantic_masks(points: DataFrame, size: int = 20, classes=(0, 1, 2)) -> DataFrame:
    """Voxel by voxel, a flag for each class: is it the voxel's most frequent?"""
    one = voxel_majority(points, "semantic_gt", size)
    return one.select(*VOXEL, *[(F.col("semantic_gt") == c).cast("int").alias(f"c{c}") for c in classes])


def superpoint_markup(points: DataFrame, size: int = 20) -> DataFrame:
    """Per voxel and class: do more than half of the points have it? Voxels that no class covers are unlabelled."""
    n = F.count(F.lit(1))
    flags = [(2 * F.count_if(F.col("semantic_gt") == c) > n).cast("int").alias(f"c{c}") for c in (0, 1, 2)]
    cell = with_voxels(points, size).groupBy(*VOXEL).agg(*flags)
    return cell.withColumn("unlabelled", (F.col("c0") + F.col("c1") + F.col("c2") == 0).cast("int"))


def vote_offsets(points: DataFrame, size: int = 20) -> DataFrame:
    """Mean offset from its points to the tree's centre, of each voxel's most frequent tree."""
    centre = points.where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(*[(F.sum(a) / F.count(F.lit(1))).alias("m" + a[0]) for a in ("x_cm", "y_cm", "z_cm")])
    cell = with_voxels(points, size).groupBy(*VOXEL, "instance_gt").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias("s" + a[0]) for a in ("x_cm", "y_cm", "z_cm")])
    main = cell.groupBy(*VOXEL).agg(F.max_by(F.struct("instance_gt", "n", "sx", "sy", "sz"), F.struct(F.col("n"), -F.col("instance_gt"))).alias("m")).select(*VOXEL, "m.*")
    return main.join(centre, ["scan_id", "instance_gt"]).select(*VOXEL, "instance_gt", *[F.round(F.col("m" + a) - F.col("s" + a) / F.col("n"), 6).alias("o" + a) for a in "xyz"])


def tile_votes(points: DataFrame, votes: DataFrame, classes: int = 3, first_seen: bool = False) -> DataFrame:
    """Class that most tiles vote for, votes(scan_id, point_id, region_id, vote), point by point; -1 without a vote.

    Votes are counted class by class in one aggregate. Ties go to the smaller class, or to the one that the tile with the smallest id votes for (first_seen).
    """
    n = votes.groupBy("scan_id", "point_id").agg(*[F.count_if(F.col("vote") == c).alias(f"n{c}") for c in range(classes)], *[F.min(F.when(F.col("vote") == c, F.col("region_id"))).alias(f"r{c}") for c in range(classes)])
    rank = [F.struct(F.col(f"n{c}").alias("n"), (-F.col(f"r{c}") if first_seen else F.lit(-c)).cast("bigint").alias("r"), F.lit(c).alias("c")) for c in range(classes)]
    best = F.greatest(*rank)["c"]
    return points.select("scan_id", "point_id").join(n.withColumn("voted", best), ["scan_id", "point_id"], "left").select("scan_id", "point_id", F.coalesce("voted", F.lit(-1)).alias("semantic"))


def dense_relabel(points: DataFrame, instance: str = "instance_pred", into: str = "dense_id") -> DataFrame:
    """Instance ids of a scan renumbered from 0 in ascending order; -1 stays. Ranks are given to the distinct ids and joined back."""
    ids = points.where(F.col(instance) >= 0).select("scan_id", instance).distinct()
    ids = ids.withColumn(into, (F.row_number().over(Window.partitionBy("scan_id").orderBy(instance)) - 1).cast("bigint"))
    return points.join(ids, ["scan_id", instance], "left").select("scan_id", "point_id", F.coalesce(into, F.lit(-1).cast("bigint")).alias(into))


def drop_small(points: DataFrame, least: int = 10, instance: str = "instance_pred") -> DataFrame:
    """Instances of fewer than `least` points become unassigned."""
    n = points.groupBy("scan_id", instance).agg(F.count(F.lit(1)).alias("n"))
    return points.join(n, ["scan_id", instance]).select("scan_id", "point_id", F.when(F.col("n") < least, -1).otherwise(F.col(instance)).cast("bigint").alias(instance))


def ground_mask_out(points: DataFrame) -> DataFrame:
    return points.select("scan_id", "point_id", F.when(F.col("semantic_pred") == 0, -1).otherwise(F.col("instance_pred")).cast("bigint").alias("instance_pred"))


def label_shift(points: DataFrame) -> DataFrame:
    """Labels as stored (from 1 on) turned into labels from 0 on, with ground's instance 0."""
    stored = points.select("scan_id", "point_id", (F.col("semantic_gt") + 1).alias("s"), "instance_gt")
    return stored.select("scan_id", "point_id", (F.col("s") - 1).alias("semantic"), F.when(F.col("s") == 1, 0).otherwise(F.col("instance_gt")).cast("bigint").alias("instance"))


def first_label(points: DataFrame) -> DataFrame:
    """Dense id and the class of the first point of each true tree, in scans with two trees at least."""
    one = points.where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(F.min_by("semantic_gt", "point_id").alias("semantic"))
    part = Window.partitionBy("scan_id")
    one = one.withColumn("dense_id", (F.row_number().over(part.orderBy("instance_gt")) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(part))
    return one.where("n >= 2").drop("n")


def named_instances(points: DataFrame) -> DataFrame:
    """Evaluation names of true trees: 1000 times the smallest class of the tree plus its id."""
    one = points.where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(F.min("semantic_gt").alias("c"))
    return one.select("scan_id", "instance_gt", (F.col("c") * 1000 + F.col("instance_gt")).cast("bigint").alias("name"))


def swap_classes(points: DataFrame, a: int = 1, b: int = 2) -> DataFrame:
    c = F.col("semantic_gt")
    return points.select("scan_id", "point_id", F.when(c == a, b).when(c == b, a).otherwise(c).cast("int").alias("semantic_gt"))


def split_leftovers(points: DataFrame) -> DataFrame:
    """Points by where they go next: left over (a tree class, no instance) or kept."""
    left = (F.col("semantic_pred") != 0) & (F.col("instance_pred") == -1)
    return points.select("scan_id", "point_id", F.when(left, "left").otherwise("kept").alias("part"))


def union_rounds(points: DataFrame) -> DataFrame:
    """Rounds one after another: a round's instances are numbered on from the largest id so far, and unassigned ones stay -1.

    Rounds stand in for files: scan_id is the round here. One row a round is summed in order.
    """
    top = points.groupBy("scan_id").agg((F.max("instance_pred") + 1).alias("room"))
    before = Window.partitionBy(F.lit(0)).orderBy("scan_id").rowsBetween(Window.unboundedPreceding, -1)
    base = top.select("scan_id", F.coalesce(F.sum("room").over(before), F.lit(0)).alias("base"))
    i = F.col("instance_pred")
    return points.join(base, "scan_id").select("point_id", F.when(i >= 0, i + F.col("base")).otherwise(i).cast("bigint").alias("instance_pred"))
