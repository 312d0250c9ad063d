"""The point, mask and vector views that the queries run on, as DataFrames and as SQL.

Coordinates are whole centimetres, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """
select event_id as point_id,
  cast(user_id % 4 as int) as scan_id,
  ((user_id * 397) % 6400) + ((event_id * 31) % 300) as x_cm,
  ((user_id * 811) % 6400) + ((event_id * 57) % 300) as y_cm,
  case when event_type in ('error') then (event_id * 13) % 40 else 20 + (event_id * 29) % 2400 end as z_cm,
  cast(case when event_type = 'error' then 0 when event_id % 3 = 0 then 1 else 2 end as int) as semantic_gt,
  cast(case when event_id % 17 = 0 then 0 when event_type = 'error' then 0 when event_id % 7 = 0 then 1 else 2 end as int) as semantic_pred,
  case when event_type = 'error' then 0 else user_id + 1 end as instance_gt,
  case when event_id % 17 = 0 or event_type = 'error' then -1
       when user_id % 5 = 0 and event_id % 3 = 0 then user_id - (user_id % 5) + 1000
       when user_id % 7 = 0 and event_id % 5 < 3 then user_id + 2000 + event_id % 3
       else user_id end as instance_pred,
  cast(40 + (user_id * 23 + event_id % 2) % 60 as int) as score_pct
from events"""

MASK_POINTS_SQL = """
select scan_id, (instance_gt - 1) * 4 as mask_id, point_id from points where instance_gt > 0 and point_id % 10 < 9
union all
select scan_id, (instance_gt - 1) * 4 + 1 as mask_id, point_id from points where instance_gt > 0 and point_id % 2 = 0
union all
select scan_id, ((instance_gt - 1) - (instance_gt - 1) % 8) * 4 + 2 as mask_id, point_id from points where instance_gt > 0 and point_id % 3 = 0"""

MASKS_SQL = """
select scan_id, mask_id, cast(20 + (mask_id * 37) % 80 as int) as score_pct, count(*) as n_points
from mask_points group by scan_id, mask_id"""

#: Opens every query's SQL.
WITH = f"with points as ({POINTS_SQL}),\nmask_points as ({MASK_POINTS_SQL}),\nmasks as ({MASKS_SQL})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p, u, error = F.col("event_id"), F.col("user_id"), F.col("event_type") == "error"
    blank = p % 17 == 0
    return e.select(
        p.alias("point_id"),
        (u % 4).cast("int").alias("scan_id"),
        (u * 397 % 6400 + p * 31 % 300).alias("x_cm"),
        (u * 811 % 6400 + p * 57 % 300).alias("y_cm"),
        F.when(error, p * 13 % 40).otherwise(20 + p * 29 % 2400).alias("z_cm"),
        F.when(error, 0).when(p % 3 == 0, 1).otherwise(2).cast("int").alias("semantic_gt"),
        F.when(blank | error, 0).when(p % 7 == 0, 1).otherwise(2).cast("int").alias("semantic_pred"),
        F.when(error, 0).otherwise(u + 1).cast("bigint").alias("instance_gt"),
        F.when(blank | error, -1).when((u % 5 == 0) & (p % 3 == 0), u - u % 5 + 1000).when((u % 7 == 0) & (p % 5 < 3), u + 2000 + p % 3).otherwise(u).cast("bigint").alias("instance_pred"),
        (40 + (u * 23 + p % 2) % 60).cast("int").alias("score_pct"),
    )


def mask_points(points: DataFrame) -> DataFrame:
    tree = F.col("instance_gt") - 1
    some = points.where("instance_gt > 0")
    parts = [("point_id % 10 < 9", tree * 4), ("point_id % 2 = 0", tree * 4 + 1), ("point_id % 3 = 0", (tree - tree % 8) * 4 + 2)]
    # one pass: each point names the masks that hold it
    held = F.array_compact(F.array(*[F.when(F.expr(rule), mask) for rule, mask in parts]))
    return some.select("scan_id", F.explode(held).alias("mask_id"), "point_id")


def masks(mask_points: DataFrame) -> DataFrame:
    return mask_points.groupBy("scan_id", "mask_id").agg((20 + F.col("mask_id") * 37 % 80).cast("int").alias("score_pct"), F.count(F.lit(1)).alias("n_points"))


# ---- what stands in for a network's answers, as columns

def soft_points(mask_points: DataFrame) -> DataFrame:
    """mask_points with p: a mask value, in percent."""
    return mask_points.withColumn("p", 10 + (F.col("point_id") * 31 + F.col("mask_id") * 17) % 90)


def mask_values(mask_points: DataFrame) -> DataFrame:
    """mask_points with p: a mask value as a probability."""
    return mask_points.withColumn("p", (10 + (F.col("point_id") * 31 + F.col("mask_id") * 17) % 90) / 100.0)


def offsets(points: DataFrame) -> DataFrame:
    """points with (px, py, pz): offsets to the tree's centre, and the true ones (gx, gy, gz)."""
    c = points.where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(*[(F.sum(a) / F.count(F.lit(1))).alias("m" + a[0]) for a in ("x_cm", "y_cm", "z_cm")])
    p = points.where("instance_gt > 0").join(c, ["scan_id", "instance_gt"]).withColumns({"g" + a: F.col("m" + a) - F.col(f"{a}_cm") for a in "xyz"})
    return p.withColumn("px", F.col("gx") + 10).withColumn("py", F.col("gy") - 5).withColumn("pz", F.col("gz") * 0.5)


def heat(points: DataFrame) -> DataFrame:
    """points with heat and its target, both in (0, 1)."""
    return points.withColumn("heat", (10 + F.col("point_id") % 80) / 100.0).withColumn("target", F.col("score_pct") / 100.0)


def class_values(points: DataFrame) -> DataFrame:
    """points with three class values."""
    return points.withColumns({f"c{k}": (F.col("point_id") * m + F.col("z_cm")) % 97 for k, m in enumerate((13, 29, 47))})


def tile_answers(member: DataFrame, points: DataFrame) -> DataFrame:
    """(scan_id, point_id, region_id, vote) of member: a tile's class for a point, moved on by one where the tile's id is a multiple of five."""
    vote = F.when(F.col("region_id") % 5 == 0, (F.col("semantic_pred") + 1) % 3).otherwise(F.col("semantic_pred"))
    return member.join(points.select("scan_id", "point_id", "semantic_pred"), ["scan_id", "point_id"]).select("scan_id", "point_id", "region_id", vote.alias("vote"))


def mask_labels(masks: DataFrame, of: int = 2) -> DataFrame:
    """masks with a label."""
    return masks.withColumn("label", (F.floor(F.col("mask_id") / 4) % of).cast("int"))


def centres(masks: DataFrame) -> DataFrame:
    """(scan_id, mask_id, cx, cy): the centre of the tile that a mask comes from."""
    return masks.select("scan_id", "mask_id", (1600 + F.floor(F.col("mask_id") / 4) % 3 * 1600).alias("cx"), F.lit(3200).alias("cy"))


def truth(points: DataFrame) -> DataFrame:
    """(scan_id, point_id, class, instance): two classes of trees; ground and every eleventh tree are void."""
    g = F.col("instance_gt")
    return points.select("scan_id", "point_id", F.when((g == 0) | (g % 11 == 0), 0).otherwise(1 + g % 2).cast("int").alias("class"), g.alias("instance"))


def class_masks(masks: DataFrame) -> DataFrame:
    return masks.select("scan_id", "mask_id", (1 + (F.floor(F.col("mask_id") / 4) + 1) % 2).cast("int").alias("class"), F.col("score_pct").alias("score"))


def spilt_masks(mask_points: DataFrame, points: DataFrame, masks: DataFrame) -> DataFrame:
    """mask_points, and some of the ground under masks."""
    ground = points.where("instance_gt = 0 and point_id % 3 = 0").select("scan_id", (F.col("point_id") * 7 % 40 * 4).alias("mask_id"), "point_id")
    return mask_points.unionByName(ground.join(masks.select("scan_id", "mask_id"), ["scan_id", "mask_id"], "left_semi"))


def samples(points: DataFrame) -> DataFrame:
    """(scan_id, sample_id, x_cm, y_cm, z_cm, semantic_pred): few points, many voxels apart."""
    return points.where("point_id % 101 = 0").select("scan_id", F.col("point_id").alias("sample_id"), "x_cm", "y_cm", "z_cm", "semantic_pred")
