"""Nearest neighbours of points in another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.operators.lineage import hold

AXES = ("x_cm", "y_cm", "z_cm")


def nearest_join(points: DataFrame, samples: DataFrame, size: float = 20, point: str = "point_id", sample: str = "sample_id") -> DataFrame:
    """(scan_id, point, sample, d2): for each of points(scan_id, point, x_cm, y_cm, z_cm) the nearest of samples(scan_id, sample, x_cm, y_cm, z_cm) of its scan; ties go to the smaller one.

    Left-total: points of a scan without samples have a null one. Samples are put in the 27 cells around theirs and meet the points by an equi-join. A
    sample outside these cells is an edge away at least, so that an answer within an edge is certain; the points without one go
    on with edges twice as long, as often as the scans' extent allows. They are those far from all samples, so few samples are near them then.
    """
    low_high = [x for a in AXES for x in (F.min(a), F.max(a))]
    ends = points.select(*AXES).unionByName(samples.select(*AXES)).agg(*low_high).first()
    extent = max((float(ends[2 * k + 1]) - float(ends[2 * k]) for k in range(3) if ends[2 * k] is not None), default=0.0)
    todo, done, edge = points.select("scan_id", point, *AXES), None, float(size)
    while True:
        cell = lambda a: F.floor(F.col(a) / edge).cast("bigint")  # noqa: B023,E731
        near = samples.select("scan_id", F.col(sample).alias("_s"), *[F.col(a).alias("s" + a[0]) for a in AXES], *[cell(a).alias("w" + a[0]) for a in AXES])
        for a in "xyz":
            near = near.withColumn("v" + a, F.explode(F.sequence(F.col("w" + a) - 1, F.col("w" + a) + 1)))
        d2 = sum((F.col(a) - F.col("s" + a[0])) * (F.col(a) - F.col("s" + a[0])) for a in AXES)
        met = todo.select("*", *[cell(a).alias("v" + a[0]) for a in AXES]).join(near, ["scan_id", "vx", "vy", "vz"], "left")
        best = met.groupBy("scan_id", point, *AXES).agg(F.min(F.when(F.col("_s").isNotNull(), F.struct(d2.alias("d2"), "_s"))).alias("b"))
        last = edge > extent
        found = hold(best if last else best.withColumn("sure", F.coalesce(F.col("b.d2") <= edge * edge, F.lit(False))))
        ours = found if last else found.where("sure")
        ours = ours.select("scan_id", point, F.col("b._s").alias(sample), F.col("b.d2").alias("d2"))
        done = ours if done is None else done.unionByName(ours)
        if last:
            return done
        todo = found.where("not sure").select("scan_id", point, *AXES)
        if todo.isEmpty():
            return done
        edge *= 2


def carried_back(points: DataFrame, samples: DataFrame, columns: list[str], size: float = 20) -> DataFrame:
    """points with the columns (predictions) of their nearest sample."""
    to = nearest_join(points, samples, size).select("scan_id", "point_id", "sample_id")
    return to.join(samples.select("scan_id", "sample_id", *columns), ["scan_id", "sample_id"], "left").select("scan_id", "point_id", *columns)


def lowest_points(points: DataFrame, instance: str = "instance_pred") -> DataFrame:
    """(scan_id, instance, x_cm, y_cm, z_cm): mean place and lowest height of each instance."""
    mean = lambda a: (F.sum(a) / F.count(F.lit(1))).alias(a)
    return points.where(F.col(instance) >= 0).groupBy("scan_id", instance).agg(mean("x_cm"), mean("y_cm"), F.min("z_cm").alias("z_cm"))


def ground_scores(points: DataFrame, voxel: int = 20, size: float = 200) -> DataFrame:
    """(scan_id, instance_pred, ground_id, height, score): occupied voxels over the height above the nearest ground point; 1,000,000 where that isn't positive."""
    ground = points.where("semantic_pred = 0").select("scan_id", F.col("point_id").alias("ground_id"), *AXES)
    low = hold(lowest_points(points))
    near = nearest_join(low, ground, size, "instance_pred", "ground_id").select("scan_id", "instance_pred", "ground_id")
    cells = points.where("instance_pred >= 0").groupBy("scan_id", "instance_pred").agg(F.count_distinct(*[F.floor(F.col(a) / voxel) for a in AXES]).alias("volume"))
    all_ = low.select("scan_id", "instance_pred", "z_cm").join(near, ["scan_id", "instance_pred"]).join(cells, ["scan_id", "instance_pred"])
    all_ = all_.join(ground.select("scan_id", "ground_id", F.col("z_cm").alias("g")), ["scan_id", "ground_id"], "left").withColumn("height", F.col("z_cm") - F.col("g"))
    return all_.select("scan_id", "instance_pred", "ground_id", "height", F.when(F.col("height") > 0, F.round(F.col("volume") / F.col("height"), 6)).otherwise(1e6).alias("score"))
