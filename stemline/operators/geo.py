"""Voxels, tiles, rasters and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x_cm", "y_cm", "z_cm")


def voxel_key(size: int, anchor: dict[str, F.Column] | None = None, mode: str = "floor", axes=AXES) -> list[F.Column]:
    """Voxel indices vx, vy, vz of whole-centimetre coordinates.

    anchor: what is taken off a coordinate first (nothing: the origin). mode floor rounds down, trunc towards zero, so that
    with trunc what lies less than a voxel left of the anchor falls in voxel 0.
    """
    out = []
    for axis in axes:
        d = F.col(axis) - (anchor[axis] if anchor else F.lit(0))
        q = d / F.lit(float(size))
        out.append((F.floor(q) if mode == "floor" else F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))).cast("bigint").alias("v" + axis[0]))
    return out


def with_voxels(points: DataFrame, size: int, mode: str = "floor") -> DataFrame:
    return points.select("*", *voxel_key(size, mode=mode))


def voxel_mean(points: DataFrame, size: int = 20) -> DataFrame:
    """Mean point, count and first point of each occupied voxel; sums of whole numbers, so exact in any order."""
    return with_voxels(points, size).groupBy("scan_id", "vx", "vy", "vz").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(a) / F.count(F.lit(1)), 6).alias("mean_" + a[0]) for a in AXES], F.min("point_id").alias("first_id")
    )


def voxel_first(points: DataFrame, size: int = 100) -> DataFrame:
    """The point of each voxel with the smallest id (thinning)."""
    cell = with_voxels(points, size).groupBy("scan_id", "vx", "vy", "vz")
    return cell.agg(F.min_by(F.struct("point_id", *AXES), "point_id").alias("p")).select("scan_id", "p.*")


def thin_ground(points: DataFrame, size: int = 100, gate: int = 100_000) -> DataFrame:
    """Ground points, thinned by voxel in the scans that have more than gate of them."""
    ground = points.where("semantic_pred = 0")
    many = ground.groupBy("scan_id").agg((F.count(F.lit(1)) > gate).alias("many"))
    marked = ground.join(many, "scan_id")
    thin = voxel_first(marked.where("many"), size)
    return marked.where("not many").select("scan_id", "point_id", *AXES).unionByName(thin)


def voxel_hash_pick(points: DataFrame, size: int = 20, seed: int = 7) -> DataFrame:
    """A pseudo-random point of each voxel: the smallest MD5 of seed and id, the same on every engine and run."""
    spin = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("point_id").cast("string")).cast("binary"))
    return with_voxels(points, size).groupBy("scan_id", "vx", "vy", "vz").agg(F.min_by("point_id", spin).alias("point_id"))


def recenter(points: DataFrame) -> DataFrame:
    """Coordinates from the mean x, mean y and lowest z of their scan; a row a scan is joined back."""
    o = points.groupBy("scan_id").agg((F.sum("x_cm") / F.count(F.lit(1))).alias("ox"), (F.sum("y_cm") / F.count(F.lit(1))).alias("oy"), F.min("z_cm").alias("oz"))
    return points.join(o, "scan_id").select("point_id", "scan_id", F.round(F.col("x_cm") - F.col("ox"), 6).alias("x"), F.round(F.col("y_cm") - F.col("oy"), 6).alias("y"), (F.col("z_cm") - F.col("oz")).alias("z"))


def scan_extent(points: DataFrame) -> DataFrame:
    return points.groupBy("scan_id").agg(*[f(a).alias(f"{n}_{a[0]}") for a in AXES for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("n"))


def tile_regions(points: DataFrame, step: int = 400) -> DataFrame:
    """Tile centres of each scan: a lattice from the smallest coordinates on, region_id row by row."""
    e = points.groupBy("scan_id").agg(F.min("x_cm").alias("x0"), F.min("y_cm").alias("y0"), F.max("x_cm").alias("x1"), F.max("y_cm").alias("y1"))
    n = lambda a, b: F.floor((F.col(b) - F.col(a)) / step).cast("int")
    e = e.select("scan_id", "x0", "y0", F.explode(F.sequence(F.lit(0), n("x0", "x1"))).alias("i"), n("y0", "y1").alias("m"))
    e = e.select("scan_id", "x0", "y0", "i", "m", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("j"))
    return e.select("scan_id", (F.col("i") * (F.col("m") + 1) + F.col("j")).cast("bigint").alias("region_id"), (F.col("x0") + F.col("i") * step).alias("cx"), (F.col("y0") + F.col("j") * step).alias("cy"))


def tile_membership(points: DataFrame, radius: int = 1600, step: int = 400) -> DataFrame:
    """(scan_id, point_id, region_id, d2) for each tile whose centre lies within radius of a point.

    Centres lie on a lattice, so each point lists the lattice places that can reach it
    and keeps those that do: a range join without a join.
    """
    e = points.groupBy("scan_id").agg(F.min("x_cm").alias("x0"), F.min("y_cm").alias("y0"), F.max("x_cm").alias("x1"), F.max("y_cm").alias("y1"))
    p = points.select("scan_id", "point_id", "x_cm", "y_cm").join(F.broadcast(e) if _few(e) else e, "scan_id")
    top = {a: F.floor((F.col(a + "1") - F.col(a + "0")) / step).cast("int") for a in "xy"}

    def reach(a: str) -> F.Column:
        d = F.col(f"{a}_cm") - F.col(a + "0")
        first, last = F.greatest(F.ceil((d - radius) / step), F.lit(0)).cast("int"), F.least(F.floor((d + radius) / step).cast("int"), top[a])
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    p = p.withColumn("m", top["y"]).withColumn("i", reach("x")).withColumn("j", reach("y"))
    dx, dy = F.col("x_cm") - F.col("x0") - F.col("i") * step, F.col("y_cm") - F.col("y0") - F.col("j") * step
    out = p.select("scan_id", "point_id", (F.col("i") * (F.col("m") + 1) + F.col("j")).cast("bigint").alias("region_id"), (dx * dx + dy * dy).cast("bigint").alias("d2"))
    return out.where(F.col("d2") <= radius * radius)


def _few(df: DataFrame, bound: int = 100_000) -> bool:
    """Whether df, a row a scan, is small enough to broadcast (8 columns: 10 MB)."""
    return df.limit(bound + 1).count() <= bound


def ground_raster(points: DataFrame, cell: int = 300) -> DataFrame:
    """Mean height of the ground in each cell, indexed from the ground's smallest coordinates."""
    g = points.where("semantic_pred = 0")
    o = g.groupBy("scan_id").agg(F.min("x_cm").alias("x0"), F.min("y_cm").alias("y0"))
    i = lambda a: F.expr(f"({a}_cm - {a}0) div {cell}").cast("bigint")  # noqa: E731  towards zero
    return g.join(o, "scan_id").groupBy("scan_id", i("x").alias("xi"), i("y").alias("yi")).agg(F.round(F.sum("z_cm") / F.count(F.lit(1)), 6).alias("gz"))


def height_above_ground(points: DataFrame, cell: int = 300) -> DataFrame:
    """Height of the points that aren't ground over their cell's mean ground; null over a cell without ground."""
    o = points.where("semantic_pred = 0").groupBy("scan_id").agg(F.min("x_cm").alias("x0"), F.min("y_cm").alias("y0"))
    i = lambda a: F.expr(f"({a}_cm - {a}0) div {cell}").cast("bigint")
    p = points.where("semantic_pred <> 0").join(o, "scan_id").select("scan_id", "point_id", *AXES, "instance_pred", i("x").alias("xi"), i("y").alias("yi"))
    return p.join(ground_raster(points, cell), ["scan_id", "xi", "yi"], "left").select("scan_id", "point_id", *AXES, "instance_pred", F.round(F.col("z_cm") - F.col("gz"), 6).alias("height"))


def noise_scores(points: DataFrame, voxel: int = 50, cell: int = 300, least: int = 5) -> DataFrame:
    """Score of each predicted instance: occupied voxels over its lowest height; 1,000,000 below `least` points or without a height above 0."""
    h = with_voxels(height_above_ground(points, cell).where("instance_pred >= 0"), voxel)
    one = h.groupBy("scan_id", "instance_pred", "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), F.min("height").alias("low"))
    inst = one.groupBy("scan_id", "instance_pred").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("volume"), F.min("low").alias("low"))
    return inst.select("scan_id", "instance_pred", "n", "volume", F.when((F.col("n") >= least) & (F.col("low") > 0), F.round(F.col("volume") / F.col("low"), 6)).otherwise(1e6).alias("score"))


def drop_noise(points: DataFrame, below: float = 200.0, **how) -> DataFrame:
    """points whose instance scores under `below` become unassigned (-1)."""
    s = noise_scores(points, **how).select("scan_id", "instance_pred", "score")
    return points.join(s, ["scan_id", "instance_pred"], "left").select("scan_id", "point_id", F.when(F.coalesce("score", F.lit(1e6)) < below, -1).otherwise(F.col("instance_pred")).cast("bigint").alias("instance_pred"))


def nearest_sample(points: DataFrame, size: int = 20) -> DataFrame:
    """(scan_id, point_id, vx, vy, vz, d2): the nearest voxel mean of each point; ties go to the smallest voxel.

    The mean of a point's own voxel bounds its answer: another voxel can only hold a nearer mean if it is no farther than that one.
    Points ask for these voxels by an equi-join. Their number isn't in Spark's estimates, so the joins are named: no side is ever broadcast.
    """
    means = with_voxels(points, size).groupBy("scan_id", "vx", "vy", "vz").agg(*[(F.sum(a) / F.count(F.lit(1))).alias("s" + a[0]) for a in AXES])
    means = means.hint("merge")
    to_mean = sum((F.col(f"{a}_cm") - F.col("s" + a)) * (F.col(f"{a}_cm") - F.col("s" + a)) for a in "xyz")
    own = with_voxels(points.select("scan_id", "point_id", *AXES), size).join(means, ["scan_id", "vx", "vy", "vz"])
    ask = own.select("scan_id", "point_id", *AXES, (to_mean + 1e-3).alias("most"))  # distances are compared at six places
    for a in "xyz":
        x, reach = F.col(f"{a}_cm"), F.sqrt("most")
        ask = ask.withColumn("v" + a, F.explode(F.sequence(F.floor((x - reach) / size).cast("bigint"), F.floor((x + reach) / size).cast("bigint"))))
        gap = F.greatest(F.col("v" + a) * size - x, x - (F.col("v" + a) + 1) * size, F.lit(0))
        ask = ask.withColumn("gap" + a, gap * gap).where(sum(F.col("gap" + b) for b in "xyz"[: "xyz".index(a) + 1]) <= F.col("most"))
    met = ask.join(means, ["scan_id", "vx", "vy", "vz"]).withColumn("best", F.struct(F.round(to_mean, 6).alias("d2"), "vx", "vy", "vz"))
    found = met.groupBy("scan_id", "point_id").agg(F.min("best").alias("b"))
    return found.select("scan_id", "point_id", "b.vx", "b.vy", "b.vz", F.round("b.d2", 3).alias("d2"))


def bounding_boxes(points: DataFrame, instance: str = "instance_gt") -> DataFrame:
    """Centre and extent of each instance above 0."""
    b = points.where(F.col(instance) > 0).groupBy("scan_id", instance).agg(*[f(a).alias(f"{n}{a[0]}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    return b.select("scan_id", instance, *[((F.col("lo" + a) + F.col("hi" + a)) / 2).alias("c" + a) for a in "xyz"], *[(F.col("hi" + a) - F.col("lo" + a)).alias("d" + a) for a in "xyz"])


def points_in_rotated_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, scan_id, point_id) of points inside boxes(box_id, scan_id, cx, cy, cz, dx, dy, dz, yaw).

    Both sides meet by 10-metre cells that the box's circumscribed square touches.
    """
    cell = 1000
    r = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 2
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / cell), F.floor((F.col(c) + r) / cell)))
    b = boxes.withColumn("gx", span("cx")).withColumn("gy", span("cy"))
    p = points.select("scan_id", "point_id", *AXES, F.floor(F.col("x_cm") / cell).alias("gx"), F.floor(F.col("y_cm") / cell).alias("gy"))
    dx, dy = F.col("x_cm") - F.col("cx"), F.col("y_cm") - F.col("cy")
    u, v = dx * F.cos("yaw") + dy * F.sin("yaw"), dy * F.cos("yaw") - dx * F.sin("yaw")
    inside = (F.abs(u) <= F.col("dx") / 2) & (F.abs(v) <= F.col("dy") / 2) & (F.abs(F.col("z_cm") - F.col("cz")) <= F.col("dz") / 2)
    return p.join(b, ["scan_id", "gx", "gy"]).where(inside).select("box_id", "scan_id", "point_id")


def crop(points: DataFrame, centres: DataFrame, radius: int, strict: bool = True) -> DataFrame:
    """points within radius of their scan's centre(scan_id, cx, cy); strictly, as in training."""
    dx, dy = F.col("x_cm") - F.col("cx"), F.col("y_cm") - F.col("cy")
    d2 = dx * dx + dy * dy
    return points.join(centres, "scan_id").where(d2 < radius * radius if strict else d2 <= radius * radius)


def hashed_centre(points: DataFrame, seed: int = 7) -> DataFrame:
    """(scan_id, cx, cy): a pseudo-random point of each scan."""
    spin = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("point_id").cast("string")).cast("binary"))
    return points.groupBy("scan_id").agg(F.min_by(F.struct("x_cm", "y_cm"), spin).alias("c")).select("scan_id", F.col("c.x_cm").alias("cx"), F.col("c.y_cm").alias("cy"))


def crop_ratios(points: DataFrame, radius: int = 800) -> DataFrame:
    """Of each true tree that the crop meets: points inside, points in all, their ratio, and the centre of what is inside."""
    inside = crop(points, hashed_centre(points), radius).where("instance_gt > 0")
    some = inside.groupBy("scan_id", "instance_gt").agg(F.count(F.lit(1)).alias("n_in"), *[F.round(F.sum(a) / F.count(F.lit(1)), 6).alias("c" + a[0]) for a in AXES])
    every = points.where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(F.count(F.lit(1)).alias("n_all"))
    return some.join(every, ["scan_id", "instance_gt"]).withColumn("ratio", F.round(F.col("n_in") / F.col("n_all"), 6))


def fully_inside(points: DataFrame, radius: int = 800) -> DataFrame:
    """Points of a crop that belong to background or to trees that lie in it as a whole."""
    inside = crop(points, hashed_centre(points), radius).select("scan_id", "point_id", "instance_gt")
    whole = crop_ratios(points, radius).where("n_in = n_all").select("scan_id", "instance_gt")
    return inside.where("instance_gt = 0").unionByName(inside.join(whole, ["scan_id", "instance_gt"], "left_semi").select("scan_id", "point_id", "instance_gt"))


def farthest_points(vectors: DataFrame, group: str, key: str, vector: str, k: int) -> DataFrame:
    """(group, rank, key): farthest-point samples of each group, from its smallest key on; ties go to smaller keys.

    One pass after another by nature: each group, a tile of bounded size, is one task's.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        least, picked = np.full(len(x), np.inf), [0]
        while len(picked) < min(k, len(x)):
            least = np.minimum(least, ((x - x[picked[-1]]) ** 2).sum(axis=1))
            least[picked] = -1
            picked.append(int(least.argmax()))
        return pd.DataFrame({group: pdf[group].iloc[0], "rank": range(len(picked)), key: pdf[key].to_numpy()[picked]})

    kinds = dict(vectors.dtypes)
    return vectors.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, rank bigint, {key} {kinds[key]}")


def hash_sample(points: DataFrame, per_scan: int, seed: int = 7) -> DataFrame:
    """per_scan pseudo-random points of each scan without replacement, by MD5 of seed and id."""
    spin = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("point_id").cast("string")).cast("binary"))
    order = Window.partitionBy("scan_id").orderBy("spin")
    return points.withColumn("spin", spin).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_scan).select("scan_id", "point_id")
