"""Pseudo-random draws by MD5, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: F.Column | str | int) -> F.Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def draw(spin: F.Column, first: int = 1) -> F.Column:
    """A whole number below 2^28 from seven hex digits."""
    return F.conv(F.substring(spin, first, 7), 16, 10).cast("bigint")


def uniform(spin: F.Column, first: int = 1) -> F.Column:
    """In (0, 1)."""
    return (draw(spin, first) + 0.5) / float(1 << 28)


def normal(spin: F.Column) -> F.Column:
    """Standard normal, from two uniforms of one digest."""
    return F.sqrt(-2 * F.log(uniform(spin, 1))) * F.cos(2 * F.pi() * uniform(spin, 8))


def with_replacement(points: DataFrame, per_scan: int, seed: int = 7) -> DataFrame:
    """(scan_id, turn, point_id): min(per_scan, points) draws of each scan, each from all its points."""
    placed = points.select("scan_id", "point_id", (F.row_number().over(Window.partitionBy("scan_id").orderBy("point_id")) - 1).alias("place"))
    n = points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    turns = n.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(per_scan).cast("bigint"), F.col("n")) - 1)))
    drawn = turns.select("scan_id", "turn", (draw(digest(seed, F.col("scan_id"), F.col("turn"))) % F.col("n")).alias("place"))
    return drawn.join(placed, ["scan_id", "place"]).select("scan_id", "turn", "point_id")


def shuffled(points: DataFrame, seed: int = 7) -> DataFrame:
    """points of each scan in a pseudo-random order: place counts from 0."""
    order = Window.partitionBy("scan_id").orderBy(digest(seed, F.col("point_id")), "point_id")
    return points.select("scan_id", "point_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"))


def jitter(points: DataFrame, std: float = 3.0, most: float = 5.0, seed: int = 7) -> DataFrame:
    """Coordinates moved by clipped normal noise."""
    move = lambda a: F.greatest(F.lit(-most), F.least(F.lit(most), normal(digest(seed, a, F.col("point_id"))) * std))
    return points.select("scan_id", "point_id", *[F.round(F.col(f"{a}_cm") + move(a), 4).alias(a) for a in "xyz"])


def object_noise(points: DataFrame, boxes: DataFrame, std: float = 60.0, turn: float = 0.3, tries: int = 8, seed: int = 7) -> DataFrame:
    """(scan_id, point_id, x, y): points of objects moved and turned with their box, boxes(scan_id, instance_gt, x0, y0, x1, y1).

    A box tries `tries` moves (normal) and turns (uniform up to `turn`) about its centre and takes the first after which the upright
    box around it touches no other box of the scan that it didn't touch before; without one it stays. Boxes meet by
    cells of a lattice that is as wide as the widest of them.
    """
    import math

    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    attempts = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"))
    spin = lambda what: digest(seed, what, F.col("scan_id"), F.col("instance_gt"), F.col("t"))
    attempts = attempts.withColumn("dx", normal(spin("x")) * std).withColumn("dy", normal(spin("y")) * std).withColumn("angle", (uniform(spin("a")) * 2 - 1) * turn)
    half_w, half_h = (F.col("x1") - F.col("x0")) / 2, (F.col("y1") - F.col("y0")) / 2
    c, s = F.abs(F.cos("angle")), F.abs(F.sin("angle"))
    w, h = half_w * c + half_h * s, half_w * s + half_h * c
    attempts = attempts.withColumns({"a0": cx + F.col("dx") - w, "a1": cx + F.col("dx") + w, "b0": cy + F.col("dy") - h, "b1": cy + F.col("dy") + h})
    edge = float(boxes.agg(F.greatest(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0")))).first()[0] or 1) * math.sqrt(2) + 1
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / edge).cast("bigint"), F.floor(hi / edge).cast("bigint")))
    others = boxes.select("scan_id", F.col("instance_gt").alias("other"), *[F.col(k).alias("o" + k) for k in ("x0", "x1", "y0", "y1")])
    others = others.withColumn("gx", cells(F.col("ox0"), F.col("ox1"))).withColumn("gy", cells(F.col("oy0"), F.col("oy1")))
    asked = attempts.withColumn("gx", cells(F.col("a0"), F.col("a1"))).withColumn("gy", cells(F.col("b0"), F.col("b1")))
    touch = (F.col("a0") <= F.col("ox1")) & (F.col("a1") >= F.col("ox0")) & (F.col("b0") <= F.col("oy1")) & (F.col("b1") >= F.col("oy0"))
    was = (F.col("x0") <= F.col("ox1")) & (F.col("x1") >= F.col("ox0")) & (F.col("y0") <= F.col("oy1")) & (F.col("y1") >= F.col("oy0"))
    hit = asked.join(others, ["scan_id", "gx", "gy"]).where((F.col("other") != F.col("instance_gt")) & touch & ~was).select("scan_id", "instance_gt", "t").distinct()
    free = attempts.join(hit, ["scan_id", "instance_gt", "t"], "left_anti").groupBy("scan_id", "instance_gt").agg(F.min_by(F.struct("dx", "dy", "angle"), "t").alias("m"))
    moved = boxes.select("scan_id", "instance_gt", cx.alias("cx"), cy.alias("cy")).join(free, ["scan_id", "instance_gt"], "left")
    dx, dy, angle = (F.coalesce(F.col(f"m.{k}"), F.lit(0.0)) for k in ("dx", "dy", "angle"))
    rx, ry = F.col("x_cm") - F.col("cx"), F.col("y_cm") - F.col("cy")
    inside = points.where("instance_gt > 0").join(moved, ["scan_id", "instance_gt"])
    return inside.select("scan_id", "point_id", F.round(F.col("cx") + dx + rx * F.cos(angle) - ry * F.sin(angle), 3).alias("x"), F.round(F.col("cy") + dy + rx * F.sin(angle) + ry * F.cos(angle), 3).alias("y"))
