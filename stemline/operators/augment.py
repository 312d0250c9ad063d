"""Geometric augmentations with fixed parameters, scene mixing, and range filters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotate_flip_scale(points: DataFrame, angle: float = math.pi / 6, scale: float = 1.05, shift=(10.0, -10.0, 0.0), flip: bool = True) -> DataFrame:
    x, y = F.col("x_cm") * (-1 if flip else 1), F.col("y_cm")
    c, s = math.cos(angle), math.sin(angle)
    return points.select("scan_id", "point_id", F.round((x * c - y * s) * scale + shift[0], 4).alias("x"), F.round((x * s + y * c) * scale + shift[1], 4).alias("y"), F.round(F.col("z_cm") * scale + shift[2], 4).alias("z"))


def rotate_votes(offsets: DataFrame, angle: float = math.pi / 6, scale: float = 1.05, flip: bool = True) -> DataFrame:
    """Vote vectors (gx, gy, gz) turned, flipped and scaled as rotate_flip_scale does with the points; they aren't shifted."""
    x, y = F.col("gx") * (-1 if flip else 1), F.col("gy")
    c, s = math.cos(angle), math.sin(angle)
    return offsets.select("scan_id", "point_id", F.round((x * c - y * s) * scale, 6).alias("gx"), F.round((x * s + y * c) * scale, 6).alias("gy"), F.round(F.col("gz") * scale, 6).alias("gz"))


def align(points: DataFrame, m) -> DataFrame:
    """Coordinates under a 4 x 4 matrix."""
    at = lambda r: F.round(F.col("x_cm") * m[r][0] + F.col("y_cm") * m[r][1] + F.col("z_cm") * m[r][2] + m[r][3], 6)
    return points.select("scan_id", "point_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def range_filter(points: DataFrame, low=(1000, 1000, 100), high=(5000, 5000, 2000)) -> DataFrame:
    return points.where(" and ".join(f"{a}_cm > {lo} and {a}_cm < {hi}" for a, lo, hi in zip("xyz", low, high))).select("scan_id", "point_id")


def sector_swap(points: DataFrame, a: int = 0, b: int = 1, start: float = 0.0, stop: float = math.pi / 2, centre: int = 3200) -> DataFrame:
    """Scene a with the angular sector start..stop taken from scene b."""
    angle = F.atan2((F.col("y_cm") - centre).cast("double"), (F.col("x_cm") - centre).cast("double"))
    inside = (angle > start) & (angle < stop)
    return points.where(((F.col("scan_id") == a) & ~inside) | ((F.col("scan_id") == b) & inside)).select("scan_id", "point_id")


def pitch_bands(points: DataFrame, a: int = 0, b: int = 1, bands: int = 4, centre: int = 3200, low: float = 0.0, high: float = 1.6) -> DataFrame:
    """Scenes a and b woven by bands of pitch: even bands of the one, odd bands of the other."""
    dx, dy = F.col("x_cm") - centre, F.col("y_cm") - centre
    pitch = F.atan2(F.col("z_cm").cast("double"), F.sqrt((dx * dx + dy * dy).cast("double")))
    band = F.floor((pitch - low) / ((high - low) / bands))
    return points.withColumn("band", band.cast("bigint")).where(((F.col("scan_id") == a) & (F.col("band") % 2 == 0)) | ((F.col("scan_id") == b) & (F.col("band") % 2 == 1))).select("scan_id", "point_id", "band")


def drop_where_hash(points: DataFrame, share_pct: int = 20, seed: int = 7) -> DataFrame:
    """score_pct set to 0 for a pseudo-random share of the points (colour dropping)."""
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("point_id").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int")
    return points.select("scan_id", "point_id", F.when(first % 100 < share_pct, 0).otherwise(F.col("score_pct")).cast("int").alias("score_pct"))


def colour_normalise(points: DataFrame, mean: float = 127.5, std: float = 127.5) -> DataFrame:
    return points.select("scan_id", "point_id", F.round((F.col("score_pct") - mean) / std, 6).alias("c"))


def elastic(points: DataFrame, grain: int = 600, magnitude: float = 40.0, seed: int = 7) -> DataFrame:
    """Points moved by noise on a lattice, interpolated linearly between its eight corners.

    The noise of a corner is drawn from the MD5 of its place, so that no grid has to be sent around.
    """
    q = [F.col(f"{a}_cm") / float(grain) for a in "xyz"]
    base, frac = [F.floor(v).cast("bigint") for v in q], [v - F.floor(v) for v in q]

    def noise(k: int) -> F.Column:
        out = F.lit(0.0)
        for corner in range(8):
            bit = [corner >> i & 1 for i in range(3)]
            name = F.concat_ws("|", F.lit(f"{seed}|{k}"), *[(base[i] + bit[i]).cast("string") for i in range(3)])
            value = F.conv(F.substring(F.md5(name.cast("binary")), 1, 6), 16, 10).cast("double") / 8388608.0 - 1
            weight = F.lit(1.0)
            for i in range(3):
                weight = weight * (frac[i] if bit[i] else 1 - frac[i])
            out = out + value * weight
        return out

    return points.select("scan_id", "point_id", *[F.round(F.col(f"{a}_cm") + magnitude * noise(k), 4).alias(a) for k, a in enumerate("xyz")])
