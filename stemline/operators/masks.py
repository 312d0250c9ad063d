"""Scored masks: top-k, suppression, filters, painting, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemline.operators.lineage import hold

KEY = ["scan_id", "mask_id"]


def top_masks(masks: DataFrame, k: int = 30) -> DataFrame:
    """The k best masks of each scan; ties go to smaller ids."""
    order = Window.partitionBy("scan_id").orderBy(F.desc("score_pct"), "mask_id")
    return masks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def objectness(mask_points: DataFrame, masks: DataFrame, least: int = 30) -> DataFrame:
    """Score times the mean value of a mask's points above `least`; mask_points has the values p, in percent."""
    some = F.col("p") > least
    one = mask_points.groupBy(*KEY).agg(F.sum(F.when(some, F.col("p")).otherwise(0)).alias("s"), F.count_if(some).alias("n"))
    return masks.join(one, KEY).select(*KEY, F.round(F.col("score_pct") / 100 * (F.col("s") / 100) / (F.col("n") + 1e-6), 6).alias("score"))


def overlaps(mask_points: DataFrame) -> DataFrame:
    """(scan_id, a, b, shared): pairs a < b of masks with points in common.

    A point lists the masks that hold it, three at most here, and yields their
    pairs, which are counted: no self-join of the points.
    """
    held = mask_points.groupBy("scan_id", "point_id").agg(F.sort_array(F.collect_set("mask_id")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.where(F.size("m") > 1).select("scan_id", F.explode(pairs).alias("x")).groupBy("scan_id", "x.a", "x.b").agg(F.count(F.lit(1)).alias("shared"))


def iou_pairs(mask_points: DataFrame, masks: DataFrame) -> DataFrame:
    """Overlapping pairs with IoU and the shares of either mask."""
    n = masks.select("scan_id", "mask_id", "n_points")
    out = overlaps(mask_points).join(n.toDF("scan_id", "a", "n_a"), ["scan_id", "a"]).join(n.toDF("scan_id", "b", "n_b"), ["scan_id", "b"])
    s = F.col("shared")
    return out.select("scan_id", "a", "b", "shared", F.round(s / (F.col("n_a") + F.col("n_b") - s), 6).alias("iou"), F.round(s / F.col("n_a"), 6).alias("of_a"), F.round(s / F.col("n_b"), 6).alias("of_b"))


def matrix_nms(mask_points: DataFrame, masks: DataFrame, kernel: str = "linear", sigma: float = 2.0, label: str | None = None, first: int | None = None, least: float | None = None, most: int | None = None) -> DataFrame:
    """Scores decayed by the IoU with better masks, each compensated by that mask's own best overlap; closed form, no order of passes.

    label: masks of different labels leave each other alone. first: only so many best masks of a scan take part. least: decayed scores have to exceed it. most: so many are
    returned of a scan. Pairs come from the masks of each point: their number is bounded by what the masks of a point make, not by all masks of a scan.
    """
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("score_pct"), "mask_id"))
    ranked = masks.withColumn("rank", rank).withColumn("_label", F.col(label) if label else F.lit(0))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
        mask_points = mask_points.join(ranked.select(*KEY), KEY, "left_semi")
    r = ranked.select("scan_id", "mask_id", "rank", "n_points", "_label")
    pair = overlaps(mask_points).join(r.toDF("scan_id", "a", "ra", "na", "la"), ["scan_id", "a"]).join(r.toDF("scan_id", "b", "rb", "nb", "lb"), ["scan_id", "b"]).where(F.col("la") == F.col("lb"))
    iou = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    pair = pair.select("scan_id", F.least("ra", "rb").alias("i"), F.greatest("ra", "rb").alias("j"), iou.alias("iou"))
    own = pair.groupBy("scan_id", F.col("j").alias("i")).agg(F.max("iou").alias("own"))
    pair = pair.join(own, ["scan_id", "i"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    if kernel == "linear":
        decay = (1 - F.col("iou")) / (1 - F.col("own"))
    else:
        decay = F.exp(-sigma * F.col("iou") * F.col("iou")) / F.exp(-sigma * F.col("own") * F.col("own"))
    # where own is 1 the decay is undefined; such a mask is a copy of a better one and doesn't count
    low = pair.where("own < 1").groupBy("scan_id", F.col("j").alias("rank")).agg(F.min(decay).alias("decay"))
    # masks that share no point with a better one decay by the best of what the others compensate
    out = ranked.join(low, ["scan_id", "rank"], "left").select(*KEY, F.round(F.col("score_pct") / 100 * F.least(F.coalesce("decay", F.lit(1.0)), F.lit(1.0)), 6).alias("score"))
    if least is not None:
        out = out.where(F.col("score") > least)
    if most is not None:
        out = out.withColumn("turn", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("score"), "mask_id"))).where(F.col("turn") <= most).drop("turn")
    return out


def predict(mask_points: DataFrame, masks: DataFrame, points: DataFrame, centres: DataFrame | None, k: int = 40, label: str | None = "label", nms: bool = True, threshold: float = 0.6, score: float = 0.05, least: int = 10) -> DataFrame:
    """(scan_id, mask_id, score, n_points): the masks of a network's answer that are handed on, in the steps of the post-processor.

    The k best of a scan, scores times mean mask value, matrix suppression within a label, values over the threshold, least score and size, and no
    point at the edge of the tile. mask_points has the values p. centres None: no edge test (whole scans); nms False: none.
    """
    top = top_masks(masks, k).drop("rank")
    held = mask_points.join(top.select(*KEY), KEY, "left_semi")
    told = objectness(held, top)
    if nms:
        sized = top.drop("score_pct").join(told.select(*KEY, (F.col("score") * 100).alias("score_pct")), KEY)
        told = matrix_nms(held.select("scan_id", "mask_id", "point_id"), sized, label=label)
    told = told.where(F.col("score") > score)
    hard = binarise(held.join(told.select(*KEY), KEY, "left_semi"), threshold)
    size = hard.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_points")).where(F.col("n_points") > least)
    out = told.join(size, KEY).select(*KEY, "score", "n_points")
    return out if centres is None else out.join(edge_filter(hard, points, centres), KEY, "left_semi")


def edge_filter(mask_points: DataFrame, points: DataFrame, centres: DataFrame, radius: int = 1600, margin: int = 50) -> DataFrame:
    """Masks without a point farther than radius - margin from the centre of their tile, centres(scan_id, mask_id, cx, cy)."""
    dx, dy = F.col("x_cm") - F.col("cx"), F.col("y_cm") - F.col("cy")
    held = mask_points.join(centres, KEY).join(points.select("scan_id", "point_id", "x_cm", "y_cm"), ["scan_id", "point_id"])
    return held.groupBy(*KEY).agg(F.max(dx * dx + dy * dy).alias("d2")).where(F.col("d2") <= (radius - margin) ** 2).select(*KEY)


def stuff_majority_filter(mask_points: DataFrame, masks: DataFrame, points: DataFrame) -> DataFrame:
    """Scores set to 0 where over half of a mask's points are predicted as ground."""
    n = mask_points.join(points.select("scan_id", "point_id", "semantic_pred"), ["scan_id", "point_id"]).groupBy(*KEY).agg(F.count_if(F.col("semantic_pred") == 0).alias("stuff"), F.count(F.lit(1)).alias("n"))
    return masks.join(n, KEY).select(*KEY, F.when(2 * F.col("stuff") > F.col("n"), 0).otherwise(F.col("score_pct")).cast("int").alias("score_pct"))


def height_filter(mask_points: DataFrame, masks: DataFrame, points: DataFrame, above: int = 500) -> DataFrame:
    """Scores set to 0 where a mask starts more than `above` over the highest ground of its scan."""
    top = points.where("semantic_pred = 0").groupBy("scan_id").agg(F.max("z_cm").alias("top"))
    low = mask_points.join(points.select("scan_id", "point_id", "z_cm"), ["scan_id", "point_id"]).groupBy(*KEY).agg(F.min("z_cm").alias("low"))
    return masks.join(low, KEY, "left").join(top, "scan_id", "left").select(*KEY, F.when(F.col("low").isNull() | (F.col("low") > F.col("top") + above), 0).otherwise(F.col("score_pct")).cast("int").alias("score_pct"))


def size_score_filter(masks: DataFrame, score: int = 40, least: int = 10) -> DataFrame:
    return masks.where((F.col("score_pct") > score) & (F.col("n_points") > least)).select(*KEY)


def binarise(mask_points: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Points of masks whose sigmoid value exceeds the threshold; mask_points has the values p, in percent, of which 50 is even."""
    logit = (F.col("p") - 50) / 20.0
    return mask_points.where(1 / (1 + F.exp(-logit)) > threshold).select(*KEY, "point_id")


def argmax_mask(mask_points: DataFrame, masks: DataFrame) -> DataFrame:
    """The best-scored mask of each point, the smaller id on a tie: one aggregate, whatever tiles the masks came from."""
    m = mask_points.join(masks.select(*KEY, "score_pct"), KEY)
    return m.groupBy("scan_id", "point_id").agg(F.max_by("mask_id", F.struct(F.col("score_pct"), -F.col("mask_id"))).alias("mask_id"))


def surviving_masks(mask_points: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks that still win a point."""
    return masks.join(argmax_mask(mask_points, masks), KEY, "left_semi").select(*KEY, "score_pct")


def paint(mask_points: DataFrame, masks: DataFrame, points: DataFrame, least: int = 10) -> DataFrame:
    """Panoptic labels: things painted by ascending score over stuff, what keeps `least` points or fewer dropped, ids made dense."""
    on_top = argmax_mask(mask_points, masks)
    n = on_top.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    ids = n.withColumn("thing", F.row_number().over(Window.partitionBy("scan_id").orderBy("mask_id")).cast("bigint")).select(*KEY, "thing")
    painted = on_top.join(ids, KEY).select("scan_id", "point_id", "thing")
    return points.select("scan_id", "point_id", "semantic_pred").join(painted, ["scan_id", "point_id"], "left").select("scan_id", "point_id", F.coalesce(F.col("thing") + 2, F.col("semantic_pred").cast("bigint")).alias("panoptic"))


def components(pairs: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", node: str = "mask_id") -> DataFrame:
    """(scan_id, node, root): smallest id that pairs lead to, scan by scan; minimum labels in rounds of joins, cut by checkpoints."""
    both = pairs.select("scan_id", F.col(a).alias("u"), F.col(b).alias("v"))
    edge = both.unionByName(both.select("scan_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    label = nodes.select("scan_id", F.col(node).alias("u")).withColumn("root", F.col("u"))
    edge, label = hold(edge), hold(label)
    while True:
        near = edge.join(label.select("scan_id", F.col("u").alias("v"), F.col("root").alias("r")), ["scan_id", "v"]).groupBy("scan_id", "u").agg(F.min("r").alias("r"))
        nxt = label.join(near, ["scan_id", "u"], "left").select("scan_id", "u", F.least("root", F.coalesce("r", "root")).alias("root"), "root")
        nxt = nxt.toDF("scan_id", "u", "root", "was")
        up = nxt.select("scan_id", F.col("u").alias("root"), F.col("root").alias("up"))
        nxt = hold(nxt.join(up, ["scan_id", "root"]).select("scan_id", "u", F.col("up").alias("root"), (F.col("up") != F.col("was")).alias("moved")))
        label = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return label.select("scan_id", F.col("u").alias(node), "root")


def merge_masks(mask_points: DataFrame, masks: DataFrame, least_iou: float = 0.6) -> DataFrame:
    """Masks that chains of IoU over least_iou join, as one: its smallest id, best score and distinct points."""
    pairs = iou_pairs(mask_points, masks).where(F.col("iou") > least_iou)
    root = components(pairs, masks)
    score = masks.join(root, KEY).groupBy("scan_id", "root").agg(F.max("score_pct").alias("score_pct"), F.count(F.lit(1)).alias("n_masks"))
    size = mask_points.join(root, KEY).select("scan_id", "root", "point_id").distinct().groupBy("scan_id", "root").agg(F.count(F.lit(1)).alias("n_points"))
    return score.join(size, ["scan_id", "root"]).select("scan_id", F.col("root").alias("mask_id"), "score_pct", "n_masks", "n_points")


def greedy_suppress(mask_points: DataFrame, masks: DataFrame, most: float = 0.3) -> DataFrame:
    """(scan_id, point_id, mask_id): by falling score, a mask is dropped if over `most` of its points are taken; kept ones overwrite.

    A mask's fate hangs on those before it that it shares points with, and on what theirs hangs on: what overlaps join is one task's, as (mask,
    point) pairs, and masks apart from it go elsewhere.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places, at = np.unique(pdf["point_id"].to_numpy(), return_inverse=True)
        owner = np.full(len(places), -1, np.int64)
        order = pdf.assign(at=at).sort_values(["score_pct", "mask_id"], ascending=[False, True], kind="stable")
        for mask, rows in order.groupby("mask_id", sort=False):
            held = rows["at"].to_numpy()
            if (owner[held] >= 0).mean() <= most:
                owner[held] = mask
        kept = owner >= 0
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "point_id": places[kept], "mask_id": owner[kept]})

    root = components(overlaps(mask_points), masks)
    held = mask_points.select(*KEY, "point_id").join(masks.select(*KEY, "score_pct").join(root, KEY), KEY)
    return held.groupBy("scan_id", "root").applyInPandas(run, "scan_id int, point_id bigint, mask_id bigint")


def pairwise_suppress(mask_points: DataFrame, masks: DataFrame, most: float = 0.3) -> DataFrame:
    """Masks left when, pair after pair in order of id, of two that overlap by over `most` of either the lower-scored goes, the earlier staying on a tie.

    Pairs are found by joins; the pass over those that pairs join is one task's.
    """
    import pandas as pd

    s = masks.select("scan_id", "mask_id", "score_pct")
    pair = iou_pairs(mask_points, masks).where((F.col("of_a") > most) | (F.col("of_b") > most))
    pair = pair.join(s.toDF("scan_id", "a", "sa"), ["scan_id", "a"]).join(s.toDF("scan_id", "b", "sb"), ["scan_id", "b"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for a, b, sa, sb in pdf.sort_values(["a", "b"])[["a", "b", "sa", "sb"]].itertuples(index=False):
            if a not in gone and b not in gone:
                gone.add(b if sa >= sb else a)
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "mask_id": sorted(gone)}, columns=["scan_id", "mask_id"])

    pair = hold(pair.select("scan_id", "a", "b", "sa", "sb"))
    root = components(pair, pair.select("scan_id", F.explode(F.array("a", "b")).alias("mask_id")).distinct())
    gone = pair.join(root.withColumnRenamed("mask_id", "a"), ["scan_id", "a"]).groupBy("scan_id", "root").applyInPandas(run, "scan_id int, mask_id bigint")
    return s.join(gone, KEY, "left_anti")
