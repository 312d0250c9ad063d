"""Semantic, instance and panoptic quality of labelled points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Raw classes (label + 1): 1 is stuff, these are things.
GROUND, TREE_CLASSES = 1, (2, 3)


def ratio(a, b) -> F.Column:
    """a / b, null without b."""
    return F.try_divide(F.lit(a).cast("double") if isinstance(a, int) else a.cast("double"), b.cast("double"))


def raw_classes(points: DataFrame) -> DataFrame:
    """points with classes gt_c, pred_c (0 unclassified, 1 ground, 2 wood, 3 leaf) and their binary forms gt_b, pred_b."""
    out = points.withColumns({"gt_c": F.col("semantic_gt") + 1, "pred_c": F.col("semantic_pred") + 1})
    binary = lambda c: F.when(F.col(c) == GROUND, 1).when(F.col(c).isin(*TREE_CLASSES), 2).otherwise(0)
    return out.withColumns({"gt_b": binary("gt_c"), "pred_b": binary("pred_c")})


def evaluated(points: DataFrame, protocol: str = "file") -> DataFrame:
    """Rows that count: the file protocol drops points that are unclassified or ground on both sides, the unified one ground on both."""
    rows = raw_classes(points)
    if protocol == "file":
        return rows.where(~F.col("gt_c").isin(0, 1) | ~F.col("pred_c").isin(0, 1))
    return rows.where((F.col("gt_b") != 1) | (F.col("pred_b") != 1))


def most_frequent(rows: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """The most frequent value of each group, the smaller one on a tie; counts are pre-aggregated, no window."""
    one = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col(value))).alias(into), F.sum("n").alias("n"))


def confusion(points: DataFrame, binary: bool = False) -> DataFrame:
    """(class, gt, pred, tp) over all points."""
    g, p = ("gt_b", "pred_b") if binary else ("gt_c", "pred_c")
    cell = raw_classes(points).groupBy(F.col(g).alias("g"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("g").alias("class"), F.col("n").alias("gt"), F.lit(0).cast("bigint").alias("pred")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("gt"), F.col("n").alias("pred"))))
    both = cell.select(side.alias("s"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("hit")).select("s.*", "hit")
    return both.groupBy("class").agg(F.sum("gt").alias("gt"), F.sum("pred").alias("pred"), F.sum(F.when(F.col("gt") > 0, F.col("hit")).otherwise(0)).alias("tp"))


def semantic_summary(points: DataFrame, protocol: str = "file") -> DataFrame:
    """o_acc, m_acc, m_iou over the four classes. The file protocol's mean counts the wanted classes that occur but adds up all."""
    c = confusion(points)
    iou = ratio(F.col("tp"), F.col("gt") + F.col("pred") - F.col("tp"))
    wanted = F.col("class").isin(1, 2, 3) & (F.col("gt") > 0)
    every = F.sum(iou) if protocol == "file" else F.sum(F.when(wanted, iou))
    return c.agg(
        F.round(ratio(F.sum("tp"), F.sum("gt")), 6).alias("o_acc"),
        F.round(F.sum(F.when(wanted, ratio(F.col("tp"), F.col("gt")))) / F.count_if(wanted), 6).alias("m_acc"),
        F.round(every / F.count_if(wanted), 6).alias("m_iou"),
    )


def instance_pairs(points: DataFrame, protocol: str = "file") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predicted instances, true instances, pairs of one class with their IoU). The unified protocol leaves out instance 0."""
    rows = evaluated(points, protocol)
    least = -1 if protocol == "file" else 0
    g = most_frequent(rows.where(F.col("instance_gt") > least), ["scan_id", "instance_gt"], "gt_b", "g_class")
    p = most_frequent(rows.where("instance_pred <> -1"), ["scan_id", "instance_pred"], "pred_b", "p_class")
    both = rows.where((F.col("instance_gt") > least) & (F.col("instance_pred") != -1)).groupBy("scan_id", "instance_gt", "instance_pred").agg(F.count(F.lit(1)).alias("shared"))
    pairs = (
        both.join(g.withColumnRenamed("n", "g_n"), ["scan_id", "instance_gt"]).join(p.withColumnRenamed("n", "p_n"), ["scan_id", "instance_pred"])
        .where("g_class = p_class").withColumn("iou", ratio(F.col("shared"), F.col("g_n") + F.col("p_n") - F.col("shared")))
    )
    return p, g, pairs


def quality(tp: F.Column, n_pred: F.Column, n_gt: F.Column, iou: F.Column) -> dict[str, F.Column]:
    """Precision, recall, F1 and the panoptic family from counts and the sum of matched IoUs."""
    rq, sq = ratio(2 * tp, n_pred + n_gt), ratio(iou, tp)
    precision, recall = ratio(tp, n_pred), ratio(tp, n_gt)
    return {
        "prec": F.round(precision, 6), "rec": F.round(recall, 6),
        "f1": F.round(F.try_divide(2 * precision * recall, precision + recall), 6),
        "rq": F.round(rq, 6), "sq": F.round(F.coalesce(sq, F.lit(0.0)), 6), "pq": F.round(F.coalesce(sq, F.lit(0.0)) * rq, 6),
    }


def panoptic(points: DataFrame, protocol: str = "file", by_scan: bool = True, least_iou: float = 0.5) -> DataFrame:
    """Tree quality of each scan, or of all: a predicted instance is right if its best IoU reaches least_iou."""
    p, g, pairs = instance_pairs(points, protocol)
    best = pairs.groupBy("scan_id", "instance_pred").agg(F.max("iou").alias("best"))
    hit = F.col("best") >= least_iou
    got = p.where("p_class = 2").join(best, ["scan_id", "instance_pred"], "left").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(hit).alias("tp"), F.coalesce(F.sum(F.when(hit, F.col("best"))), F.lit(0.0)).alias("iou"))
    true = g.where("g_class = 2").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_gt"))
    scans = true.join(got, "scan_id", "full").fillna(0)
    if not by_scan:
        scans = scans.agg(*[F.sum(c).alias(c) for c in ("n_pred", "tp", "n_gt", "iou")])
    keys = ["scan_id"] if by_scan else []
    return scans.select(*keys, "n_pred", "tp", "n_gt", *[v.alias(k) for k, v in quality(F.col("tp"), F.col("n_pred"), F.col("n_gt"), F.col("iou")).items()])


def coverage(points: DataFrame, protocol: str = "file") -> DataFrame:
    """Mean best IoU of the true trees of a scan, plain and weighted by their points."""
    _, g, pairs = instance_pairs(points, protocol)
    best = pairs.groupBy("scan_id", "instance_gt").agg(F.max("iou").alias("best"))
    one = g.where("g_class = 2").join(best, ["scan_id", "instance_gt"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return one.groupBy("scan_id").agg(F.round(F.avg("best"), 6).alias("mucov"), F.round(F.sum(F.col("best") * F.col("n")) / F.sum("n"), 6).alias("mwcov"))


def stuff_quality(points: DataFrame) -> DataFrame:
    """Ground as one segment a scan: its IoU counts from 0.5 on; the starred form always."""
    rows = raw_classes(points)
    g, p = F.col("gt_b") == 1, F.col("pred_b") == 1
    one = rows.groupBy("scan_id").agg(ratio(F.count_if(g & p), F.count_if(g | p)).alias("iou"))
    ok = F.col("iou") >= 0.5
    return one.select("scan_id", F.when(ok, 1.0).otherwise(0.0).alias("rq"), F.when(ok, F.round("iou", 6)).otherwise(0.0).alias("pq"), F.round("iou", 6).alias("pq_star"))


def rollup_counts(points: DataFrame) -> DataFrame:
    """Per-scan class counts with their total over all scans (scan null)."""
    cell = raw_classes(points).groupBy("scan_id", F.col("gt_c").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt_c") == F.col("pred_c")).alias("tp"))
    both = cell.select(F.explode(F.array(F.col("scan_id"), F.lit(None).cast("int"))).alias("scan_id"), "class", "n", "tp")
    return both.groupBy("scan_id", "class").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))


# ---- average precision

def mask_matches(mask_points: DataFrame, points: DataFrame) -> DataFrame:
    """(scan_id, mask_id, instance_gt, shared, iou): contingency of scored masks and true trees."""
    label = points.select("scan_id", "point_id", "instance_gt")
    both = mask_points.join(label, ["scan_id", "point_id"])
    cell = both.groupBy("scan_id", "mask_id", "instance_gt").agg(F.count(F.lit(1)).alias("shared"))
    size = mask_points.groupBy("scan_id", "mask_id").agg(F.count(F.lit(1)).alias("m_n"))
    true = points.where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(F.count(F.lit(1)).alias("g_n"))
    return cell.join(size, ["scan_id", "mask_id"]).join(true, ["scan_id", "instance_gt"]).withColumn("iou", ratio(F.col("shared"), F.col("m_n") + F.col("g_n") - F.col("shared")))


def greedy_matches(matches: DataFrame, masks: DataFrame, least_iou: float) -> DataFrame:
    """(scan_id, mask_id, score_pct, tp): by falling score each mask takes a true tree that it overlaps by more than least_iou, each tree once; later ones are false.

    A tree belongs to the first mask that qualifies. Above an IoU of one half a mask qualifies for one
    tree at most, so that a window over its masks gives what the pass in order would.
    """
    fit = matches.where(F.col("iou") > least_iou).join(masks.select("scan_id", "mask_id", "score_pct"), ["scan_id", "mask_id"])
    order = Window.partitionBy("scan_id", "instance_gt").orderBy(F.desc("score_pct"), "mask_id")
    won = fit.withColumn("turn", F.row_number().over(order)).where("turn = 1").select("scan_id", "mask_id").distinct().withColumn("tp", F.lit(1))
    return masks.join(won, ["scan_id", "mask_id"], "left").select("scan_id", "mask_id", "score_pct", F.coalesce("tp", F.lit(0)).alias("tp"))


def precision_recall(scored: DataFrame, n_gt: int | F.Column) -> DataFrame:
    """(score_pct, precision, recall) at each distinct score, from counts of hits at or above it."""
    one = scored.groupBy("score_pct").agg(F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("score_pct"))  # a row a distinct score, 100 at most
    return one.select("score_pct", F.sum("tp").over(down).alias("hits"), F.sum("n").over(down).alias("kept")).select("score_pct", ratio(F.col("hits"), F.col("kept")).alias("precision"), ratio(F.col("hits"), n_gt if isinstance(n_gt, F.Column) else F.lit(n_gt)).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Area under the curve: each precision weighs half the recall between its two neighbours; the curve ends at recall 0 with precision 1."""
    closed = curve.select("score_pct", "precision", "recall").unionByName(curve.sparkSession.createDataFrame([(101, 1.0, 0.0)], "score_pct int, precision double, recall double"))
    order = Window.partitionBy(F.lit(0)).orderBy("score_pct")
    before, after = F.coalesce(F.lag("recall").over(order), F.col("recall")), F.lead("recall").over(order)
    step = (before - F.coalesce(after, F.lit(0.0))) / 2
    return closed.withColumn("step", step).agg(F.round(F.sum(F.col("precision") * F.col("step")), 6).alias("ap"))
