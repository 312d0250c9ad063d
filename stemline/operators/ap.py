"""Average precision of scored masks over IoU thresholds, by class, with void points and least sizes."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: IoU thresholds in percent: 50 to 90 by 5, and 25.
OVERLAPS = (50, 55, 60, 65, 70, 75, 80, 85, 90, 25)


def contingency(mask_points: DataFrame, masks: DataFrame, truth: DataFrame, valid: Iterable[int], least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, true instances, overlaps) from mask_points(scan_id, mask_id, point_id), masks(scan_id, mask_id, class, score) and truth(scan_id, point_id, class, instance).

    Predictions have their size and the points of it that belong to no valid class; smaller ones and those of other
    classes go. An overlap is of one class.
    """
    kinds = list(valid)
    held = mask_points.join(truth.select("scan_id", "point_id", F.col("class").alias("g_class"), "instance"), ["scan_id", "point_id"])
    size = held.groupBy("scan_id", "mask_id").agg(F.count(F.lit(1)).alias("m_n"), F.count_if(~F.col("g_class").isin(kinds)).alias("void_n")).where(F.col("m_n") >= least)
    preds = masks.select("scan_id", "mask_id", "class", "score").where(F.col("class").isin(kinds)).join(size, ["scan_id", "mask_id"])
    true = truth.where(F.col("class").isin(kinds)).groupBy("scan_id", "class", "instance").agg(F.count(F.lit(1)).alias("g_n"))
    cell = held.groupBy("scan_id", "mask_id", F.col("g_class").alias("class"), "instance").agg(F.count(F.lit(1)).alias("n"))
    return preds, true, cell.join(preds, ["scan_id", "mask_id", "class"]).join(true, ["scan_id", "class", "instance"])


def scored_examples(preds: DataFrame, true: DataFrame, both: DataFrame, least: int = 100, overlaps: Iterable[int] = OVERLAPS) -> tuple[DataFrame, DataFrame]:
    """((overlap, class, score, hit) of what counts, (overlap, class, missed) of true instances without a match).

    True instances go in the order of their ids. Of the predictions over the threshold that no earlier one took, an instance takes the first; the
    best score of them all counts as its hit, the others as false. A prediction over the threshold with no instance at all is
    false, unless more than the threshold of it is void or belongs to instances that are too small. Only overlaps
    from the least threshold on, of which an instance and a prediction have three each at most, meet in a group: a scan's class.
    """
    levels = sorted(overlaps)
    iou = F.col("n") / (F.col("m_n") + F.col("g_n") - F.col("n"))
    near = both.withColumn("iou", iou).where(F.col("iou") > levels[0] / 100)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["instance", "mask_id"])
        for t in levels:
            taken: set = set()
            for instance, some in pdf[pdf["iou"] > t / 100].groupby("instance", sort=True):
                free = [(m, s) for m, s in zip(some["mask_id"], some["score"]) if m not in taken]
                if free:
                    taken.add(free[0][0])
                    out += [(t, k == 0, s) for k, s in enumerate(sorted((s for _, s in free), reverse=True))]
        rows = pd.DataFrame(out, columns=["overlap", "hit", "score"])
        return rows.assign(**{"class": pdf["class"].iloc[0]})[["overlap", "class", "score", "hit"]]

    kind = both.schema["class"].dataType.simpleString()
    met = near.where(F.col("g_n") >= least).groupBy("scan_id", "class").applyInPandas(match, f"overlap int, class {kind}, score double, hit boolean")
    level = F.explode(F.array(*map(F.lit, levels))).alias("overlap")
    touched = near.select("scan_id", "mask_id", level, "iou").where(F.col("iou") > F.col("overlap") / 100).select("scan_id", "mask_id", "overlap").distinct()
    small = both.where(F.col("g_n") < least).groupBy("scan_id", "mask_id").agg(F.sum("n").alias("small_n"))
    alone = preds.join(small, ["scan_id", "mask_id"], "left").select("*", level).join(touched, ["scan_id", "mask_id", "overlap"], "left_anti")
    alone = alone.where((F.col("void_n") + F.coalesce("small_n", F.lit(0))) / F.col("m_n") <= F.col("overlap") / 100)
    examples = met.unionByName(alone.select("overlap", "class", F.col("score").cast("double").alias("score"), F.lit(False).alias("hit")))
    asked = true.where(F.col("g_n") >= least).groupBy("class").agg(F.count(F.lit(1)).alias("asked")).select("class", "asked", level)
    hits = met.where("hit").groupBy("overlap", "class").agg(F.count(F.lit(1)).alias("hits"))
    return examples, asked.join(hits, ["overlap", "class"], "left").select("overlap", "class", (F.col("asked") - F.coalesce("hits", F.lit(0))).alias("missed"))


def precision_by_overlap(preds: DataFrame, examples: DataFrame, missed: DataFrame, valid: Iterable[int], overlaps: Iterable[int] = OVERLAPS) -> DataFrame:
    """(overlap, class, ap, best_precision, best_recall): null without true instances, 0 without predictions.

    The curve has a point for each distinct score and ends at precision 1, recall 0; a precision
    weighs half the recall between its neighbours. The best point has the largest F1, the lowest score on a tie.
    """
    spark = preds.sparkSession
    cells = spark.createDataFrame([(o, c) for o in overlaps for c in valid], "overlap int, class int")
    one = examples.groupBy("overlap", "class", "score").agg(F.count_if("hit").alias("t"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("overlap", "class").orderBy(F.desc("score"))  # rows: distinct scores
    total = F.sum("t").over(Window.partitionBy("overlap", "class"))
    curve = one.withColumn("tp", F.sum("t").over(up)).withColumn("kept", F.sum("n").over(up)).withColumn("total", total).join(missed, ["overlap", "class"])
    curve = curve.select("overlap", "class", "score", (F.col("tp") / F.col("kept")).alias("p"), F.when(F.col("total") + F.col("missed") > 0, F.col("tp") / F.nullif(F.col("total") + F.col("missed"), F.lit(0))).otherwise(0.0).alias("r"))
    order = Window.partitionBy("overlap", "class").orderBy("score")
    before, after = F.coalesce(F.lag("r").over(order), F.col("r")), F.coalesce(F.lead("r").over(order), F.lit(0.0))
    first = F.first("r").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the end point has precision 1 and half the recall of the last score before it
    last = F.lead("r").over(order).isNull()
    area = F.col("p") * (before - after) / 2 + F.when(last, F.col("r") / 2).otherwise(0.0)
    f1 = 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + 0.0001)
    best = curve.withColumn("area", area).withColumn("start", first).groupBy("overlap", "class").agg(F.sum("area").alias("ap"), F.max_by(F.struct("p", "r"), F.struct(f1.alias("f"), (-F.col("score")).alias("s"))).alias("b"))
    have = preds.select("class").distinct().withColumn("has_pred", F.lit(True))
    out = cells.join(missed, ["overlap", "class"], "left").join(have, "class", "left").join(best, ["overlap", "class"], "left")
    asked, told = F.col("missed").isNotNull(), F.coalesce("has_pred", F.lit(False))
    pick = lambda x, empty: F.when(asked & told, F.round(F.coalesce(x, F.lit(empty)), 6)).when(asked, 0.0)
    return out.select("overlap", "class", pick(F.col("ap"), 0.0).alias("ap"), pick(F.col("b.p"), 1.0).alias("best_precision"), pick(F.col("b.r"), 0.0).alias("best_recall"))


def averages(by_overlap: DataFrame) -> DataFrame:
    """(class, ap, ap50, ap25, precision50, recall50): means over classes (class null) and for each class; ap leaves 25 out."""
    at = lambda level, x: F.avg(F.when(F.col("overlap") == level, F.col(x)))
    sums = [F.avg(F.when(F.col("overlap") != 25, F.col("ap"))), at(50, "ap"), at(25, "ap"), at(50, "best_precision"), at(50, "best_recall")]
    names = ["ap", "ap50", "ap25", "precision50", "recall50"]
    rolled = by_overlap.select(F.explode(F.array(F.col("class"), F.lit(None).cast("int"))).alias("class"), "overlap", "ap", "best_precision", "best_recall")
    return rolled.groupBy("class").agg(*[F.round(s, 6).alias(n) for s, n in zip(sums, names)])


def evaluate(mask_points: DataFrame, masks: DataFrame, truth: DataFrame, valid: Iterable[int], least: int = 100, overlaps: Iterable[int] = OVERLAPS) -> DataFrame:
    """The whole protocol: average precision of each class at each threshold."""
    kinds = list(valid)
    preds, true, both = contingency(mask_points, masks, truth, kinds, least)
    examples, missed = scored_examples(preds, true, both, least, overlaps)
    return precision_by_overlap(preds, examples, missed, kinds, overlaps)
