"""Forward values of the training losses, and the matchings that they need, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemline.functions import vectors as V
from stemline.operators.lineage import hold
from stemline.operators.masks import components


def label_means(vectors: DataFrame) -> DataFrame:
    """(label, place, mean): mean vector of each label, a row a component."""
    return vectors.select("label", F.posexplode("embedding").alias("place", "v")).groupBy("label", "place").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def mean_distances(vectors: DataFrame) -> DataFrame:
    """Distance of each vector to the mean of its label, and exp of its negative."""
    m = label_means(vectors).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("mean"))
    d = V.distance(F.col("embedding"), F.col("mean"))
    return vectors.join(m, "label").select("vec_id", "label", F.round(d, 6).alias("distance"), F.round(F.exp(-d), 6).alias("score"))


def covariances(vectors: DataFrame, dims: int = 3) -> DataFrame:
    """Covariances of the first `dims` components within each label."""
    x = [F.get("embedding", F.lit(k)).cast("double") for k in range(dims)]
    return vectors.groupBy("label").agg(*[F.round(F.covar_samp(x[i], x[j]), 6).alias(f"c{i}{j}") for i in range(dims) for j in range(i, dims)])


def mahalanobis(vectors: DataFrame, dims: int = 5, epsilon: float = 1e-6) -> DataFrame:
    """Squared Mahalanobis distance of each vector within its label over the first `dims` components, and exp of its negative.

    Moments are gathered by aggregates; only their small inverses, one a label, are numpy's.
    """
    import numpy as np
    import pandas as pd

    x = [F.get("embedding", F.lit(k)).cast("double") for k in range(dims)]
    moments = vectors.groupBy("label").agg(F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.covar_samp(x[i], x[j]) for i in range(dims) for j in range(dims)]).alias("cov"))

    def invert(parts):
        for pdf in parts:
            pdf["inverse"] = [np.linalg.inv(np.array(c).reshape(dims, dims) + epsilon * np.eye(dims)).ravel().tolist() if c is not None and None not in list(c) and not np.isnan(c).any() else None for c in pdf["cov"]]
            yield pd.DataFrame(pdf[["label", "mean", "inverse"]])

    inverse = moments.mapInPandas(invert, "label int, mean array<double>, inverse array<double>")
    d = F.zip_with(F.slice("embedding", 1, dims), "mean", lambda a, b: a.cast("double") - b)
    rows = vectors.join(inverse, "label").withColumn("d", d)
    quad = sum(F.get("d", F.lit(i)) * F.get("d", F.lit(j)) * F.get("inverse", F.lit(i * dims + j)) for i in range(dims) for j in range(dims))
    return rows.select("vec_id", "label", F.round(quad, 4).alias("d2"), F.round(F.exp(-quad), 6).alias("score"))


def minmax_scores(points: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within each predicted instance; 1 where all are equal."""
    part = points.where("instance_pred >= 0").groupBy("scan_id", "instance_pred").agg(F.min("score_pct").alias("lo"), F.max("score_pct").alias("hi"))
    s = F.when(F.col("hi") > F.col("lo"), (F.col("score_pct") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).otherwise(1.0)
    return points.join(part, ["scan_id", "instance_pred"]).select("scan_id", "point_id", F.round(s, 6).alias("score"))


def discriminative_loss(vectors: DataFrame, pull: float = 0.5, push: float = 1.5) -> DataFrame:
    """Pull of vectors to their label's mean, push between means, and mean L1 norm of the means."""
    m = label_means(vectors).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("mean"))
    near = vectors.join(m, "label").withColumn("h", F.greatest(V.distance(F.col("embedding"), F.col("mean")) - pull, F.lit(0.0)))
    var = near.groupBy("label").agg(F.avg(F.col("h") * F.col("h")).alias("v")).agg(F.avg("v").alias("pull"))
    two = m.toDF("a", "ma").join(m.toDF("b", "mb"), F.col("a") < F.col("b"))  # labels are few
    gap = F.greatest(2 * push - V.distance(F.col("ma"), F.col("mb")), F.lit(0.0))
    far = two.agg(F.avg(gap * gap).alias("push"))
    size = m.agg(F.avg(V.total(F.transform("mean", F.abs))).alias("norm"))
    return var.join(far, F.lit(True)).join(size, F.lit(True)).select(F.round("pull", 6).alias("pull"), F.round("push", 6).alias("push"), F.round("norm", 6).alias("norm"))


def offset_loss(offsets: DataFrame) -> DataFrame:
    """L1 distance and negative cosine of offsets(scan_id, px, py, pz, gx, gy, gz), predicted against true."""
    p, g, q = offsets, [F.col("g" + a) for a in "xyz"], [F.col("p" + a) for a in "xyz"]
    l1 = sum(F.abs(a - b) for a, b in zip(q, g))
    size = lambda v: F.sqrt(sum(a * a for a in v))
    cosine = sum(a * b for a, b in zip(q, g)) / (size(q) + 1e-8) / (size(g) + 1e-8)
    return p.groupBy("scan_id").agg(F.round(F.avg(l1), 4).alias("l1"), F.round(-F.avg(cosine), 4).alias("direction"))


def focal_loss(heat: DataFrame, centre: float = 0.95) -> DataFrame:
    """Focal loss of heat(scan_id, heat, target); targets of at least `centre` are centres."""
    o, t = F.col("heat"), F.col("target")
    neg = F.log(1 - o) * F.pow(o, F.lit(3.0)) * F.pow(1 - t, F.lit(6.0))
    pos = F.when(t >= centre, F.log(o) * F.pow(1 - o, F.lit(3.0))).otherwise(0.0)
    return heat.groupBy("scan_id").agg(F.round(-(F.sum(neg) + F.sum(pos)) / F.greatest(F.count_if(t >= centre), F.lit(1)), 4).alias("focal"))


def cropped_iou(mask_points: DataFrame, points: DataFrame, ratios: DataFrame) -> DataFrame:
    """(scan_id, mask_id, instance_gt, iou): soft IoU of masks, whose points have probabilities p, with the true trees they meet, each tree's area put right for the part of it, ratios(scan_id, instance_gt, ratio), that the crop holds."""
    tree = points.where("instance_gt > 0").select("scan_id", "point_id", "instance_gt")
    size = tree.groupBy("scan_id", "instance_gt").agg(F.count(F.lit(1)).alias("g_n")).join(ratios, ["scan_id", "instance_gt"])
    mass = mask_points.groupBy("scan_id", "mask_id").agg(F.sum("p").alias("p_sum"))
    hit = mask_points.join(tree, ["scan_id", "point_id"]).groupBy("scan_id", "mask_id", "instance_gt").agg(F.sum("p").alias("hit"))
    both = hit.join(mass, ["scan_id", "mask_id"]).join(size, ["scan_id", "instance_gt"])
    return both.select("scan_id", "mask_id", "instance_gt", F.round(F.col("hit") / (F.col("g_n") / F.col("ratio") + F.col("p_sum") - F.col("hit") + 1e-6), 6).alias("iou"))


def mask_costs(mask_points: DataFrame, points: DataFrame) -> DataFrame:
    """Dice and cross-entropy of each scored mask against each true tree that it meets; mask_points has the probabilities p."""
    held = mask_points
    mass = held.groupBy("scan_id", "mask_id").agg(F.sum("p").alias("p_sum"), F.sum(F.log(1 - F.col("p") * 0.99)).alias("off"), F.count(F.lit(1)).alias("n"))
    tree = points.where("instance_gt > 0").select("scan_id", "point_id", "instance_gt")
    size = tree.groupBy("scan_id", "instance_gt").agg(F.count(F.lit(1)).alias("g_n"))
    both = held.join(tree, ["scan_id", "point_id"]).groupBy("scan_id", "mask_id", "instance_gt").agg(F.sum("p").alias("hit"), F.sum(F.log("p") - F.log(1 - F.col("p") * 0.99)).alias("gain"))
    out = both.join(mass, ["scan_id", "mask_id"]).join(size, ["scan_id", "instance_gt"])
    return out.select("scan_id", "mask_id", "instance_gt", F.round(1 - (2 * F.col("hit") + 1) / (F.col("p_sum") + F.col("g_n") + 1), 6).alias("dice"), F.round(-(F.col("off") + F.col("gain")) / F.col("n"), 6).alias("bce"))


def iou_losses(matches: DataFrame, masks: DataFrame) -> DataFrame:
    """Losses of the scores against best IoUs: cross-entropy against a ramp from 0.25 to 0.75, squared error from 0.5 on, plain cross-entropy."""
    best = matches.groupBy("scan_id", "mask_id").agg(F.max("iou").alias("iou"))
    m = masks.join(best, ["scan_id", "mask_id"]).withColumn("s", F.col("score_pct") / 100.0)
    ramp = V.clamp((F.col("iou") - 0.25) / 0.5, 0.0, 1.0)
    bce = lambda t: -(t * F.log("s") + (1 - t) * F.log(1 - F.col("s") * 0.999))
    high = F.col("iou") >= 0.5
    return m.groupBy("scan_id").agg(F.round(F.avg(bce(ramp)), 5).alias("ramp"), F.round(F.sum(F.when(high, (F.col("s") - F.col("iou")) * (F.col("s") - F.col("iou")))) / F.greatest(F.count_if(high), F.lit(1)), 5).alias("mse"), F.round(F.avg(bce(F.col("iou"))), 5).alias("bce"))


def one_to_many(mask_points: DataFrame, points: DataFrame, masks: DataFrame) -> DataFrame:
    """Each mask's query point (its smallest) and the first true tree that holds it, -1 without one."""
    q = mask_points.groupBy("scan_id", "mask_id").agg(F.min("point_id").alias("point_id"))
    g = points.where("instance_gt > 0").select("scan_id", "point_id", "instance_gt")
    hit = q.join(g, ["scan_id", "point_id"], "left").groupBy("scan_id", "mask_id").agg(F.min("instance_gt").alias("g"))
    return masks.join(hit, ["scan_id", "mask_id"], "left").select("scan_id", "mask_id", F.coalesce("g", F.lit(-1).cast("bigint")).alias("instance_gt"))


def sparse_matches(costs: DataFrame, k: int = 2) -> DataFrame:
    """Masks whose cost for a true tree is strictly below its (k+1)-th smallest, so that ties at the border go out."""
    order = Window.partitionBy("scan_id", "instance_gt").orderBy("dice", "mask_id")
    ranked = costs.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1)
    limit = ranked.groupBy("scan_id", "instance_gt").agg(F.max(F.when(F.col("turn") == k + 1, F.col("dice"))).alias("most"))
    return ranked.join(limit, ["scan_id", "instance_gt"]).where((F.col("turn") <= k) & (F.col("most").isNull() | (F.col("dice") < F.col("most")))).select("scan_id", "instance_gt", "mask_id")


def assignment(cost) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of rows to columns, by shortest augmenting paths with potentials."""
    import numpy as np

    c = np.asarray(cost, float)
    flip = c.shape[0] > c.shape[1]
    c = c.T if flip else c
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        here, last = row, -1
        while True:
            reduced = c[here] - u[here] - v
            base = 0.0 if last < 0 else least[last]
            better = ~done & (reduced + base < least)
            least[better], via[better] = (reduced + base)[better], last
            last = int(np.where(done, np.inf, least).argmin())
            done[last] = True
            if owner[last] < 0:
                break
            here = owner[last]
        end = least[last]
        closed = np.flatnonzero(done & (least < end))
        u[row] += end
        for j in closed:
            u[owner[j]] += end - least[j]
            v[j] -= end - least[j]
        while last >= 0:
            prev = via[last]
            owner[last] = row if prev < 0 else owner[prev]
            last = prev
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) for i, j in pairs) if flip else sorted(pairs)


def sparse_assignment(rows: list[int], columns: list[int], cost: list[float]) -> list[int]:
    """Places of the pairs in the cheapest one-to-one assignment, where a row without a column costs 1.

    Shortest augmenting paths with potentials over the listed pairs alone; rows and columns are numbered from 0, rows in order.
    """
    from heapq import heappop, heappush

    n = rows[-1] + 1 if rows else 0
    first = [0] * (n + 1)
    for i in rows:
        first[i + 1] += 1
    for i in range(n):
        first[i + 1] += first[i]
    u, v = [0.0] * n, [0.0] * (max(columns, default=-1) + 1)
    owner, match = [-1] * len(v), [-1] * n
    for start in range(n):
        dist, via, done, heap = {}, {}, [], []
        closed, here, base, end, alone, free = set(), start, 0.0, float("inf"), -1, -1
        while True:
            if base + 1 - u[here] < end:
                end, alone = base + 1 - u[here], here
            for e in range(first[here], first[here + 1]):
                j = columns[e]
                d = base + cost[e] - u[here] - v[j]
                if j not in closed and d < dist.get(j, end):
                    dist[j], via[j] = d, e
                    heappush(heap, (d, j))
            while heap and heap[0][1] in closed:
                heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            base, last = heappop(heap)
            if owner[last] < 0:
                end, free = base, last
                break
            closed.add(last)
            done.append(last)
            here = owner[last]
        u[start] += end
        for j in done:
            u[owner[j]] += end - dist[j]
            v[j] -= end - dist[j]
        if free < 0 and alone != start:  # a row gives its column up
            free, match[alone] = columns[match[alone]], -1
        while free >= 0:
            e = via[free]
            i, before = rows[e], match[rows[e]]
            owner[free], match[i] = i, e
            free = -1 if i == start else columns[before]
    return [e for e in match if e >= 0]


def hungarian(costs: DataFrame) -> DataFrame:
    """(scan_id, mask_id, instance_gt): the one-to-one matching of least total Dice cost, scan by scan; pairs that don't meet cost 1.

    A pair that costs 1 is worth as much as none, so masks that no chain of meeting pairs connects are matched apart. A connected component is one
    task's, which holds its pairs, not their matrix.
    """
    import numpy as np
    import pandas as pd

    pairs = hold(costs.select("scan_id", "mask_id", "instance_gt", "dice").where("dice < 1"))
    least = pairs.groupBy("scan_id", "instance_gt").agg(F.min("mask_id").alias("b"))
    links = pairs.join(least, ["scan_id", "instance_gt"]).where("mask_id <> b").select("scan_id", F.col("mask_id").alias("a"), "b")
    root = components(links, pairs.select("scan_id", "mask_id").distinct())
    key = ["scan_id", "root"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # components don't meet, so that all of them are solved in one go
        _, i = np.unique(pdf[["scan_id", "mask_id"]].to_records(index=False), return_inverse=True)
        _, j = np.unique(pdf[["scan_id", "instance_gt"]].to_records(index=False), return_inverse=True)
        order = np.lexsort((j, i))
        kept = sparse_assignment(i[order].tolist(), j[order].tolist(), pdf["dice"].to_numpy()[order].tolist())
        return pdf.iloc[order[kept]][["scan_id", "mask_id", "instance_gt"]]

    def run(parts):
        held = None
        for pdf in parts:
            held = pdf if held is None else pd.concat([held, pdf])
            ends = (held[key] != held[key].iloc[-1]).any(axis=1).to_numpy() if len(held) else np.zeros(0, bool)
            if ends.any():  # the last component may go on
                yield solve(held[ends])
                held = held[~ends]
        if held is not None and len(held):
            yield solve(held)

    met = pairs.join(root, ["scan_id", "mask_id"]).repartition(*key).sortWithinPartitions(*key)
    return met.select(*key, "mask_id", "instance_gt", "dice").mapInPandas(run, "scan_id int, mask_id bigint, instance_gt bigint")
