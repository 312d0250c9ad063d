"""Edge cases of the point and mask operators."""

import pytest
from pyspark.sql import functions as F

from stemline.operators import boxes, geo, labels, masks, metrics, rounds

POINT = "point_id bigint, scan_id int, x_cm bigint, y_cm bigint, z_cm bigint, semantic_gt int, semantic_pred int, instance_gt bigint, instance_pred bigint, score_pct int"


def cloud(spark, rows):
    return spark.createDataFrame([(k, 0, *r) for k, r in enumerate(rows)], POINT)


def test_voxels_floor_and_truncate(spark):
    p = cloud(spark, [(x, 0, 0, 0, 0, 0, -1, 50) for x in (-21, -20, -1, 0, 19, 20)])
    for mode, want in (("floor", [-2, -1, -1, 0, 0, 1]), ("trunc", [-1, -1, 0, 0, 0, 1])):
        assert [r.vx for r in geo.with_voxels(p, 20, mode).orderBy("point_id").collect()] == want


def test_vote_tie_and_no_points(spark):
    rows = spark.createDataFrame([(1, 2), (1, 0), (2, 1)], "k int, c int")
    assert {r.k: r.m for r in metrics.most_frequent(rows, ["k"], "c", "m").collect()} == {1: 0, 2: 1}
    none = cloud(spark, [(0, 0, 0, 0, 0, 0, -1, 50)]).where("false")
    assert metrics.panoptic(none).count() == 0 and geo.voxel_mean(none).count() == 0 and labels.dense_relabel(none).count() == 0


def test_small_instances_at_the_border(spark):
    rows = [(0, 0, 0, 1, 1, 1, i, 50) for i, n in ((1, 9), (2, 10), (3, 11)) for _ in range(n)]
    got = {r.instance_pred for r in labels.drop_small(cloud(spark, rows)).collect()}
    assert got == {-1, 2, 3}


def test_iou_of_one_half_counts(spark):
    rows = [(0, 0, 0, 1, 1, 7, 4, 50)] * 2 + [(0, 0, 0, 1, 1, 7, -1, 50)] * 2
    r = metrics.panoptic(cloud(spark, rows)).first()
    assert (r.n_pred, r.tp, r.n_gt, r.sq) == (1, 1, 1, 0.5)


def test_scans_without_one_side(spark):
    only_true = metrics.panoptic(cloud(spark, [(0, 0, 0, 1, 1, 7, -1, 50)])).first()
    assert (only_true.n_pred, only_true.tp, only_true.n_gt, only_true.pq, only_true.prec) == (0, 0, 1, 0.0, None)


def test_noise_needs_points_and_ground(spark):
    ground = [(0, 0, 10, 0, 0, 0, -1, 50)]
    tree = lambda i, n, x: [(x, 0, 110 + 60 * k, 1, 1, i, i, 50) for k in range(n)]
    rows = ground + tree(1, 4, 0) + tree(2, 5, 0) + tree(3, 6, 5000) + [(0, 0, 10, 1, 1, 4, 4, 50)] * 5
    got = {r.instance_pred: r.score for r in geo.noise_scores(cloud(spark, rows)).collect()}
    assert got == {1: 1e6, 2: 0.05, 3: 1e6, 4: 1e6}


def test_nearest_sample_outside_the_own_voxel(spark):
    rows = [(19, 10, 10, 0, 0, 0, -1, 50), (0, 10, 10, 0, 0, 0, -1, 50), (0, 10, 10, 0, 0, 0, -1, 50), (21, 10, 10, 0, 0, 0, -1, 50)]
    got = {r.point_id: r.vx for r in geo.nearest_sample(cloud(spark, rows)).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 1}


def test_nearest_sample_like_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    xyz = rng.integers(0, 150, (400, 3))
    p = cloud(spark, [(int(x), int(y), int(z), 0, 0, 0, -1, 50) for x, y, z in xyz])
    cells = {}
    for q in xyz:
        cells.setdefault(tuple((q // 20).tolist()), []).append(q)
    means = {k: np.mean(v, axis=0) for k, v in cells.items()}
    for r in geo.nearest_sample(p).collect():
        best = min((round(float(((xyz[r.point_id] - m) ** 2).sum()), 6), k) for k, m in means.items())
        assert (r.vx, r.vy, r.vz) == best[1]


def test_nearest_sample_is_never_broadcast(spark, tmp_path):
    # a small file, of which Spark thinks that what its rows turn into is small, too
    cloud(spark, [(k % 50, k % 70, k % 90, 0, 0, 0, -1, 50) for k in range(500)]).write.parquet(str(tmp_path / "p"))
    got = geo.nearest_sample(spark.read.parquet(str(tmp_path / "p")))
    assert got.count() == 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_suppression_keeps_exactly_three_tenths(spark):
    mp = spark.createDataFrame([(0, 1, k) for k in range(10)] + [(0, 2, k) for k in range(7, 17)] + [(0, 3, k) for k in (0, 1, 2, 3, 20, 21, 22, 23, 24, 25)], "scan_id int, mask_id bigint, point_id bigint")
    m = spark.createDataFrame([(0, 1, 90, 10), (0, 2, 80, 10), (0, 3, 70, 10)], "scan_id int, mask_id bigint, score_pct int, n_points bigint")
    got = {r.point_id: r.mask_id for r in masks.greedy_suppress(mp, m).collect()}
    assert got[7] == 2 and got[6] == 1 and got[0] == 1 and 20 not in got


def test_rounds_stop(spark):
    p = cloud(spark, [(k, 0, 0, 1, 1, 1, -1, 50) for k in range(6)])
    calls = []

    def assign(left, k):
        calls.append(k)
        return left.select("scan_id", "point_id", F.when(F.col("point_id") < 3, 0).otherwise(-1).cast("bigint").alias("instance"))

    got = {r.point_id: r.instance for r in rounds.iterate(p, assign, 5).collect()}
    assert calls == [0, 1] and got == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1}


def test_region_merge(spark):
    rows = [(0, 0, p, 1) for p in range(10)] + [(0, 1, p, 5) for p in range(6, 12)] + [(0, 2, p, 5) for p in range(11, 30)]
    got = {r.point_id: r.label for r in boxes.region_merge(spark.createDataFrame(rows, "scan_id int, region_id bigint, point_id bigint, local bigint")).collect()}
    assert {got[p] for p in range(12)} == {0} and {got[p] for p in range(12, 30)} == {1}


def test_pipelines_by_name(spark):
    df = spark.range(10)
    known = {"over": lambda d, least: d.where(F.col("id") > least)}
    assert boxes.chain(df, [("over", {"least": 4}), ("over", {"least": 7})], known).count() == 2
    with pytest.raises(KeyError, match="other is not registered"):
        boxes.chain(df, [("other", {})], known)


def test_vertex_normals(spark):
    from stemline.operators import graph

    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 0.0, 0.0, 1.0)], "scan_id int, vertex_id int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 1, 3), (0, 2, 0, 0, 1)], "scan_id int, face_id int, v1 int, v2 int, v3 int")
    got = {r.vertex_id: (r.nx, r.ny, r.nz) for r in graph.vertex_normals(v, f).collect()}
    assert got[2] == (0, 0, 1) and got[3] == (0, -1, 0)
    assert [r.nz for r in graph.face_normals(v, f).orderBy("face_id").collect()] == [1, 0, 0]
