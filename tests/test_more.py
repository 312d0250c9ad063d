"""Two-table joins, sinks and readers of later rounds, against plain restatements."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemline.operators import nearest
from stemline.sources import arrays, las, ply, sinks, store, text
from stemline.streaming import ingest


def test_nearest_join_equals_brute_force(spark):
    rng = random.Random(4)
    pts = [(k % 3, k, rng.randrange(4000), rng.randrange(4000), rng.randrange(300)) for k in range(400)] + [(9, 1000, 1, 1, 1), (0, 1001, -90_000, 5, 5)]
    smp = [(k % 3, k, rng.randrange(4000), rng.randrange(4000), rng.randrange(300)) for k in range(20)] + [(1, 50, 7, 7, 7), (1, 51, 7, 7, 7)]
    df = spark.createDataFrame(pts, "scan_id int, point_id bigint, x_cm bigint, y_cm bigint, z_cm bigint")
    sm = spark.createDataFrame(smp, "scan_id int, sample_id bigint, x_cm bigint, y_cm bigint, z_cm bigint")
    got = {(r.scan_id, r.point_id): (r.sample_id, r.d2) for r in nearest.nearest_join(df, sm).collect()}
    assert len(got) == len(pts)
    for s, i, *p in pts:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for t, j, *q in smp if t == s)
        assert got[s, i] == ((near[0][1], near[0][0]) if near else (None, None))
    assert {r.sample_id for r in nearest.nearest_join(df.where("scan_id = 9"), sm).collect()} == {None}
    assert nearest.nearest_join(df.where("false"), sm).count() == 0


@pytest.mark.parametrize("ascii_", ["false", "true"])
def test_a_scan_over_several_tasks_is_one_whole_file(spark, tmp_path, ascii_):
    ply.register(spark)
    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("scan"), F.col("id").cast("int").alias("v"), (F.col("id") / 3).alias("w")).repartition(6)
    df.write.format("ply").option("by", "scan").option("ascii", ascii_).mode("overwrite").save(str(tmp_path / "o"))
    assert sorted(os.listdir(tmp_path / "o")) == ["a.ply", "b.ply"]
    back = spark.read.format("ply").load(f"file://{tmp_path}/o").collect()
    assert sorted((r.scan_id, r.v, r.w) for r in back) == sorted(("a" if k < 900 else "b", k, k / 3) for k in range(1000))


def test_split_of_assigned_and_leftover(spark, tmp_path):
    ply.register(spark)
    rows = [(1, k, float(k), 0.0, 0.0, [0, 1, 2][k % 3], -1 if k % 2 else 5) for k in range(12)]
    df = spark.createDataFrame(rows, "scan_id int, point_id bigint, x double, y double, z double, semantic_pred int, instance_pred int").repartition(3)
    before = spark.createDataFrame([(1, 1, 0)], "scan_id int, point_id bigint, semantic_pred int")
    sinks.write_split(df, str(tmp_path), 2, ["x", "semantic_pred", "instance_pred"], before=before)
    assert sorted(os.listdir(tmp_path)) == ["1_2.ply", "1_bluepoints_2.ply"]
    left = {r.x for r in spark.read.format("ply").load(str(tmp_path / "1_bluepoints_2.ply")).collect()}
    assert left == {k for _, k, *_ in rows if k % 2 and k % 3 and k != 1}
    assert spark.read.format("ply").load(str(tmp_path)).count() == 12


@pytest.mark.parametrize("kind", ["npy", "bin"])
def test_array_sinks(spark, tmp_path, kind):
    df = spark.range(5000).select((F.col("id") % 3).alias("scan_id"), F.col("id").alias("point_id"), (F.col("id") * 2).alias("u"), (F.col("id") / 4).alias("v")).repartition(5)
    got = {r.file: r.rows for r in sinks.write_arrays(df, str(tmp_path / "a"), ["u", "v"], kind=kind).collect()}
    assert got == {f"{s}.{kind}": len(range(s, 5000, 3)) for s in range(3)} and len(os.listdir(tmp_path / "a")) == 3
    data = np.load(tmp_path / "a" / "1.npy") if kind == "npy" else np.fromfile(tmp_path / "a" / "1.bin", "<f4").reshape(-1, 2)
    assert data.tolist() == [[2.0 * k, k / 4] for k in range(1, 5000, 3)]
    if kind == "bin":
        assert arrays.read_bin(spark, str(tmp_path / "a"), ["u", "v"]).count() == 5000


def test_metric_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "scan_id int, pq double")
    for _ in range(2):
        sinks.write_metric_logs(df, df.agg(F.avg("pq").alias("pq")), str(tmp_path))
    assert (tmp_path / "1.txt").read_text() == "pq: 0.5\n"
    assert [json.loads(x) for x in (tmp_path / "total.txt").read_text().splitlines()] == [{"pq": 0.375}] * 2


def test_las_reader(spark, tmp_path):
    n = 7
    columns = {a: np.arange(n) + 0.5 for a in "xyz"} | {e[0]: np.arange(n) for e in las.EXTRA}
    las.write_las(str(tmp_path / "s.las"), columns, (0, 0, 0))
    got = sorted(tuple(r) for r in las.read_scans(spark, str(tmp_path), rows=3).collect())
    assert [(r[0], r[1], round(r[2], 3), r[5], r[9]) for r in got] == [("s", k, k + 0.5, k, k) for k in range(n)]
    df = spark.read.format("noop") if False else spark.createDataFrame([(f"t{k % 2}", float(k), 0.0, 0.0, 0.0, 0.0, 0.0, 1, k, 0.5, 1, k) for k in range(6)], "scan_id string, x double, y double, z double, ox double, oy double, oz double, semantic_pred int, instance_pred int, score float, semantic_gt int, instance_gt int")
    las.write_scans(df, f"file://{tmp_path}/out")
    back = las.read_scans(spark, str(tmp_path / "out"))
    assert sorted((r.scan_id, r.x, r.instance_gt) for r in back.collect()) == sorted((f"t{k % 2}", float(k), k) for k in range(6))


def test_superpoints_fall_back(spark, tmp_path):
    (tmp_path / "local").mkdir()
    np.arange(5, dtype="<i8").tofile(tmp_path / "local" / "a.bin")
    got = arrays.read_superpoints(spark, str(tmp_path / "none"), str(tmp_path / "local"))
    assert sorted(r.superpoint for r in got.collect()) == list(range(5))
    with pytest.raises(FileNotFoundError):
        arrays.read_superpoints(spark, str(tmp_path / "none"))


def test_routing_refuses_unknown_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "scan_id int, x double, label int")
    row = text.routed(df, {"inputs": ["x"], "samples": ["label"], "meta": ["pose"]}, ["scan_id"]).first()
    assert row.inputs.x == 2.0 and row.samples.label == 3 and len(row) == 3
    with pytest.raises(KeyError):
        text.routed(df, {"inputs": ["x"]}, ["scan_id"])


def test_logs_are_tailed(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"epoch": 1, "loss": 2.0}\n{"epoch": 1, "loss": 4.0}\n{"config": 1}\n')
    q = ingest.tailed_logs(spark, str(tmp_path)).writeStream.format("memory").queryName("tailed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("tailed").collect()] == [(1, "loss", 2, 3.0)]


def test_best_scores_and_votes_run_on(spark, tmp_path):
    spark.createDataFrame([(1, 1, 5, 0.5), (1, 1, 4, 0.5), (1, 1, 9, 0.25)], "scan_id int, point_id int, mask_id int, score double").write.parquet(str(tmp_path / "s"))
    stream = ingest.arriving(spark, str(tmp_path / "s"), "scan_id int, point_id int, mask_id int, score double")
    for name, df in (("best", ingest.best_scores(stream)), ("voted", ingest.running_votes(stream.withColumn("vote", F.col("mask_id") % 2)))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("best").collect()] == [(1, 1, 0.5, 4)]
    assert sorted((r.vote, r.n) for r in spark.table("voted").collect()) == [(0, 1), (1, 2)]
    done = spark.createDataFrame([(1,)], "scan_id int")
    assert ingest.pending(spark.createDataFrame([(1,), (2,)], "scan_id int"), done).collect()[0].scan_id == 2


def test_listing(tmp_path):
    for n in ("b.ply", "a.ply", "c.txt"):
        (tmp_path / n).write_text("")
    assert [os.path.basename(x) for x in store.listing(f"file://{tmp_path}", "*.ply")] == ["a.ply", "b.ply"]
    assert len(store.listing(str(tmp_path / "a.*"), "*")) == 1 and len(store.listing(str(tmp_path / "c.txt"), "*.ply")) == 1
