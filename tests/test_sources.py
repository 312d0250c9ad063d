"""PLY reading and writing, split lists, logs, streams."""

import json
import os

import numpy as np
import pytest

from stemline.sources import ply, text
from stemline.streaming import ingest

ROWS = [(0.5, -1.25, 2.0, 1, 7), (3.0, 4.0, -5.5, 3, 9)]
NAMES, KINDS = ["x", "y", "z", "semantic_seg", "treeID"], ["float", "double", "double", "int", "int"]


@pytest.mark.parametrize("ascii_", [False, True])
def test_scan(spark, tmp_path, ascii_):
    ply.register(spark)
    ply.write_file(str(tmp_path / "a.ply"), NAMES, KINDS, ROWS, ascii_)
    ply.write_file(str(tmp_path / "b.ply"), NAMES, KINDS, [], ascii_)
    df = spark.read.format("ply").load(str(tmp_path))
    assert [tuple(r) for r in df.orderBy("point_id").collect()] == [("a", k, *r) for k, r in enumerate(ROWS)]
    assert dict(df.dtypes)["x"] == "float" and dict(df.dtypes)["treeID"] == "int"


def test_big_endian_comments_and_lists(spark, tmp_path):
    ply.register(spark)
    head = "ply\nformat binary_big_endian 1.0\ncomment x\nelement vertex 2\nproperty ushort a\nproperty double b\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    data = np.array([(65535, 1.5), (2, -2.5)], dtype=[("a", ">u2"), ("b", ">f8")]).tobytes() + np.uint8(3).tobytes() + np.array([0, 1, 1], ">i4").tobytes()
    (tmp_path / "m.ply").write_bytes(head.encode() + data)
    assert [(r.a, r.b) for r in spark.read.format("ply").load(str(tmp_path)).collect()] == [(65535, 1.5), (2, -2.5)]
    assert spark.read.format("ply").option("element", "face").load(str(tmp_path)).first().vertex_indices == [0, 1, 1]


def test_refuses(spark, tmp_path):
    for name, content in (("a", b"plyx\n"), ("b", b"ply\nformat ascii 1.0\nelement vertex 0\nproperty quad x\nend_header\n"), ("c", b"ply\nformat ascii 1.0\n")):
        (tmp_path / f"{name}.ply").write_bytes(content)
        with open(tmp_path / f"{name}.ply", "rb") as f, pytest.raises(ply.PlyError):
            ply.read_header(f)
    with pytest.raises(FileNotFoundError):
        ply._files(str(tmp_path / "none" / "*.ply"))


@pytest.mark.parametrize("ascii_", ["false", "true"])
def test_round_trip(spark, tmp_path, ascii_):
    ply.register(spark)
    df = spark.createDataFrame([("s1", *r) for r in ROWS] + [("s2", *ROWS[0])], "scan string, x float, y double, z double, semantic_seg int, treeID int")
    df.repartition(1).write.format("ply").option("by", "scan").option("ascii", ascii_).mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["s1.ply", "s2.ply"]
    back = spark.read.format("ply").load(str(tmp_path / "out"))
    assert sorted(tuple(r)[2:] for r in back.collect()) == sorted([*ROWS, ROWS[0]])


def test_prediction_layouts(spark, tmp_path):
    ply.register(spark)
    ply.write_file(str(tmp_path / "a.ply"), NAMES, KINDS, ROWS)
    r = ply.read_predictions(spark, str(tmp_path / "a.ply")).orderBy("point_id").first()
    assert (r.semantic_pred, r.instance_pred, r.score, r.instance_gt) == (0, -1, 0.0, 7)
    ply.write_file(str(tmp_path / "b.ply"), ["x", "y", "z", "semantic_pred", "instance_pred", "score"], ["float"] * 3 + ["int", "int", "float"], [(1, 2, 3, 1, 5, 0.5)])
    r = ply.read_predictions(spark, str(tmp_path / "b.ply")).first()
    assert (r.instance_pred, r.score, r.instance_gt) == (5, 0.5, -1)
    ply.write_file(str(tmp_path / "c.ply"), ["x", "y", "z"], ["float"] * 3, [(1, 2, 3)])
    with pytest.raises(ValueError, match="neither"):
        ply.read_predictions(spark, str(tmp_path / "c.ply"))
    assert ply.with_labels(spark.read.format("ply").load(str(tmp_path / "c.ply"))).first().semantic_seg == 1


def test_texts(spark, tmp_path):
    (tmp_path / "split.txt").write_text("a_1 \nb\n\n")
    assert [r.scan_id for r in text.split_list(spark, str(tmp_path / "split.txt")).collect()] == ["a_1", "b"]
    lines = [json.dumps(x) for x in ({"env": 1}, {"epoch": 1, "time": 0.5}, {"epoch": 1, "val/pq": 0.25})]
    got = text.training_log(spark.createDataFrame([(x,) for x in lines], "value string")).where("key <> 'epoch'").collect()
    assert [(r.epoch, r.key, r.value, r.validation) for r in got] == [(1, "time", 0.5, False), (1, "val/pq", 0.25, True)]


def test_streams(spark, tmp_path):
    src, seen = tmp_path / "in", []
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "scan_id int, semantic_pred int")
    df.coalesce(1).write.parquet(str(src))
    stream = ingest.arriving(spark, str(src), "scan_id int, semantic_pred int")
    for _ in range(2):  # a restart reads nothing twice
        ingest.run_rounds(stream, lambda b, k: seen.extend(tuple(r) for r in b.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == [(0, 1), (0, 1), (1, 2)]
    q = ingest.class_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("counts").collect()) == [(0, 1, 2), (1, 2, 1)]


def test_las(spark, tmp_path):
    from stemline.sources import las

    rows = [("s", 400000.1234, 50.5, -3.25, 400000.9, 50.2, -7.0, 2, 11, 0.5, 1, 9), ("s", 400001.0, 51.0, 2.0, 400000.9, 50.2, -7.0, 0, -1, 0.0, 0, 0), ("t", 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1, 1, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "scan_id string, x double, y double, z double, ox double, oy double, oz double, semantic_pred int, instance_pred int, score float, semantic_gt int, instance_gt int")
    las.write_scans(df, str(tmp_path / "las"))
    assert sorted(os.listdir(tmp_path / "las")) == ["s.las", "t.las"]
    back = las.read_las(str(tmp_path / "las" / "s.las"))
    assert sorted(back["x"].round(3)) == [400000.123, 400001.0] and sorted(back["instance_pred"]) == [-1, 11] and sorted(back["score"]) == [0.0, 0.5]
    (tmp_path / "x.las").write_bytes(b"nope" * 100)
    with pytest.raises(ValueError, match="not a LAS"):
        las.read_las(str(tmp_path / "x.las"))


def test_arrays(spark, tmp_path):
    from stemline.sources import arrays

    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    got = arrays.read_npy(spark, str(tmp_path / "a.npy"), ["x", "y", "z"]).orderBy("point_id").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0.0, 1.0, 2.0), ("a", 1, 3.0, 4.0, 5.0)]
    np.arange(8, dtype="<f4").tofile(tmp_path / "p.bin")
    assert [tuple(r)[2:] for r in arrays.read_bin(spark, str(tmp_path / "p.bin"), ["x", "z"], use=[0, 2], load=4).orderBy("point_id").collect()] == [(0.0, 2.0), (4.0, 6.0)]
    np.array([5, -1], "<i8").tofile(tmp_path / "m.bin")
    assert [r.label for r in arrays.read_bin(spark, str(tmp_path / "m.bin"), ["label"], "<i8").orderBy("point_id").collect()] == [5, -1]
