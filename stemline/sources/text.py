"""Split lists, segment files, training logs and scan information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """Scan names of a split, a line each."""
    return spark.read.text(path).select(F.rtrim("value").alias("scan_id")).where("scan_id <> ''")


def segment_groups(documents: DataFrame, column: str = "json") -> DataFrame:
    """(object_id, label, segment) from aggregation files; object ids from 1 on."""
    kind = "struct<segGroups:array<struct<objectId:int,label:string,segments:array<int>>>>"
    g = documents.select(F.explode(F.from_json(column, kind)["segGroups"]).alias("g"))
    return g.select((F.col("g.objectId") + 1).alias("object_id"), F.col("g.label").alias("label"), F.explode("g.segments").alias("segment"))


def segment_vertices(documents: DataFrame, column: str = "json", by: list[str] | None = None) -> DataFrame:
    """(by..., segment, vertices): the vertex numbers of each segment of a document, in order; by: the columns that tell documents apart."""
    v = documents.select(*(by or []), F.posexplode(F.from_json(column, "struct<segIndices:array<int>>")["segIndices"]).alias("vertex", "segment"))
    return v.groupBy(*(by or []), "segment").agg(F.sort_array(F.collect_list("vertex")).alias("vertices"))


def training_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, epoch, key, value, validation) of a log of one JSON object a line; lines of one key are dropped, keys with a slash are validation's."""
    m = F.from_json(column, "map<string,string>")
    rows = lines.withColumn("line", F.monotonically_increasing_id()).withColumn("m", m).where(F.size("m") > 1)
    rows = rows.select("line", F.try_element_at("m", F.lit("epoch")).cast("int").alias("epoch"), F.explode("m").alias("key", "text"))
    return rows.select("line", "epoch", "key", F.col("text").try_cast("double").alias("value"), F.col("key").contains("/").alias("validation")).where("value is not null")


def scan_info(boxes: DataFrame, classes=("tree",)) -> DataFrame:
    """One JSON document a scan, without keys that are null."""
    box = F.struct(F.array(*[F.col(c).cast("double") for c in ("cx", "cy", "cz", "dx", "dy", "dz")]).alias("bbox_3d"), F.lit(0).alias("bbox_label_3d"))
    one = boxes.groupBy("scan_id").agg(F.sort_array(F.collect_list(box)).alias("instances"))
    info = F.struct(F.col("scan_id").alias("sample_idx"), F.struct(F.lit(3).alias("num_pts_feats"), F.concat(F.col("scan_id").cast("string"), F.lit(".bin")).alias("lidar_path")).alias("lidar_points"), "instances", F.lit(None).cast("string").alias("images"))
    return one.select("scan_id", F.to_json(info).alias("info"))


def pruned(info: DataFrame, column: str) -> DataFrame:
    """A struct column as JSON without its null keys, however deep."""
    return info.withColumn(column, F.to_json(column, {"ignoreNullFields": "true"}))


def split_of(path: F.Column, names: tuple[str, ...] = ("train", "val", "test")) -> F.Column:
    """The split that a path names, the last of `names` that it holds; null without one. As a partition column it prunes what a plan reads."""
    out = F.lit(None).cast("string")
    for n in names:
        out = F.when(path.contains(n), F.lit(n)).otherwise(out)
    return out


def routed(rows: DataFrame, groups: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """keys, and a struct for each group of columns; a column that no group knows is an error."""
    unknown = set(rows.columns) - set(keys) - {c for cs in groups.values() for c in cs}
    if unknown:
        raise KeyError(f"no group takes {', '.join(sorted(unknown))}")
    return rows.select(*keys, *[F.struct(*[c for c in cs if c in rows.columns]).alias(g) for g, cs in groups.items() if any(c in rows.columns for c in cs)])
