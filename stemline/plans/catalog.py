"""Every query by name, with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.functions import vectors as V
from stemline.operators import augment, boxes, geo, graph, labels, losses, masks, metrics, rounds, training
from stemline.plans import views
from stemline.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _on(views_: tuple[str, ...], name: str, make: Callable[..., DataFrame], sql: str | None, plain: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = views.points(spark, sf_dir)
        mp = views.mask_points(p)
        have = {"points": p, "mask_points": mp, "masks": views.masks(mp)}
        return make(*[have[v] if v in have else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views_])

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql if plain else views.WITH + ("" if sql.lstrip().startswith(",") else "\n") + sql


def on_points(name: str, make: Callable[..., DataFrame], sql: str | None = None) -> None:
    _on(("points",), name, make, sql)


def on_masks(name: str, make: Callable[..., DataFrame], sql: str | None = None) -> None:
    """make(mask_points, masks, points)"""
    _on(("mask_points", "masks", "points"), name, make, sql)


# ---- metrics

_RAW = """, raw as (select *, semantic_gt + 1 as gt_c, semantic_pred + 1 as pred_c,
  case when semantic_gt + 1 = 1 then 1 when semantic_gt + 1 in (2, 3) then 2 else 0 end as gt_b,
  case when semantic_pred + 1 = 1 then 1 when semantic_pred + 1 in (2, 3) then 2 else 0 end as pred_b from points)"""


def _pairs(protocol: str) -> str:
    keep = "gt_c not in (0, 1) or pred_c not in (0, 1)" if protocol == "file" else "gt_b <> 1 or pred_b <> 1"
    least = -1 if protocol == "file" else 0
    return _RAW + f""",
ev as (select * from raw where {keep}),
gc as (select scan_id, instance_gt, gt_b, count(*) as n from ev where instance_gt > {least} group by all),
g as (select scan_id, instance_gt, arg_max(gt_b, n * 10 - gt_b) as g_class, sum(n) as g_n from gc group by scan_id, instance_gt),
pc as (select scan_id, instance_pred, pred_b, count(*) as n from ev where instance_pred <> -1 group by all),
p as (select scan_id, instance_pred, arg_max(pred_b, n * 10 - pred_b) as p_class, sum(n) as p_n from pc group by scan_id, instance_pred),
x as (select scan_id, instance_gt, instance_pred, count(*) as shared from ev where instance_gt > {least} and instance_pred <> -1 group by all),
pr as (select x.*, g_n, p_n, cast(shared as double) / (g_n + p_n - shared) as iou from x
  join g on x.scan_id = g.scan_id and x.instance_gt = g.instance_gt join p on x.scan_id = p.scan_id and x.instance_pred = p.instance_pred where g_class = p_class)"""


def _panoptic(protocol: str, by_scan: bool) -> str:
    keys, group = ("scan_id, ", "") if by_scan else ("", "")
    scans = """,
bp as (select scan_id, instance_pred, max(iou) as best from pr group by scan_id, instance_pred),
got as (select p.scan_id, count(*) as n_pred, count(*) filter (best >= 0.5) as tp, coalesce(sum(best) filter (best >= 0.5), 0) as iou
  from p left join bp on p.scan_id = bp.scan_id and p.instance_pred = bp.instance_pred where p_class = 2 group by p.scan_id),
tr as (select scan_id, count(*) as n_gt from g where g_class = 2 group by scan_id),
sc as (select coalesce(got.scan_id, tr.scan_id) as scan_id, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp, coalesce(n_gt, 0) as n_gt, coalesce(iou, 0) as iou
  from got full join tr on got.scan_id = tr.scan_id)"""
    if not by_scan:
        scans += ",\nal as (select cast(sum(n_pred) as bigint) as n_pred, cast(sum(tp) as bigint) as tp, cast(sum(n_gt) as bigint) as n_gt, sum(iou) as iou from sc)"
    return _pairs(protocol) + scans + f"""
select {keys}n_pred, tp, n_gt, round(tp / nullif(n_pred, 0), 6) as prec, round(tp / nullif(n_gt, 0), 6) as rec,
  round(2 * (tp / nullif(n_pred, 0)) * (tp / nullif(n_gt, 0)) / nullif(tp / nullif(n_pred, 0) + tp / nullif(n_gt, 0), 0), 6) as f1,
  round(2 * tp / nullif(n_pred + n_gt, 0), 6) as rq, round(coalesce(iou / nullif(tp, 0), 0), 6) as sq,
  round(coalesce(iou / nullif(tp, 0), 0) * (2 * tp / nullif(n_pred + n_gt, 0)), 6) as pq from {'sc' if by_scan else 'al'}"""


for _protocol, _suffix in (("file", ""), ("unified", "_unified")):
    on_points("pq_per_scan" + _suffix, lambda p, k=_protocol: metrics.panoptic(p, k), _panoptic(_protocol, True))
    on_points("pq_global" + _suffix, lambda p, k=_protocol: metrics.panoptic(p, k, by_scan=False), _panoptic(_protocol, False))
    on_points(
        "coverage_mucov_mwcov" + _suffix, lambda p, k=_protocol: metrics.coverage(p, k),
        _pairs(_protocol) + """,
bg as (select scan_id, instance_gt, max(iou) as best from pr group by scan_id, instance_gt)
select g.scan_id, round(avg(coalesce(best, 0)), 6) as mucov, round(sum(coalesce(best, 0) * g_n) / sum(g_n), 6) as mwcov
from g left join bg on g.scan_id = bg.scan_id and g.instance_gt = bg.instance_gt where g_class = 2 group by g.scan_id""",
    )

for _name, _g, _p in (("confusion_4class", "gt_c", "pred_c"), ("confusion_binary", "gt_b", "pred_b")):
    on_points(
        _name, lambda p, b=_g == "gt_b": metrics.confusion(p, b),
        _RAW + f""", c as (select {_g} as class, 1 as g, 0 as p, case when gt_c is not null and {_g} = {_p} then 1 else 0 end as hit from raw
  union all select {_p}, 0, 1, 0 from raw)
select class, cast(sum(g) as bigint) as gt, cast(sum(p) as bigint) as pred, cast(sum(hit) as bigint) as tp from c group by class""",
    )
for _protocol in ("file", "unified"):
    _every = "sum(tp / nullif(gt + pred - tp, 0))" if _protocol == "file" else "sum(tp / nullif(gt + pred - tp, 0)) filter (class in (1, 2, 3) and gt > 0)"
    on_points(
        f"semantic_summary_{_protocol}", lambda p, k=_protocol: metrics.semantic_summary(p, k),
        _RAW + f""", c as (select k.class, (select count(*) from raw where gt_c = k.class) as gt, (select count(*) from raw where pred_c = k.class) as pred,
  (select count(*) from raw where gt_c = k.class and pred_c = k.class) as tp from (select unnest([0, 1, 2, 3]) as class) k)
select round(sum(tp) / sum(gt), 6) as o_acc, round(sum(tp / nullif(gt, 0)) filter (class in (1, 2, 3) and gt > 0) / count(*) filter (class in (1, 2, 3) and gt > 0), 6) as m_acc,
  round({_every} / count(*) filter (class in (1, 2, 3) and gt > 0), 6) as m_iou from c""",
    )
on_points(
    "stuff_pq", metrics.stuff_quality,
    _RAW + """, s as (select scan_id, count(*) filter (gt_b = 1 and pred_b = 1) / nullif(count(*) filter (gt_b = 1 or pred_b = 1), 0) as iou from raw group by scan_id)
select scan_id, case when iou >= 0.5 then 1.0::double else 0.0::double end as rq, case when iou >= 0.5 then round(iou, 6) else 0.0 end as pq, round(iou, 6) as pq_star from s""",
)
on_points("count_rollup", metrics.rollup_counts, _RAW + " select scan_id, gt_c as class, count(*) as n, count(*) filter (gt_c = pred_c) as tp from raw group by grouping sets ((scan_id, gt_c), (gt_c))")
on_points(
    "class_presence_intersect",
    lambda p: metrics.raw_classes(p).select("scan_id", F.col("gt_c").alias("class")).intersect(metrics.raw_classes(p).select("scan_id", F.col("pred_c").alias("class"))).where("class in (1, 2, 3)"),
    _RAW + " select scan_id, gt_c as class from raw where gt_c in (1, 2, 3) intersect select scan_id, pred_c from raw",
)

_MATCH = """, mm as (select mp.scan_id, mask_id, instance_gt, count(*) as shared from mask_points mp join points using (scan_id, point_id) where instance_gt > 0 group by all),
gn as (select scan_id, instance_gt, count(*) as g_n from points where instance_gt > 0 group by all),
ma as (select mm.*, n_points as m_n, g_n, cast(shared as double) / (n_points + g_n - shared) as iou from mm join masks using (scan_id, mask_id) join gn using (scan_id, instance_gt))"""
_TP = _MATCH + """, fit as (select ma.scan_id, ma.mask_id, ma.instance_gt, score_pct, row_number() over (partition by ma.scan_id, ma.instance_gt order by score_pct desc, ma.mask_id) as turn
  from ma join masks using (scan_id, mask_id) where iou > 0.5),
tp as (select scan_id, mask_id, score_pct, case when exists (select 1 from fit f where f.turn = 1 and f.scan_id = m.scan_id and f.mask_id = m.mask_id) then 1 else 0 end as tp from masks m)"""
_CURVE = _TP + """, one as (select score_pct, sum(tp) as tp, count(*) as n from tp group by score_pct),
cv as (select score_pct, sum(tp) over (order by score_pct desc) / sum(n) over (order by score_pct desc) as precision,
  sum(tp) over (order by score_pct desc) / (select count(*) from gn) as recall from one)"""
_gt = lambda p: p.where("instance_gt > 0").select("scan_id", "instance_gt").distinct()
_scored = lambda mp, m, p: metrics.greedy_matches(metrics.mask_matches(mp, p.where("instance_gt > 0")), m, 0.5)


def _curve(mp: DataFrame, m: DataFrame, p: DataFrame) -> DataFrame:
    return metrics.precision_recall(_scored(mp, m, p), _gt(p).count())


on_masks("mask_gt_iou", lambda mp, m, p: metrics.mask_matches(mp, p.where("instance_gt > 0")).select("scan_id", "mask_id", "instance_gt", "shared", F.round("iou", 6).alias("iou")), _MATCH + " select scan_id, mask_id, instance_gt, shared, round(iou, 6) as iou from ma")
on_masks("ap_match", _scored, _TP + " select scan_id, mask_id, score_pct, tp from tp")
on_masks("ap_curve", lambda mp, m, p: _curve(mp, m, p).select("score_pct", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")), _CURVE + " select score_pct, round(precision, 6) as precision, round(recall, 6) as recall from cv")
on_masks(
    "ap_value", lambda mp, m, p: metrics.average_precision(_curve(mp, m, p)),
    _CURVE + """, cl as (select score_pct, precision, recall from cv union all select 101, 1.0, 0.0),
st as (select precision, (coalesce(lag(recall) over (order by score_pct), recall) - coalesce(lead(recall) over (order by score_pct), 0)) / 2 as step from cl)
select round(sum(precision * step), 6) as ap from st""",
)

# ---- voxels, tiles, rasters

_V = lambda s: f", vx as (select *, cast(floor(x_cm / {s}.0) as bigint) as vx, cast(floor(y_cm / {s}.0) as bigint) as vy, cast(floor(z_cm / {s}.0) as bigint) as vz from points)"
on_points("voxel_mean", geo.voxel_mean, _V(20) + " select scan_id, vx, vy, vz, count(*) as n, round(sum(x_cm) / count(*), 6) as mean_x, round(sum(y_cm) / count(*), 6) as mean_y, round(sum(z_cm) / count(*), 6) as mean_z, min(point_id) as first_id from vx group by scan_id, vx, vy, vz")
on_points("voxel_first", lambda p: geo.voxel_first(p, 300), _V(300) + " select scan_id, point_id, x_cm, y_cm, z_cm from (select *, row_number() over (partition by scan_id, vx, vy, vz order by point_id) as k from vx) where k = 1")
on_points(
    "ground_thinned", lambda p: geo.thin_ground(p, 300, 400),
    _V(300) + """, gr as (select *, count(*) over (partition by scan_id) > 400 as many, row_number() over (partition by scan_id, vx, vy, vz order by point_id) as k from vx where semantic_pred = 0)
select scan_id, point_id, x_cm, y_cm, z_cm from gr where not many or k = 1""",
)
on_points("voxel_hash_pick", geo.voxel_hash_pick, _V(20) + " select scan_id, vx, vy, vz, arg_min(point_id, md5('7|' || point_id)) as point_id from vx group by scan_id, vx, vy, vz")
on_points("voxel_distinct_volume", lambda p: geo.with_voxels(p, 50).where("instance_pred >= 0").groupBy("scan_id", "instance_pred").agg(F.count_distinct("vx", "vy", "vz").alias("volume")), _V(50) + " select scan_id, instance_pred, count(distinct (vx, vy, vz)) as volume from vx where instance_pred >= 0 group by all")
on_points("recenter", geo.recenter, ", o as (select scan_id, sum(x_cm) / count(*) as ox, sum(y_cm) / count(*) as oy, min(z_cm) as oz from points group by scan_id) select point_id, scan_id, round(x_cm - ox, 6) as x, round(y_cm - oy, 6) as y, z_cm - oz as z from points join o using (scan_id)")
on_points("scan_extent", geo.scan_extent, " select scan_id, min(x_cm) as min_x, max(x_cm) as max_x, min(y_cm) as min_y, max(y_cm) as max_y, min(z_cm) as min_z, max(z_cm) as max_z, count(*) as n from points group by scan_id")
_EXT = ", e as (select scan_id, min(x_cm) as x0, min(y_cm) as y0, max(x_cm) as x1, max(y_cm) as y1 from points group by scan_id)"
_REG = _EXT + """, ei as (select *, unnest(range(0, (x1 - x0) // 400 + 1)) as i from e), rg0 as (select *, unnest(range(0, (y1 - y0) // 400 + 1)) as j from ei),
rg as (select scan_id, cast(i * ((y1 - y0) // 400 + 1) + j as bigint) as region_id, x0 + i * 400 as cx, y0 + j * 400 as cy from rg0)"""
on_points("tile_regions", geo.tile_regions, _REG + " select scan_id, region_id, cx, cy from rg")
_TILE = _REG + """, tm as (select p.scan_id, point_id, region_id, cast((x_cm - cx) * (x_cm - cx) + (y_cm - cy) * (y_cm - cy) as bigint) as d2, semantic_pred from points p join rg on p.scan_id = rg.scan_id
  and x_cm between cx - 1600 and cx + 1600 and y_cm between cy - 1600 and cy + 1600 and (x_cm - cx) * (x_cm - cx) + (y_cm - cy) * (y_cm - cy) <= 2560000)"""
on_points("tile_membership", geo.tile_membership, _TILE + " select scan_id, point_id, region_id, d2 from tm")
on_points(
    "tile_vote_semantic", lambda p: labels.tile_votes(p, views.tile_answers(geo.tile_membership(p), p)),
    _TILE + """, vo as (select scan_id, point_id, case when region_id % 5 = 0 then (semantic_pred + 1) % 3 else semantic_pred end as v, count(*) as n from tm group by all),
be as (select scan_id, point_id, arg_max(v, n * 10 - v) as s from vo group by all)
select p.scan_id, p.point_id, cast(coalesce(s, -1) as int) as semantic from points p left join be on p.scan_id = be.scan_id and p.point_id = be.point_id""",
)
_GO = ", go as (select scan_id, min(x_cm) as x0, min(y_cm) as y0 from points where semantic_pred = 0 group by scan_id)"
_RASTER = _GO + """, ra as (select scan_id, cast(trunc((x_cm - x0) / 300) as bigint) as xi, cast(trunc((y_cm - y0) / 300) as bigint) as yi, round(sum(z_cm) / count(*), 6) as gz
  from points join go using (scan_id) where semantic_pred = 0 group by all),
ht as (select h.scan_id, point_id, x_cm, y_cm, z_cm, instance_pred, round(z_cm - gz, 6) as height from (select p.*, cast(trunc((x_cm - x0) / 300) as bigint) as xi, cast(trunc((y_cm - y0) / 300) as bigint) as yi
  from points p join go on p.scan_id = go.scan_id where semantic_pred <> 0) h left join ra on h.scan_id = ra.scan_id and h.xi = ra.xi and h.yi = ra.yi)"""
_NOISE = _RASTER + """, nh as (select *, floor(x_cm / 50.0) as a, floor(y_cm / 50.0) as b, floor(z_cm / 50.0) as c from ht where instance_pred >= 0),
ns as (select scan_id, instance_pred, count(*) as n, count(distinct (a, b, c)) as volume, min(height) as low from nh group by all),
sc as (select scan_id, instance_pred, n, volume, case when n >= 5 and low > 0 then round(volume / low, 6) else 1000000.0::double end as score from ns)"""
on_points("ground_raster", geo.ground_raster, _RASTER + " select scan_id, xi, yi, gz from ra")
on_points("height_above_ground", lambda p: geo.height_above_ground(p).select("scan_id", "point_id", "height"), _RASTER + " select scan_id, point_id, height from ht")
on_points("instance_noise_score", geo.noise_scores, _NOISE + " select scan_id, instance_pred, n, volume, score from sc")
on_points("noise_removal", lambda p: geo.drop_noise(p, 0.5), _NOISE + " select p.scan_id, point_id, cast(case when coalesce(score, 1000000) < 0.5 then -1 else p.instance_pred end as bigint) as instance_pred from points p left join sc on p.scan_id = sc.scan_id and p.instance_pred = sc.instance_pred")
on_points("nearest_sample", geo.nearest_sample, _V(20) + """, sm as (select scan_id, vx, vy, vz, sum(x_cm) / count(*) as sx, sum(y_cm) / count(*) as sy, sum(z_cm) / count(*) as sz from vx group by scan_id, vx, vy, vz),
nn as (select p.scan_id, point_id, s.vx, s.vy, s.vz, round((x_cm - sx) * (x_cm - sx) + (y_cm - sy) * (y_cm - sy) + (z_cm - sz) * (z_cm - sz), 6) as d2
  from points p join sm s on p.scan_id = s.scan_id and sx between x_cm - 36 and x_cm + 36 and sy between y_cm - 36 and y_cm + 36 and sz between z_cm - 36 and z_cm + 36)
select scan_id, point_id, vx, vy, vz, round(d2, 3) as d2 from (select *, row_number() over (partition by scan_id, point_id order by d2, vx, vy, vz) as k from nn) where k = 1""")
on_points("bbox_per_instance", geo.bounding_boxes, """ select scan_id, instance_gt, (min(x_cm) + max(x_cm)) / 2 as cx, (min(y_cm) + max(y_cm)) / 2 as cy, (min(z_cm) + max(z_cm)) / 2 as cz,
  max(x_cm) - min(x_cm) as dx, max(y_cm) - min(y_cm) as dy, max(z_cm) - min(z_cm) as dz from points where instance_gt > 0 group by all""")
_CROP = """, ce as (select scan_id, arg_min(x_cm, md5('7|' || point_id)) as cx0, arg_min(y_cm, md5('7|' || point_id)) as cy0 from points group by scan_id),
ins as (select p.* from points p join ce on p.scan_id = ce.scan_id where (x_cm - cx0) * (x_cm - cx0) + (y_cm - cy0) * (y_cm - cy0) < 640000),
al as (select scan_id, instance_gt, count(*) as n_all from points where instance_gt > 0 group by all),
cr as (select i.scan_id, i.instance_gt, count(*) as n_in, round(sum(x_cm) / count(*), 6) as cx, round(sum(y_cm) / count(*), 6) as cy, round(sum(z_cm) / count(*), 6) as cz, any_value(n_all) as n_all, round(count(*) / any_value(n_all), 6) as ratio
  from ins i join al on i.scan_id = al.scan_id and i.instance_gt = al.instance_gt group by i.scan_id, i.instance_gt)"""
on_points("crop_ratio_votes", geo.crop_ratios, _CROP + " select scan_id, instance_gt, n_in, cx, cy, cz, n_all, ratio from cr")
on_points("fully_inside_crop", geo.fully_inside, _CROP + " select scan_id, point_id, instance_gt from ins i where instance_gt = 0 or exists (select 1 from cr where cr.scan_id = i.scan_id and cr.instance_gt = i.instance_gt and n_in = n_all)")
on_points("hash_sample", lambda p: geo.hash_sample(p, 100), " select scan_id, point_id from (select *, row_number() over (partition by scan_id order by md5('7|' || point_id)) as k from points) where k <= 100")
on_points("thinned_far_near", lambda p: p.where("z_cm >= 1200").select("scan_id", "point_id").unionByName(geo.hash_sample(p.where("z_cm < 1200"), 50)), " select scan_id, point_id from points where z_cm >= 1200 union all select scan_id, point_id from (select *, row_number() over (partition by scan_id order by md5('7|' || point_id)) as k from points where z_cm < 1200) where k <= 50")


def _boxes(p: DataFrame) -> DataFrame:
    return geo.bounding_boxes(p).select(F.col("instance_gt").alias("box_id"), "scan_id", "cx", "cy", "cz", "dx", "dy", "dz", F.lit(math.pi / 6).alias("yaw"))


on_points("points_in_rotated_box", lambda p: geo.points_in_rotated_box(p, _boxes(p)), """, bx as (select scan_id, instance_gt as box_id, (min(x_cm) + max(x_cm)) / 2 as cx, (min(y_cm) + max(y_cm)) / 2 as cy, (min(z_cm) + max(z_cm)) / 2 as cz,
  max(x_cm) - min(x_cm) as dx, max(y_cm) - min(y_cm) as dy, max(z_cm) - min(z_cm) as dz, pi() / 6 as a from points where instance_gt > 0 group by all)
select box_id, p.scan_id, point_id from points p join bx on p.scan_id = bx.scan_id where abs((x_cm - cx) * cos(a) + (y_cm - cy) * sin(a)) <= dx / 2
  and abs((y_cm - cy) * cos(a) - (x_cm - cx) * sin(a)) <= dy / 2 and abs(z_cm - cz) <= dz / 2""")

# ---- labels

_VL = lambda c: _V(20) + f", vc as (select scan_id, vx, vy, vz, {c}, count(*) as n from vx group by all) select scan_id, vx, vy, vz, arg_max({c}, n * 100000 - {c}) as {c} from vc group by scan_id, vx, vy, vz"
on_points("majority_voxel_instance", lambda p: labels.voxel_majority(p, "instance_gt"), _VL("instance_gt"))
on_points("majority_voxel_semantic", lambda p: labels.voxel_majority(p, "semantic_gt"), _VL("semantic_gt"))
on_points("semantic_masks", labels.semantic_masks, _V(20) + ", vc as (select scan_id, vx, vy, vz, semantic_gt, count(*) as n from vx group by all), m as (select scan_id, vx, vy, vz, arg_max(semantic_gt, n * 10 - semantic_gt) as s from vc group by scan_id, vx, vy, vz) select scan_id, vx, vy, vz, cast(s = 0 as int) as c0, cast(s = 1 as int) as c1, cast(s = 2 as int) as c2 from m")
on_points("superpoint_markup", lambda p: labels.superpoint_markup(p, 300), _V(300) + ", m as (select scan_id, vx, vy, vz, cast(2 * count(*) filter (semantic_gt = 0) > count(*) as int) as c0, cast(2 * count(*) filter (semantic_gt = 1) > count(*) as int) as c1, cast(2 * count(*) filter (semantic_gt = 2) > count(*) as int) as c2 from vx group by scan_id, vx, vy, vz) select *, cast(c0 + c1 + c2 = 0 as int) as unlabelled from m")
on_points("inst_mask_half", labels.voxel_instance_halves, _V(20) + ", vc as (select scan_id, vx, vy, vz, instance_gt, count(*) as n from vx group by all) select scan_id, vx, vy, vz, instance_gt from (select *, sum(n) over (partition by scan_id, vx, vy, vz) as t from vc) where 2 * n > t and instance_gt > 0")
on_points("foreground_voxel", labels.foreground_voxels, _V(20) + " select scan_id, vx, vy, vz, 2 * count(*) filter (instance_gt > 0) > count(*) as foreground from vx group by scan_id, vx, vy, vz")
on_points("vote_offsets", lambda p: labels.vote_offsets(p, 100), _V(100) + """, c as (select scan_id, instance_gt, sum(x_cm) / count(*) as mx, sum(y_cm) / count(*) as my, sum(z_cm) / count(*) as mz from points where instance_gt > 0 group by all),
vc as (select scan_id, vx, vy, vz, instance_gt, count(*) as n, sum(x_cm) as sx, sum(y_cm) as sy, sum(z_cm) as sz from vx group by all),
m as (select * from (select *, row_number() over (partition by scan_id, vx, vy, vz order by n desc, instance_gt) as k from vc) where k = 1)
select m.scan_id, vx, vy, vz, m.instance_gt, round(mx - sx / n, 6) as ox, round(my - sy / n, 6) as oy, round(mz - sz / n, 6) as oz from m join c on m.scan_id = c.scan_id and m.instance_gt = c.instance_gt""")
on_points("dense_relabel", labels.dense_relabel, " select scan_id, point_id, cast(case when instance_pred < 0 then -1 else dense_rank() over (partition by scan_id, instance_pred < 0 order by instance_pred) - 1 end as bigint) as dense_id from points")
on_points("small_instance_removal", labels.drop_small, " select scan_id, point_id, case when count(*) over (partition by scan_id, instance_pred) < 10 then -1 else instance_pred end as instance_pred from points")
on_points("ground_mask_out", labels.ground_mask_out, " select scan_id, point_id, case when semantic_pred = 0 then -1 else instance_pred end as instance_pred from points")
on_points("label_shift", labels.label_shift, " select scan_id, point_id, semantic_gt as semantic, case when semantic_gt = 0 then 0 else instance_gt end as instance from points")
on_points("first_label_dense", labels.first_label, ", o as (select scan_id, instance_gt, arg_min(semantic_gt, point_id) as semantic from points where instance_gt > 0 group by all) select * from (select *, row_number() over (partition by scan_id order by instance_gt) - 1 as dense_id from o) q where (select count(*) from o where o.scan_id = q.scan_id) >= 2")
on_points("named_instances", labels.named_instances, " select scan_id, instance_gt, min(semantic_gt) * 1000 + instance_gt as name from points where instance_gt > 0 group by scan_id, instance_gt")
on_points("class_swap", labels.swap_classes, " select scan_id, point_id, cast(case semantic_gt when 1 then 2 when 2 then 1 else semantic_gt end as int) as semantic_gt from points")
on_points("leftovers_split", labels.split_leftovers, " select scan_id, point_id, case when semantic_pred <> 0 and instance_pred = -1 then 'left' else 'kept' end as part from points")
on_points("round_union_offset", labels.union_rounds, ", t as (select scan_id, max(instance_pred) + 1 as room from points group by scan_id), b as (select scan_id, coalesce(sum(room) over (order by scan_id rows between unbounded preceding and 1 preceding), 0) as base from t) select point_id, cast(case when instance_pred >= 0 then instance_pred + base else instance_pred end as bigint) as instance_pred from points join b using (scan_id)")
on_points("assigned_only", lambda p: p.where("instance_pred <> -1").select("scan_id", "point_id", "instance_pred"), " select scan_id, point_id, instance_pred from points where instance_pred <> -1")

# ---- masks

on_masks("topk_masks", lambda mp, m, p: masks.top_masks(m), " select * from (select *, cast(row_number() over (partition by scan_id order by score_pct desc, mask_id) as int) as rank from masks) where rank <= 30")
_SOFT = ", so as (select *, 10 + (point_id * 31 + mask_id * 17) % 90 as p from mask_points)"
on_masks("objectness", lambda mp, m, p: masks.objectness(views.soft_points(mp), m), _SOFT + " select scan_id, mask_id, round(any_value(score_pct) / 100 * (coalesce(sum(p) filter (p > 30), 0) / 100) / (count(*) filter (p > 30) + 1e-6), 6) as score from so join masks using (scan_id, mask_id) group by scan_id, mask_id")
_OV = """, ov as (select a.scan_id, a.mask_id as a, b.mask_id as b, count(*) as shared from mask_points a join mask_points b on a.scan_id = b.scan_id and a.point_id = b.point_id and a.mask_id < b.mask_id group by all),
io as (select ov.scan_id, a, b, shared, round(shared / (x.n_points + y.n_points - shared), 6) as iou, round(shared / x.n_points, 6) as of_a, round(shared / y.n_points, 6) as of_b
  from ov join masks x on ov.scan_id = x.scan_id and a = x.mask_id join masks y on ov.scan_id = y.scan_id and b = y.mask_id)"""
on_masks("mask_iou_pairs", lambda mp, m, p: masks.iou_pairs(mp, m), _OV + " select * from io")
for _kernel in ("linear", "gauss"):
    _dec = "(1 - iou) / (1 - own)" if _kernel == "linear" else "exp(-2.0 * iou * iou) / exp(-2.0 * own * own)"
    on_masks(
        f"matrix_nms_{_kernel}", lambda mp, m, p, k=_kernel: masks.matrix_nms(mp, m, k),
        _OV + f""", rk as (select *, row_number() over (partition by scan_id order by score_pct desc, mask_id) as rank from masks),
pa as (select ov.scan_id, least(x.rank, y.rank) as i, greatest(x.rank, y.rank) as j, shared / (x.n_points + y.n_points - shared) as iou from ov
  join rk x on ov.scan_id = x.scan_id and a = x.mask_id join rk y on ov.scan_id = y.scan_id and b = y.mask_id),
ow as (select scan_id, j, max(iou) as own from pa group by all),
pd as (select pa.scan_id, pa.j, iou, coalesce(own, 0) as own from pa left join ow on pa.scan_id = ow.scan_id and pa.i = ow.j),
dc as (select scan_id, j, min({_dec}) as decay from pd where own < 1 group by all)
select rk.scan_id, mask_id, round(score_pct / 100 * least(coalesce(decay, 1), 1), 6) as score from rk left join dc on rk.scan_id = dc.scan_id and rk.rank = dc.j""",
    )
on_masks("edge_filter", lambda mp, m, p: masks.edge_filter(mp, p, views.centres(m)), " select mp.scan_id, mask_id from mask_points mp join points using (scan_id, point_id) group by all having max((x_cm - (1600 + mask_id // 4 % 3 * 1600)) * (x_cm - (1600 + mask_id // 4 % 3 * 1600)) + (y_cm - 3200) * (y_cm - 3200)) <= 2402500")
on_masks("stuff_majority_filter", lambda mp, m, p: masks.stuff_majority_filter(mp, m, p), ", s as (select mp.scan_id, mask_id, count(*) filter (semantic_pred = 0) as st, count(*) as n from mask_points mp join points using (scan_id, point_id) group by all) select scan_id, mask_id, cast(case when 2 * st > n then 0 else score_pct end as int) as score_pct from masks join s using (scan_id, mask_id)")
on_masks("height_filter", lambda mp, m, p: masks.height_filter(mp, m, p), ", tp as (select scan_id, max(z_cm) as top from points where semantic_pred = 0 group by all), lo as (select mp.scan_id, mask_id, min(z_cm) as low from mask_points mp join points using (scan_id, point_id) group by all) select scan_id, mask_id, cast(case when low > top + 500 then 0 else score_pct end as int) as score_pct from masks join lo using (scan_id, mask_id) left join tp using (scan_id)")
on_masks("size_score_filter", lambda mp, m, p: masks.size_score_filter(m), " select scan_id, mask_id from masks where score_pct > 40 and n_points > 10")
on_masks("mask_binarise", lambda mp, m, p: masks.binarise(views.soft_points(mp)), _SOFT + " select scan_id, mask_id, point_id from so where 1 / (1 + exp(-(p - 50) / 20.0)) > 0.6")
_AM = ", am as (select scan_id, point_id, arg_max(mask_id, score_pct * 1000000 - mask_id) as mask_id from mask_points join masks using (scan_id, mask_id) group by all)"
on_masks("argmax_mask_per_point", lambda mp, m, p: masks.argmax_mask(mp, m), _AM + " select scan_id, point_id, mask_id from am")
on_masks("mask_semijoin", lambda mp, m, p: masks.surviving_masks(mp, m), _AM + " select scan_id, mask_id, score_pct from masks m where exists (select 1 from am where am.scan_id = m.scan_id and am.mask_id = m.mask_id)")
on_masks("panoptic_paint", lambda mp, m, p: masks.paint(mp, m, p), _AM + """, n as (select scan_id, mask_id from am group by all having count(*) > 10), id as (select *, row_number() over (partition by scan_id order by mask_id) as thing from n),
pt as (select am.scan_id, point_id, thing from am join id on am.scan_id = id.scan_id and am.mask_id = id.mask_id)
select p.scan_id, p.point_id, coalesce(thing + 2, semantic_pred) as panoptic from points p left join pt on p.scan_id = pt.scan_id and p.point_id = pt.point_id""")
on_masks("mask_components", lambda mp, m, p: masks.components(masks.iou_pairs(mp, m).where("iou > 0.4"), m), None)
SQL["mask_components"] = views.WITH.replace("with points", "with recursive points", 1) + _OV + """, ed as (select scan_id, a, b from io where iou > 0.4 union all select scan_id, b, a from io where iou > 0.4),
re(scan_id, mask_id, other) as (select scan_id, mask_id, mask_id from masks union select re.scan_id, re.mask_id, ed.b from re join ed on re.scan_id = ed.scan_id and re.other = ed.a)
select scan_id, mask_id, min(other) as root from re group by all"""
on_masks("merge_masks", lambda mp, m, p: masks.merge_masks(mp, m, 0.4), None)
SQL["merge_masks"] = SQL["mask_components"].rsplit("\nselect", 1)[0] + """, ro as (select scan_id, mask_id, min(other) as root from re group by all),
ms as (select scan_id, root, max(score_pct) as score_pct, count(*) as n_masks from masks join ro using (scan_id, mask_id) group by all),
mn as (select scan_id, root, count(distinct point_id) as n_points from mask_points join ro using (scan_id, mask_id) group by all)
select scan_id, root as mask_id, score_pct, n_masks, n_points from ms join mn using (scan_id, root)"""
on_masks("greedy_suppress", lambda mp, m, p: masks.greedy_suppress(mp, m))
on_masks("pairwise_suppress", lambda mp, m, p: masks.pairwise_suppress(mp, m))

# ---- losses and matchings

_on(("embeddings",), "mean_embed_distance", losses.mean_distances, """with m as (select label, pos, avg(v) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by all),
d as (select vec_id, e.label, sqrt(sum((v - mean) * (v - mean))) as d from (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) e join m on e.label = m.label and e.pos = m.pos group by all)
select vec_id, label, round(d, 6) as distance, round(exp(-d), 6) as score from d""", True)
_on(("embeddings",), "cov_per_label", losses.covariances, "select label, " + ", ".join(f"round(covar_samp(embedding[{i + 1}]::double, embedding[{j + 1}]::double), 6) as c{i}{j}" for i in range(3) for j in range(i, 3)) + " from embeddings group by label", True)
_on(("embeddings",), "mahalanobis", losses.mahalanobis, None)
_on(("embeddings",), "discriminative_loss", losses.discriminative_loss, """with m as (select label, pos, avg(v) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by all),
d as (select vec_id, e.label, greatest(sqrt(sum((v - mean) * (v - mean))) - 0.5, 0) as h from (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) e join m on e.label = m.label and e.pos = m.pos group by all),
pl as (select avg(x) as pull from (select avg(h * h) as x from d group by label)),
g as (select a.label as la, b.label as lb, greatest(3.0::double - sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))), 0) as gap from m a join m b on a.pos = b.pos and a.label < b.label group by all)
select round((select pull from pl), 6) as pull, round((select avg(gap * gap) from g), 6) as push, round((select avg(s) from (select sum(abs(mean)) as s from m group by label)), 6) as norm""", True)
_on(("embeddings",), "vector_functions", lambda e: e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.dot(F.col("embedding"), F.reverse("embedding")), 6).alias("dot"), F.round(F.get(V.softmax(F.col("embedding")), F.lit(0)), 6).alias("soft"), F.round(V.sigmoid(F.get("embedding", F.lit(0)).cast("double")), 6).alias("sig")),
    "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::double * embedding[len(embedding) + 1 - i]::double)), 6) as dot, round(exp(embedding[1]::double - list_max(embedding)) / list_sum(list_transform(embedding, lambda x: exp(x::double - list_max(embedding)))), 6) as soft, round(1 / (1 + exp(-embedding[1]::double)), 6) as sig from embeddings", True)
on_points("minmax_scores", losses.minmax_scores, ", r as (select *, min(score_pct) over (partition by scan_id, instance_pred) as lo, max(score_pct) over (partition by scan_id, instance_pred) as hi from points where instance_pred >= 0) select scan_id, point_id, round(case when hi > lo then (score_pct - lo) / (hi - lo) else 1.0::double end, 6) as score from r")
on_points("offset_loss", lambda p: losses.offset_loss(views.offsets(p)), """, c as (select scan_id, instance_gt, sum(x_cm) / count(*) as mx, sum(y_cm) / count(*) as my, sum(z_cm) / count(*) as mz from points where instance_gt > 0 group by all),
g as (select p.scan_id, mx - x_cm as a, my - y_cm as b, mz - z_cm as c from points p join c on p.scan_id = c.scan_id and p.instance_gt = c.instance_gt),
q as (select *, a + 10 as qa, b - 5 as qb, c * 0.5::double as qc from g)
select scan_id, round(avg(abs(qa - a) + abs(qb - b) + abs(qc - c)), 4) as l1, round(-avg((qa * a + qb * b + qc * c) / (sqrt(qa * qa + qb * qb + qc * qc) + 1e-8) / (sqrt(a * a + b * b + c * c) + 1e-8)), 4) as direction from q group by scan_id""")
on_points("focal_loss", lambda p: losses.focal_loss(views.heat(p)), """, o as (select *, (10 + point_id % 80) / 100 as o, score_pct / 100 as t from points)
select scan_id, round(-(sum(ln(1 - o) * pow(o, 3) * pow(1 - t, 6)) + sum(case when score_pct >= 95 then ln(o) * pow(1 - o, 3) else 0 end)) / greatest(count(*) filter (score_pct >= 95), 1), 4) as focal from o group by scan_id""")
_COST = """, h as (select *, ((10 + (point_id * 31 + mask_id * 17) % 90) / 100)::double as p from mask_points),
ms as (select scan_id, mask_id, sum(p) as p_sum, sum(ln(1 - p * 0.99::double)) as off, count(*) as n from h group by all),
gn as (select scan_id, instance_gt, count(*) as g_n from points where instance_gt > 0 group by all),
bo as (select h.scan_id, mask_id, instance_gt, sum(p) as hit, sum(ln(p) - ln(1 - p * 0.99::double)) as gain from h join points using (scan_id, point_id) where instance_gt > 0 group by all),
co as (select scan_id, mask_id, instance_gt, round(1 - (2 * hit + 1) / (p_sum + g_n + 1), 6) as dice, round(-(off + gain) / n, 6) as bce from bo join ms using (scan_id, mask_id) join gn using (scan_id, instance_gt))"""
on_masks("dice_bce_cost", lambda mp, m, p: losses.mask_costs(views.mask_values(mp), p), _COST + " select * from co")
on_masks("iou_losses", lambda mp, m, p: losses.iou_losses(metrics.mask_matches(mp, p.where("instance_gt > 0")), m), _MATCH + """, be as (select scan_id, mask_id, max(iou) as iou from ma group by all), s as (select be.scan_id, iou, score_pct / 100 as s, greatest(least((iou - 0.25) / 0.5, 1), 0) as r from be join masks using (scan_id, mask_id))
select scan_id, round(avg(-(r * ln(s) + (1 - r) * ln(1 - s * 0.999))), 5) as ramp, round(coalesce(sum((s - iou) * (s - iou)) filter (iou >= 0.5), 0) / greatest(count(*) filter (iou >= 0.5), 1), 5) as mse, round(avg(-(iou * ln(s) + (1 - iou) * ln(1 - s * 0.999))), 5) as bce from s group by scan_id""")
on_masks("one_to_many", lambda mp, m, p: losses.one_to_many(mp, p, m), ", q as (select scan_id, mask_id, min(point_id) as point_id from mask_points group by all) select q.scan_id, mask_id, case when instance_gt > 0 then instance_gt else -1 end as instance_gt from q join points using (scan_id, point_id)")
on_masks("sparse_match", lambda mp, m, p: losses.sparse_matches(losses.mask_costs(views.mask_values(mp), p)), _COST + ", rk as (select *, row_number() over (partition by scan_id, instance_gt order by dice, mask_id) as k from co) select scan_id, instance_gt, mask_id from rk a where k <= 2 and not exists (select 1 from rk b where b.scan_id = a.scan_id and b.instance_gt = a.instance_gt and b.k = 3 and b.dice <= a.dice)")
on_masks("hungarian", lambda mp, m, p: losses.hungarian(losses.mask_costs(views.mask_values(mp), p)))
_on(("embeddings",), "fps", lambda e: geo.farthest_points(e, "label", "vec_id", "embedding", 5), None)

# ---- augmentation and range

_R = ", r as (select scan_id, point_id, -x_cm as x, y_cm as y, z_cm as z, pi() / 6 as a from points)"
on_points("rotate_flip_scale", augment.rotate_flip_scale, _R + " select scan_id, point_id, round((x * cos(a) - y * sin(a)) * 1.05::double + 10, 4) as x, round((x * sin(a) + y * cos(a)) * 1.05::double - 10, 4) as y, round(z * 1.05::double, 4) as z from r")
on_points("align_matrix", lambda p: augment.align(p, ((0.5, 0.25, 0, 10), (-0.25, 0.5, 0, 20), (0, 0, 2.0, -5))), " select scan_id, point_id, round(x_cm * 0.5::double + y_cm * 0.25::double + 10, 6) as x, round(x_cm * -0.25::double + y_cm * 0.5::double + 20, 6) as y, round(z_cm * 2.0::double - 5, 6) as z from points")
on_points("range_filter", augment.range_filter, " select scan_id, point_id from points where x_cm > 1000 and x_cm < 5000 and y_cm > 1000 and y_cm < 5000 and z_cm > 100 and z_cm < 2000")
_ANG = ", an as (select scan_id, point_id, atan2(y_cm - 3200, x_cm - 3200) as a from points)"
on_points("polar_sector_swap", augment.sector_swap, _ANG + " select scan_id, point_id from an where (scan_id = 0 and not (a > 0 and a < pi() / 2)) or (scan_id = 1 and a > 0 and a < pi() / 2)")
on_points("laser_bands", augment.pitch_bands, ", pi_ as (select scan_id, point_id, cast(floor(atan2(z_cm, sqrt((x_cm - 3200) * (x_cm - 3200) + (y_cm - 3200) * (y_cm - 3200))) / 0.4::double) as bigint) as band from points) select scan_id, point_id, band from pi_ where (scan_id = 0 and band % 2 = 0) or (scan_id = 1 and band % 2 = 1)")
on_points("colour_drop", augment.drop_where_hash, " select scan_id, point_id, cast(case when ('0x' || substr(md5('7|' || point_id), 1, 4))::int % 100 < 20 then 0 else score_pct end as int) as score_pct from points")
on_points("colour_normalise", augment.colour_normalise, " select scan_id, point_id, round((score_pct - 127.5::double) / 127.5::double, 6) as c from points")
on_points("elastic", augment.elastic)

# ---- graphs, documents, tables

_NODES = lambda p: p.where("instance_gt > 0").select("scan_id", F.col("point_id").alias("node"), *[F.col(f"{a}_cm").cast("double").alias(a) for a in "xyz"], F.lit(0.0).alias("nx"), ((F.col("point_id") % 5) / 5.0).alias("ny"), F.sqrt(1 - F.col("ny") * F.col("ny")).alias("nz"))
_EDGES = lambda p: p.where("instance_gt > 0").select("scan_id", F.col("point_id").alias("a"), F.lead("point_id").over(labels.Window.partitionBy("scan_id", "instance_gt").orderBy("point_id")).alias("b")).where("b is not null")
_GRAPH = """, nd as (select scan_id, point_id as node, x_cm as x, y_cm as y, z_cm as z, 0.0::double as nx, (point_id % 5) / 5 as ny, sqrt(1 - ((point_id % 5) / 5) * ((point_id % 5) / 5)) as nz, instance_gt from points where instance_gt > 0),
ed as (select * from (select scan_id, node as a, lead(node) over (partition by scan_id, instance_gt order by node) as b from nd) where b is not null),
ew as (select ed.scan_id, ed.a, ed.b, 1 - (p.nx * q.nx + p.ny * q.ny + p.nz * q.nz) as w, (q.nx * (q.x - p.x) + q.ny * (q.y - p.y) + q.nz * (q.z - p.z)) / nullif(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)), 0) as d
  from ed join nd p on ed.scan_id = p.scan_id and ed.a = p.node join nd q on ed.scan_id = q.scan_id and ed.b = q.node)"""
on_points("graph_edge_weights", lambda p: graph.edge_weights(_NODES(p), _EDGES(p)), _GRAPH + " select scan_id, a, b, round(case when d > 0 then w * w else w end, 6) as w from ew")
on_points("graph_segments", lambda p: graph.segment(graph.edge_weights(_NODES(p), _EDGES(p)), 0.05, 5))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as one aggregation document a class, read back."""
    p = views.points(spark, sf_dir).where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(F.sort_array(F.collect_list(F.col("point_id").cast("int"))).alias("segments"))
    one = p.groupBy("scan_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("instance_gt").cast("int").alias("objectId"), F.concat(F.lit("tree"), (F.col("instance_gt") % 3).cast("string")).alias("label"), "segments")).alias("segGroups"))).alias("json"))
    return text.segment_groups(one).groupBy("label").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("object_id").alias("objects"), F.min("object_id").alias("first"))


QUERIES["json_segments"] = _segments
SQL["json_segments"] = views.WITH + " select 'tree' || instance_gt % 3 as label, count(*) as segments, count(distinct instance_gt) as objects, cast(min(instance_gt) + 1 as int) as first from points where instance_gt > 0 group by 1"


def _inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment document a scan, inverted scan by scan."""
    p = views.points(spark, sf_dir).groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("point_id", (F.col("point_id") % 37).cast("int").alias("s")))), lambda x: x["s"]).alias("segIndices"))
    vertices = text.segment_vertices(p.select("scan_id", F.to_json(F.struct("segIndices")).alias("json")), by=["scan_id"])
    return vertices.select("scan_id", "segment", F.size("vertices").alias("n"), F.element_at("vertices", 1).alias("first"), F.element_at("vertices", -1).alias("last"))


QUERIES["json_vertices"] = _inverted
SQL["json_vertices"] = views.WITH + ", v as (select scan_id, cast(row_number() over (partition by scan_id order by point_id) - 1 as int) as v, cast(point_id % 37 as int) as segment from points) select scan_id, segment, cast(count(*) as int) as n, min(v) as first, max(v) as last from v group by scan_id, segment"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when(F.col("event_id") % 50 == 0, F.to_json(F.struct(F.lit("x").alias("env")))).when(F.col("event_id") % 7 == 0, F.to_json(F.struct((F.col("event_id") % 10).alias("epoch"), F.col("value").alias("val/score"))))
    lines = e.select(F.coalesce(line, F.to_json(F.struct((F.col("event_id") % 10).alias("epoch"), F.col("event_id").alias("iter"), F.col("value").alias("time")))).alias("value"))
    log = text.training_log(lines).where("key = 'time' and not validation")
    per = log.groupBy("epoch").agg(F.avg("value").alias("mean"))
    return per.select("epoch", F.round("mean", 6).alias("mean"), F.round(F.stddev_pop("mean").over(labels.Window.partitionBy(F.lit(0))), 6).alias("spread"), F.max_by("epoch", "mean").over(labels.Window.partitionBy(F.lit(0))).alias("slowest"))


QUERIES["log_epoch_stats"] = _log
SQL["log_epoch_stats"] = "with p as (select cast(event_id % 10 as int) as epoch, avg(value) as mean from events where event_id % 50 <> 0 and event_id % 7 <> 0 group by 1) select epoch, round(mean, 6) as mean, round(stddev_pop(mean) over (), 6) as spread, (select arg_max(epoch, mean) from p) as slowest from p"


def _infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = text.scan_info(geo.bounding_boxes(views.points(spark, sf_dir)))
    kind = "struct<sample_idx:int,images:string,instances:array<struct<bbox_3d:array<double>,bbox_label_3d:int>>>"
    return info.select("scan_id", F.from_json("info", kind).alias("i"), F.get_json_object("info", "$.lidar_points.lidar_path").alias("path")).select("scan_id", "path", F.size("i.instances").alias("n"), F.col("i.instances")[0]["bbox_3d"][0].alias("first_cx"), F.col("i.images").isNull().alias("pruned"))


QUERIES["scan_infos"] = _infos
SQL["scan_infos"] = views.WITH + ", b as (select scan_id, instance_gt, (min(x_cm) + max(x_cm)) / 2 as cx from points where instance_gt > 0 group by all) select scan_id, scan_id || '.bin' as path, cast(count(*) as int) as n, min(cx) as first_cx, true as pruned from b group by scan_id"
_on(("points",), "dir_compare", lambda p: p.select("scan_id", "point_id", F.col("z_cm").alias("a")).join(p.where("point_id % 10 <> 3").select("scan_id", "point_id", (F.col("z_cm") + (F.col("point_id") % 4 == 0).cast("int")).alias("b")), ["scan_id", "point_id"], "left").groupBy("scan_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("most"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean"), F.count_if(F.col("b").isNull()).alias("missing"), F.when(F.count_if(F.col("b").isNull() | (F.col("a") != F.col("b"))) > 0, "DIFFERENT").otherwise("SAME").alias("verdict")),
    ", d as (select scan_id, z_cm as a, case when point_id % 10 <> 3 then z_cm + case when point_id % 4 = 0 then 1 else 0 end end as b from points) select scan_id, max(abs(a - b)) as most, round(avg(abs(a - b)), 6) as mean, count(*) filter (b is null) as missing, case when count(*) filter (b is null or a <> b) > 0 then 'DIFFERENT' else 'SAME' end as verdict from d group by scan_id")
_on(("customer",), "safe_names", lambda c: c.select("c_custkey", F.concat(F.lit("scan_"), F.col("c_custkey").cast("string")).alias("name")).select("c_custkey", F.when(F.col("name").rlike("_[0-9]+$"), F.concat("name", F.lit("_fixedname"))).otherwise(F.col("name")).alias("name")).select("c_custkey", F.regexp_replace("name", "(fixedname)+", "fixedname").alias("name")),
    "select c_custkey, 'scan_' || c_custkey || '_fixedname' as name from customer", True)
_on(("orders", "customer"), "split_semijoin", lambda o, c: o.join(c.where("c_custkey % 3 = 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy((F.col("o_custkey") % 5).alias("part")).agg(F.count(F.lit(1)).alias("n")),
    "select o_custkey % 5 as part, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_custkey % 3 = 0) group by 1", True)
_on(("points",), "rounds_first_writer", lambda p: p.select((F.col("point_id") % 500).alias("k"), "scan_id", "point_id").groupBy("k").agg(F.min_by(F.struct("scan_id", "point_id"), F.struct("scan_id", "point_id")).alias("w")).select("k", "w.*"),
    " select k, scan_id, point_id from (select point_id % 500 as k, scan_id, point_id, row_number() over (partition by point_id % 500 order by scan_id, point_id) as r from points) where r = 1")


def _model(pdf):
    """A stand-in for a network: a point belongs to the 8-metre cell that it stands in."""
    out = pdf[["scan_id", "point_id"]].copy()
    out["instance"] = (pdf["x_cm"] // 800 * 100 + pdf["y_cm"] // 800).where(pdf["z_cm"] % 2 == 0, -1)
    return out


def _iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir).where("semantic_pred <> 0")

    def assign(left: DataFrame, k: int) -> DataFrame:
        got = rounds.score_with(left, _model, ["scan_id"], "scan_id int, point_id bigint, instance bigint")
        return got if k == 0 else left.select("scan_id", "point_id", F.when(F.col("point_id") % 3 == 0, F.col("scan_id")).otherwise(-1).cast("bigint").alias("instance"))

    return rounds.iterate(p, assign).groupBy("scan_id").agg(F.count_if(F.col("instance") >= 0).alias("assigned"), F.count_if(F.col("instance") < 0).alias("left"))


QUERIES["round_iteration"] = _iterated
SQL["round_iteration"] = views.WITH + " select scan_id, count(*) filter (z_cm % 2 = 0 or point_id % 3 = 0) as assigned, count(*) filter (not (z_cm % 2 = 0 or point_id % 3 = 0)) as \"left\" from points where semantic_pred <> 0 group by scan_id"


# ---- boxes, batches, training

_BX = """, bx as (select scan_id, instance_gt as box_id, (min(x_cm) + max(x_cm)) / 2 as cx, (min(y_cm) + max(y_cm)) / 2 as cy, (min(z_cm) + max(z_cm)) / 2 as cz,
  max(x_cm) - min(x_cm) as dx, max(y_cm) - min(y_cm) as dy, max(z_cm) - min(z_cm) as dz, pi() / 6 as a from points where instance_gt > 0 group by all),
inb as (select box_id, p.scan_id, point_id, abs((x_cm - cx) * cos(a) + (y_cm - cy) * sin(a)) - dx / 2 as u, abs((y_cm - cy) * cos(a) - (x_cm - cx) * sin(a)) - dy / 2 as v, abs(z_cm - cz) - dz / 2 as w
  from points p join bx on p.scan_id = bx.scan_id)"""
on_points("box_range_filter", lambda p: boxes.in_range(_boxes(p).withColumn("yaw", F.lit(4.0))).select("scan_id", "box_id", "yaw"), _BX + " select scan_id, box_id, round(4.0::double - 2 * pi(), 6) as yaw from bx where cx > 1000 and cx < 5000 and cy > 1000 and cy < 5000")
on_points("box_class_filter", lambda p: boxes.of_classes(_boxes(p).withColumn("class", (F.col("box_id") % 3).cast("int")), (0, 2)).select("scan_id", "box_id", "class"), _BX + " select scan_id, box_id, cast(box_id % 3 as int) as class from bx where box_id % 3 in (0, 2)")
on_points("box_margin_removed", lambda p: boxes.without_margin(p, _boxes(p)).select("scan_id", "point_id"), _BX + " select scan_id, point_id from points p where not exists (select 1 from inb i where i.scan_id = p.scan_id and i.point_id = p.point_id and u <= 50 and v <= 50 and w <= 50) or exists (select 1 from inb i where i.scan_id = p.scan_id and i.point_id = p.point_id and u <= 0 and v <= 0 and w <= 0)")
on_points("box_objects_put_in", lambda p: boxes.with_objects(p, _boxes(p), p.where("scan_id = 1 and instance_gt > 0")), _BX + " select scan_id, point_id, instance_gt from points p where not exists (select 1 from inb i where i.scan_id = p.scan_id and i.point_id = p.point_id and u <= 0 and v <= 0 and w <= 0) union all select scan_id, point_id, instance_gt from points where scan_id = 1 and instance_gt > 0")
_on(("customer",), "dataset_route", lambda c: boxes.route(c.select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "scannet_").when(F.col("c_custkey") % 3 == 1, "forest_").otherwise("x_"), F.col("c_custkey").cast("string")).alias("name")), "name", {"scannet": "indoor", "forest": "outdoor"}).groupBy("head").agg(F.count(F.lit(1)).alias("n")),
    "select case c_custkey % 3 when 0 then 'indoor' when 1 then 'outdoor' else 'unknown dataset' end as head, count(*) as n from customer group by 1", True)
on_points("region_merge", lambda p: boxes.region_merge(geo.tile_membership(p, 800, 1600).join(p.where("instance_pred >= 0").select("scan_id", "point_id", F.col("instance_pred").alias("local")), ["scan_id", "point_id"]).select("scan_id", "region_id", "point_id", "local")))
on_points("batch_offsets", training.batch_offsets, _V(20) + ", n as (select scan_id, count(distinct (vx, vy, vz)) as n from vx group by scan_id) select scan_id, n, cast(coalesce(sum(n) over (order by scan_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from n")
on_points("superpoint_pool", lambda p: training.pooled(p, [F.col("score_pct"), F.col("x_cm") - 3200, F.col("y_cm") - 3200]), _V(100) + " select scan_id, vx, vy, vz, round(sum(score_pct) / count(*), 6) as f0, round(sum(x_cm - 3200) / count(*), 6) as f1, round(sum(y_cm - 3200) / count(*), 6) as f2 from vx group by scan_id, vx, vy, vz")
on_points("voxel_sample_padded", training.padded_voxel_sample, _V(300) + """, ce as (select *, cast(row_number() over (partition by scan_id order by vx, vy, vz) - 1 as int) as slot from (select distinct scan_id, vx, vy, vz from vx)),
ke as (select * from ce where slot < 40), pa as (select scan_id, vx, vy, vz, cast(unnest(range((select count(*) from ke k where k.scan_id = ke.scan_id), 40)) as int) as slot from ke where slot = 0),
ra as (select * from (select *, row_number() over (partition by scan_id, vx, vy, vz order by point_id) as k from vx) where k <= 5)
select s.scan_id, s.slot, point_id from (select * from ke union all select * from pa) s join ra on s.scan_id = ra.scan_id and s.vx = ra.vx and s.vy = ra.vy and s.vz = ra.vz""")
on_points("patch_acceptance", training.patches, " select scan_id, cast(floor(x_cm / 800) as bigint) as px, cast(floor(y_cm / 800) as bigint) as py, count(distinct (floor(x_cm / 50), floor(y_cm / 50), floor(z_cm / 50))) as occupied, round(count(*) filter (instance_gt > 0) / count(*), 6) as labelled from points group by 1, 2, 3 having occupied >= 20 and labelled >= 0.7")
on_masks("instance_ordinals", lambda mp, m, p: training.instance_ordinals(m.withColumn("label", (F.col("mask_id") % 4).cast("int"))), " select scan_id, mask_id, cast(mask_id % 4 as int) as label, cast(row_number() over (partition by scan_id, mask_id % 4 order by mask_id) - 1 as int) as ordinal from masks where score_pct >= 20")
on_masks("mask_loss", lambda mp, m, p: training.mask_loss(views.mask_values(mp), metrics.mask_matches(mp, p.where("instance_gt > 0")), p), _MATCH + """, be as (select scan_id, mask_id, instance_gt as best from (select *, row_number() over (partition by scan_id, mask_id order by iou desc, instance_gt) as k from ma) where k = 1 and iou > 0.5),
pr as (select p.scan_id, p.instance_gt = best as hit, ((10 + (mp.point_id * 31 + mp.mask_id * 17) % 90) / 100)::double * 0.99::double as q from mask_points mp join be on mp.scan_id = be.scan_id and mp.mask_id = be.mask_id join points p on p.scan_id = mp.scan_id and p.point_id = mp.point_id)
select scan_id, round(avg(case when hit then -ln(q) else -ln(1 - q) end), 5) as loss, count(*) as n from pr group by scan_id""")
on_points("semantic_decode", lambda p: training.semantic_decode(views.class_values(p), ["c0", "c1", "c2"]), ", v as (select scan_id, point_id, (point_id * 13 + z_cm) % 97 as a, (point_id * 29 + z_cm) % 97 as b, (point_id * 47 + z_cm) % 97 as c from points) select scan_id, point_id, cast(case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as int) as semantic from v")
_on(("events",), "loss_sum", lambda e: training.loss_sum(e.select((F.col("event_id") % 10).alias("step"), F.concat(F.when(F.col("event_id") % 3 == 0, "loss_").otherwise("acc_"), F.col("event_type")).alias("key"), "value")),
    "with o as (select event_id % 10 as step, case when event_id % 3 = 0 then 'loss_' else 'acc_' end || event_type as key, avg(value) as v from events group by all) select step, round(sum(v) filter (key like '%loss%'), 6) as total, count(*) as keys from o group by step", True)

from stemline.plans import more  # noqa: E402,F401  registers its queries beside these
