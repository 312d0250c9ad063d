"""Queries of the evaluation protocol, joins of two tables, draws and the mask post-processor."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemline.operators import ap, augment, geo, labels, losses, masks, nearest, samplers
from stemline.plans import catalog, views
from stemline.plans.catalog import on_masks, on_points
from stemline.sources import text

# ---- average precision as published: ten thresholds, classes, void points, least sizes

_LEAST = 20
_AP = views.WITH.replace("with ", "with recursive ", 1) + f""",
tr as (select scan_id, point_id, instance_gt as instance, cast(case when instance_gt = 0 or instance_gt % 11 = 0 then 0 else 1 + instance_gt % 2 end as int) as class from points),
mq as (select * from mask_points union all
  select s.* from (select scan_id, point_id * 7 % 40 * 4 as mask_id, point_id from points where instance_gt = 0 and point_id % 3 = 0) s join masks m on s.scan_id = m.scan_id and s.mask_id = m.mask_id),
pn as (select mq.scan_id, mq.mask_id, cast(1 + (mq.mask_id // 4 + 1) % 2 as int) as class, any_value(m.score_pct) as score, count(*) as m_n, count(*) filter (tr.class = 0) as void_n
  from mq join tr on mq.scan_id = tr.scan_id and mq.point_id = tr.point_id join masks m on mq.scan_id = m.scan_id and mq.mask_id = m.mask_id group by mq.scan_id, mq.mask_id having count(*) >= {_LEAST}),
gn as (select scan_id, class, instance, count(*) as g_n from tr where class > 0 group by all),
ix as (select mq.scan_id, mq.mask_id, tr.class, tr.instance, count(*) as n from mq join tr on mq.scan_id = tr.scan_id and mq.point_id = tr.point_id where tr.class > 0 group by all),
iy as (select ix.*, m_n, g_n, score from ix join pn on ix.scan_id = pn.scan_id and ix.mask_id = pn.mask_id and ix.class = pn.class join gn on ix.scan_id = gn.scan_id and ix.class = gn.class and ix.instance = gn.instance),
th as (select unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 25]) as t),
ov as (select t, iy.* from iy, th where n / (m_n + g_n - n) > t / 100),
cd as (select t, scan_id, class, instance, row_number() over (partition by t, scan_id, class order by instance) as k, list(mask_id order by mask_id) as ms from ov where g_n >= {_LEAST} group by t, scan_id, class, instance),
rc as (select distinct t, scan_id, class, cast(0 as bigint) as k, cast([] as bigint[]) as seen, cast([] as bigint[]) as free from cd
  union all select rc.t, rc.scan_id, rc.class, cd.k, list_concat(rc.seen, list_filter(cd.ms, lambda x: not list_contains(rc.seen, x))[1:1]), list_filter(cd.ms, lambda x: not list_contains(rc.seen, x))
  from rc join cd on rc.t = cd.t and rc.scan_id = cd.scan_id and rc.class = cd.class and cd.k = rc.k + 1),
fr as (select t, scan_id, class, k, unnest(free) as mask_id from rc),
hi as (select fr.t, fr.class, pn.score, row_number() over (partition by fr.t, fr.scan_id, fr.class, fr.k order by pn.score desc, pn.mask_id) = 1 as hit from fr join pn on fr.scan_id = pn.scan_id and fr.mask_id = pn.mask_id),
sm as (select scan_id, mask_id, sum(n) as small_n from iy where g_n < {_LEAST} group by all),
al as (select th.t, pn.class, pn.score, false as hit from pn cross join th left join sm on pn.scan_id = sm.scan_id and pn.mask_id = sm.mask_id
  where (void_n + coalesce(small_n, 0)) / m_n <= th.t / 100 and not exists (select 1 from ov where ov.t = th.t and ov.scan_id = pn.scan_id and ov.mask_id = pn.mask_id)),
ex as (select * from hi union all select * from al),
mi as (select th.t, g.class, g.asked - coalesce(h.hits, 0) as missed from (select class, count(*) as asked from gn where g_n >= {_LEAST} group by class) g cross join th
  left join (select t, class, count(*) as hits from hi where hit group by all) h on h.t = th.t and h.class = g.class),
on1 as (select t, class, score, count(*) filter (hit) as h, count(*) as n from ex group by all),
cv as (select on1.t, on1.class, score, sum(h) over w / sum(n) over w as p, coalesce(sum(h) over w / nullif(sum(h) over (partition by on1.t, on1.class) + missed, 0), 0) as r
  from on1 join mi on on1.t = mi.t and on1.class = mi.class window w as (partition by on1.t, on1.class order by score desc)),
st as (select *, p * (coalesce(lag(r) over o, r) - coalesce(lead(r) over o, 0)) / 2 + case when lead(r) over o is null then r / 2 else 0 end as area, 2 * p * r / (p + r + 0.0001) as f1 from cv window o as (partition by t, class order by score)),
bs as (select t, class, sum(area) as ap, arg_max(p, struct_pack(f := f1, s := -score)) as bp, arg_max(r, struct_pack(f := f1, s := -score)) as br from st group by all),
tb as (select cast(th.t as int) as overlap, c.class, case when missed is null then null when c.class in (select class from pn) then round(coalesce(ap, 0), 6) else 0.0 end as ap,
  case when missed is null then null when c.class in (select class from pn) then round(coalesce(bp, 1), 6) else 0.0 end as best_precision,
  case when missed is null then null when c.class in (select class from pn) then round(coalesce(br, 0), 6) else 0.0 end as best_recall
  from th cross join (select unnest([1, 2]) as class) c left join mi on mi.t = th.t and mi.class = c.class left join bs on bs.t = th.t and bs.class = c.class)"""


def _thresholds(mp, m, p):
    return ap.evaluate(views.spilt_masks(mp, p, m), views.class_masks(m), views.truth(p), (1, 2), _LEAST)


def _register(name: str, make, sql: str) -> None:
    on_masks(name, make)
    catalog.SQL[name] = sql


_register("ap_thresholds", _thresholds, _AP + " select * from tb")
_register(
    "ap_averages", lambda mp, m, p: ap.averages(_thresholds(mp, m, p)),
    _AP + """ select class, round(avg(ap) filter (overlap <> 25), 6) as ap, round(avg(ap) filter (overlap = 50), 6) as ap50, round(avg(ap) filter (overlap = 25), 6) as ap25,
  round(avg(best_precision) filter (overlap = 50), 6) as precision50, round(avg(best_recall) filter (overlap = 50), 6) as recall50 from tb group by grouping sets ((class), ())""",
)
_register(
    "void_contingency",
    lambda mp, m, p: ap.contingency(views.spilt_masks(mp, p, m), views.class_masks(m), views.truth(p), (1, 2), _LEAST)[0],
    _AP + " select scan_id, mask_id, class, score, m_n, void_n from pn",
)

# ---- nearest neighbours of two tables

_SAMPLE = ", sm as (select scan_id, point_id as sample_id, x_cm, y_cm, z_cm, semantic_pred from points where point_id % 101 = 0)"
_NEAR = _SAMPLE + """, nn as (select p.scan_id, p.point_id, min(struct_pack(d2 := (p.x_cm - s.x_cm) * (p.x_cm - s.x_cm) + (p.y_cm - s.y_cm) * (p.y_cm - s.y_cm) + (p.z_cm - s.z_cm) * (p.z_cm - s.z_cm), id := s.sample_id)) as b
  from points p join sm s on p.scan_id = s.scan_id group by p.scan_id, p.point_id)"""
on_points("nearest_far_sample", lambda p: nearest.nearest_join(p, views.samples(p)), _NEAR + " select scan_id, point_id, b.id as sample_id, b.d2 as d2 from nn")
on_points("carried_back", lambda p: nearest.carried_back(p, views.samples(p), ["semantic_pred"]), _NEAR + " select nn.scan_id, nn.point_id, sm.semantic_pred from nn join sm on nn.scan_id = sm.scan_id and nn.b.id = sm.sample_id")
on_points(
    "ground_nearest_score", nearest.ground_scores,
    """, lo as (select scan_id, instance_pred, sum(x_cm) / count(*) as x, sum(y_cm) / count(*) as y, min(z_cm) as z,
  count(distinct (cast(floor(x_cm / 20.0) as bigint), cast(floor(y_cm / 20.0) as bigint), cast(floor(z_cm / 20.0) as bigint))) as volume from points where instance_pred >= 0 group by all),
gr as (select scan_id, point_id, x_cm, y_cm, z_cm from points where semantic_pred = 0),
nn as (select lo.scan_id, instance_pred, volume, z, arg_min(struct_pack(i := point_id, g := z_cm), struct_pack(d := (x_cm - x) * (x_cm - x) + (y_cm - y) * (y_cm - y) + (z_cm - z) * (z_cm - z), i := point_id)) as b
  from lo join gr on lo.scan_id = gr.scan_id group by all)
select scan_id, instance_pred, b.i as ground_id, z - b.g as height, case when z - b.g > 0 then round(volume / (z - b.g), 6) else 1e6 end as score from nn""",
)

# ---- draws

_HEX = "cast('0x' || substr(md5({0}), {1}, 7) as bigint)"
_U = lambda key, at: "((" + _HEX.format(key, at) + f" + 0.5) / {float(1 << 28)})"
_N = lambda key: f"sqrt(-2 * ln({_U(key, 1)})) * cos(2 * pi() * {_U(key, 8)})"
on_points(
    "sample_with_replacement", lambda p: samplers.with_replacement(p, 200),
    f""", pl as (select scan_id, point_id, row_number() over (partition by scan_id order by point_id) - 1 as place, count(*) over (partition by scan_id) as n from points),
tu as (select scan_id, n, unnest(range(0, least(200, n))) as turn from (select scan_id, count(*) as n from points group by scan_id))
select tu.scan_id, turn, point_id from tu join pl on pl.scan_id = tu.scan_id and pl.place = {_HEX.format("'7|' || tu.scan_id || '|' || turn", 1)} % tu.n""",
)
on_points("shuffled", samplers.shuffled, " select scan_id, point_id, row_number() over (partition by scan_id order by md5('7|' || point_id), point_id) - 1 as place from points")
on_points("jitter", samplers.jitter, " select scan_id, point_id, " + ", ".join(f"round({a}_cm + greatest(-5.0, least(5.0, {_N(chr(39) + '7|' + a + '|' + chr(39) + ' || point_id')} * 3.0)), 4) as {a}" for a in "xyz") + " from points")
_BOX = lambda p: p.where("instance_gt > 0").groupBy("scan_id", "instance_gt").agg(F.min("x_cm").alias("x0"), F.min("y_cm").alias("y0"), F.max("x_cm").alias("x1"), F.max("y_cm").alias("y1"))
_SPIN = lambda what: f"'7|{what}|' || scan_id || '|' || instance_gt || '|' || t"
on_points(
    "object_noise", lambda p: samplers.object_noise(p, _BOX(p)),
    f""", bx as (select scan_id, instance_gt, min(x_cm) as x0, min(y_cm) as y0, max(x_cm) as x1, max(y_cm) as y1 from points where instance_gt > 0 group by all),
tr0 as (select *, unnest(range(0, 8)) as t from bx),
tr1 as (select *, {_N(_SPIN('x'))} * 60.0 as dx, {_N(_SPIN('y'))} * 60.0 as dy, ({_U(_SPIN('a'), 1)} * 2 - 1) * 0.3 as angle, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, (x1 - x0) / 2 as hw, (y1 - y0) / 2 as hh from tr0),
tr2 as (select *, hw * abs(cos(angle)) + hh * abs(sin(angle)) as w, hw * abs(sin(angle)) + hh * abs(cos(angle)) as h from tr1),
tr3 as (select *, cx + dx - w as a0, cx + dx + w as a1, cy + dy - h as b0, cy + dy + h as b1 from tr2),
ok as (select * from tr3 where not exists (select 1 from bx o where o.scan_id = tr3.scan_id and o.instance_gt <> tr3.instance_gt and tr3.a0 <= o.x1 and tr3.a1 >= o.x0 and tr3.b0 <= o.y1 and tr3.b1 >= o.y0
  and not (tr3.x0 <= o.x1 and tr3.x1 >= o.x0 and tr3.y0 <= o.y1 and tr3.y1 >= o.y0))),
mv as (select scan_id, instance_gt, arg_min(struct_pack(dx := dx, dy := dy, angle := angle), t) as m from ok group by all),
al as (select bx.scan_id, bx.instance_gt, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, coalesce(m.dx, 0) as dx, coalesce(m.dy, 0) as dy, coalesce(m.angle, 0) as angle from bx left join mv on bx.scan_id = mv.scan_id and bx.instance_gt = mv.instance_gt)
select p.scan_id, point_id, round(cx + dx + (x_cm - cx) * cos(angle) - (y_cm - cy) * sin(angle), 3) as x, round(cy + dy + (x_cm - cx) * sin(angle) + (y_cm - cy) * cos(angle), 3) as y
from points p join al on p.scan_id = al.scan_id and p.instance_gt = al.instance_gt""",
)
on_points(
    "rotated_votes", lambda p: augment.rotate_votes(views.offsets(p)),
    """, c as (select scan_id, instance_gt, sum(x_cm) / count(*) as mx, sum(y_cm) / count(*) as my, sum(z_cm) / count(*) as mz from points where instance_gt > 0 group by all),
o as (select p.scan_id, point_id, -(mx - x_cm) as x, my - y_cm as y, mz - z_cm as z from points p join c on p.scan_id = c.scan_id and p.instance_gt = c.instance_gt)
select scan_id, point_id, round((x * cos(pi() / 6) - y * sin(pi() / 6)) * 1.05, 6) as gx, round((x * sin(pi() / 6) + y * cos(pi() / 6)) * 1.05, 6) as gy, round(z * 1.05, 6) as gz from o""",
)

# ---- masks

_TOP = """, tp as (select * from (select *, cast(mask_id // 4 % 2 as int) as label, row_number() over (partition by scan_id order by score_pct desc, mask_id) as rk from masks) where rk <= {0}),
hp as (select mp.scan_id, mp.mask_id, point_id, 10 + (point_id * 31 + mp.mask_id * 17) % 90 as p from mask_points mp join tp on mp.scan_id = tp.scan_id and mp.mask_id = tp.mask_id)"""
_DECAY = """, rn as (select *, row_number() over (partition by scan_id order by score_pct desc, mask_id) as rank from sz),
pr as (select x.scan_id, least(x.rank, y.rank) as i, greatest(x.rank, y.rank) as j, o.n / (x.n_points + y.n_points - o.n) as iou
  from (select a.scan_id, a.mask_id as a, b.mask_id as b, count(*) as n from hp a join hp b on a.scan_id = b.scan_id and a.point_id = b.point_id and a.mask_id < b.mask_id group by all) o
  join rn x on o.scan_id = x.scan_id and o.a = x.mask_id join rn y on o.scan_id = y.scan_id and o.b = y.mask_id where x.label = y.label),
ow as (select scan_id, j, max(iou) as own from pr group by all),
dc as (select pr.scan_id, pr.j, min((1 - iou) / (1 - coalesce(own, 0))) as decay from pr left join ow on pr.scan_id = ow.scan_id and pr.i = ow.j where coalesce(own, 0) < 1 group by all),
nm as (select rn.scan_id, mask_id, round(score_pct / 100 * least(coalesce(decay, 1), 1), 6) as score from rn left join dc on rn.scan_id = dc.scan_id and rn.rank = dc.j)"""
on_masks(
    "matrix_nms_labelled", lambda mp, m, p: masks.matrix_nms(mp, views.mask_labels(m), label="label", first=60, least=0.2, most=25),
    _TOP.format(60) + ", sz as (select scan_id, mask_id, label, score_pct, n_points from tp)" + _DECAY + """
select scan_id, mask_id, score from (select *, row_number() over (partition by scan_id order by score desc, mask_id) as turn from nm where score > 0.2) where turn <= 25""",
)
_CHAIN = _TOP.format(40) + """, ob as (select hp.scan_id, hp.mask_id, round(any_value(score_pct) / 100 * (coalesce(sum(p) filter (p > 30), 0) / 100) / (count(*) filter (p > 30) + 1e-6), 6) as s
  from hp join tp on hp.scan_id = tp.scan_id and hp.mask_id = tp.mask_id group by hp.scan_id, hp.mask_id),
sz as (select tp.scan_id, tp.mask_id, label, s * 100 as score_pct, n_points from tp join ob on tp.scan_id = ob.scan_id and tp.mask_id = ob.mask_id)"""
_HARD = """, hd as (select hp.scan_id, hp.mask_id, point_id from hp join {0} nm on hp.scan_id = nm.scan_id and hp.mask_id = nm.mask_id where nm.score > 0.05 and 1 / (1 + exp(-(p - 50) / 20.0)) > 0.6),
ns as (select scan_id, mask_id, count(*) as n_points from hd group by all having count(*) > 10)
select nm.scan_id, nm.mask_id, nm.score, ns.n_points from {0} nm join ns on nm.scan_id = ns.scan_id and nm.mask_id = ns.mask_id where nm.score > 0.05"""
_EDGE = """ and (select max((x_cm - (1600 + nm.mask_id // 4 % 3 * 1600)) * (x_cm - (1600 + nm.mask_id // 4 % 3 * 1600)) + (y_cm - 3200) * (y_cm - 3200)) from hd join points p on hd.scan_id = p.scan_id and hd.point_id = p.point_id
  where hd.scan_id = nm.scan_id and hd.mask_id = nm.mask_id) <= 2402500"""
on_masks("mask_chain", lambda mp, m, p: masks.predict(views.soft_points(mp), views.mask_labels(m), p, views.centres(m)), _CHAIN + _DECAY + _HARD.format("nm") + _EDGE)
on_masks("mask_chain_whole_scans", lambda mp, m, p: masks.predict(views.soft_points(mp), views.mask_labels(m), p, None, nms=False), _CHAIN + ", nq as (select scan_id, mask_id, s as score from ob)" + _HARD.format("nq"))
on_masks(
    "cropped_iou", lambda mp, m, p: losses.cropped_iou(views.mask_values(mp), p, p.where("instance_gt > 0").select("scan_id", "instance_gt", (0.5 + F.col("instance_gt") % 5 / 10.0).alias("ratio")).distinct()),
    """, tg as (select scan_id, point_id, instance_gt from points where instance_gt > 0), gs as (select scan_id, instance_gt, count(*) / any_value(0.5 + instance_gt % 5 / 10.0) as g from tg group by all),
mv as (select *, (10 + (point_id * 31 + mask_id * 17) % 90) / 100.0 as p from mask_points), ms as (select scan_id, mask_id, sum(p) as s from mv group by all),
ht as (select mv.scan_id, mask_id, instance_gt, sum(p) as h from mv join tg on mv.scan_id = tg.scan_id and mv.point_id = tg.point_id group by all)
select ht.scan_id, ht.mask_id, ht.instance_gt, round(h / (g + s - h + 1e-6), 6) as iou from ht join gs on ht.scan_id = gs.scan_id and ht.instance_gt = gs.instance_gt join ms on ht.scan_id = ms.scan_id and ht.mask_id = ms.mask_id""",
)

# ---- votes of tiles a radius apart, first seen wins

on_points(
    "tile_vote_first_seen", lambda p: labels.tile_votes(p, views.tile_answers(geo.tile_membership(p, 1600, 1600), p), first_seen=True),
    catalog._TILE.replace("// 400", "// 1600").replace("* 400", "* 1600") + """, vo as (select scan_id, point_id, case when region_id % 5 = 0 then (semantic_pred + 1) % 3 else semantic_pred end as v, count(*) as n, min(region_id) as r from tm group by all),
be as (select scan_id, point_id, arg_max(v, struct_pack(n := n, r := -r)) as s from vo group by all)
select p.scan_id, p.point_id, cast(coalesce(s, -1) as int) as semantic from points p left join be on p.scan_id = be.scan_id and p.point_id = be.point_id""",
)

# ---- information records

on_points(
    "info_without_nulls",
    lambda p: text.pruned(p.groupBy("scan_id").agg(F.count_if(F.col("instance_gt") > 0).alias("n")).select("scan_id", F.struct(F.struct(F.col("n").alias("points"), F.lit(None).cast("string").alias("calib")).alias("lidar"), F.lit(None).cast("int").alias("images")).alias("info")), "info"),
    " select scan_id, '{\"lidar\":{\"points\":' || count(*) filter (instance_gt > 0) || '}}' as info from points group by scan_id",
)
on_points(
    "split_by_path",
    lambda p: p.select(F.concat(F.lit("data/"), F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test"), F.lit("other")), (F.col("scan_id") + 1).cast("int")), F.lit("/"), F.col("scan_id").cast("string")).alias("path"), "point_id").withColumn("split", text.split_of(F.col("path"))).groupBy("path", "split").agg(F.count(F.lit(1)).alias("n")),
    " select 'data/' || ['train', 'val', 'test', 'other'][scan_id + 1] || '/' || scan_id as path, case scan_id when 0 then 'train' when 1 then 'val' when 2 then 'test' end as split, count(*) as n from points group by scan_id",
)

# ---- SQL of queries beside these

_MOVE = lambda k: " + ".join(
    f"(cast('0x' || substr(md5('7|{k}|' || (kx + {c & 1}) || '|' || (ky + {c >> 1 & 1}) || '|' || (kz + {c >> 2 & 1})), 1, 6) as bigint) / 8388608.0 - 1)"
    + "".join(f" * {'f' + a if c >> i & 1 else '(1 - f' + a + ')'}" for i, a in enumerate("xyz"))
    for c in range(8)
)
catalog.SQL["elastic"] = views.WITH + f""",
la as (select *, {", ".join(f"cast(floor({a}_cm / 600.0) as bigint) as k{a}, {a}_cm / 600.0 - floor({a}_cm / 600.0) as f{a}" for a in "xyz")} from points)
select scan_id, point_id, {", ".join(f"round({a}_cm + 40.0 * ({_MOVE(k)}), 4) as {a}" for k, a in enumerate("xyz"))} from la"""
catalog._on(
    ("embeddings",), "mahalanobis_plane", lambda e: losses.mahalanobis(e, 2),
    """with e as (select vec_id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings),
m as (select label, avg(x) as mx, avg(y) as my, covar_samp(x, x) + 1e-6 as a, covar_samp(x, y) as b, covar_samp(y, y) + 1e-6 as d from e group by label),
q as (select vec_id, e.label, (d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b) as d2 from e join m on e.label = m.label)
select vec_id, label, round(d2, 4) as d2, round(exp(-d2), 6) as score from q""",
    True,
)
