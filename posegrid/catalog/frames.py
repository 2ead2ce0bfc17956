"""Queries over poses, time stamps, pixels, segmentation pairs and ray samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CAMERA, r4
from ..functions import geometry as g
from ..functions import labels as L
from ..operators import matching
from ..operators import rays as R
from ..operators import sampling
from ..operators import segmentation as S
from ..operators import trajectory as T
from .registry import query

POSE = [f"r{i}{j}" for i in range(3) for j in range(3)]
XYZ = ("x", "y", "z")


def _r4cols(df, keys, cols):
    return df.select(*keys, *[r4(c).alias(c) for c in cols])


# -- poses -------------------------------------------------------------------------------------


@query(
    "p14_camera_flip",
    "SELECT seq_id, frame_idx, r4(r00) AS r00, r4(-r01) AS r01, r4(-r02) AS r02, r4(r10) AS r10, r4(-r11) AS r11, r4(-r22) AS r22 FROM fx_pose",
)
def _(fx):
    r = g.flip_camera(g.mat("r"))
    cols = {"r00": r[0][0], "r01": r[0][1], "r02": r[0][2], "r10": r[1][0], "r11": r[1][1], "r22": r[2][2]}
    return fx.pose.select("seq_id", "frame_idx", *[r4(v).alias(k) for k, v in cols.items()])


@query(
    "p14_world_frame_change",
    """SELECT seq_id, frame_idx, r4(r00) AS r00, r4(-r01) AS r01, r4(r20) AS r10, r4(-r22) AS r12, r4(-r10) AS r20, r4(r11) AS r21, r4(tx) AS tx, r4(tz) AS ty, r4(-ty) AS tz FROM fx_pose""",
)
def _(fx):
    r, t = g.world_to_yup(g.mat("r"), g.vec("tx", "ty", "tz"))
    cols = {"r00": r[0][0], "r01": r[0][1], "r10": r[1][0], "r12": r[1][2], "r20": r[2][0], "r21": r[2][1], "tx": t[0], "ty": t[1], "tz": t[2]}
    return fx.pose.select("seq_id", "frame_idx", *[r4(v).alias(k) for k, v in cols.items()])


@query(
    "p15_matrix_to_quaternion",
    """SELECT seq_id, frame_idx, r4(CASE WHEN c >= 0 THEN sqrt((1+c)/2) ELSE abs(s)/sqrt((1-c)/2)/2 * sign(s) END) AS qw,
      r4(0.0) AS qx, r4(CASE WHEN c >= 0 THEN s/(2*sqrt((1+c)/2)) ELSE sqrt((1-c)/2) END) AS qz FROM (SELECT *, r00 AS c, r10 AS s FROM fx_pose)""",
)
def _(fx):
    q = g.matrix_to_quat(g.mat("r"))
    return fx.pose.select("seq_id", "frame_idx", r4(q[0]).alias("qw"), r4(q[1]).alias("qx"), r4(q[3]).alias("qz"))


@query(
    "p15_quaternion_to_matrix",
    """WITH q AS (SELECT event_id, (event_id % 7)::DOUBLE + 1 AS w, (event_id % 5)::DOUBLE AS x, (event_id % 3)::DOUBLE AS y, (event_id % 11)::DOUBLE AS z FROM events),
    u AS (SELECT event_id, w/n AS w, x/n AS x, y/n AS y, z/n AS z FROM (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM q))
    SELECT event_id, r4(1-2*(y*y+z*z)) AS r00, r4(2*(x*y-w*z)) AS r01, r4(2*(x*z+w*y)) AS r02, r4(2*(y*z-w*x)) AS r12, r4(1-2*(x*x+y*y)) AS r22 FROM u""",
)
def _(fx):
    e = F.col("event_id")
    m = g.quat_to_matrix(*[(e % k).cast("double") + c for k, c in ((7, 1), (5, 0), (3, 0), (11, 0))])
    return fx.table("events").select(
        "event_id", r4(m[0][0]).alias("r00"), r4(m[0][1]).alias("r01"), r4(m[0][2]).alias("r02"), r4(m[1][2]).alias("r12"), r4(m[2][2]).alias("r22")
    )


@query(
    "p16_relative_to_first",
    """WITH f AS (SELECT seq_id, r00 AS a, r10 AS b, tx AS x0, ty AS y0, tz AS z0 FROM fx_pose WHERE frame_idx = 0)
    SELECT p.seq_id, frame_idx, r4(a*r00+b*r10) AS r00, r4(-(a*r01+b*r11)) AS r01, r4(a*r10-b*r00) AS r10, r4(-(1.0)) AS r22,
      r4(a*(tx-x0)+b*(ty-y0)) AS tx, r4(a*(ty-y0)-b*(tx-x0)) AS ty, r4(tz-z0) AS tz FROM fx_pose p JOIN f ON p.seq_id = f.seq_id""",
)
def _(fx):
    return _r4cols(T.relative_to_first(fx.pose), ["seq_id", "frame_idx"], ["r00", "r01", "r10", "r22", "tx", "ty", "tz"])


@query("p17_unit_rescale", "SELECT seq_id, frame_idx, r4(tx / 2.5) AS tx, r4(ty / 2.5) AS ty, r4(tz / 2.5) AS tz FROM fx_pose")
def _(fx):
    return fx.pose.select("seq_id", "frame_idx", *[r4(F.col(c) / 2.5).alias(c) for c in ("tx", "ty", "tz")])


RAY = {
    a: f"(r{i}0*((u-3.5)/6.0)+r{i}1*(-(v-5.5)/6.0)+r{i}2*(-1.0))" for i, a in enumerate(XYZ)
}


@query(
    "p18_back_projection",
    f"""SELECT frame, v, u, {', '.join(f'r4({RAY[a]}) AS d{a}' for a in XYZ)}, {', '.join(f'r4(t{a}+{RAY[a]}*depth) AS {a}' for a in XYZ)} FROM fx_view_pixel""",
)
def _(fx):
    p = fx.view_pixel
    u, v = F.col("u").cast("double"), F.col("v").cast("double")
    d = g.pixel_ray(u, v, CAMERA, g.mat("r"))
    q = g.back_project(u, v, F.col("depth"), CAMERA, g.mat("r"), g.vec("tx", "ty", "tz"))
    return p.select("frame", "v", "u", *[r4(c).alias("d" + a) for a, c in zip(XYZ, d)], *[r4(c).alias(a) for a, c in zip(XYZ, q)])


PROJECT_SQL = """SELECT c.point_id, w.frame, w.image, c.scene_id, (r00*(x-tx)+r10*(y-ty)+r20*(z-tz)) AS cx, (r01*(x-tx)+r11*(y-ty)+r21*(z-tz)) AS cy, (r02*(x-tx)+r12*(y-ty)+r22*(z-tz)) AS cz
      FROM fx_keyed_cloud c JOIN fx_view w ON w.scene_id = c.scene_id"""
UV_SQL = f"""SELECT point_id, frame, image, scene_id, (6.0*(-cx)+3.5*cz)/(cz+1e-5) AS u, (6.0*cy+5.5*cz)/(cz+1e-5) AS v, cz+1e-5 AS z FROM ({PROJECT_SQL})"""


@query(
    "p19_world_to_pixel",
    """WITH q AS (SELECT frame, u AS pu, v AS pv, r00, r01, r02, r10, r11, r12, r20, r21, r22, (v::DOUBLE/4.0 - tx) AS x, (u::DOUBLE/2.0 - ty) AS y, (depth - tz) AS z FROM fx_view_pixel),
    c AS (SELECT *, r00*x+r10*y+r20*z AS cx, r01*x+r11*y+r21*z AS cy, r02*x+r12*y+r22*z AS cz FROM q)
    SELECT frame, pu, pv, round((6.0*(-cx)+3.5*cz)/(cz+1e-5), 2) AS u, round((6.0*cy+5.5*cz)/(cz+1e-5), 2) AS v, r4(cz+1e-5) AS z FROM c WHERE abs(cz) > 0.01""",
)
def _(fx):
    p = fx.view_pixel
    pt = [F.col("v").cast("double") / 4.0, F.col("u").cast("double") / 2.0, F.col("depth")]
    q = g.project(pt, CAMERA, g.mat("r"), g.vec("tx", "ty", "tz"))
    out = p.select("frame", F.col("u").alias("pu"), F.col("v").alias("pv"), F.round(q["u"], 2).alias("u"), F.round(q["v"], 2).alias("v"), q["z"].alias("z"))
    return out.filter(F.abs(F.col("z") - 1e-5) > 0.01).withColumn("z", r4("z"))


@query(
    "p09_crop_and_resize",
    """WITH c AS (SELECT frame, v - 1 AS v, u - 1 AS u, depth FROM fx_pixel WHERE v >= 1 AND v < 11 AND u >= 1 AND u < 7),
    t AS (SELECT v, u FROM range(5) a(v), range(3) b(u)), f AS (SELECT DISTINCT frame FROM fx_pixel)
    SELECT c.frame, t.v, t.u, r4(depth) AS depth FROM f, t JOIN c ON c.v = t.v * 10 // 5 AND c.u = t.u * 6 // 3 WHERE c.frame = f.frame""",
)
def _(fx):
    edge, (h, w), (h1, w1) = 1, (10, 6), (5, 3)
    p = fx.pixel.filter((F.col("v") >= edge) & (F.col("v") < 12 - edge) & (F.col("u") >= edge) & (F.col("u") < 8 - edge))
    p = p.select("frame", (F.col("v") - edge).alias("sv"), (F.col("u") - edge).alias("su"), "depth")
    # Nearest resize: target (v, u) reads source floor(v*h/h1), floor(u*w/w1); each source pixel
    # therefore serves the targets in one index range.
    tv = F.sequence(F.ceil(F.col("sv") * h1 / h), F.ceil((F.col("sv") + 1) * h1 / h) - 1)
    tu = F.sequence(F.ceil(F.col("su") * w1 / w), F.ceil((F.col("su") + 1) * w1 / w) - 1)
    has = lambda c, a, b: F.ceil(F.col(c) * a / b) <= F.ceil((F.col(c) + 1) * a / b) - 1
    p = p.filter(has("sv", h1, h) & has("su", w1, w))
    return p.withColumn("v", F.explode(tv)).withColumn("u", F.explode(tu)).select("frame", "v", "u", r4("depth").alias("depth"))


@query("p22_sdf_to_alpha", "SELECT event_id, r4(1.0-exp(-10.0/(1.0+exp(10.0*sdf)))) AS alpha FROM fx_ray_sample")
def _(fx):
    return fx.ray_sample.select("event_id", r4(g.sdf_to_alpha(F.col("sdf"))).alias("alpha"))


@query(
    "f02_valid_poses",
    """WITH g AS (SELECT seq_id, frame_idx, CASE WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 19 = 0 THEN 'Infinity'::DOUBLE ELSE tx END AS tx FROM fx_pose)
    SELECT e.seq_id, e.frame_idx, r4(e.tx) AS tx FROM fx_pose_est e SEMI JOIN (SELECT * FROM g WHERE NOT isnan(tx) AND NOT isinf(tx)) v ON e.seq_id = v.seq_id AND e.frame_idx = v.frame_idx""",
)
def _(fx):
    e = F.col("event_id")
    gt = fx.pose.withColumn("tx", F.when(e % 17 == 0, float("nan")).when(e % 19 == 0, float("inf")).otherwise(F.col("tx")))
    ok = T.valid_frames(gt, POSE + ["tx", "ty", "tz"])
    return fx.pose_est.join(ok, ["seq_id", "frame_idx"], "left_semi").select("seq_id", "frame_idx", r4("tx").alias("tx"))


@query("f03_valid_depth", "SELECT frame, v, u, r4(depth) AS depth FROM fx_pixel WHERE depth > 0")
def _(fx):
    return fx.pixel.filter("depth > 0").select("frame", "v", "u", r4("depth").alias("depth"))


@query(
    "f04_median_error_mask",
    """WITH e AS (SELECT frame, v, gt, abs(gt_depth - est_depth) AS err FROM fx_pixel_pair), m AS (SELECT frame, quantile_disc(err, 0.5) AS med FROM e GROUP BY frame)
    SELECT e.frame, count(*) AS n, r4(sum(err)) AS total FROM e JOIN m ON e.frame = m.frame WHERE err < 10 * med GROUP BY e.frame""",
)
def _(fx):
    e = fx.pixel_pair.select("frame", "v", "gt", F.abs(F.col("gt_depth") - F.col("est_depth")).alias("err"))
    return R.median_error_mask(e, ["frame"], "err").groupBy("frame").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("err")).alias("total"))


@query(
    "f07_every_nth",
    """WITH t AS (SELECT seq_id, max(frame_idx) AS top FROM fx_pose GROUP BY seq_id)
    SELECT p.seq_id, frame_idx FROM fx_pose p JOIN t ON p.seq_id = t.seq_id WHERE frame_idx % 5 = 0 UNION ALL SELECT seq_id, top FROM t""",
)
def _(fx):
    return T.every_nth(fx.pose.select("seq_id", "frame_idx"), 5)


@query("f10_border_excluded", "SELECT frame, v, u, r4(depth) AS depth FROM fx_pixel WHERE v >= 2 AND v < 10 AND u >= 2 AND u < 6")
def _(fx):
    return fx.pixel.filter("v >= 2 AND v < 10 AND u >= 2 AND u < 6").select("frame", "v", "u", r4("depth").alias("depth"))


# -- stamps ------------------------------------------------------------------------------------


def _kind(fx, k):
    return fx.stamps.filter(F.col("kind") == k).select("id", "ts")


@query(
    "j01_frame_association",
    """WITH i AS (SELECT * FROM fx_stamps WHERE kind = 'image'),
    d AS (SELECT i.id, s.id AS other, abs(i.ts - s.ts) AS dt, row_number() OVER (PARTITION BY i.id ORDER BY abs(i.ts - s.ts), s.ts) AS rn FROM i JOIN fx_stamps s ON s.kind = 'depth' AND abs(i.ts - s.ts) < 3000),
    p AS (SELECT i.id, s.id AS other, abs(i.ts - s.ts) AS dt, row_number() OVER (PARTITION BY i.id ORDER BY abs(i.ts - s.ts), s.ts) AS rn FROM i JOIN fx_stamps s ON s.kind = 'pose' AND abs(i.ts - s.ts) < 3000)
    SELECT d.id AS image_id, d.other AS depth_id, p.other AS pose_id, r4(d.dt) AS depth_dt, r4(p.dt) AS pose_dt FROM d JOIN p ON d.id = p.id WHERE d.rn = 1 AND p.rn = 1 AND d.dt < 3000 AND p.dt < 3000""",
)
def _(fx):
    a = matching.associate_frames(_kind(fx, "image"), _kind(fx, "depth"), _kind(fx, "pose"), max_dt=3000.0)
    return a.select("image_id", "depth_id", "pose_id", r4("depth_dt").alias("depth_dt"), r4("pose_dt").alias("pose_dt"))


@query(
    "j02_one_to_one_match",
    """WITH RECURSIVE c AS (SELECT a.ts AS a, b.ts AS b, row_number() OVER (ORDER BY abs(a.ts - b.ts), a.ts, b.ts) AS rn FROM fx_stamps a JOIN fx_stamps b
      ON a.kind = 'image' AND b.kind = 'depth' AND abs(a.ts - b.ts) < 300),
    g(rn, ua, ub, took) AS (SELECT 0::BIGINT, []::DOUBLE[], []::DOUBLE[], false UNION ALL
      SELECT c.rn, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END,
        NOT (list_contains(ua, a) OR list_contains(ub, b)) FROM g JOIN c ON c.rn = g.rn + 1)
    SELECT c.a, c.b FROM g JOIN c ON c.rn = g.rn WHERE took""",
)
def _(fx):
    return matching.match_one_to_one(_kind(fx, "image").select("ts"), _kind(fx, "depth").select("ts"), max_difference=300.0).select("a", "b")


@query(
    "j08_positional_zip",
    """WITH r AS (SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY regexp_extract(path, '_(\\d+)\\.png', 1)::BIGINT) AS pos FROM fx_paths)
    SELECT a.pos - 1 AS pos, a.path AS rgb, b.path AS depth FROM r a JOIN r b ON a.pos = b.pos AND a.kind = 'rgb' AND b.kind = 'depth'""",
)
def _(fx):
    from ..sources.manifest import frame_manifest

    m = frame_manifest(fx.paths, [])
    rgb = m.filter("kind = 'rgb'").select("pos", F.col("path").alias("rgb"))
    return rgb.join(m.filter("kind = 'depth'").select("pos", F.col("path").alias("depth")), "pos")


@query(
    "w01_constant_speed",
    """SELECT seq_id, frame_idx, r4(coalesce(2 * lag(tx, 1) OVER w - lag(tx, 2) OVER w, lag(tx, 1) OVER w)) AS pred_tx, r4(coalesce(2 * lag(ty, 1) OVER w - lag(ty, 2) OVER w, lag(ty, 1) OVER w)) AS pred_ty
    FROM fx_pose WINDOW w AS (PARTITION BY seq_id ORDER BY frame_idx)""",
)
def _(fx):
    return _r4cols(T.predict_constant_speed(fx.pose, ["tx", "ty"]), ["seq_id", "frame_idx"], ["pred_tx", "pred_ty"])


@query(
    "w05_gap_segments",
    """WITH s AS (SELECT seq_id, frame_idx, ts, ts - lag(ts) OVER (PARTITION BY seq_id ORDER BY frame_idx) AS step FROM fx_pose),
    m AS (SELECT seq_id, median(step) AS med FROM s GROUP BY seq_id), g AS (SELECT s.*, coalesce(step >= 2 * med, false) AS gap FROM s JOIN m ON s.seq_id = m.seq_id),
    n AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY frame_idx) AS segment FROM g)
    SELECT seq_id, frame_idx, segment::BIGINT AS segment FROM n WHERE NOT gap""",
)
def _(fx):
    return T.split_at_gaps(fx.pose.select("seq_id", "frame_idx", "ts")).select("seq_id", "frame_idx", "segment")


@query(
    "w06_min_gap_thinning",
    """WITH RECURSIVE k AS (SELECT seq_id, frame_idx, ts, ts AS last FROM fx_pose WHERE frame_idx = 0 UNION ALL
      SELECT p.seq_id, p.frame_idx, p.ts, CASE WHEN p.ts - k.last > 50000 THEN p.ts ELSE k.last END FROM k JOIN fx_pose p ON p.seq_id = k.seq_id AND p.frame_idx = k.frame_idx + 1)
    SELECT seq_id, frame_idx FROM k WHERE ts = last""",
)
def _(fx):
    return T.thin_min_gap(fx.pose.select("seq_id", "frame_idx", "ts"), 50000.0).select("seq_id", "frame_idx")


@query(
    "w09_trace_last_write",
    """WITH f AS (SELECT *, max(iter) OVER (PARTITION BY trace_id) AS final, row_number() OVER (PARTITION BY trace_id, iter ORDER BY run_id DESC) AS rn FROM fx_trace)
    SELECT trace_id, iter, r4(t0) AS t0, r4(m00) AS m00 FROM f WHERE rn = 1 AND (iter % 4 = 0 OR iter = final)""",
)
def _(fx):
    t = T.last_write_per_iteration(fx.trace, ["trace_id"], "run_id", 4, ["t0", "m00"])
    return t.select("trace_id", "iter", r4("t0").alias("t0"), r4("m00").alias("m00"))


def _trajectory_pairs(fx):
    gt = fx.pose.select("seq_id", "frame_idx", F.col("tx").alias("dx"), F.col("ty").alias("dy"), F.col("tz").alias("dz"))
    est = fx.pose_est.select("seq_id", "frame_idx", F.col("tx").alias("sx"), F.col("ty").alias("sy"), F.col("tz").alias("sz"))
    return gt.join(est, ["seq_id", "frame_idx"])


@query(
    "a08_alignment_moments",
    """WITH p AS (SELECT a.seq_id, a.tx AS dx, a.ty AS dy, e.tx AS sx, e.ty AS sy FROM fx_pose a JOIN fx_pose_est e ON a.seq_id = e.seq_id AND a.frame_idx = e.frame_idx)
    SELECT seq_id, count(*) AS n, r4(avg(sx)) AS msx, r4(avg(dy)) AS mdy, r4(covar_pop(dx, sx)) AS cxx, r4(covar_pop(dx, sy)) AS cxy, r4(covar_pop(dy, sx)) AS cyx, r4(covar_pop(dy, sy)) AS cyy FROM p GROUP BY seq_id""",
)
def _(fx):
    from ..operators.fit import weighted_moments

    return _r4cols(weighted_moments(_trajectory_pairs(fx), ["seq_id"]), ["seq_id", "n"], ["msx", "mdy", "cxx", "cxy", "cyx", "cyy"])


@query("a08_horn_alignment")
def _(fx):
    return T.horn_align(_trajectory_pairs(fx), ["seq_id"])


@query(
    "a18_error_statistics",
    """WITH p AS (SELECT a.seq_id, sqrt((a.tx-e.tx)**2 + (a.ty-e.ty)**2 + (a.tz-e.tz)**2) AS err FROM fx_pose a JOIN fx_pose_est e ON a.seq_id = e.seq_id AND a.frame_idx = e.frame_idx)
    SELECT seq_id, count(*) AS pairs, r4(sqrt(avg(err*err))*100) AS rmse, r4(avg(err)*100) AS mean, r4(stddev_pop(err)*100) AS std, r4(min(err)*100) AS min, r4(max(err)*100) AS max, r4(median(err)*100) AS median FROM p GROUP BY seq_id""",
)
def _(fx):
    e = _trajectory_pairs(fx).withColumn("err", g.norm(g.sub(g.vec("sx", "sy", "sz"), g.vec("dx", "dy", "dz"))))
    return _r4cols(T.error_statistics(e, ["seq_id"]), ["seq_id", "pairs"], ["rmse", "mean", "std", "min", "max", "median"])


# -- segmentation ------------------------------------------------------------------------------

CLASS_SQL = """c AS (SELECT gt, pred, count(*) AS n FROM fx_pixel_pair WHERE gt >= 0 AND gt < 7 GROUP BY gt, pred),
    k AS (SELECT l.label, coalesce((SELECT sum(n) FROM c WHERE gt = l.label), 0)::BIGINT AS gt_n, coalesce((SELECT sum(n) FROM c WHERE pred = l.label), 0)::BIGINT AS pred_n,
      coalesce((SELECT sum(n) FROM c WHERE gt = l.label AND pred = l.label), 0)::BIGINT AS inter FROM range(7) l(label)),
    s AS (SELECT *, gt_n + pred_n - inter AS union_n, inter::DOUBLE / (gt_n + pred_n - inter) AS iou FROM k)"""


@query("a20_class_scores", f"WITH {CLASS_SQL} SELECT label, gt_n, pred_n, inter, union_n, r4(iou) AS iou FROM s")
def _(fx):
    return S.class_scores(S.confusion(fx.pixel_pair), 7).select("label", "gt_n", "pred_n", "inter", "union_n", r4("iou").alias("iou"))


@query(
    "a20_score_summary",
    f"""WITH {CLASS_SQL} SELECT r4(avg(iou)) AS miou, r4(avg(iou) FILTER (label <> 0)) AS miou_no_back, r4(sum(iou*gt_n)/sum(gt_n)) AS freq_iou,
      r4(sum(inter)/sum(gt_n)) AS pixel_acc, sum(gt_n)::BIGINT AS labeled FROM s""",
)
def _(fx):
    s = S.score_summary(S.class_scores(S.confusion(fx.pixel_pair), 7))
    return s.select(*[r4(c).alias(c) for c in ("miou", "miou_no_back", "freq_iou", "pixel_acc")], "labeled")


LOGIT = "[((event_id * (3 + c) * 37) % 101)::DOUBLE / 20.0 FOR c IN [0,1,2,3,4,5]]"


def _logits():
    e = F.col("event_id")
    return F.array(*[((e * (3 + c) * 37) % 101).cast("double") / 20.0 for c in range(6)])


@query(
    "a21_accumulated_scores",
    f"""WITH l AS (SELECT raw % 6 AS gt, {LOGIT} AS s FROM fx_pixel), p AS (SELECT gt, list_position(s, list_max(s)) - 1 AS pred,
      list_position([trunc(x) FOR x IN s], list_max([trunc(x) FOR x IN s])) - 1 AS pred_acc FROM l),
    k AS (SELECT c, sum(CASE WHEN gt = c AND pred = c THEN 1 ELSE 0 END) AS i, sum(CASE WHEN gt = c OR pred = c THEN 1 ELSE 0 END) AS u FROM p, range(6) t(c) GROUP BY c)
    SELECT r4((SELECT sum(CASE WHEN gt = pred_acc THEN 1 ELSE 0 END) / (2.220446049250313e-16 + count(*)) FROM p)) AS pix_acc, r4((SELECT avg(i / (2.220446049250313e-16 + u)) FROM k WHERE u > 0)) AS miou""",
)
def _(fx):
    p = fx.pixel.select((F.col("raw") % 6).alias("gt"), _logits().alias("s"))
    p = p.select("gt", L.argmax(F.col("s")).alias("pred"), L.argmax(F.col("s"), truncate=True).alias("pred_acc"))
    return S.accumulated_scores(p, 6).select(r4("pix_acc").alias("pix_acc"), r4("miou").alias("miou"))


@query(
    "a22_image_accuracy",
    """SELECT frame, sum(CASE WHEN g >= 0 THEN 1 ELSE 0 END)::BIGINT AS labeled, sum(CASE WHEN g >= 0 AND g = pred THEN 1 ELSE 0 END)::BIGINT AS correct,
      r4(sum(CASE WHEN g >= 0 AND g = pred THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN g >= 0 THEN 1 ELSE 0 END), 0)) AS accuracy
    FROM (SELECT frame, gt - 1 AS g, pred FROM fx_pixel_pair) GROUP BY frame""",
)
def _(fx):
    p = fx.pixel_pair.withColumn("gt", F.col("gt") - 1)
    return S.image_accuracy(p, ["frame"]).select("frame", "labeled", "correct", r4("accuracy").alias("accuracy"))


@query(
    "a22_image_areas",
    """WITH p AS (SELECT frame, gt - 1 AS g, CASE WHEN gt - 1 >= 0 THEN pred ELSE 0 END AS pred FROM fx_pixel_pair),
    l AS (SELECT frame, g AS label, CASE WHEN g = pred THEN 1 ELSE 0 END AS i, 1 AS u FROM p UNION ALL SELECT frame, pred, 0, CASE WHEN g = pred THEN 0 ELSE 1 END FROM p)
    SELECT frame, label, sum(i)::BIGINT AS inter, sum(u)::BIGINT AS union_n FROM l WHERE label BETWEEN 1 AND 6 GROUP BY frame, label""",
)
def _(fx):
    return S.image_areas(fx.pixel_pair.withColumn("gt", F.col("gt") - 1), ["frame"], 6)


@query(
    "a23_psnr",
    """WITH r AS (SELECT frame, v, avg((gt_c-est_c)*(gt_c-est_c)) AS mse FROM (SELECT frame, v, gt_c + 0.013 AS gt_c, est_c FROM fx_pixel_pair) GROUP BY frame, v)
    SELECT frame, r4(avg(20.0*log10(1.0/sqrt(mse)))) AS psnr FROM r GROUP BY frame""",
)
def _(fx):
    return S.psnr(fx.pixel_pair, ["frame"], "v", F.col("gt_c") + 0.013, F.col("est_c")).select("frame", r4("psnr").alias("psnr"))


@query(
    "a19_depth_l1",
    """SELECT r4(avg(l1)*100) AS depth_l1_cm, count(*) AS views FROM (SELECT frame, avg(abs(gt_depth-est_depth)) AS l1 FROM fx_pixel_pair GROUP BY frame)""",
)
def _(fx):
    return S.depth_l1(fx.pixel_pair, ["frame"]).select(r4("depth_l1_cm").alias("depth_l1_cm"), "views")


@query(
    "a25_image_losses",
    """SELECT frame, r4(avg((gt_c-est_c)*(gt_c-est_c))) AS color_loss, r4(avg(CASE WHEN gt_depth > 0 THEN (gt_depth-est_depth)*(gt_depth-est_depth) END)) AS depth_loss, r4(avg(abs(gt_c-est_c))) AS feature_loss
    FROM (SELECT frame, gt_c, est_c, est_depth, CASE WHEN gt = 0 THEN 0.0 ELSE gt_depth END AS gt_depth FROM fx_pixel_pair) GROUP BY frame""",
)
def _(fx):
    p = fx.pixel_pair.withColumn("gt_depth", F.when(F.col("gt") == 0, 0.0).otherwise(F.col("gt_depth")))
    return _r4cols(R.image_losses(p, ["frame"]), ["frame"], ["color_loss", "depth_loss", "feature_loss"])


@query(
    "a25_cross_entropy",
    f"""WITH l AS (SELECT frame, raw % 7 - 1 AS label, {LOGIT} AS s FROM fx_pixel)
    SELECT frame, r4(avg(CASE WHEN label >= 0 THEN ln(list_sum([exp(x - list_max(s)) FOR x IN s])) + list_max(s) - s[label + 1] END)) AS ce FROM l GROUP BY frame""",
)
def _(fx):
    ce = R.cross_entropy(_logits(), (F.col("raw") % 7 - 1).cast("int"))
    return fx.pixel.groupBy("frame").agg(r4(F.avg(ce)).alias("ce"))


@query(
    "a30_residual_means",
    """SELECT frame, r4(avg(CASE WHEN gt_depth = 0 THEN 0 ELSE abs(gt_depth-est_depth) END)) AS depth_res, r4(avg(CASE WHEN gt_depth = 0 THEN 0 ELSE abs(gt_c-est_c) END)) AS color_res
    FROM (SELECT frame, gt_c, est_c, est_depth, CASE WHEN gt = 0 THEN 0.0 ELSE gt_depth END AS gt_depth FROM fx_pixel_pair) GROUP BY frame""",
)
def _(fx):
    p = fx.pixel_pair.withColumn("gt_depth", F.when(F.col("gt") == 0, 0.0).otherwise(F.col("gt_depth")))
    m = S.residual_means(p, ["frame"], {"depth_res": ("gt_depth", "est_depth"), "color_res": ("gt_c", "est_c")})
    return _r4cols(m, ["frame"], ["depth_res", "color_res"])


RUN_SQL = """WITH c AS (SELECT v, k AS label, sum(CASE WHEN gt = k AND pred = k THEN 1 ELSE 0 END) AS i, sum(CASE WHEN gt = k OR pred = k THEN 1 ELSE 0 END) AS u FROM fx_pixel_pair, range(7) t(k) GROUP BY v, k),
    r AS (SELECT v, label, sum(i) OVER w AS i, sum(u) OVER w AS u FROM c WINDOW w AS (PARTITION BY label ORDER BY v)),
    a AS (SELECT v, sum(CASE WHEN gt = pred THEN 1 ELSE 0 END) AS ok, count(*) AS n FROM fx_pixel_pair GROUP BY v),
    s AS (SELECT v, sum(ok) OVER (ORDER BY v) / (2.220446049250313e-16 + sum(n) OVER (ORDER BY v)) AS pix_acc FROM a),
    f AS (SELECT r.v, any_value(pix_acc) AS pix_acc, avg(CASE WHEN u > 0 THEN i / (2.220446049250313e-16 + u) END) AS miou FROM r JOIN s ON r.v = s.v GROUP BY r.v)"""


@query("a31_running_score_average", RUN_SQL + " SELECT r4(avg(pix_acc)) AS pix_acc, r4(avg(miou)) AS miou, count(*) AS updates FROM f")
def _(fx):
    counts = S.confusion(fx.pixel_pair, ["v"])
    run = S.running_scores(counts, 7, [], "v")
    return run.agg(r4(F.avg("pix_acc")).alias("pix_acc"), r4(F.avg("miou")).alias("miou"), F.count(F.lit(1)).alias("updates"))


# -- rays --------------------------------------------------------------------------------------


@query(
    "a24_sdf_losses",
    """WITH b AS (SELECT *, z < depth-0.3 AS front, z > depth+0.3 AS back, z > depth-0.4*0.3 AND z < depth+0.4*0.3 AS centre FROM fx_ray_sample)
    SELECT ray_id, r4(avg(CASE WHEN front THEN (sdf-1)*(sdf-1) END)) AS fs_loss, r4(avg(CASE WHEN centre THEN (z+sdf*0.3-depth)*(z+sdf*0.3-depth) END)) AS center_loss,
      r4(avg(CASE WHEN NOT front AND NOT back AND NOT centre THEN (z+sdf*0.3-depth)*(z+sdf*0.3-depth) END)) AS tail_loss FROM b GROUP BY ray_id""",
)
def _(fx):
    return _r4cols(R.sdf_losses(fx.ray_sample, 0.3, ["ray_id"]), ["ray_id"], ["fs_loss", "center_loss", "tail_loss"])


@query(
    "w02_jitter_bounds",
    """SELECT ray_id, k, r4(coalesce(0.5*(z + lag(z) OVER w), z)) AS lower, r4(coalesce(0.5*(z + lead(z) OVER w), z)) AS upper FROM fx_ray_sample WINDOW w AS (PARTITION BY ray_id ORDER BY k)""",
)
def _(fx):
    return _r4cols(R.jitter_bounds(fx.ray_sample), ["ray_id", "k"], ["lower", "upper"])


@query("w02_stratified_jitter")
def _(fx):
    return R.jitter(fx.ray_sample).select("ray_id", "k", "z")


W_SQL = """a AS (SELECT *, 1.0-exp(-10.0/(1.0+exp(10.0*sdf))) AS alpha FROM fx_ray_sample),
    w AS (SELECT *, alpha * exp(coalesce(sum(ln(1.0-alpha+1e-10)) OVER (PARTITION BY ray_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS w FROM a)"""


@query("w03_compositing", f"WITH {W_SQL} SELECT ray_id, r4(sum(w*z)) AS depth, r4(sum(w*r)) AS r, r4(sum(w*g)) AS g, r4(sum(w*b)) AS b FROM w GROUP BY ray_id")
def _(fx):
    return _r4cols(R.composite(fx.ray_sample.drop("depth")), ["ray_id"], ["depth", "r", "g", "b"])


@query(
    "w04_inverse_cdf_sampling",
    """WITH n AS (SELECT ray_id, k, z, lead(z) OVER o AS z_hi, CASE WHEN lead(z) OVER o IS NOT NULL THEN r / 10.0 END AS weight FROM fx_ray_sample WINDOW o AS (PARTITION BY ray_id ORDER BY k)),
    c AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY ray_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo FROM n),
    d AS (SELECT *, lead(lo) OVER (PARTITION BY ray_id ORDER BY k) AS hi FROM c), u AS (SELECT j, j / 15.0 AS u FROM range(16) t(j)),
    h AS (SELECT d.*, j, u, row_number() OVER (PARTITION BY ray_id, j ORDER BY k DESC) AS rn FROM d JOIN u ON u.u >= d.lo)
    SELECT ray_id, j, r4(CASE WHEN z_hi IS NULL THEN z ELSE z + (u-lo) / (CASE WHEN hi-lo < 1e-5 THEN 1.0 ELSE hi-lo END) * (z_hi-z) END) AS sample FROM h WHERE rn = 1""",
)
def _(fx):
    from ..operators.ordered import lag_by_index

    s = lag_by_index(fx.ray_sample, ["ray_id"], "k", {"_n": ("z", -1)})
    bins = s.select("ray_id", "k", "z", F.when(F.col("_n").isNotNull(), F.col("r") / 10.0).alias("weight"))
    return R.sample_pdf(bins, 16).select("ray_id", "j", r4("sample").alias("sample"))


@query("j10_random_cdf_sampling")
def _(fx):
    s = fx.ray_sample.select("ray_id", "k", "z", (F.col("r") / 10.0).alias("weight"))
    return R.sample_pdf(s, 16, deterministic=False)


@query(
    "j10_cdf_bins",
    """SELECT ray_id, k, r4(lo) AS cdf_lo, r4(lo + w) AS cdf_hi FROM (SELECT ray_id, k, r / 10.0 AS w, coalesce(sum(r / 10.0) OVER (PARTITION BY ray_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo,
      lead(z) OVER (PARTITION BY ray_id ORDER BY k) AS z_hi FROM fx_ray_sample) WHERE z_hi IS NOT NULL""",
)
def _(fx):
    s = fx.ray_sample.select("ray_id", "k", "z", (F.col("r") / 10.0).alias("weight"))
    return R.cdf_bins(s).filter(F.col("z_hi").isNotNull()).select("ray_id", "k", r4("cdf_lo").alias("cdf_lo"), r4("cdf_hi").alias("cdf_hi"))


@query(
    "w08_depth_samples",
    """WITH r AS (SELECT event_id AS ray_id, depth FROM fx_pixel WHERE depth > 0), z AS (SELECT ray_id, 1.2*depth*(i/31.0) AS z FROM r, range(32) t(i) UNION ALL SELECT ray_id, (depth-0.09)+((depth+0.09)-(depth-0.09))*(i/7.0) FROM r, range(8) t(i))
    SELECT ray_id, row_number() OVER (PARTITION BY ray_id ORDER BY z) - 1 AS k, r4(z) AS z FROM z""",
)
def _(fx):
    rays = fx.pixel.select(F.col("event_id").alias("ray_id"), "depth")
    return R.depth_samples(rays).select("ray_id", "k", r4("z").alias("z"))


@query(
    "w08_overlap_samples",
    """SELECT event_id AS ray_id, i AS k, r4(depth*0.8*(1-i/7.0)+(depth+0.5)*(i/7.0)) AS z FROM fx_pixel, range(8) t(i) WHERE depth > 0""",
)
def _(fx):
    rays = fx.pixel.select(F.col("event_id").alias("ray_id"), "depth")
    return R.overlap_samples(rays).select("ray_id", "k", r4("z").alias("z"))


BLIND_SQL = f"""p AS (SELECT frame * 1000000000 + event_id AS ray_id, tx AS ox, ty AS oy, tz AS oz, {', '.join(f'{RAY[a]} + 0.0137 AS d{a}' for a in XYZ)} FROM fx_view_pixel WHERE depth <= 0),
    f AS (SELECT *, least(greatest((-1.0-ox)/dx, (6.0-ox)/dx), greatest((-1.0-oy)/dy, (5.0-oy)/dy), greatest((-1.0-oz)/dz, (4.0-oz)/dz)) + 0.01 AS far FROM p)"""


def _blind_rays(fx):
    p = fx.view_pixel
    d = g.pixel_ray(F.col("u").cast("double"), F.col("v").cast("double"), CAMERA, g.mat("r"))
    return p.select(
        (F.col("frame") * 1_000_000_000 + F.col("event_id")).alias("ray_id"), "depth", *[F.col("t" + a).alias("o" + a) for a in XYZ], *[(c + 0.0137).alias("d" + a) for a, c in zip(XYZ, d)]
    )


@query("w08_unmeasured_rays", f"WITH {BLIND_SQL} SELECT ray_id, i AS k, r4(far*(i/15.0)) AS z FROM f, range(16) t(i)")
def _(fx):
    return R.unmeasured_samples(_blind_rays(fx), (-1, -1, -1), (6, 5, 4), 16).select("ray_id", "k", r4("z").alias("z"))


def _soft_ball(samples):
    """Signed distance, scaled by a tenth, from a ball in the middle of the room."""
    d = g.sub(g.vec("px", "py", "pz"), [F.lit(2.5), F.lit(2.0), F.lit(1.5)])
    return samples.withColumn("sdf", (g.norm(d) - 1.0) * 0.1)


@query(
    "w08_chained_samples",
    f"""WITH {BLIND_SQL}, c AS (SELECT *, far*(i/15.0) AS z, i AS k FROM f, range(16) t(i)),
    s AS (SELECT ray_id, k, z, (sqrt((ox+dx*z-2.5)*(ox+dx*z-2.5)+(oy+dy*z-2.0)*(oy+dy*z-2.0)+(oz+dz*z-1.5)*(oz+dz*z-1.5)) - 1.0) * 0.1 AS sdf FROM c),
    a AS (SELECT *, 1.0-exp(-10.0/(1.0+exp(10.0*sdf))) AS alpha FROM s),
    w AS (SELECT *, alpha * exp(coalesce(sum(ln(1.0-alpha+1e-10)) OVER (PARTITION BY ray_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS w FROM a),
    mid AS (SELECT ray_id, k, 0.5 * (z + lead(z) OVER o) AS z, 0.5 * (lead(z) OVER o + lead(z, 2) OVER o) AS z_hi, CASE WHEN k < 14 THEN lead(w) OVER o END AS weight FROM w WINDOW o AS (PARTITION BY ray_id ORDER BY k)),
    cum AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY ray_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo FROM mid WHERE z IS NOT NULL),
    d AS (SELECT *, lead(lo) OVER (PARTITION BY ray_id ORDER BY k) AS hi FROM cum),
    h AS (SELECT d.*, u, row_number() OVER (PARTITION BY ray_id, j ORDER BY k DESC) AS rn FROM d JOIN (SELECT j, j / 7.0 AS u FROM range(8) t(j)) ON u >= lo),
    fine AS (SELECT ray_id, CASE WHEN z_hi IS NULL THEN z ELSE z + (u-lo) / (CASE WHEN hi-lo < 1e-5 THEN 1.0 ELSE hi-lo END) * (z_hi-z) END AS z FROM h WHERE rn = 1),
    every AS (SELECT ray_id, z, 0 AS fine FROM s UNION ALL SELECT ray_id, z, 1 FROM fine),
    n AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY z, fine) - 1 AS k FROM every)
    SELECT ray_id, count(*) AS n, sum(fine)::BIGINT AS n_fine, r4(max(z)) AS far, r4(sum(z * k)) AS by_place, r4(sum(CASE WHEN fine = 1 THEN z END)) AS fine_sum FROM n GROUP BY ray_id""",
)
def _(fx):
    s = R.chained_samples(_blind_rays(fx), (-1, -1, -1), (6, 5, 4), _soft_ball, 16, 8)
    fine = F.when(F.col("fine"), F.col("z"))
    return s.groupBy("ray_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(fine).alias("n_fine"), r4(F.max("z")).alias("far"), r4(F.sum(F.col("z") * F.col("k"))).alias("by_place"), r4(F.sum(fine)).alias("fine_sum")
    )


@query("t03_pixel_sampling")
def _(fx):
    return sampling.sample_pixels(fx.pixel, 20, ["frame"], 0, 12, 0, 8).select("frame", "draw", "v", "u", "depth", "raw")


@query(
    "t03_draw_counts",
    """SELECT frame, 20::BIGINT AS draws, 20::BIGINT AS inside FROM (SELECT DISTINCT frame FROM fx_pixel)""",
)
def _(fx):
    drawn = sampling.sample_pixels(fx.pixel, 20, ["frame"], 0, 12, 0, 8)
    inside = F.col("v").between(0, 11) & F.col("u").between(0, 7)
    return drawn.groupBy("frame").agg(F.count(F.lit(1)).alias("draws"), F.count(F.when(inside, 1)).alias("inside"))


@query("t05_random_k")
def _(fx):
    return sampling.random_k(fx.pose.select("seq_id", "frame_idx"), 100, ["seq_id", "frame_idx"])


@query("t06_train_validation_split")
def _(fx):
    return sampling.train_validation_split(fx.pose.select("seq_id", "frame_idx"), 0.1, ["seq_id", "frame_idx"])


@query(
    "t01_best_candidate",
    """SELECT method, candidate, r4(score) AS score FROM (SELECT s_suppkey % 7 AS method, s_suppkey AS candidate, (s_suppkey % 5)::DOUBLE / 5.0 AS score,
      row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey % 5 DESC, s_suppkey) AS rn FROM supplier) WHERE rn = 1""",
)
def _(fx):
    s = fx.table("supplier").select((F.col("s_suppkey") % 7).alias("method"), F.col("s_suppkey").alias("candidate"), ((F.col("s_suppkey") % 5).cast("double") / 5.0).alias("score"))
    return sampling.best_candidate(s, ["method"], "score", "candidate", []).select("method", "candidate", r4("score").alias("score"))


SUMMARY_SQL = """SELECT method, count(*) AS trials, round(avg(CASE WHEN rot_deg < 5 AND trans < 0.1 AND scale_ratio < 0.05 THEN 1.0 ELSE 0.0 END), 3) AS success_rate, round(median(rot_deg), 3) AS med_rot_deg,
      round(median(trans), 4) AS med_trans, round(median(scale_ratio), 4) AS med_scale_ratio, avg(chamfer) AS chamfer FROM fx_trials GROUP BY method"""


@query("a29_benchmark_summary", f"SELECT method, trials, success_rate, med_rot_deg, med_trans, med_scale_ratio FROM ({SUMMARY_SQL})")
def _(fx):
    return sampling.benchmark_summary(fx.trials)


@query(
    "t02_method_ranking",
    f"SELECT method, success_rate, row_number() OVER (ORDER BY success_rate DESC, chamfer, method) AS place, row_number() OVER (ORDER BY success_rate DESC, chamfer, method) = 1 AS adopted FROM ({SUMMARY_SQL})",
)
def _(fx):
    s = sampling.benchmark_summary(fx.trials).join(fx.trials.groupBy("method").agg(F.avg("chamfer").alias("chamfer")), "method")
    return sampling.rank_methods(s).select("method", "success_rate", "place", "adopted")
