"""Queries over compound plans, text sources, sinks and streams."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F

from ..fixtures import r4, seconds
from ..functions import geometry as g
from ..functions import linalg, rand
from ..operators import mesh as M
from ..operators import neighbors as nn
from ..operators import segmentation as S
from ..operators import trajectory as T
from ..plans import evaluation as E
from ..plans import geometric
from ..plans import registration as R
from ..session import shared_dir, write_folders
from ..sources import poses as P
from ..sources import sinks, tables
from ..streaming import frames as ST
from .frames import CLASS_SQL, _trajectory_pairs
from .registry import query

CFG = R.Config(voxel_size=0.2, normal_radius=0.8, normal_max_nn=30, ransac_iters=100, ransac_thresh_deg=20.0, yaw_bins=36, max_iter=4, max_corr_dist=0.8, tukey_c=0.8, feature_radius=1.0, feature_max_nn=30, hypothesis_dist=0.4, hypotheses=200, icp_dist=0.8, icp_iters=4)


def _scratch(fx, name: str) -> str:
    return os.path.join(shared_dir(fx.spark), f"{name}-{uuid.uuid4().hex}")


def _sides(fx):
    c = fx.cloud.select(F.lit("scene").alias("scene_id"), "point_id", F.col("label").cast("int").alias("label"), "x", "y", "z", "nx", "ny", "nz", "side")
    src = c.filter("side = 0").drop("side").withColumn("trial_id", F.lit(0).cast("long"))
    return src, c.filter("side = 1").drop("side")


def _identity(src):
    eye = [F.lit(1.0 if i == j else 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    return src.select(*R.SRC).distinct().select(*R.SRC, F.lit(0).alias("candidate"), *eye, *[F.lit(0.0).alias(f"t{i}") for i in range(3)])


# -- text sources and sinks --------------------------------------------------------------------

POSE_OUT = "SELECT seq_id, frame_idx, r4(r00) AS r00, r4(r01) AS r01, r4(r11) AS r11, r4(tx) AS tx, r4(ty) AS ty, r4(tz) AS tz FROM fx_pose"


def _pose_out(df):
    return df.select("seq_id", "frame_idx", *[r4(c).alias(c) for c in ("r00", "r01", "r11", "tx", "ty", "tz")])


@query("s01_pose_lines", POSE_OUT)
def _(fx):
    path = _scratch(fx, "pose_lines")
    P.write_pose_lines(fx.pose, path)
    back = P.read_pose_lines(fx.spark, path)
    # One folder per sequence: its number comes from the partition folder of the file.
    return _pose_out(back)


@query("s02_pose_directory", "SELECT frame AS frame_idx, r4(r00) AS r00, r4(r02) AS r02, r4(r21) AS r21, r4(tx) AS tx, r4(ty) AS ty FROM fx_current")
def _(fx):
    path = _scratch(fx, "pose_dir")
    r = g.flip_camera(g.mat("r"))
    rows = [F.concat_ws(" ", *[c.cast("string") for c in [*r[i], F.col(t)]]) for i, t in enumerate(("tx", "ty", "tz"))]
    text = fx.current.select(F.format_string("%06d", F.col("frame")).alias("f"), F.concat_ws("\n", *rows, F.lit("0 0 0 1")).alias("value"))
    write_folders(text, path, ["f"])
    files = fx.spark.read.text(path, wholetext=True).select(F.col("f").cast("int").alias("frame_idx"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").cast("array<double>").alias("_v"))
    return files.select("frame_idx", *P._pose_columns(F.col("_v"))).select("frame_idx", *[r4(c).alias(c) for c in ("r00", "r02", "r21", "tx", "ty")])


@query("s03_stamped_list", "SELECT kind, id, r4(ts) AS ts FROM fx_stamps")
def _(fx):
    path = _scratch(fx, "stamps")
    lines = fx.stamps.select(F.format_string("%.6f %s/%d.png", F.col("ts"), F.col("kind"), F.col("id")).alias("value"))
    lines.unionByName(fx.spark.range(1).select(F.lit("# stamp path").alias("value"))).write.text(path)
    back = P.read_stamped(fx.spark, path, P.STAMP_PATH)
    return back.select(F.split("path", "/")[0].alias("kind"), F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("id"), r4("stamp").alias("ts"))


@query("s10_frozen_transform", "SELECT run_id::VARCHAR AS scene_id, r4(m00) AS m00, r4(m10) AS m10, r4(t0) AS t0 FROM fx_sim3")
def _(fx):
    path = _scratch(fx, "transform")
    empty = sinks.load_transform(fx.spark, path)
    sinks.save_transform(fx.sim3.withColumnRenamed("run_id", "scene_id"), path)
    return empty.unionByName(sinks.load_transform(fx.spark, path)).select("scene_id", r4("m00").alias("m00"), r4("m10").alias("m10"), r4("t0").alias("t0"))


@query("s12_cloud_adapter", "SELECT point_id, CASE label WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 0 END::BIGINT AS label, r4(x) AS x, r4(y) AS y FROM fx_keyed_cloud")
def _(fx):
    path = _scratch(fx, "elements")
    fx.keyed_cloud.write.parquet(path)
    return tables.load_cloud(fx.spark, "elements", path=path).select("point_id", "label", r4("x").alias("x"), r4("y").alias("y"))


# -- evaluation --------------------------------------------------------------------------------


@query("c07_trajectory_evaluation")
def _(fx):
    return E.trajectory_evaluation(fx.pose, fx.pose_est)


#: Stamps of one sequence that stand alone: a frame and its twin 0.2 s later must not meet another frame's.
ALONE_SQL = """WITH p AS (SELECT seq_id, ts, any_value(tx) AS tx, any_value(ty) AS ty, any_value(tz) AS tz, count(*) AS n FROM fx_pose GROUP BY seq_id, ts),
    o AS (SELECT *, lag(ts) OVER w AS prev, lead(ts) OVER w AS next FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY ts)),
    q AS (SELECT * FROM o WHERE n = 1 AND coalesce(ts - prev, 9) > 1 AND coalesce(next - ts, 9) > 1)"""


def _timed_tracks(fx):
    """Each frame twice, the second time 0.2 s later; the estimate is turned, half as large, 0.5 s late, and 1 to 5 cm (by sequence) off
    upwards at the first time and downwards at the second, which leaves the best alignment as it is."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq_id").orderBy("ts")
    p = fx.pose.groupBy("seq_id", "ts").agg(F.count(F.lit(1)).alias("n"), *[F.min("t" + a).alias("t" + a) for a in nn.XYZ])
    p = p.withColumns({"prev": F.lag("ts").over(w), "next": F.lead("ts").over(w)}).filter("n = 1 AND coalesce(ts - prev, 9) > 1 AND coalesce(next - ts, 9) > 1")
    both = p.withColumn("twin", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ts", F.col("ts") + F.col("twin") * 0.2)
    off = (F.col("seq_id") % 5 + 1) * 0.01 * (1 - 2 * F.col("twin"))
    est = _turned(both.select("seq_id", F.col("tx").alias("x"), F.col("ty").alias("y"), (F.col("tz") + off).alias("z"), (F.col("ts") - 0.497).alias("ts")))
    return both.select("seq_id", "ts", "tx", "ty", "tz"), est.select("seq_id", "ts", *[(F.col(a) / 2.0).alias("t" + a) for a in nn.XYZ])


@query(
    "c07_timed_evaluation",
    ALONE_SQL + """ SELECT seq_id, 2 * count(*) AS pairs, seq_id % 5 + 1.0::DOUBLE AS rmse, seq_id % 5 + 1.0::DOUBLE AS mean, 0.0::DOUBLE AS std,
    seq_id % 5 + 1.0::DOUBLE AS min, seq_id % 5 + 1.0::DOUBLE AS max, seq_id % 5 + 1.0::DOUBLE AS median FROM q GROUP BY seq_id""",
)
def _(fx):
    stats, _pairs, _aligned = E.timed_trajectory_evaluation(*_timed_tracks(fx), offset=0.5, scale=2.0)
    return stats.select("seq_id", "pairs", *[r4(c).alias(c) for c in ("rmse", "mean", "std", "min", "max", "median")])


@query(
    "c07_association_lines",
    ALONE_SQL + """ SELECT seq_id, round(ts + 0.2 * k, 6) AS a, round(ts + 0.2 * k - 0.497, 6) AS b, r4(tx) AS ax, r4(ty) AS ay, r4(tz) AS az FROM q, (VALUES (0), (1)) AS v(k)""",
)
def _(fx):
    _stats, pairs, _aligned = E.timed_trajectory_evaluation(*_timed_tracks(fx), offset=0.5, scale=2.0)
    path = _scratch(fx, "associations")
    sinks.write_associations(pairs, path)
    v = F.split("value", " ").cast("array<double>")
    lines = fx.spark.read.text(path).select(F.col("seq_id").cast("long").alias("seq_id"), v.alias("v"))
    return lines.select("seq_id", F.col("v")[0].alias("a"), F.col("v")[4].alias("b"), *[r4(F.col("v")[i]).alias(c) for i, c in ((1, "ax"), (2, "ay"), (3, "az"))])


ERR = "degrees(acos(least(greatest(((a.m00*b.m00+a.m01*b.m01+a.m10*b.m10+a.m11*b.m11+a.m22*b.m22)/(a.s*b.s)-1.0)/2.0,-1.0),1.0)))"


@query(
    "c09_deviation_table",
    f"""WITH s AS (SELECT *, cbrt(greatest(m22*(m00*m11-m01*m10), 1e-18)) AS s FROM fx_trace), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY trace_id, iter ORDER BY run_id DESC) = 1),
    f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY iter DESC) = 1)
    SELECT a.trace_id, a.iter, round({ERR}, 2) AS rot_deg, r4(sqrt((a.t0-b.t0)**2+(a.t1-b.t1)**2+(a.t2-b.t2)**2)) AS trans, r4(abs(a.s/b.s-1.0)) AS scale_ratio
    FROM l a JOIN f b ON a.trace_id = b.trace_id WHERE a.iter <> b.iter""",
)
def _(fx):
    t = T.last_write_per_iteration(fx.trace, ["trace_id"], "run_id", 1, R.SIM3)
    ref = t.groupBy("trace_id").agg(F.max_by(F.struct("iter", *R.SIM3), F.col("iter")).alias("b")).select("trace_id", F.col("b.iter").alias("last"), *[f"b.{c}" for c in R.SIM3])
    d = R.deviation_table(t.join(ref.select("trace_id", "last"), "trace_id"), ref.drop("last"), ["trace_id"])
    return d.filter("iter <> last").select("trace_id", "iter", F.round("rot_deg", 2).alias("rot_deg"), r4("trans").alias("trans"), r4("scale_ratio").alias("scale_ratio"))


# -- registration ------------------------------------------------------------------------------

ICP1_SQL = """WITH s AS (SELECT * FROM fx_cloud WHERE side = 0 AND label IN (1,2,3,4,5)), d AS (SELECT * FROM fx_cloud WHERE side = 1),
    c AS (SELECT s.x AS sx, s.y AS sy, s.z AS sz, d.x AS dx, d.y AS dy, d.z AS dz, sqrt((s.x-d.x)**2+(s.y-d.y)**2+(s.z-d.z)**2) AS dist,
      row_number() OVER (PARTITION BY s.point_id ORDER BY sqrt((s.x-d.x)**2+(s.y-d.y)**2+(s.z-d.z)**2), d.point_id) AS rn FROM s JOIN d ON s.label = d.label),
    p AS (SELECT *, (1-(dist/0.8)**2)**2 AS w FROM c WHERE rn = 1 AND dist < 0.8),
    m AS (SELECT sum(w)+1e-12 AS sw, sum(w*sx)/(sum(w)+1e-12) AS ax, sum(w*sy)/(sum(w)+1e-12) AS ay, sum(w*sz)/(sum(w)+1e-12) AS az, sum(w*dx)/(sum(w)+1e-12) AS bx, sum(w*dy)/(sum(w)+1e-12) AS b_y, sum(w*dz)/(sum(w)+1e-12) AS bz FROM p),
    f AS (SELECT sum(w/sw*((sx-ax)*(dx-bx)+(sy-ay)*(dy-b_y)+(sz-az)*(dz-bz)))/(sum(w/sw*((sx-ax)**2+(sy-ay)**2+(sz-az)**2))+1e-12) AS s, any_value(ax) AS ax, any_value(ay) AS ay, any_value(az) AS az, any_value(bx) AS bx, any_value(b_y) AS b_y, any_value(bz) AS bz FROM p, m)"""


@query("c01_one_alignment_step", ICP1_SQL + " SELECT r4(s) AS m00, r4(bx-s*ax) AS t0, r4(b_y-s*ay) AS t1, r4(bz-s*az) AS t2 FROM f")
def _(fx):
    src, dst = _sides(fx)
    cfg = R.Config(max_iter=1, max_corr_dist=0.8, tukey_c=0.8)
    return R.align(src, dst, _identity(src), cfg, rotation_fixed=True).select(*[r4(c).alias(c) for c in ("m00", "t0", "t1", "t2")])


@query("c01_iterative_alignment")
def _(fx):
    src, dst = _sides(fx)
    return R.align(src, dst, _identity(src), CFG).select("scene_id", "trial_id", "iter", *R.SIM3)


@query("c02_physical_registration")
def _(fx):
    return R.get_method("proposed")(*_sides(fx), CFG)


def _turned(df, names=nn.XYZ):
    """Turned by 30 degrees about the vertical and shifted by (1, 2, 0.5)."""
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    x, y, z = (F.col(a) for a in nn.XYZ)
    return df.withColumns(dict(zip(names, (x * c - y * s + 1.0, x * s + y * c + 2.0, z + 0.5))))


TURNED_SQL = "r4(sqrt(3) / 2) AS m00, -0.5::DOUBLE AS m01, 0.0::DOUBLE AS m02, 1.0::DOUBLE AS m22, 1.0::DOUBLE AS t0, 2.0::DOUBLE AS t1, 0.5::DOUBLE AS t2"
TURNED = ("m00", "m01", "m02", "m22", "t0", "t1", "t2")


@query("c03_geometry_registration", f"SELECT 'scene' AS scene_id, {TURNED_SQL}")
def _(fx):
    """A cloud against its turned self, with the default number of hypotheses. Voxels are so small that they move with the cloud; their
    normals are upright, which a turn about the vertical keeps."""
    src, _dst = _sides(fx)
    cfg = R.Config(voxel_size=0.001, feature_radius=0.5)
    return R.get_method("baseline")(src, _turned(src.drop("trial_id")), cfg).select("scene_id", *[r4(c).alias(c) for c in TURNED])


@query(
    "c03_hypothesis_rounds",
    f"""SELECT 'scene' AS scene_id, k::BIGINT AS trial_id, count(*) FILTER (point_id % k = 0) AS hits, true AS confident, {TURNED_SQL}
    FROM fx_cloud, (VALUES (1), (2), (4)) AS v(k) WHERE side = 0 GROUP BY k""",
)
def _(fx):
    """Matches of three runs, of which all, a half and a quarter are true."""
    src, _dst = _sides(fx)
    every = src.drop("trial_id").withColumn("trial_id", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 4)])))
    moved = _turned(every.withColumns({f"s{a}": F.col(a) for a in nn.XYZ}))
    true = F.col("point_id") % F.col("trial_id") == 0
    ends = [F.when(true, F.col(a)).otherwise(rand.uniform("point_id", "trial_id", seed=i) * 10.0).alias(f"d{a}") for i, a in enumerate(nn.XYZ)]
    matches = moved.select(*R.SRC, F.col("point_id").alias("src_id"), F.col("point_id").alias("dst_id"), "sx", "sy", "sz", *ends)
    found = geometric.search_hypotheses(matches, R.Config(hypothesis_dist=0.02))
    confident = (F.col("drawn") >= F.col("needed")) & (F.col("needed") < R.Config.hypotheses)
    return found.select(*R.SRC, "hits", confident.alias("confident"), *[r4(c).alias(c) for c in TURNED])


@query("c04_point_to_point")
def _(fx):
    src, dst = _sides(fx)
    return R.point_to_point(src, dst, gate=0.8, iters=4)


def _sheet(fx, x: float = 0.0, z: float = 0.0):
    """Parts as the nodes of a flat lattice 50 wide with unit cells of two triangles, moved by x and z: vertices and gathered faces."""
    n = fx.table("part").count()
    k = F.col("p_partkey") - 1
    i, j = (k % 50).cast("double"), F.floor(k / 50).cast("double")
    nodes = fx.table("part").select(F.lit("scene").alias("scene_id"), k.cast("long").alias("vid"), (i + x).alias("x"), j.alias("y"), F.lit(z).alias("z"))
    cells = nodes.filter((F.col("vid") % 50 < 49) & (F.col("vid") + 51 < n))
    rows = []
    for half, corners in enumerate((((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))):
        at = [e.alias(f"p{m}{c}") for m, (u, v) in enumerate(corners) for c, e in zip(nn.XYZ, (F.col("x") + u, F.col("y") + v, F.col("z")))]
        rows.append(cells.select("scene_id", (F.col("vid") * 2 + half).alias("fid"), *at))
    return nodes, rows[0].unionByName(rows[1])


@query("c06_reconstruction_evaluation", "SELECT 'scene' AS scene_id, 450000::BIGINT AS n_points, true AS accuracy_near, true AS completion_near, true AS ratio_near")
def _(fx):
    """A sheet against itself, moved by a few centimetres. Once aligned, n even draws on an area A lie sqrt(A / n) / 2 from their nearest
    in the mean, and closer than r with a chance of 1 - exp(-pi r^2 n / A)."""
    n = 450_000
    v, faces = _sheet(fx)
    scores = E.reconstruction_evaluation(_sheet(fx, 0.05, 0.03)[1], faces, _sheet(fx, 0.05, 0.03)[0], v, n_points=n, gate=0.2)
    area = M.face_geometry(faces).groupBy("scene_id").agg(F.sum("area").alias("area"))
    mean = F.sqrt(F.col("area") / n) * 50.0
    ratio = (1.0 - F.exp(-math.pi * 0.05**2 * n / F.col("area"))) * 100.0
    near = lambda c: F.col(c).between(mean * 0.98, mean * 1.03)
    return scores.join(area, "scene_id").select(
        "scene_id", F.lit(n).cast("long").alias("n_points"), near("accuracy_cm").alias("accuracy_near"), near("completion_cm").alias("completion_near"), (F.abs(F.col("completion_ratio_pct") - ratio) < 1.0).alias("ratio_near")
    )


@query("c08_robustness_benchmark")
def _(fx):
    from ..operators.sampling import benchmark_summary

    trials = fx.table("nation").select((F.col("n_nationkey") + 1).cast("long").alias("trial_id"))
    return benchmark_summary(R.robustness(*_sides(fx), "proposed", trials, CFG))


@query("c12_reference_transform")
def _(fx):
    src, dst = _sides(fx)
    transform, quality = E.freeze_reference(src, dst, CFG)
    path = _scratch(fx, "frozen")
    sinks.save_transform(transform, path)
    return sinks.load_transform(fx.spark, path).join(quality.drop("trial_id"), "scene_id")


@query(
    "v01_method_registry",
    """SELECT name AS method, r4(avg(x) FILTER (side = 1) - avg(x) FILTER (side = 0)) AS t0, r4(avg(z) FILTER (side = 1) - avg(z) FILTER (side = 0)) AS t2
    FROM fx_cloud, (VALUES ('baseline'), ('centroid'), ('proposed')) m(name) GROUP BY name""",
)
def _(fx):
    @R.register_method("centroid")
    def centroid(src, dst, cfg):
        mean = lambda df, keys, p: df.groupBy(*keys).agg(*[F.avg(a).alias(p + a) for a in nn.XYZ])
        j = mean(src, R.SRC, "s").join(mean(dst, R.DST, "d"), R.DST)
        eye = [F.lit(1.0 if i == k else 0.0).alias(f"m{i}{k}") for i in range(3) for k in range(3)]
        return j.select(*R.SRC, *eye, *[(F.col("d" + a) - F.col("s" + a)).alias(f"t{i}") for i, a in enumerate(nn.XYZ)])

    names = fx.spark.createDataFrame([(n,) for n in R.available_methods()], "method string")
    t = R.get_method("centroid")(*_sides(fx), CFG).withColumn("k", F.lit(0))
    return names.withColumn("k", F.lit(0)).join(t, "k").select("method", r4("t0").alias("t0"), r4("t2").alias("t2"))


@query(
    "v02_batched_rotation_solve",
    """WITH p AS (SELECT a.seq_id, a.tx AS dx, a.ty AS dy, e.tx AS sx, e.ty AS sy FROM fx_pose a JOIN fx_pose_est e ON a.seq_id = e.seq_id AND a.frame_idx = e.frame_idx),
    c AS (SELECT seq_id, covar_pop(dx, sx) + covar_pop(dy, sy) AS c, covar_pop(dy, sx) - covar_pop(dx, sy) AS s FROM p GROUP BY seq_id)
    SELECT seq_id, r4(c / sqrt(c*c + s*s)) AS r00, r4(s / sqrt(c*c + s*s)) AS r10 FROM c""",
)
def _(fx):
    from ..operators.fit import weighted_moments

    m = weighted_moments(_trajectory_pairs(fx), ["seq_id"])
    # The z row of a level trajectory is degenerate; one unit there fixes the vertical axis.
    cov = F.array(*[F.lit(1.0) if a == b == "z" else F.col(f"c{a}{b}") for a in nn.XYZ for b in nn.XYZ])
    return m.withColumn("r", linalg.best_rotation(cov)).select("seq_id", r4(F.col("r")[0]).alias("r00"), r4(F.col("r")[3]).alias("r10"))


# -- streams -----------------------------------------------------------------------------------


def _stream(fx, name: str):
    schema = fx.table(name).schema
    return fx.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(fx.dir)


def _seconds_stream(fx):
    return _stream(fx, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("sec"))


@query("x01_streaming_scores", f"WITH {CLASS_SQL} SELECT label, gt_n, pred_n, inter, r4(iou) AS iou FROM s")
def _(fx):
    gt = F.col("l_linenumber").cast("long") - 1
    pairs = _stream(fx, "lineitem").select(F.lit(0).alias("seq_id"), gt.alias("gt"), ((gt + F.when(F.col("l_discount") > 0.05, 1).otherwise(0)) % 7).alias("pred"))
    final = ST.latest_update(ST.drain(ST.running_confusion(pairs), "update", "confusion"), ["seq_id", "gt", "pred"])
    return S.class_scores(final, 7).select("label", "gt_n", "pred_n", "inter", r4("iou").alias("iou"))


@query(
    "x02_streaming_association",
    """SELECT image_id, other_id, r4(dt) AS dt FROM (SELECT i.id AS image_id, s.id AS other_id, abs(i.ts - s.ts) AS dt, row_number() OVER (PARTITION BY i.id ORDER BY abs(i.ts - s.ts), s.ts) AS rn
      FROM fx_stamps i JOIN fx_stamps s ON i.kind = 'image' AND s.kind = 'depth' AND abs(i.ts - s.ts) < 300) WHERE rn = 1""",
)
def _(fx):
    e = _seconds_stream(fx).select(F.col("event_id").alias("id"), F.timestamp_micros((F.col("sec") * 1e6 + 0.5).cast("long")).alias("ts"), "event_type")
    c = ST.candidate_associations(e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'click'").drop("event_type"), 300.0)
    return ST.nearest_association(ST.drain(c, "append", "association")).select("image_id", "other_id", r4("dt").alias("dt"))


def _timed_stream(fx, rows, name: str, rest: int, slices: int = 4, **closing):
    """``rows`` with ``ts`` as a stream of several micro-batches, slice of time after slice, and the delay that covers a slice's disorder.
    A last row ``rest`` seconds later, of sequence -1, tells the watermark that the stream is over."""
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    path, step = _scratch(fx, name), (hi - lo) // slices + 1
    for k in range(slices):
        start = lo + k * step
        rows.filter(F.unix_micros("ts").between(start, start + step - 1)).write.mode("append").parquet(path)
    end = F.timestamp_micros(F.lit(hi + step * 2 + rest * 1_000_000))
    values = {"seq_id": F.lit(-1), "ts": end} | {c: F.lit(v) for c, v in closing.items()}
    one = fx.spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    one.write.mode("append").parquet(path)
    files = max(len(fx.table("events").inputFiles()), 1)
    stream = fx.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream, f"{step // 1_000_000 + 1} seconds"


def _timed_events(fx):
    e = fx.table("events")
    return e.select((F.col("user_id")).alias("seq_id"), "event_id", "event_type", "value", F.timestamp_micros((seconds(F.col("ts")) * 1e6 + 0.5).cast("long")).alias("ts"))


@query(
    "x02_stream_frames",
    """WITH s AS (SELECT user_id % 7 AS seq_id, event_type, event_id AS id, epoch_us(ts) AS us FROM events),
    n AS (SELECT i.seq_id, i.id AS image_id, o.event_type AS kind, o.id AS oid, abs(i.us - o.us) AS dt, row_number() OVER (PARTITION BY i.id, o.event_type ORDER BY abs(i.us - o.us), o.us, o.id) AS rn
      FROM s i JOIN s o ON i.seq_id = o.seq_id AND i.event_type = 'view' AND o.event_type IN ('click', 'purchase') AND abs(i.us - o.us) < 7200000000)
    SELECT d.seq_id, d.image_id, d.oid AS depth_id, r4(d.dt / 1e6) AS depth_dt, p.oid AS pose_id, r4(p.dt / 1e6) AS pose_dt FROM n d JOIN n p ON d.image_id = p.image_id AND d.rn = 1 AND p.rn = 1
      AND d.kind = 'click' AND p.kind = 'purchase'""",
)
def _(fx):
    t = F.col("event_type")
    kind = F.when(t == "view", "image").when(t == "click", "depth").when(t == "purchase", "pose").otherwise("other")
    e = _timed_events(fx).select((F.col("seq_id") % 7).alias("seq_id"), kind.alias("kind"), F.col("event_id").alias("id"), "ts")
    s, delay = _timed_stream(fx, e, "stamps", 30 * 86400, kind="depth", id=-1)
    out = ST.drain(ST.associate_stream(s, "2 hours", delay=delay), "append", "frames")
    return out.select("seq_id", "image_id", "depth_id", r4("depth_dt").alias("depth_dt"), "pose_id", r4("pose_dt").alias("pose_dt"))


@query(
    "x03_streaming_thinning",
    """WITH RECURSIVE k AS (SELECT seq_id, frame_idx, ts, ts AS last FROM fx_pose WHERE frame_idx = 0 UNION ALL
      SELECT p.seq_id, p.frame_idx, p.ts, CASE WHEN p.ts - k.last > 50000 THEN p.ts ELSE k.last END FROM k JOIN fx_pose p ON p.seq_id = k.seq_id AND p.frame_idx = k.frame_idx + 1)
    SELECT seq_id, r4(ts) AS ts FROM k WHERE ts = last""",
)
def _(fx):
    s, delay = _timed_stream(fx, _timed_events(fx).select("seq_id", "ts"), "thin", 86400)
    out = ST.drain(ST.thin_stream(s, "50000 seconds", delay=delay), "append", "thin").filter("seq_id >= 0")
    return out.select("seq_id", r4(F.unix_micros("ts") / 1e6).alias("ts"))


def _tracked(fx):
    return _timed_events(fx).select(
        "seq_id", F.col("event_id").alias("frame_idx"), (F.col("value") / 100.0).alias("tx"), ((F.col("event_id") % 100).cast("double") / 25.0).alias("ty"), F.lit(1.5).alias("tz"), "ts"
    )


@query(
    "x04_streaming_prediction",
    """SELECT seq_id, event_id, r4(coalesce(2 * lag(tx, 1) OVER w - lag(tx, 2) OVER w, lag(tx, 1) OVER w)) AS pred_tx FROM fx_pose WINDOW w AS (PARTITION BY seq_id ORDER BY frame_idx)""",
)
def _(fx):
    s, delay = _timed_stream(fx, _tracked(fx), "poses", 86400, frame_idx=-1, tx=0, ty=0, tz=0)
    out = ST.drain(ST.predict_stream(s, idle="400 days", delay=delay), "append", "predict").filter("seq_id >= 0")
    return out.select("seq_id", F.col("frame_idx").alias("event_id"), r4("pred_tx").alias("pred_tx"))


@query(
    "x04_prediction_after_rest",
    """WITH g AS (SELECT *, lag(tx, 1) OVER w AS one, lag(tx, 2) OVER w AS two, lag(ty, 1) OVER w AS yone, lag(ty, 2) OVER w AS ytwo, ts - lag(ts, 1) OVER w <= 36000 AS near, lag(ts, 1) OVER w - lag(ts, 2) OVER w <= 36000 AS nearer
      FROM fx_pose WINDOW w AS (PARTITION BY seq_id ORDER BY frame_idx))
    SELECT seq_id, event_id, r4(CASE WHEN near AND nearer THEN 2 * one - two WHEN near THEN one END) AS pred_tx, r4(CASE WHEN near AND nearer THEN 2 * yone - ytwo WHEN near THEN yone END) AS pred_ty FROM g""",
)
def _(fx):
    s, delay = _timed_stream(fx, _tracked(fx), "rests", 86400, frame_idx=-1, tx=0, ty=0, tz=0)
    out = ST.drain(ST.predict_stream(s, idle="10 hours", delay=delay), "append", "rests").filter("seq_id >= 0")
    return out.select("seq_id", F.col("frame_idx").alias("event_id"), r4("pred_tx").alias("pred_tx"), r4("pred_ty").alias("pred_ty"))


@query(
    "x05_windowed_losses",
    """WITH e AS (SELECT epoch_us(ts) // 86400000000 AS day, value / 100.0 AS z, ((event_id % 21) - 10) / 10.0 AS sdf, 1.5::DOUBLE AS depth FROM events)
    SELECT day, count(*) AS n, r4(avg(CASE WHEN z < depth-0.3 THEN (sdf-1)*(sdf-1) END)) AS fs_loss, r4(avg(CASE WHEN z > depth-0.12 AND z < depth+0.12 THEN (z+sdf*0.3-depth)*(z+sdf*0.3-depth) END)) AS center_loss FROM e GROUP BY day""",
)
def _(fx):
    s = _seconds_stream(fx).select(
        F.timestamp_micros((F.col("sec") * 1e6 + 0.5).cast("long")).alias("ts"), (F.col("value") / 100.0).alias("z"), (((F.col("event_id") % 21) - 10) / 10.0).alias("sdf"), F.lit(1.5).alias("depth")
    )
    u = ST.drain(ST.windowed_losses(s, 0.3, "1 day"), "update", "losses")
    u = u.withColumn("day", F.floor(F.unix_micros("w.start") / 86_400_000_000)).drop("w")
    return ST.latest_update(u, ["day"]).select("day", "n", r4("fs_loss").alias("fs_loss"), r4("center_loss").alias("center_loss"))
