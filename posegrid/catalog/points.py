"""Queries over labelled clouds, colours, similarity transforms and fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..fixtures import CLASS_OF_SIZE, r4
from ..functions import geometry as g
from ..functions import labels as L
from ..functions import rand
from ..operators import cloud as C
from ..operators import fit
from ..operators import neighbors as nn
from ..operators import sampling
from .registry import query

RAD = math.pi / 180


def _case(col: str, mapping: dict[int, int], default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


def _side(fx, k: int):
    return fx.cloud.filter(F.col("side") == k)


PALETTE52_SQL = "(VALUES " + ", ".join(f"({i}, {r}, {gg}, {b})" for i, (r, gg, b) in enumerate(L.PALETTE52)) + ") AS pal(id, pr, pg, pb)"

# -- counts, labels, colours -------------------------------------------------------------------


@query(
    "a01_class_counts",
    """SELECT c.label, d.name, count(*) AS n FROM fx_cloud_big c LEFT JOIN fx_class_dim d ON c.label = d.label GROUP BY c.label, d.name""",
)
def _(fx):
    return C.class_counts(fx.cloud_big, fx.class_dim).select("label", "name", "n")


@query(
    "a02_color_counts",
    f"""WITH u AS (SELECT r, g, b, count(*) AS n FROM fx_color GROUP BY r, g, b),
    k AS (SELECT r, g, b, n, arg_min(id, (abs(r-pr)+abs(g-pg)+abs(b-pb)) * 1000 + id) AS idx FROM u, {PALETTE52_SQL} GROUP BY r, g, b, n)
    SELECT r, g, b, n, idx::BIGINT AS idx, ({_case('idx', dict(enumerate(L.PALETTE52_CLASS)), '-1')})::BIGINT AS class_id,
           coalesce(p.p_name, '?') AS name FROM k LEFT JOIN part p ON p.p_partkey = ({_case('idx', dict(enumerate(L.PALETTE52_CLASS)), '-1')})""",
)
def _(fx):
    names = fx.table("part").select(F.col("p_partkey").cast("int").alias("class_id"), F.col("p_name").alias("name"))
    return C.color_counts(fx.color, names).select("r", "g", "b", "n", "idx", "class_id", "name")


@query(
    "a03_label_discovery",
    """WITH d AS (SELECT raw, count(*) AS n FROM fx_pixel GROUP BY raw) SELECT row_number() OVER (ORDER BY raw) - 1 AS idx, raw, n FROM d""",
)
def _(fx):
    return C.discover_labels(fx.pixel, "raw")


@query(
    "a04_voxel_downsample",
    """WITH lo AS (SELECT label, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM fx_cloud_big GROUP BY label)
    SELECT c.label, count(*) AS n, r4(avg(x)) AS x, r4(avg(y)) AS y, r4(avg(z)) AS z FROM fx_cloud_big c JOIN lo ON c.label = lo.label
    GROUP BY c.label, floor((x-(x0-0.1))/0.2), floor((y-(y0-0.1))/0.2), floor((z-(z0-0.1))/0.2)""",
)
def _(fx):
    return C.voxel_downsample(fx.cloud_big, 0.2).select("label", "n", r4("x").alias("x"), r4("y").alias("y"), r4("z").alias("z"))


@query(
    "p01_nearest_color_l2",
    """SELECT r, g, b, p.label::BIGINT AS label, count(*) AS n FROM (
      SELECT c.r, c.g, c.b, arg_min(d.label, ((c.r-d.r)*(c.r-d.r)+(c.g-d.g)*(c.g-d.g)+(c.b-d.b)*(c.b-d.b)) * 10 + d.label) AS label, rid FROM
        (SELECT *, row_number() OVER () AS rid FROM fx_color) c, fx_class_dim d GROUP BY rid, c.r, c.g, c.b) p GROUP BY r, g, b, label""",
)
def _(fx):
    return C.color_to_label(fx.color).groupBy("r", "g", "b", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p02_nearest_color_l1",
    f"""WITH u AS (SELECT DISTINCT r, g, b FROM fx_color),
    k AS (SELECT r, g, b, arg_min(id, (abs(r-pr)+abs(g-pg)+abs(b-pb)) * 1000 + id) AS idx FROM u, {PALETTE52_SQL} GROUP BY r, g, b)
    SELECT idx::BIGINT AS idx, ({_case('idx', dict(enumerate(L.PALETTE52_CLASS)), '-1')})::BIGINT AS class_id, count(*) AS n
    FROM fx_color c JOIN k USING (r, g, b) GROUP BY idx""",
)
def _(fx):
    idx = L.nearest_color(F.col("r"), F.col("g"), F.col("b"), L.PALETTE52, "l1")
    return fx.color.select(idx.alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("n")).withColumn("class_id", L.palette_class(F.col("idx")))


@query(
    "p03_label_to_rgb",
    """SELECT c.label, d.r / 255.0 AS r, d.g / 255.0 AS g, d.b / 255.0 AS b, count(*) AS n
    FROM fx_cloud_big c JOIN fx_class_dim d ON c.label = d.label GROUP BY ALL""",
)
def _(fx):
    out = fx.cloud_big.join(F.broadcast(fx.class_dim), "label")
    return out.groupBy("label", (F.col("r") / 255.0).alias("r"), (F.col("g") / 255.0).alias("g"), (F.col("b") / 255.0).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_class_remap", f"SELECT instance, class_id, ({_case('class_id', CLASS_OF_SIZE, '0')})::BIGINT AS label FROM fx_remap")
def _(fx):
    return fx.remap.withColumn("label", L.int_map(F.col("class_id"), CLASS_OF_SIZE, 0))


@query(
    "p05_two_hop_remap",
    f"""SELECT l.l_partkey - 5 AS instance, coalesce({_case('r.class_id', CLASS_OF_SIZE, '0')}, 0)::BIGINT AS label, count(*) AS n
    FROM lineitem l LEFT JOIN fx_remap r ON r.instance = l.l_partkey - 5 GROUP BY ALL""",
)
def _(fx):
    pix = fx.table("lineitem").groupBy((F.col("l_partkey") - 5).alias("instance")).agg(F.count(F.lit(1)).alias("n"))
    hop = pix.join(fx.remap, "instance", "left")
    return hop.select("instance", L.int_map(F.col("class_id"), CLASS_OF_SIZE, 0).alias("label"), "n")


@query(
    "p06_pixel_label_override",
    """SELECT frame, v, u, raw, CASE WHEN raw = 12 THEN 4 WHEN raw = 3 THEN 1 WHEN raw = 7 THEN 2 WHEN raw = 12 THEN 3 WHEN raw = 9 THEN 4 WHEN raw = 11 THEN 5 ELSE 0 END::BIGINT AS label FROM fx_pixel""",
)
def _(fx):
    return fx.pixel.select("frame", "v", "u", "raw", L.pixel_label(F.col("raw"), [0, 3, 7, 12, 9, 11], {12: 4}).alias("label"))


@query(
    "p07_instance_to_class_clamped",
    """SELECT i.instance, greatest(r.class_id - 10, 0)::BIGINT AS label FROM
      (SELECT least(greatest(p_partkey - 3, 0), 65535) AS instance FROM part) i JOIN fx_remap r ON r.instance = i.instance""",
)
def _(fx):
    inst = fx.remap.select(F.least(F.greatest(F.col("instance") - 3, F.lit(0)), F.lit(65535)).alias("instance"))
    return inst.join(fx.remap, "instance").select("instance", F.greatest(F.col("class_id") - 10, F.lit(0)).alias("label"))


@query("p08_depth_to_mm", "SELECT frame, v, u, trunc(depth * 1000.0)::BIGINT AS depth_mm FROM fx_pixel")
def _(fx):
    return fx.pixel.select("frame", "v", "u", L.depth_to_mm(F.col("depth")).alias("depth_mm"))


# -- similarity transforms ---------------------------------------------------------------------

APPLY = "m{i}0*x+m{i}1*y+m{i}2*z"


@query(
    "p10_apply_sim3",
    """SELECT c.point_id, t.run_id, r4(m00*x+m01*y+m02*z+t0) AS x, r4(m10*x+m11*y+m12*z+t1) AS y, r4(m20*x+m21*y+m22*z+t2) AS z
    FROM fx_keyed_cloud c JOIN fx_sim3 t ON t.run_id = c.point_id % 100""",
)
def _(fx):
    moved = C.transform_cloud(fx.keyed_cloud.withColumn("run_id", F.col("point_id") % 100).join(fx.sim3, "run_id"), *g.sim3(), with_normals=False)
    return moved.select("point_id", "run_id", *[r4(a).alias(a) for a in nn.XYZ])


@query(
    "p10_apply_sim3_normals",
    """SELECT c.point_id, r4((m00*nx+m01*ny+m02*nz)/s) AS nx, r4((m10*nx+m11*ny+m12*nz)/s) AS ny, r4((m20*nx+m21*ny+m22*nz)/s) AS nz
    FROM fx_cloud c JOIN (SELECT *, cbrt(m22*(m00*m11-m01*m10)) AS s FROM fx_sim3) t ON t.run_id = c.point_id % 10""",
)
def _(fx):
    moved = C.transform_cloud(fx.cloud.withColumn("run_id", F.col("point_id") % 10).join(fx.sim3, "run_id"), *g.sim3())
    return moved.select("point_id", *[r4(a).alias(a) for a in ("nx", "ny", "nz")])


@query(
    "p11_invert_sim3",
    """WITH s AS (SELECT *, cbrt(greatest(m22*(m00*m11-m01*m10), 1e-18)) AS s FROM fx_sim3)
    SELECT run_id, r4(s) AS s, r4(m00/s/s) AS m00, r4(m10/s/s) AS m01, r4(m11/s/s) AS m11, r4(m22/s/s) AS m22,
      r4(-(m00*t0+m10*t1)/s/s) AS t0, r4(-(m01*t0+m11*t1)/s/s) AS t1, r4(-(m22*t2)/s/s) AS t2 FROM s""",
)
def _(fx):
    m, t = g.invert_sim3(*g.sim3())
    cols = {"m00": m[0][0], "m01": m[0][1], "m11": m[1][1], "m22": m[2][2], "t0": t[0], "t1": t[1], "t2": t[2]}
    return fx.sim3.select("run_id", r4(g.sim3_scale(g.mat("m"))).alias("s"), *[r4(v).alias(k) for k, v in cols.items()])


@query(
    "p11_compose_sim3",
    """SELECT a.run_id, r4(a.m00*b.m00+a.m01*b.m10) AS m00, r4(a.m00*b.m01+a.m01*b.m11) AS m01, r4(a.m22*b.m22) AS m22,
      r4(a.m00*b.t0+a.m01*b.t1+a.t0) AS t0, r4(a.m10*b.t0+a.m11*b.t1+a.t1) AS t1, r4(a.m22*b.t2+a.t2) AS t2
    FROM fx_sim3 a JOIN fx_sim3 b ON b.run_id = a.run_id + 1""",
)
def _(fx):
    b = fx.sim3.select((F.col("run_id") - 1).alias("run_id"), *[F.col(c).alias("b" + c) for c in fx.sim3.columns if c != "run_id"])
    m, t = g.compose_sim3(g.sim3(), g.sim3("bm", "bt"))
    cols = {"m00": m[0][0], "m01": m[0][1], "m22": m[2][2], "t0": t[0], "t1": t[1], "t2": t[2]}
    return fx.sim3.join(b, "run_id").select("run_id", *[r4(v).alias(k) for k, v in cols.items()])


ERRORS_SQL = """degrees(acos(least(greatest(((a.m00*b.m00+a.m01*b.m01+a.m10*b.m10+a.m11*b.m11+a.m22*b.m22)/(a.s*b.s)-1.0)/2.0,-1.0),1.0)))"""


@query(
    "p12_sim3_errors",
    f"""WITH s AS (SELECT *, cbrt(greatest(m22*(m00*m11-m01*m10), 1e-18)) AS s FROM fx_sim3)
    SELECT a.run_id, round({ERRORS_SQL}, 3) AS rot_deg, r4(sqrt((a.t0-b.t0)**2+(a.t1-b.t1)**2+(a.t2-b.t2)**2)) AS trans, r4(abs(a.s/b.s-1.0)) AS scale_ratio
    FROM s a JOIN s b ON b.run_id = a.run_id + 1""",
)
def _(fx):
    b = fx.sim3.select((F.col("run_id") - 1).alias("run_id"), *[F.col(c).alias("b" + c) for c in fx.sim3.columns if c != "run_id"])
    e = g.sim3_errors(g.sim3(), g.sim3("bm", "bt"))
    return fx.sim3.join(b, "run_id").select("run_id", F.round(e["rot_deg"], 3).alias("rot_deg"), r4(e["trans"]).alias("trans"), r4(e["scale_ratio"]).alias("scale_ratio"))


@query(
    "p13_angle_between",
    """SELECT a.point_id, r4(degrees(acos(least(abs((a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)/((sqrt(a.nx*a.nx+a.ny*a.ny+a.nz*a.nz)+1e-12)*(sqrt(b.nx*b.nx+b.ny*b.ny+b.nz*b.nz)+1e-12))),1.0)))) AS deg
    FROM fx_cloud a JOIN fx_cloud b ON b.point_id = a.point_id + 1""",
)
def _(fx):
    b = fx.cloud.select((F.col("point_id") - 1).alias("point_id"), *[F.col("n" + a).alias("b" + a) for a in nn.XYZ])
    return fx.cloud.join(b, "point_id").select("point_id", r4(g.angle_between_deg(g.vec("nx", "ny", "nz"), g.vec("bx", "by", "bz"))).alias("deg"))


@query(
    "p20_enlarged_bound",
    """SELECT label, r4((trunc((max(x)-min(x))/0.32)+1)*0.32+min(x)) AS hx, r4((trunc((max(y)-min(y))/0.32)+1)*0.32+min(y)) AS hy,
      r4((trunc((max(z)-min(z))/0.32)+1)*0.32+min(z)) AS hz FROM fx_keyed_cloud GROUP BY label""",
)
def _(fx):
    return fx.keyed_cloud.groupBy("label").agg(*[r4(g.enlarged_bound(F.min(a), F.max(a), 0.32)).alias("h" + a) for a in nn.XYZ])


@query("p21_normalize_to_bound", "SELECT point_id, r4((x-0.0)/5.0*2.0-1.0) AS x, r4((y-0.0)/4.0*2.0-1.0) AS y, r4((z-0.0)/2.5*2.0-1.0) AS z FROM fx_keyed_cloud")
def _(fx):
    p = g.normalize_to_bound(g.vec(*nn.XYZ), (0, 0, 0), (5, 4, 2.5))
    return fx.keyed_cloud.select("point_id", *[r4(c).alias(a) for a, c in zip(nn.XYZ, p)])


@query(
    "p23_tukey_weight",
    "SELECT point_id, r4((1-r*r)*(1-r*r)) AS w FROM (SELECT point_id, least(greatest(sqrt(x*x+y*y+z*z)/1.5,0.0),1.0) AS r FROM fx_cloud)",
)
def _(fx):
    return fx.cloud.select("point_id", r4(g.tukey_weight(g.norm(g.vec(*nn.XYZ)), 1.5)).alias("w"))


@query(
    "p24_canonical_frames",
    """WITH u AS (SELECT point_id, nx AS ux, ny AS uy, nz AS uz, CASE WHEN abs(nx) < 0.9 THEN 1.0 ELSE 0.0 END AS fx0, CASE WHEN abs(nx) < 0.9 THEN 0.0 ELSE 1.0 END AS fy0 FROM fx_cloud),
    d AS (SELECT *, fx0*ux+fy0*uy AS p FROM u), e AS (SELECT *, fx0-p*ux AS ax, fy0-p*uy AS ay, -p*uz AS az FROM d),
    n AS (SELECT *, sqrt(ax*ax+ay*ay+az*az)+1e-12 AS l FROM e), x AS (SELECT *, ax/l AS x0, ay/l AS x1, az/l AS x2 FROM n)
    SELECT point_id, r4(x0) AS x0, r4(x1) AS x1, r4(x2) AS x2, r4(uy*x2-uz*x1) AS y0, r4(uz*x0-ux*x2) AS y1, r4(ux*x1-uy*x0) AS y2 FROM x""",
)
def _(fx):
    up = g.vec("nx", "ny", "nz")
    e1, e2 = g.horizontal_basis(up)
    cols = dict(zip(("x0", "x1", "x2", "y0", "y1", "y2"), e1 + e2))
    return fx.cloud.select("point_id", *[r4(v).alias(k) for k, v in cols.items()])


@query(
    "p24_yaw_candidates",
    """WITH f AS (SELECT run_id, m00/s AS c, m10/s AS n FROM (SELECT *, m22 AS s FROM fx_sim3)),
    j AS (SELECT a.run_id, b.c AS bc, b.n AS bn, a.c AS ac, a.n AS an, k, cos(k*pi()/2) AS kc, sin(k*pi()/2) AS ks FROM f a JOIN f b ON b.run_id = a.run_id + 1, range(4) t(k))
    SELECT run_id, k AS candidate, r4((bc*kc+bn*ks)*ac+(bn*kc-bc*ks)*an) AS r00, r4((bc*ks-bn*kc)*ac+(bn*ks+bc*kc)*an) AS r10, r4(1.0) AS r22 FROM j""",
)
def _(fx):
    s = g.sim3_rotation(g.mat("m"))
    frames = fx.sim3.select("run_id", *g.named(s, "k"))
    nxt = frames.withColumn("run_id", F.col("run_id") - 1)
    return fit.yaw_candidates(frames, nxt, ["run_id"]).select("run_id", "candidate", r4("r00").alias("r00"), r4("r10").alias("r10"), r4("r22").alias("r22"))


@query("p25_random_sim3")
def _(fx):
    trials = fx.table("supplier").select(F.col("s_suppkey").alias("trial"))
    return sampling.random_sim3(trials)


@query("p26_label_noise")
def _(fx):
    c = fx.keyed_cloud
    return c.select("point_id", "label", rand.label_noise(F.col("label"), 0.2, 6, "point_id", seed=1).alias("noisy"))


# -- filters and sets --------------------------------------------------------------------------


@query("f01_class_subset", "SELECT point_id, label, x, y, z FROM fx_keyed_cloud WHERE label IN (1, 3, 5)")
def _(fx):
    return C.subset(fx.keyed_cloud, ["wall", "floor", "ceiling"]).select("point_id", "label", *nn.XYZ)


@query(
    "f08_bound_mask",
    """SELECT point_id, x > 0.5 AND x < 4.0 AND y > 0.25 AND y < 3.0 AND z > 0.0 AND z < 2.0 AS inside,
      CASE WHEN x > 0.5 AND x < 4.0 AND y > 0.25 AND y < 3.0 AND z > 0.0 AND z < 2.0 THEN r4(z - 1.0) ELSE -1.0 END AS sdf FROM fx_keyed_cloud""",
)
def _(fx):
    inside = F.lit(True)
    for a, lo, hi in zip(nn.XYZ, (0.5, 0.25, 0.0), (4.0, 3.0, 2.0)):
        inside = inside & (F.col(a) > lo) & (F.col(a) < hi)
    return fx.keyed_cloud.select("point_id", inside.alias("inside"), F.when(inside, r4(F.col("z") - 1.0)).otherwise(-1.0).alias("sdf"))


@query("f09_vertical_normals", "SELECT point_id, nx, ny FROM (SELECT point_id, r4(nx) AS nx, r4(ny) AS ny, sqrt(nx*nx+ny*ny) AS h FROM fx_cloud) WHERE h > 0.3")
def _(fx):
    return fx.cloud.filter(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")) > 0.3).select("point_id", r4("nx").alias("nx"), r4("ny").alias("ny"))


@query(
    "u01_concat_clouds",
    """SELECT 0::BIGINT AS part, point_id, label, r4(x) AS x FROM fx_cloud WHERE side = 0 UNION ALL SELECT 1, point_id, label, r4(x) FROM fx_cloud WHERE side = 1""",
)
def _(fx):
    cols = ["point_id", "label", r4("x").alias("x")]
    return _side(fx, 0).select(F.lit(0).alias("part"), *cols).unionByName(_side(fx, 1).select(F.lit(1).alias("part"), *cols))


@query(
    "u02_common_classes",
    "SELECT DISTINCT label FROM fx_cloud WHERE side = 0 AND label IN (1,2,3,4,5) INTERSECT SELECT label FROM fx_cloud WHERE side = 1",
)
def _(fx):
    return C.common_classes(_side(fx, 0), _side(fx, 1), (1, 2, 3, 4, 5))


# -- neighbours and scores ---------------------------------------------------------------------

D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


@query(
    "j03_same_class_nearest",
    f"""WITH c AS (SELECT a.point_id, a.label, b.point_id AS nearest_id, sqrt({D2}) AS d FROM fx_cloud a JOIN fx_cloud b ON a.label = b.label AND a.side = 0 AND b.side = 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, nearest_id) AS rn FROM c)
    SELECT point_id, label, nearest_id, r4(d) AS dist FROM m WHERE rn = 1 AND d < 0.6""",
)
def _(fx):
    s = _side(fx, 0).select("label", F.col("point_id").alias("src_id"), *nn.XYZ)
    d = _side(fx, 1).select("label", F.col("point_id").alias("dst_id"), *nn.XYZ)
    return nn.nearest(s, d, ["label"], radius=0.6).select(F.col("src_id").alias("point_id"), "label", F.col("dst_id").alias("nearest_id"), r4(F.sqrt("d2")).alias("dist"))


@query(
    "j04_nearest_neighbour",
    f"""WITH c AS (SELECT a.point_id, b.point_id AS nearest_id, sqrt({D2}) AS d FROM fx_cloud a JOIN fx_cloud b ON a.side = 0 AND b.side = 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, nearest_id) AS rn FROM c)
    SELECT point_id, nearest_id, r4(d) AS dist FROM m WHERE rn = 1""",
)
def _(fx):
    return C.cloud_distances(_side(fx, 0), _side(fx, 1)).select("point_id", "nearest_id", r4("dist").alias("dist"))


@query(
    "j05_radius_neighbours",
    f"""WITH c AS (SELECT a.point_id, b.point_id AS other_id, {D2} AS d2 FROM fx_cloud a, fx_cloud b WHERE {D2} <= 0.64),
    m AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, other_id) AS rn FROM c)
    SELECT point_id, other_id, rn AS rank, r4(sqrt(d2)) AS dist FROM m WHERE rn <= 12""",
)
def _(fx):
    s = fx.cloud.select(F.col("point_id").alias("src_id"), *nn.XYZ)
    d = fx.cloud.select(F.col("point_id").alias("dst_id"), *nn.XYZ)
    hood = nn.neighborhoods(s, d, 0.8, 12)
    return hood.select(F.col("src_id").alias("point_id"), F.col("dst_id").alias("other_id"), "rank", r4(F.sqrt("d2")).alias("dist"))


@query(
    "j09_mutual_nearest_features",
    """WITH c AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE-p[2]::DOUBLE)*(p[1]::DOUBLE-p[2]::DOUBLE))) AS d2
      FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
    f AS (SELECT a_id, b_id, d2, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY d2, a_id) AS rb FROM c)
    SELECT a_id, b_id, r4(d2) AS d2 FROM f WHERE ra = 1 AND rb = 1""",
)
def _(fx):
    e = fx.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    a = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a_id"), "vec")
    b = e.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("b_id"), "vec")
    return nn.mutual_nearest_features(a, b).select("a_id", "b_id", r4("d2").alias("d2"))


@query(
    "a05_neighbourhood_covariance",
    f"""WITH c AS (SELECT a.point_id, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.point_id ORDER BY {D2}, b.point_id) AS rn FROM fx_cloud a, fx_cloud b WHERE {D2} <= 0.64)
    SELECT point_id, count(*) AS n, r4(covar_pop(x,x)) AS cxx, r4(covar_pop(x,y)) AS cxy, r4(covar_pop(x,z)) AS cxz, r4(covar_pop(y,y)) AS cyy, r4(covar_pop(y,z)) AS cyz, r4(covar_pop(z,z)) AS czz
    FROM c WHERE rn <= 30 GROUP BY point_id""",
)
def _(fx):
    cov = C.neighborhood_covariance(fx.cloud, 0.8, 30)
    return cov.select(F.col("src_id").alias("point_id"), "n", *[r4(c).alias(c) for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")])


@query("a05_estimate_normals")
def _(fx):
    return C.estimate_normals(fx.cloud, 0.8, 30).select("point_id", "nx", "ny", "nz")


NN_SQL = f"""WITH ab AS (SELECT a.point_id, min(sqrt({D2})) AS d FROM fx_cloud a JOIN fx_cloud b ON a.side = 0 AND b.side = 1 GROUP BY a.point_id),
    ba AS (SELECT b.point_id, min(sqrt({D2})) AS d FROM fx_cloud a JOIN fx_cloud b ON a.side = 0 AND b.side = 1 GROUP BY b.point_id)"""


@query("a15_chamfer", NN_SQL + " SELECT r4((SELECT avg(d) FROM ab)) AS d_ab, r4((SELECT avg(d) FROM ba)) AS d_ba, r4(((SELECT avg(d) FROM ab) + (SELECT avg(d) FROM ba)) / 2) AS chamfer")
def _(fx):
    return C.chamfer(_side(fx, 0), _side(fx, 1)).select(*[r4(c).alias(c) for c in ("d_ab", "d_ba", "chamfer")])


@query(
    "a16_class_inlier_ratio",
    f"""WITH m AS (SELECT a.point_id, min(sqrt({D2})) AS d FROM fx_cloud a JOIN fx_cloud b ON a.label = b.label AND a.side = 0 AND b.side = 1 GROUP BY a.point_id)
    SELECT count(*) AS total, sum(CASE WHEN d < 0.6 THEN 1 ELSE 0 END)::BIGINT AS inliers, r4(avg(CASE WHEN d < 0.6 THEN 1.0 ELSE 0.0 END)) AS ratio FROM m""",
)
def _(fx):
    return C.class_inlier_ratio(_side(fx, 0), _side(fx, 1), 0.6).select("total", "inliers", r4("ratio").alias("ratio"))


@query(
    "a17_reconstruction_scores",
    NN_SQL + """ SELECT r4((SELECT avg(d) * 100 FROM ab)) AS accuracy_cm, r4((SELECT avg(d) * 100 FROM ba)) AS completion_cm,
      r4((SELECT avg(CASE WHEN d < 0.5 THEN 1.0 ELSE 0.0 END) * 100 FROM ba)) AS completion_ratio_pct""",
)
def _(fx):
    s = C.reconstruction_scores(_side(fx, 0), _side(fx, 1), threshold=0.5)
    return s.select(*[r4(c).alias(c) for c in ("accuracy_cm", "completion_cm", "completion_ratio_pct")])


@query(
    "a27_scene_bound",
    """WITH b AS (SELECT label, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, max(x+y+z) AS s FROM fx_cloud_big GROUP BY label),
    c AS (SELECT *, (lx+hx)/2 AS cx, (ly+hy)/2 AS cy, (lz+hz)/2 AS cz FROM b)
    SELECT label, r4(cx+(lx-cx)*1.02) AS lo_x, r4(cx+(hx-cx)*1.02) AS hi_x, r4(cz+(hz-cz)*1.02) AS hi_z, r4((cx+cy+cz)+(s-(cx+cy+cz))*1.02) AS diag FROM c""",
)
def _(fx):
    b = C.scene_bound(fx.cloud_big, ["label"])
    k = C.SUPPORT_DIRECTIONS.index((1, 1, 1))
    return b.select("label", r4("lo_x").alias("lo_x"), r4("hi_x").alias("hi_x"), r4("hi_z").alias("hi_z"), r4(f"s{k}").alias("diag"))


# -- fits --------------------------------------------------------------------------------------

PAIRS_SQL = "(SELECT a.label, a.point_id, a.x AS sx, a.y AS sy, a.z AS sz, b.x AS dx, b.y AS dy, b.z AS dz, 1.0/(1+a.point_id%4) AS w FROM fx_cloud a JOIN fx_cloud b ON b.point_id = a.point_id + 6)"


def _pairs(fx):
    b = fx.cloud.select((F.col("point_id") - 6).alias("point_id"), *[F.col(a).alias("d" + a) for a in nn.XYZ])
    p = fx.cloud.select("label", "point_id", *[F.col(a).alias("s" + a) for a in nn.XYZ]).join(b, "point_id")
    return p.withColumn("wt", 1.0 / (1 + F.col("point_id") % 4))


@query(
    "a06_similarity_moments",
    f"""WITH p AS {PAIRS_SQL}, m AS (SELECT label, count(*) AS n, sum(w)+1e-12 AS sw, sum(w*sx)/(sum(w)+1e-12) AS ax, sum(w*sy)/(sum(w)+1e-12) AS ay, sum(w*sz)/(sum(w)+1e-12) AS az,
       sum(w*dx)/(sum(w)+1e-12) AS bx, sum(w*dy)/(sum(w)+1e-12) AS "by", sum(w*dz)/(sum(w)+1e-12) AS bz FROM p GROUP BY label)
    SELECT label, any_value(n) AS n, r4(any_value(ax)) AS msx, r4(any_value(bz)) AS mdz, r4(sum(w/sw*(dx-bx)*(sx-ax))) AS cxx, r4(sum(w/sw*(dx-bx)*(sy-ay))) AS cxy,
      r4(sum(w/sw*(dz-bz)*(sx-ax))) AS czx, r4(sum(w/sw*((sx-ax)*(sx-ax)+(sy-ay)*(sy-ay)+(sz-az)*(sz-az)))) AS vs FROM p JOIN m USING (label) GROUP BY label""",
)
def _(fx):
    m = fit.weighted_moments(_pairs(fx), ["label"], F.col("wt"))
    return m.select("label", "n", *[r4(c).alias(c) for c in ("msx", "mdz", "cxx", "cxy", "czx", "vs")])


@query("a06_umeyama_fit")
def _(fx):
    return fit.umeyama(_pairs(fx), ["label"], F.col("wt"))


@query(
    "a07_scale_translation",
    f"""WITH p AS {PAIRS_SQL}, m AS (SELECT label, sum(w)+1e-12 AS sw, sum(w*sx)/(sum(w)+1e-12) AS ax, sum(w*sy)/(sum(w)+1e-12) AS ay, sum(w*sz)/(sum(w)+1e-12) AS az,
       sum(w*dx)/(sum(w)+1e-12) AS bx, sum(w*dy)/(sum(w)+1e-12) AS b_y, sum(w*dz)/(sum(w)+1e-12) AS bz FROM p GROUP BY label),
    s AS (SELECT label, any_value(ax) AS ax, any_value(ay) AS ay, any_value(az) AS az, any_value(bx) AS bx, any_value(b_y) AS b_y, any_value(bz) AS bz,
      sum(w/sw*((sx-ax)*(dx-bx)+(sy-ay)*(dy-b_y)+(sz-az)*(dz-bz))) / (sum(w/sw*((sx-ax)*(sx-ax)+(sy-ay)*(sy-ay)+(sz-az)*(sz-az)))+1e-12) AS s FROM p JOIN m USING (label) GROUP BY label)
    SELECT label, r4(s) AS scale, r4(bx-s*ax) AS t0, r4(b_y-s*ay) AS t1, r4(bz-s*az) AS t2 FROM s""",
)
def _(fx):
    m = fit.scale_translation(fit.weighted_moments(_pairs(fx), ["label"], F.col("wt")))
    return m.select("label", *[r4(c).alias(c) for c in ("scale", "t0", "t1", "t2")])


@query(
    "a09_axis_votes",
    """WITH u AS (SELECT label, point_id, nx/(l+1e-12) AS nx, ny/(l+1e-12) AS ny, nz/(l+1e-12) AS nz FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM fx_cloud)),
    h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY point_id) - 1 AS h FROM u),
    v AS (SELECT h.label, h.h, sum(CASE WHEN abs(h.nx*u.nx+h.ny*u.ny+h.nz*u.nz) > 0.5 THEN 1 ELSE 0 END)::BIGINT AS inliers FROM h JOIN u ON h.label = u.label WHERE h.h < 20 GROUP BY h.label, h.h)
    SELECT label, h, inliers FROM v""",
)
def _(fx):
    hyp = fit.draw_hypotheses(fx.cloud, ["label"], 20, F.col("point_id"))
    return fit.axis_votes(fit.direction_counts(fx.cloud, ["label"]), hyp, ["label"], 60.0).select("label", "h", "inliers")


@query("a09_robust_axis")
def _(fx):
    return fit.robust_axis(fx.cloud, ["label"], 30.0, 200)


@query("a10_gravity_axis")
def _(fx):
    return fit.gravity_axis(fx.cloud, ["side"], 30.0, 200)


@query(
    "a11_manhattan_yaw",
    """WITH w AS (SELECT side, CASE WHEN atan2(ny, nx) < 0 THEN atan2(ny, nx) + 2*pi() ELSE atan2(ny, nx) END AS a FROM fx_cloud WHERE label = 1 AND sqrt(nx*nx+ny*ny) > 0.3),
    b AS (SELECT side, least(floor((a - floor(a/(pi()/2))*(pi()/2))/(pi()/2/36)), 35)::BIGINT AS bin, count(*) AS votes FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY votes DESC, bin) AS rn FROM b)
    SELECT side, bin, votes, r4(cos(bin*(pi()/2/36)+pi()/2/36/2)) AS wx, r4(sin(bin*(pi()/2/36)+pi()/2/36/2)) AS wy FROM r WHERE rn = 1""",
)
def _(fx):
    up = fx.cloud.select("side").distinct().select("side", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"))
    y = fit.yaw_direction(fx.cloud, up, ["side"], 36)
    return y.select("side", "bin", "votes", r4("wx").alias("wx"), r4("wy").alias("wy"))


SPANS_SQL = """SELECT scene_id, 0::BIGINT AS axis, count(*) AS n, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM fx_keyed_cloud WHERE label = 1 GROUP BY scene_id
      UNION ALL SELECT scene_id, 1, count(*), quantile_cont(y, 0.02), quantile_cont(y, 0.98) FROM fx_keyed_cloud WHERE label = 1 GROUP BY scene_id
      UNION ALL SELECT scene_id, 2, count(*), quantile_cont(z, 0.02), quantile_cont(z, 0.98) FROM fx_keyed_cloud WHERE label IN (3, 5) GROUP BY scene_id"""


def _level_frame(scenes):
    eye = [F.lit(1.0 if i == j else 0.0).alias(f"k{i}{j}") for i in range(3) for j in range(3)]
    return scenes.select("scene_id").distinct().select("scene_id", *eye)


@query("a12_axis_span", f"SELECT scene_id, axis, n, CASE WHEN n >= 10 THEN r4((lo+hi)/2) END AS centre, CASE WHEN n >= 10 THEN r4(hi-lo) END AS extent FROM ({SPANS_SQL})")
def _(fx):
    s = fit.axis_spans(fx.keyed_cloud, _level_frame(fx.keyed_cloud), ["scene_id"])
    return s.select("scene_id", "axis", "n", r4("centre").alias("centre"), r4("extent").alias("extent"))


CENTROID_SQL = "SELECT scene_id, coalesce(avg(x) FILTER (label IN (1,3,5)), avg(x)) AS cx, coalesce(avg(y) FILTER (label IN (1,3,5)), avg(y)) AS cy, coalesce(avg(z) FILTER (label IN (1,3,5)), avg(z)) AS cz FROM fx_keyed_cloud GROUP BY scene_id"


@query("a13_struct_centroid", f"SELECT scene_id, r4(cx) AS cx, r4(cy) AS cy, r4(cz) AS cz FROM ({CENTROID_SQL})")
def _(fx):
    return fit.struct_centroid(fx.keyed_cloud, ["scene_id"]).select("scene_id", *[r4("c" + a).alias("c" + a) for a in nn.XYZ])


@query(
    "a14_plane_seed",
    f"""WITH sp AS ({SPANS_SQL}), ct AS ({CENTROID_SQL}), e AS (SELECT scene_id, axis, CASE WHEN n >= 10 THEN (lo+hi)/2 END AS c, CASE WHEN n >= 10 THEN hi-lo END AS w FROM sp),
    p AS (SELECT a.scene_id, a.axis, a.c AS sc, b.c AS dc, CASE WHEN a.w > 0.5 AND b.w > 0.5 THEN b.w/a.w END AS ratio FROM e a JOIN e b ON a.axis = b.axis AND b.scene_id = (a.scene_id + 1) % 5),
    s AS (SELECT scene_id, coalesce(least(greatest(median(ratio), 0.3), 3.0), 1.0) AS s, max(CASE WHEN axis=0 THEN sc END) AS s0, max(CASE WHEN axis=0 THEN dc END) AS d0, max(CASE WHEN axis=1 THEN sc END) AS s1,
      max(CASE WHEN axis=1 THEN dc END) AS d1, max(CASE WHEN axis=2 THEN sc END) AS s2, max(CASE WHEN axis=2 THEN dc END) AS d2 FROM p GROUP BY scene_id)
    SELECT s.scene_id, r4(s.s) AS scale, r4(coalesce(d0-s.s*s0, b.cx-s.s*a.cx)) AS t0, r4(coalesce(d1-s.s*s1, b.cy-s.s*a.cy)) AS t1, r4(coalesce(d2-s.s*s2, b.cz-s.s*a.cz)) AS t2
    FROM s JOIN ct a ON a.scene_id = s.scene_id JOIN ct b ON b.scene_id = (s.scene_id + 1) % 5""",
)
def _(fx):
    frame = _level_frame(fx.keyed_cloud)
    spans = fit.axis_spans(fx.keyed_cloud, frame, ["scene_id"])
    cent = fit.struct_centroid(fx.keyed_cloud, ["scene_id"])
    back = F.pmod(F.col("scene_id") + 4, F.lit(5))
    seed = fit.plane_seed(spans, spans.withColumn("scene_id", back), cent, cent.withColumn("scene_id", back), frame, ["scene_id"])
    return seed.select("scene_id", *[r4(c).alias(c) for c in ("scale", "t0", "t1", "t2")])
