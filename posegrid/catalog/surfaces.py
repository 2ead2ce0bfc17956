"""Queries over meshes, lattices, view volumes and file-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CAMERA, r4
from ..functions import geometry as g
from ..functions import labels as L
from ..operators import mesh as M
from ..operators import sampling
from ..operators import visibility as V
from ..operators.rays import overlap_samples
from ..operators.views import counts_in_view, unoccluded_points
from ..session import materialize
from ..sources import manifest as files
from ..sources import tables
from .frames import RAY, UV_SQL
from .registry import query

XYZ = ("x", "y", "z")

# -- sources -----------------------------------------------------------------------------------


@query(
    "s04_frame_manifest",
    """SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY regexp_extract(path, '_(\\d+)\\.png', 1)::BIGINT) - 1 AS pos, path FROM fx_paths""",
)
def _(fx):
    return files.frame_manifest(fx.paths, []).select("kind", "pos", "path")


@query(
    "s04_unpaired_files",
    """WITH r AS (SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY regexp_extract(path, '_(\\d+)\\.png', 1)::BIGINT) - 1 AS pos FROM fx_paths)
    SELECT a.kind, a.pos, a.path FROM r a WHERE a.kind IN ('rgb', 'depth') AND NOT EXISTS (SELECT 1 FROM r b WHERE b.kind IN ('rgb', 'depth') AND b.kind <> a.kind AND b.pos = a.pos)""",
)
def _(fx):
    manifest = files.frame_manifest(fx.paths, [])
    sides = [files.unpaired(manifest, a, b, []).select(F.lit(a).alias("kind"), "pos", "path") for a, b in (("rgb", "depth"), ("depth", "rgb"))]
    return sides[0].unionByName(sides[1])


@query(
    "s05_pixel_source",
    "SELECT frame, v, u, r4(r / 255.0) AS r, r4(g / 255.0) AS g, r4(b / 255.0) AS b, r4(raw_depth / 6553.5 * 2.0) AS depth FROM (SELECT *, trunc(depth * 1000.0) AS raw_depth FROM fx_pixel)",
)
def _(fx):
    raw = fx.pixel.withColumn("depth", L.depth_to_mm(F.col("depth")).cast("double"))
    p = tables.scale_pixels(raw, depth_scale=6553.5, scale=2.0)
    return p.select("frame", "v", "u", *[r4(c).alias(c) for c in ("r", "g", "b", "depth")])


@query(
    "s06_class_info_json",
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS class_id FROM events",
)
def _(fx):
    e = fx.table("events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("class_id"))


@query(
    "s07_mesh_source",
    """SELECT f.object_id, count(*) AS n, r4(avg(v.x)) AS x, r4(avg(v.y)) AS y, r4(avg(v.z)) AS z FROM fx_face f JOIN fx_vertex v ON v.vid IN (f.v0, f.v1, f.v2, f.v3) GROUP BY f.object_id""",
)
def _(fx):
    c = fx.face.select("object_id", F.explode(F.array("v0", "v1", "v2", "v3")).alias("vid")).join(fx.vertex, "vid")
    return c.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), *[r4(F.avg(a)).alias(a) for a in XYZ])


@query(
    "s08_label_filtered_export",
    """SELECT point_id, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, label::DOUBLE AS label FROM fx_keyed_cloud WHERE label NOT IN (4)""",
)
def _(fx):
    return tables.export_rows(fx.keyed_cloud, hide=(4,)).select("point_id", *XYZ, "label")


@query(
    "s09_per_object_split",
    """SELECT object_id, half, count(*) AS n, min(tri_id) AS first_tri, max(tri_id) AS last_tri FROM
      (SELECT object_id, h AS half, fid + h * (SELECT count(*) FROM fx_face) AS tri_id FROM fx_face, range(2) t(h)) GROUP BY object_id, half""",
)
def _(fx):
    t = tables.object_triangles(fx.face)
    return t.groupBy("object_id", "half").agg(F.count(F.lit(1)).alias("n"), F.min("tri_id").alias("first_tri"), F.max("tri_id").alias("last_tri"))


@query("s11_latest_snapshot", "SELECT max(path) AS path FROM fx_paths WHERE path LIKE '%tar%'")
def _(fx):
    return files.latest_snapshot(fx.paths)


# -- meshes ------------------------------------------------------------------------------------

TRI_SQL = "(SELECT fid, object_id, 0::BIGINT AS half, v0 AS a, v1 AS b, v2 AS c FROM fx_face UNION ALL SELECT fid, object_id, 1, v0, v2, v3 FROM fx_face)"
GEO_SQL = f"""g AS (SELECT t.fid, t.half, t.object_id, (q.y-p.y)*(s.z-p.z)-(q.z-p.z)*(s.y-p.y) AS cx, (q.z-p.z)*(s.x-p.x)-(q.x-p.x)*(s.z-p.z) AS cy, (q.x-p.x)*(s.y-p.y)-(q.y-p.y)*(s.x-p.x) AS cz,
      p.x AS p0x, q.y AS p1y, s.z AS p2z FROM {TRI_SQL} t JOIN fx_vertex p ON p.vid = t.a JOIN fx_vertex q ON q.vid = t.b JOIN fx_vertex s ON s.vid = t.c),
    n AS (SELECT *, sqrt(cx*cx+cy*cy+cz*cz) AS l FROM g)"""


def _triangles(fx):
    return M.face_geometry(M.gather_corners(M.triangulate(fx.face), fx.vertex))


@query("j07_mesh_gather", f"WITH {GEO_SQL} SELECT fid, half, r4(p0x) AS p0x, r4(p1y) AS p1y, r4(p2z) AS p2z FROM n")
def _(fx):
    return _triangles(fx).select("fid", "half", r4("p0x").alias("p0x"), r4("p1y").alias("p1y"), r4("p2z").alias("p2z"))


@query(
    "p27_triangle_geometry",
    f"WITH {GEO_SQL} SELECT fid, half, r4(l/2) AS area, r4(CASE WHEN l > 0 THEN cx/l END) AS nx, r4(CASE WHEN l > 0 THEN cz/l END) AS nz FROM n",
)
def _(fx):
    return _triangles(fx).select("fid", "half", *[r4(c).alias(c) for c in ("area", "nx", "nz")])


@query("w07_sample_counts", f"WITH {GEO_SQL}, t AS (SELECT object_id, sum(l/2) AS total FROM n GROUP BY object_id) SELECT fid, half, r4(2000.0*(l/2)/total) AS expected FROM n JOIN t USING (object_id)")
def _(fx):
    return M.surface_counts(_triangles(fx), ["object_id"], 2000).select("fid", "half", r4("expected").alias("expected"))


@query("w07_samples_per_object", f"WITH {GEO_SQL} SELECT object_id, 2000::BIGINT AS n, 2000::BIGINT AS inside FROM n GROUP BY object_id HAVING sum(l) > 0")
def _(fx):
    s = M.sample_surface(_triangles(fx), ["object_id"], 2000, ["fid", "half"])
    within = [F.col(a).between(F.least(*(f"p{i}{a}" for i in range(3))) - 1e-9, F.greatest(*(f"p{i}{a}" for i in range(3))) + 1e-9) for a in XYZ]
    return s.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(within[0] & within[1] & within[2], 1)).alias("inside"))


@query("w07_surface_samples")
def _(fx):
    return M.sample_surface(_triangles(fx), ["object_id"], 2000, ["fid", "half"]).select("object_id", "fid", "half", "i", *XYZ, "nx", "ny", "nz")


@query(
    "c10_element_sizes",
    f"WITH {GEO_SQL} SELECT object_id, r4(sum(l/2)) AS area, greatest(trunc(sum(l/2)*0.05)::BIGINT, 10) AS n FROM n GROUP BY object_id",
)
def _(fx):
    return M.element_sizes(_triangles(fx), ["object_id"], 0.05).select("object_id", r4("area").alias("area"), "n")


@query("c10_element_samples")
def _(fx):
    return M.sample_elements(_triangles(fx), ["object_id"], ["fid", "half"], 0.05).select("object_id", "fid", "half", "i", *XYZ)


#: Elements of a building: an upright panel w wide and a shorter one at a right angle to its end, for each supplier.
ELEMENT_SIZE = {"w": "(s_acctbal + 1000.0) / 4000.0 + 0.2003717", "h": "2.0 + 0.1 * (s_nationkey % 5)"}
ELEMENT_NAMES = [*L.ELEMENT_CLASSES, "IfcRoof"]
ELEMENT_SQL = f"""e AS (SELECT s_suppkey AS element_id, ({ELEMENT_SIZE['w']})::DOUBLE AS w, ({ELEMENT_SIZE['h']})::DOUBLE AS h, [{', '.join(f"'{n}'" for n in ELEMENT_NAMES)}][s_suppkey % {len(ELEMENT_NAMES)} + 1] AS class_name FROM supplier),
    m AS (SELECT *, CASE class_name {' '.join(f"WHEN '{n}' THEN {i}" for n, i in L.ELEMENT_CLASSES.items())} END AS label FROM e)"""


def _elements(fx):
    """Labelled elements and their triangles. Two panels share the edge at the corner."""
    name = F.element_at(F.array(*[F.lit(n) for n in ELEMENT_NAMES]), (F.col("s_suppkey") % len(ELEMENT_NAMES) + 1).cast("int"))
    sized = fx.table("supplier").select(F.col("s_suppkey").alias("element_id"), *[F.expr(c).cast("double").alias(a) for a, c in ELEMENT_SIZE.items()], name.alias("class_name"))
    elements = M.label_elements(sized)
    zero, w, h = F.lit(0.0), F.col("w"), F.col("h")
    corners = [(zero, zero, zero), (w, zero, zero), (w, w / 2.0, zero), (zero, zero, h), (w, zero, h), (w, w / 2.0, h)]
    vertex = elements.select("element_id", F.posexplode(F.array(*[F.struct(*g.named_vec(list(c), *XYZ)) for c in corners])).alias("vid", "p")).select("element_id", "vid", "p.*")
    quads = F.array(*[F.struct(F.lit(i).alias("fid"), *[F.lit(v).alias(f"v{k}") for k, v in enumerate(q)]) for i, q in enumerate(((0, 1, 4, 3), (1, 2, 5, 4)))])
    quad = elements.select("element_id", F.explode(quads).alias("q")).select("element_id", "q.*")
    return elements, M.face_geometry(M.gather_corners(M.triangulate(quad), vertex, ["element_id"]))


@query(
    "c10_labelled_elements",
    f"""WITH {ELEMENT_SQL} SELECT element_id, label::BIGINT AS label, greatest(trunc(1.5 * w * h * 500.0)::BIGINT, 10) AS n, true AS spread, true AS on_surface, true AS shared FROM m WHERE label IS NOT NULL""",
)
def _(fx):
    """Samples at the documented density: their number, that none are closer than half the spacing of a perfect packing, that they lie on the panels,
    and that the panels share them by their areas."""
    elements, faces = _elements(fx)
    pts = M.sample_elements(faces, ["element_id"], ["fid", "half"]).join(elements, "element_id")
    pts = materialize(pts.select("element_id", "label", "w", "h", "fid", F.struct("fid", "half", "i").alias("id"), *XYZ), "samples")
    n = F.count(F.lit(1))
    # such points share one of the eight cells around a corner of the doubled grid
    sizes = pts.groupBy("element_id").agg(n.alias("n"))
    near = F.sqrt(1.5 * F.col("w") * F.col("h") / F.col("n") / (2.0 * 3.0**0.5))
    p = pts.join(sizes, "element_id").withColumn("near", near)
    cells = [F.explode(F.array(*[F.floor(F.col(a) / F.col("near")) + k for k in (0, 1)])).alias("g" + a) for a in XYZ]
    for c, a in zip(cells, XYZ):
        p = p.select("*", c)
    at = ["element_id", "gx", "gy", "gz"]
    mates = p.select(*at, F.col("id").alias("other"), *[F.col(a).alias("o" + a) for a in XYZ])
    gap = g.sub(g.vec(*XYZ), g.vec("ox", "oy", "oz"))
    crowded = p.join(mates, at).filter((F.col("id") < F.col("other")) & (g.dot(gap, gap) < F.col("near") * F.col("near"))).select("element_id").distinct().withColumn("crowded", F.lit(True))
    flat = F.when(F.col("fid") == 0, (F.abs("y") < 1e-9) & F.col("x").between(0, F.col("w"))).otherwise((F.abs(F.col("x") - F.col("w")) < 1e-9) & F.col("y").between(0, F.col("w") / 2.0))
    share = F.avg(F.when(F.col("fid") == 0, 1.0).otherwise(0.0))
    out = pts.groupBy("element_id", "label").agg(n.alias("n"), F.every(flat & F.col("z").between(-1e-9, F.col("h") + 1e-9)).alias("on_surface"), (F.abs(share - 2.0 / 3.0) < 1.0 / F.sqrt(n)).alias("shared"))
    return out.join(crowded, "element_id", "left").select("element_id", "label", "n", F.col("crowded").isNull().alias("spread"), "on_surface", "shared")


@query(
    "c11_zero_crossings",
    """WITH g AS (SELECT scene_id, ix, iy, iz, avg(sdf) AS s FROM fx_grid GROUP BY ALL),
    e AS (SELECT a.scene_id, 0::BIGINT AS axis, a.ix, a.iy, a.iz, a.s AS a, b.s AS b FROM g a JOIN g b ON a.scene_id = b.scene_id AND b.ix = a.ix + 1 AND b.iy = a.iy AND b.iz = a.iz
      UNION ALL SELECT a.scene_id, 1, a.ix, a.iy, a.iz, a.s, b.s FROM g a JOIN g b ON a.scene_id = b.scene_id AND b.ix = a.ix AND b.iy = a.iy + 1 AND b.iz = a.iz
      UNION ALL SELECT a.scene_id, 2, a.ix, a.iy, a.iz, a.s, b.s FROM g a JOIN g b ON a.scene_id = b.scene_id AND b.ix = a.ix AND b.iy = a.iy AND b.iz = a.iz + 1)
    SELECT scene_id, axis, ix, iy, iz, r4(ix + CASE WHEN axis = 0 THEN a/(a-b) ELSE 0.0 END) AS px, r4(iy + CASE WHEN axis = 1 THEN a/(a-b) ELSE 0.0 END) AS py, r4(iz + CASE WHEN axis = 2 THEN a/(a-b) ELSE 0.0 END) AS pz
    FROM e WHERE (a < 0 AND b >= 0) OR (a >= 0 AND b < 0)""",
)
def _(fx):
    z = M.zero_crossings(fx.grid, ["scene_id"])
    return z.select("scene_id", "axis", "ix", "iy", "iz", *[r4("p" + a).alias("p" + a) for a in XYZ])


@query(
    "c11_uniform_grid",
    """WITH b AS (SELECT object_id % 10 AS scene_id, min(v.x) AS lx, max(v.x) AS hx, min(v.y) AS ly, max(v.y) AS hy, min(v.z) AS lz, max(v.z) AS hz FROM fx_face f JOIN fx_vertex v ON v.vid = f.v0 GROUP BY 1),
    n AS (SELECT *, round_even((hx-lx+0.1)/0.5, 0)::BIGINT AS nx, round_even((hy-ly+0.1)/0.5, 0)::BIGINT AS ny, round_even((hz-lz+0.1)/0.5, 0)::BIGINT AS nz FROM b)
    SELECT scene_id, nx, ny, nz, r4(lx-0.05+(hx-lx+0.1)*i/(nx-1)) AS x, i AS ix FROM n, range(1000) t(i) WHERE i < nx""",
)
def _(fx):
    v = fx.face.select((F.col("object_id") % 10).alias("scene_id"), F.col("v0").alias("vid")).join(fx.vertex, "vid")
    b = v.groupBy("scene_id").agg(*[f(a).alias(n + a) for a in XYZ for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    grid = M.uniform_grid(b, 0.5)
    sizes = grid.groupBy("scene_id").agg(*[(F.max("i" + a) + 1).alias("n" + a) for a in XYZ])
    line = grid.filter("iy = 0 AND iz = 0").select("scene_id", "ix", r4("x").alias("x"))
    return sizes.join(line, "scene_id").select("scene_id", "nx", "ny", "nz", "x", "ix")


# -- visibility --------------------------------------------------------------------------------

#: Pairs are listed for the newest camera of every user; what is counted or reduced meets every camera.
SEEN_SQL = f"vis AS (SELECT * FROM ({UV_SQL.replace('fx_view', 'fx_current')}) WHERE -z >= 0 AND u < 8 AND u > 0 AND v < 12 AND v > 0)"


def _visible(fx, views, **kw):
    return V.visible_points(views, fx.keyed_cloud, CAMERA, ["scene_id"], ["frame"], ["point_id"], **kw)


@query("j06_visible_pairs", f"WITH {SEEN_SQL} SELECT frame, point_id, round(u, 2) AS u, round(v, 2) AS v, r4(z) AS z FROM vis")
def _(fx):
    return _visible(fx, fx.current).select("frame", "point_id", F.round("u", 2).alias("u"), F.round("v", 2).alias("v"), r4("z").alias("z"))


@query(
    "f05_frustum_strict_front",
    f"SELECT frame, count(*) AS n FROM ({UV_SQL.replace('fx_view', 'fx_current')}) WHERE z < 0 AND u < 7 AND u > 1 AND v < 11 AND v > 1 GROUP BY frame",
)
def _(fx):
    seen = counts_in_view(fx.current, fx.keyed_cloud, CAMERA, ["scene_id"], ["frame"], edge=1.0)
    return seen.groupBy("frame").agg(F.sum("n").alias("n"))


OCCLUDED_SQL = f"""WITH {SEEN_SQL}, s AS (SELECT *, u/8.0*7.0 AS sx, v/12.0*11.0 AS sy FROM vis), f AS (SELECT *, floor(sx)::BIGINT AS u0, floor(sy)::BIGINT AS v0, sx-floor(sx) AS ax, sy-floor(sy) AS ay FROM s),
    d AS (SELECT f.*, (1-ax)*(1-ay)*coalesce(p00.depth,0.0) + (1-ax)*ay*coalesce(p01.depth,0.0) + ax*(1-ay)*coalesce(p10.depth,0.0) + ax*ay*coalesce(p11.depth,0.0) AS ds FROM f
      LEFT JOIN fx_pixel p00 ON p00.frame = f.image AND p00.u = u0 AND p00.v = v0 LEFT JOIN fx_pixel p01 ON p01.frame = f.image AND p01.u = u0 AND p01.v = v0 + 1
      LEFT JOIN fx_pixel p10 ON p10.frame = f.image AND p10.u = u0 + 1 AND p10.v = v0 LEFT JOIN fx_pixel p11 ON p11.frame = f.image AND p11.u = u0 + 1 AND p11.v = v0 + 1),
    ok AS (SELECT * FROM d WHERE ds + 0.06 >= -z)"""


def _unoccluded(fx):
    depth = fx.pixel.withColumnRenamed("frame", "image")
    return unoccluded_points(fx.current, fx.keyed_cloud, depth, CAMERA, ["scene_id"], ["frame"], ["image"], ["point_id"], 0.06)


@query("f06_occlusion_test", OCCLUDED_SQL + " SELECT frame, point_id, r4(ds) AS depth_sample FROM ok")
def _(fx):
    return _unoccluded(fx).select("frame", "point_id", r4("depth_sample").alias("depth_sample"))


#: The cloud spread over three times the room's size, so that some of it is out of every camera's sight.
FAR_CLOUD_SQL = "(SELECT point_id, scene_id, label, 3.0*x AS x, 3.0*y AS y, 3.0*z - 3.0 AS z FROM fx_keyed_cloud)"


def _spread(points, *keep):
    return points.select(*keep, *[(F.col(a) * 3.0 - (3.0 if a == "z" else 0.0)).alias(a) for a in XYZ])


@query(
    "u03_never_seen_points",
    f"""WITH vis AS (SELECT DISTINCT point_id FROM ({UV_SQL.replace("fx_keyed_cloud c", FAR_CLOUD_SQL + " c")}) WHERE -z >= 0 AND u < 8 AND u > 0 AND v < 12 AND v > 0)
    SELECT point_id, label FROM fx_keyed_cloud WHERE point_id NOT IN (SELECT point_id FROM vis)""",
)
def _(fx):
    cloud = _spread(fx.keyed_cloud, "point_id", "scene_id", "label")
    seen = V.seen_by_any(fx.view, cloud, CAMERA, ["scene_id"], ["frame"], ["point_id"])
    return cloud.join(seen.select("point_id"), "point_id", "left_anti").select("point_id", "label")


#: The mesh spread over three times the room's size, so that much of it is out of sight or behind what the cameras measured.
SPREAD_SQL = "(SELECT vid, 3.0*x AS x, 3.0*y AS y, 3.0*z - 3.0 AS z FROM fx_vertex)"
CORNER_SQL = " ".join(f"LEFT JOIN fx_pixel p{a}{b} ON p{a}{b}.frame = f.image AND p{a}{b}.u = u0 + {a} AND p{a}{b}.v = v0 + {b}" for a in (0, 1) for b in (0, 1))
CULL_SQL = f"""WITH w AS (SELECT v.vid, image, (r00*(x-tx)+r10*(y-ty)+r20*(z-tz)) AS cx, (r01*(x-tx)+r11*(y-ty)+r21*(z-tz)) AS cy, (r02*(x-tx)+r12*(y-ty)+r22*(z-tz)) AS cz FROM {SPREAD_SQL} v, fx_view),
    vis AS (SELECT * FROM (SELECT vid, image, (6.0*(-cx)+3.5*cz)/(cz+1e-5) AS u, (6.0*cy+5.5*cz)/(cz+1e-5) AS v, cz+1e-5 AS z FROM w) WHERE -z >= 0 AND u < 8 AND u > 0 AND v < 12 AND v > 0),
    f AS (SELECT *, floor(u/8.0*7.0)::BIGINT AS u0, floor(v/12.0*11.0)::BIGINT AS v0, u/8.0*7.0-floor(u/8.0*7.0) AS ax, v/12.0*11.0-floor(v/12.0*11.0) AS ay FROM vis),
    seen AS (SELECT DISTINCT vid FROM f {CORNER_SQL}
      WHERE (1-ax)*(1-ay)*coalesce(p00.depth,0.0) + (1-ax)*ay*coalesce(p01.depth,0.0) + ax*(1-ay)*coalesce(p10.depth,0.0) + ax*ay*coalesce(p11.depth,0.0) + 0.06 >= -z),
    kept AS (SELECT t.* FROM {TRI_SQL} t WHERE a IN (SELECT vid FROM seen) OR b IN (SELECT vid FROM seen) OR c IN (SELECT vid FROM seen)),
    used AS (SELECT DISTINCT v FROM (SELECT a AS v FROM kept UNION ALL SELECT b FROM kept UNION ALL SELECT c FROM kept)),
    idx AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS n FROM used)"""


def _culled(fx):
    spread = _spread(fx.vertex, "vid")
    depth = fx.pixel.withColumnRenamed("frame", "image")
    seen = V.seen_by_any(fx.view, spread, CAMERA, [], ["frame"], ["vid"], depth, ["image"], 0.06)
    return M.cull_faces(M.triangulate(fx.face), seen.select("vid"))


@query("c05_mesh_culling", CULL_SQL + " SELECT fid, half, x.n AS v0, y.n AS v1, z.n AS v2 FROM kept JOIN idx x ON x.v = a JOIN idx y ON y.v = b JOIN idx z ON z.v = c")
def _(fx):
    return M.reindex(fx.vertex, _culled(fx))[1].select("fid", "half", "v0", "v1", "v2")


@query("w10_dense_reindex", f"WITH used AS (SELECT DISTINCT v FROM (SELECT a AS v FROM {TRI_SQL} UNION ALL SELECT b FROM {TRI_SQL} UNION ALL SELECT c FROM {TRI_SQL})) SELECT v AS vid, row_number() OVER (ORDER BY v) - 1 AS new_vid FROM used JOIN fx_vertex ON vid = v")
def _(fx):
    return M.reindex(fx.vertex, M.triangulate(fx.face))[0].select("vid", "new_vid")


SAMPLES_SQL = f"""smp AS (SELECT w.frame, w.scene_id, p.event_id, i, tx+{RAY['x']}*zz AS x, ty+{RAY['y']}*zz AS y, tz+{RAY['z']}*zz AS z FROM
      (SELECT *, depth*0.8*(1-i/7.0)+(depth+0.5)*(i/7.0) AS zz FROM fx_pixel, range(8) t(i) WHERE depth > 0) p JOIN fx_current w ON p.frame = w.image)"""


def _overlap(fx):
    p = fx.pixel.withColumnRenamed("frame", "image").join(fx.current, "image")
    keep = ["frame", "scene_id", "event_id", "u", "v", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]
    s = overlap_samples(p, keep=keep)
    d = g.pixel_ray(F.col("u").cast("double"), F.col("v").cast("double"), CAMERA, g.mat("r"))
    pts = g.add(g.vec("tx", "ty", "tz"), g.scale(d, F.col("z")))
    samples = s.select("scene_id", "frame", (F.col("event_id") * 8 + F.col("k")).alias("point_id"), *[c.alias(a) for a, c in zip(XYZ, pts)])
    kf = fx.view.withColumnRenamed("frame", "kf")
    return V.overlap_fraction(samples, kf, CAMERA, ["scene_id"], edge=1.0), kf


@query(
    "a26_keyframe_overlap",
    f"""WITH {SAMPLES_SQL}, kf AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY frame DESC) AS rn FROM fx_view),
    c AS (SELECT s.frame, k.frame AS kf, r00*(x-tx)+r10*(y-ty)+r20*(z-tz) AS cx, r01*(x-tx)+r11*(y-ty)+r21*(z-tz) AS cy, r02*(x-tx)+r12*(y-ty)+r22*(z-tz) AS cz FROM smp s JOIN kf k ON k.scene_id = s.scene_id AND k.rn > 2),
    q AS (SELECT frame, kf, (6.0*(-cx)+3.5*cz)/(cz+1e-5) AS u, (6.0*cy+5.5*cz)/(cz+1e-5) AS v, cz+1e-5 AS z FROM c)
    SELECT frame, kf, sum(CASE WHEN z < 0 AND u < 7 AND u > 1 AND v < 11 AND v > 1 THEN 1 ELSE 0 END)::BIGINT AS inside, count(*) AS total FROM q GROUP BY frame, kf HAVING inside > 0""",
)
def _(fx):
    return _overlap(fx)[0].select("frame", "kf", "inside", "total")


@query("t04_keyframe_pick")
def _(fx):
    overlap, kf = _overlap(fx)
    return sampling.pick_keyframes(overlap, kf, 4, ["scene_id"])


#: Widths off the short decimals, so that no voxel's centre falls on a pixel's edge.
@query(
    "a28_voxel_fusion",
    f"""WITH p AS (SELECT scene_id, frame, {', '.join(f't{a}+{RAY[a]}*depth AS {a}' for a in XYZ)} FROM fx_view_pixel WHERE depth > 0 AND u % 2 = 0 AND v % 2 = 0),
    lo AS (SELECT scene_id, frame, {', '.join(f'floor(({a}-0.4007)/0.8012)::BIGINT AS l{a}, floor(({a}+0.4007)/0.8012)::BIGINT AS h{a}' for a in XYZ)} FROM p),
    blk AS (SELECT DISTINCT scene_id, frame, lx + i AS gx, ly + j AS gy, lz + k AS gz FROM lo, range(3) a(i), range(3) b(j), range(3) c(k) WHERE lx + i <= hx AND ly + j <= hy AND lz + k <= hz),
    vox AS (SELECT scene_id, frame, gx * 4 + i AS cx, gy * 4 + j AS cy, gz * 4 + k AS cz FROM blk, range(4) a(i), range(4) b(j), range(4) c(k)),
    ctr AS (SELECT v.*, image, (cx+0.5)*0.2003::DOUBLE-tx AS x, (cy+0.5)*0.2003::DOUBLE-ty AS y, (cz+0.5)*0.2003::DOUBLE-tz AS z, r00, r01, r02, r10, r11, r12, r20, r21, r22 FROM vox v JOIN fx_view w ON w.frame = v.frame),
    cam AS (SELECT scene_id, image, cx, cy, cz, r00*x+r10*y+r20*z AS px, r01*x+r11*y+r21*z AS py, -(r02*x+r12*y+r22*z) AS pz FROM ctr),
    pix AS (SELECT *, floor(3.5+6.0*px/pz+0.5)::BIGINT AS u, floor(5.5-6.0*py/pz+0.5)::BIGINT AS v FROM cam WHERE pz > 0),
    d AS (SELECT scene_id, cx, cy, cz, (depth-pz)*sqrt(1.0+((q.u-3.5)/6.0)*((q.u-3.5)/6.0)+((q.v-5.5)/6.0)*((q.v-5.5)/6.0)) AS far FROM pix JOIN fx_pixel q ON q.frame = image AND q.u = pix.u AND q.v = pix.v
      WHERE depth > 0 AND pix.u BETWEEN 0 AND 7 AND pix.v BETWEEN 0 AND 11)
    SELECT scene_id, cx, cy, cz, count(*) AS frames, r4(avg(least(1.0, far/0.4007))) AS sdf FROM d WHERE far > -0.4007 GROUP BY scene_id, cx, cy, cz""",
)
def _(fx):
    depth = fx.pixel.withColumnRenamed("frame", "image")
    out = V.fused_voxels(depth, fx.view, CAMERA, ["scene_id"], ["frame"], ["image"], 0.2003, 0.4007, side=4, stride=2)
    return out.select("scene_id", "cx", "cy", "cz", "frames", r4("sdf").alias("sdf"))
