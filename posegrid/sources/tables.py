"""Tabular sources and exports: pixels, class info, meshes, clouds."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as g
from ..functions import labels as L
from ..functions import rand
from ..operators import mesh as M
from ..operators.cloud import color_to_label, subset


def scale_pixels(pixels: DataFrame, depth_scale: float = 1000.0, scale: float = 1.0) -> DataFrame:
    """Colours to 0..1 and stored depth units to scene units."""
    return pixels.withColumns({c: F.col(c) / 255.0 for c in ("r", "g", "b")} | {"depth": F.col("depth") / depth_scale * scale})


def read_pixels(spark: SparkSession, path: str, depth_scale: float = 1000.0, scale: float = 1.0) -> DataFrame:
    return scale_pixels(schemas.conform(spark.read.parquet(path), schemas.PIXEL, "pixel"), depth_scale, scale)


def read_class_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(instance -> class id, class id -> name) from a scene's information file."""
    info = spark.read.schema(schemas.CLASS_INFO).json(path, multiLine=True)
    instances = info.select(F.posexplode("id_to_label").alias("instance", "class_id"))
    names = info.select(F.explode("classes").alias("c")).select(F.col("c.id").alias("class_id"), F.col("c.name").alias("name"))
    return instances, names


def instance_labels(faces: DataFrame, instances: DataFrame, class_to_six: dict[int, int]) -> DataFrame:
    """Two-hop label per face; unknown instances and classes become background."""
    i = instances.select(F.col("instance").cast("long").alias("object_id"), "class_id")
    out = faces.drop("label").join(i, "object_id", "left")
    return out.withColumn("label", L.int_map(F.col("class_id"), class_to_six, 0).cast("int")).drop("class_id")


def read_mesh(spark: SparkSession, vertex_path: str, face_path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces; faces with a fourth corner ``v3`` are quads and keep it."""
    v = schemas.conform(spark.read.parquet(vertex_path), schemas.VERTEX, "vertex")
    faces = spark.read.parquet(face_path)
    return v, schemas.conform(faces, schemas.QUAD if "v3" in faces.columns else schemas.FACE, "face")


def export_rows(cloud: DataFrame, hide=(4,)) -> DataFrame:
    """Rows of a labelled export: hidden classes dropped, single-precision coordinates."""
    shown = cloud.filter(~F.col("label").isin(list(hide))) if hide else cloud
    cols = {a: F.col(a).cast("float") for a in ("x", "y", "z")} | {"label": F.col("label").cast("float")}
    return shown.withColumns(cols)


def export_cloud(cloud: DataFrame, path: str, hide=(4,), fmt: str = "parquet") -> bool:
    """Write the export partitioned by label; an empty result warns and writes nothing."""
    rows = export_rows(cloud, hide)
    if rows.isEmpty():
        warnings.warn("no points left after hiding labels", stacklevel=2)
        return False
    rows.write.mode("overwrite").partitionBy("label").format(fmt).save(path)
    return True


def object_triangles(quads: DataFrame) -> DataFrame:
    """Triangles per object; the second triangle of a quad is numbered after all the first ones."""
    n = quads.count()
    t = M.triangulate(quads)
    return t.withColumn("tri_id", F.col("fid") + F.col("half") * n)


def export_objects(quads: DataFrame, vertices: DataFrame, path: str) -> None:
    """One folder per object with its gathered triangles."""
    M.gather_corners(object_triangles(quads), vertices).write.mode("overwrite").partitionBy("object_id").parquet(path)


def mesh_cloud(vertices: DataFrame, triangles: DataFrame, n_points: int, seed: int = 0) -> DataFrame:
    """Source cloud of a coloured mesh: uniform surface samples labelled by interpolated colour."""
    geo = M.face_geometry(M.gather_corners(triangles, vertices, carry=("x", "y", "z", "r", "g", "b")))
    s = M.sample_surface(geo, [], n_points, ["fid"], seed)
    # Barycentric weights of the sample, recovered from its draws.
    u, v = F.sqrt(rand.uniform("fid", "i", seed=seed + 1)), rand.uniform("fid", "i", seed=seed + 2)
    w = [1.0 - u, u * (1.0 - v), u * v]
    s = s.withColumns({c: w[0] * F.col("p0" + c) + w[1] * F.col("p1" + c) + w[2] * F.col("p2" + c) for c in ("r", "g", "b")})
    out = color_to_label(s)
    return schemas.conform(out.withColumn("point_id", F.xxhash64("fid", "i")), schemas.CLOUD, "cloud")


def reference_cloud(vertices: DataFrame, quads: DataFrame, instances: DataFrame, class_to_six: dict[int, int], n_points: int, structural_only: bool = True, keep=None, seed: int = 0) -> DataFrame:
    """Reference cloud: two-hop labels, structural faces kept before sampling, triangles, samples."""
    labelled = instance_labels(quads, instances, class_to_six)
    if keep is not None:
        labelled = subset(labelled, keep, strict=True)
    elif structural_only:
        labelled = subset(labelled, L.STRUCTURAL, strict=True)
    geo = M.face_geometry(M.gather_corners(M.triangulate(labelled), vertices))
    s = M.sample_surface(geo, [], n_points, ["fid", "half"], seed)
    return schemas.conform(s.withColumn("point_id", F.xxhash64("fid", "half", "i")), schemas.CLOUD, "cloud")


def _cloud_table(spark: SparkSession, path: str, **_) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.CLOUD, "cloud")


def _mesh_source(spark: SparkSession, vertex_path: str, face_path: str, n_points: int = 200_000, seed: int = 0) -> DataFrame:
    v, f = read_mesh(spark, vertex_path, face_path)
    t = M.triangulate(f).withColumn("fid", F.col("fid") * 2 + F.col("half")) if "v3" in f.columns else f
    return mesh_cloud(v, t, n_points, seed)


def _labelled_mesh(spark: SparkSession, vertex_path: str, face_path: str, info_path: str, class_to_six, n_points: int = 200_000, structural_only: bool = True, keep=None, seed: int = 0) -> DataFrame:
    v, f = read_mesh(spark, vertex_path, face_path)
    return reference_cloud(v, f, read_class_info(spark, info_path)[0], class_to_six, n_points, structural_only, keep, seed)


def _elements(spark: SparkSession, path: str, **_) -> DataFrame:
    """Element samples carry building-element ids; they are bridged to the six classes."""
    c = schemas.conform(spark.read.parquet(path), schemas.CLOUD, "cloud")
    return c.withColumn("label", L.int_map(F.col("label"), L.ELEMENT_TO_SIX, 0).cast("int"))


CLOUD_SOURCES = {"table": _cloud_table, "colored_mesh": _mesh_source, "labelled_mesh": _labelled_mesh, "elements": _elements}


def load_cloud(spark: SparkSession, kind: str, **options) -> DataFrame:
    """A cloud from any source kind; unknown kinds raise."""
    if kind not in CLOUD_SOURCES:
        raise ValueError(f"unknown cloud source {kind!r}; known: {sorted(CLOUD_SOURCES)}")
    return CLOUD_SOURCES[kind](spark, **options)


def normals_complete(cloud: DataFrame) -> bool:
    """True when every point has a normal, False when none has; a mix raises."""
    n, have = cloud.agg(F.count(F.lit(1)), F.count("nx")).first()
    if have not in (0, n):
        raise ValueError(f"{n - have} of {n} points lack a normal")
    return n > 0 and have == n


def camera_after_resize(cam: g.Camera, height: int | None, width: int | None, edge: int = 0) -> g.Camera:
    out = cam if height is None else cam.resized(height, width)
    return out.cropped(edge) if edge else out
