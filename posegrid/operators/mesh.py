"""Triangle and quad meshes as vertex and face tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rand
from ..functions.labels import ELEMENT_CLASSES
from ..session import materialize
from .elimination import reaches, spread_subset
from .neighbors import XYZ
from .ordered import rank_within
from .skew import small_table


def triangulate(quads: DataFrame) -> DataFrame:
    """Fan split of quads; the second triangle is numbered after all first ones (``half`` 1)."""
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c")),
        F.struct(F.lit(1).alias("half"), F.col("v0").alias("a"), F.col("v2").alias("b"), F.col("v3").alias("c")),
    )
    rest = [c for c in quads.columns if c not in ("v0", "v1", "v2", "v3")]
    return quads.select(*rest, F.explode(halves).alias("t")).select(*rest, "t.half", F.col("t.a").alias("v0"), F.col("t.b").alias("v1"), F.col("t.c").alias("v2"))


def gather_corners(triangles: DataFrame, vertices: DataFrame, keys=(), carry=XYZ) -> DataFrame:
    """Vertex values of the three corners as ``p0x .. p2z``; one keyed join per corner."""
    keys = list(keys)
    out = triangles
    table = vertices.select(*keys, "vid", *carry)
    for i in range(3):
        v = table.select(*keys, F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"p{i}{c}") for c in carry])
        out = out.join(v, keys + [f"v{i}"])
    return out


def face_geometry(corners: DataFrame) -> DataFrame:
    n, area = g.triangle_normal_area(*[g.vec(*[f"p{i}{a}" for a in XYZ]) for i in range(3)])
    return corners.withColumns({"nx": n[0], "ny": n[1], "nz": n[2], "area": area})


FACES_PER_BLOCK = 1 << 18


def surface_counts(faces: DataFrame, keys, n_points: int | Column) -> DataFrame:
    """Expected samples per face, n * area / total area of its key."""
    keys = list(keys)
    total = faces.groupBy(*keys).agg(F.sum("area").alias("_total"))
    n = F.lit(float(n_points)) if isinstance(n_points, int) else n_points
    if not keys:
        faces, total, keys = faces.withColumn("_k", F.lit(0)), total.withColumn("_k", F.lit(0)), ["_k"]
    return faces.join(small_table(total), keys).withColumn("expected", F.try_divide(n * F.col("area"), F.col("_total"))).drop("_total", "_k")


def sample_surface(faces: DataFrame, keys, n_points: int | Column, face_id, seed: int = 0) -> DataFrame:
    """Exactly ``n_points`` uniform surface points per key (none where it has no area), with face normals.

    A face gets the whole numbers its share of the running expectation passes. The running sum is cut into blocks of hashed faces, so
    a key with most of the faces is many tasks' work.
    """
    face_id, keys = list(face_id), list(keys)
    f = surface_counts(faces, keys, n_points).withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    if not keys:
        f, keys = f.withColumn("_k", F.lit(0)), ["_k"]
    sized = f.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / FACES_PER_BLOCK).cast("int").alias("_blocks"))
    f = f.join(sized, keys).withColumn("_blk", F.pmod(F.xxhash64(*face_id), F.col("_blocks"))).drop("_blocks")
    earlier = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    carry = f.groupBy(*keys, "_blk").agg(F.sum("expected").alias("_s")).select(*keys, "_blk", F.coalesce(earlier, F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*face_id)
    total = lambda end: F.coalesce(F.sum("expected").over(inside.rowsBetween(Window.unboundedPreceding, end)), F.lit(0.0))
    f = f.join(carry, [*keys, "_blk"]).withColumn("_upto", F.col("_before") + total(0)).withColumn("_from", F.col("_before") + total(-1))
    # sums of fractions end a little beside the whole number they stand for
    f = f.withColumn("_n", F.floor(F.col("_upto") + 1e-6) - F.floor(F.col("_from") + 1e-6)).filter(F.col("_n") > 0)
    f = f.drop("_before", "_upto", "_from", "_blk", "_k")
    s = f.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    u = F.sqrt(rand.uniform(*face_id, "i", seed=seed + 1))
    v = rand.uniform(*face_id, "i", seed=seed + 2)
    a, b, c = 1.0 - u, u * (1.0 - v), u * v
    pos = {x: a * F.col("p0" + x) + b * F.col("p1" + x) + c * F.col("p2" + x) for x in XYZ}
    return s.withColumns(pos).drop("_n", "expected")


def element_sizes(faces: DataFrame, keys, density: float = 500.0, minimum: int = 10) -> DataFrame:
    """Samples per element: area times density, at least ``minimum``."""
    n = F.greatest((F.sum("area") * density).cast("long"), F.lit(minimum).cast("long"))
    return faces.groupBy(*keys).agg(F.sum("area").alias("area"), n.alias("n"))


def sample_elements(faces: DataFrame, keys, face_id, density: float = 500.0, minimum: int = 10, oversample: int = 5, seed: int = 0) -> DataFrame:
    """Evenly spread samples per element: draw five times too many, eliminate the most crowded until the wanted count is left."""
    keys, face_id = list(keys), list(face_id)
    sizes = element_sizes(faces, keys, density, minimum)
    f = faces.join(small_table(sizes.select(*keys, F.col("n").alias("_want"), F.col("area").alias("_area"))), keys)
    drawn = sample_surface(f, keys, F.col("_want") * float(oversample), face_id, seed)
    reach, least = reaches(F.col("_area"), F.col("_want"), oversample)
    drawn = materialize(drawn.withColumns({"_reach": reach, "_least": least}), "drawn")
    return spread_subset(drawn, keys, [*face_id, "i"], "_want").drop("_want", "_area", "_reach", "_least")


def label_elements(elements: DataFrame, name: str = "class_name") -> DataFrame:
    """Elements whose class has an id, with it as ``label``; elements of other classes have no samples."""
    pairs = [F.lit(x) for kv in ELEMENT_CLASSES.items() for x in kv]
    return elements.withColumn("label", F.create_map(*pairs)[F.col(name)]).filter(F.col("label").isNotNull())


def reindex(vertices: DataFrame, faces: DataFrame, keys=()) -> tuple[DataFrame, DataFrame]:
    """Drop unreferenced vertices, number the rest densely per key, rewrite the faces."""
    keys = list(keys)
    used = faces.select(*keys, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    kept = rank_within(vertices.join(used, keys + ["vid"], "left_semi"), keys, ["vid"], "new_vid")
    out = faces
    for i in range(3):
        m = kept.select(*keys, F.col("vid").alias(f"v{i}"), F.col("new_vid").alias(f"_n{i}"))
        out = out.join(m, keys + [f"v{i}"])
    out = out.drop("v0", "v1", "v2").withColumnsRenamed({f"_n{i}": f"v{i}" for i in range(3)})
    return kept, out


def cull_faces(triangles: DataFrame, seen: DataFrame, keys=()) -> DataFrame:
    """Keep triangles with at least one seen corner. ``seen`` lists (keys, vid) once each."""
    keys = list(keys)
    out = triangles
    mark = seen.select(*keys, "vid").distinct()
    for i in range(3):
        m = mark.select(*keys, F.col("vid").alias(f"v{i}"), F.lit(True).alias(f"_s{i}"))
        out = out.join(m, keys + [f"v{i}"], "left")
    any_seen = F.coalesce("_s0", F.lit(False)) | F.coalesce("_s1", F.lit(False)) | F.coalesce("_s2", F.lit(False))
    return out.filter(any_seen).drop("_s0", "_s1", "_s2")


def uniform_grid(bounds: DataFrame, resolution: float, padding: float = 0.05) -> DataFrame:
    """Lattice nodes of each bound row (``lo_x .. hi_z``), end points included."""
    out = bounds
    for a in XYZ:
        lo, hi = F.col("lo_" + a) - padding, F.col("hi_" + a) + padding
        n = F.rint((hi - lo) / resolution).cast("long")
        out = out.withColumns({"_n" + a: n, "_a" + a: lo, "_b" + a: hi})
        out = out.withColumn("i" + a, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n" + a) - 1)))
        out = out.withColumn(a, F.col("_a" + a) + (F.col("_b" + a) - F.col("_a" + a)) * F.col("i" + a) / F.greatest(F.col("_n" + a) - 1, F.lit(1)))
    return out.drop(*[p + a for p in ("_n", "_a", "_b", "lo_", "hi_") for a in XYZ])


def zero_crossings(grid: DataFrame, keys=(), level: float = 0.0) -> DataFrame:
    """Crossing position on every lattice edge whose ends lie on different sides of the level."""
    keys = list(keys)
    base = grid.select(*keys, "ix", "iy", "iz", "sdf")
    # Each node is sent to its lower neighbour on every axis and to itself, then edges meet by key.
    ends = base.withColumn(
        "e",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("axis"), F.lit(end).alias("end"),
                        *[(F.col(i) - (end if n == k else 0)).alias(i) for n, i in enumerate(("ix", "iy", "iz"))],
                    )
                    for k in range(3)
                    for end in (0, 1)
                ]
            )
        ),
    ).select(*keys, "e.*", "sdf")
    edges = ends.groupBy(*keys, "axis", "ix", "iy", "iz").agg(
        F.max(F.when(F.col("end") == 0, F.col("sdf"))).alias("s0"), F.max(F.when(F.col("end") == 1, F.col("sdf"))).alias("s1")
    )
    a, b = F.col("s0") - level, F.col("s1") - level
    t = a / (a - b)
    crossing = edges.filter(((a < 0) & (b >= 0)) | ((a >= 0) & (b < 0)))
    return crossing.select(
        *keys, "axis", "ix", "iy", "iz", *[(F.col(i) + F.when(F.col("axis") == k, t).otherwise(0.0)).alias("p" + i[1]) for k, i in enumerate(("ix", "iy", "iz"))]
    )
