"""Small linear algebra written as column expressions.

A matrix is a 3x3 nested list of columns and a vector a list of three; everything below stays
inside code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list
Mat = list

AXES = range(3)


@dataclass(frozen=True)
class Camera:
    """Pinhole intrinsics; job parameters, so they travel as literals and need no join."""

    H: int
    W: int
    fx: float
    fy: float
    cx: float
    cy: float

    def resized(self, height: int, width: int) -> "Camera":
        sx, sy = width / self.W, height / self.H
        return Camera(height, width, self.fx * sx, self.fy * sy, self.cx * sx, self.cy * sy)

    def cropped(self, edge: int) -> "Camera":
        return Camera(self.H - 2 * edge, self.W - 2 * edge, self.fx, self.fy, self.cx - edge, self.cy - edge)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def vec(*names) -> Vec:
    return [col(n) for n in names]


def mat(prefix: str) -> Mat:
    """Columns ``<prefix>00 .. <prefix>22``."""
    return [[F.col(f"{prefix}{i}{j}") for j in AXES] for i in AXES]


def add(a, b):
    return [x + y for x, y in zip(a, b)]


def sub(a, b):
    return [x - y for x, y in zip(a, b)]


def scale(a, s):
    return [x * s for x in a]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cross(a, b) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a, eps: float = 1e-12) -> Vec:
    n = norm(a) + eps
    return [x / n for x in a]


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def mat_vec(m: Mat, v: Vec) -> Vec:
    return [dot(row, v) for row in m]


def transpose(m: Mat) -> Mat:
    return [[m[j][i] for j in AXES] for i in AXES]


def mat_mul(a: Mat, b: Mat) -> Mat:
    bt = transpose(b)
    return [[dot(row, c) for c in bt] for row in a]


def det(m: Mat) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def trace_of_product_t(a: Mat, b: Mat) -> Column:
    """trace(a b^T)."""
    return dot(a[0], b[0]) + dot(a[1], b[1]) + dot(a[2], b[2])


def named(m: Mat, prefix: str) -> list[Column]:
    return [m[i][j].alias(f"{prefix}{i}{j}") for i in AXES for j in AXES]


def named_vec(v: Vec, *names: str) -> list[Column]:
    return [x.alias(n) for x, n in zip(v, names)]


def floats(values) -> Mat:
    return [[F.lit(float(x)) for x in row] for row in values]


def rot_z(angle: Column) -> Mat:
    zero, one = F.lit(0.0), F.lit(1.0)
    c, s = F.cos(angle), F.sin(angle)
    return [[c, -s, zero], [s, c, zero], [zero, zero, one]]


def axis_rotation(axis: Vec, angle: Column) -> Mat:
    """Rodrigues rotation about a unit axis."""
    x, y, z = axis
    zero = F.lit(0.0)
    k = [[zero, -z, y], [z, zero, -x], [-y, x, zero]]
    kk = mat_mul(k, k)
    s, c1 = F.sin(angle), 1.0 - F.cos(angle)
    return [[F.lit(1.0 if i == j else 0.0) + s * k[i][j] + c1 * kk[i][j] for j in AXES] for i in AXES]


# -- similarity transforms -------------------------------------------------------------------


def sim3(prefix: str = "m", t: str = "t") -> tuple[Mat, Vec]:
    return mat(prefix), [F.col(f"{t}{i}") for i in AXES]


def make_sim3(rot: Mat, trans: Vec, s) -> tuple[Mat, Vec]:
    return [[x * s for x in row] for row in rot], trans


def apply_sim3(m: Mat, t: Vec, p: Vec) -> Vec:
    return add(mat_vec(m, p), t)


def sim3_scale(m: Mat) -> Column:
    return F.cbrt(F.greatest(det(m), F.lit(1e-18)))


def sim3_rotation(m: Mat) -> Mat:
    """The rotation of an exact similarity; drifted input goes through ``linalg.orthonormalize``."""
    s = sim3_scale(m)
    return [[x / s for x in row] for row in m]


def compose_sim3(a: tuple[Mat, Vec], b: tuple[Mat, Vec]) -> tuple[Mat, Vec]:
    return mat_mul(a[0], b[0]), add(mat_vec(a[0], b[1]), a[1])


def invert_sim3(m: Mat, t: Vec) -> tuple[Mat, Vec]:
    s = sim3_scale(m)
    ri = transpose(sim3_rotation(m))
    si = F.lit(1.0) / s
    return [[x * si for x in row] for row in ri], [-(si * x) for x in mat_vec(ri, t)]


def rotation_error_deg(ra: Mat, rb: Mat) -> Column:
    return F.degrees(F.acos(clip((trace_of_product_t(ra, rb) - 1.0) / 2.0, -1.0, 1.0)))


def sim3_errors(est: tuple[Mat, Vec], ref: tuple[Mat, Vec]) -> dict[str, Column]:
    """Rotation angle in degrees, translation distance, relative scale difference."""
    return {
        "rot_deg": rotation_error_deg(sim3_rotation(est[0]), sim3_rotation(ref[0])),
        "trans": norm(sub(est[1], ref[1])),
        "scale_ratio": F.abs(sim3_scale(est[0]) / sim3_scale(ref[0]) - 1.0),
    }


def angle_between_deg(u: Vec, v: Vec) -> Column:
    """Angle that treats a vector and its negative as equal."""
    return F.degrees(F.acos(clip(F.abs(dot(unit(u), unit(v))), -1.0, 1.0)))


def tukey_weight(d: Column, c: float) -> Column:
    r = clip(d / max(c, 1e-9), 0.0, 1.0)
    w = 1.0 - r * r
    return w * w


# -- rigid poses ------------------------------------------------------------------------------


def rigid_inverse(r: Mat, t: Vec) -> tuple[Mat, Vec]:
    rt = transpose(r)
    return rt, [-x for x in mat_vec(rt, t)]


def flip_camera(r: Mat) -> Mat:
    """Negate the second and third columns (y-down/z-forward to y-up/z-backward and back)."""
    return [[row[0], -row[1], -row[2]] for row in r]


# Y-up to z-up world rotation, the shortest turn taking (0,-1,0) to (0,0,-1).
YUP_TO_ZUP = [[1, 0, 0], [0, 0, -1], [0, 1, 0]]


def world_to_yup(r: Mat, t: Vec) -> tuple[Mat, Vec]:
    """Camera-to-world pose in the z-up frame to the y-up simulator frame."""
    m = transpose(floats(YUP_TO_ZUP))
    return flip_camera(mat_mul(m, r)), mat_vec(m, t)


def yup_to_world(r: Mat, t: Vec) -> tuple[Mat, Vec]:
    m = floats(YUP_TO_ZUP)
    return flip_camera(mat_mul(m, r)), mat_vec(m, t)


def quat_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Mat:
    """Rotation matrix of a quaternion, normalised first."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [
        [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y)],
        [2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x)],
        [2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)],
    ]


def matrix_to_quat(m: Mat) -> Vec:
    """(w, x, y, z) from the largest component, so no division is ill-conditioned."""
    d0, d1, d2 = m[0][0], m[1][1], m[2][2]
    q2 = [1.0 + d0 + d1 + d2, 1.0 + d0 - d1 - d2, 1.0 - d0 + d1 - d2, 1.0 - d0 - d1 + d2]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    e, f, g = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    rows = [[q2[0], a, b, c], [a, q2[1], e, f], [b, e, q2[2], g], [c, f, g, q2[3]]]
    best = F.greatest(*q2)
    out = []
    for k in range(4):
        pick = None
        for i in range(4):
            value = rows[i][k] / (2.0 * F.sqrt(q2[i]))
            pick = F.when(q2[i] == best, value) if pick is None else pick.when(q2[i] == best, value)
        out.append(pick)
    return out


# -- cameras ----------------------------------------------------------------------------------


def pixel_ray(u: Column, v: Column, cam: Camera, r: Mat) -> Vec:
    """World direction of the ray through pixel (u, v); unit depth along the optical axis."""
    d = [(u - cam.cx) / cam.fx, -(v - cam.cy) / cam.fy, F.lit(-1.0)]
    return mat_vec(r, d)


def back_project(u: Column, v: Column, depth: Column, cam: Camera, r: Mat, t: Vec) -> Vec:
    return add(t, scale(pixel_ray(u, v, cam, r), depth))


def project(p: Vec, cam: Camera, r: Mat, t: Vec, flipped: bool = False) -> dict[str, Column]:
    """World point to pixel. ``z`` is negative in front of the camera and carries the 1e-5 offset."""
    rot = flip_camera(r) if flipped else r
    c = mat_vec(transpose(rot), sub(p, t))
    x, y, z0 = -c[0], c[1], c[2]
    z = z0 + 1e-5
    return {"u": (cam.fx * x + cam.cx * z0) / z, "v": (cam.fy * y + cam.cy * z0) / z, "z": z}


def in_view(uvz: dict[str, Column], cam: Camera, edge: float = 0.0, strict_front: bool = False) -> Column:
    """Strictly inside the image minus ``edge`` and in front of the camera."""
    u, v, z = uvz["u"], uvz["v"], uvz["z"]
    front = (z < 0.0) if strict_front else (-z >= 0.0)
    return front & (u < cam.W - edge) & (u > edge) & (v < cam.H - edge) & (v > edge)


def normalize_to_bound(p: Vec, lo, hi) -> Vec:
    return [(p[i] - float(lo[i])) / float(hi[i] - lo[i]) * 2.0 - 1.0 for i in AXES]


def enlarged_bound(lo: Column, hi: Column, step: float) -> Column:
    """Upper bound moved so the extent is a whole number of steps; it always adds one."""
    return (((hi - lo) / step).cast("long") + 1) * step + lo


def sdf_to_alpha(sdf: Column, beta: float = 10.0) -> Column:
    return 1.0 - F.exp(-beta / (1.0 + F.exp(beta * sdf)))


def box_exit(o: Vec, d: Vec, lo, hi) -> Column:
    """Ray parameter where it leaves the box, plus the 0.01 margin."""
    far = [F.greatest((float(lo[i]) - o[i]) / d[i], (float(hi[i]) - o[i]) / d[i]) for i in AXES]
    return F.least(*far) + 0.01


def horizontal_basis(up: Vec) -> tuple[Vec, Vec]:
    """Two horizontal unit vectors; the reference axis is x unless ``up`` nearly is."""
    tilted = F.abs(up[0]) < 0.9
    ref = [F.when(tilted, 1.0).otherwise(0.0), F.when(tilted, 0.0).otherwise(1.0), F.lit(0.0)]
    e1 = unit(sub(ref, scale(up, dot(ref, up))))
    return e1, cross(up, e1)


def canonical_rows(up: Vec, xdir: Vec) -> Mat:
    x = unit(sub(xdir, scale(up, dot(xdir, up))))
    return [x, cross(up, x), up]


def triangle_normal_area(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    n = cross(sub(b, a), sub(c, a))
    length = norm(n)
    return [F.try_divide(x, length) for x in n], length / 2.0


def cell(c: Column, h: float) -> Column:
    return F.floor(c / F.lit(float(h)))


TWO_PI = 2.0 * math.pi
