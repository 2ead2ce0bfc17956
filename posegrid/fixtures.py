"""Spatial tables derived from the relational test tables.

Each table exists twice: as a DataFrame here and as the SQL text of the same name, so that a query
and its SQL twin start from independently built but equal inputs. Every table uses all rows.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import Camera
from .functions.labels import CLASS_COLORS, CLASS_NAMES
from .operators.ordered import rank_within

CAMERA = Camera(H=12, W=8, fx=6.0, fy=6.0, cx=3.5, cy=5.5)
CLASS_OF_SIZE = {1: 3, 2: 1, 3: 2, 4: 4, 5: 5}

SQL: dict[str, str] = {
    "fx_cloud": """
        SELECT vec_id AS point_id, 5.0 * e[1]::DOUBLE AS x, 5.0 * e[2]::DOUBLE AS y, 5.0 * e[3]::DOUBLE AS z,
               e[4]::DOUBLE / n AS nx, e[5]::DOUBLE / n AS ny, e[6]::DOUBLE / n AS nz,
               (label % 6)::BIGINT AS label, vec_id % 2 AS side
        FROM (SELECT vec_id, label, embedding AS e,
                     sqrt(embedding[4]::DOUBLE * embedding[4]::DOUBLE + embedding[5]::DOUBLE * embedding[5]::DOUBLE
                          + embedding[6]::DOUBLE * embedding[6]::DOUBLE) AS n FROM embeddings)""",
    "fx_keyed_cloud": """
        SELECT o_orderkey AS point_id, o_custkey % 5 AS scene_id, o_totalprice / 100000.0 AS x,
               (o_custkey % 97)::DOUBLE / 24.0 AS y, (o_orderkey * 7919 % 1000)::DOUBLE / 400.0 AS z,
               o_custkey % 6 AS label FROM orders""",
    "fx_cloud_big": """
        SELECT l_quantity / 10.0 AS x, l_extendedprice / 20000.0 AS y, l_discount * 30.0 AS z,
               l_suppkey % 6 AS label, (l_orderkey + l_partkey) % 2 AS side FROM lineitem""",
    "fx_color": """
        SELECT (l_suppkey * 37 % 256)::DOUBLE AS r, (l_partkey % 256)::DOUBLE AS g,
               floor(l_quantity * 5.0)::DOUBLE AS b FROM lineitem""",
    "fx_class_dim": " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS label, '{n}' AS name, {r}::DOUBLE AS r, {g}::DOUBLE AS g, {b}::DOUBLE AS b"
        for i, (n, (r, g, b)) in enumerate(zip(CLASS_NAMES, CLASS_COLORS))
    ),
    "fx_remap": "SELECT p_partkey AS instance, p_size::BIGINT AS class_id FROM part",
    "fx_paths": """
        SELECT CASE event_type WHEN 'view' THEN 'rgb' WHEN 'click' THEN 'depth' WHEN 'purchase' THEN 'semantic'
                    WHEN 'error' THEN 'pose' ELSE 'log' END AS kind,
               CASE event_type WHEN 'view' THEN 'rgb/rgb_' WHEN 'click' THEN 'depth/depth_'
                    WHEN 'purchase' THEN 'semantic/semantic_' WHEN 'error' THEN 'pose/pose_' ELSE 'ckpt/tar_' END
               || event_id || '.png' AS path FROM events""",
    "fx_event": """
        SELECT event_id, user_id, epoch_us(ts) / 1e6 AS ts, event_type, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events""",
    "fx_pose": f"""
        SELECT user_id AS seq_id, i AS frame_idx, ts, cos(a) AS r00, -sin(a) AS r01, 0.0::DOUBLE AS r02, sin(a) AS r10, cos(a) AS r11,
               0.0::DOUBLE AS r12, 0.0::DOUBLE AS r20, 0.0::DOUBLE AS r21, 1.0::DOUBLE AS r22, value / 100.0 AS tx,
               (event_id % 100)::DOUBLE / 25.0 AS ty, 1.5::DOUBLE AS tz, event_id
        FROM (SELECT *, (event_id % 360)::DOUBLE * {math.pi / 180!r} AS a FROM fx_event)""",
    "fx_pose_est": f"""
        SELECT seq_id, frame_idx, ts, event_id,
               {math.cos(math.radians(10))!r} * tx - {math.sin(math.radians(10))!r} * ty + 0.3 + 0.01 * ((event_id % 11) - 5) AS tx,
               {math.sin(math.radians(10))!r} * tx + {math.cos(math.radians(10))!r} * ty - 0.2 AS ty, tz + 0.1 AS tz FROM fx_pose""",
    # One camera per event, level and looking along its yaw; its picture is the one of its user.
    "fx_view": f"""
        SELECT event_id AS frame, seq_id AS image, seq_id % 5 AS scene_id, -sin(a) AS r00, 0.0::DOUBLE AS r01, -cos(a) AS r02, cos(a) AS r10, 0.0::DOUBLE AS r11,
               -sin(a) AS r12, 0.0::DOUBLE AS r20, 1.0::DOUBLE AS r21, 0.0::DOUBLE AS r22, tx, ty, tz
        FROM (SELECT *, (event_id % 360)::DOUBLE * {math.pi / 180!r} AS a FROM fx_pose)""",
    # The newest camera of every user.
    "fx_current": "SELECT * FROM fx_view WHERE frame IN (SELECT arg_max(event_id, ts) FROM events GROUP BY user_id)",
    "fx_view_pixel": "SELECT w.*, p.v, p.u, p.depth, p.raw, p.event_id FROM fx_pixel p JOIN fx_view w ON p.frame = w.image",
    "fx_stamps": """
        SELECT CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'depth' WHEN 'purchase' THEN 'pose' ELSE 'other' END AS kind,
               event_id AS id, epoch_us(ts) / 1e6 AS ts FROM events""",
    "fx_pixel_pair": """
        SELECT l_orderkey AS frame, l_suppkey % 10 AS v, (l_linenumber - 1)::BIGINT AS gt,
               ((l_linenumber - 1 + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) % 7)::BIGINT AS pred,
               l_quantity AS gt_depth, l_quantity * (1 + l_tax) AS est_depth, l_discount * 10 AS gt_c, l_tax * 10 AS est_c
        FROM lineitem""",
    "fx_ray_sample": """
        SELECT user_id AS ray_id, i AS k, (i + 1) * 0.05 AS z, ((event_id % 21) - 10) / 10.0 AS sdf, value / 600.0 AS r,
               (event_id % 100)::DOUBLE / 100.0 AS g, (event_id % 7)::DOUBLE / 7.0 AS b, 1.5::DOUBLE AS depth, ts, event_id FROM fx_event""",
    "fx_vertex": """
        SELECT c_custkey AS vid, c_acctbal / 2000.0 AS x, c_nationkey::DOUBLE / 5.0 AS y, (c_custkey % 7)::DOUBLE / 2.0 AS z FROM customer""",
    "fx_face": """
        SELECT o_orderkey AS fid, o_custkey AS v0, (o_custkey + 1) % n AS v1, (o_custkey + 7) % n AS v2, (o_custkey + 11) % n AS v3,
               o_orderkey % 50 AS object_id FROM orders, (SELECT count(*) AS n FROM customer)""",
    "fx_sim3": f"""
        SELECT s_suppkey AS run_id, s * cos(a) AS m00, -(s * sin(a)) AS m01, 0.0::DOUBLE AS m02, s * sin(a) AS m10, s * cos(a) AS m11, 0.0::DOUBLE AS m12,
               0.0::DOUBLE AS m20, 0.0::DOUBLE AS m21, s AS m22, s_acctbal / 10000.0 AS t0, (s_suppkey % 5)::DOUBLE / 5.0 AS t1, 0.1::DOUBLE AS t2
        FROM (SELECT *, s_nationkey::DOUBLE * 14.4 * {math.pi / 180!r} AS a, 1.0 + 0.01 * (s_suppkey % 10) AS s FROM supplier)""",
    "fx_pixel": """
        SELECT user_id AS frame, i // 8 AS v, i % 8 AS u, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE 1.0 + value / 300.0 END AS depth,
               event_id % 13 AS raw, event_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 13 % 256 AS b, event_id FROM fx_event""",
    "fx_trace": """
        SELECT run_id // 20 AS trace_id, run_id % 10 AS iter, * FROM fx_sim3""",
    "fx_trials": """
        SELECT s_suppkey % 3 AS method, (s_suppkey % 13)::DOUBLE AS rot_deg, (s_suppkey % 7)::DOUBLE / 40.0 AS trans,
               (s_suppkey % 5)::DOUBLE / 60.0 AS scale_ratio, s_acctbal / 10000.0 AS chamfer FROM supplier""",
    # A lattice of 16 x 16 x 16 nodes per scene with a signed distance at each node.
    "fx_grid": """
        SELECT o_orderkey // 4096 AS scene_id, (o_orderkey // 256 % 16)::BIGINT AS ix, (o_orderkey // 16 % 16)::BIGINT AS iy, (o_orderkey % 16)::BIGINT AS iz,
               o_totalprice / 250000.0 - 1.0 AS sdf FROM orders""",
}


def with_fixtures(sql: str) -> str:
    """Prefix a statement with the fixture tables it names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in SQL and name not in order:
                visit(SQL[name])
                order.append(name)

    visit(sql)
    body = sql.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in order)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[4:].strip()}"
    return f"WITH {head}\n{body}"


def r4(c) -> Column:
    """Four decimals by plain arithmetic, the same in both engines; the threshold lies off the
    short decimals, where a last-bit difference would flip the digit."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10000.0 + 0.50317) / 10000.0


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a zone-less timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1e6


def _d(c) -> Column:
    return c.cast("double")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def cloud(self) -> DataFrame:
        e = [_d(F.col("embedding")[i]) for i in range(6)]
        n = F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5])
        return self.table("embeddings").select(
            F.col("vec_id").alias("point_id"), (e[0] * 5.0).alias("x"), (e[1] * 5.0).alias("y"), (e[2] * 5.0).alias("z"),
            (e[3] / n).alias("nx"), (e[4] / n).alias("ny"), (e[5] / n).alias("nz"),
            (F.col("label") % 6).cast("long").alias("label"), (F.col("vec_id") % 2).alias("side"),
        )

    @cached_property
    def keyed_cloud(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            k.alias("point_id"), (c % 5).alias("scene_id"), (F.col("o_totalprice") / 100000.0).alias("x"),
            (_d(c % 97) / 24.0).alias("y"), (_d(k * 7919 % 1000) / 400.0).alias("z"), (c % 6).alias("label"),
        )

    @cached_property
    def cloud_big(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_quantity") / 10.0).alias("x"), (F.col("l_extendedprice") / 20000.0).alias("y"), (F.col("l_discount") * 30.0).alias("z"),
            (F.col("l_suppkey") % 6).alias("label"), ((F.col("l_orderkey") + F.col("l_partkey")) % 2).alias("side"),
        )

    @cached_property
    def color(self) -> DataFrame:
        return self.table("lineitem").select(
            _d(F.col("l_suppkey") * 37 % 256).alias("r"), _d(F.col("l_partkey") % 256).alias("g"), _d(F.floor(F.col("l_quantity") * 5.0)).alias("b")
        )

    @cached_property
    def class_dim(self) -> DataFrame:
        rows = [(i, n, float(r), float(g), float(b)) for i, (n, (r, g, b)) in enumerate(zip(CLASS_NAMES, CLASS_COLORS))]
        return self.spark.createDataFrame(rows, "label long, name string, r double, g double, b double")

    @cached_property
    def remap(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("instance"), F.col("p_size").cast("long").alias("class_id"))

    @cached_property
    def paths(self) -> DataFrame:
        t = F.col("event_type")
        kind = F.when(t == "view", "rgb").when(t == "click", "depth").when(t == "purchase", "semantic").when(t == "error", "pose").otherwise("log")
        stem = F.when(kind == "log", "ckpt/tar_").otherwise(F.concat(kind, F.lit("/"), kind, F.lit("_")))
        return self.table("events").select(kind.alias("kind"), F.concat(stem, F.col("event_id"), F.lit(".png")).alias("path"))

    @cached_property
    def event(self) -> DataFrame:
        e = self.table("events").select("event_id", "user_id", seconds(F.col("ts")).alias("ts"), "event_type", "value")
        return rank_within(e, ["user_id"], ["ts"], "i")

    @cached_property
    def pose(self) -> DataFrame:
        a = _d(F.col("event_id") % 360) * (math.pi / 180)
        zero = F.lit(0.0)
        return self.event.select(
            F.col("user_id").alias("seq_id"), F.col("i").alias("frame_idx"), "ts",
            F.cos(a).alias("r00"), (-F.sin(a)).alias("r01"), zero.alias("r02"), F.sin(a).alias("r10"), F.cos(a).alias("r11"), zero.alias("r12"),
            zero.alias("r20"), zero.alias("r21"), F.lit(1.0).alias("r22"),
            (F.col("value") / 100.0).alias("tx"), (_d(F.col("event_id") % 100) / 25.0).alias("ty"), F.lit(1.5).alias("tz"), "event_id",
        )

    @cached_property
    def pose_est(self) -> DataFrame:
        c, s = math.cos(math.radians(10)), math.sin(math.radians(10))
        return self.pose.select(
            "seq_id", "frame_idx", "ts", "event_id",
            (c * F.col("tx") - s * F.col("ty") + 0.3 + 0.01 * ((F.col("event_id") % 11) - 5)).alias("tx"),
            (s * F.col("tx") + c * F.col("ty") - 0.2).alias("ty"), (F.col("tz") + 0.1).alias("tz"),
        )

    @cached_property
    def view(self) -> DataFrame:
        a = _d(F.col("event_id") % 360) * (math.pi / 180)
        zero = F.lit(0.0)
        return self.table("events").select(
            F.col("event_id").alias("frame"), F.col("user_id").alias("image"), (F.col("user_id") % 5).alias("scene_id"),
            (-F.sin(a)).alias("r00"), zero.alias("r01"), (-F.cos(a)).alias("r02"), F.cos(a).alias("r10"), zero.alias("r11"), (-F.sin(a)).alias("r12"),
            zero.alias("r20"), F.lit(1.0).alias("r21"), zero.alias("r22"),
            (F.col("value") / 100.0).alias("tx"), (_d(F.col("event_id") % 100) / 25.0).alias("ty"), F.lit(1.5).alias("tz"),
        )

    @cached_property
    def current(self) -> DataFrame:
        newest = self.table("events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("frame"))
        return self.view.join(newest.select("frame"), "frame", "left_semi")

    @cached_property
    def view_pixel(self) -> DataFrame:
        return self.pixel.withColumnRenamed("frame", "image").join(self.view, "image")

    @cached_property
    def stamps(self) -> DataFrame:
        t = F.col("event_type")
        kind = F.when(t == "view", "image").when(t == "click", "depth").when(t == "purchase", "pose").otherwise("other")
        return self.table("events").select(kind.alias("kind"), F.col("event_id").alias("id"), seconds(F.col("ts")).alias("ts"))

    @cached_property
    def pixel_pair(self) -> DataFrame:
        gt = F.col("l_linenumber").cast("long") - 1
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 10).alias("v"), gt.alias("gt"),
            ((gt + F.when(F.col("l_discount") > 0.05, 1).otherwise(0)) % 7).alias("pred"),
            F.col("l_quantity").alias("gt_depth"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("est_depth"),
            (F.col("l_discount") * 10).alias("gt_c"), (F.col("l_tax") * 10).alias("est_c"),
        )

    @cached_property
    def ray_sample(self) -> DataFrame:
        e = F.col("event_id")
        return self.event.select(
            F.col("user_id").alias("ray_id"), F.col("i").alias("k"), ((F.col("i") + 1) * 0.05).alias("z"), (((e % 21) - 10) / 10.0).alias("sdf"),
            (F.col("value") / 600.0).alias("r"), (_d(e % 100) / 100.0).alias("g"), (_d(e % 7) / 7.0).alias("b"), F.lit(1.5).alias("depth"), "ts", "event_id",
        )

    @cached_property
    def vertex(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("vid"), (F.col("c_acctbal") / 2000.0).alias("x"), (_d(F.col("c_nationkey")) / 5.0).alias("y"), (_d(F.col("c_custkey") % 7) / 2.0).alias("z")
        )

    @cached_property
    def face(self) -> DataFrame:
        n = self.table("customer").count()
        c = F.col("o_custkey")
        return self.table("orders").select(
            F.col("o_orderkey").alias("fid"), c.alias("v0"), ((c + 1) % n).alias("v1"), ((c + 7) % n).alias("v2"), ((c + 11) % n).alias("v3"),
            (F.col("o_orderkey") % 50).alias("object_id"),
        )

    @cached_property
    def sim3(self) -> DataFrame:
        a = _d(F.col("s_nationkey")) * 14.4 * (math.pi / 180)
        s = 1.0 + 0.01 * (F.col("s_suppkey") % 10)
        zero = F.lit(0.0)
        return self.table("supplier").select(
            F.col("s_suppkey").alias("run_id"), (s * F.cos(a)).alias("m00"), (-(s * F.sin(a))).alias("m01"), zero.alias("m02"),
            (s * F.sin(a)).alias("m10"), (s * F.cos(a)).alias("m11"), zero.alias("m12"), zero.alias("m20"), zero.alias("m21"), s.alias("m22"),
            (F.col("s_acctbal") / 10000.0).alias("t0"), (_d(F.col("s_suppkey") % 5) / 5.0).alias("t1"), F.lit(0.1).alias("t2"),
        )

    @cached_property
    def pixel(self) -> DataFrame:
        e = F.col("event_id")
        return self.event.select(
            F.col("user_id").alias("frame"), F.floor(F.col("i") / 8).alias("v"), (F.col("i") % 8).alias("u"),
            F.when(e % 10 == 0, 0.0).otherwise(1.0 + F.col("value") / 300.0).alias("depth"), (e % 13).alias("raw"),
            (e % 256).alias("r"), (e * 7 % 256).alias("g"), (e * 13 % 256).alias("b"), "event_id",
        )

    @cached_property
    def trace(self) -> DataFrame:
        return self.sim3.select(F.floor(F.col("run_id") / 20).alias("trace_id"), (F.col("run_id") % 10).alias("iter"), "*")

    @cached_property
    def trials(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            (s % 3).alias("method"), _d(s % 13).alias("rot_deg"), (_d(s % 7) / 40.0).alias("trans"), (_d(s % 5) / 60.0).alias("scale_ratio"),
            (F.col("s_acctbal") / 10000.0).alias("chamfer"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.floor(k / 4096).alias("scene_id"), (F.floor(k / 256) % 16).alias("ix"), (F.floor(k / 16) % 16).alias("iy"), (k % 16).alias("iz"),
            (F.col("o_totalprice") / 250000.0 - 1.0).alias("sdf"),
        )
