"""Table layouts, declared once and checked at read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}[kind])
            for name, kind in (part.split(":") for part in text.split())
        ]
    )


CLOUD = _table("scene_id:string point_id:long x:double y:double z:double label:int nx:double ny:double nz:double")
POSE = _table(
    "seq_id:string frame_idx:int ts:double "
    "r00:double r01:double r02:double r10:double r11:double r12:double r20:double r21:double r22:double "
    "tx:double ty:double tz:double"
)
PIXEL = _table("seq_id:string frame_idx:int v:int u:int r:double g:double b:double depth:double sem:int")
VERTEX = _table("scene_id:string vid:long x:double y:double z:double r:int g:int b:int")
FACE = _table("scene_id:string fid:long v0:long v1:long v2:long object_id:long label:int")
QUAD = _table("scene_id:string fid:long v0:long v1:long v2:long v3:long object_id:long label:int")
SIM3 = _table(
    "m00:double m01:double m02:double m10:double m11:double m12:double m20:double m21:double m22:double "
    "t0:double t1:double t2:double"
)
CLASS_INFO = T.StructType(
    [
        T.StructField("id_to_label", T.ArrayType(T.IntegerType())),
        T.StructField("classes", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))),
    ]
)


def conform(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Select and cast to ``schema``; absent nullable columns become NULL, absent required ones raise."""
    from pyspark.sql import functions as F

    optional = {"ts", "nx", "ny", "nz", "sem", "r", "g", "b", "object_id", "label", "scene_id", "seq_id"}
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if missing:
        raise ValueError(f"{name} table lacks columns {missing}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
