"""Registration of queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import Fixtures, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand_rounding(sql: str) -> str:
    """Write out ``r4(expr)`` (four decimals) in plain arithmetic."""
    while (at := sql.find("r4(")) >= 0:
        depth, i = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[at + 3 : i - 1]
        sql = f"{sql[:at]}(floor(({inner}) * 10000.0 + 0.50317) / 10000.0){sql[i:]}"
    return sql


def _plain_types(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long").alias(f.name)
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain_types(fn(Fixtures(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_fixtures(expand_rounding(sql))
        return fn

    return wrap
