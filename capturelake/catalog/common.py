"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.fixtures import ctes, table
from capturelake.functions.pose import FIELDS, pose
from capturelake.operators.gates import tracking_only


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; + 0.0 turns −0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rq(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {alias}"


def intrinsics(alias: str = "image_k") -> Column:
    return F.struct("fx", "fy", "cx", "cy", F.col("img_w").alias("width"), F.col("img_h").alias("height")).alias(alias)


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """Pose frames with pose and intrinsics structs."""
    t = table(spark, sf, "poses")
    return t.select("session_id", "seq", "timestamp_ns", "tracking_state", pose().alias("pose"),
                    intrinsics("image_k"), intrinsics("texture_k"), "lens_state", "af_state")


def tracking(spark: SparkSession, sf: str) -> DataFrame:
    return tracking_only(poses(spark, sf))


def sql(body: str, *tables: str, extra: str = "", recursive: bool = False) -> str:
    """A DuckDB statement over the derived tables."""
    more = f",\n{extra}" if extra else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes(*tables)}{more}\n{body}"


# Pose algebra in SQL text, for the comparison statements.
def sql_rotate(q: str, v: tuple[str, str, str], sign: str = "") -> tuple[str, str, str]:
    x, y, z, w = (f"({sign}{q}qx)", f"({sign}{q}qy)", f"({sign}{q}qz)", f"{q}qw")
    a, b, c = v
    return (f"((1-2*({y}*{y}+{z}*{z}))*{a} + 2*({x}*{y}-{z}*{w})*{b} + 2*({x}*{z}+{y}*{w})*{c})",
            f"(2*({x}*{y}+{z}*{w})*{a} + (1-2*({x}*{x}+{z}*{z}))*{b} + 2*({y}*{z}-{x}*{w})*{c})",
            f"(2*({x}*{z}-{y}*{w})*{a} + 2*({y}*{z}+{x}*{w})*{b} + (1-2*({x}*{x}+{y}*{y}))*{c})")


def sql_relative(a: str, b: str) -> dict[str, str]:
    """a⁻¹∘b as seven SQL expressions over columns prefixed a and b."""
    t = sql_rotate(a, tuple(f"({b}t{k}-{a}t{k})" for k in "xyz"), "-")
    x1, y1, z1, w1 = f"(-{a}qx)", f"(-{a}qy)", f"(-{a}qz)", f"{a}qw"
    x2, y2, z2, w2 = f"{b}qx", f"{b}qy", f"{b}qz", f"{b}qw"
    q = (f"{w1}*{x2} + {x1}*{w2} + {y1}*{z2} - {z1}*{y2}", f"{w1}*{y2} - {x1}*{z2} + {y1}*{w2} + {z1}*{x2}",
         f"{w1}*{z2} + {x1}*{y2} - {y1}*{x2} + {z1}*{w2}", f"{w1}*{w2} - {x1}*{x2} - {y1}*{y2} - {z1}*{z2}")
    return dict(zip(FIELDS, (*t, *q)))


def sql_matrix(q: str = "") -> list[str]:
    """The 16 column-major values of a pose given by columns prefixed q."""
    cols = [sql_rotate(q, v) for v in (("1", "0", "0"), ("0", "1", "0"), ("0", "0", "1"))]
    out = [e for c in cols for e in (*c, "0e0")]
    return [*out, f"{q}tx", f"{q}ty", f"{q}tz", "1e0"]


# Frames with the motion against the previous arrival; `f` is reused by several statements.
MOTION_SQL = """
tracked AS (SELECT * FROM poses WHERE tracking_state = 'TRACKING'),
lagged AS (SELECT *, lag(timestamp_ns) OVER w AS p_ts, lag(tx) OVER w AS ptx, lag(ty) OVER w AS pty,
  lag(tz) OVER w AS ptz, lag(qx) OVER w AS pqx, lag(qy) OVER w AS pqy, lag(qz) OVER w AS pqz, lag(qw) OVER w AS pqw
  FROM tracked WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
f AS (SELECT *, CASE WHEN timestamp_ns > p_ts THEN
    sqrt((tx-ptx)*(tx-ptx) + (ty-pty)*(ty-pty) + (tz-ptz)*(tz-ptz)) / ((timestamp_ns - p_ts)/1e9) ELSE 0e0 END AS linear_mps,
  CASE WHEN timestamp_ns > p_ts THEN
    degrees(2*acos(least(1e0, abs(qx*pqx + qy*pqy + qz*pqz + qw*pqw)))) / ((timestamp_ns - p_ts)/1e9) ELSE 0e0 END AS angular_dps
  FROM lagged)"""
