"""Pose algebra on struct columns ``(tx, ty, tz, qx, qy, qz, qw)``, unit quaternions, doubles.

All functions build native column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
Vec = tuple[Column, Column, Column]


def pose(*cols: str | Column) -> Column:
    """A pose struct from seven columns (defaults to columns named like the fields)."""
    parts = cols or FIELDS
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f)
                      for c, f in zip(parts, FIELDS)])


def settle(values: list[Column]) -> Column:
    """An array kept as one computed value.

    Catalyst replaces an element access on a literal array by the element's expression, so
    values that feed each other would be expanded again at every use; a slice stops that.
    """
    return F.slice(F.array(*values), 1, len(values))


def parts(p: Column) -> list[Column]:
    """The seven fields of a pose column."""
    return [p[f] for f in FIELDS]


def with_pose(df: DataFrame, name: str, values: list[Column]) -> DataFrame:
    """Adds a pose column from its seven values, which are evaluated once per row."""
    held = f"_settled_{name}"
    rows = df.withColumn(held, settle(values))
    return rows.withColumn(name, F.struct(*[F.col(held)[i].alias(f) for i, f in enumerate(FIELDS)])).drop(held)


def _turn(q: list[Column], v: list[Column]) -> list[Column]:
    """v rotated by the quaternion q: v + 2w(u×v) + 2u×(u×v)."""
    ux, uy, uz, w = q
    vx, vy, vz = v
    cx, cy, cz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    return [vx + 2.0 * (w * cx + uy * cz - uz * cy), vy + 2.0 * (w * cy + uz * cx - ux * cz),
            vz + 2.0 * (w * cz + ux * cy - uy * cx)]


def _product(a: list[Column], b: list[Column]) -> list[Column]:
    """Quaternion product a⊗b."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx,
            aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def _conjugate(q: list[Column]) -> list[Column]:
    return [-q[0], -q[1], -q[2], q[3]]


def inverse_parts(a: list[Column]) -> list[Column]:
    q = _conjugate(a[3:])
    return [*[-c for c in _turn(q, a[:3])], *q]


def compose_parts(a: list[Column], b: list[Column]) -> list[Column]:
    return [*[t + c for t, c in zip(a[:3], _turn(a[3:], b[:3]))], *_product(a[3:], b[3:])]


def relative_parts(a: list[Column], b: list[Column]) -> list[Column]:
    """a⁻¹∘b in one step: the offset between the two turned back by a."""
    q = _conjugate(a[3:])
    return [*_turn(q, [y - x for x, y in zip(a[:3], b[:3])]), *_product(q, b[3:])]


def rotate_vector(p: Column, x: float | Column, y: float | Column, z: float | Column) -> Column:
    """A direction rotated by the pose, as array(3)."""
    v = [c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z)]
    return F.array(*_turn(parts(p)[3:], v))


def forward_world(p: Column) -> Column:
    return rotate_vector(p, 0.0, 0.0, -1.0)


def up_world(p: Column) -> Column:
    return rotate_vector(p, 0.0, 1.0, 0.0)


def pose_inverse(p: Column) -> Column:
    """q* with translation −R(q*)t."""
    return pose(*inverse_parts(parts(p)))


def pose_compose(a: Column, b: Column) -> Column:
    """a∘b, translation ta + R(qa)tb and rotation qa⊗qb."""
    return pose(*compose_parts(parts(a), parts(b)))


def pose_matrix(p: Column) -> Column:
    """4×4 homogeneous matrix as a column-major array of 16."""
    x, y, z, w = p["qx"], p["qy"], p["qz"], p["qw"]
    one, zero = F.lit(1.0), F.lit(0.0)
    return settle([
        one - 2.0 * (y * y + z * z), 2.0 * (x * y + z * w), 2.0 * (x * z - y * w), zero,
        2.0 * (x * y - z * w), one - 2.0 * (x * x + z * z), 2.0 * (y * z + x * w), zero,
        2.0 * (x * z + y * w), 2.0 * (y * z - x * w), one - 2.0 * (x * x + y * y), zero,
        p["tx"], p["ty"], p["tz"], one,
    ])


def translation_distance(a: Column, b: Column) -> Column:
    """I4: metres between two poses."""
    dx, dy, dz = a["tx"] - b["tx"], a["ty"] - b["ty"], a["tz"] - b["tz"]
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def rotation_degrees(a: Column, b: Column) -> Column:
    """Angle of a⁻¹∘b; the w of the relative rotation is the dot product of unit quaternions."""
    w = a["qx"] * b["qx"] + a["qy"] * b["qy"] + a["qz"] * b["qz"] + a["qw"] * b["qw"]
    return F.degrees(2.0 * F.acos(F.least(F.lit(1.0), F.abs(w))))


def apply_matrix(m: Column, x: Column, y: Column, z: Column) -> Vec:
    """Column-major affine transform of a point."""
    return tuple(m[i] * x + m[i + 4] * y + m[i + 8] * z + m[i + 12] for i in range(3))


def column_major_to_rows(m: Column) -> Column:
    """Nested 4×4 rows; null when the array does not hold 16 values (E2 reports it)."""
    rows = F.array(*[F.array(*[m[c * 4 + r] for c in range(4)]) for r in range(4)])
    return F.when(F.size(m) == 16, rows)
