"""Skew-safe ordered computations and session-level joins.

One session may hold a third of all rows, and so may one stretch of its clock. No operator
here partitions raw rows by ``session_id`` alone; every group has a bound that does not
depend on the data:

* rows are cut into fine chunks along an integer order column (2^17 arrivals or 2^20 ns);
  an order value occurs once per session (``seq`` by definition, timestamps after
  reduction), so a fine chunk cannot hold more rows than it is wide;
* fine chunks are grouped into coarse ones of 2^20 fine chunks.

A running value is the value within the fine chunk, combined with the carry of the earlier
fine chunks of its coarse chunk and the carry of the earlier coarse chunks. Carries come
from one row per chunk, built with map-side partial aggregation and joined back on
(session, chunk), the key the rows are partitioned by already.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SESSION = "session_id"
SEQ_CHUNK = 1 << 17
CELL_NS = 1 << 20
COARSE = 1 << 20
SALTS = 64


def chunk_of(order: str | Column, width: int) -> Column:
    """Floor division of a long column (exact, also for negatives)."""
    o = (F.col(order) if isinstance(order, str) else order).cast("long")
    return F.call_function("div", o - F.pmod(o, F.lit(width)), F.lit(width).cast("long"))


def chunk_name(order: str = "seq", width: int = SEQ_CHUNK) -> str:
    return f"_chunk_{order}_{width}"


def with_chunk(df: DataFrame, order: str = "seq", width: int = SEQ_CHUNK) -> DataFrame:
    """Adds the chunk column unless it is there; steps that share it share one shuffle."""
    name = chunk_name(order, width)
    return df if name in df.columns else df.withColumn(name, chunk_of(order, width))


@dataclass(frozen=True)
class Running:
    """One running column: ``kind`` is last (latest non-null), sum, min or max."""

    out: str
    kind: str
    value: Column
    inclusive: bool = True


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}
_JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
         "min": F.least, "max": F.greatest, "last": F.coalesce}


def pick(value: Column, dtype: T.DataType, position: Column, reverse: bool) -> Column:
    """The value at the last position, leaf by leaf: primitive buffers aggregate by hash."""
    if isinstance(dtype, T.StructType):
        leaves = [pick(value[f.name], f.dataType, position, reverse).alias(f.name) for f in dtype.fields]
        return F.when(F.max(position).isNotNull(), F.struct(*leaves))
    return (F.min_by if reverse else F.max_by)(value, position)


def running(df: DataFrame, specs: Sequence[Running], *, order: Sequence[str] = ("seq",), width: int = SEQ_CHUNK,
            keys: Sequence[str] = (SESSION,), reverse: bool = False, coarse: int = COARSE) -> DataFrame:
    """Adds running columns over each key in ``order`` (or backwards), for keys of any size.

    The first order column is the integer one that is cut into chunks; the others break
    ties within it. Non-null values of a ``last`` column need distinct first order values.
    """
    chunk, group = chunk_name(order[0], width), "_coarse"
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    values = {s.out: f"_v_{s.out}" for s in specs}
    rows = with_chunk(df, order[0], width).withColumns({values[s.out]: s.value for s in specs})
    types = {s.out: rows.schema[values[s.out]].dataType for s in specs}

    def over(s: Running, v: Column, window: Window) -> Column:
        return (F.last(v, ignorenulls=True) if s.kind == "last" else _AGG[s.kind](v)).over(window)

    def total(s: Running, v: Column, position: str) -> Column:
        if s.kind != "last":
            return _AGG[s.kind](v)
        return pick(v, types[s.out], F.when(v.isNotNull(), F.col(position)), reverse)

    def earlier(at: str, *by: str) -> Window:
        return Window.partitionBy(*by).orderBy(direction(at)).rowsBetween(Window.unboundedPreceding, -1)

    by_chunk = Window.partitionBy(*keys, chunk).orderBy(*[direction(c) for c in order])
    upto = {True: by_chunk.rowsBetween(Window.unboundedPreceding, 0),
            False: by_chunk.rowsBetween(Window.unboundedPreceding, -1)}
    fine = (rows.groupBy(*keys, chunk)
            .agg(*[total(s, F.col(values[s.out]), order[0]).alias(f"_t_{s.out}") for s in specs])
            .withColumn(group, chunk_of(chunk, coarse)))
    wide = fine.groupBy(*keys, group).agg(*[total(s, F.col(f"_t_{s.out}"), chunk).alias(f"_w_{s.out}") for s in specs])
    across = wide.select(*keys, group, *[over(s, F.col(f"_w_{s.out}"), earlier(group, *keys)).alias(f"_b_{s.out}")
                                         for s in specs])
    within = fine.select(*keys, chunk, group, *[
        over(s, F.col(f"_t_{s.out}"), earlier(chunk, *keys, group)).alias(f"_a_{s.out}") for s in specs])
    carried = within.join(across, [*keys, group], "left").select(
        *keys, chunk, *[_JOIN[s.kind](F.col(f"_a_{s.out}"), F.col(f"_b_{s.out}")).alias(f"_c_{s.out}") for s in specs])
    local = rows.withColumns({f"_l_{s.out}": over(s, F.col(values[s.out]), upto[s.inclusive]) for s in specs})
    result = local.join(carried, [*keys, chunk], "left").withColumns(
        {s.out: _JOIN[s.kind](F.col(f"_l_{s.out}"), F.col(f"_c_{s.out}")) for s in specs})
    kept = [c for c in df.columns if c not in {s.out for s in specs}]
    return result.select(*kept, *[s.out for s in specs])


def attach(df: DataFrame, values: DataFrame, by: Sequence[str | Column], keys: Sequence[str] = (SESSION,),
           how: str = "left", salts: int = SALTS) -> DataFrame:
    """Joins per-key values (one row per key) onto rows, spreading a hot key over ``salts`` groups.

    Rows get a salt from ``by``, columns that tell the rows of one key apart. The values go to
    the (key, salt) pairs that occur first; the row-level join is on (key, salt). Blocks of
    a counter as ``by`` (``chunk_of("seq", 1024)``) give small keys a single pair.
    """
    added = [c for c in values.columns if c not in keys]
    rows = df.drop(*added).withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    pairs = rows.select(*keys, "_salt").distinct().join(values, list(keys), how)
    return rows.join(pairs, [*keys, "_salt"], how).select(*[c for c in rows.columns if c != "_salt"], *added)
