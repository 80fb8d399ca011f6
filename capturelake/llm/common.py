"""Helpers the operators share: working tables, column access, joins that survive a hot key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.session import checkpoint_dir

#: A key is hot above this share of all rows, so at most HOT_KEYS of them exist: a bounded broadcast.
HOT_KEYS = 1000


def working_table(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ... so that no name which an operator adds can be a user's, and the new name of each.

    ``toDF(*docs.columns)`` on these columns gives the old names back.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    lower() is many times faster than translate() and does the same where A-Z are the only capitals.
    """
    translated = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]"), translated).otherwise(F.lower(text))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of their group; groups has one row per key and its row count in ``size``.

    Keys above 1/HOT_KEYS of all rows are at most HOT_KEYS many, so they are broadcast and their rows
    are not dealt by key; all other keys are joined by a shuffle in which none is hot.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    values = [c for c in groups.columns if c not in keys]
    pack = F.struct(*values).alias("_group")
    hot = groups.where(F.col(size) * HOT_KEYS > F.lit(total)).select(*keys, pack)
    cold = groups.where(F.col(size) * HOT_KEYS <= F.lit(total)).select(*keys, pack)
    marked = rows.join(F.broadcast(hot), keys, "left")
    found = marked.where("_group is not null").unionByName(
        marked.where("_group is null").drop("_group").join(cold, keys, "inner"))
    return found.select(*rows.columns, *[F.col(f"_group.{c}").alias(c) for c in values])


def tidy(run):
    """The task function, giving back what its worker no longer uses: workers serve one task after another."""
    def go(batches):
        import ctypes
        import ctypes.util

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return go


def utf8(column) -> tuple:
    """Bytes and offsets of an Arrow string column without nulls, as numpy arrays over its own buffers."""
    import numpy as np
    import pyarrow as pa

    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, n + 1, column.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets, most: int):
    """Ranges of rows with at most ``most`` bytes each, or one row that is longer."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = begin + 1
        while end < n and offsets[end + 1] - offsets[begin] <= most:
            end += 1
        yield begin, end
        begin = end


def pieces(data, starts) -> tuple:
    """(number of the distinct piece for every piece, distinct pieces) of bytes cut at ``starts``; starts[0] is 0."""
    import numpy as np
    import pyarrow as pa

    if not len(starts):
        return np.zeros(0, np.int64), []
    cuts = np.append(starts, len(data)).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    coded = whole.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_string()).to_pylist()


def spread(which, values: list) -> tuple:
    """(concatenation, ends) of the unsigned 32-bit ids in values[w] for every w of ``which``."""
    import numpy as np

    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    ids = np.frombuffer(b"".join(values), "<u4")
    first = np.cumsum(sizes) - sizes
    size = sizes[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(first[which] - (ends - size), size) + np.arange(total)], ends
