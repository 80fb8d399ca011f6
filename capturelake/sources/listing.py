"""Files below a root, listed and read by tasks.

The driver never holds the names: folders are listed level by level, each level by many tasks, and the list is a table. A
task reads many small files, however many there are, and rows of a few files travel together. One folder is
listed by one task, which streams its entries.

Names are taken as Spark's own listing takes them: what begins with ``_`` (unless it has a ``=``) or ``.`` is left out.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from fnmatch import translate

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.session import checkpoint_dir
from capturelake.sources.files import open_root

FOUND = "place string, length long"
#: Rows of a listing, bytes of files, and files that travel in one batch; bytes of lines one task reads of a file.
ENTRIES, BATCH_BYTES, BATCH_FILES, LINE_RANGE = 1 << 13, 1 << 23, 1 << 10, 1 << 25


def _hidden(name: str) -> bool:
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(fs: pafs.FileSystem, folder: str, wanted: re.Pattern) -> Iterator[tuple[str, int | None]]:
    """(name, length) of the folder's wanted files, and (name, None) of its folders."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    yield entry.name, None
                elif wanted.match(entry.name):
                    yield entry.name, entry.stat().st_size
        return
    for entry in fs.get_file_info(pafs.FileSelector(folder)):
        if _hidden(entry.base_name):
            continue
        if entry.type == pafs.FileType.Directory:
            yield entry.base_name, None
        elif entry.type == pafs.FileType.File and wanted.match(entry.base_name):
            yield entry.base_name, entry.size


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def listed(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """(place, length) of every file below the root whose name has one of the patterns; ``place`` is its path from there.

    Lists at once, a job per level of folders; the files of one folder are dealt to all tasks.
    """
    fs, base = open_root(root)
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"there is no folder {root}")
    wanted = re.compile("|".join(translate(p) for p in patterns))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        places, lengths = [], []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, length in _entries(fs, f"{base}/{folder}" if folder else base, wanted):
                    places.append(f"{folder}/{name}" if folder else name)
                    lengths.append(length)
                    if len(places) == ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(lengths, pa.int64())], ["place", "length"])
                        places, lengths = [], []
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(lengths, pa.int64())], ["place", "length"])

    held, levels = f"{checkpoint_dir(spark)}/list-{uuid.uuid4().hex}", []
    folders = spark.range(1).select(F.lit("").alias("place")).coalesce(1)
    while not levels or not folders.isEmpty():
        where = f"{held}/{len(levels)}"
        folders.mapInArrow(enter, FOUND).write.parquet(where)
        levels.append(where)
        folders = spark.read.schema(FOUND).parquet(where).where("length IS NULL").select("place").repartition(tasks(spark), "place")
    return spark.read.schema(FOUND).parquet(*levels).where("length IS NOT NULL").repartition(tasks(spark), "place")


def path_of(root: str) -> Column:
    """The whole path of a place, as Spark names it."""
    if "://" not in root or root.startswith("file:"):
        root = "file:" + open_root(root)[1]
    return F.concat(F.lit(f"{root.rstrip('/')}/"), F.col("place"))


def _batches(rows: Iterable[tuple[list, int]], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as batches of bounded size."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size >= BATCH_BYTES or len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _text(data: bytes) -> str | None:
    """A JSON text in any of its encodings; none where the bytes are not text."""
    try:
        return data.decode(json.detect_encoding(data))
    except UnicodeDecodeError:
        return None


def contents(files: DataFrame, root: str, text: bool = False) -> DataFrame:
    """(place, length, content) of listed files, whole; with ``text`` decoded as JSON is, without files that are blank."""
    kind = pa.string() if text else pa.binary()
    schema = pa.schema([("place", pa.string()), ("length", pa.int64()), ("content", kind)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)

        def rows() -> Iterator[tuple[list, int]]:
            for batch in batches:
                for place, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    with fs.open_input_file(f"{base}/{place}") as source:
                        data = source.read()
                    content = _text(data) if text else data
                    if not text or content is None or content.strip():
                        yield [place, length, content], len(data)

        yield from _batches(rows(), schema, BATCH_FILES)

    return files.select("place", "length").mapInArrow(read, f"{FOUND}, content {'string' if text else 'binary'}")


def json_documents(spark: SparkSession, root: str, schema: str, *patterns: str) -> DataFrame:
    """(place, fields of the schema): a row per JSON document, as ``multiLine`` reads them.

    A file is one document, or an array of them; one that cannot be read is a row of nulls.
    """
    permissive = {"mode": "PERMISSIVE"}
    whole = contents(listed(spark, root, *patterns), root, text=True)
    fields = spark.createDataFrame([], schema).schema
    one = F.from_json("content", fields, permissive)
    several = F.from_json("content", f"array<{fields.simpleString()}>", permissive)
    # As a whole, an array with a null element cannot be read.
    sound = F.transform(F.array(several), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), a))[0]
    rows = whole.select("place", F.explode(
        F.when(F.ltrim("content").startswith("["), F.coalesce(sound, F.array(F.lit(None)))).otherwise(F.array(one))).alias("_doc"))
    return rows.select("place", "_doc.*")


def lines(spark: SparkSession, root: str, pattern: str, head: str | None = None, body: str | None = None, size: int = LINE_RANGE) -> DataFrame:
    """(place, start, head, line) of the lines of text files, which are read in ranges; ``start`` is true for a file's first line.

    ``head``: a pattern of the line that ``head`` repeats on every row, looked for before the first line that begins with ``body``.
    """
    ranges = listed(spark, root, pattern).select("place", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / size))).alias("part"))
    # The ranges of one long file are dealt out; most files have one.
    ranges = ranges.repartition(tasks(spark), "place", "part")
    schema = pa.schema([("place", pa.string()), ("start", pa.bool_()), ("head", pa.string()), ("line", pa.string())])
    title = re.compile(head) if head else None

    def begins(fs: pafs.FileSystem, path: str) -> str | None:
        with fs.open_input_file(path) as source:
            for line in _split(source, 0, None):
                if title.search(line):
                    return line
                if line.startswith(body):
                    return None
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)

        def rows() -> Iterator[tuple[list, int]]:
            for batch in batches:
                for place, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    first = begins(fs, f"{base}/{place}") if title else None
                    with fs.open_input_file(f"{base}/{place}") as source:
                        for n, line in enumerate(_split(source, part * size, (part + 1) * size)):
                            yield [place, part == 0 and n == 0, first, line], len(line) + len(first or "")

        yield from _batches(rows(), schema, 1 << 14)

    return ranges.mapInArrow(read, "place string, start boolean, head string, line string")


def _split(source: pa.NativeFile, start: int, end: int | None, block: int = 1 << 16) -> Iterator[str]:
    """The lines that begin in a range of a file."""
    at = max(0, start - 1)
    source.seek(at)
    rest, skipping = b"", start > 0  # a line begins at ``start`` if the byte before ends one
    while True:
        data = source.read(block)
        if not data:
            break
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            begun, at = at, at + len(line) + 1
            if skipping:
                skipping = False
                continue
            if end is not None and begun >= end:
                return
            yield line.removesuffix(b"\r").decode("utf-8", "replace")
    if rest and not skipping and (end is None or at < end):
        yield rest.removesuffix(b"\r").decode("utf-8", "replace")
