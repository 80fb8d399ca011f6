"""Elements of one array of large JSON documents, cut out by many tasks for one file.

A byte range cannot know whether it begins inside a string or how deep. Each range therefore gives its effect for
all three states it may be entered in (outside a string, inside, inside behind a backslash): the state it is left in, the change
of bracket depth and the lowest depth on the way. Composed along a file (blocks of ranges first, then blocks, so no group
has more than BLOCK of either for files below a thousand terabytes) they give every range its state and depth.

Ranges that touch depth 1 then write down the root object with each container replaced by its place, which a JSON parser
reads as a small document; the ranges of the wanted array cut its elements at the commas of depth 2. An element
belongs to the range it begins in, whose task reads on to its end.

Defined results: a document that is not one object, is cut short or has no such array gives no elements; of
repeated keys the last counts; empty files and arrays give none; a null element is an element with text ``null``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.session import cut
from capturelake.sources.files import open_root
from capturelake.sources.listing import tasks

RANGE, BLOCK, AHEAD = 1 << 22, 4096, 1 << 18
#: Rows that leave a fold together.
ROWS = 1 << 13
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
STATES = (OUTSIDE, INSIDE, ESCAPED)
QUOTE, BACKSLASH, COMMA, OPENS_ARRAY = b'"\\,['
STEP = np.zeros(256, np.int64)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1
STRUCTURAL = STEP != 0
STRUCTURAL[COMMA] = True


def scan(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Places of brackets and commas outside strings, and the state after the bytes."""
    n = len(data)
    quotes = np.flatnonzero(data == QUOTE)
    trailing = 0
    slashes = np.flatnonzero(data == BACKSLASH)
    if len(slashes) or state == ESCAPED:
        # Runs of backslashes: a quote is escaped where an odd run ends just before it.
        first = np.ones(len(slashes), dtype=bool)
        first[1:] = np.diff(slashes) > 1
        begins = slashes[first]
        lengths = np.diff(np.append(np.flatnonzero(first), len(slashes)))
        ends = begins + lengths
        if state == ESCAPED:  # one more before the first byte
            if len(begins) and begins[0] == 0:
                lengths[0] += 1
            else:
                ends, lengths = np.append(0, ends), np.append(1, lengths)
        odd = ends[lengths % 2 == 1]
        quotes = quotes[~np.isin(quotes, odd)]
        trailing = int(len(odd) > 0 and odd[-1] == n)
    places = np.flatnonzero(STRUCTURAL[data])
    inside = np.searchsorted(quotes, places) + (state != OUTSIDE)
    left = (len(quotes) + (state != OUTSIDE)) % 2
    return places[inside % 2 == 0], (ESCAPED if trailing else INSIDE) if left else OUTSIDE


def _read(path: str, start: int, size: int) -> np.ndarray:
    fs, place = open_root(path)
    with fs.open_input_file(place) as source:
        source.seek(start)
        return np.frombuffer(source.read(size), np.uint8)


def _effects(ranges: DataFrame, size: int) -> DataFrame:
    """Per range and state on entry: state after (s), change of depth (d), lowest depth (l)."""
    names = [f"{k}{s}" for s in STATES for k in "sdl"]

    def effect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, part in zip(pdf["path"], pdf["part"]):
                data, row = _read(path, part * size, size), [path, part]
                for state in STATES:
                    places, after = scan(data, state)
                    depth = np.cumsum(STEP[data[places]])
                    row += [after, int(depth[-1]) if len(depth) else 0, min(0, int(depth.min())) if len(depth) else 0]
                out.append(row)
            yield pd.DataFrame(out, columns=["path", "part", *names])

    return ranges.select("path", "part").mapInPandas(effect, "path string, part long, " + ", ".join(f"{n} long" for n in names))


def _walk(rows: list[tuple], state: int, depth: int) -> Iterator[tuple[int, int, int]]:
    """State and depth on entry, and lowest depth, of each row of effects in turn; a last one for what comes after."""
    for row in rows:
        after, change, low = row[3 * state:3 * state + 3]
        yield state, depth, depth + low
        state, depth = after, depth + change
    yield state, depth, depth


def _folded(rows: DataFrame, keys: list[str], order: str, fold: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold`` of each key's other columns in order. Most files have a group of few rows, so groups pass in one sorted stream."""
    columns = [*keys, order, *[c for c in rows.columns if c not in (*keys, order)]]
    names = [field.split()[0] for field in schema.split(", ")]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple]]]:
        now, held = None, []
        for pdf in batches:
            for row in zip(*[pdf[c].tolist() for c in columns]):
                key = row[:len(keys)]
                if held and key != now:
                    yield now, held
                    held = []
                now = key
                held.append(row[len(keys):])
        if held:
            yield now, held

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, held in groups(batches):
            out += fold(key, held)
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    dealt = rows.select(*columns).repartition(tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(stream, schema)


def entered(ranges: DataFrame, size: int) -> DataFrame:
    """(path, part, state, depth, low): how each range of a file is entered, and the lowest depth in it."""
    effects = cut(_effects(ranges, size).withColumn("block", F.floor(F.col("part") / BLOCK)))

    def summary(key: tuple, rows: list[tuple]) -> list[tuple]:
        row = [*key]
        for s in STATES:
            steps = list(_walk([r[1:] for r in rows], s, 0))
            row += [*steps[-1][:2], min(low for _, _, low in steps)]
        return [tuple(row)]

    def blocks(key: tuple, rows: list[tuple]) -> list[tuple]:
        steps = _walk([r[1:] for r in rows], OUTSIDE, 0)
        return [(*key, r[0], state, depth) for r, (state, depth, _) in zip(rows, steps)]

    def parts(key: tuple, rows: list[tuple]) -> list[tuple]:
        state, depth = rows[0][-2:]
        return [(key[0], r[0], *step) for r, step in zip(rows, _walk([r[1:] for r in rows], state, depth))]

    fields = ", ".join(f"{k}{s} long" for s in STATES for k in "sdl")
    whole = _folded(effects, ["path", "block"], "part", summary, f"path string, block long, {fields}")
    starts = _folded(whole, ["path"], "block", blocks, "path string, block long, state long, depth long")
    return _folded(effects.join(starts, ["path", "block"]), ["path", "block"], "part", parts,
                   "path string, part long, state long, depth long, low long")


def roots(known: DataFrame, size: int, schema: str) -> DataFrame:
    """(path, root): the root object, in which ``"@start:end"`` stands for each array, with # for each object."""

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, part, state, depth in zip(pdf["path"], pdf["part"], pdf["state"], pdf["depth"]):
                data, at = _read(path, part * size, size), part * size
                places, _ = scan(data, state)
                after = depth + np.cumsum(STEP[data[places]])
                step = STEP[data[places]]
                # Places where a container of the root opens, or has just closed.
                turns = np.flatnonzero(((after == 2) & (step == 1)) | ((after == 1) & (step == -1)))
                text, begin, shown = [], 0, depth <= 1
                for i in turns.tolist():
                    place = int(places[i])
                    if step[i] == 1:
                        mark = b"@" if data[place] == OPENS_ARRAY else b"#"
                        text += [data[begin:place].tobytes(), b'"%s%d:' % (mark, at + place)]
                        shown = False
                    else:
                        text.append(b'%d"' % (at + place))
                        begin, shown = place + 1, True
                if shown:
                    text.append(data[begin:].tobytes())
                out.append((path, part, b"".join(text)))
            yield pd.DataFrame(out, columns=["path", "part", "text"])

    pieces = known.where("low <= 1").select("path", "part", "state", "depth").mapInPandas(
        outline, "path string, part long, text binary")
    joined = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"]))
    text = F.regexp_replace(F.decode(whole, "UTF-8"), "^\uFEFF", "")  # a byte order mark is no value
    return joined.select("path", F.from_json(text, schema).alias("root"))


def elements(files: DataFrame, array: str, schema: str, size: int = RANGE) -> DataFrame:
    """(path, root, element text) of the array named ``array`` of every file (path, length).

    ``schema`` describes the root's own fields that are wanted, which must fit a row.
    """
    ranges = files.select("path", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / size))).alias("part"))
    ranges = ranges.repartition(tasks(files.sparkSession), "path", "part")
    known = cut(entered(ranges, size))
    found = roots(known, size, f"{schema}, {array} string")
    span = [F.regexp_extract(f"root.{array}", r"^@(\d+):(\d+)$", i).try_cast("long") for i in (1, 2)]
    found = found.select("path", F.col("root").dropFields(array).alias("root"), span[0].alias("start"), span[1].alias("end"))
    todo = known.join(found.where("end IS NOT NULL"), "path").where(
        f"part BETWEEN floor(start / {size}) AND floor(end / {size})")

    def elements_of(path: str, part: int, state: int, depth: int, start: int, end: int) -> list[bytes]:
        at, data = part * size, _read(path, part * size, size)
        places, state = scan(data, state)
        after = depth + np.cumsum(STEP[data[places]])
        cuts = places[((data[places] == COMMA) & (after == 2)) | (places + at == start) | (places + at == end)] + at
        cuts = cuts[(cuts >= start) & (cuts <= end)].tolist()
        if not cuts:
            return []
        raw = data.tobytes()
        out = [raw[a + 1 - at:b - at] for a, b in zip(cuts, cuts[1:])]
        if cuts[-1] < end:
            # The last one ends in a later range.
            rest, depth, next_at = [raw[cuts[-1] + 1 - at:]], int(after[-1]), at + len(data)
            while True:
                data = _read(path, next_at, AHEAD)
                places, state = scan(data, state)
                after = depth + np.cumsum(STEP[data[places]])
                stops = places[((data[places] == COMMA) & (after == 2)) | (places + next_at == end)]
                if len(stops):
                    rest.append(data[:stops[0]].tobytes())
                    break
                rest.append(data.tobytes())
                depth, next_at = int(after[-1]) if len(after) else depth, next_at + len(data)
            out.append(b"".join(rest))
        return [e for e in (e.strip(b" \t\r\n") for e in out) if e]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["path", "part", "state", "depth", "start", "end"]).to_pylist()
            for i, row in enumerate(rows):
                texts = elements_of(**row)
                if texts:
                    index = pa.array(np.full(len(texts), i))
                    held = batch.select(["path", "root"])
                    yield pa.RecordBatch.from_arrays(
                        [held.column(0).take(index), held.column(1).take(index),
                         pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["path", "root", "element"])

    fields = known.sparkSession.createDataFrame([], f"path string, root struct<{_struct(schema)}>, element string").schema
    return todo.select("path", "root", "part", "state", "depth", "start", "end").repartition(
        tasks(files.sparkSession), "path", "part").mapInArrow(cut_out, fields)


def _struct(schema: str) -> str:
    """``a string, b long`` as the fields of a struct."""
    return ", ".join(": ".join(field.split(None, 1)) for field in schema.split(","))
