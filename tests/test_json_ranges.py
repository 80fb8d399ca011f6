"""Documents of other tools, read in byte ranges: every split position gives the rows of the whole parse."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from capturelake.sources import json_ranges, readers
from capturelake.sources.json_ranges import ESCAPED, INSIDE, OUTSIDE, scan


def plain_scan(data: bytes, state: int):
    places = []
    for i, c in enumerate(data):
        if state == ESCAPED:
            state = INSIDE
        elif state == INSIDE:
            state = ESCAPED if c == 92 else OUTSIDE if c == 34 else INSIDE
        elif c == 34:
            state = INSIDE
        elif c in b"[]{},":
            places.append(i)
    return places, state


def test_scan_equals_a_walk():
    draw = random.Random(3)
    for _ in range(4000):
        data, state = [], draw.choice([OUTSIDE, INSIDE, ESCAPED])
        first = now = state
        for _ in range(draw.randrange(14)):
            c = draw.choice(b'a"\\[]{},' if now != OUTSIDE else b'a"[]{},')  # no backslash outside strings
            data.append(c)
            now = plain_scan(bytes([c]), now)[1]
        data = bytes(data)
        places, after = scan(np.frombuffer(data, np.uint8), first)
        assert (places.tolist(), after) == plain_scan(data, first), (data, first)


ODD = 'a "quoted\\ , ] } [ { \\" name\\\\'
FRAMES = [{"file_path": f"{ODD}{i}.jpg", "capture_index": i, "timestamp_ns": 7 + i, "w": 4000, "fl_x": 1.5,
           "transform_matrix": [[1, 0], [0, i]], "extra": {"frames": [{"file_path": "no"}], "é": "[{,"}} for i in range(3)]
DOCS = {
    "plain": json.dumps({"camera_model": "OPENCV", "coordinate_system": ODD, "frames": FRAMES}),
    "last": json.dumps({"cameras": [{"file_path": "no", "frames": [1]}], "frames": FRAMES[:2], "x": {"frames": [{}]}, "camera_model": "é"},
                       indent=2, ensure_ascii=False),
    "twice": '{"frames": [{"file_path": "no"}], "frames" : [ {"file_path": "yes"} , {} ] }',
    "nulls": '﻿{"frames": [null, {"file_path": null}], "camera_model": null}',
    "none": '{"camera_model": "frames", "k": "@1:9"}', "empty": '{"frames": [ ]}', "null": '{"frames": null}',
    "object": '{"frames": {"file_path": "no", "w": 1}}', "blank": "", "short": json.dumps({"frames": FRAMES})[:-2],
    "text": '{"frames": "[{}, {}]", "camera_model": "\\\\"}',
}


def write(tmp_path, docs):
    for name, text in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "transforms.json").write_text(text, encoding="utf-8")
    return str(tmp_path)


def flat(df):
    return sorted(map(repr, df.select("session_id", "camera_model", "coordinate_system", "file_path", "capture_index", "timestamp_ns",
                                      "w", "fl_x", "transform_matrix").collect()))


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 22])
def test_every_split_gives_the_rows_of_the_whole_parse(spark, tmp_path, size):
    root = write(tmp_path, DOCS)
    want = flat(readers.read_transforms(spark, root))
    assert sum("plain" in r for r in want) == 3 and sum("last" in r for r in want) == 2 and sum("yes" in r for r in want) == 1
    assert flat(readers.read_transforms_ranges(spark, root, size)) == want


def test_blocks_of_ranges(spark, tmp_path, monkeypatch):
    """More ranges than a group takes; elements longer than what is read ahead."""
    monkeypatch.setattr(json_ranges, "BLOCK", 5)
    long = [{"file_path": "x" * 3000 + str(i), "capture_index": i} for i in range(4)]
    root = write(tmp_path, {"long": json.dumps({"frames": long, "camera_model": "m"}), "plain": DOCS["plain"]})
    monkeypatch.setattr(json_ranges, "AHEAD", 11)
    assert flat(readers.read_transforms_ranges(spark, root, 100)) == flat(readers.read_transforms(spark, root))


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    root = write(tmp_path, {"s": json.dumps({"frames": [{"capture_index": i} for i in range(2000)]})})
    files = spark.createDataFrame([(f"{root}/s/transforms.json", (tmp_path / "s" / "transforms.json").stat().st_size)],
                                  "path string, length long")
    known = json_ranges.entered(files.select("path", F.explode(F.expr("sequence(0L, (length - 1) div 1000)")).alias("part")), 1000)
    assert rows_of(known.where("part = 0"), "state", "depth") == [(0, 0)]
    assert known.where("low <= 1").count() == 2  # only the ends of the document touch the root
    assert readers.read_transforms_ranges(spark, root, 1000).agg(F.sum("capture_index")).first()[0] == 1999000
