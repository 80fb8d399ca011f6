"""Files found and read by tasks: the rows of Spark's own readers, in as many tasks as there are cores, not files."""

from __future__ import annotations

import json

import pytest
from helpers import rows_of
from test_files import documents

from capturelake.sources import listing, readers, writers

SCHEMA = "a int, b array<string>, c struct<d:double>"
TEXTS = {
    "plain": b'{"a": 1, "b": ["x", null], "c": {"d": 2}}', "lines": b'\n{\n "a":\n 2}\n', "array": b'[{"a": 3}, {"a": 4}, null]',
    "none": b"[]", "broken": b'{"a": 5', "blank": b" \n", "empty": b"", "mark": b'\xef\xbb\xbf{"a": 6}', "wide": '{"a": 7, "b": ["é"]}'.encode("utf-16"),
    "number": b"5", "wrong": b'{"a": "x", "c": {"d": 1}}', "bytes": b'{"b": ["\xff"]}', "after": b'{"a": 8} {"a": 9}', "badarray": b'[{"a": 1}, {',
}


def test_documents_are_those_of_the_multiline_reader(spark, tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / "s 1" / name).mkdir(parents=True)
        (tmp_path / "s 1" / name / "doc_1.json").write_bytes(text)
        (tmp_path / "s 1" / name / ".doc_2.json").write_bytes(text)
    for hidden in ("_manifests", ".tmp"):
        (tmp_path / hidden).mkdir()
        (tmp_path / hidden / "doc_1.json").write_text('{"a": 99}')
    want = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "doc_*.json").option("multiLine", True)
            .schema(SCHEMA).json(str(tmp_path)))
    got = readers.read_documents(spark, str(tmp_path), SCHEMA, "doc_*.json")
    assert sorted(map(repr, got.select("a", "b", "c").collect())) == sorted(map(repr, want.collect()))
    assert {r.session_id for r in got.collect()} <= set(TEXTS) and {r.file_name for r in got.collect()} == {"doc_1.json"}


def test_many_small_files_take_no_more_tasks_than_few(spark, tmp_path):
    writers.write_keyframes(documents(spark, [(f"s{i % 40}", i, 4000, None) for i in range(700)]), str(tmp_path))
    for name in ("transforms.json", "session_camera.json"):
        for i in range(400):
            folder = tmp_path / f"t{i}"
            folder.mkdir(exist_ok=True)
            (folder / name).write_text(json.dumps({"camera_id": "0", "frames": []}))
    root, tasks = str(tmp_path), listing.tasks(spark)
    for rows, count in ((readers.read_keyframes(spark, root), 700), (readers.read_session_cameras(spark, root), 400),
                        (readers.transforms_sessions(spark, root), 400)):
        assert rows.count() == count
        assert rows.rdd.getNumPartitions() <= tasks
        assert not any(f.endswith(".json") for f in rows.inputFiles())  # the driver holds no list of them


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_keyframes(spark, str(tmp_path / "no"))


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 20])
def test_every_split_gives_all_lines(spark, tmp_path, size):
    texts = {"a": "head [\nx1\nx22\n\nx3", "b": "\n\n", "c": "", "d": "x\r\nx2\n", "e": "x" * 30}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.txt").write_bytes(text.encode())
    got = listing.lines(spark, str(tmp_path), "t.txt", r"\[$", "x", size)
    want = [(n, line) for n, text in texts.items() for line in text.replace("\r", "").split("\n")[:None if text and not text.endswith("\n") else -1]]
    assert sorted((r.place[0], r.line) for r in got.collect()) == sorted(want)
    assert rows_of(got.where("start"), "place") == [(f"{n}/t.txt",) for n in "abde"]
    assert {(r.place[0], r.head) for r in got.collect()} == {(n, "head [" if n == "a" else None) for n, _ in want}


def test_lines_longer_than_a_block(tmp_path):
    import pyarrow as pa
    place = tmp_path / "t"
    place.write_bytes(b"aaaa\nbb\ncccccc")
    got = []
    for start in range(0, 14, 3):
        with pa.OSFile(str(place)) as source:
            got += listing._split(source, start, start + 3, 2)
    assert got == ["aaaa", "bb", "cccccc"]
