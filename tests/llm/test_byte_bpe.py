from __future__ import annotations

import hashlib
import random
import struct

import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from capturelake.llm.byte_bpe import ByteBpe, RankQueue, decode, encode, load_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "aab   \n\t'sé́日本1２2　\x1c\x85\xa0.,!!-=\U0001f600dreTHE’ "


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def texts():
    draw = random.Random(4)
    out = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    return out + ["", " ", "   ", "a" * 5000, "ab" * 3000, "-=" * 2000, "x" + " " * 999 + "y"]


def test_ids_are_those_of_the_library(library):
    bpe = ByteBpe(load_ranks(PATH), public_tokenizers.PATTERN, memo=50)
    for text, ids in zip(texts(), bpe.texts(pa.array(texts())), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids).decode() == text


def test_query_columns(documents, library):
    rows = [(i, t) for i, t in enumerate(texts()[-400:])] + [(None, "null id"), (1, None), (2, "twice"), (2, "twice")]
    got = sorted((tuple(r) for r in round_trip(documents(rows), PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_then_decode(documents, spark):
    rows = [(1, "Hello  world é"), (2, ""), (3, None)]
    ids = encode(documents(rows), PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.data).decode() for r in decode(ids, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {1: "Hello  world é", 2: "", 3: ""}
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(decode(nothing, PATH, public_tokenizers.PATTERN).first().data) == b""
    assert round_trip(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_queue_gives_lowest_rank_and_leftmost_position():
    draw, queue = random.Random(1), RankQueue(200_000)
    entries = [(draw.choice([0, 63, 64, 4095, 4096, 199_999, draw.randrange(200_000)]), draw.randrange(99)) for _ in range(2000)]
    for rank, position in entries:
        queue.push(rank, position)
    out = []
    while queue.top:
        out.append(queue.pop())
    assert out == sorted(entries)
