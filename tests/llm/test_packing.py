from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from capturelake.llm.packing import Recent, WordIds, differencing, fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_rebuild_the_documents(documents, words):
    rows = [(i, words(i, 40 * i % 700, 900)) for i in range(60)] + [
        (100, None), (101, ""), (102, " \n\t"), (103, words(5, 9000, 2000)), (104, "It's  İΣς x y\u0085z é é"),
        (None, "no id"), (105, "A,b.C!\x0bd")]
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    out = pack(documents(rows).repartition(3), PATH).toPandas()
    for i, group in out.sort_values("start").groupby("doc_id", dropna=False):
        own, at = ids[None if np.isnan(i) else int(i)], 0
        for r in group.itertuples():
            assert r.start == at and r.doc_tokens == len(own)
            assert zlib.crc32(own[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(own)
    assert out["doc_id"].nunique(dropna=False) == len(rows)
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == np.cumsum([0, *group["length"][:-1]]).tolist()
        assert group["length"].sum() == group["sequence_tokens"].iloc[0] <= 2048
    # One window short of full for each map task at most, and little beside.
    total = out["length"].sum()
    assert out["sequence_id"].nunique() <= total / 2048 * 1.02 + 3


def test_repeated_rows_are_packed_as_often(documents):
    out = pack(documents([(1, "a b"), (1, "a b")]).coalesce(1), PATH).collect()
    assert len(out) == 2 and len({(r.sequence_id, r.offset) for r in out}) == 2


def test_empty_table(documents):
    assert pack(documents([]), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_windows_hold_everything_and_are_near_equal(seed):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 513, 400)
    loads = np.bincount(fit(sizes, 2048), weights=sizes)
    assert loads.max() <= 2048 and loads.sum() == sizes.sum()
    assert len(loads) <= -(-sizes.sum() // 2048) + 1
    loads = np.bincount(differencing(sizes, 50), weights=sizes, minlength=50)
    assert loads.max() - loads.min() <= 10


def test_differencing_small_cases():
    assert sorted(np.bincount(differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    assert differencing(np.array([5]), 1).tolist() == [0]
    assert np.bincount(fit(np.full(7, 1500), 2048)).max() == 1


def test_words_as_the_tokenizer_has_them():
    """Runs of letters, digits and marks, contractions, capitals, other scripts: word by word and as one text."""
    draw = np.random.default_rng(1)
    parts = ["a", "Zu", "é", "É", "ß", "ÿ", "÷", "×", "1", "23", ".", ",%", "$$$", "'s", "'", "'LL", "-", "_", "\\", "^", "`", "[", "K", "ſ", "İ", "é", "λ",
             "日本", " ", " ", "\x01", "ﬁ", "²", "ª", "\U0001f600"]
    texts = [" ".join("".join(draw.choice(parts, draw.integers(1, 5))) for _ in range(draw.integers(1, 12))) for _ in range(1500)]
    words, tokenizer = WordIds(PATH, memo=40_000), Tokenizer.from_file(PATH)
    for _ in range(2):
        data = [t.encode() for t in texts]
        ids, ends = words.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
        got = np.split(ids, ends[:-1])
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_ids_stay_within_their_bytes():
    memo = Recent(50_000)
    for i in range(2000):
        memo.put(f"w{i}", bytes(8))
        assert memo.get("w0") is None or i < 500 or memo.get("w0") == bytes(8)
        memo.get("w5")
    assert memo.get("w5") == memo.get("w1999") == bytes(8) and memo.get("w600") is None
    assert Recent.EACH * (len(memo.new) + len(memo.old)) <= 50_000
    memo.put("x" * 100_000, b"")
    assert memo.get("x" * 100_000) is None
