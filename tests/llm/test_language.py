from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from capturelake.llm.common import utf8
from capturelake.llm.language import SPACE, Parser, identify, suffix_automaton

MORPHEMES = {"aa": "the ing tion er and ou sh".split(), "bb": "der sch ung ein ich ü ß".split(), "cc": "que ción ado ñ los í".split()}


def text(lang, seed, n=60):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(MORPHEMES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))


def test_automaton_accepts_exactly_the_substrings():
    draw = random.Random(1)
    s = [draw.randrange(3) for _ in range(60)]
    moves = suffix_automaton(s)

    def accepts(x):
        state = 0
        for c in x:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    subs = {tuple(s[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        x = tuple(draw.randrange(3) for _ in range(draw.randint(1, 7)))
        assert accepts(x) == (x in subs)


def test_phrases_are_greedy_longest_matches():
    parser = Parser({"aa": ["abcabx abd"], "bb": ["xyz zyx"]})
    data, offsets = utf8(pa.array(["abcabd", "zyxq xyz", "abdabcabx"]))
    for i in range(3):
        codes = np.frombuffer(data[offsets[i]:offsets[i + 1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        symbols = parser._dense(parser.symbol[codes])
        got = parser.phrases(symbols[None, :])[:, 0].tolist()
        want = []
        for source in (["abcabx abd"], ["xyz zyx"]):
            held, at, n = parser._dense(parser.symbol[np.frombuffer(source[0].encode("utf-32-le"), np.uint32)]).tolist(), 0, 0
            subs = {tuple(held[a:b]) for a in range(len(held)) for b in range(a + 1, len(held) + 1)}
            while at < len(symbols):
                size = 1
                while at + size < len(symbols) and tuple(symbols[at:at + size + 1].tolist()) in subs:
                    size += 1
                at, n = at + size, n + 1
            want.append(n)
        assert got == want
    assert SPACE == 0


def greedy(parser, sources, symbols):
    """Phrases of one parse from left to right, by looking at every substring."""
    held = ["".join(map(chr, parser._dense(parser.symbol[np.frombuffer(t.encode("utf-32-le"), np.uint32)]))) for t in sources]
    text, at, n = "".join(map(chr, symbols)), 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at:at + size + 1] in h for h in held):
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_go_over_blocks_and_texts_do_not():
    """Periodic and long shared stretches, whose phrases are longer than a block, besides ordinary text."""
    draw = random.Random(4)
    long_a, long_b = "ab" * 700 + "c" + "ab" * 300, text("aa", 1, 500)
    sources = {"aa": [long_a, long_b], "bb": ["xyz zyx", text("bb", 3, 300)]}
    parser = Parser(sources)
    texts = [long_a[3:] + "q" + long_a[:900], long_b[7:2000] * 2, text("aa", 2, 900), text("bb", 4, 40) + "x" * 700, "ba" * 1200, "", "xyz", "日" * 600]
    texts += ["".join(draw.choice([long_a[:draw.randrange(600)], long_b[:draw.randrange(900)], "q", "xyz"]) for _ in range(6)) for _ in range(12)]
    data, offsets = utf8(pa.array(texts))
    calls, plain = [], parser.phrases

    def watched(blocks, follows):
        out = plain(blocks, follows)
        calls.append((out, follows))
        return out

    parser.phrases = watched
    parser.predict(data, offsets)
    (out, follows), = calls
    start = np.flatnonzero(~follows)
    got = np.add.reduceat(out, start, axis=1)
    shown = [t for t in texts if t]
    assert got.shape == (2, len(shown)) and follows.sum() > 20
    for i, t in enumerate(shown):
        symbols = parser._dense(parser.symbol[np.frombuffer(t.encode("utf-32-le"), np.uint32)]).tolist()
        assert [greedy(parser, sources[name], symbols) for name in ("aa", "bb")] == got[:, i].tolist()


def test_languages_that_differ_in_rare_letters_only():
    """120 common letters are shared; each language has 1,000 letters of its own, each of them rare."""
    shared, own = [chr(0x4E00 + i) for i in range(120)], {"x": [chr(0x5000 + i) for i in range(1000)], "y": [chr(0x6000 + i) for i in range(1000)]}

    def made(lang, seed, n):
        draw = random.Random(f"{lang}{seed}")
        return "".join(draw.choice(own[lang]) if draw.random() < 0.3 else draw.choice(shared) for _ in range(n))

    parser = Parser({lang: [made(lang, i, 250) for i in range(60)] for lang in own})
    assert parser.symbols > 2000 > parser.width
    rows = [(lang, made(lang, 1000 + i, 120)) for lang in own for i in range(100)]
    names, _ = parser.predict(*utf8(pa.array([t for _, t in rows])))
    assert sum(a == b for a, (b, _) in zip(names, rows, strict=True)) >= 198


def test_held_out_documents_are_recognised(documents):
    rows = [(i, text(lang, i), lang) for lang in MORPHEMES for i in range(300 * (ord(lang[0]) - 97), 300 * (ord(lang[0]) - 97) + 80)]
    rows += [(5000, None, "aa"), (5001, "123 ... !", "aa"), (5002, "", None), (5003, "日本語", None), (None, text("bb", 1), "bb"),
             rows[0], (5004, text("cc", 9, 9000), None)]
    df = documents([r[:2] for r in rows]).drop("lang")
    labelled = df.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS turn", "2 AS piece")
    out = {r.doc_id: r for r in identify(labelled).collect()}
    assert len(out) == len(rows) - 1
    for i, t, lang in rows:
        r = out[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert 0 <= r.score <= 1
            if lang:
                assert r.lang_pred == lang
    assert out[5004].lang_pred == "cc" and out[5003].lang_pred in MORPHEMES


def test_without_labels_and_without_rows(documents, spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in identify(none).collect()] == [("und", 0.0)]
    assert identify(none.limit(0)).count() == 0
