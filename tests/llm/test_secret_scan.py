from __future__ import annotations

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from capturelake.llm.secret_scan import ALPHABET, redact, scan_digest, window_entropy

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def texts():
    draw = random.Random(2)
    bits = ["token", "=", ": ", '"', "'", "abc", "abcdef", "API_KEY", "apikey", "passWord", " ", "AKIA", "Q7" * 9, "0f" * 13, "é",
            "😀", "\n", "secret", "x.y-z_/+=", "deadbeef"]
    out = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 25))) for _ in range(400)]
    return out + ["", "token=token:abcdef", "token=token=abcdef", "é😀 password: hunter22 " * 40, "AKIA" + "A" * 15, "a" * 24 + "g" + "0" * 23]


def test_base_spans_match_python(documents):
    rows = list(enumerate(texts())) + [(9000, None), (None, "token=abcdef"), (1, texts()[1])]
    out = scan_digest(documents(rows)).collect()
    assert len(out) == len(rows)
    want = {(i, t or "") for i, t in rows}
    found = set()
    for r in out:
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        known = ",".join(":".join(s) for s in spans if s[0] != "entropy")
        assert r.base_sha256 == hashlib.sha256(known.encode()).hexdigest()
        text = next(t for i, t in want if i == r.doc_id and ",".join(f"{k}:{a}:{b}" for a, _, k, b in base(t)) == known)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base(text)) for k in ("assign", "access", "hex"))
        found.add(r.doc_id)
    assert found == {i for i, _ in rows}


def test_incremental_entropy_is_that_of_each_window(spark):
    draw = random.Random(1)
    rows = ["".join(draw.choice(ALPHABET[:draw.choice([2, 16, 66])]) for _ in range(draw.randint(1, 60))) for _ in range(60)]

    def brute(s):
        bits = [-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) for w in (s[i:i + 20] for i in range(len(s) - 19))]
        return max(bits, default=0.0)

    df = spark.createDataFrame([(s,) for s in rows], "s string").select("s", window_entropy(F.col("s")).alias("bits"))
    for r in df.collect():
        assert abs(r.bits - brute(r.s)) < 1e-9


def test_entropy_spans_and_allow_list(documents):
    key = "wJalrXUtnFEMI7K9MDENGbPxRfiCYq3A"
    rows = [(1, f"é see {key} there"), (2, "thisisaverylongwordwithoutanydigits"), (3, "0123456789-0123456789-0123456789"),
            (4, "123e4567-e89b-12d3-a456-426614174000"), (5, f"token = {key}"), (6, "some/path/to/a/longer/file2024")]
    spans = {r.doc_id: r.spans for r in scan_digest(documents(rows)).collect()}
    assert spans == {1: "entropy:6:38", 2: "", 3: "", 4: "", 5: "assign:0:40", 6: ""}


def test_redaction(documents):
    df = documents([(1, "é token = abcdefgh and " + "0f" * 20 + "!"), (2, "clean"), (3, None), (4, "")], n_chars=-1)
    out = redact(df)
    assert out.columns == df.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {1: ("é [SECRET] and [SECRET]!", 24), 2: ("clean", -1), 3: (None, -1), 4: ("", -1)}
    assert scan_digest(documents([])).count() == 0 and redact(documents([])).count() == 0


def test_no_python_in_the_plan(documents):
    df = redact(documents([(1, "x")]))
    plan = df._jdf.queryExecution().executedPlan().toString() + scan_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_gives_the_same_spans(documents):
    import duckdb
    import pandas as pd

    from capturelake.llm.queries import OP8_SQL

    draw = random.Random(8)
    runs = ["".join(draw.choice(ALPHABET[:draw.choice([16, 36, 62, 66])]) for _ in range(draw.randint(15, 50))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts() + [f"é {a}, {b}" for a, b in zip(runs, runs[1:], strict=False)])] + [(9000, None)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    want = sorted(con.execute(OP8_SQL).df()[names].itertuples(index=False, name=None))
    got = sorted(tuple(r[n] for n in names) for r in scan_digest(documents(rows)).collect())
    assert got == want
    assert sum("entropy" in r[-1] for r in got) > 30


def test_long_candidates_and_texts_with_very_many_spans_in_linear_time(spark):
    """A megabyte of keys, and one string of many thousand characters; each is a matter of seconds."""
    import base64
    import hashlib
    import time

    from pyspark.sql import functions as F

    from capturelake.llm.secret_scan import scan

    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(30_000)]
    odd = [base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()[:24] for i in range(4000)]
    odd = [x for x in odd if len(set(x[:20])) >= 15 and any(c.isdigit() for c in x) and any(c.isalpha() for c in x)][:2000]
    one = "".join(hashlib.sha256(str(i).encode()).hexdigest().upper() + "x" for i in range(800))
    df = spark.createDataFrame([(1, " ".join(keys)), (2, " | ".join(odd) + " token=abcdefg " + " ".join(keys[:300])), (3, one)], "doc_id long, text string")
    start = time.time()
    found = {r.doc_id: r.secret_spans for r in scan(df.repartition(3)).select("doc_id", "secret_spans").collect()}
    took = time.time() - start
    assert [(s.start, s.end) for s in found[1]] == [(33 * i, 33 * i + 32) for i in range(30_000)]
    assert {s.kind for s in found[1]} == {"hex"} and [s.kind for s in found[2]].count("hex") == 300
    assert [(s.start, s.end) for s in found[2] if s.kind == "entropy"] == [(27 * i, 27 * i + 24) for i in range(2000)]
    assert [(s.start, s.end) for s in found[3] if s.kind == "entropy"] == [(0, len(one))]
    assert took < 120
    assert df.select(F.max(F.length("text"))).first()[0] > 900_000
