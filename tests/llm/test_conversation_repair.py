from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from capturelake.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Every edit sequence that is not plainly too dear, by rows; the least (cost, audit, lines)."""
    found = []

    def go(i, roles, cost, audit, lines):
        if cost > 3 * len(rows):
            return
        word = "".join(r[:1] for r in roles)
        body = word.removeprefix("s")
        if body != ("ua" * len(body))[:len(body)]:
            return
        if i == len(rows) and (word == "" or (body and len(body) % 2 == 0)):
            found.append((cost, audit, lines))
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(i, (*roles, role), cost + 2, audit + "I", (*lines, role + ":"))
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", lines)
            if fault in ("truncated", ""):
                more = fault == "truncated"
                if role:
                    go(i + 1, (*roles, role), cost + more, audit + "K", (*lines, f"{role}:{text}"))
                for given in ("user", "assistant"):
                    go(i + 1, (*roles, given), cost + 2 + more, audit + "R", (*lines, f"{given}:{text}"))

    go(0, (), 0, "", ())
    return min(found)


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(damage([r for r in rows if r[0] == c]),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = cheapest(judged)
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    return {r.conv_id: tuple(r[k] for k in COLUMNS) for r in df.collect()}


def test_small_conversations_against_every_edit(spark):
    draw = random.Random(5)
    rows = []
    for c in range(120):
        for t in range(draw.randrange(1, 6)):
            rows.append((c, draw.choice([t, t, t + 3, t - 1, None]) if c % 3 else t,
                         draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         draw.choice(["Yes.", "No!", "so", "What?\n ", " \t", "", None, "é ", f"t{t}."])))
    rows.append((None, 0, "user", "hello."))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS c", "2 AS copies", "3 AS digest", "4 AS fault", "5 AS place", "6 AS kind", "7 AS cost")
    assert result(cr.audit_damaged(df)) == plain(rows)


def test_a_long_conversation_split_over_tasks(spark):
    """The stretches of one conversation meet in the same audit as one parse of it."""
    draw = random.Random(9)
    rows = [(7, t, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"text {t}.", f"text {t}", "", "again."]))
            for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        faults = cr._faults(cr.keyed(df))
        assert faults.repartitionByRange(*cr._ORDER).select(F.spark_partition_id()).distinct().count() > 1
        audit = cr._audits(faults).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, cells = set(), []
    for _, _, role, text in rows:
        fault = (cr._BLANK if not text.strip() else cr._DUPLICATE if (role, text) in seen else cr._TRUNCATED if text[-1] not in ".!?" else cr._SOUND)
        seen.add((role, text))
        cells.append(cr.leaf(role[0], fault))
    left = {(0, 0): (0, "")}
    for cell in cells:  # from left to right, without spans
        left = cr.joined(left, cell)
    assert (audit.cost, audit.audit) == cr.least(left)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi"), (1, 3, "user", "Hi"), (2, 0, "user", " "),
            (3, 0, "user", "One."), (3, 1, "assistant", "Two.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in cr.repaired_turns(df).orderBy("conv_id", "position").collect()]
    one = cr.repair(df).where("conv_id = 1").first()
    lines = "\n".join(f"{r[3]}:{r[4]}" for r in got if r[0] == 1)
    assert hashlib.sha256(lines.encode()).hexdigest() == one.repaired_sha256
    assert "".join(r[5] for r in got if r[0] == 1) == one.audit.replace("D", "")
    assert [r for r in got if r[0] == 2] == []
    assert [r[2:] for r in got if r[0] == 3] == [(0, "user", "One.", "K"), (1, "assistant", "Two.", "K")]


def test_many_repeats_wide_gaps_and_empty_table(spark):
    rows = [(1, 5, "user", "same.")] * 500 + [(1, 2**62, "assistant", "end."), (2, None, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = result(cr.repair(df))
    assert got[1][:7] == (2**62 - 5 - 1, 0, 499, 0, 499, 1497, "K" + "D" * 499 + "K")
    assert got[2][:7] == (0, 0, 0, 0, 0, 2, "KI")
    assert cr.audit_damaged(df.limit(0)).count() == 0
    assert cr.repaired_turns(df.limit(0)).count() == 0
