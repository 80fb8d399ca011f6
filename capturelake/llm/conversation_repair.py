"""Conversation repair: the cheapest edits that give a well-formed exchange, by weighted interval parsing.

Role initials of a repaired conversation read ``(s?(ua)+)?``. That language has four states (nothing yet, after s,
after u, after a), and the repair grammar in Chomsky normal form has a nonterminal for every pair of them:
[p,q] -> [p,r] [r,q], and [p,q] -> a row with an edit that leads from p to q. Keep, Rerole, Delete are edits of a row;
inserted turns cost but take no row, so every row takes the closure of insertions before it, and the end takes one
more. A cell holds for every nonterminal the least (cost, audit) over its span of rows, the audit being the initials of
the edits. Audits of one cost over one span are never prefixes of each other (the longer one would have more
insertions and cost more), so the least cells of two neighbours give the least cell of both. Every bracketing of a span
yields the same language, so each span has one split, and spans are combined bottom-up by length: 1, 2, 4 and so on.

A conversation may have any share of the rows. Rows are dealt by ranges of (conversation, order), which split it, each
task parses its stretch of it, and the cells of the stretches, one for each task, are combined. The audit then meets
the turns in one sorted stream that holds one turn at a time: a SHA-256 cannot be computed in parts.

Order: turn with null first, then role, then SHA-256 of the text; equal rows lie side by side. A turn is blank without a
character other than ASCII white space, else a duplicate if role and text came earlier, else truncated if the last such
character is none of ``.!?``. Null role or text: one space. A role without initial cannot be kept. A null conversation
id is a conversation of its own. Other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import join_groups, working_table

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What a turn with this initial leads to.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What an inserted or given role leads to from a state, and its name.
GIVEN = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
FINAL = (0, 3)
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")

_BLANK, _DUPLICATE, _TRUNCATED, _SOUND = range(4)
_ORDER = ("c", "given", "turn", "role", "digest")


def keyed(turns: DataFrame) -> DataFrame:
    """c (text of the conversation id, marked so that null differs from all), turn, role, text."""
    return turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32 of ``conv_id:turn`` (null: one space), modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 sets its role to user.
    """
    name = [F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *name).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def _closure() -> dict:
    """(p, q) -> least (cost, audit) of insertions alone."""
    out = {}
    for p in range(4):
        state, word = p, ""
        out[p, p] = (0, "")
        for _ in range(3):
            state, word = GIVEN[state][0], word + "I"
            out.setdefault((p, state), (INSERT * len(word), word))
    return out


_INSERTED = _closure()
_NONE = {(p, p): (0, "") for p in range(4)}


def joined(left: dict, right: dict) -> dict:
    """The cell of two neighbouring spans."""
    out: dict = {}
    for (p, r), (cost, word) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                total = cost + more
                held = out.get((p, q))
                if held is None or total < held[0] or (total == held[0] and word + rest < held[1]):
                    out[p, q] = (total, word + rest)
    return out


def leaf(initial: str, fault: int, copies: int = 1) -> dict:
    """The cell of one turn, or of one turn and its repeats, after the closure of insertions."""
    if fault in (_BLANK, _DUPLICATE):
        return joined(_INSERTED, {(p, p): (DELETE * copies, "D" * copies) for p in range(4)})
    fine = CUT_OFF if fault == _TRUNCATED else 0
    row = {}
    for p in range(4):
        options = [((p, p), DELETE, "D"), ((p, GIVEN[p][0]), REROLE + fine, "R")]
        if (p, initial) in STEP:
            options.append(((p, STEP[p, initial]), fine, "K"))
        for span, cost, letter in options:
            row[span] = min(row.get(span, (cost, letter)), (cost, letter))
    cell = joined(_INSERTED, row)
    return joined(cell, leaf(initial, _DUPLICATE, copies - 1)) if copies > 1 else cell


class Parse:
    """Cells of neighbouring spans, combined bottom-up: two of one length become one of the next as soon as both are there."""

    def __init__(self):
        self.spans: list[tuple[int, dict]] = []

    def add(self, cell: dict) -> None:
        level = 0
        while self.spans and self.spans[-1][0] == level:
            cell, level = joined(self.spans.pop()[1], cell), level + 1
        self.spans.append((level, cell))

    def cell(self) -> dict:
        """The cell of all spans so far."""
        whole = _NONE
        for _, cell in reversed(self.spans):
            whole = joined(cell, whole)
        return whole


def parsed(cells) -> dict:
    """The cell of a whole run of spans."""
    run = Parse()
    for cell in cells:
        run.add(cell)
    return run.cell()


def least(cell: dict) -> tuple[int, str]:
    """(cost, audit) of the cheapest whole parse."""
    done = joined(cell, _INSERTED)
    return min(done[0, q] for q in FINAL if (0, q) in done)


def _faults(turns: DataFrame) -> DataFrame:
    """Distinct (conversation, turn, role, text) with how often, its fault, and whether it came earlier."""
    rows = turns.select(
        "c", F.col("turn").isNotNull().cast("int").alias("given"), "turn", "role", F.sha2("text", 256).alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    rows = working_table(rows.groupBy(*_ORDER, "blank", "open").agg(F.count("*").alias("copies")))
    groups = rows.groupBy("c", "role", "digest").agg(F.min(F.struct("given", "turn")).alias("seen"), F.count("*").alias("rows"))
    rows = join_groups(rows, groups, ["c", "role", "digest"], "rows")
    first = F.struct("given", "turn").eqNullSafe(F.col("seen"))
    fault = (F.when(F.col("blank"), _BLANK).when(~first, _DUPLICATE).when(F.col("open"), _TRUNCATED).otherwise(_SOUND))
    return rows.select(*_ORDER, F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"), "copies")


_CELLS = "array<struct<p: int, q: int, cost: long, audit: string>>"


def _unpacked(cells) -> dict:
    return {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in cells}


def _stretches(batches):
    """One row for every conversation of a task's sorted rows: order of its first row, end initials, cell."""
    import functools

    cell_of = functools.lru_cache(maxsize=4096)(leaf)
    head, run, last, illegal = None, Parse(), "", 0

    def out():
        packed = [{"p": p, "q": q, "cost": cost, "audit": word} for (p, q), (cost, word) in run.cell().items()]
        return head[0], dict(zip(_ORDER[1:], head[1:5], strict=True)), head[5], last, illegal, packed

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (*_ORDER, "initial", "fault", "copies")), strict=True):
            initial, fault, copies = row[5:]
            if head is None or head[0] != row[0]:
                if head is not None:
                    yield out()
                head, run, illegal = row, Parse(), 0
            else:
                illegal += last + initial not in LEGAL
            illegal += copies - 1
            last = initial
            run.add((cell_of if copies < 64 else leaf)(initial, fault, copies))
    if head is not None:
        yield out()


def _as_arrow(run, schema, most: int = 2000):
    """Rows that a task function yields, in record batches."""
    def go(batches):
        import pyarrow as pa

        kinds, rows = schema(), run(batches)
        while held := list(itertools.islice(rows, most)):
            columns = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, kinds, strict=True)], schema=kinds)
    return go


def _stretch_schema():
    import pyarrow as pa

    cell = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    first = pa.struct([("given", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string())])
    return pa.schema([("c", pa.string()), ("first_row", first), ("initial", pa.string()), ("final", pa.string()),
                      ("illegal", pa.int64()), ("cells", pa.list_(cell))])


def _whole(batches):
    for batch in batches:
        for c, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            illegal = sum(x["illegal"] for x in parts)
            illegal += sum(a["final"] + b["initial"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
            cost, audit = least(parsed(_unpacked(x["cells"]) for x in parts))
            yield c, illegal, cost, audit


def _whole_schema():
    import pyarrow as pa

    return pa.schema([("c", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def _audits(faults: DataFrame) -> DataFrame:
    """c, illegal, cost, audit of every conversation that has rows."""
    sorted_rows = faults.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    stretches = sorted_rows.mapInArrow(_as_arrow(_stretches, _stretch_schema),
                                       "c string, first_row struct<given: int, turn: long, role: string, digest: string>, "
                                       f"initial string, final string, illegal long, cells {_CELLS}")
    parts = stretches.groupBy("c").agg(F.sort_array(F.collect_list(
        F.struct("first_row", "initial", "final", "illegal", "cells"))).alias("parts"))
    return parts.mapInArrow(_as_arrow(_whole, _whole_schema), "c string, illegal long, cost long, audit string")


def _stream(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit before its turns in order, all of one conversation in one sorted stream."""
    rows = turns.select("c", F.lit(1).alias("place"), F.col("turn").isNotNull().cast("int").alias("given"), "turn", "role",
                        F.sha2("text", 256).alias("digest"), "text", F.lit(0).cast("long").alias("illegal"), F.lit(0).cast("long").alias("cost"))
    heads = audits.select("c", F.lit(0).alias("place"), F.lit(0).alias("given"), F.lit(None).cast("long").alias("turn"),
                          F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"), "illegal", "cost")
    order = ("c", "place", *_ORDER[1:])
    return heads.unionByName(rows).repartition("c").sortWithinPartitions(*order).select("c", "place", "turn", "role", "text", "illegal", "cost")


def _repaired(batches):
    """(kind, c, ...) events of a sorted stream: 'audit' with its row, 'turn' for every turn that stays or comes."""
    audit, at, state, open_ = "", 0, 0, None

    def given(edit, turn, text):
        nonlocal state
        state, role = GIVEN[state]
        return "turn", open_, turn, role, text, edit

    def rest():
        nonlocal at
        while at < len(audit):
            at += 1
            yield given("I", None, "")

    for batch in batches:
        for c, place, turn, role, text, illegal, cost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if place == 0:
                yield from rest()
                audit, at, state, open_ = text, 0, 0, c
                yield "audit", c, illegal, cost, audit, ""
                continue
            while audit[at] == "I":
                at += 1
                yield given("I", None, "")
            edit = audit[at]
            at += 1
            if edit == "K":
                state = STEP[state, role[:1]]
                yield "turn", c, turn, role, text, "K"
            elif edit == "R":
                yield given("R", turn, text)
    yield from rest()


def _digests(batches):
    import hashlib

    import pyarrow as pa

    out, hashed, before = [], None, b""

    def ready():
        names = ["c", "illegal", "cost", "audit", "repaired_sha256"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for kind, c, a, b, text, _ in _repaired(batches):
        if kind == "audit":
            if out:
                out[-1][-1] = hashed.hexdigest()
            if len(out) >= 2000:
                yield ready()
                out = []
            out.append([c, a, b, text, ""])
            hashed, before = hashlib.sha256(), b""
        else:
            hashed.update(before + b.encode() + b":" + text.encode())
            before = b"\n"
    if out:
        out[-1][-1] = hashed.hexdigest()
        yield ready()


def _turns(batches):
    import pyarrow as pa

    schema = pa.schema([("c", pa.string()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("edit", pa.string())])
    out, position, size = [], 0, 0
    for kind, c, turn, role, text, edit in _repaired(batches):
        if kind == "audit":
            position = 0
            continue
        position += 1
        out.append((c, position, turn, role, text, edit))
        size += len(text)
        if len(out) >= 4096 or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _named(df: DataFrame, turns: DataFrame) -> DataFrame:
    """df with conv_id, read back from c, in place of c."""
    kind = turns.schema["conv_id"].dataType
    name = F.when(F.col("c") != "", F.expr("substring(c, 2)")).cast(kind)
    return df.select(name.alias("conv_id"), *[x for x in df.columns if x != "c"])


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position from 1, turn (null: inserted), role, text, edit (K, R or I)."""
    rows = keyed(turns)
    held = _stream(rows, _audits(_faults(rows)))
    return _named(held.mapInArrow(_turns, "c string, position long, turn long, role string, text string, edit string"), turns)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``conversations`` (of ``turns``, if not given), with zeros where it has no turns.

    conv_id; gaps (turn numbers missing between the least and the greatest; null beyond 64 bits), blank, duplicate,
    truncated, illegal (neighbouring initials not su, ua, au) of the turns as they come; cost and audit of the
    cheapest edits (ties: least audit); repaired_sha256 of the repaired ``role:text`` lines.
    """
    rows = keyed(turns)
    faults = working_table(_faults(rows))
    sums = {"blank": F.when(F.col("fault") == _BLANK, F.col("copies")).otherwise(0),
            "duplicate": F.when(F.col("fault") == _DUPLICATE, F.col("copies")).when(F.col("fault") > _DUPLICATE, F.col("copies") - 1).otherwise(0),
            "truncated": (F.col("fault") == _TRUNCATED).cast("long")}
    counts = faults.groupBy("c", "turn").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    wide = [F.col(x).cast("decimal(38,0)") for x in ("high", "low")]
    counts = counts.groupBy("c").agg(*[F.sum(k).alias(k) for k in sums], F.max("turn").alias("high"), F.min("turn").alias("low"),
                                     F.count("turn").alias("held"))
    counts = counts.withColumn("gaps", F.coalesce(wide[0] - wide[1] + 1 - F.col("held"), F.lit(0)).try_cast("long"))
    held = _stream(rows, _audits(faults)).mapInArrow(_digests, "c string, illegal long, cost long, audit string, repaired_sha256 string")
    every = keyed(turns if conversations is None else conversations).select("c").distinct()
    out = every.join(counts, "c", "left").join(held, "c", "left")
    zero = [F.when(F.col("held").isNull(), F.lit(0).cast("long")).otherwise(F.col(k).cast("long")).alias(k)
            for k in ("gaps", *sums, "illegal", "cost")]
    return _named(out.select("c", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                             F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), turns)


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """The audit of conversations after ``damaged``, for every conversation there was before it."""
    return repair(damaged(conversations), conversations)
