"""Scan for secrets: fixed patterns, and strings of high entropy, with DataFrame functions only.

Base kinds are patterns; their matches are leftmost and do not overlap within a kind. The method adds
strings of at least MIN_LENGTH characters in which a sliding window of WINDOW characters reaches the
Shannon entropy asked of its character class (hexadecimal or base 64). The window is moved by
incremental counts: the character that enters and the one that leaves change two counts and the sum of
c*log2(c), nothing is counted anew. An allow list suppresses strings that are not secrets (plain words,
numbers, UUIDs, paths), and strings inside a base span are not reported again.

Spans are in code points, the end exclusive. Positions come from splitting the text at the pattern, so
every text is scanned whole.

Defined results: null text is empty and has no spans; repeated rows give a row each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import renamed, text_of

# Fixed values of the contract: kind, pattern (Java), least length of the group that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Each finds a text in which the kind can occur, at less cost than the pattern.
HINT = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
MIN_LENGTH = 20
HEX_BITS, BASE64_BITS = 2.9, 3.6
ALLOWED = (
    r"^[A-Za-z]+$",                     # a word
    r"^[0-9+/_=-]+$",                   # a number, date or rule
    r"^[^0-9]*$",                       # joined words
    r"^[a-z]+([_/-]+[A-Za-z]+)*[_/-]*[0-9]{0,4}$",  # a path or name with a number
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",  # a UUID
    r"(?i)example|placeholder|changeme|xxxxxx",
)
SPAN = "array<struct<start:int,end:int>>"


#: Items of an array that are folded at a time: the copy of a growing array costs no more than this.
STRETCH = 128


def _running(items: Column, zero: Column, carry, emit, kind: str) -> Column:
    """The arrays emit(carry before an item, item) of all items, joined, in time that is linear in the items.

    A long array is cut into stretches: one fold finds the carry before each, others emit within the stretches.
    """
    def folded(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("carry"), F.array().cast(kind).alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(
            carry(acc["carry"], x).alias("carry"), F.concat(acc["out"], emit(acc["carry"], x)).alias("out")), lambda acc: acc["out"])

    def bound(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / STRETCH).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(held, i * STRETCH + 1, STRETCH))
        first = F.struct(zero.alias("carry"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(parts, first, lambda acc, part: F.struct(
            F.aggregate(part, acc["carry"], carry).alias("carry"), F.concat(acc["out"], F.array(acc["carry"])).alias("out")), lambda acc: acc["out"])
        zipped = F.arrays_zip(parts.alias("part"), starts.alias("start"))
        return F.when(F.size(held) > STRETCH, F.flatten(F.transform(zipped, lambda z: folded(z["part"], z["start"])))).otherwise(
            folded(held, zero))

    return F.transform(F.array(items), bound)[0]  # a lambda's variable is computed once, an expression for each item


def _spans(text: Column, pattern: str, matches: Column, groups: Column, keep) -> Column:
    """Spans of the matches whose group keep() accepts; the gaps between them come from splitting at the pattern."""
    # Zipped, so that the text is split once and not for each match; the gap behind the last match has none.
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), groups.alias("group"))
    sizes = F.transform(F.slice(rows, F.lit(1), F.size(matches)), lambda x: F.struct(
        F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), keep(x["group"]).alias("keep")))

    def emit(at: Column, x: Column) -> Column:
        span = F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"))
        return F.when(x["keep"], F.array(span)).otherwise(F.array().cast(SPAN))

    return _running(sizes, F.lit(0), lambda at, x: at + x["gap"] + x["size"], emit, SPAN)


def _outside(spans: Column, base: Column) -> Column:
    """The spans that lie in none of the base spans: those that end after all base spans which begin no later."""
    def marked(these: Column, kind: int) -> Column:
        return F.transform(these, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def emit(reach: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        return F.when((x["kind"] == 1) & (x["end"] > reach), F.array(span)).otherwise(F.array().cast(SPAN))

    both = F.array_sort(F.concat(marked(base, 0), marked(spans, 1)))
    found = _running(both, F.lit(-1), lambda reach, x: F.when(x["kind"] == 0, F.greatest(reach, x["end"])).otherwise(reach), emit, SPAN)
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), found).otherwise(spans)


def _at_least(least: int):
    return lambda string: F.char_length(string) >= least


def _with_spans(rows: DataFrame, kind: str, pattern: str, keep) -> DataFrame:
    spans = _spans(F.col("_text"), pattern, F.col("_match"), F.col("_group"), keep)
    return rows.withColumn(f"_{kind}", F.when(F.size("_match") > 0, spans).otherwise(F.array().cast(SPAN))).drop(
        "_match", "_group")


def _base_spans(rows: DataFrame) -> DataFrame:
    for kind, pattern, group, least in BASE:
        text = F.col("_text")
        if kind == "hex":
            # A match of 24 or more is a whole run, so shorter runs need not be listed.
            pattern = f"{pattern[:-1]}{{{least},}}"
        hinted = text.rlike(HINT[kind])
        rows = rows.withColumn("_match", F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        rows = rows.withColumn("_group", F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))
        rows = _with_spans(rows, kind, pattern, _at_least(least))
    return rows


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of the windows of a string over ALPHABET, by incremental counts.

    A string shorter than the window has no window; the result is 0.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    start = F.struct(zero.alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves, i = x["enters"], x["leaves"], x["i"]
        gone = F.transform(acc["n"], lambda c, j: F.when(j == leaves, c - 1).otherwise(c))
        count_out = F.get(acc["n"], leaves)
        less = F.when(leaves > 0, F.get(table, count_out - 1) - F.get(table, count_out)).otherwise(0.0)
        count_in = F.get(acc["n"], enters) - F.when(enters == leaves, 1).otherwise(0)
        total = acc["sum"] + less + F.get(table, count_in + 1) - F.get(table, count_in)
        bits = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(0.0)
        return F.struct(F.transform(gone, lambda c, j: F.when(j == enters, c + 1).otherwise(c)).alias("n"),
                        total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    def best(places: Column) -> Column:
        moves = F.transform(places, lambda place, i: F.struct(
            (i + 1).alias("i"), place.alias("enters"), F.when(i >= window, F.get(places, i - window)).otherwise(0).alias("leaves")))
        return F.aggregate(moves, start, step, lambda acc: acc["best"])

    # The characters are numbered once; taking them out of the string one by one would walk it from its start each time.
    places = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(F.char_length(string) >= window, F.transform(F.array(places), best)[0]).otherwise(0.0)


def _suspicious(string: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | string.rlike(pattern)
    bits = F.when(string.rlike("(?i)^[0-9a-f]+$"), HEX_BITS).otherwise(BASE64_BITS)
    return F.when(allowed, False).otherwise(window_entropy(string) >= bits)


def scan(docs: DataFrame) -> DataFrame:
    """All columns and ``secret_spans``: array of (start, rank, kind, end), sorted; ranks follow the kinds as listed.

    A column ``secret_spans`` of the table gives way to it.
    """
    docs = docs.drop("secret_spans")
    return _scanned(docs)[0].toDF(*docs.columns, "secret_spans")


def _scanned(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their columns renamed and ``secret_spans`` at the end, and the new name of every column."""
    rows, at = renamed(docs)
    rows = _base_spans(rows.withColumn("_text", text_of(at["text"])))
    text = F.col("_text")
    strings = F.when(text.rlike(r"[A-Za-z0-9+/_=-]{20}"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    rows = _with_spans(rows.withColumn("_match", strings).withColumn("_group", F.col("_match")), "entropy", CANDIDATE,
                       _suspicious)
    rows = rows.withColumn("_entropy", _outside(F.col("_entropy"), F.concat("_assign", "_access", "_hex")))

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    kinds = [ranked(rank, kind) for rank, kind in enumerate(("assign", "access", "hex", "entropy"))]
    return rows.select(*at.values(), F.array_sort(F.concat(*kinds)).alias("secret_spans")), at


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans."""
    rows = scan(docs.select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter(spans, lambda s: s["kind"] != "entropy"))
    return rows.select("doc_id", count("assign"), count("access"), count("hex"),
                       F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the mark and n_chars counted anew; texts without a span are unchanged."""
    rows, at = _scanned(docs)
    text = F.col(at["text"])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.when(s["start"] >= acc["at"], gap).otherwise(F.lit(""))).alias("out"),
            s["end"].alias("at")))

    tail = lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.char_length(text)))
    clean = F.when(F.size("secret_spans") > 0, F.aggregate("secret_spans", start, step, tail)).otherwise(text)
    rows = rows.withColumn("clean", clean)
    changes = {"text": F.col("clean")}
    if "n_chars" in at:
        n = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        changes["n_chars"] = F.when(F.size("secret_spans") > 0, n).otherwise(F.col(at["n_chars"]))
    return rows.select(*[changes.get(c, F.col(name)) for c, name in at.items()]).toDF(*docs.columns)
