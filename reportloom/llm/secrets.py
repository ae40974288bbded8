"""Secret scan: pattern findings plus strings of high sliding-window entropy. Built-in functions only.

Three base kinds are found by pattern. The method adds candidate strings (maximal runs of token characters that no
base finding overlaps) in which some window of ``WINDOW`` characters has a Shannon entropy at or above its class's
bound. The entropy is kept by incremental counts: each step takes off the leaving character, adds the entering
one, and updates the sum of c * log2(c) from the two counts that changed.

Nulls and empty texts have no findings. Every row is handled alone, so repeated rows, ties, extra columns and
empty tables need no rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import fresh

#: Kinds in their order, pattern, and the fewest characters (of group 2 for ``assign``).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]+", 24),
}
#: What must be in a text for the kind's pattern to give a finding; scanned first as it is cheap.
NEEDS = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"(?<![0-9a-f])[0-9a-f]{24}"}
WINDOW = 20
#: Characters by which the blocks of a candidate go on, and matches that are listed together.
BLOCK = 256
#: Character classes of candidate strings in order: kind, pattern of the whole string, bits a character.
CLASSES = [
    ("entropy_hex", r"^[0-9a-f]+$", 3.0),
    ("entropy_upper", r"^[A-Z0-9]+$", 3.6),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", 3.8),
]
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A candidate must mix digits with letters: long words, joined words and rulers do not. So random strings of letters
#: alone are not scored; one in 170 of 24 random base64 characters has no digit.
MIXED = [r"[0-9]", r"[A-Za-z]"]
#: Values known to be harmless: repeated characters, counting sequences, UUIDs, documentation placeholders.
ALLOWED = [
    r"^(.)\1+$",
    r"(?i)0123456789|abcdefghij",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|xxxxxx",
]


def _located(text: Column, pattern: str, keep) -> Column:
    """array<struct<start, end, value>> of the pattern's leftmost non-overlapping matches, in code points.

    The text between matches comes from ``split`` and the matches from ``regexp_extract_all``; their lengths add
    up to the positions.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        here = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["value"].isNotNull() & keep(x["value"]), F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    # A list is copied for each match that is added, so matches are added in blocks, and blocks to a list of blocks.
    block = lambda acc, part: F.aggregate(part, F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out")), step)
    parts = lambda z: F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(BLOCK)), lambda i: F.slice(z, i + 1, BLOCK))
    zipped = F.array(F.arrays_zip(gaps.alias("gap"), found.alias("value")))  # in a list of one, so that it is worked out once
    blocks = F.aggregate(F.transform(zipped, parts)[0], F.array(F.struct(F.lit(0).alias("at"), none.alias("out"))), lambda acc, part: F.concat(acc, F.array(block(acc, part))))
    return F.flatten(F.transform(blocks, lambda b: b["out"]))


def _base(text: Column, kind: str) -> Column:
    pattern, least = BASE[kind]
    size = (lambda m: F.length(F.regexp_extract(m, pattern, 2))) if kind == "assign" else F.length
    found = F.transform(
        _located(text, pattern, lambda m: size(m) >= least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(list(BASE).index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")),
    )
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


def max_window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest entropy in bits of any window; null for values shorter than one.

    The value is worked through in overlapping blocks, so that the time is linear in its length (a character's place is
    found by counting from the beginning of its string). A step takes the entering and the leaving character's counts from the window's own characters and changes the sum by
    those two alone, so that it costs the window's length, whatever the alphabet.
    """
    term = lambda c: c * math.log2(c) if c else 0.0
    gains = F.array(*[F.lit(term(c + 1) - term(c)) for c in range(window)])  # of the sum, when a count of c grows by one
    bits = lambda s: F.lit(math.log2(window)) - s / window
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("best"))

    def most(block):
        def step(acc, i):
            size = F.least(i - 1, F.lit(window - 1))  # of what lies in the window before and after the step
            stay = F.substring(block, i - size, size)
            gain = lambda at: F.get(gains, size - F.length(F.replace(stay, F.substring(block, at, F.lit(1)), F.lit(""))))
            s = acc["s"] + gain(i) - F.when(i > window, gain(i - window)).otherwise(F.lit(0.0))
            return F.struct(s.alias("s"), F.when(i > window, F.greatest(acc["best"], bits(acc["s"]))).alias("best"))

        last = lambda acc: F.when(F.length(block) >= window, F.greatest(acc["best"], bits(acc["s"])))
        return F.aggregate(F.sequence(F.lit(1), F.length(block)), zero, step, last)

    blocks = F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{1,{BLOCK + window - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    return F.array_max(F.transform(blocks, most))


def _entropy(text: Column, base: Column) -> Column:
    allowed = lambda v: F.coalesce(*[F.when(v.rlike(p), F.lit(True)) for p in ALLOWED], F.lit(False))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def classed(x):
        kind = F.lit(None).cast("string")
        rank = F.lit(None).cast("int")
        for k, (name, pattern, bound) in reversed(list(enumerate(CLASSES))):
            within = x["value"].rlike(pattern)
            over = within & (max_window_entropy(x["value"]) >= bound)
            kind = F.when(within, F.when(over, F.lit(name))).otherwise(kind)
            rank = F.when(within, F.lit(len(BASE) + k)).otherwise(rank)
        return F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), kind.alias("kind"))

    free = F.filter(
        _located(text, CANDIDATE, lambda v: v.rlike(MIXED[0]) & v.rlike(MIXED[1]) & ~allowed(v)),
        lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    return F.when(text.rlike(CANDIDATE), F.filter(F.transform(free, classed), lambda x: x["kind"].isNotNull())).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds ``out``: array<struct<start, rank, end, kind>> by start, then kind; positions count code points, end exclusive.

    Base findings come first in rank; null and empty texts give an empty array. No row is dropped or repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[_base(text, k) for k in BASE]))
    name = fresh(df, "base_")
    df = df.withColumn(name, base)
    return df.withColumn(out, F.array_sort(F.concat(F.col(name), _entropy(text, F.col(name))))).drop(name)


def secrets_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, SHA-256 of the base findings, all findings as one string."""
    spans = F.col("spans_")
    found = find_secrets(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "spans_")
    base = F.filter(spans, lambda x: x["rank"] < len(BASE))
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every finding in ``text_col`` replaced by ``mask``.

    Overlapping findings become one mask; a text without findings, null included, stays as it is.
    """
    whole = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.concat(F.substring(whole, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.concat(acc["out"], F.when(x["start"] >= acc["at"], gap).otherwise(F.lit(""))).alias("out"),
        )

    name = fresh(df, "spans_")
    rebuilt = F.aggregate(F.col(name), zero, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    found = find_secrets(df, text_col, name)
    return found.withColumn(text_col, F.when(F.size(name) > 0, rebuilt).otherwise(whole)).drop(name)
