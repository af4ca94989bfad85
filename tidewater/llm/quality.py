"""Op 3. Quality rules as a bitmask ledger.

measure() reads every whole text once and stores its measurements; ledger() evaluates every rule of the catalogue once and
stores the failures as bits; a policy is a named, versioned mask over those bits, so applying one, or asking what each rule of
it removes alone (ablation()), is bitwise arithmetic on the ledger and never reads text again.

A null text counts as empty; an empty text fails `few_words`. Repeated rows are judged alike, empty tables give empty ledgers. All
columns of the input pass through ledger(), except that a column named like a measurement (in whatever case) gives way to it. A
very long text is measured whole, at about 60 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import carried
from .words import WORD_BASE, Words, mix, rolling, slices

REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")
SYMBOLS = "#*$%&|<>"

#: Bit i of fail_bits is rule i. Never reorder; append. Each is SQL over the measurements and true where the text fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_heavy", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_upper > 40 * word_chars"),
    ("exclaiming", "100 * n_exclaim > 50 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is rejected if any bit of mask is set."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "shouting", "exclaiming", "long_words", "short_words"))
POLICIES = (BASE, STANDARD)

_TABLE = np.zeros((3, 256), bool)
_TABLE[0][[ord(c) for c in SYMBOLS]] = True
_TABLE[1][65:91] = True
_TABLE[2][33] = True


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


def _repeat_words(w: Words) -> np.ndarray:
    """Words of each text inside a five-word window that the text holds twice or more."""
    at = w.windows(REPEAT_WINDOW)
    inside = np.zeros(len(w.start) + 1, np.int32)
    if len(at):
        doc = np.searchsorted(w.first, at, "right") - 1
        h = mix(rolling(w.hashes(), at, REPEAT_WINDOW, WORD_BASE) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(h)
        same = np.r_[False, h[order][1:] == h[order][:-1]]
        same[:-1] |= same[1:].copy()
        twice = at[order[same]]
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + REPEAT_WINDOW, -1)
    return _per_text(np.cumsum(inside[:-1]) > 0, w.first)


def _measures(column: pa.Array) -> list[np.ndarray]:
    w = Words(column)
    lines, dups = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        if text:
            whole = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines[i], dups[i] = len(whole), len(whole) - len(set(whole))
    symbols, upper, exclaim = (_per_text(t[w.buf], w.bytes) for t in _TABLE)
    chars = _per_text(((w.buf & 0xC0) != 0x80) & ~w.space, w.bytes)
    return [w.count, chars, symbols, dups, _repeat_words(w), lines, upper, exclaim]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with MEASURES added (long), each read from the whole text."""
    rest = carried(docs, (*MEASURES, "fail_bits"))
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(at)):
                part = batch.slice(i, j - i)
                new = [pa.array(np.asarray(m, np.int64)) for m in _measures(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*rest, *MEASURES])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, MEASURES and fail_bits: bit i is set if rule i fails."""
    bits = " + ".join(f"CASE WHEN {sql} THEN {1 << i}L ELSE 0L END" for i, (_, sql) in enumerate(RULES))
    return measure(docs, text_col).withColumn("fail_bits", F.expr(bits))


def rejected(policy: Policy):
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablation(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: documents failing it, and those that only it rejects. The ledger is first counted by
    its bit patterns (at most 2**rules rows), so nothing but patterns is shuffled."""
    spark = ledger_df.sparkSession
    patterns = ledger_df.groupBy("fail_bits").count()
    rules = spark.createDataFrame([(r, BIT[r], policy.mask) for r in policy.rules], "rule string, bit long, mask long")
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return (
        patterns.join(F.broadcast(rules), hit)
        .groupBy("rule")
        .agg(F.sum("count").alias("n_failed"), F.sum(F.when(alone, F.col("count")).otherwise(0)).alias("n_only_this"))
        .join(rules.select("rule"), "rule", "right")
        .select(F.lit(f"{policy.name}/{policy.version}").alias("policy"), "rule", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_only_this", F.lit(0)).alias("n_only_this"))
    )
