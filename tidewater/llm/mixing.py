"""Op 6. Mixing sources to target weights by entropy balancing.

Among all document rates that give every source its target of words, the ones nearest the base rates in relative entropy
(counted in words) are base * exp(dual of the source), held at CAP. The duals solve a convex problem; its Newton steps run over
all sources at once as a join of the current duals with a histogram of words by source and base rate, which is all the dual
needs of the documents. Rates then become whole copies: each source is dealt into blocks of about BLOCK documents by a hash,
and a block carries its rounding error from its longest document to its shortest, so it ends within about half its shortest
one of its share. No block depends on another and nothing is random, so reruns agree. With base rates of 1, as in the query, a
source's tilt is one number; base rates by document make it a tilt of theirs.

Sources may be as many as documents: they are numbered by ranges of their order, targets rise in rounds of one aggregate each, and
only FEW_SOURCES or fewer are broadcast. Null text: size 0. Null source: a source of its own, last in order. A source without
words gets none. Repeated rows are each their own document; rows alike in id, size and text that are more than a HEAVY-th of all
(fewer than HEAVY such kinds) are spread over blocks by their place in the input. Empty tables give empty results. Extra columns
can be carried along; one named like a result, in whatever case, gives way. Very long texts are only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import carried, discard, materialise, shuffle_partitions
from .words import Words, slices

WEIGHTS, SHARE, CAP, BLOCK = (5.0, 2.0, 1.0), 1.0, 3.0, 4096
#: Sources that may be broadcast; beyond that they are joined by salted keys.
FEW_SOURCES, SALTS, HEAVY = 10_000, 64, 1000
OWN = ("size", "source_size", "target", "rate", "copies", "taken")
INNER = ("_mix_text", "_mix_key", "_mix_base", "_mix_dual", "_mix_blocks", "_mix_salt", "_mix_tie", "_mix_block", "_mix_n")


def with_size(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with size, the number of words of the text, and a hash of it that tells rows apart; the text column only if asked."""
    rest = carried(docs, (*OWN, *INNER, text_col))
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.xxhash64(f"`{text_col}`").alias("_mix_text"), F.col(f"`{text_col}`"))
    n = len(rest) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(n)):
                part = batch.slice(i, j - i)
                size = pa.array(Words(part.column(n)).count.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[: n + keep_text], size], [*rest, "_mix_text", *([text_col] if keep_text else []), "size"])

    schema = T.StructType([*rows.schema.fields[: n + keep_text], T.StructField("size", T.LongType())])
    return rows.mapInArrow(run, schema)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (key, source, source_size) with target: weights repeat in code point order, null last; a target stops at cap
    times its source's size and the excess goes to the others by weight: a common level rises until no further target reaches
    its cap, one aggregate a round."""
    order = F.col("source").asc_nulls_last()
    placed = sources.repartitionByRange(shuffle_partitions(sources.sparkSession), order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_range", F.shiftright("_at", 33)), "mix-ordered")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.shiftleft("_range", 33)
    ranked = placed.join(F.broadcast(before), "_range").withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(place, F.lit(len(weights))).cast("int")])
    ranked = materialise(ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size")).drop("_range", "_at", "_before"), "mix-sources")
    discard(placed)
    total = ranked.agg(F.sum("source_size")).first()[0]
    if not total:
        return ranked.withColumn("target", F.lit(0.0))
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        n, held, free = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        level, capped = (share * float(total) - held) / free, n
    return ranked.withColumn("target", F.least("most", F.lit(level) * F.col("weight")) if free else F.col("most"))


def solve(histogram: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-12, most: int = 50) -> DataFrame:
    """(key, dual): Newton steps on sum(words * min(cap, base * exp(dual))) = target for every source at once. histogram:
    (key, base, words); goals: (key, target). Steps are held to one unit, so an overshoot beyond the cap comes back."""
    duals = goals.select("key", F.col("target"), F.lit(0.0).alias("dual"))
    stored = None
    rate = F.least(F.lit(float(cap)), F.col("base") * F.exp("dual"))
    for _ in range(most):
        sums = histogram.join(duals, "key").groupBy("key", "target", "dual").agg(
            F.sum(F.col("words") * rate).alias("have"), F.sum(F.when(rate < cap, F.col("words") * rate).otherwise(0.0)).alias("slope")
        )
        gap = F.col("target") - F.col("have")
        down = F.when(gap < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        step = F.when(F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)), 0.0).when(F.col("slope") <= 0, down).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / F.col("slope"))))
        new = materialise(sums.select("key", "target", (F.col("dual") + step).alias("dual"), F.abs(step).alias("moved")), "mix-duals")
        moved = new.agg(F.max("moved")).first()[0] or 0.0
        if stored is not None:
            discard(stored)
        stored = new
        duals = new.drop("moved")
        if moved < 1e-13:
            break
    return duals.select("key", "dual")


def _round(rest: list[str]):
    def run(table: pa.Table) -> pa.Table:
        size, rate = table.column("size").to_numpy(), table.column("rate").to_numpy()
        order = np.lexsort((table.column("_mix_tie").to_numpy(), -size))
        copies = np.zeros(len(size), np.int64)
        error = 0.0
        for i in order.tolist():
            n = int(size[i])
            if n == 0:
                continue
            r = float(rate[i])
            low = int(r + 1e-9)
            high = low if r - low < 1e-9 else low + 1
            error += r * n
            c = min(high, max(low, int(error / n + 0.5) if error > 0 else 0))
            error -= c * n
            copies[i] = c
        return table.select(rest).append_column("copies", pa.array(copies))

    return run


def mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, base_col: str | None = None) -> DataFrame:
    """sized's columns with source_size, target, rate, copies and taken. base_col: base rates; 1 for all without it."""
    source = F.col(f"`{source_col}`")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    base = F.lit(1.0) if base_col is None else F.coalesce(F.col(f"`{base_col}`").cast("double"), F.lit(1.0))
    rest = [c for c in carried(sized, (*OWN[1:], *INNER)) if c.lower() != "size"]
    text = F.col("_mix_text") if "_mix_text" in sized.columns else F.lit(0).cast("long")
    keyed = sized.select(*[F.col(f"`{c}`") for c in rest], F.col("size"), key.alias("_mix_key"), base.alias("_mix_base"), F.xxhash64(F.col(f"`{id_col}`"), "size", text).alias("_mix_tie"))
    counted = keyed.groupBy(F.col("_mix_key").alias("key"), source.alias("source"), F.col("_mix_base").alias("base")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    cells = materialise(counted, "mix-cells")
    sources = cells.groupBy("key", "source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    goals = materialise(targets(sources, weights, share, cap), "mix-goals")
    duals = solve(cells.select("key", "base", "words"), goals.where("source_size > 0"), cap)
    plan = goals.join(duals, "key", "left").select(F.col("key").alias("_mix_key"), "source_size", "target", F.col("dual").alias("_mix_dual"), F.ceil(F.col("n") / BLOCK).alias("_mix_blocks"))
    n_sources, n_rows = goals.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_sources <= FEW_SOURCES:
        joined = keyed.join(F.broadcast(plan), "_mix_key")
    else:
        salted = plan.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # merged by hint: Spark sizes what explode() makes as what it is given, so it may broadcast it
        joined = keyed.withColumn("_mix_salt", F.pmod("_mix_tie", F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["_mix_key", "_mix_salt"]).drop("_mix_salt")
    alike = keyed.groupBy("_mix_key", "_mix_tie").agg(F.count("*").alias("_mix_n")).where(F.col("_mix_n") > max(BLOCK, n_rows // HEAVY))
    spread = F.when(F.col("_mix_n").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_mix_n") / BLOCK))).otherwise(0)
    rated = (
        joined.withColumn("rate", F.coalesce(F.least(F.lit(float(cap)), F.col("_mix_base") * F.exp("_mix_dual")), F.lit(0.0)))
        .join(F.broadcast(alike), ["_mix_key", "_mix_tie"], "left")
        .withColumn("_mix_block", F.pmod(F.col("_mix_tie") + spread, "_mix_blocks").cast("int"))
        .drop("_mix_base", "_mix_dual", "_mix_blocks", "_mix_n")
    )
    kept = [c for c in rated.columns if c not in INNER]
    schema = T.StructType([*(rated.schema[c] for c in kept), T.StructField("copies", T.LongType())])
    dealt = rated.groupBy("_mix_key", "_mix_block").applyInArrow(_round(kept), schema)
    return dealt.withColumn("taken", F.col("copies") * F.col("size"))
