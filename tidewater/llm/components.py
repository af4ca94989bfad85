"""Connected components by alternating large-star and small-star rounds, each a shuffle of links, until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Every node's neighbours (larger: those above it; else those below, and itself) point at the smallest in reach."""
    if larger:
        both = links.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(links.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    else:
        both = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionAll(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """(id, root) for every node of links (src, dst: long); root is the smallest id of its component."""
    now = links
    before = None
    for _ in range(most):
        after = materialise(_star(_star(now, True), False), "components")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now is not links:
            discard(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    # at rest every link points at its component's smallest node
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("root")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("root")).unionAll(roots)
