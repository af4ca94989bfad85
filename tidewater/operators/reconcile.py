"""Two scores of the same entities, aligned and compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.expressions import average_rank

T_WEAK, VIF_HIGH, THIN = 1.5, 10, 20


def z(df: DataFrame, column: str, out: str) -> DataFrame:
    """Population z-score over the whole (entity-sized) table, from one aggregate row."""
    stats = df.agg(F.avg(column).alias("_m"), F.nullif(F.stddev_pop(column), F.lit(0.0)).alias("_s"))
    return df.join(F.broadcast(stats)).withColumn(out, F.coalesce((F.col(column) - F.col("_m")) / F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def align(text: DataFrame, market: DataFrame, text_score: str = "aia", market_score: str = "ai_beta") -> DataFrame:
    both = z(z(text.join(market, "ticker"), text_score, "semantic_z"), market_score, "beta_z")
    return both.withColumn("gap", F.col("semantic_z") - F.col("beta_z")).withColumn("abs_gap", F.abs("gap"))


def trailing_scores(index: DataFrame, quarters: int = 4) -> DataFrame:
    """The text side of align(): means of the last periods that the index holds, and the units behind them, by entity."""
    last = index.select("period").distinct().orderBy(F.desc("period")).limit(quarters)
    return index.join(F.broadcast(last), "period").groupBy("ticker").agg(
        F.avg("salience_shrunk").alias("salience"), F.avg("valence_shrunk").alias("valence"), F.avg("aia").alias("aia"), F.sum("n_substantive").alias("n_substantive")
    )


def trajectory(index: DataFrame, ticker: str) -> DataFrame:
    """An entity's scores by period, rounded to three digits."""
    scores = [F.bround(c, 3).alias(c) for c in ("salience_shrunk", "valence_shrunk", "aia")]
    return index.where(F.col("ticker") == ticker).select("period", *scores, "n_substantive").orderBy("period")


def _two_sided_t(rho: float | None, n: int) -> float | None:
    """p of a correlation of n pairs: the tail of Student's t with n - 2 degrees of freedom, by its finite sum."""
    if rho is None or n < 3 or abs(rho) >= 1:
        return None if rho is None or n < 3 else 0.0
    free = n - 2
    angle = np.arctan(abs(rho) * np.sqrt(free / (1 - rho * rho)) / np.sqrt(free))
    term, total, k = (np.cos(angle), np.cos(angle), 3) if free % 2 else (1.0, 1.0, 2)
    while k < free:
        term *= (k - 1) / k * np.cos(angle) ** 2
        total += term
        k += 2
    inside = 2 / np.pi * (angle + np.sin(angle) * (total if free > 1 else 0.0)) if free % 2 else np.sin(angle) * total
    return float(1 - inside)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho, its p by Student's t, n. Ranks need all rows in one task: df is entity-sized."""
    everyone = Window.partitionBy()
    found = df.select(average_rank(a, everyone).alias("ra"), average_rank(b, everyone).alias("rb")).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))

    def with_p(batches):
        for pdf in batches:
            pdf["p"] = [_two_sided_t(None if pd.isna(r) else r, n) for r, n in zip(pdf["rho"], pdf["n"], strict=True)]
            yield pdf

    return found.mapInPandas(with_p, "rho double, n long, p double")


def bootstrap_ci(df: DataFrame, a: str, b: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of the rank correlation over resampled entities. df is entity-sized and gathered in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([a, b])
        r, rho = np.random.default_rng(seed), []
        for _ in range(draws):
            s = pdf.iloc[r.integers(0, len(pdf), len(pdf))]
            x, y = s[a].rank(), s[b].rank()
            if x.nunique() >= 3 and y.nunique() >= 2:
                rho.append(np.corrcoef(x, y)[0, 1])
        low, high = np.percentile(rho, [2.5, 97.5]) if rho else (np.nan, np.nan)
        return pd.DataFrame({"ci_lo": [low], "ci_hi": [high], "draws": [len(rho)]})

    return df.select(a, b).groupBy().applyInPandas(run, "ci_lo double, ci_hi double, draws long")


def largest_gaps(df: DataFrame, n: int = 3) -> DataFrame:
    return df.orderBy(F.desc(F.abs("gap")), "ticker").limit(n)


def triage(df: DataFrame, n: int = 3) -> DataFrame:
    """The largest gaps, and whether weak measurement alone could explain them."""
    weak, collinear, thin = F.abs("ai_t") < T_WEAK, F.col("max_vif") > VIF_HIGH, F.col("n_substantive") < THIN
    return (
        largest_gaps(df, n)
        .withColumn("direction", F.when(F.col("gap") > 0, "text > market").otherwise("market > text"))
        .withColumn("beta_weak", F.coalesce(weak, F.lit(False)))
        .withColumn("beta_collinear", F.coalesce(collinear, F.lit(False)))
        .withColumn("semantic_thin", F.coalesce(thin, F.lit(False)))
        .withColumn("likely_measurement", F.col("beta_weak") | F.col("beta_collinear") | F.col("semantic_thin"))
    )


def quadrants(df: DataFrame, x: str = "salience", y: str = "valence") -> DataFrame:
    split = df.agg(F.median(x).alias("_split"))
    right, up = F.col(x) >= F.col("_split"), F.col(y) >= 0
    name = F.when(right & up, "high/positive").when(right, "high/negative").when(up, "low/positive").otherwise("low/negative")
    return df.join(F.broadcast(split)).withColumn("quadrant", name).withColumnRenamed("_split", "x_split")


def scatter_frame(df: DataFrame, flagged: int = 3) -> DataFrame:
    """Points, whether each is among the largest gaps, and the common axis limit."""
    limit = df.agg((1.25 * F.max(F.greatest(F.abs("semantic_z"), F.abs("beta_z")))).alias("axis_limit"))
    top = largest_gaps(df, flagged).select("ticker", F.lit(True).alias("flagged"))
    return df.join(F.broadcast(limit)).join(F.broadcast(top), "ticker", "left").select("ticker", "semantic_z", "beta_z", F.coalesce("flagged", F.lit(False)).alias("flagged"), "axis_limit")


def near_points(df: DataFrame, key: str, x: str, y: str, near_x: float, near_y: float) -> DataFrame:
    """(key, other) of points that lie within both distances: a join on the cells of a grid of that width and the eight around each,
    so no point meets the far ones."""
    at = df.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), F.floor(F.col(x) / near_x).alias("cx"), F.floor(F.col(y) / near_y).alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    seen = at.withColumn("s", F.explode(around)).select(F.col("key").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    close = (F.abs(F.col("x") - F.col("ox")) < near_x) & (F.abs(F.col("y") - F.col("oy")) < near_y) & (F.col("key") != F.col("other"))
    return at.join(seen, ["cx", "cy"]).where(close).select(F.col("key").alias(key), "other")


#: Where a label may stand about its point, first choice first.
SLOTS = ((0, 12, "center"), (0, -17, "center"), (-13, -4, "right"), (13, -4, "left"))


def label_offsets(points: list[tuple[str, float, float]], span: float) -> dict[str, tuple[int, int, str]]:
    """Where each label of a chart stands: from the top down, the first slot that no near neighbour (within 0.18 and 0.16 of the
    span) has yet; the first if all are taken. A chart holds few points, so this runs where it is drawn."""
    taken: list[tuple[float, float, int]] = []
    out = {}
    for name, x, y in sorted(points, key=lambda p: -p[2]):
        near = {slot for a, b, slot in taken if abs(a - x) < 0.18 * span and abs(b - y) < 0.16 * span}
        slot = min(set(range(len(SLOTS))) - near, default=0)
        taken.append((x, y, slot))
        out[name] = SLOTS[slot]
    return out
