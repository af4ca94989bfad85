"""Panel operators: classified units to salience and valence by entity and period, shrunk, scored and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.expressions import weight

# Fixed values.
SOURCE_WEIGHTS = {"sec_filing": 1.0, "transcript": 1.0, "ir_release": 0.8, "news": 0.6, "social": 0.3}
MATERIALITY_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.2}
PRIOR_STRENGTH, TRAILING = 10, 4
CELL = ["ticker", "period"]


def _judged(units: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    return units.where(F.col("source_category").isin(*sources) & F.col("ai_relevance").isNotNull())


def raw_salience(units: DataFrame, sources: tuple[str, ...] = ("sec_filing",)) -> DataFrame:
    """Weighted share of substantive units by cell; gated-out units stay in the denominator, failed (null) ones don't."""
    w = weight("source_category", SOURCE_WEIGHTS, 1.0)
    m = weight("materiality", MATERIALITY_WEIGHTS, 0.0)
    sub = F.when(F.col("ai_relevance") == "substantive", 1).otherwise(0)
    cells = _judged(units, sources).groupBy(*CELL).agg(F.count("*").alias("n_units"), F.sum(sub).alias("n_substantive"), F.sum(w).alias("den"), F.sum(w * m * sub).alias("num"))
    return cells.withColumn("salience_raw", F.coalesce(F.try_divide("num", "den"), F.lit(0.0)))


def shrink_salience(cells: DataFrame, k: float = PRIOR_STRENGTH, trailing: int = TRAILING, strict_prior: bool = False) -> DataFrame:
    """Toward the mean of the entity's last `trailing` rows before; the first row's prior is the entity's mean over all rows, or
    with strict_prior its own raw value, which looks at nothing later."""
    one = Window.partitionBy("ticker")
    before = one.orderBy("period").rowsBetween(-trailing, -1)
    first = F.col("salience_raw") if strict_prior else F.avg("salience_raw").over(one)
    lam = F.col("n_units") / (F.col("n_units") + F.lit(float(k)))
    return (
        cells.withColumn("prior", F.coalesce(F.avg("salience_raw").over(before), first)).withColumn("lam", lam).withColumn("salience_shrunk", F.col("lam") * F.col("salience_raw") + (1 - F.col("lam")) * F.col("prior"))
    )


def raw_valence(units: DataFrame, sources: tuple[str, ...] = ("sec_filing",), weight_by_materiality: bool = True) -> DataFrame:
    w = weight("materiality", MATERIALITY_WEIGHTS, 0.0) if weight_by_materiality else F.lit(1.0)
    sub = _judged(units, sources).where("ai_relevance = 'substantive'")
    cells = sub.groupBy(*CELL).agg(F.count("*").alias("n_substantive"), F.sum(w).alias("wsum"), F.sum(w * F.col("valence_ai")).alias("vsum"))
    return cells.withColumn("valence_raw", F.coalesce(F.try_divide("vsum", "wsum"), F.lit(0.0)))


def shrink_valence(cells: DataFrame, k: float = PRIOR_STRENGTH, target: float = 0.0) -> DataFrame:
    lam = F.col("n_substantive") / (F.col("n_substantive") + F.lit(float(k)))
    return cells.withColumn("lam_v", lam).withColumn("valence_shrunk", F.col("lam_v") * F.col("valence_raw") + (1 - F.col("lam_v")) * F.lit(target))


def cross_sectional_z(df: DataFrame, column: str, out: str) -> DataFrame:
    """Population z-score within each period; no dispersion: 0."""
    w = Window.partitionBy("period")
    z = (F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_pop(column).over(w), F.lit(0.0))
    return df.withColumn(out, F.coalesce(z, F.lit(0.0)))


def excess_over_median(df: DataFrame, column: str = "salience_shrunk", out: str = "excess_salience") -> DataFrame:
    return df.withColumn(out, F.col(column) - F.median(column).over(Window.partitionBy("period")))


def exposure_index(units: DataFrame, sources: tuple[str, ...] = ("sec_filing",)) -> DataFrame:
    sal = shrink_salience(raw_salience(units, sources))
    val = shrink_valence(raw_valence(units, sources)).drop("n_substantive")
    zero = {c: 0.0 for c in ("valence_raw", "valence_shrunk", "lam_v", "wsum", "vsum")}
    both = sal.join(val, CELL, "left").fillna(zero).withColumn("aia", F.col("salience_shrunk") * F.col("valence_shrunk"))
    return excess_over_median(cross_sectional_z(cross_sectional_z(both, "aia", "aia_z"), "salience_shrunk", "salience_z"))


def current_ranking(index: DataFrame) -> DataFrame:
    last = index.agg(F.max("period").alias("period"))
    return index.join(F.broadcast(last), "period", "left_semi").orderBy(F.desc("aia"), "ticker")


def last_periods(df: DataFrame, n: int = TRAILING) -> DataFrame:
    """Rows of the n last distinct periods of the whole table. Only distinct periods are ordered in one place."""
    keep = df.select("period").distinct().orderBy(F.desc("period")).limit(n)
    return df.join(F.broadcast(keep), "period", "left_semi")


def trailing_ranking(index: DataFrame, n: int = TRAILING, digits: int = 4) -> DataFrame:
    means = [F.bround(F.avg(c), digits).alias(a) for c, a in (("salience_shrunk", "salience"), ("valence_shrunk", "valence"), ("aia", "aia"), ("aia_z", "aia_z"))]
    return last_periods(index, n).groupBy("ticker").agg(*means, F.sum("n_substantive").alias("n_substantive")).orderBy(F.desc("aia"), "ticker")


def coverage_check(cells: DataFrame, thin: int = 10) -> DataFrame:
    moved = F.abs(F.col("salience_shrunk") - F.col("salience_raw"))
    return cells.agg(F.count("*").alias("n_cells"), F.count_if(F.col("n_units") < thin).alias("n_thin"), F.median(moved).alias("median_move"), F.max(moved).alias("max_move"))


def section_evidence(units: DataFrame, least: int = 15) -> DataFrame:
    sub = units.where("ai_relevance = 'substantive' AND source_category = 'sec_filing' AND section_name <> ''")
    return sub.groupBy("section_name").agg(F.bround(F.avg("valence_ai"), 2).alias("mean_valence"), F.count("*").alias("n")).where(F.col("n") >= least).orderBy("mean_valence", "section_name")
