"""From returns and published factors to the table that regressions read: sector residuals, the theme's factor, designs, teardown.
Every input is a long table by date; a factor or a name is a column or a value of one, never a frame of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.timeseries import as_decimals, extreme_moves, gap_check, long_short, orthogonalise

# Fixed values.
STYLES = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "MOM")
SECTOR_ETFS = ("XLK", "XLI", "XLP")
YARDSTICKS = ("AIQ", "SPY")
REPACKAGED = 0.85
WORST_DAY = -0.50


def universe(names: list[str], basket: list[str], controls: tuple[str, ...] = SECTOR_ETFS + YARDSTICKS) -> list[str]:
    """Every name whose prices are needed, in order."""
    return sorted({*names, *basket, *controls})


def style_factors(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """Five factors and RF joined with momentum by date, names stripped (Mom is MOM), percent turned into decimals."""
    tidy = lambda df: df.select(*[F.col(f"`{c}`").alias("MOM" if c.strip() == "Mom" else c.strip()) for c in df.columns])
    both = tidy(five).join(tidy(momentum), "date")
    return as_decimals(both, [c for c in both.columns if c != "date"])


def excess(returns: DataFrame, factors: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(ticker, date, excess) and the factors, for returns less the riskless rate."""
    some = returns if names is None else returns.where(F.col("ticker").isin(*names))
    return some.select("ticker", "date", "ret").join(factors, "date").withColumn("excess", F.col("ret") - F.col("RF")).drop("ret")


def sector_residuals(returns: DataFrame, factors: DataFrame, etfs: list[str], styles: list[str]) -> DataFrame:
    """(ticker, date, resid, r2): each sector fund's excess return without what the styles explain."""
    return orthogonalise(excess(returns, factors, etfs), "ticker", "excess", styles)


def theme_factor(returns: DataFrame, factors: DataFrame, basket: list[str], against: str, styles: list[str], names: list[str] = (), least: int = 100) -> DataFrame:
    """(date, raw, resid, r2): the basket less the sector fund, and what styles and that fund's excess leave of it."""
    raw = long_short(returns, basket, against, names, least)
    fund = excess(returns, factors, [against]).select("date", F.col("excess").alias("_fund"))
    rows = raw.join(factors, "date").join(fund, "date").withColumn("_all", F.lit("all"))
    return raw.withColumnRenamed("factor", "raw").join(orthogonalise(rows, "_all", "factor", [*styles, "_fund"]).drop("_all"), "date")


def factor_table(returns: DataFrame, factors: DataFrame, basket: list[str], against: str, etfs: list[str], styles: list[str], names: list[str] = (), least: int = 100) -> DataFrame:
    """One complete row a date: styles, RF, AIF (raw), AIF_orth and <fund>_orth of each sector."""
    theme = theme_factor(returns, factors, basket, against, styles, names, least).select("date", F.col("raw").alias("AIF"), F.col("resid").alias("AIF_orth"))
    sectors = sector_residuals(returns, factors, etfs, styles).groupBy("date").pivot("ticker", list(etfs)).agg(F.first("resid"))
    sectors = sectors.select("date", *[F.col(f"`{e}`").alias(f"{e}_orth") for e in etfs])
    return reduce(lambda a, b: a.join(b, "date"), [factors.select("date", *[f"`{s}`" for s in styles], "RF"), theme, sectors]).na.drop()


def design(returns: DataFrame, table: DataFrame, sector_of: dict[str, str], styles: list[str]) -> DataFrame:
    """(ticker, date, excess, styles, SECTOR, AIF): each name with the residual of its own sector's fund; complete cases only."""
    fund = F.create_map(*[F.lit(x) for kv in sector_of.items() for x in kv])[F.col("ticker")]
    funds = sorted(set(sector_of.values()))
    own = F.coalesce(*[F.when(fund == e, F.col(f"`{e}_orth`")) for e in funds])
    rows = returns.where(F.col("ticker").isin(*sector_of)).select("ticker", "date", "ret").join(table, "date")
    return rows.select("ticker", "date", (F.col("ret") - F.col("RF")).alias("excess"), *[F.col(f"`{s}`") for s in styles], own.alias("SECTOR"), F.col("AIF_orth").alias("AIF")).na.drop()


def teardown(returns: DataFrame, factors: DataFrame, fund: str, against: str, yardstick: str, styles: list[str]) -> DataFrame:
    """One row: the fund's correlations with the sector fund and the yardstick, how much styles and sector explain, the verdict."""
    wide = returns.where(F.col("ticker").isin(fund, against, yardstick)).groupBy("date").pivot("ticker", [fund, against, yardstick]).agg(F.first("ret"))
    corr = wide.agg(F.corr(fund, against).alias("corr_sector"), F.corr(fund, yardstick).alias("corr_yardstick"), F.corr(against, yardstick).alias("corr_between"))
    other = excess(returns, factors, [against]).select("date", F.col("excess").alias("_fund"))
    left = orthogonalise(excess(returns, factors, [fund]).join(other, "date"), "ticker", "excess", [*styles, "_fund"]).agg(F.first("r2").alias("r2"))
    verdict = F.when(F.col("r2") > REPACKAGED, "mostly a tech/market repackage with little independent variance").otherwise("retains meaningful independent variance")
    return corr.join(F.broadcast(left)).select(F.lit(fund).alias("etf"), "corr_sector", "corr_yardstick", "corr_between", "r2", verdict.alias("verdict"))


def price_report(returns: DataFrame, split_name: str, per_year: int = 252) -> DataFrame:
    """One row of the four checks of a return panel: gaps between its dates, its length against the calendar, names with extreme
    moves, and the worst day of the name whose split must not show."""
    dates = returns.where("ret is not null").select(F.lit("all").alias("ticker"), "date").distinct()
    span = dates.agg(F.count("*").alias("n_dates"), (F.datediff(F.max("date"), F.min("date")) / 365.25 * per_year).alias("n_expected"))
    gaps = gap_check(dates).agg(F.count("*").alias("n_gaps"))
    moves = extreme_moves(returns).agg(F.count_distinct("ticker").alias("n_extreme"))
    worst = returns.where(F.col("ticker") == split_name).agg(F.min("ret").alias("worst_day"))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), [span, gaps, moves, worst])
    ratio = F.try_divide("n_dates", "n_expected")
    return row.withColumns({
        "no_long_gap": F.col("n_gaps") == 0, "plausible_length": F.coalesce(ratio.between(0.95, 1.05), F.lit(False)), "split_continuous": F.coalesce(F.col("worst_day") > WORST_DAY, F.lit(True))
    })
