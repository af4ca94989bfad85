"""Returns and regressions. Long tables (date, ticker, ...); one regressor stays in SQL aggregates, several use one pass of cross
products per group or, where order matters (Newey-West, rolling windows), a grouped NumPy fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS, HAC_LAGS, ROLLING, Z95 = 252, 5, 126, 1.959963984540054


def simple_returns(prices: DataFrame, by: str = "ticker", at: str = "date", price: str = "price") -> DataFrame:
    """price / previous price - 1; nothing is padded across nulls; each series loses its first row."""
    before = F.lag(price).over(Window.partitionBy(by).orderBy(at))
    return prices.withColumn("_p", before).where("_p is not null").withColumn("ret", F.col(price) / F.nullif("_p", F.lit(0.0)) - 1).drop("_p")


def as_decimals(df: DataFrame, columns: list[str], limit: float = 0.5) -> DataFrame:
    """Percentages become decimals: if any value reaches the limit, all are divided by 100; raises if they still do."""
    largest = df.agg(F.max(F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in columns], F.lit(0.0)))).first()[0] or 0.0
    if largest >= limit:
        if largest / 100 >= limit:
            raise ValueError(f"{largest} is no percentage")
        df = df.withColumns({c: F.col(c) / 100 for c in columns})
    return df


def gap_check(returns: DataFrame, most_days: int = 5) -> DataFrame:
    before = F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))
    return returns.withColumn("gap_days", F.datediff("date", before)).where(F.col("gap_days") > most_days).select("ticker", "date", "gap_days")


def extreme_moves(returns: DataFrame, limit: float = 0.25, k: int = 3) -> DataFrame:
    order = Window.partitionBy("ticker").orderBy("date")
    return returns.where(F.abs("ret") > limit).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def density(returns: DataFrame, per_year: int = TRADING_DAYS, low: float = 0.95, high: float = 1.05) -> DataFrame:
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    agg = returns.groupBy("ticker").agg(F.count("*").alias("n"), F.try_divide(F.count("*"), years * per_year).alias("share"))
    return agg.withColumn("dense", F.coalesce(F.col("share").between(low, high), F.lit(False)))


def long_short(returns: DataFrame, basket: list[str], against: str, universe: list[str] = (), least: int = 100) -> DataFrame:
    """Mean of the basket's available names (with more than `least` rows) less `against`, by date."""
    if set(basket) & set(universe):
        raise ValueError("the basket holds names that it is to be tested on")
    inside = returns.where(F.col("ticker").isin(*basket) & F.col("ret").isNotNull())
    long_enough = inside.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") > least).select("ticker")
    mean = inside.join(long_enough, "ticker", "left_semi").groupBy("date").agg(F.avg("ret").alias("basket"))
    other = returns.where(F.col("ticker") == against).select("date", F.col("ret").alias("against"))
    return mean.join(other, "date").where("against is not null").select("date", (F.col("basket") - F.col("against")).alias("factor"))


def ols_one(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return both.groupBy(by).agg(F.count("*").alias("n_obs"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("corr"))


def rolling_one(df: DataFrame, by: str, y: str, x: str, window: int = ROLLING) -> DataFrame:
    w = Window.partitionBy(by).orderBy("date").rowsBetween(-(window - 1), 0)
    out = df.withColumn("n_window", F.count("*").over(w)).withColumn("beta", F.regr_slope(y, x).over(w))
    return out.where(F.col("n_window") == window).select(by, "date", "beta")


def _fit(y: np.ndarray, x: np.ndarray, lags: int) -> dict[str, np.ndarray | float]:
    """OLS with a constant in column 0 of x, and Newey-West errors with Bartlett weights, without small-sample correction."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    u = x * e[:, None]
    s = u.T @ u
    for lag in range(1, min(lags, len(y) - 1) + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    cov = inverse @ s @ inverse
    total = ((y - y.mean()) ** 2).sum()
    return {"beta": beta, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "r2": 1 - (e @ e) / total if total else float("nan"), "resid": e}


def vif(x: np.ndarray) -> np.ndarray:
    """Variance inflation of each column (no constant): the diagonal of the inverse correlation matrix."""
    if x.shape[1] < 2:
        return np.ones(x.shape[1])
    return np.diag(np.linalg.pinv(np.corrcoef(x, rowvar=False)))


def regress(df: DataFrame, by: str, y: str, regressors: list[str], focus: str, lags: int = HAC_LAGS) -> DataFrame:
    """One row a group: coefficient of `focus` with Newey-West error, t, normal p and interval, annual alpha, R2, VIFs. A group
    is one entity's history and fits in a task; groups with too few rows for the fit are left out."""
    k = regressors.index(focus)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("date")
        if len(pdf) <= len(regressors) + 1:
            return pd.DataFrame(columns=columns)
        x = pdf[regressors].to_numpy(float)
        f = _fit(pdf[y].to_numpy(float), np.column_stack([np.ones(len(x)), x]), lags)
        b, se, v = float(f["beta"][k + 1]), float(f["se"][k + 1]), vif(x)
        t = b / se if se else float("nan")
        row = [key[0], b, se, t, math.erfc(abs(t) / math.sqrt(2)), b - Z95 * se, b + Z95 * se, float(f["beta"][0]) * TRADING_DAYS, float(f["r2"]), len(pdf), float(v.max()), float(v[k])]
        return pd.DataFrame([row], columns=columns)

    columns = ["ticker", "beta", "se", "t", "p", "ci_lo", "ci_hi", "alpha_ann", "r2", "n_obs", "max_vif", "vif_focus"]
    schema = "ticker string, beta double, se double, t double, p double, ci_lo double, ci_hi double, alpha_ann double, r2 double, n_obs long, max_vif double, vif_focus double"
    return df.select(F.col(by), "date", y, *regressors).groupBy(by).applyInPandas(run, schema)


def orthogonalise(df: DataFrame, by: str, y: str, controls: list[str]) -> DataFrame:
    """Residual of y on a constant and the controls within each group, on complete cases: (by, date, resid, r2)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("date")
        if len(pdf) <= len(controls) + 1:
            return pd.DataFrame(columns=[by, "date", "resid", "r2"])
        f = _fit(pdf[y].to_numpy(float), np.column_stack([np.ones(len(pdf)), pdf[controls].to_numpy(float)]), 0)
        return pd.DataFrame({by: key[0], "date": pdf["date"].to_numpy(), "resid": f["resid"], "r2": f["r2"]})

    return df.select(by, "date", y, *controls).groupBy(by).applyInPandas(run, f"{by} string, date date, resid double, r2 double")


def rolling_beta(df: DataFrame, by: str, y: str, regressors: list[str], focus: str, window: int = ROLLING) -> DataFrame:
    """OLS coefficient of `focus` on every full window, from running sums of cross products: no window is refitted from its rows."""
    k = regressors.index(focus) + 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("date")
        if len(pdf) < window:
            return pd.DataFrame(columns=[by, "date", "beta"])
        x = np.column_stack([np.ones(len(pdf)), pdf[regressors].to_numpy(float)])
        yy = pdf[y].to_numpy(float)
        roll = lambda a: (c := np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)]))[window:] - c[:-window]
        gram, cross = roll(x[:, :, None] * x[:, None, :]), roll(x * yy[:, None])
        beta = np.stack([np.linalg.lstsq(g, c, rcond=None)[0][k] for g, c in zip(gram, cross, strict=True)])
        return pd.DataFrame({by: key[0], "date": pdf["date"].to_numpy()[window - 1 :], "beta": beta})

    return df.select(by, "date", y, *regressors).groupBy(by).applyInPandas(run, f"{by} string, date date, beta double")


def sanity_gate(betas: DataFrame, must_load: list[str], null_names: list[str], level: float = 0.05) -> DataFrame:
    """Names that must load positively and those that must not, and whether all do."""
    want = F.when(F.col("ticker").isin(*must_load), "load").when(F.col("ticker").isin(*null_names), "null")
    rows = betas.withColumn("want", want).where("want is not null")
    ok = F.when(F.col("want") == "load", (F.col("beta") > 0) & (F.col("p") < level)).otherwise(F.col("p") > level)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return rows.select("ticker", "want", "beta", "p", "ok").join(F.broadcast(rows.agg(F.every("ok").alias("passed"))))


def annualised(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg((F.avg(column) * TRADING_DAYS).alias("mean_ann"), (F.stddev_samp(column) * F.sqrt(F.lit(TRADING_DAYS))).alias("vol_ann"))
