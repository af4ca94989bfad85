"""Top-k, duplicates, differences, counts and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """Give order a key that breaks ties. Spark prunes rows beyond n before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def top_and_bottom(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """k highest and k lowest, each row once."""
    return df.orderBy(F.desc(column), tie).limit(k).union(df.orderBy(column, tie).limit(k)).distinct()


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_n_per_group(df, keys, order, 1)


def duplicate_content(df: DataFrame, content: Column, id_col: str) -> DataFrame:
    """A row for each content that several rows have: how many, and the smallest and largest id. Aggregated before the shuffle."""
    return df.groupBy(F.sha2(content, 256).alias("content_sha256")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n > 1")


def table_diff(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side without a partner, tagged `_diff`."""
    return new.join(old, keys, "left_anti").withColumn("_diff", F.lit("new")).unionByName(old.join(new, keys, "left_anti").withColumn("_diff", F.lit("missing")))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0, values)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())


def term_frequency(df: DataFrame, array: str, k: int = 12) -> DataFrame:
    return df.select(F.explode(array).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def hit_rates(df: DataFrame, group: str, hit: str, least: int = 20, k: int | None = None) -> DataFrame:
    out = df.groupBy(group).agg(F.count_if(F.col(hit)).alias("hits"), F.count("*").alias("n"), F.avg(F.col(hit).cast("int")).alias("rate")).where(F.col("n") >= least)
    return out.orderBy(F.desc("rate"), group).limit(k) if k else out


def coverage_span(df: DataFrame, group: str, at: str, since: str) -> DataFrame:
    """First and last moment of a group, whole days elapsed between, and whether the first is before `since`."""
    agg = df.groupBy(group).agg(F.count("*").alias("n"), F.min(at).alias("earliest"), F.max(at).alias("latest"))
    return agg.withColumn("days", F.expr("timestampdiff(DAY, earliest, latest)")).withColumn("reaches", F.col("earliest") < F.expr(f"timestamp_ntz '{since}'"))


def cell_audit(df: DataFrame, cell: list[str], keep: int) -> DataFrame:
    agg = df.groupBy(*cell).agg(F.count("*").alias("n_available"))
    return agg.withColumn("n_kept", F.least("n_available", F.lit(keep))).withColumn("short", F.col("n_available") < keep)


def form_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.median(column).alias("median"), F.sum(column).alias("total"), *[F.percentile(column, p).alias(f"p{int(p * 100)}") for p in (0.25, 0.75)], F.min(column).alias("least"), F.max(column).alias("most"))


def warning_histogram(df: DataFrame, array: str) -> DataFrame:
    kinds = F.transform(F.filter(array, lambda w: ~w.startswith("info:")), lambda w: F.split(w, ":")[0])
    return df.select(F.explode(kinds).alias("warning")).groupBy("warning").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "warning")


def hashed_sample(df: DataFrame, group: list[str], id_col: str, n: int, seed: int = 1) -> DataFrame:
    """At most n rows a group in the order of a seeded hash of their id: the same rows at every run."""
    return top_n_per_group(df, group, [F.xxhash64(F.lit(seed), id_col), F.col(id_col)], n)


def quarters(df_session, first: str, last: str) -> DataFrame:
    """A row for each quarter from first to last (dates)."""
    return df_session.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 3 months)) AS start").selectExpr("start", "concat(year(start), 'Q', quarter(start)) AS period")


def cost_summary(log: DataFrame, prices: dict[str, tuple[float, float]], batch_share: float = 0.5) -> DataFrame:
    """Calls, tokens and estimated cost by task and model, and a total row (task TOTAL). prices: model to cost of a million input
    and output tokens; batch calls cost that share."""
    rate = lambda i: F.coalesce(F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[i]))])[F.col("model")], F.lit(0.0))
    cost = (F.col("input") * rate(0) + F.col("output") * rate(1)) / 1e6 * F.when(F.col("batch"), batch_share).otherwise(1.0)
    agg = log.withColumn("usd", cost).rollup("task", "model").agg(F.grouping_id().alias("g"), F.count("*").alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("usd").alias("usd"))
    return agg.where("g in (0, 3)").withColumn("task", F.when(F.col("g") == 3, "TOTAL").otherwise(F.col("task"))).drop("g")


def complete_cases(frames: list[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), frames).na.drop()


def distinct_counts(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def pivot_mean(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """Means by row and column; cells without rows are null."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def duplicate_members(df: DataFrame, content: Column, id_col: str, title_col: str) -> DataFrame:
    """Every row whose content another row has: (content_sha256, id, title). Only hashes are counted; titles are joined on."""
    rows = df.select(F.sha2(content, 256).alias("content_sha256"), F.col(id_col).alias("id"), F.col(title_col).alias("title"))
    again = rows.groupBy("content_sha256").agg(F.count("*").alias("n")).where("n > 1").select("content_sha256")
    return rows.join(again, "content_sha256", "left_semi")


def log_costs(log: DataFrame, prices: dict[str, tuple[float, float]], cache_read: float = 0.1, batch_share: float = 0.5) -> DataFrame:
    """log (task, model, input, output, cache_read, cache_write, batch) with usd, rounded to six digits, ready to be appended. Cached
    reads cost a share of input, cache writes as input. A model without a price is an error."""
    known = F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, F.array(*map(F.lit, map(float, p))))])[F.col("model")]
    price = F.when(known.isNull(), F.raise_error(F.concat(F.lit("no price for "), F.col("model")))).otherwise(known)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = ((n("input") + n("cache_read") * cache_read + n("cache_write")) * price[0] + n("output") * price[1]) / 1e6
    return log.withColumn("usd", F.round(cost * F.when(F.coalesce("batch", F.lit(False)), batch_share).otherwise(1.0), 6))
