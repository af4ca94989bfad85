"""Lexicon tagging, the gate before an expensive classifier, merging its labels back, and checking them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The theme's terms.
TERMS = (
    "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model", "foundation model",
    "generative ai", "gen ai", "transformer model", "copilot", "chatbot", "agentic", "inference", "accelerator", "datacenter gpu",
    "data center gpu", "training cluster", "llm", "gpu", "npu", "tpu", "hbm",
)
ACRONYMS = r"|\bai\b|\ba\.i\."
CORPUS = ("doc_id", "parent_doc_id", "ticker", "period", "date", "title", "text", "source_category", "section", "section_name", "url")
LABELS = "struct<ai_relevance:string,ai_role:string,materiality:string,valence_ai:int,confidence:string,evidence_span:string>"


def pattern(terms: tuple[str, ...] = TERMS, more: str = ACRONYMS) -> str:
    return "|".join(rf"\b{re.escape(t)}\b".replace("\\ ", " ") for t in terms) + more


def flag(df: DataFrame, text_cols: list[str], terms: tuple[str, ...] = TERMS, more: str = ACRONYMS) -> DataFrame:
    """lexicon_terms (sorted, distinct, lower case) and lexicon_hit; nothing is filtered."""
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in text_cols]))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(blob, F.lit(pattern(terms, more)), F.lit(0))))
    return df.withColumn("lexicon_terms", found).withColumn("lexicon_hit", F.size("lexicon_terms") > 0)


def union_corpus(chunks: DataFrame, news: DataFrame) -> DataFrame:
    blank = F.lit("")
    a = chunks.withColumn("parent_doc_id", F.col("doc_id")).withColumn("doc_id", F.col("chunk_id")).select(*CORPUS)
    b = news.withColumn("parent_doc_id", F.col("doc_id")).withColumn("section", blank).withColumn("section_name", blank).select(*CORPUS)
    return a.unionByName(b)


def gated(df: DataFrame, gate: bool = True) -> DataFrame:
    return df.where("lexicon_hit") if gate else df


def user_block(text: str | Column, aliases: list[str] = (), most: int = 4000) -> Column:
    """Clipped text, with the entity's names masked if any are given."""
    out = F.substring(text, 1, most)
    for a in sorted(aliases, key=len, reverse=True):
        out = F.regexp_replace(out, "(?i)" + re.escape(a), "[COMPANY]")
    return out


def rubric(relevance: dict[str, str], roles: dict[str, str], materiality: dict[str, str]) -> str:
    """The same text for the same definitions, whatever their order in memory."""
    part = lambda name, d: [name, *[f"- {k}: {v}" for k, v in d.items()]]
    return "\n".join([*part("relevance", relevance), "", *part("role", roles), "", *part("materiality", materiality)])


def parse_labels(answers: DataFrame, json_col: str) -> DataFrame:
    """(doc_id, labels): confidence held to 0..1 and 0 where it is no number; text that isn't JSON gives nulls, which mean failed."""
    got = answers.select("doc_id", F.from_json(json_col, LABELS).alias("x")).select("doc_id", "x.*")
    number = F.expr("try_cast(confidence AS double)")
    return got.withColumn("confidence", F.when(F.col("ai_relevance").isNotNull(), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), F.lit(0.0))))


def classify(df: DataFrame, rule: Callable[[DataFrame], DataFrame] | None = None, gate: bool = True) -> DataFrame:
    """The remote classifier is a function from gated rows to (doc_id, labels); the gate stands below it in the plan."""
    return merge_labels(df, (rule or term_rule)(gated(df, gate)))


def term_rule(sent: DataFrame) -> DataFrame:
    """The labels of a rule that needs no model, for runs without one: two distinct terms or more are substantive, one is incidental."""
    many = F.size("lexicon_terms") > 1
    return sent.select(
        "doc_id", F.when(many, "substantive").otherwise("incidental").alias("ai_relevance"), F.when(many, "A_builder").otherwise("E_none").alias("ai_role"),
        F.when(F.size("lexicon_terms") > 3, "high").when(many, "medium").otherwise("low").alias("materiality"), F.lit(0).alias("valence_ai"), F.lit(0.5).alias("confidence"), F.element_at("lexicon_terms", 1).alias("evidence_span"),
    )


def merge_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the gate held back get the neutral labels; rows sent that came back without labels stay null."""
    got = df.join(labels.withColumn("_got", F.lit(True)), "doc_id", "left")
    out = F.col("_got").isNull() & ~F.col("lexicon_hit")
    neutral = {"ai_relevance": F.lit("none"), "ai_role": F.lit("E_none"), "materiality": F.lit("low"), "valence_ai": F.lit(0), "confidence": F.lit(1.0), "evidence_span": F.lit("")}
    return got.withColumns({c: F.when(out, v).otherwise(F.col(c)) for c, v in neutral.items()}).withColumn("gated_out", out).drop("_got")


def sent(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("gated_out", F.lit(False)) & F.col("ai_relevance").isNotNull())


def buzzword_trap(df: DataFrame) -> DataFrame:
    """Units with a term that the classifier still demoted."""
    s = sent(df).where("lexicon_hit")
    demoted = F.col("ai_relevance").isin("none", "incidental")
    return s.agg(F.count("*").alias("n_hit"), F.count_if(demoted).alias("n_demoted")).withColumn("separation_rate", F.bround(F.try_divide("n_demoted", "n_hit"), 3))


def contradictions(df: DataFrame, k: int = 12) -> DataFrame:
    """Label sets that the rubric forbids (all of them), topped up to k with the least confident substantive rows."""
    sub = F.col("ai_relevance") == "substantive"
    why = (
        F.when((F.col("ai_role") == "D_negative_exposure") & (F.col("valence_ai") > 0), "negative role, positive valence")
        .when((F.col("ai_relevance") == "none") & ((F.col("ai_role") != "E_none") | (F.col("valence_ai") != 0)), "relevance none but role/valence set")
        .when(sub & (F.col("ai_role") == "E_none"), "substantive but no role")
        .when(sub & ~F.col("lexicon_hit"), "substantive with no AI term in the text")
    )
    s = sent(df).withColumn("why", why)
    bad = s.where("why is not null")
    n = bad.agg(F.count("*").alias("_n"))
    low = s.where(F.col("why").isNull() & sub).orderBy("confidence", "doc_id").limit(k)
    place = F.row_number().over(Window.orderBy("confidence", "doc_id"))  # over k rows at most
    top = low.withColumn("_r", place).join(F.broadcast(n)).where(F.col("_r") <= F.lit(k) - F.col("_n")).drop("_r", "_n").withColumn("why", F.lit("lowest-confidence substantive"))
    return bad.unionByName(top)


def representative(df: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("ai_relevance", "ai_role").orderBy(F.desc("confidence"), "doc_id")
    return sent(df).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def review_sample(df: DataFrame, group: str, n: int = 40, seed: int = 1) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    out = sent(df).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return out.withColumn("text", F.substring("text", 1, 700)).withColumn("agree", F.lit("")).withColumn("note", F.lit(""))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, from their counts by value."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("na")).join(cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("nb")), "v").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    po, pe = F.try_divide("same", "total"), F.try_divide("both", F.col("total") * F.col("total"))
    return total.join(F.broadcast(chance)).select(F.col("total").alias("n"), po.alias("agreement"), F.bround(F.try_divide(po - pe, 1 - pe), 3).alias("kappa"))


def cross_model(a: DataFrame, b: DataFrame, fields: list[str], number: str) -> DataFrame:
    """Kappa of each field, and the correlation (of more than two) and exact share of a number, on rows that both labelled; (field, n, value)."""
    both = a.select("doc_id", *[F.col(c).alias(f"{c}_a") for c in (*fields, number)]).join(b.select("doc_id", *[F.col(c).alias(f"{c}_b") for c in (*fields, number)]), "doc_id")
    out = None
    for f in fields:
        one = kappa(both, f"{f}_a", f"{f}_b").select(F.lit(f).alias("field"), "n", F.col("kappa").alias("value"))
        out = one if out is None else out.unionByName(one)
    num = both.na.drop(subset=[f"{number}_a", f"{number}_b"]).agg(
        F.count("*").alias("n"), F.bround(F.when(F.count("*") > 2, F.corr(f"{number}_a", f"{number}_b")), 3).alias("corr"), F.bround(F.avg((F.col(f"{number}_a") == F.col(f"{number}_b")).cast("int")), 3).alias("same")
    )
    return out.unionByName(num.select(F.lit(f"{number}_corr").alias("field"), "n", F.col("corr").alias("value"))).unionByName(num.select(F.lit(f"{number}_exact_match").alias("field"), "n", F.col("same").alias("value")))


def audit(df: DataFrame) -> DataFrame:
    """One row of counts and shares over classified units."""
    s = F.coalesce("gated_out", F.lit(False))
    judged = ~s & F.col("ai_relevance").isNotNull()
    return df.agg(
        F.count("*").alias("n"), F.count_if(s).alias("n_gated"), F.count_if(judged).alias("n_model"), F.count_if(~s & F.col("ai_relevance").isNull()).alias("n_failed"),
        F.try_divide(F.count_if(judged & (F.col("valence_ai") < 0)), F.count_if(judged)).alias("negative_share"), F.try_divide(F.count_if(F.col("ai_relevance") == "substantive"), F.count("ai_relevance")).alias("substantive_share"),
    )


# What the audit looks at.
LEAST_NEGATIVE, THIN_CELL, SCATTERED, LEAST_SECTION = 0.02, 5, 4, 15
DISRUPTED = ("ADBE", "TEAM", "INTC")


def section_order(df: DataFrame) -> DataFrame:
    """Whether valence is conditioned on the aspect: mean of risk factors against that of business and management's discussion, over
    substantive filings of sections with enough units. (risk, lowest of the others, verdict)"""
    s = sent(df).where((F.col("ai_relevance") == "substantive") & (F.col("source_category") == "sec_filing") & (F.coalesce("section_name", F.lit("")) != ""))
    means = s.groupBy("section_name").agg(F.avg("valence_ai").alias("mean"), F.count("valence_ai").alias("n")).where(F.col("n") >= LEAST_SECTION)
    row = means.agg(F.max(F.when(F.col("section_name") == "risk_factors", F.col("mean"))).alias("risk"), F.min(F.when(F.col("section_name").isin("business", "mdna"), F.col("mean"))).alias("others"))
    return row.withColumn("verdict", F.when(F.col("risk") < F.col("others"), "PASS").otherwise("CHECK"))


def negative_class(df: DataFrame) -> DataFrame:
    s = sent(df).where("ai_relevance = 'substantive'").agg(F.avg((F.col("valence_ai") < 0).cast("int")).alias("negative_share"))
    return s.withColumn("verdict", F.when(F.col("negative_share") >= LEAST_NEGATIVE, "PASS").otherwise("CHECK"))


def disrupted_names(df: DataFrame, names: tuple[str, ...] = DISRUPTED) -> DataFrame:
    """Mean valence and units of names that the theme may hurt, over all substantive units and within risk factors."""
    s = sent(df).where((F.col("ai_relevance") == "substantive") & F.col("ticker").isin(*names))
    risk = F.when(F.col("section_name") == "risk_factors", F.col("valence_ai"))
    return s.groupBy("ticker").agg(F.bround(F.avg("valence_ai"), 2).alias("mean"), F.count("valence_ai").alias("n"), F.bround(F.avg(risk), 2).alias("risk_mean"), F.count(risk).alias("risk_n"))


def raw_shares(df: DataFrame) -> DataFrame:
    """Share of substantive units by source category and name, before any shrinkage."""
    hit = F.coalesce(F.col("ai_relevance") == "substantive", F.lit(False))
    return df.groupBy("source_category", "ticker").agg(F.bround(F.avg(hit.cast("int")), 3).alias("share"), F.count_if(hit).alias("hits"), F.count("*").alias("n"))


def thin_cells(df: DataFrame) -> DataFrame:
    """Cells of name and period with substantive filings, how many there could be, and how many are thin."""
    s = sent(df).where((F.col("ai_relevance") == "substantive") & (F.col("source_category") == "sec_filing"))
    cells = s.groupBy("ticker", "period").agg(F.count("*").alias("n"))
    possible = F.count_distinct("ticker") * F.count_distinct("period")
    return cells.agg(F.count("*").alias("n_cells"), possible.alias("n_possible"), F.count_if(F.col("n") < THIN_CELL).alias("n_thin"))


def failures(df: DataFrame) -> DataFrame:
    """Rows without labels, over how many names, and whether they cluster."""
    f = df.where(F.col("ai_relevance").isNull()).agg(F.count("*").alias("n_failed"), F.count_distinct("ticker").alias("n_names"))
    return f.withColumn("verdict", F.when(F.col("n_failed") == 0, "none").when(F.col("n_names") > SCATTERED, "scattered").otherwise("CLUSTERED"))
