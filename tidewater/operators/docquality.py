"""Checks of extracted documents, as projections; failing ones stop a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
XBRL_MARKERS = ("xbrli:", "us-gaap:", "iso4217:", "utr:", "dei:", "xbrldi:")
CHAR_BOUNDS = {"10-K": (80_000, 900_000), "10-Q": (30_000, 400_000), "8-K": (1_000, 60_000)}
EXHIBIT_BOUNDS = (500, 200_000)
JACCARD_FLOOR, JACCARD_DEFAULT, RETENTION_FLOOR = {"10-K": 0.85, "10-Q": 0.85, "8-K": 0.95}, 0.85, 0.98
FAIL_FLAGS = ("xbrl_leak", "entity_residue", "toc_residue", "near_empty")
WARN_FLAGS = ("size_outlier", "low_alpha", "odd_word_len", "fragmented", "short_exhibit")


def words(text: str) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def letters(text: str) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def fragment_rate(text: str) -> Column:
    """Share of one-letter words other than a, A and I."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z][A-Za-z0-9'\-]*"), F.lit(0))
    odd = F.filter(found, lambda w: (F.length(w) == 1) & ~w.isin("a", "A", "I"))
    return F.coalesce(F.try_divide(F.size(odd), F.size(found)), F.lit(0.0))


def check_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, form, doc_role. Adds the measurements and flags."""
    t = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_w", words("text"))
    bound = lambda i: F.coalesce(F.create_map(*[F.lit(x) for f, b in CHAR_BOUNDS.items() for x in (f, b[i])])[F.when(F.col("doc_role") == "primary", F.col("form")).otherwise("")], F.lit(EXHIBIT_BOUNDS[i]))
    exhibit = F.col("doc_role") == "exhibit"
    t = (
        t.withColumn("n_chars", F.length("text"))
        .withColumn("n_words", F.size("_w"))
        .withColumn("_alpha", F.coalesce(F.try_divide(letters("text"), F.col("n_chars")), F.lit(0.0)))
        .withColumn("_mean", F.coalesce(F.try_divide(F.length(F.array_join("_w", "")), F.col("n_words")), F.lit(0.0)))
        .withColumn("_frag", fragment_rate("text"))
    )
    return (
        t.withColumn("alpha_ratio", F.bround("_alpha", 3)).withColumn("mean_word_len", F.bround("_mean", 2)).withColumn("fragment_rate", F.bround("_frag", 4))
        .withColumn("xbrl_leak", F.col("text").rlike("|".join(XBRL_MARKERS)))
        .withColumn("entity_residue", F.col("text").rlike(r"&[a-zA-Z]{2,8};|&#\d{2,5};"))
        .withColumn("toc_residue", F.col("text").rlike(r"(?mi)^table\s+of\s+contents\.?$"))
        .withColumn("near_empty", F.col("n_words") < F.when(exhibit, 15).otherwise(50))
        .withColumn("short_exhibit", exhibit & (F.col("n_words") < 50))
        .withColumn("size_outlier", ~F.col("n_chars").between(bound(0), bound(1)))
        .withColumn("low_alpha", F.col("_alpha") < 0.50)
        .withColumn("odd_word_len", ~F.col("_mean").between(3.5, 7.0))
        .withColumn("fragmented", F.col("_frag") > 0.05)
        .drop("_w", "_alpha", "_mean", "_frag")
    )


def roll_up(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("n_documents"), *[F.count_if(f).alias(f) for f in (*FAIL_FLAGS, *WARN_FLAGS)])


def gate(checked: DataFrame) -> DataFrame:
    """checked, or an error that names the failing flags."""
    row = roll_up(checked).first()
    bad = {f: row[f] for f in FAIL_FLAGS if row[f]}
    if bad:
        raise ValueError(f"documents fail: {bad}")
    return checked


def cross_check(docs: DataFrame, form_col: str | None = None) -> DataFrame:
    """text against baseline: token-set Jaccard and retained letters. docs: id columns, text, baseline."""
    tokens = lambda c: F.array_distinct(words(F.lower(c)))
    floor = F.lit(JACCARD_DEFAULT) if form_col is None else F.coalesce(F.create_map(*[F.lit(x) for kv in JACCARD_FLOOR.items() for x in kv])[F.col(form_col)], F.lit(JACCARD_DEFAULT))
    out = docs.withColumn("_a", tokens("text")).withColumn("_b", tokens("baseline"))
    out = out.withColumn("jaccard", F.bround(F.coalesce(F.try_divide(F.size(F.array_intersect("_a", "_b")), F.size(F.array_union("_a", "_b"))), F.lit(1.0)), 4))
    out = out.withColumn("retention", F.bround(F.coalesce(F.try_divide(letters("text"), letters("baseline")), F.lit(1.0)), 4))
    return out.withColumn("content_loss", F.col("retention") < RETENTION_FLOOR).withColumn("below_floor", F.col("jaccard") < floor).drop("_a", "_b")


def section_report(docs: DataFrame) -> DataFrame:
    """Sections a document, how many open with their heading, and the spread of their sizes."""
    s = docs.where(F.size("section_spans") > 0).select("doc_id", "text", F.explode("section_spans").alias("s"))
    s = s.withColumn("size", F.col("s.end") - F.col("s.start")).withColumn("headed", F.expr("substring(text, s.start + 1, 40)").rlike(r"(?i)^[ \t|]*item"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.avg(F.col("headed").cast("int")).alias("headed_share"), F.try_divide(F.max("size"), F.min("size")).alias("spread"))


# What the headings of four Items of an annual report say, and the verdicts' bounds.
HEADINGS = {"1A": "risk factor", "7": "management", "3": "legal", "1": "business"}
LEAST_MEDIAN, MOST_MEDIAN, LEAST_HEADED, LEAST_SPREAD = 12, 24, 0.80, 20


def verify_sections(docs: DataFrame, head: int = 120) -> DataFrame:
    """(check, value, verdict) over annual reports (form 10-K) and coverage over these and quarterly ones: filings with sections,
    median number of sections, share of the headings of four Items that hold their phrase, largest median size over smallest."""
    filed = docs.where(F.col("form").isin("10-K", "10-Q"))
    annual = filed.where("form = '10-K'")
    n = F.coalesce(F.size("section_spans"), F.lit(0))
    ok = lambda good: F.when(good, "PASS").otherwise("CHECK")
    coverage = filed.agg(F.avg((n > 0).cast("int")).alias("value")).select(F.lit("coverage").alias("check"), "value", F.lit("").alias("verdict"))
    median = annual.agg(F.median(n).alias("value")).select(F.lit("median_sections").alias("check"), "value", ok(F.col("value").between(LEAST_MEDIAN, MOST_MEDIAN)).alias("verdict"))
    s = annual.select("text", F.explode("section_spans").alias("s")).select(F.col("s.item").alias("label"), F.substring_index("s.item", ".", -1).alias("item"), (F.col("s.end") - F.col("s.start")).alias("size"), F.expr(f"lower(substring(text, cast(s.start as int) + 1, {head}))").alias("head"))
    phrases = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    heads = s.where(F.col("item").isin(*HEADINGS)).groupBy("item").agg(F.avg(F.contains("head", phrases[F.col("item")]).cast("int")).alias("value"))
    headed = docs.sparkSession.createDataFrame([(i,) for i in HEADINGS], "item string").join(heads, "item", "left").select(F.concat(F.lit("heading_"), "item").alias("check"), "value", ok(F.col("value") >= LEAST_HEADED).alias("verdict"))
    sizes = s.groupBy("label").agg(F.median("size").alias("m")).agg((F.max("m") / F.greatest(F.min("m"), F.lit(1))).alias("value")).select(F.lit("size_spread").alias("check"), "value", ok(F.col("value") > LEAST_SPREAD).alias("verdict"))
    return coverage.unionByName(median).unionByName(headed).unionByName(sizes)
