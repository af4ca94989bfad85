"""Sources and sinks: tables, news dumps, filing lists and index pages."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.expressions import canonical_url, period, short_id
from tidewater.operators.relational import top_n_per_group

FEED = "array<struct<url:string,title:string,summary:string,time_published:string,source:string,source_domain:string,overall_sentiment_score:double,ticker_sentiment:array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string>>>>"
FORMS = ("10-K", "10-Q", "8-K")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def write_parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """zstd, replacing; by: partition columns, so that a failed run can be resumed by entity."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_tsv(df: DataFrame, path: str, digits: int = 8) -> None:
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def news_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row for each (article, ticker) of dumps, a file each (so many tasks as files; one holds
    a reply of the news service, thousands of articles at most): {data: {ticker: {feed: [...]}}}; its relevance is the first entry of that ticker."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<data:map<string,struct<feed:{FEED}>>>").alias("j"))
    flat = raw.select(F.explode("j.data").alias("ticker", "x")).select("ticker", F.explode("x.feed").alias("a"))
    own = F.filter("a.ticker_sentiment", lambda s: s["ticker"] == F.col("ticker"))
    mine = F.get(own, 0)
    at = F.try_to_timestamp("a.time_published", F.lit("yyyyMMdd'T'HHmmss"))
    url = canonical_url("a.url")
    return flat.select(
        short_id(url, "ticker", sep="|").alias("doc_id"), short_id(url).alias("article_id"), "ticker", at.alias("date"), period(at).alias("period"), F.col("a.title").alias("title"), F.col("a.summary").alias("summary"),
        F.concat_ws("\n\n", "a.title", "a.summary").alias("text"), F.col("a.url").alias("url"), F.col("a.source_domain").alias("domain"), F.col("a.source").alias("source"), F.lit("news").alias("source_category"),
        mine["relevance_score"].cast("double").alias("av_relevance"), mine["ticker_sentiment_score"].cast("double").alias("av_ticker_sentiment"), F.col("a.overall_sentiment_score").alias("av_overall_sentiment"),
    )


def relevant_news(rows: DataFrame, floor: float = 0.5) -> DataFrame:
    """Above the floor, one row an id: the most relevant, then the earliest, then by title and text."""
    some = rows.where(F.coalesce("av_relevance", F.lit(0.0)) >= floor)
    return top_n_per_group(some, ["doc_id"], [F.desc("av_relevance"), F.col("date").asc_nulls_last(), "title", "text", "url"], 1)


def merge_shards(recent: DataFrame, shards: DataFrame, columns: list[str]) -> DataFrame:
    """Column-oriented lists (one array a column) joined by cik; a column that a shard lacks is blank at its rows."""
    n = F.size(F.coalesce(*[F.col(f"s.{c}") for c in columns]))
    both = recent.alias("r").join(shards.alias("s"), "cik", "left")
    return both.select("cik", *[F.concat(f"r.{c}", F.when(n > 0, F.coalesce(f"s.{c}", F.array_repeat(F.lit(""), n))).otherwise(F.array().cast("array<string>"))).alias(c) for c in columns])


def filings(lists: DataFrame, columns: list[str], since: str, as_of: str, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """Parallel arrays to rows, in range and form, by ticker and falling date."""
    rows = lists.select("ticker", F.inline(F.arrays_zip(*columns)))
    return rows.where(F.col("form").isin(*forms) & F.col("filingDate").between(since, as_of)).orderBy("ticker", F.desc("filingDate"))


class _Index(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        if tag in ("td", "tr"):
            self.cell = False

    def handle_data(self, data):
        if self.cell:
            self.rows[-1][-1] += data


def index_documents(page: str | None, primary: str | None) -> list[tuple[int, str, str, str]]:
    """(seq, type, role, filename) of the documents that a filing's index page lists: its primary document and its EX-99 exhibits."""
    p = _Index()
    p.feed(page or "")
    out: dict[str, tuple[int, str, str, str]] = {}
    for r in p.rows:
        if len(r) != 5 or not r[0].strip().isdigit():
            continue
        name, kind = (r[2].split() or [""])[0], r[3].strip()
        role = "primary" if name == primary else "exhibit" if kind.upper().startswith("EX-99") else ""
        if role and name.lower().endswith((".htm", ".html")) and name not in out:
            out[name] = (int(r[0]), kind, role, name)
    if primary and not any(d[2] == "primary" for d in out.values()):
        out[primary] = (0, "", "primary", primary)
    return sorted(out.values())


def list_documents(spark: SparkSession, view: str) -> DataFrame:
    """Lateral 1:N over a view of (accession, page, primary_document)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="seq: int, doc_type: string, doc_role: string, filename: string")
    class ListDocuments:
        def eval(self, page: str, primary: str):
            yield from index_documents(page, primary)

    spark.udtf.register("list_documents", ListDocuments)
    return spark.sql(f"SELECT f.accession, d.* FROM {view} f, LATERAL list_documents(f.page, f.primary_document) d")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made and written there first if it is not there yet, or if forced. What a remote source returned, or any
    costly table, is so had once."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def harvest(requests: DataFrame, fetch: Callable[[str, str], str | None], schema: str, per_ticker: int = 10, retries: int = 3) -> DataFrame:
    """Replies to requests (ticker, period) of a news service, the best `per_ticker` articles of each. fetch(ticker, period) gives a JSON
    array of articles or None, which is asked again; it is given from outside, as no service is reached from here. Put behind cached()."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            replies = [next((x for _ in range(retries) if (x := fetch(r["ticker"], r["period"])) is not None), None) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(replies, pa.string())], ["ticker", "period", "reply"])

    got = requests.select("ticker", "period").mapInArrow(run, "ticker string, period string, reply string")
    articles = got.select("ticker", "period", F.explode(F.from_json("reply", f"array<struct<{schema}>>")).alias("a")).select("ticker", "period", "a.*")
    return top_n_per_group(articles, ["ticker", "period"], [F.col("relevance").desc_nulls_last(), "url"], per_ticker)


def prices(spark: SparkSession, path: str, tickers: list[str], first: str, last: str) -> DataFrame:
    """(ticker, date, price) of a table of adjusted closes between two days; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("ticker").isin(*tickers) & F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("ticker", "date", "price")


def dump_texts(docs: DataFrame, path: str, n: int, seed: int = 1) -> DataFrame:
    """A few documents as text files for reading: n by a seeded hash of their id, a file each, written by the tasks. Returns what was
    written: (doc_id, n_chars)."""
    some = docs.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    some.select("text", "doc_id").write.mode("overwrite").option("lineSep", "\n").partitionBy("doc_id").text(path)
    return some.select("doc_id", F.length("text").alias("n_chars"))
