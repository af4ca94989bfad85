"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, dropped from addresses.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "guccounter")


def short_id(*parts: Column | str, sep: str = ":") -> Column:
    """First 16 hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, 16)


def period(day: Column | str) -> Column:
    """2024Q2."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def weight(column: Column | str, weights: dict[str, float], default: float) -> Column:
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(column) if isinstance(column, str) else column], F.lit(default))


def canonical_url(url: Column | str) -> Column:
    """Host in lower case, no closing slash, no fragment, no tracking parameters; the rest keeps its order."""
    whole = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)([^?]*)(\?(.*))?$", 2)
    scheme = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1))
    path = F.regexp_replace(F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.split(kv, "=")[0].isin(*TRACKING))
    return F.concat(scheme, F.lower(head), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def average_rank(column: str, over) -> Column:
    """Rank with ties at their mean; over: a window spec partition without order."""
    ordered = over.orderBy(column)
    from pyspark.sql import Window

    tied = F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(ordered) + (tied - 1) / 2


def clamp(column: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def document_url(cik, accession, document):
    """Where an archived filing's document lies; the accession number loses its dashes."""
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.col(cik).cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)
