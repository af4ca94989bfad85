import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.expressions import canonical_url
from tidewater.operators import chunk, classify, docquality, extract, factors, panel, reconcile, relational, timeseries
from tidewater.plans import registry
from tidewater.sources import readers
from tidewater.streaming.gate import gate_stream, windowed_counts

# Published scores and betas of nine names, and the gaps they give.
SCORES = [("DELL", 0.2407, 98), ("NVDA", 0.1133, 112), ("TEAM", 0.0741, 138), ("MU", 0.068, 49), ("INTC", 0.0411, 50), ("ADBE", 0.0344, 58), ("CAT", 0.0014, 4), ("WM", 0.0, 1), ("PG", -0.0011, 3)]


# Their betas as z-scores, and the gaps of the two scores.
BETA_Z = {"TEAM": -1.054, "NVDA": 1.598, "DELL": 1.620, "CAT": -0.094, "ADBE": -1.066, "MU": 0.708, "PG": -0.336, "INTC": -0.739, "WM": -0.637}
GAPS = {"TEAM": 1.199, "NVDA": -0.913, "DELL": 0.821, "CAT": -0.762, "ADBE": 0.664, "MU": -0.647, "PG": -0.554, "INTC": 0.430, "WM": -0.238}


def test_reconciliation_by_hand(spark):
    betas = [(t, BETA_Z[t], 1.0 if i % 2 else 3.0, 1.2) for i, (t, *_) in enumerate(SCORES)]
    out = reconcile.align(spark.createDataFrame(SCORES, "ticker string, aia double, n_substantive long"), spark.createDataFrame(betas, "ticker string, ai_beta double, ai_t double, max_vif double"))
    got = {x.ticker: x for x in out.collect()}
    a, b = np.array([s[1] for s in SCORES]), np.array([x[1] for x in betas])
    za, zb = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    for (t, *_), x, y in zip(SCORES, za, zb, strict=True):
        assert got[t].semantic_z == pytest.approx(x) and got[t].gap == pytest.approx(x - y)
    assert [round(got[t].semantic_z, 3) for t in ("TEAM", "NVDA", "DELL", "PG")] == [0.145, 0.685, 2.441, -0.891]
    assert all(got[t].gap == pytest.approx(g, abs=0.005) for t, g in GAPS.items())
    assert reconcile.spearman(out, "semantic_z", "beta_z").first().rho == pytest.approx(0.4333, abs=5e-5)
    top = reconcile.triage(out).collect()
    assert [x.ticker for x in top] == sorted(got, key=lambda t: -got[t].abs_gap)[:3]
    assert all(x.likely_measurement == (abs(x.ai_t) < 1.5 or x.max_vif > 10 or x.n_substantive < 20) for x in top)
    ci = reconcile.bootstrap_ci(out, "semantic_z", "beta_z", draws=50).first()
    assert -1 <= ci.ci_lo <= ci.ci_hi <= 1


def test_salience_keeps_gated_and_drops_failed(spark):
    rows = [("A", "2024Q1", "substantive", "high", 2, "sec_filing"), ("A", "2024Q1", "none", "low", 0, "sec_filing"), ("A", "2024Q1", None, None, None, "sec_filing"), ("A", "2024Q2", "none", "low", 0, "sec_filing"), ("A", "2024Q2", "substantive", "high", 1, "news")]
    u = spark.createDataFrame(rows, "ticker string, period string, ai_relevance string, materiality string, valence_ai int, source_category string")
    out = {r.period: r for r in panel.shrink_salience(panel.raw_salience(u)).collect()}
    assert (out["2024Q1"].salience_raw, out["2024Q1"].n_units, out["2024Q2"].salience_raw) == (0.5, 2, 0.0)
    assert out["2024Q1"].prior == 0.25 and out["2024Q2"].prior == 0.5
    z = panel.cross_sectional_z(panel.raw_salience(u), "salience_raw", "z").collect()
    assert all(r.z == 0 for r in z)  # one name a period


HTML = """<SEC-DOCUMENT><TEXT><html><head><title>x</title><style>p{}</style></head><body><ix:header>gone</ix:header>
<div style="display: none">hidden <div>deep</div></div><p>Caf&eacute; &ldquo;quoted&rdquo;&nbsp;text</p><p>one<br>two</p>
<table><tr><td>Name</td><td>Value</td></tr><tr><td></td></tr><tr><td>a|b</td><td>$1,000</td></tr><tr><td>c<table><tr><td>in</td></tr></table></td></tr></table>
<p>Table of Contents</p><p>12</p>""" + "<p>Running Header</p><p>body line</p>" * 5 + "<script>bad()</script><p>end</p></body></html></TEXT>junk"


def test_extract():
    got = extract.extract(HTML.encode())
    t = got["text"]
    assert 'Café "quoted" text' in t and "one\ntwo" in t and "| a\\|b | $1,000 |" in t
    for gone in ("hidden", "deep", "gone", "bad()", "Running Header", "Contents", "junk", "body line", "\x00"):
        assert gone not in t
    (s,) = got["tables"]
    assert t[s["start"] :].startswith("| Name | Value |") and t[: s["end"]].endswith("|") and (s["n_rows"], s["n_cols"]) == (3, 2)
    assert s["numeric_frac"] == 0.2 and "| c in |  |" in t
    assert extract.extract("é".encode("cp1252"))["text"] == "é" and extract.extract(b"")["text"] == ""


def test_pages_equal_sql_where_references_are_cut_or_escaped_twice(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    heads = ("cut&amp;&amp", "cut&am", "cut&quo", "cut&quot", "b &amp;lt; c", "&amp;amp;amp;", "&notit; &copy 2 &copy;", "\ue000 & &", "plain")
    pages = [(i, f"<html><head><title>{h}</title></head><body><h1>{h}</h1><p><a href='?a=1&lt=2'>{h} and</a> more</p></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_extract", "cross_extractor"):
        want = sorted(sql.execute(registry.ORACLE_SQL[name]).fetchall())
        assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == want, name
    assert extract.extract("<p>a&amp;&amp &amp;lt;</p>")["text"] == "a&& <"  # filings: as before
    table = extract.extract("<table><tr><td>1&amp</td><td>a&#10;b&lt;</td></tr></table>", ended=True)
    assert table["text"].startswith("| 1&amp | a b< |")


def test_sections_and_chunks():
    body = "PART I\n" + "".join(f"Item {i}. Head {i}\n" for i in (1, 2, 3)) + "PART I\n" + "".join(f"Item {i}. Head {i}\n\n" + f"Sentence number {i} goes here. " * (100 * i) + "\n\n" for i in (1, 2, 3))
    notes: list[str] = []
    spans = extract.sections(body, "10-Q", notes)
    assert [s["item"] for s in spans] == ["I.1", "I.2", "I.3"] and spans[-1]["end"] == len(body)
    assert all(a["end"] == b["start"] for a, b in zip(spans, spans[1:], strict=False))
    assert extract.sections(body, "10-K", notes) == [] and extract.sections(body, "8-K", []) == []
    out = list(chunk.chunks(body, [], spans))
    assert {s for s, *_ in out} == {"I.1", "I.2", "I.3"} and all(len(c) <= chunk.MOST for _, c, _ in out)
    assert [c for _, c, _ in chunk.chunks("x" * 9000, [], [])] and list(chunk.chunks("", [], [])) == []
    table = {"start": 3, "end": 8, "numeric_frac": 0.9}
    assert list(chunk.chunks("ab\n|1|2|\ncd", [table], [])) == [("", "ab\n\n\n\ncd".replace("\n\n\n\n", "\n\n"), 5)]


def longest_by_hand(labels):
    """Every rising run, the longest; of several the one whose end is first, and so on backwards."""
    k = [extract.rank(x) for x in labels]
    runs = {i: [i] for i in range(len(k))}
    for i in range(len(k)):
        for j in range(i):
            if k[j] < k[i] and len(runs[j]) + 1 > len(runs[i]):
                runs[i] = [*runs[j], i]
    return max(runs.values(), key=len, default=[])


def test_rising_is_longest_and_the_first_of_several():
    labels = ["I.1", "I.3", "I.2", "II.1", "I.2A", "I.3"]
    assert [labels[i] for i in extract.rising(labels)] == ["I.1", "I.2", "I.2A", "I.3"]
    assert extract.rising(["I.1", "I.3", "I.2"]) == [0, 1] and extract.rising([]) == []
    r = random.Random(2)
    pool = [f"{p}{i}" for p in ("", "I.", "II.", "IV.") for i in ("1", "1A", "2", "7A", "10")]
    for _ in range(2000):
        labels = [r.choice(pool) for _ in range(r.randrange(12))]
        assert extract.rising(labels) == longest_by_hand(labels)


def test_a_label_of_a_picture_is_no_wrapper():
    assert extract.extract("<p>before</p><svg><text>lab</text></svg><p>after</p>")["text"] == "before\n\nlabafter"
    assert extract.extract("<TYPE>8-K\n<TEXT>\n<html><p>in</p></html>\n</TEXT>\nout")["text"] == "in"
    assert extract.extract("<TYPE>8-K\n<html><p>in</p></html>")["text"] == "in" and extract.extract("lead <html><p>in</p></html>")["text"] == "lead in"
    assert extract.extract("x<div>y</div>z<p>a<p>b<ul><li>c<li>d</ul>e<hr>f")["text"] == "xy\n\nza\n\nb\n\nc\n\nd\n\ne\n\nf"
    assert extract.extract(b"\x81")["warnings"] == ["decode_lossy"]


def test_chunks_fill_keep_the_ceiling_and_overlap():
    sentence = "Some words stand here. "
    text = "\n\n".join([sentence * n for n in (3, 150, 1, 400, 20)] + ["y" * 9000, "short end."])
    made = [c for _, c, _ in chunk.chunks(text, [], [])]
    assert all(len(c) <= chunk.MOST for c in made) and "".join(made).count("y") >= 9000
    for a, b in zip(made, made[1:], strict=False):
        lead = b.split("\n\n")[0]
        assert a.endswith(lead) or len(lead) > chunk.OVERLAP  # an overlap, or a unit that left it no room
    assert chunk.tail("Short. Text") == "Short. Text" and chunk.tail("x" * 300 + ". One. " + "z" * 150) == "One. " + "z" * 150
    assert list(chunk.units("a b. " * 1000))[0] == ("a b. " * 1000).strip()[: chunk.MOST]  # one sentence (no capital), cut at the ceiling
    assert chunk.pack(["a" * 2990, "b" * 100]) == ["a" * 2990 + "\n\n" + "a" * 200 + "\n\n" + "b" * 100] and len(chunk.pack(["a" * 2990, "b" * 900])) == 2


def test_section_names(spark):
    rows = [("10-K", "I.1A"), ("10-Q", "II.1A"), ("10-K", "1A"), ("10-Q", ""), ("10-Q", "III.9"), ("8-K", "I.1")]
    got = [r.n for r in spark.createDataFrame(rows, "form string, label string").select(chunk.section_name("form", "label").alias("n")).collect()]
    assert got == ["risk_factors", "risk_factors", "risk_factors", "", "10-Q:III.9", "8-K:I.1"]


def test_lexicon_merge_and_parse(spark):
    docs = spark.createDataFrame([("a", "AI and GPU"), ("b", "plain GPUs maintain"), ("c", "a large language model"), ("d", None)], "doc_id string, text string")
    f = classify.flag(docs, ["text"])
    assert {r.doc_id: r.lexicon_terms for r in f.collect()} == {"a": ["ai", "gpu"], "b": [], "c": ["large language model"], "d": []}
    answers = spark.createDataFrame([("a", json.dumps({"ai_relevance": "substantive", "ai_role": "A", "materiality": "high", "valence_ai": 1, "confidence": 7, "evidence_span": "x"}))], "doc_id string, j string")
    got = {r.doc_id: r for r in classify.merge_labels(f, classify.parse_labels(answers, "j")).collect()}
    assert got["a"].confidence == 1.0 and not got["a"].gated_out
    assert got["b"].ai_relevance == "none" and got["b"].gated_out and got["b"].confidence == 1.0
    assert got["c"].ai_relevance is None and not got["c"].gated_out
    bad = classify.parse_labels(spark.createDataFrame([("x", "no json")], "doc_id string, j string"), "j").first()
    assert bad.ai_relevance is None and bad.confidence is None
    assert [r.m for r in docs.where("doc_id='a'").select(classify.user_block("text", ["gpu"]).alias("m")).collect()] == ["AI and [COMPANY]"]


def test_contradictions_are_never_cut(spark):
    rows = [(f"{i:02}", "substantive", "E_none", 1, True, 0.5) for i in range(15)] + [("z", "substantive", "A", 1, True, 0.1)]
    df = spark.createDataFrame(rows, "doc_id string, ai_relevance string, ai_role string, valence_ai int, lexicon_hit boolean, confidence double").withColumn("gated_out", F.lit(False))
    assert classify.contradictions(df, 12).count() == 15
    assert {r.doc_id for r in classify.contradictions(df, 16).collect()} >= {"z"}


def test_gate_raises(spark):
    ok = spark.createDataFrame([("a", "Some clean words here. " * 50, "8-K", "primary")], "doc_id string, text string, form string, doc_role string")
    assert docquality.gate(docquality.check_documents(ok)).count() == 1
    with pytest.raises(ValueError, match="entity_residue"):
        docquality.gate(docquality.check_documents(ok.withColumn("text", F.concat("text", F.lit("&nbsp;")))))
    empty = docquality.check_documents(ok.withColumn("text", F.lit(None).cast("string"))).first()
    assert empty.near_empty and empty.alpha_ratio == 0 and empty.mean_word_len == 0


def test_newey_west_and_vif(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2))
    x[:, 1] += 0.5 * x[:, 0]
    y = 0.1 + x @ [0.7, -0.2] + r.normal(size=200)
    import datetime

    days = [datetime.date(2024, 1, 1) + datetime.timedelta(int(i)) for i in range(200)]
    df = spark.createDataFrame([("T", d, float(a), float(b[0]), float(b[1])) for d, a, b in zip(days, y, x, strict=True)], "ticker string, date date, y double, a double, b double")
    got = timeseries.regress(df, "ticker", "y", ["a", "b"], "a").first()
    X = np.column_stack([np.ones(200), x])
    beta = np.linalg.solve(X.T @ X, X.T @ y)
    u = X * (y - X @ beta)[:, None]
    s = sum((1 - abs(k) / 6) * sum(np.outer(u[t], u[t - k]) for t in range(max(k, 0), 200 + min(k, 0))) for k in range(-5, 6))
    inv = np.linalg.inv(X.T @ X)
    assert got.beta == pytest.approx(beta[1]) and got.se == pytest.approx(np.sqrt((inv @ s @ inv)[1, 1]))
    other = np.column_stack([np.ones(200), x[:, 1]])
    e = x[:, 0] - other @ np.linalg.lstsq(other, x[:, 0], rcond=None)[0]
    assert got.vif_focus == pytest.approx(x[:, 0].var() / e.var())
    rolled = timeseries.rolling_beta(df, "ticker", "y", ["a", "b"], "a", 50).orderBy("date").collect()
    assert len(rolled) == 151 and rolled[7].beta == pytest.approx(np.linalg.lstsq(X[7:57], y[7:57], rcond=None)[0][1])
    res = timeseries.orthogonalise(df, "ticker", "y", ["a", "b"]).agg(F.avg("resid"), F.corr("resid", "resid")).first()
    assert abs(res[0]) < 1e-12


def test_returns_and_guards(spark):
    df = spark.createDataFrame([("A", "2024-01-01", 10.0), ("A", "2024-01-02", 11.0), ("A", "2024-01-12", None), ("A", "2024-01-13", 12.0)], "ticker string, date string, price double").withColumn("date", F.to_date("date"))
    assert [r.ret for r in timeseries.simple_returns(df).orderBy("date").collect()] == [pytest.approx(0.1), None]
    with pytest.raises(ValueError):
        timeseries.long_short(df.withColumn("ret", F.col("price")), ["A"], "B", ["A"])
    pct = timeseries.as_decimals(df.select((F.col("price") / 10).alias("x")), ["x"])
    assert pct.agg(F.max("x")).first()[0] == pytest.approx(0.012)


def test_sources(spark, tmp_path):
    feed = {"data": {"NVDA": {"feed": [{"url": "HTTPS://A.com/x/?utm_source=1&b=2#f", "title": "T", "summary": "S", "time_published": "20240105T101112", "source": "s", "source_domain": "A.com", "overall_sentiment_score": 0.1, "ticker_sentiment": [{"ticker": "AMD", "relevance_score": "0.9", "ticker_sentiment_score": "0.1"}, {"ticker": "NVDA", "relevance_score": "0.7", "ticker_sentiment_score": "0.2"}]}]}}}
    (tmp_path / "n.json").write_text(json.dumps(feed))
    r = readers.relevant_news(readers.news_rows(spark, str(tmp_path / "n.json"))).collect()
    assert len(r) == 1 and (r[0].av_relevance, r[0].period, str(r[0].date)) == (0.7, "2024Q1", "2024-01-05 10:11:12")
    page = "<table>" + "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in row)}</tr>" for row in [("1", "d", "main.htm iXBRL", "8-K", "9"), ("2", "d", "ex.htm", "EX-99.1 CHARTER", "9"), ("3", "d", "g.jpg", "GRAPHIC", "1"), ("x", "d", "n.htm", "EX-99", "1"), ("4", "bad")]) + "</table>"
    assert readers.index_documents(page, "main.htm") == [(1, "8-K", "primary", "main.htm"), (2, "EX-99.1 CHARTER", "exhibit", "ex.htm")]
    assert readers.index_documents("", "m.htm") == [(0, "", "primary", "m.htm")]
    spark.createDataFrame([("a1", page, "main.htm")], "accession string, page string, primary_document string").createOrReplaceTempView("f")
    assert readers.list_documents(spark, "f").count() == 2
    lists = spark.createDataFrame([("T", ["10-K", "S-1", "8-K"], ["2024-02-01", "2024-01-01", "2020-01-01"])], "ticker string, form array<string>, filingDate array<string>")
    assert [x.form for x in readers.filings(lists, ["form", "filingDate"], "2023-01-01", "2025-01-01").collect()] == ["10-K"]
    recent = spark.createDataFrame([(1, ["a"], ["x"])], "cik int, form array<string>, items array<string>")
    shard = spark.createDataFrame([(1, ["b", "c"], None)], "cik int, form array<string>, items array<string>")
    got = readers.merge_shards(recent, shard, ["form", "items"]).first()
    assert (got.form, got["items"]) == (["a", "b", "c"], ["x", "", ""])
    readers.write_tsv(spark.createDataFrame([("a", 0.5)], "k string, v double"), str(tmp_path / "t"))
    assert readers.read_csv(spark, str(tmp_path / "t"), "k string, v double", "\t").first().v == 0.5


@pytest.mark.parametrize("url, want", [("https://Ex.COM/a/b/?utm_source=x&q=1&ref=z#top", "https://ex.com/a/b?q=1"), ("http://e.com", "http://e.com"), ("http://e.com/?fbclid=1", "http://e.com")])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url("u")).first()[0] == want


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id AS doc_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) AS date, CASE WHEN id % 3 = 0 THEN 'a GPU' ELSE 'none' END AS text, id % 2 AS kind, double(id) AS v FROM range(300)")
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("hits", gate_stream(s, ["text"])), ("agg", windowed_counts(s, "date", "kind", "v"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("hits").count() == 100
    batch = {(r.start, r.kind): (r.n, r.total) for r in windowed_counts(spark.read.parquet(str(tmp_path / "in")), "date", "kind", "v").collect()}
    closed = {(r.start, r.kind): (r.n, r.total) for r in spark.table("agg").collect()}
    hours = sorted({start for start, _ in batch})  # rows reach to 04:59, the watermark to 04:49
    assert len(hours) == 5 and closed == {k: v for k, v in batch.items() if k[0] < hours[4]}


def test_samples_and_diffs(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    a = relational.hashed_sample(df, ["g"], "id", 5).collect()
    assert len(a) == 15 and sorted(a) == sorted(relational.hashed_sample(df.repartition(7), ["g"], "id", 5).collect())
    d = relational.table_diff(df.where("id < 60"), df.where("id > 40"), ["id"]).groupBy("_diff").count().collect()
    assert {r["_diff"]: r["count"] for r in d} == {"new": 41, "missing": 40}  # 60 to 99


def test_the_bootstrap_query_draws_as_often_as_the_operator(spark):
    from tidewater.plans import registry

    assert 500 < registry.bootstrap_ci(spark, "/root/testdata/sf0.001").first().draws <= 2000


def test_factor_side_against_least_squares(spark):
    """Six names, two styles; a basket of two; each step against numpy."""
    import datetime

    r = np.random.default_rng(4)
    n = 160
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(int(i)) for i in range(n)]
    mkt, smb = r.normal(0, 0.01, n), r.normal(0, 0.01, n)
    ret = {t: 0.0002 + b * mkt + c * smb + r.normal(0, 0.01, n) for t, b, c in (("B1", 1.2, 0.1), ("B2", 0.9, 0.3), ("S1", 1.0, 0.2), ("S2", 0.7, -0.4), ("N1", 1.1, 0.0), ("N2", 0.4, 0.5))}
    rets = spark.createDataFrame([(t, d, float(x)) for t, xs in ret.items() for d, x in zip(days, xs, strict=True)], "ticker string, date date, ret double")
    fac = spark.createDataFrame([(d, float(a), float(b), 0.0001) for d, a, b in zip(days, mkt, smb, strict=True)], "date date, MKT double, SMB double, RF double")

    def resid(y, *xs):
        x = np.column_stack([np.ones(n), *xs])
        return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]

    table = factors.factor_table(rets, fac, ["B1", "B2"], "S1", ["S1", "S2"], ["MKT", "SMB"], ["N1", "N2"]).orderBy("date").toPandas()
    raw = (ret["B1"] + ret["B2"]) / 2 - ret["S1"]
    s1, s2, aif = resid(ret["S1"] - 0.0001, mkt, smb), resid(ret["S2"] - 0.0001, mkt, smb), resid(raw, mkt, smb, ret["S1"] - 0.0001)
    assert np.allclose(table["AIF"], raw) and np.allclose(table["AIF_orth"], aif) and np.allclose(table["S1_orth"], s1) and np.allclose(table["S2_orth"], s2)
    m = factors.design(rets, spark.createDataFrame(table), {"N1": "S2", "N2": "S1"}, ["MKT", "SMB"]).orderBy("date").toPandas()
    one = m[m["ticker"] == "N1"]
    assert len(m) == 2 * n and np.allclose(one["SECTOR"], s2) and np.allclose(one["excess"], ret["N1"] - 0.0001)
    t = factors.teardown(rets, fac, "S2", "S1", "N1", ["MKT", "SMB"]).first()
    e = resid(ret["S2"] - 0.0001, mkt, smb, ret["S1"] - 0.0001)
    assert t.r2 == pytest.approx(1 - e.var() / (ret["S2"]).var()) and t.corr_sector == pytest.approx(np.corrcoef(ret["S2"], ret["S1"])[0, 1]) and "independent" in t.verdict
    assert factors.universe(["N1"], ["B2", "B1"], ("S1",)) == ["B1", "B2", "N1", "S1"] and len(factors.universe([], [])) == 5


def test_style_factors_and_report(spark):
    five = spark.createDataFrame([("2024-01-02", 1.2, 0.5), ("2024-01-03", -0.9, 0.02)], "date string, ` Mkt-RF` double, RF double")
    mom = spark.createDataFrame([("2024-01-03", 0.7)], "date string, `Mom   ` double")
    got = factors.style_factors(five, mom).first()
    assert (got["Mkt-RF"], got["MOM"]) == (pytest.approx(-0.009), pytest.approx(0.007))
    rows = [("NVDA", "2024-01-01", -0.6), ("NVDA", "2024-01-20", 0.3), ("A", "2024-01-20", None)]
    rep = factors.price_report(spark.createDataFrame(rows, "ticker string, date string, ret double").withColumn("date", F.to_date("date")), "NVDA").first()
    assert (rep.n_gaps, rep.n_extreme, rep.no_long_gap, rep.split_continuous, rep.plausible_length) == (1, 1, False, False, False)


def test_rank_correlation_has_the_p_of_students_t(spark):
    rows = [(f"t{i}", float(i), float((i * 7) % 9)) for i in range(9)]
    got = reconcile.spearman(spark.createDataFrame(rows, "ticker string, a double, b double"), "a", "b").first()
    x = np.abs(got.rho) * np.sqrt(7 / (1 - got.rho**2))
    grid = np.linspace(x, 4000, 4_000_001)
    from math import gamma, pi, sqrt

    density = gamma(4) / (sqrt(7 * pi) * gamma(3.5)) * (1 + grid**2 / 7) ** -4
    assert got.p == pytest.approx(2 * np.trapezoid(density, grid), abs=1e-6)
    assert reconcile._two_sided_t(0.0, 10) == pytest.approx(1) and reconcile._two_sided_t(0.5, 3) == pytest.approx(2 / 3)


def test_label_slots_and_near_points(spark):
    points = [("a", 0.0, 1.0), ("b", 0.1, 0.95), ("c", 0.05, 0.9), ("far", 9.0, 9.0)]
    assert reconcile.label_offsets(points, 1.0) == {"far": reconcile.SLOTS[0], "a": reconcile.SLOTS[0], "b": reconcile.SLOTS[1], "c": reconcile.SLOTS[2]}
    got = reconcile.near_points(spark.createDataFrame(points, "k string, x double, y double"), "k", "x", "y", 0.18, 0.16).collect()
    assert {tuple(r) for r in got} == {(a, b) for a in "abc" for b in "abc" if a != b}


def test_assembly_chunks_coverage_and_verification(spark):
    body = "PART I\n" + "".join(f"Item {i}. {h}\n\n" + f"Sentence {i} stands here. " * n + "\n\n" for i, h, n in (("1", "Business", 300), ("1A", "Risk Factors", 900), ("3", "Legal Proceedings", 5), ("7", "Management's Discussion", 400), ("8", "Statements", 50)))
    page = "<html>" + "".join(f"<p>{p}</p>" for p in body.split("\n")) + "<table><tr><td>Revenue</td><td>1,000</td><td>2,000</td></tr></table></html>"
    index = spark.createDataFrame([("T", "Test Inc", 7, "10-K", "2024-02-01", "2023-12-31", "0001-24-000001", None)], "ticker string, company string, cik int, form string, filingDate string, reportDate string, accession string, items string")
    listed = spark.createDataFrame([("0001-24-000001", 1, "10-K", "primary", "a.htm"), ("0001-24-000001", 2, "", "exhibit", "b.htm"), ("0001-24-000001", 3, "EX-99.1", "exhibit", "missing.htm")], "accession string, seq int, doc_type string, doc_role string, filename string")
    raw = spark.createDataFrame([("0001-24-000001", "a.htm", bytearray(page.encode()), "2024-03-01"), ("0001-24-000001", "b.htm", bytearray(b"<p>short</p>"), "2024-03-01")], "accession string, filename string, raw binary, fetched_at string")
    docs = extract.assemble(index, listed, raw)
    got = {r.filename: r for r in docs.collect()}
    assert set(got) == {"a.htm", "b.htm"} and got["b.htm"].doc_type == "10-K" and got["a.htm"].url.endswith("/7/000124000001/a.htm")
    assert got["a.htm"].title == "T 10-K 2024-02-01 10-K" and got["a.htm"].raw_bytes == len(page) and len(got["a.htm"].content_sha256) == 64
    assert [s["item"] for s in got["a.htm"].section_spans] == ["I.1", "I.1A", "I.3", "I.7", "I.8"] and got["a.htm"].n_tables_numeric == 1
    c = chunk.build(docs)
    rows = c.collect()
    assert {r.period for r in rows} == {"2024Q1"} and all(r.title.endswith(f"#{r.chunk_ix}") for r in rows) and any(" Item I.1A #" in r.title for r in rows)
    assert not any("1,000" in r.text for r in rows) and sum(r.table_chars_dropped for r in rows) > 0
    cov = chunk.chunk_coverage(c).first()
    assert cov.n == len(rows) and cov.n_over == 0 and cov.n_labelled == len(rows) - 1 and cov.n_tiny >= 1
    assert [r.section_name for r in chunk.chunk_counts(c.where("section <> ''"), "section_name", 2).collect()] == ["risk_factors", "10-K:I.7"]
    checks = {r.check: (r.value, r.verdict) for r in docquality.verify_sections(docs).collect()}
    assert checks["coverage"][0] == 0.5 and checks["heading_1A"] == (1.0, "PASS") and checks["heading_3"] == (1.0, "PASS") and checks["median_sections"][1] == "CHECK" and checks["size_spread"][1] == "PASS"
    assert docquality.section_report(docs).first().n_sections == 5 and relational.warning_histogram(docs, "warnings").collect() is not None


def test_cached_harvest_prices_and_dump(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert readers.cached(spark, str(tmp_path / "c"), make, force).count() == 3
    assert len(made) == 2
    asked = spark.createDataFrame([("A", "2024Q1"), ("B", "2024Q1"), ("C", "2024Q1")], "ticker string, period string")
    reply = lambda t, p: None if t == "C" else json.dumps([{"url": f"{t}{i}", "relevance": i / 10} for i in range(5)])
    got = readers.harvest(asked, reply, "url:string,relevance:double", per_ticker=2).collect()
    assert sorted(r.url for r in got) == ["A3", "A4", "B3", "B4"]
    spark.sql("SELECT 'A' AS ticker, date'2024-01-01' + cast(id AS int) AS date, double(id) AS price FROM range(10)").write.parquet(str(tmp_path / "p"))
    assert readers.prices(spark, str(tmp_path / "p"), ["A"], "2024-01-03", "2024-01-05").count() == 3
    docs = spark.createDataFrame([(i, f"text {i}\nline") for i in range(6)], "doc_id long, text string")
    assert readers.dump_texts(docs, str(tmp_path / "d"), 4).count() == 4 and len(list((tmp_path / "d").glob("doc_id=*"))) == 4


def test_audit_rules_and_plug_in(spark):
    docs = spark.createDataFrame([("a", "GPU and AI at scale"), ("b", "one gpu"), ("c", "none")], "doc_id string, text string")
    got = {r.doc_id: r for r in classify.classify(classify.flag(docs, ["text"])).collect()}
    assert (got["a"].ai_relevance, got["b"].ai_relevance, got["c"].gated_out) == ("substantive", "incidental", True)
    with pytest.raises(Exception, match="no price"):
        relational.log_costs(spark.createDataFrame([("x", 1, 1, 0, 0, False)], "model string, input int, output int, cache_read int, cache_write int, batch boolean"), {"m": (1, 1)}).collect()
    assert classify.rubric({"b": "1"}, {"a": "2"}, {}) == classify.rubric({"b": "1"}, {"a": "2"}, {})
    u = spark.createDataFrame([("A", "sec_filing", "risk_factors", -1)] * 15 + [("A", "sec_filing", "business", 1)] * 15, "ticker string, source_category string, section_name string, valence_ai int")
    u = u.withColumn("ai_relevance", F.lit("substantive")).withColumn("period", F.lit("2024Q1")).withColumn("gated_out", F.lit(False)).withColumn("doc_id", F.monotonically_increasing_id())
    assert classify.section_order(u).first().verdict == "PASS" and classify.negative_class(u).first().verdict == "PASS" and classify.failures(u).first().verdict == "none"
    assert classify.thin_cells(u).first().n_thin == 0 and classify.review_sample(u.withColumn("text", F.lit("x" * 900)), "section_name", 4).count() == 8
    news = docs.selectExpr("doc_id", "'A' AS ticker", "'2024Q1' AS period", "current_timestamp() AS date", "'t' AS title", "text", "'news' AS source_category", "'u' AS url")
    chunks = news.withColumn("chunk_id", F.concat("doc_id", F.lit("#0"))).withColumn("section", F.lit("I.1")).withColumn("section_name", F.lit("business"))
    both = classify.union_corpus(chunks, news).collect()
    assert len(both) == 6 and {r.doc_id for r in both} == {"a#0", "b#0", "c#0", "a", "b", "c"} and all(r.parent_doc_id in "abc" for r in both)
