"""Operators against brute-force versions on small fixtures, with nulls, empty and long texts, ties, repeated and no rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import bpe, chat, jaccard, langid, media, mixing, pii, quality, queries, sharding, simhash, substring_dedup, words
from tidewater.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, bucket string, size string"


def some_texts(seed=1):
    r = random.Random(seed)
    vocabulary = ["ab", "tre", "ön", "wh", "the", "of", "x1", "Ère", "#", "%%"]
    shared = " ".join(r.choice(vocabulary) + str(i) for i in range(60))
    texts = [" ".join(r.choice(vocabulary) + str(r.randrange(300)) for _ in range(r.randrange(1, 200))) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " tail", shared, "lead " + shared, shared + "\n" + shared, shared[: len(shared) // 2]]
    texts += [None, None, "", " \t\n ", "one", "one\ntwo\r\none\none\x0bend", "a " * 30_000, "Ω Ω " * 50, "line one\nline one\n\nline one\nother"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "ä", "hot", "hot", "hot"][i % 7], len(t or ""), "k", "b", "s") for i, t in enumerate(some_texts())]
    rows += [rows[3], rows[3], (None, "no id", None, None, 5, "k", "b", "s"), (3, "same id, other text", "en", "a", 1, "k", "b", "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_windows(rows, L=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + L]) for w in words for i in range(len(w) - L + 1))
    want = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for s in range(len(w) - L + 1) if seen[tuple(w[s : s + L])] > 1 for j in range(s, s + L)}
        want[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return want


def test_substring_dedup(docs, none):
    want = brute_windows([(r.doc_id, r.text) for r in docs.collect()])
    out = substring_dedup.remove_repeated_windows(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == want
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in out)
    assert all(a.end < b.start for r in out for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert substring_dedup.remove_repeated_windows(none).count() == 0


@pytest.mark.parametrize("chunk, rows_hot", [(200, 1000), (1 << 22, 2), (200, 2)])
def test_substring_dedup_settles_repeats_inside_a_chunk_and_across(spark, monkeypatch, chunk, rows_hot):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", rows_hot)
    w = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w if i % 2 else [f"d{i}", *w[:20]])) for i in range(40)]
    rows += [(100 + i, " ".join([f"e{i}", *w, f"f{i}"])) for i in range(9)] + [(200, "a " * 34), (201, "a " * 35), (202, "b c " * 18), (203, "x y z " * 40 + " ".join(w)), (None, None)]
    r = random.Random(3)
    for i in range(30):  # passages of 30 to 60 words of a common text, at odd places
        at = r.randrange(150)
        rows.append((300 + i, " ".join([f"p{r.randrange(10**6)}" for _ in range(r.randrange(40))] + [f"c{k % 90}" for k in range(at, at + r.randrange(30, 60))] + [f"q{r.randrange(10**6)}" for _ in range(9)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.remove_repeated_windows(frame).collect()) == brute_windows(rows)


@pytest.mark.parametrize("step", [substring_dedup._anchors, substring_dedup._send])
def test_windows_of_many_texts_are_hashed_within_a_bound_of_memory(monkeypatch, step):
    """Batches of a stream must not be held together: the workers of an executor share what its heap leaves."""
    monkeypatch.setattr(words, "_POWERS", {})
    r = random.Random(2)
    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(300)) for _ in range(6000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 1500)), pa.array(range(i, i + 1500)), pa.array(text[i : i + 1500]), pa.array([False] * 1500), pa.array([[1]] * 1500, pa.list_(pa.int64())), pa.array(range(i, i + 1500))], [*substring_dedup.TEXT, "text", "several", "anchors", "doc_id"]) for i in range(0, 6000, 1500)]
    tracemalloc.start()
    try:
        for _ in step(35)(iter(b if step is substring_dedup._send else b.select([0, 1, 2]) for b in batches)):
            pass
        assert tracemalloc.get_traced_memory()[1] < 250e6
    finally:
        tracemalloc.stop()


def brute_measures(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    inside = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(docs, none):
    out = quality.ledger(docs).collect()
    assert {(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out} == {brute_measures(r.text) for r in out}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.text) for r in out)
    assert all(bool(r.fail_bits & quality.BASE.mask) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)
    assert quality.ledger(none).count() == 0
    judged = quality.ledger(docs)
    got = {r["rule"]: (r.n_failed, r.n_only_this) for r in quality.ablation(judged, quality.STANDARD).collect()}
    for rule in quality.STANDARD.rules:
        bit = quality.BIT[rule]
        assert got[rule] == (sum(bool(r.fail_bits & bit) for r in out), sum(r.fail_bits & quality.STANDARD.mask == bit for r in out))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab9102.@+- ()%\nç", max_size=60))
def test_plain_spans_match_the_patterns(text):
    assert pii.find_base(text) == brute_spans(text)
    found = pii.find_spans(text)
    assert set(brute_spans(text)) <= set(found)
    assert all(0 <= a < b <= len(text) for _, a, b in found)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("write to jane(at)mail.example(dot)org.", "email", "jane(at)mail.example(dot)org"),
        ("jane at example dot com", "email", "jane at example dot com"),
        ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("mail jane​@exam​ple.com ok", "email", "jane​@exam​ple.com"),
        ("full ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("host 10[.]20[.]30[.]40 down", "ip", "10[.]20[.]30[.]40"),
        ("call plus one four one five five five five zero one two three", "phone", "plus one four one five five five five zero one two three"),
        ("call +４１ ５５５ １２３４", "phone", "+４１ ５５５ １２３４"),
        ("call plus one (four one five) five five five double zero one two", "phone", "plus one (four one five) five five five double zero one two"),
        ("call +1 triple five two one double two 9", "phone", "+1 triple five two one double two 9"),
        ("card four two four two four two four two four two four two four two four two", "card", "four two four two four two four two four two four two four two four two"),
    ],
)
def test_disguises_map_back(text, kind, part):
    at = text.index(part)
    assert (kind, at, at + len(part)) in pii.find_spans(text)


@pytest.mark.parametrize("text", ["look at example.com today", "Anat at the dot of this", "one two three go", "he was at home dot", "un deux", "a@b", "1.2.3", "", "at dot at dot", "at this point in time", "met at the dot com boom", "at some point later on", "double two and more"])
def test_clean_texts_have_no_spans(text):
    assert pii.find_spans(text) == []


def test_pii_query_equals_a_brute_force_version(spark, tmp_path):
    """The whole output; the added spans are known because each text has one disguise at a known place, or none."""
    r = random.Random(6)
    plain = ["a.b@c.dd", "10.2.3.4", "4242 4242 4242 4242", "+1 415 555 0123", "300.1.1.1", "4242 4242 4242 4241", "x@y", "nothing"]
    hidden = [("email", "ann [at] site.org"), ("email", "bob (at) site (dot) org"), ("ip", "10[.]20[.]30[.]40"), ("phone", "plus one four one five five five five zero one two three"), None, None]
    rows = [(0, None), (1, ""), (1, "same id"), (None, "a@b.cc")]
    want = Counter()
    for i in range(2, 200):
        words = [f"w{r.randrange(99)}x" for _ in range(r.randrange(1, 12))] + r.choices(plain, k=3)
        r.shuffle(words)
        rows.append((i, " ; ".join(words)))
    made = []
    for i, text in rows:
        extra, text = [], text
        h = r.choice(hidden) if i and i > 1 else None
        if h:
            text = f"{text} ; {h[1]} ; end"
            at = text.rindex(h[1])
            extra = [(h[0], at, at + len(h[1]))]
        made.append((i, text))
        base = brute_spans(text or "")
        every = sorted([*base, *extra], key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[i, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(every)] += 1
    spark.createDataFrame(made, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_pii(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert Counter(map(tuple, got)) == want


def test_pii_frame(docs, none):
    out = pii.detect(docs, redacted=True).collect()
    assert len(out) == docs.count() and all(not r.pii_base for r in out if not r.text)
    assert pii.redact("x a@b.cc y +1 234 567 8901 z", pii.find_spans("x a@b.cc y +1 234 567 8901 z")) == "x <email> y <phone> z"
    assert pii.detect(none).count() == 0
    assert pii.find_base("1" * 200_000) == [] and pii.find_spans("a" * 200_000 + "@") == []


def waterfill(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixing(docs, none):
    def run():
        return mixing.mix(mixing.with_size(docs.select("doc_id", "source", "text"), keep_text=True)).collect()

    out = run()
    assert len(out) == docs.count() and all(r["size"] == len(WORD.findall(r.text or "")) for r in out)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = waterfill(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    key = lambda rows: sorted((str(r.doc_id), r["size"], str(r.source), r.taken) for r in rows)
    assert key(out) == key(run())
    assert mixing.mix(mixing.with_size(none.select("doc_id", "source", "text"))).count() == 0


def test_mixing_of_many_sources_repeated_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    monkeypatch.setattr(mixing, "BLOCK", 16)
    r = random.Random(2)
    rows = [(i, f"s{r.randrange(40):02}" if r.random() < 0.6 else "hot", "w " * r.randrange(1, 30), "k", 1.5, "x", 7) for i in range(600)]
    rows += [(None, "same", "one text here", "k", 1.5, "x", 7)] * 400 + [(1, "empty", None, "k", 1.5, "x", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, key string, base double, dual string, Target int").repartition(3)

    def run():
        return mixing.mix(mixing.with_size(frame)).collect()

    out = run()
    assert len(out) == len(rows) and all((x["key"], x["base"], x["dual"]) == ("k", 1.5, "x") for x in out)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for x in out:
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x["size"])
        assert 0 <= x.taken <= 3 * x["size"]
    want = waterfill(sizes)
    assert all(x.target == pytest.approx(want[x.source]) for x in out)
    # a block ends within half its shortest document of its share
    assert all(abs(taken[s] - want[s]) <= largest[s] * (1 + sum(x.source == s for x in out) / 16) for s in sizes)
    assert Counter((x.doc_id, x.source, x.taken) for x in out) == Counter((x.doc_id, x.source, x.taken) for x in run())


def test_newton_meets_the_targets(spark):
    cells = [("a", 1.0, 100), ("a", 0.2, 400), ("b", 2.0, 50), ("c", 1.0, 10)]
    goals = {"a": 300.0, "b": 10.0, "c": 30.0}
    duals = {r.key: r.dual for r in mixing.solve(spark.createDataFrame(cells, "key string, base double, words long"), spark.createDataFrame(list(goals.items()), "key string, target double")).collect()}
    for s, goal in goals.items():
        assert sum(w * min(3.0, b * np.exp(duals[s])) for k, b, w in cells if k == s) == pytest.approx(goal, rel=1e-9)


@pytest.fixture(scope="module")
def own():
    ranks = bpe.encoder(queries.VOCABULARY, public_tokenizers.PATTERN).vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_bpe_equals_the_library(own, text):
    text = text.encode("utf-8", "ignore").decode()
    e = bpe.encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    assert e.encode(text).tolist() == own.encode_ordinary(text)
    assert e.decode(e.encode(text)) == text.encode()


def test_bpe_spaces_marks_and_long_runs(own, monkeypatch):
    e = bpe.encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    every = "".join(f"a{chr(c)}{chr(c)}b" for c in (*range(1, 0x180), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2030), 0x2028, 0x3000, 0xFEFF))
    for text in (every, "a" * 5000, "ab" * 3000 + "%" * 999, " " * 500 + "x", "it's we'll <|endoftext|> 1234 ½"):
        assert e.encode(text).tolist() == own.encode_ordinary(text)
    monkeypatch.setattr(bpe, "STRETCH", 7)
    for text in (every, "word  word ,word\n word   a1 b ' s  "):
        assert e.encode(text).tolist() == own.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(data=st.binary(max_size=300), new=st.binary(max_size=12), a=st.integers(0, 300), b=st.integers(0, 12))
def test_prefix_table_appends_and_edits(data, new, a, b):
    v = bpe.encoder(queries.VOCABULARY, public_tokenizers.PATTERN).vocabulary
    whole = bpe.PrefixTable(v, data)
    grown = bpe.PrefixTable(v)
    for i in range(0, len(data), 7):
        grown.append(data[i : i + 7])
    assert grown.last == whole.last
    if len(data) <= 60:
        assert whole.tokens() == v.merge(data)
    start = min(a, len(data))
    end = min(start + b, len(data))
    whole.edit(start, end, new)
    assert whole.last == bpe.PrefixTable(v, data[:start] + new + data[end:]).last


def test_bpe_frame(docs, none, own):
    args = queries.VOCABULARY, public_tokenizers.PATTERN
    for r in bpe.encode_texts(docs, *args, ids=True).collect():
        ids = own.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_texts(none, *args).count() == 0


def test_suffix_automaton_parses_greedily():
    text, query = "abracadabra", "abrabracadazzra"
    m = langid.Model({"x": text})
    n, i = 0, 0
    while i < len(query):
        j = i + 1
        while j < len(query) and query[i : j + 1] in text:
            j += 1
        n, i = n + 1, j
    assert m.phrases([m.codes(langid.fold(query))])[0, 0] == n


def naive_phrases(text, query):
    n = i = 0
    while i < len(query):
        j = i + 1
        while j < len(query) and query[i : j + 1] in text:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("lane, block", [(7, 1 << 21), (1, 40), (64, 100), (2048, 1 << 21)])
def test_lanes_and_blocks_parse_like_the_uncut_text(monkeypatch, lane, block):
    monkeypatch.setattr(langid, "LANE", lane)
    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(lane)
    samples = {"x": "".join(r.choice("abc ") for _ in range(300)), "y": "ab" * 200 + "c" * 60}
    texts = ["ab" * 150 + "z" + "c" * 40] + ["".join(r.choice("abcz ") for _ in range(r.randrange(1, 400))) for _ in range(30)] + [samples["x"], samples["y"] * 2]
    m = langid.Model(samples)
    got = m.phrases([m.codes(np.array([ord(c) for c in t], np.uint32)) for t in texts])
    assert got.tolist() == [[naive_phrases(samples["x"], t), naive_phrases(samples["y"], t)] for t in texts]


def test_language_id_equals_a_brute_force_version(docs):
    samples = langid.fit_samples(docs.where(langid.learned()))
    for r in langid.predict(docs.select("doc_id", "text"), samples, "text").collect():
        assert r.lang_pred in (*samples, "und")
    rows = docs.select("text").collect()
    lang, score = langid.Model(samples).predict([r.text for r in rows])
    for r, g, x in zip(rows, lang, score, strict=True):
        f = langid.fold(r.text).tobytes().decode("utf-32-le")
        if not f:
            assert (g, x) == ("und", 0.0)
        elif len(f) < 3000:
            cost = sorted((naive_phrases(t, f) * np.log2(len(t) + 1) / len(f), k) for k, t in samples.items())
            assert g == cost[0][1] and x == pytest.approx(1 - cost[0][0] / cost[1][0] if len(cost) > 1 else 1.0)


def test_language_id(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    held = queries.op8_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in held) > 0.95 * len(held)
    out = langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), langid.fit_samples(docs.where(langid.learned()))).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(r.lang_pred == "und" for r in langid.predict(docs.select("doc_id", "text"), {}).collect())
    assert langid.fit_samples(none) == {} and langid.predict(none.select("doc_id", "text"), {"x": "y"}).count() == 0


def brute_simhash(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_frame(docs, none):
    rows = docs.collect()
    fps = [brute_simhash(r.text) for r in rows]
    comp = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[comp[i]].append(r.doc_id)
    want = Counter((r.doc_id, f"{fps[i]:016x}", min(least[comp[i]], default=None)) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_lose_no_pair(spark):
    r = random.Random(5)
    fps = {0, 1, 3, 2**63, 2**64 - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 8)):
            fps.add(x)
            for _ in range(r.randrange(0, 4)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    want = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2])
    links = simhash.near_links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"))
    pairs = [(x.src % 2**64, x.dst % 2**64) for x in links.collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in pairs)
    assert components(fps, pairs) == want
    roots = {x.id % 2**64: x.root for x in connected_components(links).collect()}
    for a in fps:
        for b in fps:
            assert (want[a] == want[b]) == (a == b or (a in roots and b in roots and roots[a] == roots[b]))


@pytest.mark.parametrize("small", [1, 3])
def test_large_buckets_lose_no_pair(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    test_links_lose_no_pair(spark)


def test_carried_columns_may_be_named_like_results_in_any_case(spark):
    frame = spark.createDataFrame([(1, "a b@c.dd e", "x", "y", "z", "q", {"odd name": 1})], "doc_id long, text string, N_Words string, PII_base string, Lang_Pred string, N_TOKENS string, m map<string,int>")
    assert quality.ledger(frame).first()["n_words"] == 3 and pii.detect(frame, redacted=True).first()["pii_text"] == "a <email> e"
    assert bpe.encode_texts(frame, queries.VOCABULARY, public_tokenizers.PATTERN).first()["n_tokens"] > 0
    assert langid.predict(frame, {"en": "some text"}).first()["lang_pred"] == "en"


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_sharding(spark, docs, none):
    rows = [(i, f"copy {i % 7}" if i % 3 == 0 else ("flood" if i % 3 == 1 else f"own {i}")) for i in range(900)]
    for frame in (spark.createDataFrame(rows, "doc_id long, text string"), docs):
        out = sharding.shard(frame)
        got = out.collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
        sizes = Counter(r.shard for r in got)
        assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    spread = defaultdict(Counter)
    for x in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if x.text_crc32 in {zlib.crc32(f"copy {k}".encode()) for k in range(7)}:
            spread[x.text_crc32][x.shard] += 1
    met = sum(n * (n - 1) // 2 for c in spread.values() for n in c.values())
    every = sum(n * (n - 1) // 2 for n in (sum(c.values()) for c in spread.values()))
    assert len(spread) == 7 and met >= 0.5 * every  # a random deal keeps an eighth of the links of the small hubs uncut
    again = spark.createDataFrame([(1, "same")] * 500 + [(None, None)] * 300 + [(2, "other")], "doc_id long, text string").repartition(3)
    for x in (Counter(y.shard for y in sharding.shard(again).collect()),):
        assert set(x) == set(range(8)) and max(x.values()) - min(x.values()) <= 1
    flood = Counter(r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["size"] == 6)
    assert sum(n for _, n in flood.most_common(3)) >= 0.95 * 300  # 300 copies, 112 or 113 rows a shard
    assert sharding.shard(none).count() == 0


def brute_chat(rows):
    """Whole renderings: (conversation, perspective) to (text, mask, messages, trained); rows without a conversation one by one."""
    talks = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        talks[("row", k) if c is None else ("conv", c)].append((turn is None, turn or 0, role or "unknown", (text or "").replace("<|", "< |") + "<|end|>\n"))
    out = Counter()
    for (kind, c), turns in talks.items():
        for who in {t[2] for t in turns} - {"system"}:
            said, spans = "", []
            for *_, role, body in sorted(turns):
                said += "<|system|>" if role == "system" else "<|assistant|>" if role == who else f"<|user name={role.replace('<|', '< |').replace('|>', '| >')}|>"
                if role == who:
                    spans.append((len(said), len(said) + len(body)))
                said += body
            out[c if kind == "conv" else None, who, said, tuple(spans), len(turns), len(spans)] += 1
    return out


@pytest.mark.parametrize("segment", [2, 512])
def test_chat(spark, segment):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|user|> hey"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, None, "late"), (None, 0, "ann", "x"), (None, 0, "ann", "x"), (None, 1, "system", "y"), (2, 0, "system", "only"), (3, 700, "ann", "far"), (3, 1, "bob", "near")]
    rows += [(4, t, ["ann", "bob", "eve|><|assistant|>", "system"][t * 7 % 4], "word " * (t % 9)) for t in range(1300)] + [(5, 1, "ann", "long " * 60_000), (6, -3, "ann", "first"), (6, 4, "bob", "then")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, Segment string, start int").repartition(3)
    got = chat.rotate(frame, segment).orderBy("conv_id", "perspective", "segment").collect()
    parts = defaultdict(list)
    for k, r in enumerate(got):
        parts[r.conv_id, r.perspective, k if r.conv_id is None else 0].append(r)
    whole = Counter()
    for (c, who, _), rs in parts.items():
        assert [r.segment for r in rs] == list(range(len(rs)))
        text = "".join(r.rendered for r in rs)
        assert all(text[r.start : r.start + len(r.rendered)] == r.rendered for r in rs)
        whole[c, who, text, tuple((s.start, s.end) for r in rs for s in r["mask"]), sum(r.n_messages for r in rs), sum(r.n_trained for r in rs)] += 1
    assert whole == brute_chat(rows)
    assert chat.rotate(frame.limit(0)).count() == 0


def picture(r, side=96):
    return media.resize((r.rand(side // 8, side // 8) * 200 + 20).astype(np.float32), side, side)


def turned(x, degrees):
    """x turned about its middle, what comes from outside grey."""
    h, w = x.shape
    y, c = np.mgrid[:h, :w].astype(np.float64) - 0.5 * np.array([h - 1, w - 1])[:, None, None]
    t = np.deg2rad(degrees)
    sy, sx = np.cos(t) * y - np.sin(t) * c + (h - 1) / 2, np.sin(t) * y + np.cos(t) * c + (w - 1) / 2
    y0, x0 = np.clip(np.floor(sy).astype(int), 0, h - 2), np.clip(np.floor(sx).astype(int), 0, w - 2)
    fy, fx = np.clip(sy - y0, 0, 1), np.clip(sx - x0, 0, 1)
    out = (x[y0, x0] * (1 - fx) + x[y0, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1, x0] * (1 - fx) + x[y0 + 1, x0 + 1] * fx) * fy
    return np.where((sy < 0) | (sx < 0) | (sy > h - 1) | (sx > w - 1), 120.0, out)


def pasted(r, x):
    """x with a quarter of it painted over."""
    y = x.copy()
    y[30:78, 40:88] = picture(r, 48)
    return y


EDITS = {
    100: lambda r, x: x[8:80, 10:88], 200: lambda r, x: x * 0.8 + 25, 300: lambda r, x: turned(x, 30), 400: lambda r, x: np.rot90(x), 500: lambda r, x: media.resize(x, 72, 72),
    600: lambda r, x: x + r.normal(0, 4, x.shape), 700: pasted, 800: lambda r, x: media.resize(x, 144, 144),
}


def test_media(spark):
    r = np.random.RandomState(3)
    pictures = [picture(r) for _ in range(12)]
    rows = [(i, media.encode(p), i) for i, p in enumerate(pictures)]
    rows += [(k + i, media.encode(edit(r, p)), i) for k, edit in EDITS.items() for i, p in enumerate(pictures)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (None, rows[1][1], 1), (910, None, 0), (911, b"", 0), (912, b"P5 9 9 255\nshort", 0), (913, media.encode(np.full((60, 60), 7.0)), 0)]
    frame = spark.createDataFrame(rows, "id long, picture binary, image long").repartition(3)
    out = {x.id: x for x in media.copies(frame, "id", "picture").collect()}
    assert len(out) == len(rows) and all(out[i].n_keypoints == 0 for i in (910, 911, 912, 913))
    for k in EDITS:
        assert sum(out[k + i].group_id == i for i in range(12)) >= 11, k  # 0.9 of each edit
    assert all(x.group_id in (i % 100, i) for i, x in out.items() if i is not None and i < 900)  # never with another picture
    assert out[900].group_id == out[901].group_id == 0 and out[None].group_id == 1 and all(out[i].group_id == i for i in (910, 911, 912, 913))
    assert media.copies(frame.limit(0), "id", "picture").count() == 0


def test_half_a_picture_of_half_the_size_and_a_poor_one(spark):
    r = np.random.RandomState(4)
    big = [picture(r, 192) for _ in range(8)]
    plain = [picture(r)[20:60, 20:62] for _ in range(4)]
    rows = [(i, media.encode(p)) for i, p in enumerate(big)] + [(100 + i, media.encode(media.resize(p, 96, 96))) for i, p in enumerate(big)]
    rows += [(50 + i, media.encode(p)) for i, p in enumerate(plain)] + [(150 + i, media.encode(p * 0.9 + 9)) for i, p in enumerate(plain)]
    out = {x.id: x for x in media.copies(spark.createDataFrame(rows, "id long, picture binary"), "id", "picture").collect()}
    assert sum(out[100 + i].group_id == i for i in range(8)) >= 7
    poor = [i for i in range(50, 54) if media.FEWEST <= out[i].n_keypoints < 2 * media.INLIERS]
    assert len(poor) >= 3 and all(out[100 + i].group_id == i for i in poor)


def test_a_bucket_of_many_pictures_is_split(spark):
    """One key that every image holds: ranges share it, and the copies meet all the same."""
    r = np.random.RandomState(5)
    bits = r.randint(0, 256, (400, 40, 32)).astype(np.uint8)
    bits[:, 0] = 0
    bits[200:] = bits[:200]
    points = np.concatenate([r.rand(400, 40, 2) * 90, np.ones((400, 40, 1)), np.zeros((400, 40, 1))], 2).astype(np.float32)
    points[200:] = points[:200]
    rows = [(i, bytearray(points[i].tobytes()), bytearray(bits[i].tobytes())) for i in range(400)]
    pairs = {(x.src, x.dst) for x in media.proposals(spark.createDataFrame(rows, "no long, points binary, bits binary").repartition(4)).collect()}
    assert {(i + 200, i) for i in range(200)} <= pairs and len(pairs) <= 400 * media.TABLES


def test_no_bucket_loses_a_pair(spark, monkeypatch):
    """Every picture holds the same eight descriptors, and two of them the same places: all 300 share every bucket."""
    monkeypatch.setattr(media, "COUPLES", 20_000)
    r = np.random.RandomState(6)
    bits = np.broadcast_to(r.randint(0, 256, (8, 32)).astype(np.uint8), (300, 8, 32))
    points = np.concatenate([r.rand(300, 8, 2) * 90, np.ones((300, 8, 1)), np.zeros((300, 8, 1))], 2).astype(np.float32)
    points[150:] = points[:150]
    rows = [(i, 1000 + i, bytearray(points[i].tobytes()), bytearray(bits[i].tobytes())) for i in range(300)]
    described = spark.createDataFrame(rows, "no long, image long, points binary, bits binary").repartition(4)
    assert {(i + 150, i) for i in range(150)} <= {(x.src, x.dst) for x in media.proposals(described.drop("image")).collect()}
    assert {(max(x), min(x)) for x in media.confirmed(described).collect()} == {(i + 1150, i + 1000) for i in range(150)}


@pytest.mark.parametrize("blocks", [1, 2])
def test_what_is_proposed_is_matched_at_once_as_one_by_one(monkeypatch, blocks):
    """All pictures share four descriptors and places, so any two are proposed; few agree. None is matched by itself, and the links
    join what those of every pair would."""
    r = np.random.RandomState(8)
    sizes = r.randint(media.FEWEST, 40, 90)
    bits = [r.randint(0, 256, (n, 32)).astype(np.uint8) for n in sizes]
    points = [np.column_stack([r.rand(n, 2) * 90, np.ones(n), np.zeros(n)]).astype(np.float32) for n in sizes]
    for i in range(90):
        k = len(bits[i % 60]) * (i % 3 + 2) // 4 if i >= 60 else 0  # a half, three quarters or all of another's
        bits[i] = np.concatenate([bits[i % 60][:k], bits[i][k:]])
        points[i] = np.concatenate([points[i % 60][:k], points[i][k:]])
        bits[i][:4], points[i][:4] = bits[0][:4], points[0][:4]
    side = np.arange(90) * blocks // 90
    rows = {"no": range(90), "image": range(1000, 1090), "points": [x.tobytes() for x in points], "bits": [x.tobytes() for x in bits]}
    table = pa.table(rows | {"side": pa.array(side, pa.int32())})
    assert media._meet(False)(table).num_rows == (90 * 89 // 2 if blocks == 1 else 45 * 45)

    def groups(links):
        group = list(range(90))
        for x, y in links:
            group = [group[y] if g == group[x] else g for g in group]
        return [group.index(g) for g in group]

    every = [(i, j) for i in range(90) for j in range(90) if side[i] < side[j] or (blocks == 1 and i < j)]
    agree = [(i, j) for i, j in every if media.consensus(points[i], bits[i], points[j], bits[j], n := media.least_agreeing(min(len(bits[i]), len(bits[j])))) >= n]
    alone = []
    monkeypatch.setattr(media, "consensus", lambda *x: alone.append(1) or 0)
    links = media._meet(True)(table)
    assert groups((x - 1000, y - 1000) for x, y in zip(links["src"].to_pylist(), links["dst"].to_pylist(), strict=True)) == groups(agree)
    assert 5 < len(agree) < 100 and not alone


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, "").collect(), now.schema)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert stage_last(corpus_pipeline, spark, now) == now.count() > 0


def stage_last(module, spark, now):
    return module.STAGES[-1][1](spark, now, "").count()


def shingles_of(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_simhash_proposes_near_copies_and_all_it_joins_are_alike(spark):
    r = random.Random(31)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(150)) for _ in range(60)]
    copies = [t.replace(t.split()[40], "other", 1) for t in texts[:40]]
    frame = spark.createDataFrame([(t,) for t in [*texts, *copies, *texts[:9], "", None]], "text string").repartition(3)
    names = {t: jaccard._name(s) for t, s in zip([*texts, *copies], jaccard.shingle_sets(pa.array([*texts, *copies])), strict=True)}
    rows = jaccard.by_simhash(frame).collect()
    root = {x.shingles: x.root for x in rows}
    assert len(root) == len(rows)
    assert sum(names[t] in root and root.get(names[c]) == root[names[t]] for t, c in zip(texts, copies, strict=False)) >= 36
    of = {names[t]: t for t in names}
    assert all(alike(shingles_of(of[a]), shingles_of(of[b])) for a, b in root.items())


def test_proposing_tables_lose_no_pair_of_small_buckets(spark):
    r = random.Random(32)
    fps = [r.getrandbits(64) for _ in range(300)]
    near = [f ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, jaccard.RADIUS + 1))) for f in fps]
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps + near], "fp long")
    links = {frozenset((x.src, x.dst)) for x in simhash.near_links(frame, simhash.covering_masks(jaccard.RADIUS), jaccard.RADIUS).collect()}
    assert {frozenset((simhash._signed(a), simhash._signed(b))) for a, b in zip(fps, near, strict=True)} <= links
    assert all(bin((min(x) ^ max(x)) & (1 << 64) - 1).count("1") <= jaccard.RADIUS for x in links)


def test_jaccard_finds_every_planted_near_copy(spark):
    import corpus_pipeline
    from tidewater.llm import jaccard

    r = random.Random(8)
    common = " ".join(f"c{i}" for i in range(40))
    texts = []
    for k in range(40):
        w = [f"w{r.randrange(400)}" for _ in range(r.choice((3, 7, 12, 60, 300)))]
        texts.append(" ".join(w))
        for _ in range(r.randrange(6)):
            w = list(w)
            for _ in range(r.randrange(1, 1 + max(1, len(w) // 60) * 2)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(w) + (" " + common if k % 5 == 0 else ""))
    texts += [texts[0].upper(), None, "", "one", "One"]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    sets = [shingles_of(t) for t in texts]
    want = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    assert len(set(want.values())) < len(rows) - 20
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {x.doc_id: x.component for x in jaccard.near_duplicates(frame).collect()}
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got)
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, frame, "").collect()} == set(want.values())
    assert jaccard.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most, parts", [(10**6, 10_000), (2500, 4), (900, 4)])
def test_jaccard_settles_one_large_family(spark, monkeypatch, most, parts):
    """Edited copies of one text, in many components: by one task, and in blocks with common shingles spread."""
    from tidewater.llm import jaccard

    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            w[r.randrange(60)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"s{k}x{i}" for i in range(30)) for k in range(40)] + texts[:20] + ["", None]
    sets = [shingles_of(t) for t in texts]
    want = components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    assert len(set(want[i] for i in range(150))) > 10
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    census = frame.select("text").mapInArrow(jaccard._census(4), "kind int, key long, n long")
    assert jaccard.common(census, 4).count() > 20
    blocks, whole = [], jaccard.settle_large
    monkeypatch.setattr(jaccard, "settle_large", lambda members, most: blocks.append(members.count()) or whole(members, most))
    got = {x.doc_id: x.component for x in jaccard.near_duplicates(frame, most=most, parts=parts).collect()}
    assert len(blocks) == (most < 10**6) and all(n > 100 for n in blocks)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got)


def test_joined_equals_all_pairs():
    from tidewater.llm import jaccard

    r = np.random.default_rng(3)
    for _ in range(60):
        base = r.integers(1, 10**9, 40)
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(20, 40), replace=False), r.integers(1, 10**9, r.integers(1, 6))])).astype(np.uint64) for _ in range(25)]
        given = r.integers(0, 25, 25) if r.integers(2) else np.arange(25)
        first = np.array([int(np.flatnonzero(given == g)[0]) for g in given])
        links = [(i, int(first[i])) for i in range(25)] + [(i, j) for i in range(25) for j in range(i) if jaccard.near(sets[i], sets[j])]
        want, got = components(range(25), links), jaccard.joined(sets, first)
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(25) for j in range(25))


@pytest.mark.parametrize(
    "text, part",
    [
        ("write to john [at] example.com now", "john [at] example.com"),
        ("mail john (at) example.com", "john (at) example.com"),
        ("so jane [dot] doe [at] example [dot] com it is", "jane [dot] doe [at] example [dot] com"),
        ("so jane(dot)x.doe(at)example.com it is", "jane(dot)x.doe(at)example.com"),
        ("ask ann dot b dot lee at example dot com", "ann dot b dot lee at example dot com"),
        ("at this point jane at example dot com", "jane at example dot com"),
        ("mail jane at example dot museum please", "jane at example dot museum"),
        ("JOHN AT EXAMPLE DOT ORG, thanks", "JOHN AT EXAMPLE DOT ORG"),
        ("escribe a ana arroba ejemplo punto es hoy", "ana arroba ejemplo punto es"),
        ("to j.smith [at] gmail.com", "j.smith [at] gmail.com"),
        ("to j.smith AT gmail dot com", "j.smith AT gmail dot com"),
        ("to jane dot doe at example dot com", "jane dot doe at example dot com"),
    ],
)
def test_disguised_at_needs_no_other_cue(text, part):
    at = text.index(part)
    assert pii.find_spans(text) == [("email", at, at + len(part))]


def test_one_row_of_every_group_stays_whatever_its_id(spark):
    import corpus_pipeline

    def text(k):
        return " ".join(f"t{k}x{i}" for i in range(30))

    rows = [(1, text(0), "en", "a", 1), (1, text(1), "en", "a", 1), (2, text(1), "en", "a", 1), (3, text(2), "fr", "b", 2), (3, text(2), "en", "b", 2)]
    rows += [(None, text(3), "en", "a", 1)] * 3 + [(None, text(2), "en", "a", 1), (None, text(4), "de", "c", 1), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    want = [(1, text(0), "en", "a", 1), (1, text(1), "en", "a", 1), (3, text(2), "en", "b", 2), (None, text(3), "en", "a", 1), (None, text(4), "de", "c", 1), (None, None, None, None, None)]
    assert Counter(map(tuple, out)) == Counter(want)


def test_language_of_many_copies_keeps_its_sample(spark):
    for seed in range(4):
        rows = [("xx", f"only {'abcdefghij'[k]} text {'klmnopqrst'[seed]}") for k in range(5)] * 1500 + [("yy", "plain")]
        samples = langid.fit_samples(spark.createDataFrame(rows, "lang string, text string").repartition(4))
        assert all(f"only {c} text {'klmnopqrst'[seed]}" in samples["xx"] for c in "abcde") and samples["yy"].startswith("plain")


def scripts(seed, first, n_words, texts=1, length=4000):
    """Texts of two-letter words from 1,500 characters from `first` on."""
    r = random.Random(seed)
    words = [chr(first + r.randrange(1500)) + chr(first + r.randrange(1500)) for _ in range(n_words)]
    return ["".join(r.choice(words) for _ in range(length // 2)) for _ in range(texts)]


def test_language_id_tells_large_scripts_apart():
    made = {"zh": scripts(1, 0x4E00, 900, 21), "zi": scripts(2, 0x4E00, 900, 21), "ko": scripts(3, 0xAC00, 900, 21), "en": ["plain words of a small alphabet " * 100] * 21}
    m = langid.Model({g: t[0] for g, t in made.items()})
    texts = [(g, x[:60]) for g, ts in made.items() for x in ts[1:]]
    got, _ = m.predict([x for _, x in texts])
    assert sum(a == g for a, (g, _) in zip(got, texts, strict=True)) >= 0.95 * len(texts)


def test_sparse_steps_parse_greedily(monkeypatch):
    r = random.Random(4)
    text, query = ("".join(r.choice("abcdefgh") for _ in range(n)) for n in (300, 200))
    query += "zz" + text[5:20]
    whole = langid.Model({"x": text, "y": text[::-1]})
    monkeypatch.setattr(langid, "SYMBOLS", 4)
    cut = langid.Model({"x": text, "y": text[::-1]})
    assert (cut.phrases([cut.codes(langid.fold(query))]) == whole.phrases([whole.codes(langid.fold(query))])).all()


def test_a_small_crop_of_a_large_picture_is_confirmed(monkeypatch):
    r = np.random.RandomState(6)
    big = media.resize((r.rand(60, 60) * 200 + 20).astype(np.float32), 480, 480)
    big[240:] = media.resize((r.rand(60, 120) * 60 + 90).astype(np.float32), 240, 480)  # of less contrast
    crop = big[300:400, 300:400]
    whole, part = media.describe(big), media.describe(crop)
    n = media.consensus(*part, *whole)
    assert n >= media.INLIERS
    monkeypatch.setattr(media, "AT_ONCE", 1 << 18)
    assert media.consensus(*part, *whole) == n
