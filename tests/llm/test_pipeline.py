"""run() against a version that compares everything with everything, in plain Python."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tidewater.llm import bpe, mixing, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rejected(t):
    w = WORD.findall(t or "")
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 5]) for i in range(n - 4)]
    times = Counter(wins)
    inside = {j for i, x in enumerate(wins) if times[x] > 1 for j in range(i, i + 5)}
    return (
        n < 10 or 100 * len(inside) > 20 * n or 100 * sum((t or "").count(c) for c in "#*$%&|<>") > 30 * n or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        or 100 * sum("A" <= c <= "Z" for c in t) > 40 * chars or 100 * t.count("!") > 50 * n or chars > 20 * n or 2 * chars < 3 * n
    )


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def one_of_each(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


HIDDEN = {"mail a.b@c.dd now": "mail <email> now", "at 10.2.3.4 ok": "at <ip> ok", "ann [at] site.org wrote": "<email> wrote", "call +1 415 555 0123 please": "call <phone> please"}


def mixed(rows):
    """Sizes differ within a source, so the order of rounding is known."""
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    size = {s: sum(len(WORD.findall(r[1])) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, target, free = sum(size.values()), {}, set(sources)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} or {s: weight[s] * level for s in free}
        free = free - over if over else set()
    out = []
    for s in sources:
        rate, error = target[s] / size[s], 0.0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: -len(WORD.findall(r[1]))):
            n = len(WORD.findall(r[1]))
            error += rate * n
            low = int(rate + 1e-9)
            c = min(low + (rate - low > 1e-9), max(low, int(error / n + 0.5)))
            error -= c * n
            out += [r] * c
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    out, size = [], 30
    for i in range(45):
        size += 2
        words = [r.choice("abcdefghij") + f"{r.randrange(10**5)}" for _ in range(size)]
        hidden = r.choice([None, *HIDDEN])
        out.append((i, " ".join(words) + (f" {hidden}" if hidden else ""), "en", ["a", "b", "c", "d", None][i % 5], 1))
    for i in (25, 31, 38):  # near copies: one word of many differs; exact ones; one without an id
        w = out[i][1].split()
        w[4] = "other"
        out.append((100 + i, " ".join(w), "en", out[i][3], 1))
        out.append((200 + i, out[i][1], "fr", out[i][3], 1))
    out.append((None, out[25][1], "en", "a", 1))
    out += [(300, "too short", "en", "a", 1), (301, "", "en", "a", 1), (302, None, None, None, None), (303, "SHOUTED WORDS " * 9, "en", "a", 1), (304, "same line here\n" * 12, "en", "b", 1)]
    return out


def test_run_equals_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if r[1] and not rejected(r[1])]
    kept = one_of_each(kept)
    for shown, gone in HIDDEN.items():
        kept = [(r[0], r[1].replace(shown, gone), *r[2:]) for r in kept]
    sizes = [(r[3], len(WORD.findall(r[1]))) for r in kept]
    assert len(set(sizes)) == len(sizes) < len(rows) - 8  # no ties in a source
    ranks = bpe.encoder(corpus_pipeline.VOCABULARY, public_tokenizers.PATTERN).vocabulary.ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in mixed(kept):
        ids = own.encode_ordinary(r[1])
        want[r[0], r[3], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest(), tuple(ids)] += 1
    got = Counter((x.doc_id, x.source, x.n_tokens, x.ids_sha256, x.decoded_sha256, tuple(x.token_ids)) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_stages_of_empty_tables_are_empty(spark):
    now = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == 0


def broadcasts(df):
    """The plans of what df's joins broadcast."""
    found, left = [], [df._jdf.queryExecution().sparkPlan()]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() == "BroadcastHashJoinExec":
            found.append((node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).toString())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_no_exploded_table_is_broadcast(spark, tmp_path, monkeypatch):
    """Spark counts a row for each that explode() is given, so it takes 63 tables of many fingerprints for a small one."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    spark.range(1000).selectExpr("xxhash64(id) AS fp").write.parquet(str(tmp_path / "prints"))
    links = simhash.near_links(spark.read.parquet(str(tmp_path / "prints")), simhash.covering_masks(5), 5)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    docs = spark.createDataFrame([(i, "a b c", "en", f"s{i % 5}", 5) for i in range(20)], SCHEMA)
    mixed = mixing.mix(mixing.with_size(docs))
    assert not [p for df in (links, mixed) for p in broadcasts(df) if "Generate explode" in p]
    assert mixed.count() == 20
