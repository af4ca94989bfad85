"""Op 8. Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily against each
automaton: a phrase is the longest match from where the last one ended, and a character that extends no match ends it. The
language needing the fewest normalised phrases (phrases times the bits that address one, per character) wins; the score is one
minus the winner's share of the runner-up's. Ties go to the language first by name.

The sample: of each of the LANGUAGES languages with most distinct texts, at most DOCS distinct training texts, chosen by a hash, of
each at most PER_DOC characters, SAMPLE in all; a documented bound of the fit, so what is broadcast never grows with the corpus.
Every character of the samples is a symbol. Prediction reads whole texts. For speed a text is cut into lanes of LANE characters
which are walked side by side through the automata's tables; then each lane is walked again from where the one before really
ended, until both walks agree (a few characters on), so the parse is that of the uncut text.

Texts are folded before: lower case, letters kept, any other run a single space. A null text or one without a letter is `und` with
score 0. No learned language: `und`. Repeated rows are predicted alike, empty tables give empty results, other columns are
carried along except that one named like a result (in whatever case) gives way. Of a very long text BLOCK characters are walked at
a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import carried
from .words import slices

DOCS, PER_DOC, SAMPLE, LANGUAGES, LANE, BLOCK = 256, 400, 24_000, 400, 2048, 1 << 21
UNKNOWN = "und"
#: Columns of a dense table. Languages that together have more characters get tables of their own for the commonest of each;
#: the steps over its other characters are searched for.
SYMBOLS = 96


class SuffixAutomaton:
    """The smallest automaton of all substrings of a sequence of symbols (its states are all accepting)."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in symbols:
            now = len(self.next)
            self.next.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if size[p] + 1 == size[q]:
                    link[now] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now

    def table(self, n_symbols: int, column: dict[int, int] | None = None) -> np.ndarray:
        """Rows of states: next state times two for each symbol, plus one where a phrase ends and the next one starts. The last
        row stands behind a symbol never seen, which is a phrase of its own. column: of the symbols to hold, if not all."""
        behind = len(self.next)
        held = self.next if column is None else [{column[c]: to for c, to in edges.items() if c in column} for edges in self.next]
        root = np.full(n_symbols, behind, np.int32)
        for c, to in held[0].items():
            root[c] = to
        out = np.tile(root * 2 + 1, (behind + 1, 1))
        for s, edges in enumerate(held):
            if edges:
                out[s, list(edges)] = 2 * np.fromiter(edges.values(), np.int32, len(edges))
        out[0] &= ~1  # only stood in before the first symbol
        return out


class Sparse:
    """The steps of an automaton over the symbols that its dense table leaves out."""

    def __init__(self, automaton: SuffixAutomaton, column: dict[int, int], n_symbols: int):
        self.n_symbols = n_symbols
        self.column = np.full(n_symbols, len(column), np.int64)  # the last column is a symbol never seen
        for c, k in column.items():
            self.column[c] = k
        steps = sorted((s * n_symbols + c, 2 * to) for s, edges in enumerate(automaton.next) for c, to in edges.items() if c not in column)
        self.keys = np.array([k for k, _ in steps], np.int64)
        self.to = np.array([to for _, to in steps], np.int32)
        self.afresh = np.zeros(n_symbols, np.int32)  # where a phrase that starts with the symbol stands; zero: not one of these
        for c, to in automaton.next[0].items():
            if c not in column:
                self.afresh[c] = 2 * to + 1

    def step(self, to: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> None:
        """Put right what the dense table said of these symbols."""
        at = np.flatnonzero(self.afresh[symbol])
        if len(at):
            key = state[at].astype(np.int64) * self.n_symbols + symbol[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[at] = np.where(self.keys[place] == key, self.to[place], self.afresh[symbol[at]])


class Model:
    """samples: folded training text of each language, never empty."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        counts: dict[str, int] = {}
        for text in samples.values():
            for c in text:
                counts[c] = counts.get(c, 0) + 1
        every = sorted(counts, key=lambda c: (-counts[c], c))
        self.symbol = {c: i for i, c in enumerate(every)}
        self.other = len(every)  # a character of no sample
        self.tables: list[np.ndarray] = []
        self.sparse: list[Sparse | None] = []
        for g in self.languages:
            symbols = [self.symbol[c] for c in samples[g]]
            automaton = SuffixAutomaton(symbols)
            if self.other < SYMBOLS:
                self.tables.append(automaton.table(self.other + 1))
                self.sparse.append(None)
                continue
            column = {c: k for k, (c, _) in enumerate(Counter(symbols).most_common(SYMBOLS - 1))}
            self.tables.append(automaton.table(len(column) + 1, column))
            self.sparse.append(Sparse(automaton, column, self.other + 1))
        self.bits = np.array([np.log2(len(samples[g]) + 1) for g in self.languages])
        points = np.full(0x110000, -1, np.int32)
        self._points = points

    def codes(self, folded: np.ndarray) -> np.ndarray:
        """Symbols of folded code points."""
        lookup = self._points
        if lookup[32] == -1:
            lookup[:] = self.other
            for c, i in self.symbol.items():
                lookup[ord(c)] = i
        return lookup[folded]

    def _step(self, g: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next state times two, plus one where a phrase ends, for states and symbols side by side."""
        table, sparse = self.tables[g], self.sparse[g]
        to = table.ravel()[state * table.shape[1] + (symbol if sparse is None else sparse.column[symbol])]
        if sparse is not None:
            sparse.step(to, state, symbol)
        return to

    def walk(self, g: int, symbols: np.ndarray, edges: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts symbols[edges[i]:edges[i + 1]] from the states start: phrases that end in each, and the states after them."""
        many = -(-np.diff(edges) // LANE)
        owner = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        base = edges[:-1][owner] + nth * LANE
        size = np.minimum(edges[1:][owner] - base, LANE)
        said = np.zeros(len(symbols), np.int32)
        state = np.where(nth == 0, start[owner], 0).astype(np.int32)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # lanes longer than k symbols
        state, at = state[order], base[order]
        for k, n in enumerate(live.tolist()):
            said[at[:n] + k] = to = self._step(g, state[:n], symbols[at[:n] + k])
            state[:n] = to >> 1
        # seams: lanes that a lane precedes start from its end; where such a walk meets the first one, the rest is as it was
        redo = np.flatnonzero(nth > 0)
        while len(redo):
            lane, state, k = redo, said[base[redo] - 1] >> 1, 0
            moved = []
            while len(lane):
                place = base[lane] + k
                to = self._step(g, state, symbols[place])
                apart = to >> 1 != said[place] >> 1
                said[place] = to
                k += 1
                over = apart & (size[lane] == k)
                moved.append(lane[over] + 1)
                lane, state = lane[apart & ~over], (to >> 1)[apart & ~over]
            redo = np.concatenate(moved)
            redo = redo[(redo < len(owner))]
            redo = redo[nth[redo] > 0]
        sums = np.r_[0, np.cumsum(said & 1)]
        end = np.where(np.diff(edges) > 0, said[np.maximum(edges[1:] - 1, 0)] >> 1 if len(said) else 0, start)
        return sums[edges[1:]] - sums[edges[:-1]], end

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (symbols, never empty) against each language."""
        total = np.ones((len(texts), len(self.tables)), np.int64)
        i = 0
        while i < len(texts):
            j, n = i + 1, len(texts[i])
            while j < len(texts) and n + len(texts[j]) <= BLOCK:
                n, j = n + len(texts[j]), j + 1
            for g in range(len(self.tables)):
                state = np.zeros(j - i, np.int32)
                for at in range(0, max(n, 1), BLOCK):  # several blocks only of a text that is alone
                    part = texts[i][at : at + BLOCK] if j == i + 1 else np.concatenate(texts[i:j])
                    edges = np.array([0, len(part)]) if j == i + 1 else np.cumsum([0, *map(len, texts[i:j])])
                    ended, state = self.walk(g, part.astype(np.int64), edges, state)
                    total[i:j, g] += ended
            i = j
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        folded = [fold(t) for t in texts]
        seen = [i for i, f in enumerate(folded) if len(f)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if seen and self.languages:
            cost = self.phrases([self.codes(folded[i]) for i in seen]) * self.bits / np.array([len(folded[i]) for i in seen])[:, None]
            best = np.argmin(cost, 1)
            least = cost[np.arange(len(seen)), best]
            cost[np.arange(len(seen)), best] = np.inf
            second = cost.min(1)
            for i, b, x, y in zip(seen, best, least, second, strict=True):
                langs[i], scores[i] = self.languages[b], float(np.clip(1 - x / y, 0, 1)) if np.isfinite(y) else 1.0
        return langs, scores


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def fold(text: str | None) -> np.ndarray:
    """Code points of the folded text: lower case, each run of other than letters one space; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    if not _LETTER:
        _LETTER.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[0][points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 32).astype(np.uint32)[keep]


def fit_samples(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, str]:
    """The bounded sample: of each language DOCS distinct texts, chosen by hash. Rows are thinned by that hash to a few times DOCS
    texts a language, known from one count of its distinct texts, before any of them meet in a task."""
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("langid"), F.col(text_col)).alias("h")).where("lang is not null and text is not null")
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    learned = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(4.0 * DOCS) / F.col("n"))
    place = F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = rows.join(F.broadcast(learned), "lang").where(place < share)  # LANGUAGES rows at most
    middle = F.expr(f"substring(text, 1 + cast(pmod(h, greatest(1, length(text) - {PER_DOC})) as int), {PER_DOC})")
    pieces = some.select("lang", F.struct("h", middle.alias("piece")).alias("x")).distinct()
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("x.h", "x.piece"))).where(F.col("r") <= DOCS)
    out: dict[str, str] = {}
    for r in ranked.select("lang", "r", "x.piece").orderBy("lang", "r").collect():
        have = out.get(r.lang, "")
        if len(have) < SAMPLE:
            f = fold(r.piece)
            if len(f):
                out[r.lang] = (have + f.tobytes().decode("utf-32-le") + " ")[:SAMPLE]
    return {k: v for k, v in out.items() if v.strip()}


_MODELS: dict[int, Model] = {}


def predict(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs' columns other than text, with lang_pred and score."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(samples)  # at most SAMPLE characters of each of LANGUAGES
    rest = carried(docs, (text_col, "lang_pred", "score"))
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(sent.value.items())))
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(sent.value)
        for batch in batches:
            for i, j in slices(batch.column(len(rest)), 8 << 20):
                part = batch.slice(i, j - i)
                langs, scores = _MODELS[key].predict(part.column(len(rest)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1. A null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learned(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))
