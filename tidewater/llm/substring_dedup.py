"""Op 1. Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window is hashed from prefix sums. Two equal windows have the same least hash of an ANCHOR-word shingle at the same place in
them, so a window whose anchor stands nowhere else can't be repeated and is not shuffled. The steps, each linear in the text:

1. Anchors (one in about fourteen words) are counted in Spark; those that stand twice or more go back to their texts.
2. Of each text the windows of such anchors are sent, packed by anchor, to the anchor's partition, opened there and counted by
   their 128-bit hash (two polynomials with different bases, each modulo 2**64 and mixed): of 10**13 windows a false pair is
   expected in one run of millions.
3. Repeated windows go back to their texts as a bit mask an anchor; overlapping ones merge into maximal removal intervals.

A key that very many rows share is settled where it arises: what a task's chunk already holds twice is known to be repeated and is
sent to its own document, and one row stands for it in the count. A text that several rows have repeats all its windows: it is
counted once, as two. Texts that more than a HOT-th of all rows have (so fewer than HOT texts) are broadcast and never shuffled.

A null or empty text has no words. Texts under the window length are left alone. Repeated rows and clashing or null ids are rows
of their own. An empty table gives an empty result; columns besides id and text pass by, whatever their names. Ties don't arise:
windows are judged on the input. A text is held whole in a task, as arrays of about 60 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, shuffle_partitions
from .words import OTHER_BASE, WORD_BASE, Words, rolling, slices

WINDOW, ANCHOR = 35, 8
#: Bytes of text in the chunk of a task that settles its own repeats; share of all rows from which a text is broadcast, and rows.
CHUNK, HOT, HOT_ROWS = 2 << 20, 2000, 1000
TEXT = ["t1", "t2"]


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """Place of the first least value in each run of that many values."""
    place = np.arange(len(values))
    have = 1
    while have < length:
        step = min(have, length - have)
        a, b = place[:-step], place[step:]
        place = np.where(values[a] <= values[b], a, b)
        have += step
    return place


class _Windows:
    """Windows of a chunk of texts: their first words, anchors (place and hash), and runs of windows with one anchor."""

    def __init__(self, column: pa.Array, window: int):
        self.words, self.window = Words(column), window
        self.h = self.words.hashes()
        self.at = self.words.windows(window)
        size = min(ANCHOR, window)
        shingle = rolling(self.h, np.arange(max(len(self.h) - size + 1, 0)), size, WORD_BASE)
        anchor = _least(shingle, window - size + 1)[self.at] if len(self.at) else self.at
        self.doc = np.searchsorted(self.words.first, self.at, "right") - 1
        self.first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (self.doc[1:] != self.doc[:-1])]) if len(anchor) else anchor
        self.length = np.diff(np.r_[self.first, len(self.at)])
        self.anchor = shingle[anchor[self.first]].view(np.int64) if len(anchor) else anchor
        self.owner = self.doc[self.first]

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(rolling(self.h, self.at[which], self.window, b).view(np.int64) for b in (WORD_BASE, OTHER_BASE))


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows share all keys with another row, and which of those stand for them."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    last = np.r_[new[1:], True]
    shared, leads = np.zeros(len(order), bool), np.zeros(len(order), bool)
    shared[order], leads[order] = ~(new & last), new & ~last
    return shared, leads


def _chunks(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows regathered to at most CHUNK bytes of text, a longer text alone."""
    held, n = [], 0
    for batch in batches:
        for i, j in slices(batch.column(at), CHUNK):
            part = batch.slice(i, j - i)
            more = part.column(at).nbytes
            if held and n + more > CHUNK:
                yield from pa.Table.from_batches(held).rename_columns(names).combine_chunks().to_batches()
                held, n = [], 0
            held.append(part)
            n += more
    if held:
        yield from pa.Table.from_batches(held).rename_columns(names).combine_chunks().to_batches()


def _anchors(window: int):
    """(key, anchor, t1, t2, n) of (t1, t2, text); n is 0 where the chunk holds the anchor twice, and 2 where a row stands for those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 2, [*TEXT, "text"]):
            w = _Windows(part.column(2), window)
            t1, t2 = (part.column(i).to_numpy(zero_copy_only=False)[w.owner] for i in range(2))
            shared, leads = _repeats(w.anchor)
            n = np.where(leads, 2, np.where(shared, 0, 1)).astype(np.int32)
            key = np.where(n > 0, w.anchor, t1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, w.anchor, t1, t2, n)], ["key", "anchor", *TEXT, "n"])

    return run


_PACKED = "key long, t1 long, t2 long, start int, known int, weight int, places array<byte>, h1 array<long>, h2 array<long>"


def _send(window: int):
    """Of (t1, t2, text, several, anchors), each text's rows together: one row for each run of windows with one of those anchors.
    known: bits of the windows that the chunk holds twice; places, h1, h2: the windows still to be counted, each `weight` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for part in _chunks(batches, 2, [*TEXT, "text", "several", "anchors", "doc_id"]):
            t1, t2 = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            new = np.r_[(t1[0], t2[0]) != before, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]
            before = t1[-1], t2[-1]
            part = part.filter(pa.array(new))  # a text once, however many rows have it
            if not len(part):
                continue
            t1, t2 = t1[new], t2[new]
            w = _Windows(part.column(2), window)
            several = part.column(3).to_numpy(zero_copy_only=False)
            wanted = part.column(4)
            text = np.repeat(np.arange(len(part)), np.diff(wanted.offsets.to_numpy()))
            kept = _member(w.owner, w.anchor, text, wanted.flatten().to_numpy(zero_copy_only=False))
            runs = np.flatnonzero(kept)
            if not len(runs):
                continue
            many = w.length[runs]
            run_of = np.repeat(np.arange(len(runs)), many)
            place = np.arange(len(run_of)) - np.repeat(np.cumsum(many) - many, many)
            windows = w.first[runs][run_of] + place
            h1, h2 = w.hashes(windows)
            shared, leads = _repeats(h1, h2)
            twice = several[w.owner[runs]]
            counted = leads | ~shared
            known = np.zeros(len(runs), np.int64)
            np.add.at(known, run_of, np.where(shared, 1 << place, 0))
            # a row that stands for its like is sent by itself, to be counted as two
            for weight, chosen in ((1, counted & ~shared & ~twice[run_of]), (2, leads | counted & twice[run_of])):
                yield from _rows(chosen, run_of, place, h1, h2, len(runs), lambda r, weight=weight: (w.anchor[runs[r]], *_names(w, runs[r], t1, t2, twice[r]), np.zeros(len(r), np.int64), weight))
            told = np.flatnonzero((known > 0) & ~twice)
            yield from _rows(np.zeros(len(run_of), bool), run_of, place, h1, h2, len(runs), lambda r: (t1[w.owner[runs[r]]], *_names(w, runs[r], t1, t2, twice[r]), known[r], 0), told)

    return run


def _names(w: _Windows, runs: np.ndarray, t1: np.ndarray, t2: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and first word of the runs; -1 for texts of several rows, which need no answer."""
    owner = w.owner[runs]
    start = w.at[w.first[runs]] - w.words.first[owner]
    return t1[owner], t2[owner], np.where(twice, -1, start).astype(np.int32)


def _rows(chosen, run_of, place, h1, h2, n_runs, named, which=None) -> Iterator[pa.RecordBatch]:
    many = np.bincount(run_of[chosen], minlength=n_runs)
    if which is None:
        which = np.flatnonzero(many)
    if not len(which):
        return
    key, t1, t2, start, known, weight = named(which)
    offsets = pa.array(np.r_[0, np.cumsum(many[which])].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place[chosen].astype(np.int8), h1[chosen], h2[chosen])]
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(x) for x in (key, t1, t2, start, known.astype(np.int32), np.full(len(which), weight, np.int32))), *lists],
        ["key", *TEXT, "start", "known", "weight", "places", "h1", "h2"],
    )


def _member(owner: np.ndarray, anchor: np.ndarray, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which (owner, anchor) are among the (text, wanted)."""
    n = len(owner)
    order = np.lexsort((np.r_[np.ones(n, np.int8), np.zeros(len(text), np.int8)], np.r_[anchor, wanted], np.r_[owner, text]))
    o, a = np.r_[owner, text][order], np.r_[anchor, wanted][order]
    group = np.cumsum(np.r_[True, (o[1:] != o[:-1]) | (a[1:] != a[:-1])]) - 1 if len(order) else order
    asked = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    asked[group[order >= n]] = True
    out = np.zeros(n, bool)
    out[order[order < n]] = asked[group[order < n]]
    return out


def _cut(window: int):
    """The rows of the result from (doc_id, text, several, found)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(texts, CHUNK):
                part = batch.slice(i, j - i)
                n_words, n_removed, spans, kept = [], [], [], []
                for text, several, found in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = (text or b"").split()
                    n_words.append(len(words))
                    if several and len(words) >= window:
                        spans.append([{"start": 0, "end": len(words)}])
                        n_removed.append(len(words))
                        kept.append(b"")
                        continue
                    if not found:
                        n_removed.append(0)
                        spans.append([])
                        kept.append(b" ".join(words))
                        continue
                    start, mask = np.array([f["start"] for f in found], np.int64), np.array([f["mask"] for f in found], np.int64)
                    at = np.unique(np.concatenate([start[mask >> k & 1 > 0] + k for k in range(window)]))
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join(compress(words, (~gone).tolist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
                )

    return cut


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed [word intervals, end exclusive], kept_text) for each row of docs. window: ANCHOR to
    ANCHOR + 30 words."""
    if not ANCHOR <= window <= ANCHOR + 30:
        raise ValueError("the window is too short or too long for its anchors")
    n = shuffle_partitions(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("again"), text).alias("t2"))
    long_enough = F.octet_length("text") >= 2 * window - 1
    counts = rows.where(long_enough).groupBy(*TEXT).agg(F.count("*").alias("n"))
    several = materialise(counts.where("n > 1"), "windows-several")
    hot = several.where(F.col("n") > max(HOT_ROWS, rows.count() // HOT)).select(*TEXT, F.lit(True).alias("several"))  # fewer than HOT rows
    spread = rows.where(long_enough).join(F.broadcast(hot.drop("several")), TEXT, "left_anti").repartition(n, *TEXT)
    rest = rows.where(~F.coalesce(long_enough, F.lit(False)))

    # 1. anchors that stand twice or more
    met = rows.where(long_enough).select(*TEXT, "text").mapInArrow(_anchors(window), "key long, anchor long, t1 long, t2 long, n int").repartition(n, "key")
    total = F.sum("n").over(Window.partitionBy("key", "anchor"))
    wanted = met.withColumn("total", total).where("n = 0 or total > 1").groupBy(*TEXT).agg(F.collect_set("anchor").alias("anchors"))

    # 2. their windows, counted; doc_id only comes along so that the shuffle of the texts is the one that step 3 reads again
    one = rows.where(long_enough).join(F.broadcast(hot), TEXT).groupBy(*TEXT, "several").agg(F.first("text").alias("text"))
    flags = several.select(*TEXT, F.lit(True).alias("several"))
    asked = spread.join(flags, TEXT, "left").join(wanted, TEXT).select(*TEXT, "text", F.coalesce("several", F.lit(False)).alias("several"), "anchors", "doc_id").sortWithinPartitions(*TEXT)
    hot_asked = one.join(wanted, TEXT).select(*TEXT, "text", "several", "anchors", F.lit(None).cast("long").alias("doc_id")).sortWithinPartitions(*TEXT)
    sent = asked.unionByName(hot_asked).mapInArrow(_send(window), _PACKED).repartition(n, "key")
    opened = sent.select("key", *TEXT, "start", "known", "weight", F.explode_outer(F.arrays_zip("places", "h1", "h2")).alias("w"))
    opened = opened.select("key", *TEXT, "start", "known", "weight", F.col("w.places").alias("place"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    times = F.sum("weight").over(Window.partitionBy("key", "h1", "h2"))
    repeated = opened.withColumn("times", F.when(F.col("h1").isNotNull(), times)).where("start >= 0 and (known > 0 or times > 1)")
    bit = F.when(F.col("times") > 1, F.expr("shiftleft(1L, cast(place as int))")).otherwise(0)
    masks = repeated.groupBy("key", *TEXT, "start").agg(F.bit_or(F.col("known").cast("long").bitwiseOR(bit)).alias("mask"))

    # 3. back to the texts
    found = masks.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "mask")).alias("found"))
    none = F.lit(None).cast("array<struct<start:int,mask:long>>")
    judged = spread.join(flags, TEXT, "left").join(found, TEXT, "left").select("doc_id", "text", "several", "found")
    whole = rows.where(long_enough).join(F.broadcast(hot), TEXT).select("doc_id", "text", "several", none.alias("found"))
    short = rest.select("doc_id", "text", F.lit(False).alias("several"), none.alias("found"))
    result = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    return judged.unionByName(whole).unionByName(short).mapInArrow(_cut(window), result)
