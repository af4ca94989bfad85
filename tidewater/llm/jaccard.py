"""Near-duplicates by SimHash and the exact Jaccard similarity of word shingles; the pipeline's stage.

Two texts are linked if the sets of their lower-cased five-word shingles overlap by NEAR of their union or more. Sets are held as
64-bit rolling hashes, and equal sets are one. SimHash proposes first (by_simhash()): sets whose fingerprints, of PRINT-word
shingles, lie within RADIUS bits by covering tables are one group, and each group is settled exactly, as a family is below. What
no affordable radius reaches is found by the sets themselves, so that no pair is missed, whatever the texts:

- In any one order of all shingles, sets that share o of n shingles share the k least of those within their first n - o + k.
  So each set sends its first n - ceil(0.6 n) + 1 shingles by hash, and must find ceil(0.8 n) - ceil(0.6 n) + 1 of them elsewhere,
  or it has no near copy and is done with.
- Of the shingles found elsewhere the rarest come first; again only as many as any near copy must share one of meet in buckets,
  and a bucket's sets point at its least one. Components of those links are families; a near pair is always within one.
- A family that SimHash has joined wholly is done. Another is settled exactly, from what SimHash has joined on: in one task up to MOST shingles; a larger one in blocks (settle_large()), never in one task.

A shingle of very many sets (common()) is no bucket: it is ordered after all others, and its sets, spread over tasks, are linked
through a node of its own. A text of fewer words than a shingle is one shingle; texts without a word are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .storage import materialise, shuffle_partitions
from .words import WORD_BASE, Words, rolling, slices

SHINGLE, NEAR, LESS = 5, (4, 5), (3, 5)
#: Words of a shingle of the fingerprints (they lie nearer for short ones); bits that differ at most, for 2 ** (RADIUS + 1) - 1 tables.
PRINT, RADIUS = 2, 5
#: Rows up to which a table of a few numbers a row is broadcast; contents that a task remembers.
FEW, SEEN = 1_000_000, 1_000_000
#: Shingles, over all sets of a family, up to which one task settles it, and about which a block of a larger one has.
MOST = 1_000_000
#: A shingle is common from this part of all sets on, or from the part that a shuffle partition has, if that is more.
PARTS = 10_000


def _ceil(n, part: tuple[int, int]):
    return -(-n * part[0] // part[1])


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    w = Words(pc.ascii_lower(column))
    h = w.hashes()
    every = rolling(h, w.windows(shingle), shingle, WORD_BASE)
    ends = np.cumsum(np.maximum(w.count - shingle + 1, 0))
    out = [np.unique(x) for x in np.split(every, ends[:-1])] if len(ends) else []
    for size in range(1, shingle):
        at = np.flatnonzero(w.count == size)
        for i, x in zip(at, rolling(h, w.first[at], size, WORD_BASE), strict=True):
            out[i] = np.array([x], np.uint64)
    return out


def _name(found: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(found.tobytes())
    return x - (1 << 64) if x >> 63 else x


def _sets(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    for batch in batches:
        for i, j in slices(batch.column(at)):
            part = batch.slice(i, j - i)
            sets = shingle_sets(part.column(at))
            yield part, sets, [_name(s) for s in sets]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, names in _sets(batches, 2):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.int64())], ["doc_id", "text_hash", "shingles"])


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Sets that the task has not lately met."""
    seen: set[int] = set()
    for _, sets, names in _sets(batches, 0):
        new = {}
        for name, s in zip(names, sets, strict=True):
            if name not in seen and len(s):
                seen.add(name)
                new[name] = s
        if len(seen) > SEEN:
            seen.clear()
        yield list(new), list(new.values())


def _first(s: np.ndarray) -> np.ndarray:
    return s[: len(s) - _ceil(len(s), LESS) + 1]


def _census(parts: int):
    """kind 0: a set and its number of shingles. kind 1: a shingle that stands, of a slice's sets, in two and in a parts-th or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in _fresh(batches):
            if not names:
                continue
            token, many = np.unique(np.concatenate([_first(s) for s in sets]), return_counts=True)
            often = many >= max(2, -(-len(sets) // parts))
            kind = np.repeat(np.array([0, 1], np.int32), [len(names), int(often.sum())])
            key = np.concatenate([np.array(names, np.int64), token[often].view(np.int64)])
            n = np.concatenate([np.array([len(s) for s in sets], np.int64), many[often]])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(n)], ["kind", "key", "n"])

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, sets in _fresh(batches):
        firsts = [_first(s) for s in sets]
        many = [len(x) for x in firsts]
        token = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(token.view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), many)), pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), many))], ["token", "shingles", "n"]
        )


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, fp, n) of sets that the task has not lately met."""
    seen: set[int] = set()
    for part, sets, names in _sets(batches, 0):
        new = {}
        for i, (name, s) in enumerate(zip(names, sets, strict=True)):
            if name not in seen and len(s):
                seen.add(name)
                new[name] = (simhash.simhash(part.column(0)[i].as_buffer().to_pybytes(), PRINT), len(s))
        if len(seen) > SEEN:
            seen.clear()
        fp = np.array([f for f, _ in new.values()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(new.keys(), pa.int64()), pa.array(fp), pa.array([n for _, n in new.values()], pa.int64())], ["name", "fp", "n"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, sets in _fresh(batches):
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["shingles", "tokens"])


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """All of a partition."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
    return [np.concatenate(c) for c in zip(*held, strict=True)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _batches(names: list[str], *columns: np.ndarray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most]) for c in columns], names)


COMMON = np.iinfo(np.int64).max


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, shingles, n), all rows of a token together: the tokens of two sets or more, with their number of sets. Rows of
    common tokens have n below zero and may be anywhere; their number counts as the largest there is."""
    if not (held := _columns(batches)):
        return
    order = np.lexsort((held[1], held[0]))
    token, name, n = (c[order] for c in held)
    once = _starts(token, name)
    token, name, n = token[once], name[once], n[once]
    many = np.diff(np.append(_starts(token), len(token)))
    many = np.repeat(many, many)
    many[n < 0] = COMMON
    more = many > 1
    yield from _batches(["shingles", "n", "token", "many"], name[more], np.abs(n[more]), token[more], many[more])


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of what _shared() found, all rows of a set together: (token, shingles, common) of the rarest, if the set has enough of them."""
    if not (held := _columns(batches)):
        return
    order = np.lexsort((held[2], held[3], held[0]))
    name, n, token = (held[i][order] for i in range(3))
    start = _starts(name)
    count = np.diff(np.append(start, len(name)))
    place = np.arange(len(name)) - np.repeat(start, count)
    least = _ceil(n.astype(np.int64), NEAR) - _ceil(n.astype(np.int64), LESS) + 1
    kept = place <= np.repeat(count, count) - least
    yield from _batches(["token", "shingles", "common"], token[kept], name[kept], held[3][order][kept] == COMMON)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, shingles, common), all rows of a token that isn't common together: links of its sets to the least. Sets of a
    common token are linked to it."""
    if not (held := _columns(batches)):
        return
    order = np.lexsort((held[1], held[0]))
    token, name, common = (c[order] for c in held)
    yield from _batches(["src", "dst"], name[common], token[common])
    token, name = token[~common], name[~common]
    if not len(token):
        return
    start = _starts(token)
    to = np.repeat(name[start], np.diff(np.append(start, len(token))))
    apart = np.unique(np.column_stack([name, to])[name != to], axis=0)
    yield from _batches(["src", "dst"], apart[:, 0].copy(), apart[:, 1].copy())


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR[1] >= NEAR[0] * (len(a) + len(b) - both)


def joined(sets: list[np.ndarray], root: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of one member of its component; pairs that no near pair can be, or that are joined already (root: an
    index for each set, equal for those known to be joined), are not compared."""
    sizes = np.array([len(s) for s in sets])
    token, many = np.unique(np.concatenate(sets), return_counts=True)
    firsts = []
    for s in sets:
        at = np.searchsorted(token, s)
        firsts.append(at[np.argsort(many[at], kind="stable")][: len(s) - _ceil(len(s), NEAR) + 1])
    width = np.bincount(np.concatenate(firsts), minlength=len(token))
    start, filled = np.cumsum(width) - width, np.zeros(len(token), np.int64)
    bucket = np.empty(int(width.sum()), np.int64)
    root = np.arange(len(sets)) if root is None else root.copy()
    met = np.zeros(len(sets), bool)
    for i in np.argsort(sizes, kind="stable"):
        s, first = sets[i], firsts[i]
        met[:] = False
        for x, y in zip(start[first].tolist(), filled[first].tolist(), strict=True):
            met[bucket[x : x + y]] = True
        left = np.flatnonzero(met & (root != root[i]) & (sizes * NEAR[1] >= sizes[i] * NEAR[0]))
        while len(left := left[root[left] != root[i]]):
            j, left = left[-1], left[:-1]
            if near(sets[j], s):
                root[root == root[i]] = root[j]
        bucket[start[first] + filled[first]] = i
        filled[first] += 1
    return root


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    names, at = np.unique(table.column("shingles").to_numpy(), return_index=True)
    tokens = table.column("tokens")
    return names, at, [np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in at]


def _settle(table: pa.Table) -> pa.Table:
    """root: of those already joined, if known."""
    names, at, sets = _distinct(table)
    known = None
    if "root" in table.column_names:
        _, first, which = np.unique(table.column("root").to_numpy()[at], return_index=True, return_inverse=True)
        known = first[which]
    return pa.table({"shingles": names, "root": names[joined(sets, known)]})


def _settle_more(table: pa.Table) -> pa.Table:
    """Links between the roots, as known, of sets that turn out to be joined."""
    names, at, sets = _distinct(table)
    known, first, which = np.unique(table.column("root").to_numpy()[at], return_index=True, return_inverse=True)
    now = joined(sets, first[which])
    links = np.unique(np.column_stack([known, known[which[now[first]]]]), axis=0)
    links = links[links[:, 0] != links[:, 1]]
    return pa.table({"src": links[:, 0].copy(), "dst": links[:, 1].copy()})


def _relabelled(labels: DataFrame, groups: DataFrame, tag: str) -> DataFrame:
    """labels (family, block, shingles, n, root) after joining what groups() of sets show to be joined."""
    links = materialise(groups.applyInArrow(_settle_more, "src long, dst long").distinct(), tag)
    up = connected_components(links).toDF("root", "up")
    return materialise(labels.join(up, "root", "left").select("family", "block", "shingles", "n", F.coalesce("up", "root").alias("root")), tag)


def settle_large(members: DataFrame, most: int) -> DataFrame:
    """(shingles, root) of families that are too large for a task; members: (family, shingles, n, tokens), one row a set.

    A family is dealt into blocks of about `most` shingles, and every group below is one task, of one block or two:
    each block by itself; block 0 with each other one, which joins nearly all of a group of copies; then the sets that are not of
    the family's largest component, dealt alike, with each block. All pairs of different components are then settled. In a family
    of many components the last step is quadratic in blocks (not in sets).
    """
    weight = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(most)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("shingles"), "blocks").cast("int")
    dealt = materialise(members.join(weight, "family").withColumn("block", block), "jaccard-large")
    root = dealt.groupBy("family", "block").applyInArrow(_settle, "shingles long, root long")
    labels = materialise(dealt.select("family", "block", "shingles", "n").join(root, "shingles"), "jaccard-roots")

    now = dealt.join(labels.select("shingles", "root"), "shingles").select("family", "block", "blocks", "shingles", "n", "tokens", "root")
    others = F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))
    pairs = now.where("block > 0").withColumn("with", F.col("block")).unionByName(now.where("block = 0 and blocks > 1").withColumn("with", others))
    labels = _relabelled(labels, pairs.groupBy("family", "with"), "jaccard-first")

    sums = labels.groupBy("family", "root").agg(F.sum("n").alias("n"))
    largest = sums.groupBy("family").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    rest = largest.where("all > m.n").select("family", F.col("m.root").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / F.lit(most)).cast("int").alias("lots"))
    now = dealt.join(labels.select("shingles", "root"), "shingles").join(rest, "family")
    now = now.select("family", "block", "blocks", "shingles", "tokens", "root", "main", "lots")
    lot = F.pmod(F.xxhash64("shingles", F.lit("lot")), "lots").cast("int")
    every = now.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    asked = now.where("root <> main").withColumn("lot", lot).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    labels = _relabelled(labels, every.unionByName(asked).groupBy("family", "block", "lot"), "jaccard-last")
    return labels.select("shingles", "root")


def common(census: DataFrame, parts: int) -> DataFrame:
    """Tokens of a parts-th of all sets or more, as counted where they are frequent: every token of twice that part, and of one set
    more for each slice of texts, is among them."""
    sets = census.where("kind = 0").count()
    return census.where("kind = 1").groupBy(F.col("key").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") * parts >= sets).select("token", F.lit(-1).alias("sign"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _settled(texts: DataFrame, families: DataFrame, most: int) -> DataFrame:
    """(shingles, root) of the sets of families (shingles, n, family, and root if some are known to be joined)."""
    large = materialise(families.groupBy("family").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("family"), "jaccard-large-families")
    whole = texts.mapInArrow(_whole, "shingles long, tokens binary")
    if large.isEmpty():
        return whole.join(_small(families.drop("n")), "shingles").groupBy("family").applyInArrow(_settle, "shingles long, root long")
    large = _small(large)
    small = whole.join(_small(families.join(large, "family", "left_anti").drop("n")), "shingles")
    members = whole.join(_small(families.join(large, "family")), "shingles").groupBy("shingles").agg(*(F.first(c).alias(c) for c in ("family", "n", "tokens")))
    return small.groupBy("family").applyInArrow(_settle, "shingles long, root long").unionByName(settle_large(members, most))


def by_simhash(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(shingles, root) of the sets that SimHash proposes: of each group, those that the exact check joins have one root. A group
    of more than `most` shingles is dealt into blocks, each checked by itself: what lies across them is left to components()."""
    prints = materialise(texts.mapInArrow(_prints, "name long, fp long, n long"), "jaccard-prints")
    sizes = prints.groupBy("name").agg(F.max("n").alias("n"))
    groups = materialise(simhash.groups(prints.select("name", "fp"), RADIUS).join(sizes, "name"), "jaccard-groups")
    blocks = groups.groupBy("group").agg(F.ceil(F.sum("n") / F.lit(most)).alias("blocks"))
    family = F.xxhash64("group", F.pmod(F.xxhash64("name"), "blocks"))
    dealt = materialise(groups.join(blocks, "group").select(F.col("name").alias("shingles"), family.alias("family")), "jaccard-proposed")
    whole = texts.mapInArrow(_whole, "shingles long, tokens binary")
    return materialise(whole.join(_small(dealt), "shingles").groupBy("family").applyInArrow(_settle, "shingles long, root long"), "jaccard-simhash")


def components(texts: DataFrame, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(shingles, root) for the sets of texts (one column) that may have near copies; any other is a component of its own."""
    parts = min(parts, shuffle_partitions(texts.sparkSession))
    known = by_simhash(texts, most)
    census = materialise(texts.mapInArrow(_census(parts), "kind int, key long, n long"), "jaccard-census")
    often = _small(materialise(common(census, parts), "jaccard-common"))
    held = texts.mapInArrow(_firsts, "token long, shingles long, n int").join(often, "token", "left")
    held = held.select("token", "shingles", (F.col("n") * F.coalesce("sign", F.lit(1))).alias("n"))
    held = held.repartition(F.when(F.col("n") < 0, F.xxhash64("token", "shingles")).otherwise(F.col("token")))
    shared = held.mapInArrow(_shared, "shingles long, n int, token long, many long").repartition("shingles")
    rarest = shared.mapInArrow(_rarest, "token long, shingles long, common boolean")
    rarest = rarest.repartition(F.when(F.col("common"), F.xxhash64("token", "shingles")).otherwise(F.col("token")))
    links = materialise(rarest.mapInArrow(_stars, "src long, dst long").distinct(), "jaccard-links")
    families = connected_components(links).toDF("shingles", "family")
    sets = census.where("kind = 0").groupBy(F.col("key").alias("shingles")).agg(F.max("n").alias("n"))
    families = materialise(sets.join(families, "shingles"), "jaccard-families")
    families = materialise(families.join(known, "shingles", "left").select("shingles", "n", "family", F.coalesce("root", "shingles").alias("root")), "jaccard-known")
    apart = families.groupBy("family").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("family")
    rest = materialise(_settled(texts, families.join(apart, "family"), most), "jaccard-rest")
    return rest.unionByName(known.join(rest, "shingles", "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(doc_id, text_hash, component) for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    marked = rows.mapInArrow(_marks, "doc_id long, text_hash long, shingles long")
    rooted = components(docs.select(F.col(text_col).alias("text")), most, parts)
    return marked.join(rooted, "shingles", "left").select("doc_id", "text_hash", F.coalesce("root", "shingles").alias("component"))


def text_hash(text_col: str = "text"):
    return F.xxhash64(F.lit("text"), F.col(text_col))
