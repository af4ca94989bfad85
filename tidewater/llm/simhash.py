"""Op 9. SimHash near-duplicates by covering locality-sensitive hashing.

Each text has a 64-bit SimHash of its three-word shingles. Covering LSH draws a vector of radius + 1 bits for every bit
position; each of the 2**(radius+1) - 1 nonzero vectors v gives a mask of the positions whose vector has odd overlap with v.
Two fingerprints that differ in at most `radius` positions always have some v even with all of those, so they agree under that
mask: no pair is missed, whatever the draw.

Fingerprints are first made distinct. In a table, a bucket of one is dropped, and in one of SMALL members or fewer they are
compared directly. In larger ones members are compared without listing pairs: at radius 2, two members are linked exactly if they have a common neighbour at one flipped bit, so each member
sends itself and its flips of the bits outside the mask to groups of 65 rows at most, and each group points at its smallest
member. Components come from large-star and small-star rounds over those links.

groups() proposes at a larger radius, for who checks the texts: there a larger bucket's members are compared with its least only,
so pairs of such buckets may be missed.

A null or wordless text has fingerprint zero and is linked like any other. Repeated rows share a fingerprint and a component;
null ids keep their rows and never name a component unless it has no other id. Empty tables give empty results; columns besides
id and text pass by, whatever their names. A very long text is hashed whole, at about 100 bytes a word.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialise
from .words import slices

SHINGLE, RADIUS, SEED, SMALL = 3, 2, 42, 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLANE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[e - len(w) + i : f + i + size - 1], SEED) for i, (e, w, f) in enumerate(zip(ends, words, ends[size - 1 :], strict=False))], np.uint64)
    planes = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLANE).ravel(), minlength=2048).reshape(8, 256)
    ones = (planes @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(batch.column(1), 8 << 20):
            found = np.array([simhash(t) if t else 0 for t in batch.column(1).slice(i, j - i).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the unsigned fingerprint held in a long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """2**(radius+1) - 1 masks such that any `radius` positions are outside one of them; each vector is dealt equally often."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, p in enumerate(vectors) if bin(p & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, masks: list[int] | None = None, radius: int = RADIUS) -> DataFrame:
    """(src, dst) links between distinct fingerprints `fp` at `radius` or fewer differing bits. At radius 2 each pair within that
    distance is joined by a path of such links; at others each that meets in a bucket of SMALL members or fewer is linked."""
    masks = masks or covering_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks)])
    tagged = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.mask", F.col("fp").bitwiseAND(F.col("x.mask")).alias("bucket"))
    shared = tagged.groupBy("t", "bucket").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1").select("t", "bucket", "n", "least")
    every = tagged.hint("merge").join(shared, ["t", "bucket"])  # Spark sizes what explode() makes as what it is given
    few = every.where(F.col("n") <= SMALL).groupBy("t", "bucket").agg(F.collect_list("fp").alias("all"))
    close = F.expr(f"flatten(transform(all, a -> transform(filter(all, b -> b < a AND bit_count(a ^ b) <= {radius}), b -> struct(a AS src, b AS dst))))")
    pairs = few.select(F.explode(close).alias("p")).select("p.src", "p.dst")
    members = every.where(F.col("n") > SMALL)
    if radius != RADIUS:
        led = members.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius).select(F.col("fp").alias("src"), F.col("least").alias("dst"))
        return led.where("src <> dst").unionByName(pairs).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    free = F.filter(flips, lambda f: f.bitwiseAND(F.col("mask")) == 0)
    near = members.select("t", "fp", F.explode(F.transform(free, lambda f: F.col("fp").bitwiseXOR(f))).alias("via"))
    met = near.groupBy("t", "via").agg(F.min("fp").alias("dst"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.explode("all").alias("src"), "dst").where("src <> dst").unionByName(pairs).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of docs."""
    if radius != 2:
        raise ValueError("links inside a bucket are exact at radius 2 only")
    marked = materialise(fingerprints(docs, id_col, text_col), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = materialise(near_links(distinct.select("fp"), covering_masks(radius)), "simhash-links")
    linked = connected_components(links)  # (id, root) of the linked fingerprints only
    discard(links)
    rooted = distinct.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(lookup, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def groups(marked: DataFrame, radius: int) -> DataFrame:
    """(name, group) of the rows (name, fp) whose fingerprint is linked with another row's, or equal to it."""
    marked = materialise(marked.groupBy("name").agg(F.min("fp").alias("fp")), "simhash")
    links = materialise(near_links(marked.select("fp").distinct(), covering_masks(radius), radius), "simhash-links")
    linked = connected_components(links).toDF("fp", "root")
    discard(links)
    rooted = materialise(marked.join(linked, "fp", "left").select("name", F.coalesce("root", "fp").alias("group")), "simhash-groups")
    several = rooted.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return rooted.join(several, "group").select("name", "group")
