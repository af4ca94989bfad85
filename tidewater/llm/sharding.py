"""Op 2. Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a hub are linked (for the query, a hub is a text that several documents have); hubs stand for cliques, so
links stay linear in the documents. Every linked document starts in the shard of its hash. In each round the shards of a hub's
documents are counted, the counts are joined back, and each document asks for the shard, among those with room and its own,
where most of its neighbours are (the cut is the pairs of linked documents in different shards). Requests from shard a to shard b are granted in proportion to what b's quota leaves plus what
both can swap. A hub moves as one unless it is a large part of a shard; then its documents move one by one. Unlinked documents
cut nothing, so they are dealt last and make the sizes come out.

Law `rows`: counts differ by one at most. Numbers within a shard come from counts of hash buckets, at least as many as shuffle
partitions, so no task ever holds a shard. Hubs with more than a HEAVY-th of the linked documents (fewer than HEAVY hubs) are
joined by broadcast, so a flood of copies is on no single key. A null text has size 1 and checksum 0 and is linked to other null
texts. Repeated rows are separate documents, told apart by their place in the input. Very long texts only give their size and
checksums. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, shuffle_partitions

SHARDS, ROUNDS, PER_BUCKET, HEAVY = 8, 6, 20_000, 1000


#: What tells documents apart.
TIE = ["doc_id", "size", "text_crc32", "uid"]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def numbered(rows: DataFrame, group: str, tie: list[str], n_rows: int, name: str) -> DataFrame:
    """rows with a gapless number from 0 within each group. Rows are dealt into hash buckets of PER_BUCKET at most; a row's number
    is its place in its bucket plus the sizes of the group's earlier buckets. One shuffle serves both."""
    buckets = max(shuffle_partitions(rows.sparkSession), n_rows // PER_BUCKET)
    dealt = rows.withColumn("_h", F.xxhash64(*tie)).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", *tie)) - 1
    return dealt.withColumn("_own", own).join(before, [group, "_b"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_h", "_b", "_own", "_before")


def _by_hub(rows: DataFrame, hubs: DataFrame, on: list[str], heavy: Column) -> DataFrame:
    """rows joined with hubs; `heavy` (over columns of either side) names the few hubs that are broadcast."""
    return rows.where(heavy).join(F.broadcast(hubs.where(heavy)), on).unionByName(rows.where(~heavy).join(hubs.where(~heavy), on))


def _grants(wanted: dict[tuple[int, int], int], room: list[int]) -> list[list[float]]:
    """Shares of the requests from a to b that are granted: swaps, then room in proportion to what is left."""
    n = len(room)
    swap = {ab: min(x, wanted.get((ab[1], ab[0]), 0)) for ab, x in wanted.items()}
    share = [[0.0] * n for _ in range(n)]
    for b in range(n):
        left = {a: wanted[a, b] - swap[a, b] for a in range(n) if (a, b) in wanted}
        total = sum(left.values())
        for a, x in left.items():
            extra = x * min(1.0, max(0, room[b]) / total) if total else 0
            share[a][b] = (swap[a, b] + extra) / wanted[a, b]
    return share


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """linked: (doc_id, size, text_crc32, uid, hub, n_hub, heavy). Returns it with shard, and the count of each shard."""
    n = len(quota)
    state = materialise(linked.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), *TIE), F.lit(n)).cast("int")), "shards")
    for turn in range(rounds + 1):
        load = [0] * n
        for r in state.groupBy("shard").count().collect():
            load[r["shard"]] = r["count"]
        room = [q - x for q, x in zip(quota, load, strict=True)]
        if turn == rounds:
            break
        near = state.groupBy("hub", "heavy").agg(F.array(*[F.sum(F.when(F.col("shard") == s, 1).otherwise(0)) for s in range(n)]).alias("near"))
        # neighbours first; ties go to the shard that the hub prefers, alike for all its documents
        scores = [
            F.when(F.lit(room[s] > 0) | (F.col("shard") == s), F.struct((F.col("near")[s] * n + F.pmod(F.col("hub") + s, F.lit(n))).alias("score"), F.lit(s).alias("s"))) for s in range(n)
        ]
        asked = _by_hub(state, near, ["hub", "heavy"], F.col("heavy")).withColumn("want", F.greatest(*scores)["s"]).drop("near")
        wanted = {(r["shard"], r["want"]): r["count"] for r in asked.groupBy("shard", "want").count().where("shard <> want").collect()}
        if not wanted:
            break
        share = _grants(wanted, room)
        if not any(x > 0 for row in share for x in row):
            break
        alone = F.col("n_hub") * 4 > min(quota)
        luck = F.pmod(F.when(alone, F.xxhash64(F.lit(turn), *TIE)).otherwise(F.xxhash64(F.lit(turn), "hub")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        grant = F.element_at(_pick_rows(share, F.col("shard")), (F.col("want") + 1).cast("int"))
        moved = materialise(asked.withColumn("shard", F.when(luck < grant, F.col("want")).otherwise(F.col("shard")).cast("int")).drop("want"), "shards")
        discard(state)
        state = moved
    return state, load


def _pick_rows(rows: list[list[float]], at: Column) -> Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), (at + 1).cast("int"))


def shard(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs."""
    text = F.col(text_col)
    rows = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("uid")),
        "shard-rows",
    )
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    same = ["h", "text_crc32", "size"]
    hubs = rows.groupBy(*same).agg(F.count("*").alias("n_hub")).where("n_hub > 1").withColumn("hub", F.xxhash64(*same)).withColumn("heavy", F.col("n_hub") * HEAVY > total)
    flood = rows.join(F.broadcast(hubs.where("heavy")), same, "left")
    rest = flood.where("hub is null").drop("n_hub", "hub", "heavy").join(hubs.where("not heavy"), same, "left")
    full = materialise(flood.where("hub is not null").unionByName(rest).drop("h"), "shard-linked")
    discard(rows)
    state, load = propagate(full.where("hub is not null"), quota, rounds)
    tie = TIE
    kept = [min(x, q) for x, q in zip(load, quota, strict=True)]
    if sum(load):
        placed = numbered(state.select(*tie, "shard"), "shard", tie, max(load), "slot")
        stays = placed.where(F.col("slot") < _pick(quota, F.col("shard")))
        over = placed.where(F.col("slot") >= _pick(quota, F.col("shard"))).select(*tie)
    pool = full.where("hub is null").select(*tie)
    if sum(load) > sum(kept):
        pool = pool.unionByName(over)
    free = [q - k for q, k in zip(quota, kept, strict=True)]
    start = [sum(free[:s]) for s in range(n_shards)]
    dealt = numbered(pool.withColumn("_all", F.lit(0)), "_all", tie, total, "at").drop("_all")
    which = sum((F.when(F.col("at") >= F.lit(start[s] + free[s]), 1).otherwise(0) for s in range(n_shards - 1)), F.lit(0))
    filled = dealt.withColumn("shard", which.cast("int")).withColumn("slot", F.col("at") - _pick(start, F.col("shard")) + _pick(kept, F.col("shard"))).drop("at")
    out = filled.select(*tie[:3], "shard", F.col("slot").cast("long").alias("slot"))
    return out.unionByName(stays.select(*tie[:3], "shard", F.col("slot").cast("long").alias("slot"))) if sum(load) else out
