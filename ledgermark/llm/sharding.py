"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is cut into ``BUCKETS`` arcs of equal length. Within an arc rows are ordered by a hash of their contents, at
every size; an arc with many rows (one id may hold a third of them) is cut into cells, ranges of that hash, which are
numbered apart and change no order. From the arcs' counts the driver lays out which rows of an arc go to which shard:
the shard of the next virtual node clockwise takes them up to its capacity, and what overflows continues clockwise to
the next shard with room. What the driver sees and what is broadcast has a row for each arc, whatever the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 14
VIRTUAL_NODES = 128
#: Rows of a cell (about).
CELL = 1 << 16
LAW = "rows"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes, in ring order, and their shards. A node's place depends on its shard and number only."""
    nodes = []
    for s in range(shards):
        for v in range(virtual_nodes):
            h = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(h, "big") % buckets, h, s))
    nodes.sort()
    return np.array([p for p, _, _ in nodes]), np.array([s for _, _, s in nodes])


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may hold. Without slack they add up to the total and are at most one apart."""
    if slack:
        return [int(np.ceil(total / shards * (1 + slack)))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def layout(counts: dict[int, int], shards: int, caps: list[int], buckets: int = BUCKETS) -> list[tuple[int, int, int, int, int]]:
    """Segments (bucket, first rank, end rank, shard, slot of the first): every row of every bucket lies in one."""
    place, owner = ring(shards, buckets=buckets)
    room, used = list(caps), [0] * shards
    out, over = [], []

    def give(b: int, at: int, n: int, s: int) -> None:
        out.append((b, at, at + n, s, used[s]))
        used[s] += n
        room[s] -= n

    for b in sorted(counts):
        i = int(np.searchsorted(place, b)) % len(place)
        n = min(counts[b], room[owner[i]])
        if n:
            give(b, 0, n, int(owner[i]))
        if n < counts[b]:
            over.append((b, i, n))
    for b, i, at in over:
        while at < counts[b]:
            i = (i + 1) % len(place)
            n = min(counts[b] - at, room[owner[i]])
            if n:
                give(b, at, n, int(owner[i]))
                at += n
    return out


def assign(docs: DataFrame, shards: int = 16, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    Without slack the law is ``rows``: counts of shards are at most one apart. slot numbers a shard's rows from 0
    without gaps. size is the text's UTF-8 bytes plus 1 (null: 1). Rows of an arc are ordered by a hash of place,
    doc_id, size and crc32; repeated rows are rows like others, and a null doc_id has a place on the ring too; an empty
    table gives no rows. grown_shard is null, since the capacities, not the id alone, decide. Other columns are ignored.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.lit("ring"), F.col("doc_id"))
    bucket = F.shiftrightunsigned(place, 64 - (BUCKETS.bit_length() - 1)).cast("int")
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = ("place", "doc_id", "size", "text_crc32")
    rows = docs.select("doc_id", place.alias("place"), bucket.alias("b"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    per_arc = docs.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()  # at most BUCKETS rows
    arcs = {r["b"]: r["n"] for r in per_arc}
    plan = layout(arcs, shards, capacities(sum(arcs.values()), shards, slack))
    segments = F.broadcast(spark.createDataFrame(plan, "b int, first long, stop long, shard int, slot0 long"))  # arcs, and one more for each capacity met
    wide = F.broadcast(spark.createDataFrame([(b, (-(-n // CELL) - 1).bit_length()) for b, n in sorted(arcs.items())], "b int, bits int"))  # arcs
    # copies of one row are alike in all that is returned: they are counted, and dealt out again behind their places
    kinds = rows.groupBy("b", *own).agg(F.count("*").alias("n")).join(wide, "b").withColumn("h", F.xxhash64(F.lit("cell"), *own))
    kinds = kinds.withColumn("cell", F.expr("CASE WHEN bits = 0 THEN 0 ELSE shiftright(h, 64 - bits) END"))
    before = Window.partitionBy("b", "cell").orderBy("h", *own).rowsBetween(Window.unboundedPreceding, -1)
    cells = kinds.groupBy("b", "cell").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("b", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("at"))
    kinds = kinds.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, ["b", "cell"])
    kinds = kinds.withColumn("from", F.col("at") + F.col("before"))
    hit = kinds.join(segments, "b").where("from < stop and from + n > first")
    hit = hit.withColumn("rank", F.explode(F.sequence(F.greatest("from", "first"), F.least(F.col("from") + F.col("n"), "stop") - 1)))
    return hit.select(
        "doc_id", "size", "text_crc32", F.lit(LAW if not slack else "bounded").alias("law"), "shard",
        (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
