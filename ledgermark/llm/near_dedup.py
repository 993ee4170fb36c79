"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

1. A pass over the texts gives each document its shingle count, a digest of its shingle set and a signature.
   Documents with equal sets are one node from here on, so a group of exact copies costs one row.
2. Nodes that share a band meet in a bucket. Each bucket first links its members to its smallest node only,
   so a bucket of n nodes makes n - 1 candidates. Candidates are compared by size and signature and then
   confirmed on the full sets: the texts of the nodes concerned (a bit table of their keys keeps most others out of the
   shuffle) are dealt to their smallest node's tasks, and each is compared with that node's set as it comes.
3. Buckets that still hold several groups are searched again, in blocks of bounded size: members of different groups
   whose sizes and signatures allow a link (five deviations of margin) are marked, and the marked members of two
   blocks are compared on their full sets. What leaves a task are members or the links that join groups, never
   pairs of a group.
4. Links become groups by union-find within partitions, and minimum-label stars across them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import bound_batches, stage, union_find, with_values

SLOTS_PER_BAND = 5
#: Chance that a pair at the threshold meets in no band.
MISS = 1e-6
#: Nodes, and shingles, in a block of a large bucket (on average); two blocks are compared at once.
BLOCK, BLOCK_ITEMS = 512, 400_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**SLOTS_PER_BAND))


def shingles(cp: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of lower-cased (A-Z) texts, and the text each is in; a text of fewer words has
    one for its whole sequence, and one without words has none."""
    cp = tx.lower_ascii(cp)
    start, end, owner = tx.white_words(cp, offsets)
    words = tx.SpanHasher(cp)(start, end)
    n = np.bincount(owner, minlength=len(offsets) - 1)
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        h = h * _GOLD + words[j : j + len(h)]
    whole = owner[: len(h)] == owner[k - 1 : k - 1 + len(h)]
    few = np.flatnonzero((n > 0) & (n < k))
    extra = np.zeros(len(few), np.uint64)
    first = np.cumsum(n) - n
    for i, d in enumerate(few):
        x = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for w in words[first[d] : first[d] + n[d]]:
                x = x * _GOLD + w
        extra[i] = x
    return tx.mix(np.append(h[whole], extra)), np.append(owner[: len(h)][whole], few)


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of n sets. Every element has a random permutation of the slots and offers rank j plus a
    uniform value to its j-th slot; a slot keeps the least offer. Ranks are dealt level by level, and a set stops as
    soon as all its slots are filled, since later levels only offer more. A slot holds 64 bits that
    name its winner; sets without elements hold zeros."""
    out = np.zeros((n, m), np.uint64)
    live = np.arange(len(elements))  # elements whose set still has empty slots
    perm = None
    filled = np.zeros((n, m), bool)
    for j in range(m):
        e = elements[live]
        r = tx.mix(e + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + ((r >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(live))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            perm[row, j] = slot
        offer = tx.mix(r ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        own = owner[live]
        open_ = ~filled[own, slot]
        cell = own[open_] * m + slot[open_]
        best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(best, cell, offer[open_])
        new = np.zeros(n * m, bool)
        new[cell] = True
        at = np.flatnonzero(new)
        out.reshape(-1)[at] = best[at]
        filled.reshape(-1)[at] = True
        undone = ~filled.all(1)
        keep = undone[own]
        if not keep.any():
            break
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint16 if m > 255 else np.uint8), (int(keep.sum()), 1))
            row = np.arange(len(perm))
            perm[row, k[keep]] = 0
            perm[row, 0] = k[keep]
        else:
            perm = perm[keep]
        live = live[keep]
    return out


def signatures(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of each row: doc_id, text_key, n_shingles, digest (16 bytes, null without shingles), bands, sig (two bytes a slot)."""
    bands = bands_for(similarity)
    m = bands * SLOTS_PER_BAND
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = tx.mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)
        for batch in batches:
            for piece, texts in tx.blocks(batch, limit=tx.BLOCK):
                n = len(texts)
                h, owner = shingles(*tx.codes(texts), k)
                order = np.argsort(owner, kind="stable")
                h, owner = h[order], owner[order]
                parts = [np.unique(x) for x in np.split(h, np.searchsorted(owner, np.arange(1, n)))]
                size = np.array([len(x) for x in parts], np.int64)
                sig = superminhash(np.concatenate(parts), np.repeat(np.arange(n), size), n, m)
                key = np.broadcast_to(salt, (n, bands)).copy()
                for j in range(SLOTS_PER_BAND):
                    key = tx.mix(key * _GOLD + sig[:, j::SLOTS_PER_BAND])
                short = (sig >> np.uint64(20)).astype("<u2")
                none = size == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        piece.column(1),
                        pa.array(size),
                        pa.array([None if z else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x, z in zip(parts, none, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                    ],
                    schema=schema,
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_key", "cast(text as string) text").mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sig binary"
    )


#: Bits of the table for each wanted row, and of the whole table (8 MB as bits, less than 64 MB as it is broadcast).
BITS_PER_ROW, MOST_BITS = 8, 1 << 26
#: Nodes that are compared with their smallest node in one task (about).
MEMBERS = 256


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds k1, k2 and k3, by which a row of documents is found again (doc_id, whether it is null, hash of its text)."""
    return rows.withColumn("k1", F.coalesce("doc_id", F.lit(0))).withColumn("k2", F.col("doc_id").isNull()).withColumn("k3", F.col("text_key"))


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each row of ``wanted`` (k1, k2, k3), once: k1, k2, k3, text. Rows whose key's bit is not set in the table of
    wanted keys are left out before the shuffle (few others pass, and the join drops those)."""
    wanted = stage(wanted.select("k1", "k2", "k3").distinct(), "wanted")
    bits = 64
    while bits < min(MOST_BITS, BITS_PER_ROW * wanted.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(place & 63 as int))")
    table = wanted.withColumn("place", place).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = F.broadcast(stage(table, "bits"))  # at most MOST_BITS / 64 pairs of numbers
    rows = _keyed(docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_key", "cast(text as string) text")).withColumn("place", place)
    rows = rows.join(table, word == F.col("word")).where(F.expr("(bits & shiftleft(1L, cast(place & 63 as int))) != 0"))
    return rows.groupBy("k1", "k2", "k3").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2", "k3"])


def _set_of(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingles(*tx.codes([text or ""]), k)[0])


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sizes and signatures allow a link."""
    m = bands_for(similarity) * SLOTS_PER_BAND
    least = math.floor(m * (similarity - 5 * math.sqrt(similarity * (1 - similarity) / m)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, m) for i in (2, 3))
            yield batch.filter(pa.array((a == b).sum(1) >= least)).select([0, 1])

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. A node a with many pairs is dealt to several tasks, with its text for each;
    a task holds one set of a and reads the others one by one."""
    keys = _keyed(nodes.select("node", "doc_id", "text_key")).select("node", "k1", "k2", "k3")
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("s"))
    own = per.select("a", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.col("a").alias("node"), F.lit(0).alias("role"))
    others = pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("salt"), F.col("b").alias("node"), F.lit(1).alias("role"))
    roles = stage(own.unionByName(others).join(keys, "node"), "roles")
    rows = roles.join(_texts(roles, docs), ["k1", "k2", "k3"]).select("a", "salt", "role", "node", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, role, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0 and at == (hub, salt):
                    continue
                items = _set_of(text, k)
                if _digest(items) != node:  # another text with the same key
                    continue
                if role == 0:
                    at, own = (hub, salt), items
                elif at == (hub, salt):
                    both = len(np.intersect1d(own, items, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(items) - both):
                        a.append(hub)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _by_group(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to each run of equal (key, p, q) of sorted batches; a run is bounded by the blocks' size."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        keys = np.stack([rest.column(x).to_numpy() for x in ("key", "p", "q")])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        at = 0
        for c in cut.tolist():
            yield work(rest.slice(at, c - at))
            at = c
        rest = rest.slice(at)
    if rest is not None and len(rest):
        yield work(rest)


def _residual(buckets: DataFrame, label: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Members of buckets that have, within their pair of blocks, a possible link to a member of another group: key, p,
    q, i, node, label. A possible link has a size and a signature that allow one, and is looked at in the first band
    that both members share. Rows are members, never pairs."""
    bands = bands_for(similarity)
    m = bands * SLOTS_PER_BAND
    least = math.floor(m * (similarity - 5 * math.sqrt(similarity * (1 - similarity) / m)))
    rows = buckets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c"), F.sum("n").alias("s")).where("x != y")
    open_ = open_.select("key", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_ITEMS)).cast("int").alias("nb"))
    # blocks hold members of like sizes (a bucket's size classes), so that block pairs whose sizes rule out a link are left out
    dealt = rows.join(open_, "key").withColumn("size", F.when(F.col("nb") == 1, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / (math.log(1 / similarity) * (1 + 1e-9))).cast("int")))
    split = dealt.groupBy("key", "size").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    split = split.select("key", "size", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_ITEMS)).cast("int").alias("parts"))
    order = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("first", F.coalesce(F.sum("parts").over(order), F.lit(0)).cast("int"))  # a row for each class of a bucket
    near = split.select("key", F.col("size").alias("other"), F.col("first").alias("from"), (F.col("first") + F.col("parts") - 1).alias("to"))
    dealt = dealt.join(split, ["key", "size"]).withColumn("i", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    # a link's sizes differ by less than the width of a class, so a member meets its own class and the two beside it
    dealt = dealt.withColumn("other", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).join(near, ["key", "other"])
    dealt = dealt.withColumn("j", F.explode(F.sequence("from", "to")))
    dealt = dealt.join(nodes.select("node", "sig", "bands"), "node")
    dealt = dealt.select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "band", "node", "label", "n", "sig", "bands")
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def compare(g: pa.Table) -> pa.RecordBatch:
        n, i = g.column("n").to_numpy(), g.column("i").to_numpy()
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), "<u2").reshape(-1, m)
        band = g.column("band")[0].as_py()
        earlier = np.array(g.column("bands").to_pylist(), np.int64).reshape(-1, bands)[:, :band]
        _, lab = np.unique(np.array(g.column("label").to_pylist(), object), return_inverse=True)
        same_block = g.column("p")[0].as_py() == g.column("q")[0].as_py()
        hit = np.zeros(len(n), bool)
        for x in range(len(n) - 1):
            y = np.arange(x + 1, len(n))
            y = y[(lab[y] != lab[x]) & (np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]))]
            if not same_block:
                y = y[i[y] != i[x]]
            y = y[(sig[y] == sig[x]).sum(1) >= least]
            y = y[~(earlier[y] == earlier[x]).any(1)]
            hit[y] = True
            hit[x] |= len(y) > 0
        out = g.filter(pa.array(hit))
        return pa.RecordBatch.from_arrays([out.column(c).combine_chunks().cast(t) for c, t in _MEMBER.items()], list(_MEMBER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, compare)

    return dealt.mapInArrow(run, "key long, p int, q int, i int, node binary, label binary")


_MEMBER = {"key": pa.int64(), "p": pa.int32(), "q": pa.int32(), "i": pa.int32(), "node": pa.binary(), "label": pa.binary()}


def common_items(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets of distinct items, by products of their incidence matrix."""
    n = len(sets)
    items, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    shared = count[where] > 1  # an item of one set alone is in no intersection
    number = np.cumsum(count > 1) - 1
    row, col = row[shared], number[where[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    width = 2048
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (at, at + width))
        part = np.zeros((n, width), np.float32)
        part[row[a:b], col[a:b] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _linked(flagged: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between groups among the flagged members, on full sets: of each pair of blocks no more than join its groups."""
    keys = _keyed(nodes.select("node", "doc_id", "text_key")).select("node", "k1", "k2", "k3")
    flagged = stage(flagged.join(keys, "node"), "members")
    rows = flagged.join(_texts(flagged, docs), ["k1", "k2", "k3"]).select("key", "p", "q", "i", "node", "label", "text")
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def exact(g: pa.Table) -> pa.RecordBatch:
        sets = [_set_of(t, k) for t in g.column("text").to_pylist()]
        good = pa.array([_digest(x) == node for x, node in zip(sets, g.column("node").to_pylist(), strict=True)])
        sets = [x for x, ok in zip(sets, good.to_pylist(), strict=True) if ok]
        g = g.filter(good)
        if not sets:
            return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.binary())], ["a", "b"])
        node, i = g.column("node").to_pylist(), g.column("i").to_numpy()
        _, lab = np.unique(np.array(g.column("label").to_pylist(), object), return_inverse=True)
        n = np.array([len(x) for x in sets])
        both = common_items(sets)
        ok = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1) & (lab[:, None] != lab[None, :])
        if g.column("p")[0].as_py() != g.column("q")[0].as_py():
            ok &= i[:, None] != i[None, :]
        parent: dict[int, int] = {}
        a, b = [], []
        for x, y in zip(*(v.tolist() for v in np.nonzero(ok)), strict=True):
            if union_find(parent, int(lab[x]), int(lab[y])):
                a.append(node[x])
                b.append(node[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, exact)

    return rows.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (its group's smallest node) of all nodes in ``links`` (a, b)."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                union_find(parent, a, b)
        up = []
        for x in parent:
            r = x
            while parent[r] != r:
                r = parent[r]
            if r != x:
                up.append((x, r))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in up], pa.binary()), pa.array([r for _, r in up], pa.binary())], ["u", "v"])

    edges = stage(links.mapInArrow(forest, "u binary, v binary").distinct(), "forest")
    before = None
    while True:
        # large star: every larger neighbour of u moves to the least of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Rows are linked if 100 * |A and B| >= percent * |A or B| over their distinct k-word shingles (ASCII white space
    separates words, A-Z is lower-cased; fewer than k words: the whole sequence). component_id is the smallest doc_id
    reachable. Null, empty and wordless texts have no shingle and are alone; repeated rows are in one group, each
    with the same answer; a null doc_id takes part and is the component's id only if all its rows' are null; an
    empty table gives no rows. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    similarity = percent / 100
    rows = stage(signatures(docs, k, similarity), "signatures")
    nodes = (
        rows.where("digest is not null").groupBy(F.col("digest").alias("node"))
        .agg(F.min(F.struct("doc_id", "text_key", F.col("n_shingles").alias("n"), "bands", "sig")).alias("x")).select("node", "x.*")
    )
    nodes = stage(nodes, "nodes")
    member = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = member.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1")
    buckets = stage(member.join(shared.select("key", "hub"), "key"), "buckets")
    first = buckets.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(_confirmed(stage(_possible(first, nodes, similarity), "first"), nodes, docs, k, percent), "links")
    label = components(links)
    flagged = stage(_residual(buckets.select("key", "band", "node", "n"), label, nodes, similarity), "residual")
    if not flagged.isEmpty():
        more = stage(_linked(flagged, nodes, docs, k, percent), "more")
        if not more.isEmpty():
            label = components(links.union(more))
    label = nodes.select("node", "doc_id").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = label.join(least, "label").select(F.col("node").alias("digest"), "component_id")
    out = with_values(rows.select("doc_id", "text_key", "n_shingles", "digest"), found, "digest")  # many copies are one key, wordless texts none
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, without near copies: of each group the row with the smallest doc_id stays, one
    of them if that row is repeated. Rows without words stay."""
    found = near_groups(docs, k, percent).where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("c"))
    stay = stage(found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "c"), "kept")
    same = F.col("__id").eqNullSafe(docs["doc_id"].cast("long")) & (F.col("__key") == F.xxhash64(docs["text"]))
    left = docs.join(stay, same, "left_semi")
    return left if stay.where("c > 1").isEmpty() else left.dropDuplicates(["doc_id", "text"])
