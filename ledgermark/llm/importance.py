"""Resampling towards a target distribution by bucket-partitioned inverted postings.

Documents become postings (bucket, document, count) in blocks of bounded size, dealt out by ranges of buckets. Each range
meets the counts of both corpora in its buckets, so that gains are computed where the postings are; what they contribute
is summed by document. A bucket that most documents hold is no hot key: a range's postings are cut into groups
of bounded size by their blocks, and each group meets the range's counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.ranks import numbered

from ._spark import bound_batches, stage

BUCKETS, ORDERS = 10_000, 1
#: Ranges of buckets.
RANGES = 8
#: Words and documents in a block, at most (a longer document is a block of its own).
BLOCK_WORDS, BLOCK_DOCS = 1 << 17, 1 << 12
#: Postings in a row, at most: Parquet readers hold thousands of rows at once, whatever is in them.
ROW = 1 << 8
#: Postings that a group of a range holds (about).
GROUP = 1 << 20
#: Bytes of a text that are cut into words at once; runs whose bucket a worker remembers, at most.
STRETCH, CACHE = 1 << 20, 1 << 20
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(256)).lower()  # bytes.lower changes A-Z only
POSTINGS = "block long, part int, words array<long>, ids array<long>, doc array<int>, bucket array<int>, count array<int>"


class Buckets:
    """Buckets of a text's runs of words, from remembered ones where it can."""

    def __init__(self, buckets: int, orders: int):
        self.buckets, self.orders, self.known = buckets, orders, {}

    def __call__(self, text: str) -> tuple[int, list[np.ndarray]]:
        """Number of words, and the buckets of all runs, a stretch of the text at a time."""
        data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
        at, words, last, out = 0, 0, [], []
        while at < len(data):
            end = min(len(data), at + STRETCH)
            if end < len(data) and (cut := _WORD.match(data, end)):
                end = cut.end()
            own = _WORD.findall(data, at, end)
            words += len(own)
            out.append(np.fromiter(map(self.one, own), np.int32, len(own)))
            if self.orders > 1 and own:
                run = last + own  # runs across the border end in the new words
                for n in range(2, self.orders + 1):
                    begins = range(max(0, len(last) - n + 1), len(run) - n + 1)
                    out.append(np.array([zlib.crc32(b" ".join(run[i : i + n])) % self.buckets for i in begins], np.int32))
                last = run[-(self.orders - 1) :]
            at = end
        return words, out

    def one(self, word: bytes) -> int:
        b = self.known.get(word)
        if b is None:
            b = zlib.crc32(word) % self.buckets
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = b
        return b


def postings(docs: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS, ranges: int = RANGES) -> DataFrame:
    """Blocks of postings of ``docs`` (doc_id, text), three kinds of rows: ``part`` is the range that ``bucket`` is in, with
    documents as places in the block, in order, in rows of ``ROW`` postings; or -1 for a block's documents, with their ids and numbers of words; or -2 for
    a task's counts by bucket. (Written as a table: blocks are numbered by the task that read them.)"""
    bound_batches(docs.sparkSession)
    names = [c.split()[0] for c in POSTINGS.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n = Buckets(buckets, orders), 0
        part = TaskContext.get().partitionId() << 32
        total = np.zeros(buckets, np.int64)
        ids: list[int | None] = []
        words: list[int] = []
        keys: list[np.ndarray] = []  # of each document its buckets, once each, in order
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held
            doc = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
            key, count = np.concatenate(keys), np.concatenate(counts)
            own = key.astype(np.int64) * ranges // buckets
            rows: list[tuple] = [(part + n, -1, words[:], ids[:], None, None, None)]
            for p in np.unique(own).tolist():
                at = np.flatnonzero(own == p)
                for x in np.split(at, range(ROW, len(at), ROW)):
                    rows.append((part + n, p, None, None, doc[x], key[x], count[x]))
            for c in (ids, words, keys, counts):
                c.clear()
            n, held = n + 1, 0
            return batch(rows)

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size, found = find(text or "")
                here = np.zeros(0, np.int32), np.zeros(0, np.int64)
                if len(found) == 1 and size < buckets:
                    here = np.unique(found[0], return_counts=True)
                elif found:
                    c = sum(np.bincount(x, minlength=buckets) for x in found)
                    here = np.flatnonzero(c).astype(np.int32), c[c > 0]
                if len(here[1]) and here[1].max() > np.iinfo(np.int32).max:
                    raise ValueError("a document holds a bucket more than 2**31 times")
                total[here[0]] += here[1]
                ids.append(name)
                words.append(size)
                keys.append(here[0])
                counts.append(here[1].astype(np.int32))
                held += size
                if held >= BLOCK_WORDS or len(ids) >= BLOCK_DOCS:
                    yield flush()
        if ids:
            yield flush()
        at = np.flatnonzero(total)
        if len(at):
            yield batch([(part + n, -2, total[at], None, None, at, None)])

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS), "postings")


def corpus_counts(table: DataFrame, name: str) -> DataFrame:
    """bucket and how many features of the whole corpus are in it: a row for each bucket at most."""
    rows = table.where("part = -2").select(F.explode(F.arrays_zip("bucket", "words")).alias("x"))
    return rows.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.words").alias(name))


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))."""
    s, t = s.astype(np.float64), t.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * float(all_s + buckets) / ((s + 1) * float(all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """doc_id, words, n_features and weight (sum of its features' gains) of every row of ``docs``."""
    source = postings(docs, buckets, orders)
    both = corpus_counts(source, "s").join(corpus_counts(postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, orders), "t"), "bucket", "full")
    both = stage(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts")
    all_s, all_t = (int(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    own = source.where("part >= 0").select("block", "part", "doc", "bucket", "count")
    cuts = max(1, -(-int(own.agg(F.sum(F.size("bucket"))).first()[0] or 0) // (GROUP * RANGES)))
    own = own.withColumn("cut", F.pmod(F.xxhash64("block"), F.lit(cuts)).cast("int"))
    part = F.floor(F.col("bucket") * RANGES / buckets).cast("int")
    known = both.groupBy(part.alias("part")).agg(F.collect_list(F.struct("bucket", "s", "t")).alias("x"))  # so many buckets a range, whatever the corpus
    known = known.select("part", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"), "x.bucket", "x.s", "x.t")

    def contribute(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(buckets, np.int64)
        for b in right:
            for bucket, s, t in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "s", "t")), strict=True):
                gain[np.array(bucket)] = gains(np.array(s), np.array(t), all_s, all_t, buckets)
        for b in left:
            block, lists = b.column(b.schema.get_field_index("block")).to_numpy(), [b.column(b.schema.get_field_index(c)) for c in ("doc", "bucket", "count")]
            block = np.repeat(block, lists[0].value_lengths().to_numpy())
            doc, bucket, count = (c.flatten().to_numpy() for c in lists)
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])))  # a document's postings follow each other
            sums = np.add.reduceat(gain[bucket] * count, first)
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(doc[first]), pa.array(sums)], ["block", "doc", "gain"])

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(contribute(iter(left.to_batches()), iter(right.to_batches())))
        return pa.Table.from_batches(got, schema=pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("gain", pa.int64())]))

    found = own.groupBy("part", "cut").cogroup(known.groupBy("part", "cut")).applyInArrow(whole, "block long, doc int, gain long")
    rows = source.where("part = -1").select("block", F.posexplode(F.arrays_zip("ids", "words")).alias("doc", "x")).select("block", "doc", "x.ids", "x.words", F.lit(0).cast("long").alias("gain"))
    none = F.lit(None).cast("long")
    each = rows.unionByName(found.select("block", "doc", none.alias("ids"), none.alias("words"), "gain")).groupBy("block", "doc")
    out = each.agg(F.max("ids").alias("doc_id"), F.max("words").alias("words"), F.sum("gain").alias("weight"))
    n = sum((F.greatest(F.col("words") - k, F.lit(0).cast("long")) for k in range(1, orders)), F.col("words"))
    return out.select("doc_id", "words", n.alias("n_features"), "weight")


def noise(seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from a digest of seed and id: Gumbel noise, the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text): rank 1, 2, 3 and so on for the
    ``percent`` of the documents with ``least_words`` words or more whose scores are highest (ties: the smaller doc_id),
    null for all others. ``target`` (text) is the corpus that the draw should resemble.

    A null, empty or wordless text has no feature and weight 0; texts count whole, however long; repeated rows are documents
    like others, with the same score each; a null id counts as an empty one and comes last among ties; an empty table
    gives no rows, and with an empty target all gains come from the documents alone. Other columns are ignored.
    """
    scored = stage(weights(docs, target, buckets, orders).withColumn("score", F.col("weight") + noise(seed)), "scores")
    able = scored.where(F.col("words") >= least_words)
    drawn = percent * able.count() // 100
    able = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return able.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
