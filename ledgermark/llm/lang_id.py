"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered on the executors, a row for each language. The matrix of log probabilities is sparse: a bucket that
a language was not seen with has that language's floor. It is broadcast in slices of languages, and a text is scored
slice by slice in numpy as a sparse vector (the counts of the buckets that it holds, times their rows of the matrix);
the best language and the sum of all probabilities are carried along, so any number of languages can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import bound_batches, held_out, remainder, sampled

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Labelled documents that a model is fitted on, at most (about; chosen by a hash of the id).
FIT_ROWS = 20_000
#: Languages in a slice (16 MB when it is unfolded), unfolded slices that a worker keeps, and languages that a task counts at once.
SLICE, KEPT, COUNTED = 128, 8, 256
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Code points of a text that are worked on at once.
STRETCH = 1 << 18
_MUL = np.uint32(0x9E3779B1)


@dataclass
class Slice:
    """Some languages: log priors, floors (log probability of a bucket that was not seen), and what seen buckets have above
    these, language by language: ``ends`` of each one's entries in ``bucket`` and ``above``."""

    langs: list[str]
    prior: np.ndarray
    floor: np.ndarray
    ends: np.ndarray
    bucket: np.ndarray
    above: np.ndarray

    def matrix(self) -> np.ndarray:
        """Log probabilities (buckets, languages)."""
        out = np.tile(self.floor.astype(np.float32), (BUCKETS, 1))
        out[self.bucket, np.repeat(np.arange(len(self.langs)), np.diff(self.ends, prepend=0))] += self.above
        return out


@dataclass
class Model:
    """Slices of the learned languages, which are in order."""

    slices: list[Slice]

    def __post_init__(self) -> None:
        self._kept: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"slices": self.slices, "_kept": {}}

    @property
    def langs(self) -> list[str]:
        return [x for s in self.slices for x in s.langs]

    def matrix(self, i: int) -> np.ndarray:
        if i in self._kept:
            return self._kept[i]
        m = self.slices[i].matrix()
        if len(self._kept) < KEPT:
            self._kept[i] = m
        return m


def _letters(texts: list[str]) -> np.ndarray:
    """Whether a text has a letter."""
    return np.fromiter((t.isascii() and t.lower() != t.upper() or any(map(str.isalpha, t)) for t in texts), bool, len(texts))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a lower-cased text that have a letter first or last; for each order, and for each
    stretch of a long text. What is no letter counts as a blank."""
    cp, _ = tx.codes([text.lower()])
    letter = ((cp >= 97) & (cp <= 122)) | (cp >= 0xC0) & (cp != 0xD7) & (cp != 0xF7) & ~((cp >= 0x2000) & (cp < 0x2E80))
    sym = np.where(letter, cp, np.uint32(32)).astype(np.uint32)
    for at in range(0, len(sym), STRETCH):
        own = slice(at, at + STRETCH + max(ORDERS) - 1)
        part, word = sym[own], letter[own]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            h = (h[:size] ^ part[n - 1 :]) * _MUL
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                ok = (word[:size] | word[n - 1 :])[:STRETCH]
                yield ((h[:STRETCH][ok] + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text holds, and how often it holds each."""
    total = np.zeros(BUCKETS, np.int64)
    for bucket in grams(text):
        total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def fit(rows: DataFrame) -> Model:
    """Model of rows (lang, text), of all their languages; rows with a null language or text teach nothing, and without rows
    there is none to predict."""
    bound_batches(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}  # counts of buckets; at the end of documents

        def told() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])
            seen.clear()

        for batch in batches:
            for piece, texts in tx.blocks(batch):
                for lang, t in zip(piece.column(0).to_pylist(), texts, strict=True):
                    if lang not in seen:
                        if len(seen) >= COUNTED:
                            yield from told()
                        seen[lang] = np.zeros(BUCKETS + 1, np.int64)
                    at, n = counted(t)
                    seen[lang][at] += n
                    seen[lang][BUCKETS] += 1
        yield from told()

    table = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = table.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("x"))  # no more than BUCKETS + 1 entries each
    known: list[tuple] = []  # the fitting rows bound what the driver holds: the buckets that some document of a language holds
    for r in per.orderBy("lang").select("lang", F.transform("x", lambda x: x["bucket"].cast("int")), F.transform("x", lambda x: x["n"])).toLocalIterator():
        bucket, n = np.array(r[1], np.int32), np.array(r[2], np.int64)
        docs, bucket, n = int(n[-1]), bucket[:-1], n[:-1]
        total = n.sum() + SMOOTHING * BUCKETS
        known.append((r[0], docs, np.log(SMOOTHING / total), bucket, np.log((n + SMOOTHING) / SMOOTHING).astype(np.float32)))
    known.sort(key=lambda k: k[0])
    every = sum(k[1] for k in known)
    slices = []
    for i in range(0, len(known), SLICE):
        langs, docs, floor, bucket, above = map(list, zip(*known[i : i + SLICE], strict=True))
        slices.append(Slice(langs, np.log(np.array(docs) / every), np.array(floor), np.cumsum([len(x) for x in bucket]), np.concatenate(bucket), np.concatenate(above)))
    return Model(slices)


def score(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language of each text and its posterior probability; ``und`` and 0 for texts without a letter, or without a model."""
    n = len(texts)
    known = _letters(texts) if model.slices else np.zeros(n, bool)
    if not known.any():
        return [UNDETERMINED] * n, np.zeros(n)
    vectors = [counted(texts[i]) for i in np.flatnonzero(known).tolist()]
    best, lang, total = np.full(len(vectors), -np.inf), [""] * len(vectors), np.full(len(vectors), -np.inf)
    for j, part in enumerate(model.slices):
        matrix = model.matrix(j)
        for v, (at, count) in enumerate(vectors):
            log = part.prior.copy()
            for a in range(0, len(at), 4096):
                log += count[a : a + 4096].astype(np.float64) @ matrix[at[a : a + 4096]]
            top = int(log.argmax())
            total[v] = np.logaddexp(total[v], log[top] + np.log(np.exp(log - log[top]).sum()))
            if log[top] > best[v]:  # a tie goes to the language that sorts first
                best[v], lang[v] = log[top], part.langs[top]
    names, p = [UNDETERMINED] * n, np.zeros(n)
    for v, i in enumerate(np.flatnonzero(known).tolist()):
        names[i], p[i] = lang[v], min(1.0, float(np.exp(best[v] - total[v])))
    return names, p


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model of the rows of ``docs`` (doc_id, text, lang) that may be learned from, or about ``fit_rows`` different ones of them."""
    rows = docs.select("doc_id", "lang", "text").where(remainder("doc_id") != 2).where("lang is not null")
    return fit(sampled(rows, fit_rows, "doc_id", "lang", "text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text of ``docs`` (doc_id, text).

    A null, empty or letterless text is ``und`` with score 0; ties go to the language that sorts first; repeated
    rows get the same answer each; an empty table gives no rows. Other columns, lang among them, are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in tx.blocks(batch):
                langs, p = score(shared.value, texts)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(langs, pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is one of the model's with at least this posterior. Null, empty and
    letterless texts go; repeated rows are all kept or all dropped; an empty table, or a model of none, leaves no rows."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in tx.blocks(batch):
                langs, p = score(shared.value, texts)
                yield piece.filter(pa.array([x != UNDETERMINED and y >= least for x, y in zip(langs, p.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``predict`` with a model of the same rows (doc_id, text, lang), without those that are held out."""
    return predict(docs, learn(docs))
