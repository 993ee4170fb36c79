"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes a document's score of them, and the
sentence model is trained from document labels alone. The sentences that carry a high score are then located."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import bound_batches, held_out, remainder, sampled, stage

#: Labelled documents that the model is fitted on, at most (about; chosen by a hash of the id).
FIT_ROWS = 12_000
#: Lengths of the word beginnings that are features besides the whole word.
PREFIXES = (4, 5)
THRESHOLD = 0.3
EPOCHS, RATE, L1 = 80, 0.5, 1e-5
#: Logit of a sentence whose evidence weighs nothing. (A sentence without any evidence cannot be toxic: its score is 0.)
BIAS = -10.0
#: A feature is used if toxic training documents hold it so many deviations more often than chance has it, and
#: make up half of its documents at least.
DEVIATIONS = 5
#: Weight of a document of whose sentences no other one holds any; copies share a weight (whole numbers add up alike in any order).
WHOLE = 1024
#: Cased letters lie below this code point.
_CASED = 1 << 17


@functools.lru_cache(1)
def _lower() -> np.ndarray:
    """Lower-case code point of each code point (of several that it becomes, the first)."""
    return np.array([ord(chr(c).lower()[0]) for c in range(_CASED)], np.uint32)


def lowered(cp: np.ndarray) -> np.ndarray:
    """Code points in lower case, one by one, so that places stay and no character changes how others are read."""
    return np.where(cp < _CASED, _lower()[np.minimum(cp, _CASED - 1)], cp)


@dataclass
class Model:
    """Telling features (their 64-bit hashes, sorted) and their weights."""

    keys: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, bool)  # most features are told apart by their last bits
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of telling features, and their numbers."""
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at):
            return at, at
        number = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[number] == h[at]
        return at[hit], number[hit]


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0, np.float32))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all features, the sentence each is in, the text each sentence is in, and the sentences' spans
    (start, end; code points of the joined texts). A sentence ends at . ! ? or a line's end. A text without a
    word has no sentence."""
    cp, offsets = tx.codes(texts)
    cp = lowered(cp)
    letter = ((cp >= 97) & (cp <= 122)) | ((cp >= 48) & (cp <= 57)) | (cp >= 0xC0) & ~((cp >= 0x2000) & (cp < 0x2070))
    stop = (cp == 46) | (cp == 33) | (cp == 63) | (cp == 10)
    s_start, s_end, s_owner = tx.runs(~stop, offsets)
    start, end, _ = tx.runs(letter, offsets)
    sent = np.searchsorted(s_start, start, "right") - 1
    used, sent = np.unique(sent, return_inverse=True)
    hasher = tx.SpanHasher(cp)
    found = [hasher(start, end)]
    owner = [sent]
    for n in PREFIXES:
        long = end - start > n
        found.append(hasher(start[long], start[long] + n) + np.uint64(n))
        owner.append(sent[long])
    return np.concatenate(found), np.concatenate(owner), s_owner[used], np.stack([s_start[used], s_end[used]], 1)


def noisy_or(z: np.ndarray, owner: np.ndarray, n: int, times: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of sentences by their logits, and of documents that some sentence (each met so many ``times``) is toxic."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, 0.0 - np.expm1(np.bincount(owner, times * np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def sentence_keys(h: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """A key of each sentence, by the features it holds."""
    order = np.argsort(sent, kind="stable")
    return np.add.reduceat(tx.mix(h[order]), np.flatnonzero(np.diff(sent[order].astype(np.int64), prepend=-1))) if len(sent) else np.zeros(0, np.uint64)


def telling(freq: Column, hits: Column, n: float, positive: float) -> Column:
    """Whether a feature speaks for the label: of the documents that hold it (``freq``) so many are toxic (``hits``), of
    ``n`` documents with ``positive`` toxic ones."""
    base = positive / max(n, 1e-9)
    return (hits - freq * base > DEVIATIONS * F.sqrt(freq * base * (1 - base))) & (2 * hits >= freq)


def _pairs(a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a number and a hash, sorted by number."""
    order = np.lexsort((h, a))
    a, h = a[order], h[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    return a[new], h[new]


def train(odds: np.ndarray, labels: np.ndarray, weight: np.ndarray, of: np.ndarray, times: np.ndarray, sent: np.ndarray, feat: np.ndarray) -> np.ndarray:
    """Weights of the telling features by proximal AdaGrad on the weighted noisy-or likelihood.

    Documents have labels and weights. A sentence with evidence belongs to a document (``of``), which holds it so many
    ``times``; a telling feature (``feat``) stands in a sentence (``sent``). Features start from their log odds, and weights
    stay positive."""
    w = np.maximum(2 * odds, 0.0)
    gathered = np.full(len(w), 1e-6)
    share = weight / max(weight.sum(), 1e-9)
    for _ in range(EPOCHS):
        p, q = noisy_or(BIAS + np.bincount(sent, w[feat], len(of)), of, len(labels), times)
        pull = (share * np.where(labels == 1, -(1 - q) / np.maximum(q, 1e-9), 1.0))[of] * p * times  # the loss's slope by each sentence's logit
        g = np.bincount(feat, pull[sent], len(w))
        gathered += g * g
        rate = RATE / np.sqrt(gathered)
        w = np.maximum(w - rate * (g + L1), 0)
    return w.astype(np.float32)


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts; of their sentences the scores, texts, and spans in the joined texts. Within a sentence a feature
    counts once, and a sentence without evidence has probability 0, so that length alone never adds up."""
    h, sent, owner, spans = features(texts)
    at, number = model.find(h)
    pair = np.unique(sent[at] * (1 << 32) + number)
    told, of = np.unique(pair >> 32, return_inverse=True)  # sentences with evidence
    p = np.zeros(len(owner))
    p[told], q = noisy_or(BIAS + np.bincount(of, model.weights[pair & ((1 << 32) - 1)], len(told)), owner[told], len(texts))
    return q, p, owner, spans


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model of the labelled documents that may be learned from, or about ``fit_rows`` of them. A document with several
    labels is toxic if one says so; null labels, ids and texts teach nothing; without labels, or without documents, nothing
    is toxic. Near copies share one document's weight: a text that has many would else make its own words look telling. A
    document weighs the mean, over its sentences, of one by the number of documents that hold the sentence."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y")).where("y is not null").where(remainder("doc_id") != 2)
    known = sampled(known.groupBy("doc_id").agg(F.max("y").alias("y")), fit_rows, "doc_id")

    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = text.join(F.broadcast(known), "doc_id")  # known: at most about fit_rows pairs of numbers
    # numbered by id and text, so that repeated ids are documents of their own
    rows = stage(rows.select(F.xxhash64("doc_id", "text").alias("id"), "y", "text").dropDuplicates(["id"]), "labelled")
    rows = sampled(rows, fit_rows, "id")  # an id that is repeated with other texts counts as often

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _pieces(batches):
            h, sent, owner, _ = features(texts)
            doc, key = _pairs(owner, sentence_keys(h, sent))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc)), pa.array(key.view(np.int64))], ["id", "k"])

    said = rows.mapInArrow(keys, "id long, k long")
    held = said.groupBy("k").agg(F.count("*").alias("c"))
    weights = said.join(held, "k").groupBy("id").agg(F.greatest(F.lit(1), F.round(WHOLE * F.avg(1 / F.col("c")))).cast("int").alias("w"))
    got = rows.select("id", "y").join(weights, "id").toPandas().sort_values("id", kind="stable")  # at most about fit_rows rows of numbers
    labels_, weight = got["y"].to_numpy(np.int64), got["w"].to_numpy(np.int64)
    if not labels_.any():
        return NOTHING
    number = {i: n for n, i in enumerate(got["id"].tolist())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _pieces(batches):
            own = np.array([weight[number[i]] if i in number else 0 for i in piece.column(0).to_pylist()])
            h, sent, owner, _ = features(texts)
            doc, h = _pairs(owner[sent], h)
            y = piece.column(1).to_numpy(zero_copy_only=False)
            key, at = np.unique(h, return_inverse=True)
            freq, hits = (np.bincount(at, w[doc], len(key)).astype(np.int64) for w in (own, own * (y == 1)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(freq), pa.array(hits)], ["h", "freq", "hits"])

    n, positive = weight.sum() / WHOLE, weight[labels_ == 1].sum() / WHOLE
    sums = rows.mapInArrow(count, "h long, freq long, hits long").groupBy("h").agg((F.sum("freq") / WHOLE).alias("freq"), (F.sum("hits") / WHOLE).alias("hits"))
    table = sums.where(telling(F.col("freq"), F.col("hits"), n, positive)).toPandas()  # of the sample's features those few that tell
    key = table["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    freq, hits = table["freq"].to_numpy(float)[order], table["hits"].to_numpy(float)[order]
    odds = np.log((hits + 0.5) / (positive + 1)) - np.log((freq - hits + 0.5) / (n - positive + 1))
    model = Model(key[order], odds.astype(np.float32))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document the different sets of telling features that its sentences hold, and how many hold each."""
        for piece, texts in _pieces(batches):
            h, sent, owner, _ = features(texts)
            at, feat = model.find(h)
            pair = np.unique(sent[at] * (1 << 32) + feat)
            own, feat = pair >> 32, (pair & ((1 << 32) - 1)).astype("<u4")
            sets: dict[tuple[int, bytes], int] = {}
            cut = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own)).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                d = int(owner[own[a]]), feat[a:b].tobytes()
                sets[d] = sets.get(d, 0) + 1
            ids = piece.column(0).to_pylist()
            out = [(ids[d], x, n) for (d, x), n in sets.items() if ids[d] in number]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["id", "f", "n"])

    # at most about fit_rows documents, and of each only its different sets of the telling features
    found = rows.mapInArrow(occurrences, "id long, f binary, n long").toPandas().sort_values(["id", "f"], kind="stable")
    feats = [np.frombuffer(x, "<u4").astype(np.int64) for x in found["f"]]
    if not feats:
        return NOTHING
    sent = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    return Model(model.keys, train(odds, labels_, weight / WHOLE, found["id"].map(number).to_numpy(np.int64), found["n"].to_numpy(float), sent, np.concatenate(feats)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        yield from tx.blocks(batch)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the sentences that carry the score (``offending``: start and length in
    code points, and their score) of every whole text of ``docs`` (doc_id, text).

    A null, empty or wordless text has no sentence: score 0, predicted 0. Repeated rows get the same answer each; an
    empty table gives no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in tx.blocks(batch):
                q, p, owner, spans = score(shared.value, texts)
                where: list[list[dict]] = [[] for _ in texts]
                begin = np.cumsum([0, *map(len, texts)])
                for i in np.flatnonzero(p >= threshold):
                    where[owner[i]].append({"start": int(spans[i, 0] - begin[owner[i]]), "length": int(spans[i, 1] - spans[i, 0]), "score": float(p[i])})
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(q), pa.array((q >= threshold).astype(np.int32)), pa.array(where, spot)], ["doc_id", "held_out", "score", "predicted", "offending"]
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, offending array<struct<start: long, length: long, score: double>>"
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that score below the threshold. Null, empty and wordless texts score 0 and stay;
    repeated rows are all kept or all dropped; an empty table stays empty."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in tx.blocks(batch):
                yield piece.filter(pa.array(score(shared.value, texts)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
