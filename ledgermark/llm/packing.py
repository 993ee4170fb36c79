"""Packing of token pieces into windows of equal capacity by Karmarkar-Karp multiway differencing.

Tokens come from a public byte-level BPE vocabulary. Nothing is shuffled: each task packs the
documents it reads, about ``GROUP`` tokens at a time, so a group's size is bounded by a constant and a
retried task rebuilds the same windows.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import _text as tx
from ._spark import bound_batches

CAPACITY = 2048
#: Tokens that are packed together.
GROUP = 1 << 19
#: Entries that a worker's cache of encoded words holds at most.
CACHE = 400_000
SEPARATOR = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items into ``k`` windows with near-equal sums: merge the two partial partitions with the widest
    spread, largest window of one with smallest of the other, until one is left. Returns item indices by window."""
    if not sizes:
        return [[] for _ in range(k)]
    # A partial partition keeps only its non-empty windows, widest sum first; the other k - len are empty.
    heap: list = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, [i])]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)  # windows of a that are empty take b's largest first
        merged = list(a)
        take, rest = b[:free], b[free:]
        merged += take
        # what is left of b (its smallest windows) meets a's windows in opposing order: a's smallest with b's largest
        for (s, items), j in zip(rest, range(len(a) - 1, -1, -1), strict=False):
            t, own = merged[j]
            merged[j] = (t + s, own + items)
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    out = [items for _, items in heap[0][2]]
    return out + [[] for _ in range(k - len(out))]


def pack_whole(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of uncut items: as few as the total allows, and more whenever some window exceeds the capacity, by as
    many as would hold what is over. Items over the capacity are refused (cut them first)."""
    if sizes and max(sizes) > capacity:
        raise ValueError("an item is larger than the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = karmarkar_karp(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not over:
            return [w for w in windows if w]
        k += -(-over // capacity)


def pack_cut(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) that together hold every token once.

    Whole windows of long items stand alone. Differencing deals the tails, uncut, into windows, whose number rises
    whenever one exceeds the capacity (``pack_whole``). Since pieces may be cut, the windows that are above the number
    that the total fills, the least full ones, are then taken apart: their pieces fill the others up to the
    capacity, and what is left becomes windows whose lengths are powers of two, which need no padding. Empty items get
    no piece."""
    windows: list[list[tuple[int, int, int]]] = []
    tails: list[tuple[int, int, int]] = []
    for i, n in enumerate(sizes):
        full = n - n % capacity
        windows += [[(i, at, capacity)] for at in range(0, full, capacity)]
        if n > full:
            tails.append((i, full, n - full))
    if not tails:
        return windows
    dealt = [[tails[j] for j in w] for w in pack_whole([t[2] for t in tails], capacity)]
    dealt.sort(key=lambda w: -sum(p[2] for p in w))
    total = sum(t[2] for t in tails)
    keep = total // capacity
    loose = sorted((p for w in dealt[keep:] for p in w), key=lambda p: (p[2], -p[0]))  # the largest is given out first

    def fill(window: list[tuple[int, int, int]], room: int) -> None:
        while room > 0:
            i, at, n = loose.pop()
            take = min(n, room)
            window.append((i, at, take))
            room -= take
            if take < n:
                loose.append((i, at + take, n - take))

    for w in dealt[:keep]:
        fill(w, capacity - sum(p[2] for p in w))
    rest = total % capacity
    for size in (1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1):
        windows.append([])
        fill(windows[-1], size)
    return windows + dealt[:keep]


class Encoder:
    """Token ids of texts. Words are cut by class runs in numpy, each distinct word is encoded once and kept in
    a bounded cache; texts with contractions or the special token's string go through the library as a whole."""

    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.forget()
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=table, special_tokens={}
            )
        except (ImportError, FileNotFoundError):
            pass
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.zeros(0x110000, np.uint8)  # 0 other, 1 letter, 2 number, 3 white space
        for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                self.kind[ord(m[0][0]) : ord(m[0][0]) + len(m[0]) if ord(m[0][0]) >= 0xE000 or ord(m[0][-1]) < 0xD800 else 0xD800] = value

    def forget(self) -> None:
        """Empty the cache: a word's number, and by number where its ids begin in the store, and how many."""
        self.words: dict[str, int] = {}
        self.store, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def one(self, word: str) -> list[int]:
        return self.fast.encode_ordinary(word) if self.fast else self.whole.encode(word, add_special_tokens=False).ids

    def learn(self, words: list[str]) -> None:
        ids = [self.fast._core_bpe.encode_single_piece(w.encode()) for w in words] if self.fast else list(map(self.one, words))
        lengths = np.array(list(map(len, ids)), np.int64)
        n, size = len(self.words), len(self.store)
        self.words.update(zip(words, range(n, n + len(words)), strict=True))
        self.store = np.append(self.store, np.array(list(itertools.chain.from_iterable(ids)), np.uint32))
        self.begins = np.append(self.begins, size + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)

    def cuts(self, cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of the words, and the text each is in. A blank before a word belongs to it; of other white space
        before a word all but the last character is one span and the last another."""
        kind = self.kind[cp]
        n = len(kind)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin = first[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        space = kind == 3
        last = np.zeros(n, bool)  # last white space character before a word of the same text
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
        begin |= last
        blank = np.flatnonzero(last & (cp == 32)) + 1
        begin[blank] = False
        start = np.flatnonzero(begin)
        return start, np.append(start[1:], n), np.searchsorted(offsets, start, "right") - 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        slow = {i for i, t in enumerate(texts) if ("'" in t and regex.search(r"'(?:[stmd]|re|ve|ll)", t)) or self.SPECIAL in t}
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in slow:
            plain = self.fast is not None and self.SPECIAL not in texts[i]
            out[i] = np.array(self.one(texts[i]) if plain else self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        rest = [i for i, t in enumerate(texts) if t and i not in slow]
        if not rest:
            return out
        joined = "".join(texts[i] for i in rest)
        cp, offsets = tx.codes([texts[i] for i in rest])
        start, end, owner = self.cuts(cp, offsets)
        keys, at, inverse = np.unique(tx.SpanHasher(cp)(start, end), return_index=True, return_inverse=True)
        if not tx.same_spans(cp, start, end, start[at][inverse], end[at][inverse]):  # two words with one hash
            for i in rest:
                out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            return out
        if len(self.words) > CACHE:
            self.forget()
        names = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        new = [w for w in names if w not in self.words]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))[inverse]
        size = self.lengths[number]
        ends = np.cumsum(size)
        ids = self.store[np.arange(int(ends[-1])) + np.repeat(self.begins[number] - ends + size, size)]
        per_text = np.bincount(owner, size, len(rest)).astype(np.int64)
        for i, part in zip(rest, np.split(ids, np.cumsum(per_text)[:-1]), strict=True):
            out[i] = part
        return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in windows of at most ``capacity`` tokens.

    Each document's ids are followed by a separator; each id lies in exactly one piece. All windows but up to
    eleven for each ``group`` tokens are full, and those have lengths that are powers of two. A null or empty text is
    just its separator; repeated rows and ids are packed as they come; an empty table gives no pieces; other
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        part = TaskContext.get().partitionId() << 36
        n = total = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal n, total
            cols: list[list] = [[] for _ in range(7)]
            for w in pack_cut([len(x) for x in ids], capacity):
                offset = 0
                for i, at, size in w:
                    row = (names[i], at, size, zlib.crc32(ids[i][at : at + size].astype("<u4").tobytes()), len(ids[i]), part + n, offset)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += size
                n += 1
            ids.clear()
            names.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for piece, texts in tx.blocks(batch):
                for name, x in zip(piece.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids.append(np.append(x, np.uint32(SEPARATOR)))
                    names.append(name)
                    total += len(ids[-1])
                    if total >= group:
                        yield flush()
        if ids:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
