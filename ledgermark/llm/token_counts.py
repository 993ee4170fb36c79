"""Token counts by a digest cache.

Content is normalised in ways that change no count (white space runs, and case where the vocabulary ignores it) and
digested; digests are joined to the counts stored for this version of the tokenizer. Of each content that is not stored
yet one row is encoded, by the task that reads it: tasks get lists of the digests that are theirs, so texts
are not shuffled. New counts are appended to the cache, which later calls join first.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from importlib import metadata

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.tables import folder

from ._spark import bound_batches, stage, with_values

LIMIT = 2048
#: Misses up to which their digests are broadcast (32 bytes each), so that other rows stay in the JVM.
FEW = 1 << 16
#: Tasks whose lists are in one file.
LISTS = 256
#: Bytes of a text that are split into words at once; words that a worker remembers, at most, and the longest of them.
STRETCH, WORDS, LONGEST = 1 << 20, 500_000, 64
BLANKS = b" \t\n\x0b\x0c\r"
CACHE = "content binary, n_tokens long"


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """What counts depend on besides the text: the vocabulary file and the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {metadata.version(library)}".encode()).hexdigest()


def folds(path: str) -> list[str] | None:
    """The special strings of a vocabulary that lower-cases text and drops white space, the two things that ``normalised``
    levels out; None for one that does not do both."""
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    lowers = {"type": "Lowercase"} in steps and {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in steps
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "")
    special = made.get("added_tokens", [])
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in special)
    return [t["content"] for t in special] if lowers and drops and plain else None


def normalised(text: Column, special: list[str] | None) -> Column:
    """Text that has as many tokens and is equal for more rows: null is empty; if the vocabulary folds, runs of ASCII white
    space are one blank, none at the ends, and A-Z is lower-cased, but not where that could matter: beside a combining mark
    (which may compose with one case only), or where a special string would come about."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if special is None:
        return text
    told = "|".join(f"\\Q{s}\\E" for s in special)
    pattern = "[\\u0300-\\u036F]" + (f"|(?i:{told})" if told else "")
    level = F.trim(F.regexp_replace(text, r"[\t-\r ]++", " "))
    return F.when(text.rlike(pattern), level).otherwise(F.translate(level, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@functools.lru_cache(2)  # tasks of one worker share what it has read and remembers
def counter(path: str) -> Callable[[str], int]:
    """Function that counts a text's tokens as the library does. A vocabulary that drops white space is asked for
    each distinct word once, since no token reaches across; a word's count is remembered."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()

    def ask(text: str) -> int:
        return len(whole.encode(text, add_special_tokens=False).ids)

    if folds(path) is None:
        return ask
    known: dict[bytes, int] = {}

    def count(text: str) -> int:
        data, at, n = text.encode("utf-8", "replace"), 0, 0
        while at < len(data):
            end = at + STRETCH
            while end < len(data) and data[end] not in BLANKS:
                end += 1
            for word in data[at:end].split():
                m = known.get(word)
                if m is None:
                    m = ask(word.decode())
                    if len(known) >= WORDS:
                        known.clear()
                    if len(word) <= LONGEST:
                        known[word] = m
                n += m
            at = end
        return n

    return count


def cached(spark: SparkSession, cache: str, made: str) -> DataFrame:
    """content and n_tokens that the cache holds for a version, a row for each content; none if there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={made}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    # two writers may have stored the same content
    return spark.read.schema(CACHE).parquet(f"{cache}/tokenizer={made}").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _append(rows: DataFrame, cache: str, made: str) -> None:
    rows.write.mode("append").parquet(f"{cache}/tokenizer={made}")


def _encoded(rows: DataFrame, path: str, lists: str | None) -> DataFrame:
    """content and n_tokens of ``rows`` (content, text): of those on the task's list, once each, or of all without lists."""

    def own(part: int) -> set[bytes]:
        uri = f"{lists}/group={part // LISTS}"
        store, base = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        files = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")]
        if not files:
            return set()
        return set(dataset.dataset(files, filesystem=store, format="parquet").to_table(["content"], filter=dataset.field("part") == part).column(0).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = own(TaskContext.get().partitionId()) if lists else None
        count = counter(path)
        for batch in batches:
            keys, found, counts = batch.column(0).to_pylist(), [], []
            for i, key in enumerate(keys):
                if wanted is None or key in wanted:
                    if wanted is not None:
                        wanted.discard(key)
                    found.append(key)
                    counts.append(count(batch.column(1)[i].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return rows.mapInArrow(run, CACHE)


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs`` (doc_id, text).

    ``cache`` is a folder that keeps counts between calls, by tokenizer version; without one the cache lives as long as
    the tables of this process. A null or empty text, or one of white space that the vocabulary drops, has no tokens; texts
    are counted whole, however long; equal texts are encoded once, and not at all if they are stored; repeated rows and null
    ids are rows like others; an empty table gives no rows and stores nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = tokenizer_path or tokenizer("word_bpe_49k.json")
    made, special = version(path), folds(path)
    cache = cache or folder(spark, "token-cache")
    plain = normalised(F.col("text"), special)
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"), plain.alias("text"))
    digest = F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = stage(text.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), digest.alias("content"), F.spark_partition_id().alias("part")), "digests")

    def missing() -> DataFrame:
        """Distinct contents that are not stored, each with the first task that reads it."""
        first = rows.where("content is not null").groupBy("content").agg(F.min("part").alias("part"))
        return first.join(cached(spark, cache, made), "content", "left_anti")

    todo = stage(missing(), "misses")
    misses = todo.count()
    if misses:
        lists = folder(spark, "lists")
        group = F.floor(F.col("part") / LISTS)
        todo.withColumn("group", group).repartition("group").sortWithinPartitions("group", "part").write.partitionBy("group").parquet(lists)
        texts = text.select(digest.alias("content"), "text")
        read = texts.join(F.broadcast(todo.select("content")), "content", "left_semi") if misses <= FEW else texts
        _append(_encoded(read, path, lists), cache, made)
        rest = stage(missing().select("content"), "rest")
        if not rest.isEmpty():  # the input was dealt out otherwise the second time (executors came or went)
            again = texts.join(rest, "content").groupBy("content").agg(F.first("text").alias("text"))
            _append(_encoded(again, path, None), cache, made)
    counts = cached(spark, cache, made)
    n = F.coalesce("n_tokens", F.lit(0).cast("long"))
    return with_values(rows.drop("part"), counts, "content").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
