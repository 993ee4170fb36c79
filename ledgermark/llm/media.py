"""Media columns: content-addressed payloads in tar shards.

Each distinct payload is one member of one shard, named by its digest: a first pass over the digests alone finds those
that several tasks will meet, and all but one of these tasks leave them out. Rows carry digest, shard, offset
and length. Members are read back by range: the first bytes of a member's header fill the metadata columns,
the whole member gives back the payload. A payload is stored as an 8-bit grey PNG, 64 samples a row.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.tables import folder as shared_folder

from ._spark import bound_batches, stage

WIDTH = 64
#: Bytes after which a shard is closed.
SHARD = 48 << 20
#: Bytes of members, and rows, that a task reads back; rows of one shard are spread over so many tasks.
READ, READ_ROWS, SPREAD = 32 << 20, 1 << 18, 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a PNG up to the end of its header chunk.
HEADER = 33


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, continued by zeros to a positive multiple of the width."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(data: bytes) -> bytes:
    """PNG of a payload whose length is a positive multiple of the width."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def decode(stored: bytes) -> bytes:
    """The payload of a PNG that ``encode`` wrote; chunks are checked."""
    width, height, _ = header(stored)
    at, parts = 8, []
    while at < len(stored):
        size = struct.unpack(">I", stored[at : at + 4])[0]
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean and entropy (bits) of the samples, and a 16-bit pattern: which sixteenths of the payload are brighter than the mean."""
    x = np.frombuffer(data, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    mean = float(x.mean())
    bits = "".join("1" if part.mean() > mean else "0" for part in np.array_split(x, 16))
    return f"mean={mean:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};pattern={int(bits, 2):04x}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def digest(text: str = "text") -> Column:
    """SHA-256 of a text's payload, lower-case hexadecimal, computed by the JVM."""
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    pad = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.sha2(F.concat(data, F.substring(F.unhex(F.lit("00" * WIDTH)), F.lit(1), pad)), 256)


def _left_out(store: fs.FileSystem, folder: str, part: int) -> set[str]:
    """Digests that another task stores; no more than this task's own rows."""
    files = store.get_file_info(fs.FileSelector(f"{folder}/part={part}", allow_not_found=True, recursive=True))
    return {d for f in files if f.path.endswith(".parquet") for d in pq.read_table(f.path, filesystem=store, columns=["digest"]).column(0).to_pylist()}


def _write(rows: DataFrame, folder: str, others: str | None) -> DataFrame:
    """Store what ``rows`` (doc_id, text) hold but for what the list ``others`` leaves to other tasks; a row for each:
    doc_id, n_bytes, digest, and shard, offset and length, null for what another task stores.

    Shards bear the attempt's number in their names, so no attempt touches what another one wrote, and rows of
    the attempt that counts name its own shards."""
    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        elsewhere = _left_out(store, _store(others)[1], part) if others else set()
        known: dict[str, tuple[str | None, int | None, int | None]] = dict.fromkeys(elsewhere, (None, None, None))
        members: list[bytes] = []
        rows: list[tuple] = []
        at = n = 0

        def close() -> pa.RecordBatch:
            nonlocal at, n
            if members:
                with store.open_output_stream(f"{base}/part-{part:06d}-{attempt}-{n:05d}.tar") as out:
                    for m in members:
                        out.write(m)
                    out.write(bytes(2 * tarfile.BLOCKSIZE))
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
            members.clear()
            rows.clear()
            at, n = 0, n + 1
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = payload(text)
                key = hashlib.sha256(data).hexdigest()
                if key not in known:
                    stored = encode(data)
                    info = tarfile.TarInfo(f"{key}.png")
                    info.size = len(stored)
                    head = info.tobuf(tarfile.PAX_FORMAT)
                    known[key] = (f"part-{part:06d}-{attempt}-{n:05d}.tar", at + len(head), len(stored))
                    members += [head, stored, bytes(-len(stored) % tarfile.BLOCKSIZE)]
                    at += sum(map(len, members[-3:]))
                rows.append((name, len((text or "").encode("utf-8", "surrogatepass")), key, *known[key]))
                if at >= SHARD or len(rows) >= 1 << 16:
                    yield close()
        if rows:
            yield close()

    return stage(rows.mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "manifest")


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Manifest of ``docs`` (doc_id, text): doc_id, n_bytes, digest, shard, offset and length of the stored form."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # of the tasks that meet a payload the first stores it; the others find it in their list
    met = rows.select(digest().alias("digest"), F.spark_partition_id().alias("part")).groupBy("digest").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    others = shared_folder(docs.sparkSession, "elsewhere")
    met.where("size(parts) > 1").select("digest", F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("part")).repartition("part").write.partitionBy("part").parquet(others)
    manifest = _write(rows, folder, others)
    found = manifest.where("shard is not null")
    lost = manifest.where("shard is null")
    wanted = lost.select("digest").distinct()
    none = wanted.join(found.select("digest"), "digest", "left_anti")
    if not none.isEmpty():
        # the input was dealt out otherwise the second time (executors came or went): what no task stored is stored now
        again = rows.withColumn("digest", digest()).join(none, "digest").dropDuplicates(["digest"]).select("doc_id", "text")
        found = found.union(_write(again, folder, None).where("shard is not null"))
    place = found.join(wanted, "digest").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("x")).select("digest", "x.*")
    # a payload with many copies is joined in so many tasks
    place = place.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    lost = lost.select("doc_id", "n_bytes", "digest", F.pmod(F.xxhash64("doc_id", "n_bytes"), F.lit(SPREAD)).cast("int").alias("part"))
    return manifest.where("shard is not null").unionByName(lost.join(place, ["digest", "part"]).drop("part"))


def read_columns(manifest: DataFrame, folder: str) -> DataFrame:
    """``manifest`` with the columns that its members give when they are read back. Tasks get rows by shard, about
    ``READ`` bytes of members or ``READ_ROWS`` rows each, and a shard's rows are spread over up to ``SPREAD`` of them."""
    bound_batches(manifest.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "shard", "offset", "length"]
    manifest = stage(manifest, "places")
    size, count = manifest.agg(F.sum("length"), F.count("*")).first()
    tasks = max(1, -(-(size or 0) // READ), -(-count // READ_ROWS))
    manifest = manifest.repartition(tasks, "shard", F.pmod(F.xxhash64("doc_id", "n_bytes"), F.lit(SPREAD))).sortWithinPartitions("shard", "offset")

    text = {"payload_sha256", "media_sha256", "feature", "shard"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, file = None, None
        for batch in batches:
            rows: list[tuple] = []
            seen: dict[str, tuple] = {}
            for r in batch.to_pylist():
                if r["digest"] not in seen:
                    if r["shard"] != name:
                        if file:
                            file.close()
                        name, file = r["shard"], store.open_input_file(f"{base}/{r['shard']}")
                    width, height, depth = header(file.read_at(min(HEADER, r["length"]), r["offset"]))
                    stored = file.read_at(r["length"], r["offset"])
                    data = decode(stored)
                    key = hashlib.sha256(data).hexdigest()
                    if key != r["digest"]:
                        raise ValueError(f"payload of {name} at {r['offset']} is not what was stored")
                    seen[key] = (len(data), key, zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data), width, height, depth)
                rows.append((r["doc_id"], r["n_bytes"], *seen[r["digest"]], r["shard"], r["offset"], r["length"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in text else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)
        if file:
            file.close()

    return manifest.mapInArrow(run, ", ".join(f"{n} {'string' if n in text else 'long'}" for n in names))


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Metadata and features of every row of ``docs`` (doc_id, text), stored in tar shards of ``folder`` and read back, with each
    payload's shard, offset and length. Without a folder the shards go where other tables go and are removed with them.

    Equal payloads have equal values, and one member of one shard holds each. A null or empty text is one row of zeros; a long one is a
    tall image; repeated rows and null ids are rows like others; an empty table writes nothing and gives no
    rows. Other columns are ignored.
    """
    folder = folder or shared_folder(docs.sparkSession, "media")
    return read_columns(write_shards(docs, folder), folder)
