"""Bulk archives (ZIP) that executors read and write: one task reads an archive's directory, and as many as the members' size
calls for inflate them by their byte ranges."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "archive string, name string, modified string, offset long, stored long, size long, crc long, method int"
#: Stored bytes that a task inflates (about), and inflated bytes of a batch.
READ, BATCH = 32 << 20, 8 << 20
#: Entries of a batch; bytes of a member's own header before its name.
ROWS, HEAD = 4096, 30


def _open(path: str) -> pa.NativeFile:
    store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(name)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Archives that a path or glob names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().toString().replace("file:/", "file:///", 1) if f.getPath().toString().startswith("file:/") else f.getPath().toString() for f in found)


def entries(spark: SparkSession, archives: Iterable[str]) -> DataFrame:
    """A row for each member of the archives: its name, time stamp, and where its bytes are. Each directory is read by one task."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with _open(archive) as f, zipfile.ZipFile(f) as z:
                    members = [i for i in z.infolist() if not i.is_dir()]
                    for a in range(0, len(members), ROWS):
                        rows = [(archive, i.filename, "{:04}-{:02}-{:02}T{:02}:{:02}:{:02}".format(*i.date_time), i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in members[a : a + ROWS]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    paths = sorted(set(archives))
    table = spark.createDataFrame([(p,) for p in paths], "archive string")
    return table.repartition(max(1, len(paths)), "archive").mapInArrow(run, ENTRIES)


def members(found: DataFrame) -> DataFrame:
    """name, modified and content (UTF-8 text) of the members in ``found`` (rows of ``entries``). Tasks get neighbouring members,
    about ``READ`` stored bytes each. A damaged member stops the job."""
    total = found.agg(F.sum("stored")).first()[0] or 0
    dealt = found.repartitionByRange(max(1, -(-total // READ)), "archive", "offset").sortWithinPartitions("archive", "offset")
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def inflated(f: pa.NativeFile, r: dict) -> str:
        head = f.read_at(HEAD, r["offset"])
        if head[:4] != b"PK\x03\x04" or r["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{r['archive']}: no member that can be read at {r['offset']} ({r['name']})")
        begin = r["offset"] + HEAD + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        data = f.read_at(r["stored"], begin)
        if r["method"] == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -zlib.MAX_WBITS)
        if len(data) != r["size"] or zlib.crc32(data) != r["crc"]:
            raise ValueError(f"{r['archive']}: {r['name']} is damaged")
        return data.decode("utf-8-sig", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            held = 0
            for r in (dict(zip(names, row, strict=True)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if r["archive"] != path:
                    if f:
                        f.close()
                    path, f = r["archive"], _open(r["archive"])
                out.append((r["name"], r["modified"], inflated(f, r)))
                held += r["size"]
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["name", "modified", "content"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["name", "modified", "content"])
        if f:
            f.close()

    return dealt.select(*names).mapInArrow(run, "name string, modified string, content string")


def write(docs: DataFrame, folder: str, modified: tuple[int, int, int, int, int, int]) -> DataFrame:
    """Put documents (name, content) into archives below ``folder``, one for each task, member by member; archive and members
    of each. An archive's name bears the attempt's number, so that no attempt touches what another wrote; those that
    are returned count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.zip"
        n = 0
        with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for member, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    info = zipfile.ZipInfo(member, modified)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    z.writestr(info, content)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["archive", "members"])

    return docs.select("name", "content").mapInArrow(run, "archive string, members long")
