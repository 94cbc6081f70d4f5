"""File scans: rescan cache, digests, zip members, container headers."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.store import digests


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime_ms, size, content) of every file below a folder; content is read only if selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) is not in the rescan cache."""
    return files.join(known.select("path", "mtime_ms", "size"), ["path", "mtime_ms", "size"], "left_anti")


def ingest(files: DataFrame) -> DataFrame:
    """(path, mtime_ms, size, crc32, md5, sha1, sha256) in one pass."""
    return digests(files.drop("size"), F.col("content")).select("path", "mtime_ms", "size", "crc32", "md5", "sha1", "sha256")


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, method, offset, packed, size, crc32, note): central directories of zip files, without unpacking.

    offset is where a member's data starts in the file; members neither stored nor
    deflated, encrypted members and unreadable files carry a note instead.
    """
    names = ["path", "member", "method", "offset", "packed", "size", "crc32", "note"]

    def members(path: str, data: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if m.is_dir():
                        continue
                    at = m.header_offset
                    name_len, extra_len = struct.unpack_from("<HH", data, at + 26)
                    note = None if m.compress_type in (0, 8) and not m.flag_bits & 1 else "skipped"
                    yield path, m.filename, {0: "stored", 8: "deflate"}.get(m.compress_type, str(m.compress_type)), at + 30 + name_len + extra_len, m.compress_size, m.file_size, f"{m.CRC:08x}", note
        except (zipfile.BadZipFile, struct.error) as bad:
            yield path, None, None, None, None, None, None, f"unreadable: {bad}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in members(p, c)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, member string, method string, offset long, packed long, size long, crc32 string, note string")


def disk_header(content) -> dict:
    """Columns of a compressed-disk-image v5 header: version, declared sha1, whether it has a parent."""
    tag = F.substring(content, 1, 8) == F.lit(b"MComprHD")
    version = F.conv(F.hex(F.substring(content, 13, 4)), 16, 10).cast("int")
    parent = F.hex(F.substring(content, 105, 20))
    ok = tag & (version == 5) & (F.octet_length(content) >= 124)
    return {"version": F.when(ok, version), "sha1": F.when(ok, F.lower(F.hex(F.substring(content, 85, 20)))), "has_parent": F.when(ok, parent != "0" * 40)}
