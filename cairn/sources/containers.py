"""Containers that hold other files: layouts as coverage maps, sealed packs, and archives told by their first bytes.

A layout is exact or refused: its pieces and gaps cover the container once, from the first byte to the last.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First bytes of archives that need a codec of their own.
ARCHIVES = {"7z": b"7z\xbc\xaf\x27\x1c", "rar4": b"Rar!\x1a\x07\x00", "rar5": b"Rar!\x1a\x07\x01\x00", "zip": b"PK\x03\x04"}
#: Bytes of a gap that is kept as a literal; a longer one has to be a fill or a piece.
LITERAL = 4096


class Refused(ValueError):
    """The bytes are no container of this kind, or one that a layout cannot describe."""


def archive_kind(head: Column) -> Column:
    """What kind of archive a file is by its first bytes; null if none."""
    out = F.lit(None).cast("string")
    for kind, magic in ARCHIVES.items():
        out = F.when(F.substring(head, 1, len(magic)) == F.lit(magic), kind).otherwise(out)
    return out


def coverage(data: bytes, pieces: list[tuple[str, int, int]]) -> Iterator[tuple[str, str, int, int, int | None]]:
    """(kind, name, start, len, fill) that tile the container: its pieces, and what lies between them as fills and literals."""
    at = 0
    ordered = sorted(pieces, key=lambda p: (p[1], p[0]))
    for name, start, size in [*ordered, ("", len(data), 0)]:
        if start < at:
            raise Refused(f"{name} overlaps the piece before it")
        if start > at:
            gap = data[at:start]
            if gap.count(gap[0]) == len(gap):
                yield "fill", "", at, len(gap), gap[0]
            else:
                for part in range(0, len(gap), LITERAL):
                    yield "literal", "", at + part, min(LITERAL, len(gap) - part), None
        if size:
            yield "piece", name, start, size, None
        at = start + size
    if at != len(data):
        raise Refused("a piece runs past the end")


def narc_layout(data: bytes) -> list[tuple[str, int, int]]:
    """(name, start, len) of the members of a nested archive: a header, then blocks that state their own sizes.

    The table block holds each member's start and end in the image block; empty members have no bytes and are left out.
    """
    if len(data) < 16 or data[:4] != b"NARC" or data[4:6] != b"\xfe\xff":
        raise Refused("no archive of this kind")
    at, n_blocks = struct.unpack_from("<HH", data, 12)
    if at < 16 or at > len(data) or n_blocks < 3:
        raise Refused("its header is out of bounds")
    table, image = None, None
    for _ in range(n_blocks):
        if at + 8 > len(data):
            raise Refused("a block starts past the end")
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if size < 8 or at + size > len(data):
            raise Refused("a block's size is out of bounds")
        if kind == b"BTAF":
            (count,) = struct.unpack_from("<H", data, at + 8)
            if 12 + 8 * count > size:
                raise Refused("its table exceeds the block")
            table = [struct.unpack_from("<II", data, at + 12 + 8 * i) for i in range(count)]
        elif kind == b"GMIF":
            image = at + 8
        elif kind != b"BTNF":
            raise Refused(f"unknown block {kind!r}")
        at += size
    if not table or image is None:
        raise Refused("it has no members")
    pieces = []
    for i, (start, end) in enumerate(table):
        if end < start or image + end > len(data):
            raise Refused(f"member {i} is out of bounds")
        if end > start:
            pieces.append((f"narc/{i:05}.bin", image + start, end - start))
    return pieces


def cartridge_layout(data: bytes) -> list[tuple[str, int, int]]:
    """(name, start, len) of the parts of a cartridge image of the dual-screen kind: its two programs, their overlays' and the file table's entries, and the tables.

    The header gives offsets and sizes: programs at 0x20 and 0x30, the name table at 0x40, the file table at 0x48, overlay tables at 0x50 and 0x58, the banner at 0x68.
    """
    if len(data) < 0x200:
        raise Refused("shorter than the header")
    from cairn.operators.byteops import crc16

    if struct.unpack_from("<H", data, 0x15E)[0] != crc16(data[:0x15E]):
        raise Refused("the header's checksum is wrong")

    def word(at: int) -> int:
        return struct.unpack_from("<I", data, at)[0]

    parts = [("header", 0, 0x200), ("arm9.bin", word(0x20), word(0x2C)), ("arm7.bin", word(0x30), word(0x3C)), ("names", word(0x40), word(0x44)), ("files", word(0x48), word(0x4C)), ("overlays9", word(0x50), word(0x54)), ("overlays7", word(0x58), word(0x5C))]
    table, size = word(0x48), word(0x4C)
    if size % 8 or table + size > len(data):
        raise Refused("the file table is out of bounds")
    for i in range(size // 8):
        start, end = struct.unpack_from("<II", data, table + 8 * i)
        if end < start or end > len(data):
            raise Refused(f"file {i} is out of bounds")
        if end > start:
            parts.append((f"file/{i:05}.bin", start, end - start))
    out = [p for p in parts if p[2]]
    if any(start + n > len(data) for _, start, n in out):
        raise Refused("a part runs past the end")
    return out


LAYOUTS: dict[str, Callable[[bytes], list[tuple[str, int, int]]]] = {"narc": narc_layout, "cartridge": cartridge_layout}


def layouts(files: DataFrame, kind: str, key: str = "path", content: str = "content") -> DataFrame:
    """(key, seq, part, name, start, len, fill, note): the coverage map of every container; one row with a note for one that is refused."""
    layout = LAYOUTS[kind]

    def rows_of(one, data: bytes | None) -> list[tuple]:
        try:
            return [(one, i, *part, None) for i, part in enumerate(coverage(data or b"", layout(data or b"")))]
        except (Refused, struct.error) as bad:
            return [(one, 0, None, None, None, None, None, f"refused: {bad}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = list(zip(*rows_of(one, data), strict=True))
                kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[key, "seq", "part", "name", "start", "len", "fill", "note"])

    return files.select(key, F.col(content).cast("binary").alias(content)).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, seq int, part string, name string, start long, len long, fill int, note string")


# ---- sealed packs: members, a table of them, and a trailer that finds and proves the table

PACK_MAGIC, PACK_TRAILER = b"cairn/pack/1\n", b"CAIRNPAK"
_MEMBER = struct.Struct("<32sQQ")


def seal(members: list[bytes]) -> bytes:
    """A pack: the members back to back, a table of (sha256, offset, length), and the table's digest, length and a mark."""
    if not members:
        raise ValueError("a pack has a member at least")
    rows, at = [], 0
    for data in members:
        rows.append(_MEMBER.pack(hashlib.sha256(data).digest(), at, len(data)))
        at += len(data)
    footer = PACK_MAGIC + struct.pack("<I", len(rows)) + b"".join(rows)
    return b"".join(members) + footer + hashlib.sha256(footer).digest() + struct.pack("<Q", len(footer)) + PACK_TRAILER


def pack_members(data: bytes) -> list[tuple[str, int, int]]:
    """(sha256, offset, len) of a pack's members, or Refused: nothing of the table is believed before its digest fits."""
    if len(data) < 48 or data[-8:] != PACK_TRAILER:
        raise Refused("no trailer")
    digest, size = data[-48:-16], struct.unpack_from("<Q", data, len(data) - 16)[0]
    start = len(data) - 48 - size
    if start < 0:
        raise Refused("the table's length exceeds the file")
    footer = data[start : len(data) - 48]
    if hashlib.sha256(footer).digest() != digest:
        raise Refused("the table does not fit its digest")
    body = footer.removeprefix(PACK_MAGIC)
    if len(body) == len(footer) or len(body) < 4:
        raise Refused("no table")
    (count,) = struct.unpack_from("<I", body)
    if not count or len(body) != 4 + count * _MEMBER.size:
        raise Refused("the table's length is wrong")
    out, at = [], 0
    for i in range(count):
        sha, offset, n = _MEMBER.unpack_from(body, 4 + i * _MEMBER.size)
        if offset != at:
            raise Refused("members are not back to back")
        out.append((sha.hex(), offset, n))
        at += n
    if at != start:
        raise Refused("members do not fill the pack")
    return out


def scan_packs(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, sha256, offset, len, note): the members of every pack; one row with a note for one that is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for one, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(one, *member, None) for member in pack_members(data or b"")]
                except (Refused, struct.error) as bad:
                    rows.append((one, None, None, None, f"refused: {bad}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[key, "sha256", "offset", "len", "note"])

    return files.select(key, F.col(content).cast("binary").alias(content)).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, sha256 string, offset long, len long, note string")


@F.udf(T.BinaryType())
def seal_udf(members):
    """A pack of an array of members; row by row, since each row is a whole file."""
    return seal([bytes(m) for m in members]) if members else None
