"""Byte assembly as relations: offsets, range translation, assembly, chunking, byte orders."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def segment_offsets(segments: DataFrame, owner: str, order: list[str], length: str = "len") -> DataFrame:
    """Add the offset of every segment in its owner: an exclusive prefix sum."""
    w = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def translate(segments: DataFrame, owner: str, start: int, end: int, order: list[str], length: str = "len", source: str | None = None, source_offset: str | None = None) -> DataFrame:
    """Pieces of every owner that cover output bytes [start, end): (owner, ..., piece_start, piece_len).

    With ``source`` and ``source_offset``, pieces that continue each other in one source are merged.
    """
    placed = segment_offsets(segments, owner, order, length)
    inside = placed.where((F.col("offset") < end) & (F.col("offset") + F.col(length) > start) & (F.col(length) > 0))
    cut_left = F.greatest(F.lit(start) - F.col("offset"), F.lit(0))
    pieces = inside.withColumn("skip", cut_left).withColumn("piece_start", F.col("offset") + F.col("skip")).withColumn("piece_len", F.least(F.lit(end), F.col("offset") + F.col(length)) - F.col("piece_start"))
    if source is None:
        return pieces.drop("skip")
    w = Window.partitionBy(owner).orderBy("piece_start")
    from_at = F.col(source_offset) + F.col("skip")
    pieces = pieces.withColumn("src_start", from_at).withColumn("src_end", from_at + F.col("piece_len"))
    new = F.coalesce((F.lag(source).over(w) != F.col(source)) | (F.lag("src_end").over(w) != F.col("src_start")), F.lit(True))
    marked = pieces.withColumn("island", F.sum(new.cast("int")).over(w))
    return marked.groupBy(owner, "island", source).agg(F.min("src_start").alias("src_start"), F.min("piece_start").alias("piece_start"), F.sum("piece_len").alias("piece_len")).drop("island")


def assemble(segments: DataFrame, owner: str, order: str, data: str = "data") -> DataFrame:
    """Concatenate each owner's segments in order."""
    ordered = F.sort_array(F.collect_list(F.struct(order, data)))
    return segments.groupBy(owner).agg(ordered.alias("s")).select(owner, F.expr(f"aggregate(s, CAST('' AS binary), (a, x) -> concat(a, CAST(x.{data} AS binary)))").alias("data"))


def fixed_chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, seq, chunk): pieces of ``size`` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    seqs = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(key, text, F.explode(seqs).alias("seq")).select(key, "seq", F.substring(F.col(text), F.col("seq") * size + 1, F.lit(size)).alias("chunk"))


GEAR = None


def _gear() -> np.ndarray:
    """256 mixing constants from a rule (splitmix of the byte)."""
    global GEAR
    if GEAR is None:
        with np.errstate(over="ignore"):
            x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            GEAR = x ^ (x >> np.uint64(31))
    return GEAR


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks: a gear hash over the last 32 bytes, with a stricter mask before the average size and a looser one after."""
    n = len(data)
    if n == 0:
        return []
    gear, raw = _gear(), np.frombuffer(data, dtype=np.uint8)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for back in range(min(32, n)):  # h[i] = sum of gear[b[i - back]] << back
            h[back:] += gear[raw[: n - back]] << np.uint64(back)
    bits = max(1, average.bit_length() - 1)
    strict, loose = np.uint64((1 << bits + 1) - 1) << np.uint64(16), np.uint64((1 << max(1, bits - 1)) - 1) << np.uint64(16)
    hard, easy = np.flatnonzero(h & strict == 0), np.flatnonzero(h & loose == 0)
    out, at = [], 0
    while at < n:
        end = min(n, at + most)
        if n - at > least:
            i = np.searchsorted(hard, at + least)
            if i < len(hard) and hard[i] < min(n, at + average):
                end = min(end, int(hard[i]) + 1)
            else:
                i = np.searchsorted(easy, at + average)
                if i < len(easy):
                    end = min(end, int(easy[i]) + 1)
        out.append(end)
        at = end
    return out


def content_chunks(rows: DataFrame, key: str, data: str, least: int = 64 << 10, average: int = 256 << 10, most: int = 1 << 20) -> DataFrame:
    """(key, seq, offset, len, sha256) of content-defined chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: list[tuple] = []
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for seq, end in enumerate(cut_points(blob or b"", least, average, most)):
                    out.append((k, seq, at, end - at, hashlib.sha256(blob[at:end]).hexdigest()))
                    at = end
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())], names=[key, "seq", "offset", "len", "sha256"])

    return rows.select(key, F.col(data).cast("binary").alias(data)).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, seq int, offset long, len long, sha256 string")


def chunk_savings(chunks: DataFrame) -> DataFrame:
    """One row: bytes represented and bytes stored once chunks are shared."""
    per = chunks.groupBy("sha256").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("uses"))
    return per.agg(F.sum(F.col("len") * F.col("uses")).alias("represented"), F.sum("len").alias("stored"), F.count(F.lit(1)).alias("chunks"))


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    """Raw deflate windows to bytes; null stays null."""
    return data.map(lambda b: None if b is None else zlib.decompress(b, -15))


_FLIPPED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_ORDERS = {"byte": [1, 0], "word": [3, 2, 1, 0], "word-byte": [2, 3, 0, 1]}


def swap_bytes(data: bytes, kind: str) -> bytes:
    if kind == "bit":
        return data.translate(_FLIPPED)
    order = _ORDERS[kind]
    if len(data) % len(order):
        raise ValueError(f"{len(data)} bytes are no whole number of {len(order)}-byte units")
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, len(order))[:, order].tobytes()


def swapped(kind: str):
    """A pandas UDF that reorders bytes: bits of a byte, bytes of a pair, bytes of a group of four ("word"), or pairs of a group of four ("word-byte"). Lengths must fit the unit."""

    def swap(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else swap_bytes(b, kind))

    return F.pandas_udf(swap, T.BinaryType())


def crc16_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xA001 if c & 1 else c >> 1
        out.append(c)
    return out


CRC16 = crc16_table()


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0xA001 (reflected) and start 0xFFFF, byte by byte through a table."""
    c = 0xFFFF
    for b in data:
        c = c >> 8 ^ CRC16[(c ^ b) & 0xFF]
    return c


@F.pandas_udf(T.IntegerType())
def crc16_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else crc16(b)).astype("Int32")



# One-letter codes of regions.
REGION_CODES = {"usa": "U", "europe": "E", "japan": "J", "world": "W", "france": "F", "germany": "G", "spain": "S", "italy": "I", "australia": "A", "korea": "K", "china": "C", "netherlands": "N", "brazil": "B"}
_COLLECTION = re.compile(r"^[0-9]+(?: games)? in [0-9]+!? - (?=.)", re.I | re.S)
_GROUP = re.compile(r"\(([^)]*)\)")
_JUNK = re.compile(r"(?:[ .\-]|\(\)|\[\])+$")


def split_extension(name: str) -> tuple[str, str]:
    """The stem, and the extension with its dot; a name that starts with its only dot, or has over 16 bytes after it, has none."""
    stem, dot, ext = name.rpartition(".")
    return (stem, dot + ext) if stem and len(ext.encode()) <= 16 else (name, "")


def region_codes(name: str) -> str:
    """Groups in parentheses that hold regions only, in one-letter codes."""

    def short(found: re.Match) -> str:
        codes = [REGION_CODES.get(x.strip().lower()) for x in found[1].split(",")]
        return "(" + ",".join(codes) + ")" if all(codes) else found[0]

    return _GROUP.sub(short, name)


def fit_component(name: str, most: int) -> str:
    """A file name in at most ``most`` bytes of UTF-8.

    Rules are tried in turn until it fits: drop "N Games in N! - ", write regions in codes, drop junk at the
    stem's end; then the stem is cut at a character boundary. The extension stays.
    """
    for rule in (lambda n: n, lambda n: _COLLECTION.sub("", n), region_codes, lambda n: (lambda s, e: (_JUNK.sub("", s) or "_") + e)(*split_extension(n))):
        name = rule(name)
        if len(name.encode()) <= most:
            return name
    stem, ext = split_extension(name)
    room = max(1, most - len(ext.encode()))
    return (stem.encode()[:room].decode(errors="ignore") or stem[:1]) + ext


def fit_component_udf(most: int):
    """fit_component() for every component of a path column."""

    def fit(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else p if len(p.encode()) <= most else "/".join(fit_component(c, most) for c in p.split("/")))

    return F.pandas_udf(fit, T.StringType())


# ---- assembly of outputs from slices of inputs, fills and literals

#: Bytes of a literal, at most.
LITERAL_BYTES = 4096
SEGMENT = "owner, seq, source, offset, len, fill, literal"


def checked_segments(segments: DataFrame) -> DataFrame:
    """SEGMENT rows with their kind and length, or an error for a row that no recipe may hold.

    A segment is a slice of a source (source, offset, len), a byte repeated (fill, len) or a literal. Empty ones and literals over LITERAL_BYTES are refused.
    """
    kind = F.when(F.col("source").isNotNull(), "slice").when(F.col("fill").isNotNull(), "fill").when(F.col("literal").isNotNull(), "literal")
    length = F.when(kind == "literal", F.octet_length("literal").cast("long")).otherwise(F.col("len").cast("long"))
    several = F.col("source").isNotNull().cast("int") + F.col("fill").isNotNull().cast("int") + F.col("literal").isNotNull().cast("int")
    wrong = F.when(several != 1, "a segment has one kind").when(F.coalesce(length, F.lit(0)) <= 0, "a segment is empty").when((kind == "literal") & (length > LITERAL_BYTES), "a literal is too long").when((kind == "slice") & (F.coalesce("offset", F.lit(-1)) < 0), "an offset is negative").when((kind == "fill") & ~F.col("fill").between(0, 255), "a fill is no byte")
    return segments.withColumn("kind", F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("invalid segment: "), wrong))).otherwise(kind)).withColumn("len", length)


def output_sizes(segments: DataFrame) -> DataFrame:
    """(owner, size): what each owner's segments add up to."""
    return checked_segments(segments).groupBy("owner").agg(F.sum(F.when(F.col("kind").isNotNull(), F.col("len"))).alias("size"))


def assemble_segments(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner, data) from SEGMENT rows and sources(source, data): each owner's segments, one after another.

    A slice beyond its source, or of an unknown one, is an error. An output is one row and is gathered whole; bounds are the caller's, as an output's size is
    known before (output_sizes()).
    """
    checked = checked_segments(segments)
    joined = checked.join(sources.select("source", F.col("data").cast("binary").alias("__data")), "source", "left")
    short = (F.col("kind") == "slice") & (F.coalesce(F.octet_length("__data").cast("long"), F.lit(-1)) < F.col("offset") + F.col("len"))
    piece = F.expr("substring(__data, CAST(offset AS int) + 1, CAST(len AS int))")
    filled = F.unhex(F.repeat(F.lpad(F.hex(F.col("fill")), 2, "0"), F.col("len").cast("int")))
    data = F.when(short, F.raise_error(F.lit("a slice exceeds its source"))).when(F.col("kind") == "slice", piece).when(F.col("kind") == "fill", filled).otherwise(F.col("literal"))
    return assemble(joined.select("owner", "seq", data.alias("data")), "owner", "seq")


def serve_range(data: DataFrame, key: str, start: int, end: int, blob: str = "data") -> DataFrame:
    """(key, data): bytes [start, end) of every row's blob, shorter where it ends before."""
    return data.select(key, F.substring(F.col(blob).cast("binary"), F.lit(start + 1), F.lit(max(0, end - start))).alias("data"))


def outboard(rows: DataFrame, key: str, data: str, group: int = 16 << 10) -> DataFrame:
    """(key, seq, len, sha256) per group of bytes, so that a range can be verified without the rest; an empty blob has no groups."""
    blob = F.col(data).cast("binary")
    n = F.ceil(F.octet_length(blob) / group).cast("int")
    cuts = rows.select(F.col(key), blob.alias("__b"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("seq"))
    piece = F.substring(F.col("__b"), F.col("seq") * group + 1, F.lit(group))
    return cuts.select(key, "seq", F.octet_length(piece).cast("long").alias("len"), F.sha2(piece, 256).alias("sha256"))


# ---- operations by name

OPERATIONS: dict[str, object] = {}


def operation(name: str):
    """Register a column function under name@version: a recipe names it, and its outcome is stored with that name."""

    def add(fn):
        if name in OPERATIONS:
            raise ValueError(f"operation {name!r} is registered already")
        OPERATIONS[name] = fn
        return fn

    return add


operation("identity@1")(lambda c: c)
operation("deflate-decompress@1")(lambda c: inflate(c))
for _kind in ("bit", "byte", "word", "word-byte"):
    operation(f"swap-{_kind}@1")(lambda c, kind=_kind: swapped(kind)(c))


def apply_operations(rows: DataFrame, op: str = "op", data: str = "data") -> DataFrame:
    """Rows with ``data`` run through the operation that each names; an unknown name is an error. One pass per operation, over its rows only."""
    known = F.when(F.col(op).isin(*OPERATIONS), F.col(op)).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.col(op))))
    checked = rows.withColumn(op, known)
    return reduce(DataFrame.unionByName, (checked.where(F.col(op) == name).withColumn(data, fn(F.col(data))) for name, fn in OPERATIONS.items()))
