"""Blocks of documents as arrays, and an exchange of their dictionaries.

A block is a bounded run of documents of one task. Its words get local numbers,
so documents become integer arrays and each distinct word is held once per
block. What has to meet across blocks (the words) is dealt by hash into parts, one
compressed row per block and part, and what comes back is sent to the block.
A frequent word thus costs one entry per block, however often it occurs, and no
group grows with the number of documents that share a key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 10_000_000

ROW_SCHEMA = "slot long, block string, kind int, part int, payload binary"
HEADER, WORDS, DOCS, STATS = 0, 1, 2, 3


def pack(*fields: bytes) -> bytes:
    sizes = np.array([len(f) for f in fields], dtype=np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(bytes([len(fields)]) + sizes + b"".join(fields))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = raw[0]
    sizes = np.frombuffer(raw, dtype=np.uint32, count=n, offset=1)
    at, out = 1 + 4 * n, []
    for size in sizes.tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers byte by byte: high bytes compress to almost nothing."""
    wide = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    used = max(1, int(values.max()).bit_length() + 7 >> 3) if len(values) else 1
    return bytes([used]) + np.ascontiguousarray(wide[:, :used].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    used = data[0]
    parts = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((parts.shape[1], 8), dtype=np.uint8)
    out[:, :used] = parts.T
    return out.view("<u8").ravel()


def ragged(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the concatenated slices ``picks`` of a ragged array, and each slice's length."""
    starts = offsets[picks]
    lengths = offsets[picks + 1] - starts
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift, lengths


class Numbers(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Block:
    """Documents whose tokens are numbered in ``words``."""

    def __init__(self):
        self.words, self.ids, self.tokens, self.chars, self.extra = Numbers(), [], [], 0, []
        self.seal, self.id_type = 0, pa.int64()

    def add(self, key, text: str, tokens: np.ndarray, extra=None) -> None:
        self.ids.append(key)
        self.tokens.append(tokens)
        self.extra.append(extra)
        self.chars += len(text) + 64
        self.seal = zlib.crc32(text[:64].encode(), zlib.crc32(repr((key, len(text))).encode(), self.seal))

    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], dtype=np.int64)

    def flat(self) -> np.ndarray:
        return np.concatenate(self.tokens).astype(np.int64) if self.tokens else np.zeros(0, np.int64)


def word_tokens(block: Block, text: str) -> np.ndarray:
    """Numbers of the words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case."""
    words = text.encode().lower().split()
    return np.fromiter(map(block.words.__getitem__, words), dtype=np.uint32, count=len(words))


def blocks_of(batches: Iterator[pa.RecordBatch], tokens: Callable[[Block, str], np.ndarray], most: int = BLOCK_CHARS, new: Callable[[], Block] = Block) -> Iterator[Block]:
    """Cut a task's (id, text, ...) rows into blocks; null texts count as empty. A third column is kept per document."""
    block = new()
    for batch in batches:
        block.id_type = batch.schema.field(0).type
        columns = [c.to_pylist() for c in batch.columns]
        more = columns[2] if len(columns) > 2 else [None] * batch.num_rows
        for key, text, extra in zip(columns[0], columns[1], more, strict=True):
            text = text or ""
            if block.ids and block.chars + len(text) > most:
                yield block
                block = new()
                block.id_type = batch.schema.field(0).type
            block.add(key, text, tokens(block, text), extra)
    if block.ids:
        yield block


def word_hashes(block: Block) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in block.words), dtype=np.uint64, count=len(block.words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ids_to_bytes(ids: list, id_type: pa.DataType) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(ids, id_type)], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def ids_from_bytes(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
    slot, block, kind, part, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(slot, pa.int64()), pa.array(block, pa.string()), pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(payload, pa.binary())], names=["slot", "block", "kind", "part", "payload"]
    )


def dictionary_rows(block: Block, name: str, n_parts: int, encode: Callable[[object], bytes], word_extra: np.ndarray | None = None, doc_tokens: int = 1_000_000) -> Iterator[tuple]:
    """A block as rows: its words dealt over parts, and its documents as arrays of ranks by falling frequency."""
    flat, lengths = block.flat(), block.lengths()
    n = len(block.words)
    by_count = np.argsort(-np.bincount(flat, minlength=n), kind="stable")
    rank = np.empty(n, dtype=np.uint32)
    rank[by_count] = np.arange(n)
    ranks = rank[flat]
    del flat
    data = [encode(w) for w in block.words]
    part = np.fromiter((zlib.crc32(d) % n_parts for d in data), dtype=np.int64, count=n)[by_count]
    yield zlib.crc32(name.encode()), name, HEADER, -1, pack(planes(part))
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in range(n_parts):
        picked = by_count[order[bounds[p] : bounds[p + 1]]]
        if len(picked):
            words = [data[i] for i in picked.tolist()]
            more = [] if word_extra is None else [planes(word_extra[picked])]
            yield p, name, WORDS, p, pack(planes(np.array([len(w) for w in words])), b"".join(words), *more)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, base + doc_tokens, side="right")))
        extra = [np.array(block.extra[first:last], dtype="<f8").tobytes()] if block.extra[first] is not None else []
        yield zlib.crc32(name.encode()), name, DOCS, first, pack(ids_to_bytes(block.ids[first:last], block.id_type), planes(lengths[first:last]), planes(ranks[base : ends[last - 1]]), *extra)
        first = last


def words_of(fields: list[bytes]) -> list[bytes]:
    ends = np.cumsum(from_planes(fields[0]).astype(np.int64)).tolist()
    data, at, out = fields[1], 0, []
    for end in ends:
        out.append(data[at:end])
        at = end
    return out


def part_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deal(rows: DataFrame, n_parts: int, key: str, *order: str) -> DataFrame:
    """Hash-partition block rows and, where asked, sort them within a task."""
    small_batches(rows.sparkSession)
    out = rows.repartition(n_parts, F.col(key))
    return out.sortWithinPartitions(*order) if order else out
