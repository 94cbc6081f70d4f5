"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

1. Each task cuts its texts into blocks and numbers the block's distinct
   pre-tokens; a document is then the array of its pre-tokens' numbers, which are
   their positions' contents.
2. The distinct pre-tokens of all blocks are dealt by hash: every pre-token meets
   its copies from other blocks in one task, which encodes it with the tiktoken library and remembers
   it (bounded: up to 1.5 million of them, and none over 48 characters, which are encoded once a block). Documents'
   arrays ride along untouched, so texts are tokenised once only.
3. The ids go back to the blocks they came from and are put in place by position.
   Decoding looks the ids up in the token-byte table.

Two shuffles, of a few tenths of the compressed input each; no text is shuffled.
Memory per task: one block, or the distinct words of one hash part.

Null texts count as empty (no tokens); null ids are carried through; repeated
rows stay repeated; other columns are ignored; an empty table gives an empty table.
Special tokens are never produced. The rank file (under 1 MB) is broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import blocks as B
from cairn.llm.common import small_batches, thrifty, type_of
from cairn.llm.pretoken import Memo, PreTokenizer


#: Pieces of a block that are put in place at a time.
RUN = 200_000


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


class PieceBlock(B.Block):
    """A block whose texts are cut into pieces first; each distinct piece is matched once."""

    def __init__(self, split: PreTokenizer):
        super().__init__()
        self.pieces, self.split = B.Numbers(), split

    def flat(self) -> np.ndarray:
        return self.expanded()[0]

    def lengths(self) -> np.ndarray:
        return self.expanded()[1]

    def expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """Pre-token numbers of all documents, and how many each document has."""
        if not hasattr(self, "_expanded"):
            number, sizes, flat = self.words, array("q", [0]), array("i")
            for piece in self.pieces:
                flat.extend(number[m] for m in self.split.matches(piece))
                sizes.append(len(flat))
            self.pieces = B.Numbers()
            offsets, flat = np.frombuffer(sizes, dtype=np.int64), np.frombuffer(flat, dtype=np.int32)
            out, lengths, run, held = [np.zeros(0, np.int32)], [], [], 0
            # runs of documents, so that the arrays of indices stay small
            for at, picks in enumerate(self.tokens):
                run.append(picks)
                held += len(picks)
                if held >= RUN or at == len(self.tokens) - 1:
                    index, by_piece = B.ragged(offsets, np.concatenate(run).astype(np.int64))
                    out.append(flat[index])
                    ends = np.concatenate([[0], np.cumsum(by_piece)])
                    lengths.append(np.diff(ends[np.concatenate([[0], np.cumsum([len(x) for x in run])])]))
                    run, held = [], 0
            self.tokens = []
            self._expanded = np.concatenate(out), np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        return self._expanded


def piece_tokens(block: PieceBlock, text: str) -> np.ndarray:
    pieces = block.split.pieces(text) if text else []
    return np.fromiter(map(block.pieces.__getitem__, pieces), dtype=np.uint32, count=len(pieces))


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids_le, decoded): the ids as packed little-endian unsigned 32-bit integers, and the bytes they decode to."""
    spark = docs.sparkSession
    with open(ranks_file, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    n_parts = B.part_count(docs)
    small_batches(spark)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task = PreTokenizer(pattern), TaskContext.get().partitionId()
        for at, block in enumerate(B.blocks_of(batches, piece_tokens, new=lambda: PieceBlock(split))):
            block.expanded()
            name = f"{task}-{at}-{block.seal:08x}"
            rows: list[tuple] = []
            for row in B.dictionary_rows(block, name, n_parts, str.encode):
                rows.append(row)
                if len(rows) >= 64:
                    yield B.rows_to_batch(rows)
                    rows = []
            if rows:
                yield B.rows_to_batch(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(shared.value), special_tokens={})
        known = Memo(codec._encode_single_piece, most=1_500_000)  # a pre-token as it stands: the library splits texts by recursion, which ends at some megabytes
        for batch in batches:
            rows = []
            for slot, block, kind, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == B.WORDS:
                    found = list(map(known.__getitem__, B.words_of(B.unpack(payload))))
                    payload = B.pack(B.planes(np.array([len(f) for f in found])), B.planes(np.array([i for f in found for i in f])))
                rows.append((slot, block, kind, part, payload))
            if rows:
                yield B.rows_to_batch(rows)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        by_id = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            by_id[i] = word
        byte_offsets = np.concatenate([[0], np.cumsum([len(w) for w in by_id])]).astype(np.int64)
        byte_table = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        name, part_of, lengths, ids, table = None, None, {}, {}, None
        for batch in batches:
            for _, block, kind, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields = B.unpack(payload)
                if block != name:
                    if kind != B.HEADER:
                        raise RuntimeError(f"block {block} came without its header; its map task was not repeatable")
                    name, lengths, ids, table = block, {}, {}, None
                    part_of = B.from_planes(fields[0]).astype(np.int64)
                elif kind == B.WORDS:
                    lengths[part], ids[part] = B.from_planes(fields[0]).astype(np.int64), B.from_planes(fields[1]).astype(np.uint32)
                else:
                    if table is None:
                        table = by_rank(part_of, lengths, ids)
                    yield documents(fields, *table, byte_offsets, byte_table)

    def by_rank(part_of: np.ndarray, lengths: dict, ids: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids by word rank, from the answers of the parts."""
        order = np.argsort(part_of, kind="stable")
        if sum(map(len, lengths.values())) != len(order):
            raise RuntimeError("a block's dictionary came back incomplete")
        sizes = np.concatenate([lengths[p] for p in sorted(lengths)]) if len(order) else np.zeros(0, np.int64)
        flat = np.concatenate([ids[p] for p in sorted(ids)]) if len(order) else np.zeros(0, np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        index, by_word = B.ragged(offsets, place)
        return np.concatenate([[0], np.cumsum(by_word)]).astype(np.int64), flat[index]

    def documents(fields: list[bytes], offsets: np.ndarray, flat: np.ndarray, byte_offsets: np.ndarray, byte_table: np.ndarray) -> pa.RecordBatch:
        keys, counts, words = B.ids_from_bytes(fields[0]), B.from_planes(fields[1]).astype(np.int64), B.from_planes(fields[2]).astype(np.int64)
        index, sizes = B.ragged(offsets, words)
        ids = flat[index].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        byte_index, byte_sizes = B.ragged(byte_offsets, ids.astype(np.int64))
        byte_ends = np.concatenate([[0], np.cumsum(byte_sizes)])[ends]
        return pa.RecordBatch.from_arrays([keys, binary(ids.tobytes(), ends * 4), binary(byte_table[byte_index].tobytes(), byte_ends)], names=[id_col, "ids_le", "decoded"])

    def binary(data: bytes, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(thrifty(explode), B.ROW_SCHEMA)
    encoded = B.deal(rows, n_parts, "slot").mapInArrow(thrifty(encode), B.ROW_SCHEMA)
    return B.deal(encoded, n_parts, "block", "block", "kind", "part").mapInArrow(thrifty(assemble), f"`{id_col}` {type_of(docs, id_col)}, ids_le binary, decoded binary")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) from encode_decode()'s rows."""
    return encoded.select(id_col, F.expr("CAST(octet_length(ids_le) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
