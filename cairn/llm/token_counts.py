"""Token counts by heap-and-linked-list byte-pair merging, without building identifiers.

A piece starts as one symbol per byte in a doubly linked list. A heap holds the
adjacent pairs that have a merge rank; the lowest rank (leftmost first among
equals) is popped, stale entries are skipped, the pair is joined and its two new
neighbours are pushed. The count is the initial number of symbols minus the
number of merges. A piece of n bytes costs O(n log n), so one very long word
does not stall a task.

Null texts count as empty (0 bytes, 0 tokens); a null id is carried through;
repeated rows are counted each; other columns are ignored; an empty table gives
an empty table. No shuffle: one pass, one row out per row in.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_rows, type_of
from cairn.llm.pretoken import Memo, PreTokenizer


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def refuse_unknown(spec: dict) -> None:
    """An error for parts of a vocabulary file that change the tokens and are not handled here."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    unknown = {
        "model": model.get("type", "BPE") != "BPE",
        "dropout": bool(model.get("dropout")),
        "word marks": bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        "byte fallback": bool(model.get("byte_fallback")),
        "whole words first": bool(model.get("ignore_merges")),
        "normalizer": spec.get("normalizer") is not None,
        "pre-tokenizer": cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or not cut.get("use_regex", True),
        "added tokens": any(not t["special"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and spec.get("normalizer") for t in spec["added_tokens"]),
    }
    if any(unknown.values()):
        raise ValueError("vocabulary not handled: " + ", ".join(k for k, v in unknown.items() if v))


class MergeCounter:
    """Counts tokens as a byte-level BPE vocabulary file (JSON) gives them."""

    def __init__(self, blob: bytes, pattern: str):
        spec = json.loads(blob)
        refuse_unknown(spec)
        vocab = spec["model"]["vocab"]
        self.start = [vocab[c] for c in byte_symbols()]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[left] << 24 | vocab[right], (rank, vocab[left + right]))
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.split = PreTokenizer(pattern)
        self.words = Memo(lambda m: self.merged(m.encode()), most=800_000)
        self.cache = Memo(self.piece)

    def merged(self, data: bytes) -> int:
        n, merge = len(data), self.merge
        if n < 2:
            return n
        symbol = [self.start[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            known = merge.get(symbol[at] << 24 | symbol[at + 1])
            if known:
                heap.append((known[0], at))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, at = heapq.heappop(heap)
            here = symbol[at]
            if here < 0 or (right := after[at]) >= n:
                continue
            known = merge.get(here << 24 | symbol[right])
            if not known or known[0] != rank:
                continue
            symbol[at], symbol[right] = known[1], -1
            beyond = after[at] = after[right]
            left -= 1
            if beyond < n:
                before[beyond] = at
                if fresh := merge.get(known[1] << 24 | symbol[beyond]):
                    heapq.heappush(heap, (fresh[0], at))
            if (prior := before[at]) >= 0 and (fresh := merge.get(symbol[prior] << 24 | known[1])):
                heapq.heappush(heap, (fresh[0], prior))
        return left

    def piece(self, piece: str) -> int:
        return sum(map(self.words.__getitem__, self.split.matches(piece)))

    def count(self, text: str) -> int:
        parts, found = [text], 0
        for mark in self.special:  # special strings inside a text are one token each, as the library does by default
            parts = [x for part in parts for x in part.split(mark)]
        found = len(parts) - 1
        return found + sum(sum(map(self.cache.__getitem__, self.split.pieces(part))) for part in parts if part)


_COUNTERS: dict = {}


def counter(blob: bytes, pattern: str) -> MergeCounter:
    """One counter, with its cache, per Python worker and vocabulary."""
    key = (hash(blob), pattern)
    if key not in _COUNTERS:
        _COUNTERS[key] = MergeCounter(blob, pattern)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row. ``vocabulary``: path on the driver of a byte-level BPE JSON file.

    The file (a few MB, whatever the data) is broadcast.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(shared.value, pattern).count
        texts = batch.column(1).to_pylist()
        sizes = [len(t.encode()) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([count(t) if t else 0 for t in texts], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return map_rows(rows, run, f"`{id_col}` {type_of(docs, id_col)}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
