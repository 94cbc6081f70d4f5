"""Language-model scores from a log-frequency Bloom filter.

Training. Each block counts its distinct unigrams and bigrams; counts meet by
hash part, are summed and quantised on a log scale (steps of 5 %, exact up to 20). A
count of level q is stored as the entries (n-gram, 1) ... (n-gram, q) of a Bloom
filter. Each part owns one segment of the filter. Its hashes are so many that an
absent pair reads as present with a probability of about mu / (10 V) and 1 / 256 at most, and its bits follow from
the entries counted, so the filter grows with the corpus and its errors do not.

Scoring. A block sends the keys of its n-grams to the parts, training texts' with
their counts, and gets levels back; a task holds its parts' counts, segments and
(compressed) blocks' keys, and nothing of the filter is broadcast or collected. Levels are read by membership
probes for levels 1, 2, ... until one fails; keys that many blocks ask for are probed once a segment.

The model. With counts c as read, p(w) = (c(w) + 0.5) / (M + 0.5 (V + 1)), where V is the number
of distinct training tokens (and one class stands for all others) and M the sum of their
quantised counts, so p sums to 1. A token w after h (the beginning has a symbol of its own) has

    (c(hw) + mu p(w)) / (c(h) + mu + e (V + 1)),     p(w) if c(h) = 0,

where e is the count that an absent pair reads as on average, by the fill of the
segments. The sum over all w is 1 but for quantisation of c(hw) against c(h) and the
spread of false positives: a test holds it to 1 %.

The exact base score needs exact counts of every token: the distinct words of a
block are dealt by hash, summed over blocks and sent back, as for BPE encoding;
nothing of the corpus vocabulary is broadcast or collected.

Null texts count as empty: one end token. A null id is in no fold, so its text is
training text. Repeated rows count each time; other columns are ignored; an empty
table gives an empty result; without training rows every count is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import blocks as B
from cairn.llm.common import fold_is, small_batches, thrifty, type_of
from cairn.session import written

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BASE = 1.05
KEY_BITS = 48
#: Bits per entry and hash: half of the bits are then set, and an absent entry is found with a probability of 2 ** -hashes.
BITS_PER_HASH = 1.45
#: False positives may add this share of ``mu`` to a context's total.
FALSE_SHARE = 0.1
#: A block's n-gram keys, and its words' hashes by falling frequency, beside the kinds of blocks.py.
GRAMS, HASHES = 4, 5
#: Characters in a block: its pairs are held several times over while they are looked up.
BLOCK = 6_000_000
#: Tokens of a block that are scored at a time.
RUN = 200_000


def unigram_keys(words: np.ndarray) -> np.ndarray:
    return B.mix(words ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - KEY_BITS)


def bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return B.mix(left * np.uint64(0x9E3779B97F4A7C15) + B.mix(right)) >> np.uint64(64 - KEY_BITS)


def lowest_counts() -> np.ndarray:
    """The least count of level 1, 2, ...: each BASE times the one before, and one more at least."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BASE)))
    return np.array(out, dtype=np.int64)


LOWEST = lowest_counts()


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOWEST, counts, side="right")


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    at = np.clip(levels, 1, len(LOWEST) - 1)
    return np.where(levels > 0, (LOWEST[at - 1] + LOWEST[at] - 1) / 2, 0.0)


def hashes_for(vocabulary: int, mu: float) -> int:
    """So many that ``vocabulary`` absent pairs add at most about FALSE_SHARE of ``mu`` to a context, and 8 at least."""
    return max(8, min(30, math.ceil(math.log2(max(1.0, vocabulary / (FALSE_SHARE * mu))))))


@dataclass
class Segment:
    """A Bloom filter of (key, level) entries."""

    data: np.ndarray
    bits: int
    hashes: int

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, hashes: int, bits: int | None = None) -> Segment:
        """The filter of n-grams with these counts; its size follows from its entries unless ``bits`` sets it."""
        levels = level_of(counts)
        bits = bits or max(1024, math.ceil(BITS_PER_HASH * hashes * int(levels.sum())))
        if bits >= 1 << 32:
            raise ValueError("a segment has too many entries; use more shuffle partitions")
        marked = np.zeros(-(-bits // 8) * 8, dtype=bool)
        out, level = cls(marked, bits, hashes), 1
        while len(keys):
            h, step = out.start(keys, level)
            for _ in range(hashes):
                marked[out.place(h)] = True
                h = h + step
            level += 1
            more = levels >= level
            keys, levels = keys[more], levels[more]
        out.data = np.packbits(marked, bitorder="little")
        return out

    @staticmethod
    def start(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = B.mix(keys + np.uint64(0x9E3779B97F4A7C15 * level & (1 << 64) - 1))
        return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)

    def place(self, h: np.ndarray) -> np.ndarray:
        return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(self.bits) >> np.uint64(32)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Repeated membership probes: the last level before the first that is absent."""
        out = np.zeros(len(keys), dtype=np.int64)
        live, level = np.arange(len(keys)), 1
        while len(live) and level < len(LOWEST):
            h, step = self.start(keys[live], level)
            for _ in range(self.hashes):
                spot = self.place(h)
                there = (self.data[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                live, h, step = live[there], h[there] + step[there], step[there]
                if not len(live):
                    break
            out[live] = level
            level += 1
        return out

    def fill(self) -> float:
        return float(np.bitwise_count(self.data).sum()) / self.bits

    def false_count(self) -> float:
        """The count that an absent key reads as on average."""
        rate = self.fill() ** self.hashes
        return rate / (1 - rate) if rate < 1 else float(LOWEST[-1])


@dataclass(frozen=True)
class Totals:
    """What the model knows of its corpus besides the filter."""

    tokens: int  # N, ends included
    texts: int
    distinct: int  # V
    mass: float  # of the distinct tokens' quantised counts
    false_count: float
    mu: float

    def floor(self) -> float:
        """log10 of the base model's denominator."""
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))

    def smoothed(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of a word from the counts that were read for it, its context and the pair."""
        single = (word + 0.5) / (self.mass + 0.5 * (self.distinct + 1))
        seen = np.minimum(pair, np.minimum(context, word))  # a pair is no more frequent than its parts
        excess = np.where(context > 0, self.false_count * (self.distinct + 1), 0.0)
        return (seen + self.mu * single) / (context + self.mu + excess)


def grams(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' word hashes end to end, with BEGIN and END around each document: (previous, next, document)."""
    ends = np.cumsum(lengths + 1)
    right = np.full(len(words) + len(lengths), END, dtype=np.uint64)
    inner = np.ones(len(right), dtype=bool)
    inner[ends - 1] = False
    right[inner] = words
    left = np.roll(right, 1)
    left[ends - lengths - 1] = BEGIN
    return left, right, np.repeat(np.arange(len(lengths)), lengths + 1)


def block_keys(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """All keys of a block, sorted and thereby by part, from its distinct words' hashes and its bigrams' keys."""
    return np.unique(np.concatenate([unigram_keys(np.append(words, [BEGIN, END])), pairs]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def part_bits_for(n_parts: int) -> int:
    return max(0, min(18, math.ceil(math.log2(max(1, n_parts)))))


def gram_rows(block: B.Block, name: str, part_bits: int) -> Iterator[tuple]:
    """A block's n-gram keys by part, with their counts in its training documents, and its words' hashes."""
    hashes = B.word_hashes(block)
    by_count = np.argsort(-np.bincount(block.flat(), minlength=len(hashes)), kind="stable")  # as in dictionary_rows
    yield zlib.crc32(name.encode()), name, HASHES, -1, B.pack(hashes[by_count].tobytes())
    left, right, doc = grams(hashes[block.flat()], block.lengths())
    pairs = bigram_keys(left, right)
    keys = block_keys(hashes, pairs)
    train = np.array(block.extra, dtype=bool)[doc]
    # BEGIN as a context has the number of texts as its count
    seen, n = np.unique(np.concatenate([unigram_keys(right[train]), unigram_keys(left[train & (left == BEGIN)]), pairs[train]]), return_counts=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    counts[np.searchsorted(keys, seen)] = n
    bounds = np.searchsorted(keys, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - part_bits)).tolist()
    for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            yield p, name, GRAMS, p, B.pack(B.planes(np.diff(keys[a:b], prepend=np.uint64(0))), B.planes(counts[a:b]))


def keys_of(fields: list[bytes]) -> np.ndarray:
    return np.cumsum(B.from_planes(fields[0]), dtype=np.uint64)


class Segments:
    """A task's segments of the filter: takes all blocks' rows of its parts, then answers them."""

    def __init__(self, bits: int | None, mu: float):
        self.bits, self.mu = bits, mu
        self.false_counts, self.n_bits, self.n_set = 0.0, 0, 0.0
        self.asked: dict[int, list[tuple[str, bytes]]] = {}  # compressed; the parts' share of the n-grams
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.waiting: dict[int, list] = {}

    def add(self, block: str, part: int, payload: bytes) -> None:
        self.asked.setdefault(part, []).append((block, payload))
        fields = B.unpack(payload)
        keys, counts = keys_of(fields), B.from_planes(fields[1]).astype(np.int64)
        self.waiting.setdefault(part, []).append((keys[counts > 0], counts[counts > 0]))
        if sum(len(k) for k, _ in self.waiting[part]) > 2_000_000:
            self.settle(part)

    def most(self) -> int:
        """An upper bound of the distinct words, from the n-grams at hand."""
        return sum(len(k) for k, _ in self.held.values()) + sum(len(k) for rows in self.waiting.values() for k, _ in rows)

    def settle(self, part: int) -> None:
        parts = self.waiting.pop(part, []) + ([self.held[part]] if part in self.held else [])
        self.held[part] = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

    def answers(self, vocabulary: int) -> Iterator[tuple]:
        for part, asked in self.asked.items():
            if part in self.waiting:
                self.settle(part)
            keys, counts = self.held.pop(part)
            own = Segment.of(keys, counts, hashes_for(vocabulary, self.mu), self.bits)
            self.false_counts, self.n_bits, self.n_set = self.false_counts + own.false_count(), self.n_bits + own.bits, self.n_set + own.fill() * own.bits
            read = own.levels(keys)  # once for all blocks
            for block, payload in asked:
                wanted = keys_of(B.unpack(payload))
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
                levels = np.zeros(len(wanted), dtype=np.int64)
                levels[known] = read[at[known]]
                levels[~known] = own.levels(wanted[~known])
                yield part, block, GRAMS, part, B.pack(B.planes(levels))


def log_scores(words: np.ndarray, flat: np.ndarray, lengths: np.ndarray, levels: np.ndarray, totals: Totals) -> np.ndarray:
    """log10 probability of every document of a block, its end included, from the levels of ``block_keys``."""
    left, right, _ = grams(words[flat], lengths)
    pairs, where = np.unique(bigram_keys(left, right), return_inverse=True)
    del left, right
    keys, counts = block_keys(words, pairs), count_of(levels).astype(np.float32)
    of_pair = counts[np.searchsorted(keys, pairs)]
    single = counts[np.searchsorted(keys, unigram_keys(np.append(words, [BEGIN, END])))]
    begin, end = len(words), len(words) + 1
    out, ends = np.empty(len(lengths)), np.cumsum(lengths + 1)
    first = 0
    while first < len(lengths):  # runs of documents, so that the arrays of a run stay small
        start = ends[first] - lengths[first] - 1
        last = max(first + 1, int(np.searchsorted(ends, start + RUN, side="right")))
        stops = ends[first:last] - start
        at = np.full(int(stops[-1]), end)
        inner = np.ones(len(at), dtype=bool)
        inner[stops - 1] = False
        at[inner] = flat[start - first : ends[last - 1] - last]
        before = np.roll(at, 1)
        before[stops - lengths[first:last] - 1] = begin
        pair = of_pair[where[start : ends[last - 1]]]
        doc = np.repeat(np.arange(last - first), lengths[first:last] + 1)
        chance = totals.smoothed(pair.astype(float), single[before].astype(float), single[at].astype(float))
        out[first:last] = np.bincount(doc, weights=np.log10(chance), minlength=last - first)
        first = last
    return out


def stats(part: int, a: float, b: float) -> tuple:
    return 0, "", B.STATS, part, B.pack(np.array([a, b], dtype="<f8").tobytes())


def score_texts(docs: DataFrame, fold: tuple[int, int] = (5, 1), bits: int | None = None, mu: float = 1000.0, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    ``bits`` sets the size of the whole filter, which otherwise follows from its
    entries. ``report`` receives the filter's bits, the share of them that is set and the model's totals.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"), (~fold_is(id_col, *fold)).alias("__train"))
    n_parts = B.part_count(docs)
    part_bits = part_bits_for(n_parts)
    segment_bits = bits and max(1024, bits >> part_bits)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for at, block in enumerate(B.blocks_of(batches, B.word_tokens, BLOCK)):
            name = f"{task}-{at}-{block.seal:08x}"
            train = np.array(block.extra, dtype=bool)
            picked = [t for t, ok in zip(block.tokens, train.tolist(), strict=True) if ok]
            counts = np.bincount(np.concatenate(picked), minlength=len(block.words)) if picked else np.zeros(len(block.words), np.int64)
            block.extra = train.tolist()
            out: list[tuple] = [stats(0, counts.sum(), train.sum())]
            for row in chain(gram_rows(block, name, part_bits), B.dictionary_rows(block, name, n_parts, bytes, word_extra=counts)):
                out.append(row)
                if len(out) >= 64:
                    yield B.rows_to_batch(out)
                    out = []
            if out:
                yield B.rows_to_batch(out)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}
        asked: list[tuple[str, int, bytes]] = []  # compressed; a hash part's share of the words
        segments = Segments(segment_bits, mu)
        for batch in batches:
            out = []
            for slot, block, kind, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == GRAMS:
                    segments.add(block, part, payload)
                    continue
                if kind != B.WORDS:
                    out.append((slot, block, kind, part, payload))
                    continue
                asked.append((block, part, payload))
                fields = B.unpack(payload)
                for word, n in zip(B.words_of(fields), B.from_planes(fields[2]).tolist(), strict=True):
                    totals[word] = totals.get(word, 0) + n
            if out:
                yield B.rows_to_batch(out)
        for block, part, payload in asked:
            words = B.words_of(B.unpack(payload))
            yield B.rows_to_batch([(part, block, B.WORDS, part, B.pack(B.planes(np.fromiter(map(totals.__getitem__, words), np.int64, len(words)))))])
        found = np.fromiter(totals.values(), np.int64, len(totals))
        found, dealt = found[found > 0], len({part for _, part, _ in asked})
        del totals, asked
        # the parts share the words evenly; without any, every n-gram might be one
        vocabulary = len(found) * n_parts // dealt if dealt else segments.most()
        for row in segments.answers(vocabulary):
            yield B.rows_to_batch([row])
        yield B.rows_to_batch([stats(1, len(found), count_of(level_of(found)).sum()), stats(2, segments.false_counts, 0), stats(3, segments.n_bits, segments.n_set)])

    def totals_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(B.unpack(p)[0], dtype="<f8") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in values], pa.float64()), pa.array([v[1] for v in values], pa.float64())], names=["part", "a", "b"])

    small_batches(spark)
    exploded = rows.mapInArrow(thrifty(explode), B.ROW_SCHEMA)
    resolved = written(B.deal(exploded, n_parts, "slot").mapInArrow(thrifty(resolve), B.ROW_SCHEMA))
    sums = {r["part"]: (r["a"] or 0, r["b"] or 0) for r in resolved.where(F.col("kind") == B.STATS).select("part", "payload").mapInArrow(thrifty(totals_of), "part int, a double, b double").groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    tokens, texts = map(int, sums.get(0, (0, 0)))
    distinct, mass = sums.get(1, (0, 0.0))
    model = Totals(tokens + texts, texts, int(distinct) + (texts > 0), mass + float(count_of(level_of(np.array([texts])))[0]), sums.get(2, (0.0, 0))[0] / (1 << part_bits), mu)
    if report is not None:
        n_bits, n_set = sums.get(3, (0, 0))
        report.update(bits=int(n_bits), fill=n_set / n_bits if n_bits else 0.0, model=model)
    floor = model.floor()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part_of, answers, levels, docs, words = None, None, {}, {}, [], None
        for batch in batches:
            for _, block, kind, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != name:
                    if kind != B.HEADER:
                        raise RuntimeError(f"block {block} came without its header; its map task was not repeatable")
                    if name is not None:
                        yield documents(part_of, answers, levels, docs, words)
                    name, answers, levels, docs, words = block, {}, {}, [], None
                fields = B.unpack(payload)
                if kind == B.HEADER:
                    part_of = B.from_planes(fields[0]).astype(np.int64)
                elif kind == B.WORDS:
                    answers[part] = B.from_planes(fields[0]).astype(np.int64)
                elif kind == B.DOCS:
                    docs.append(fields)
                elif kind == GRAMS:
                    levels[part] = B.from_planes(fields[0]).astype(np.int64)
                else:
                    words = np.frombuffer(fields[0], dtype=np.uint64)
        if name is not None:
            yield documents(part_of, answers, levels, docs, words)

    def documents(part_of: np.ndarray, answers: dict, levels: dict, docs: list, words: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part_of, kind="stable")
        table = np.zeros(len(order), dtype=np.int64)
        if len(order):
            table[order] = np.concatenate([answers[p] for p in sorted(answers)])
        keys = pa.concat_arrays([B.ids_from_bytes(fields[0]) for fields in docs])
        lengths = np.concatenate([B.from_planes(fields[1]) for fields in docs]).astype(np.int64)
        flat = np.concatenate([B.from_planes(fields[2]) for fields in docs]).astype(np.int64)
        train = np.concatenate([np.frombuffer(fields[3], dtype="<f8") for fields in docs])
        scores = log_scores(words, flat, lengths, np.concatenate([levels[p] for p in sorted(levels)]), model)
        counts = table[flat]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(doc, weights=np.log10(counts + 0.5) - floor, minlength=len(lengths)) + (math.log10(texts + 0.5) - floor)
        known = np.bincount(doc, weights=counts > 0, minlength=len(lengths)).astype(np.int64) + (texts > 0)
        arrays = [keys, pa.array(train == 0), pa.array(lengths + 1), pa.array(known), pa.array(np.full(len(lengths), model.tokens)), pa.array(base), pa.array(scores)]
        return pa.RecordBatch.from_arrays(arrays, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = B.deal(resolved.where(F.col("kind") != B.STATS), n_parts, "block", "block", "kind", "part")
    return back.mapInArrow(thrifty(assemble), f"`{id_col}` {type_of(docs, id_col)}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
