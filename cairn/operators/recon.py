"""Set reconciliation by rateless coded symbols; the decoded result equals the symmetric difference.

A key takes part in symbol i with a probability of 1 / (1 + i / 2), so symbol 0 holds all keys and later
ones ever fewer. The gaps between a key's symbols are drawn by inverting that law: with u uniform in
(0, 1], the symbol after i is i + ceil((i + 1.5) (1 / sqrt(u) - 1)). The draws are hashes of the key's check
and the number of the draw, so both sides agree without a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols that a peer sends at most before it gives up.
MOST_SYMBOLS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def symbols_of(checks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, symbol) for every symbol below ``most`` that the keys with these checks take part in."""
    rows = np.arange(len(checks))
    seeds, at, draw = checks.astype(np.int64).view(np.uint64), np.zeros(len(checks)), 0
    out_rows, out_symbols = [rows], [np.zeros(len(checks), dtype=np.int64)]
    while len(rows):
        draw += 1
        bits = mixed(seeds[rows] + np.uint64(draw * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)
        uniform = (bits.astype(float) + 1.0) / float(1 << 53)
        at[rows] += np.maximum(1.0, np.ceil((at[rows] + 1.5) * (1.0 / np.sqrt(uniform) - 1.0)))
        rows = rows[at[rows] < most]
        out_rows.append(rows)
        out_symbols.append(at[rows].astype(np.int64))
    return np.concatenate(out_rows), np.concatenate(out_symbols)


def encode(keys: DataFrame, key: str, n_symbols: int) -> DataFrame:
    """(idx, xor_key, xor_check, n): the first ``n_symbols`` coded symbols of a set of 64-bit keys.

    A map-reduce: each key goes to its symbols, and symbols are XOR sums, combined before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, check = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows, symbols = symbols_of(check, n_symbols)
            yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(k[rows]), pa.array(check[rows])], names=["idx", "k", "check"])

    rows = keys.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct().withColumn("check", F.xxhash64("k"))
    return rows.mapInArrow(run, "idx long, k long, check long").groupBy("idx").agg(F.bit_xor("k").alias("xor_key"), F.bit_xor("check").alias("xor_check"), F.count(F.lit(1)).alias("n"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symbol-wise difference of two encodings."""
    x, y = a.alias("x"), b.alias("y")
    z = lambda c: F.coalesce(c, F.lit(0))
    return x.join(y, F.col("x.idx") == F.col("y.idx"), "full").select(F.coalesce("x.idx", "y.idx").alias("idx"), z("x.xor_key").bitwiseXOR(z("y.xor_key")).alias("xor_key"), z("x.xor_check").bitwiseXOR(z("y.xor_check")).alias("xor_check"), (z("x.n") - z("y.n")).alias("n"))


def peel(symbols: list[tuple[int, int, int, int]], n_symbols: int, check) -> tuple[set[int], set[int], bool]:
    """Decode (idx, xor_key, xor_check, n) rows: keys only in the first set, only in the second, and whether all was decoded.

    Runs on the driver: its input has as many rows as symbols were asked for, which
    follows the size of the difference and not of the sets. ``check``: key -> xxhash64.
    A key that peels twice on one side is no difference of sets: the symbols are malformed, an error.
    """
    cells = {i: [k, c, n] for i, k, c, n in symbols}
    ours: set[int] = set()
    theirs: set[int] = set()
    todo = list(cells)
    while todo:
        k, c, n = cells[todo.pop()]
        if abs(n) != 1 or check(k) != c:
            continue
        side = ours if n == 1 else theirs
        if k in side:
            raise ValueError("malformed symbols: a key came twice")
        side.add(k)
        for i in symbols_of(np.array([c], dtype=np.int64), n_symbols)[1].tolist():
            cell = cells.setdefault(i, [0, 0, 0])
            cell[0], cell[1], cell[2] = cell[0] ^ k, cell[1] ^ c, cell[2] - n
            todo.append(i)
    return ours, theirs, not any(any(cell) for cell in cells.values())


def key_check(key: int) -> int:
    """xxhash64 of a long with Spark's seed, by its published definition."""
    m = (1 << 64) - 1
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    rot = lambda x, r: (x << r | x >> 64 - r) & m
    h = (42 + p5 + 8) & m
    h ^= rot((key & m) * p2 & m, 31) * p1 & m
    h = (rot(h, 27) * p1 + p4) & m
    h = (h ^ h >> 33) * p2 & m
    h = (h ^ h >> 29) * p3 & m
    h ^= h >> 32
    return h - (1 << 64) if h >> 63 else h


def reconcile(local: DataFrame, remote: DataFrame, key: str, first: int = 64) -> DataFrame:
    """(key, side) of the keys on one side only, decoded from as few symbols as it takes.

    Asks for four times as many symbols until all is decoded; beyond MOST_SYMBOLS it is an error, as between peers.
    """
    spark, n = local.sparkSession, first
    while n <= MOST_SYMBOLS:
        rows = [tuple(r) for r in subtract(encode(local, key, n), encode(remote, key, n)).collect()]
        ours, theirs, done = peel(rows, n, key_check)
        if done:
            return spark.createDataFrame([(k, "local") for k in sorted(ours)] + [(k, "remote") for k in sorted(theirs)], f"`{key}` long, side string")
        n *= 4
    raise RuntimeError("no decoding within the symbol limit")
