"""Cumulative-snapshot collapse and chat rendering, in DataFrame operations only.

A log that is saved after every turn holds a conversation many times over, each
snapshot a prefix of the next. A turn's hash covers its place, role and text's SHA-256; the
hash of the first k turns is the XOR of k turn hashes (four 64-bit lanes), a rolling
hash that windows and partial aggregation can build. A conversation whose full
hash appears among the shorter prefixes of others is dropped by an anti-join, and
of equal conversations the smallest id stays. All this works on digests; texts are
shuffled once, to be rendered.

Prefix hashes are distinct before the join, so a very common first turn is one
row. A conversation is one output row and is therefore gathered whole; windows over a
conversation hold digests only.

Turns are ordered by turn, then role, then the text's SHA-256 (nulls first); exact repeats of a row are one
turn. A null role renders as "unknown", a null text as empty; the marks that open and close a
turn are escaped where a role or text holds them (a backslash after "<"), so no text can forge a turn; rows with a null conversation id are
dropped. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("<\\|"))


def turns_of(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, digest, text) of rows with a conversation id."""
    text = F.col(f"`{text_col}`").cast("string")
    own = rows.where(F.col(f"`{id_col}`").isNotNull())
    return own.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"))


def prefixes_of(turns: DataFrame) -> DataFrame:
    """(conv, at, h, n): rolling hashes of the first ``at`` turns, and the conversation's number of turns."""
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest"))
    placed = turns.select("conv", "turn", "role", "digest").distinct().withColumn("at", F.row_number().over(order))
    whole = F.sha2(F.concat_ws("|", "at", F.coalesce(F.concat(F.lit("r"), F.sha2("role", 256)), F.lit("n")), F.coalesce("digest", F.lit("n"))), 256)
    lanes = [F.conv(F.substring("w", 16 * i + 1, 16), 16, -10).cast("long").alias(f"x{i}") for i in range(4)]
    hashed = placed.select("conv", "at", whole.alias("w")).select("conv", "at", *lanes)
    running = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = F.struct(*(F.bit_xor(f"x{i}").over(running).alias(f"x{i}") for i in range(4)))
    return hashed.select("conv", "at", rolled.alias("h"), F.max("at").over(Window.partitionBy("conv")).alias("n"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another; of equal ones the smallest id, with the number of equals."""
    full = prefixes.where("at = n").groupBy("n", "h").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    shorter = prefixes.where("at < n").select(F.col("at").alias("n"), "h").distinct()
    return full.join(shorter, ["n", "h"], "left_anti").select("conv", "n_copies")


def collapse_and_render(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_copies, text): every maximal conversation, rendered as one chat text."""
    turns = turns_of(rows, id_col, turn_col, role_col, text_col)
    kept = maximal(prefixes_of(turns))
    piece = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit("unknown"))), F.lit(CLOSE + "\n"), escaped(F.coalesce("text", F.lit(""))), F.lit("\n" + OPEN + "end" + CLOSE + "\n"))
    pieces = turns.select("conv", F.struct("turn", "role", "digest", piece.alias("piece")).alias("t"))
    whole = pieces.join(kept, "conv").groupBy("conv").agg(F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_set("t")).alias("ts"))
    return whole.select(F.col("conv").alias(id_col), F.size("ts").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("text"))


#: The same result for (conv_id, turn, role, text) rows, in DuckDB's SQL.
ORACLE = """
WITH plain AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(text) NULLS FIRST) AS pos FROM plain),
pieces AS (SELECT conv_id, pos, '<|' || replace(coalesce(role, 'unknown'), '<|', '<' || chr(92) || '|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<' || chr(92) || '|') || chr(10) || '<|end|>' || chr(10) AS piece,
                  sha256(CAST(pos AS VARCHAR) || '|' || coalesce(role, chr(1)) || '|' || coalesce('t' || text, 'n')) AS h FROM turns),
prefix AS (SELECT conv_id, pos, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM pieces),
whole AS (SELECT p, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefix WHERE pos = n GROUP BY p, n),
kept AS (SELECT conv_id, n, n_copies FROM whole WHERE NOT EXISTS (SELECT 1 FROM prefix s WHERE s.p = whole.p AND s.pos < s.n))
SELECT k.conv_id AS conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies, string_agg(p.piece, '' ORDER BY p.pos) AS text
FROM kept k JOIN pieces p ON p.conv_id = k.conv_id GROUP BY k.conv_id, k.n, k.n_copies
"""
