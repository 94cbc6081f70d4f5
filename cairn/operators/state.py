"""Small pointer tables (tags, configuration, grants), paging, and snapshots of the state that cannot be recomputed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import watermark
from cairn.operators.diff import is_dirty

# Settings and their defaults.
DEFAULTS = {"evict:high": "90%", "evict:low": "85%", "gc:grace-secs": "86400", "swap:share-min-pct": "50", "chunk:pack-min-members": "4", "chunk:pack": "on"}
KEEP_PREFIX = "gc:keep:"


def latest(log: DataFrame, key: str, order: list[str], deleted: str | None = None) -> DataFrame:
    """The last row of each key in an append-only log, by ``order`` and then by all columns; keys whose last row says deleted are gone."""
    rest = [c for c in log.columns if c not in (key, *order)]
    last = log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in [*order, *rest]))
    return last if deleted is None else last.where(~F.coalesce(F.col(deleted), F.lit(False)))


def with_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key starts with a prefix, taken literally."""
    return rows.where(F.col(key).startswith(prefix))


def setting(config: DataFrame, key: str) -> str | None:
    """A setting's value of config(key, value), else its default."""
    row = config.where(F.col("key") == key).select("value").first()
    return row["value"] if row else DEFAULTS.get(key)


def policy(config: DataFrame, total: Column) -> dict[str, Column | int | bool]:
    """All settings as values: watermarks in bytes of a store of ``total`` bytes, the rest as numbers."""
    return {
        "high": watermark(setting(config, "evict:high"), total),
        "low": watermark(setting(config, "evict:low"), total),
        "grace": int(setting(config, "gc:grace-secs")),
        "share": int(setting(config, "swap:share-min-pct")),
        "pack_members": int(setting(config, "chunk:pack-min-members")),
        "pack": setting(config, "chunk:pack") == "on",
    }


def keep_marks(config: DataFrame) -> DataFrame:
    """(hash, note): contents that an operator has marked to keep."""
    return with_prefix(config, "key", KEEP_PREFIX).select(F.expr(f"substring(key, {len(KEEP_PREFIX) + 1})").alias("hash"), F.col("value").alias("note"))


def visible(rows: DataFrame, view: str, grants: DataFrame, user: str, owner: bool) -> DataFrame:
    """The rows of views that a user may see: an owner all, others those granted(user, view) to them."""
    if owner:
        return rows
    mine = grants.where(F.col("user") == user).select(F.col("view").alias(view)).distinct()
    return rows.join(mine, view, "left_semi")


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every wanted value that is not None."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), rows)


def page(rows: DataFrame, order: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page with the number of all rows as ``total``: 200 rows unless asked, 1 to 1000."""
    size = min(max(1, 200 if limit is None else limit), 1000)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(size).crossJoin(F.broadcast(total))  # one row


def capped(rows: DataFrame, order: list[str], cap: int, shown: list[str]) -> DataFrame:
    """The first ``cap`` rows by ``order``, in the order ``shown``, with the number of all rows as ``total``."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(cap).crossJoin(F.broadcast(total)).orderBy(*shown)  # one row


def find_files(paths: DataFrame, part: str, path: str = "path") -> DataFrame:
    """Paths that hold a piece of text, whatever its case, taken literally."""
    return paths.where(F.lower(path).contains(part.lower()))


def current_revision(sources: DataFrame, provider: str, system: str) -> int:
    """The current revision of a source; an unknown source and one without a revision are different errors."""
    row = sources.where((F.col("provider") == provider) & (F.col("system") == system)).select("current").first()
    if row is None:
        raise LookupError(f"no source {provider}/{system}")
    if row["current"] is None:
        raise ValueError(f"source {provider}/{system} has no revision")
    return row["current"]


def next_sequence(log: DataFrame, key: str = "seq") -> DataFrame:
    """One row: the number after the last."""
    return log.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_seq"))


def digest(table: DataFrame, shards: int = 256) -> DataFrame:
    """One row (n, digest): a digest of a table's rows that does not depend on their order.

    Rows are digested (nulls tagged), dealt into shards by their digest, and each shard's sorted digests digested; last the
    shards' digests in order. So no task sees more than a shard.
    """
    line = F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in table.columns)), 256)
    rows = table.select(line.alias("d")).withColumn("s", F.pmod(F.conv(F.substring("d", 1, 8), 16, 10).cast("long"), F.lit(shards)))
    shard = rows.groupBy("s").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    whole = shard.agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("s", "d"))).alias("x"))  # ``shards`` rows
    return whole.select(F.coalesce("n", F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform("x", lambda s: s["d"]), ""), 256).alias("digest"))


def mint(log: DataFrame, tables: dict[str, DataFrame], before: dict[str, DataFrame], now: int) -> DataFrame:
    """log(seq, digest, at) with a new snapshot if any table differs from the last snapshot's."""
    if before and not any(is_dirty(before[name], table) for name, table in tables.items()):
        return log
    parts = reduce(DataFrame.unionByName, (digest(t).select(F.lit(name).alias("name"), "digest") for name, t in sorted(tables.items())))
    whole = parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit("="), x["digest"])), "\n"), 256).alias("digest"))  # a row for each table
    return log.unionByName(next_sequence(log).crossJoin(whole).select(F.col("next_seq").cast("long").alias("seq"), "digest", F.lit(now).cast("long").alias("at")))


def newest_valid(log: DataFrame, signatures: DataFrame) -> DataFrame:
    """The newest snapshot whose digest our key has signed(digest): what recovery starts from."""
    good = log.join(signatures.select("digest").distinct(), "digest", "left_semi")
    return good.agg(F.max(F.struct("seq", "digest", "at")).alias("x")).where("x IS NOT NULL").select("x.*")


def recover(stored: DataFrame, alias_batches: DataFrame, analysis_batches: DataFrame) -> dict[str, DataFrame]:
    """Tables rebuilt from what is stored(hash, size, content digests...) and the restored batches, duplicates dropped.

    blobs(hash, size); aliases(hash, algo, digest), restored for contents that are stored; analyses(hash, analyzer, outcome), all of
    them, since an outcome holds whether or not its content is here.
    """
    blobs = stored.groupBy("hash").agg(F.max("size").alias("size"))
    aliases = alias_batches.select("hash", "algo", "digest").distinct().join(blobs.select("hash"), "hash", "left_semi")
    analyses = analysis_batches.groupBy("hash", "analyzer").agg(F.max("outcome").alias("outcome"))
    return {"blobs": blobs, "aliases": aliases, "analyses": analyses}


def sharded(rows: DataFrame, key: str, fanout: int) -> DataFrame:
    """(shard, n, digest) of hash-keyed rows: sorted in their shard by the first byte of the hex key; a repeated key is an error."""
    shard = F.floor(F.conv(F.substring(key, 1, 2), 16, 10).cast("int") * fanout / 256).cast("int")
    grouped = rows.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(key)).alias("keys"))
    twice = F.size(F.array_distinct("keys")) < F.size("keys")
    return grouped.select("shard", F.size("keys").cast("long").alias("n"), F.when(twice, F.raise_error(F.lit("a shard has a key twice"))).otherwise(F.sha2(F.array_join("keys", "\n"), 256)).alias("digest"))
