"""From catalog files to audited entries: one job over all files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import audit, identity
from cairn.operators.selection import newest, numbered
from cairn.sources.catalogs import entries_of
from cairn.session import cut

# Statuses of claims.
STATUSES = {"good": 0, "baddump": 1, "nodump": 2, "verified": 3}


def resolve_parents(entries: DataFrame) -> DataFrame:
    """Entries(revision, entry, name, cloneof, romof) with cloneof_id and romof_id: the entry of that name in the same revision, null if there is none."""
    names = entries.groupBy("revision", "name").agg(F.min("entry").alias("id"))
    out = entries
    for column in ("cloneof", "romof"):
        own = names.select("revision", F.col("name").alias(column), F.col("id").alias(f"{column}_id"))
        out = out.join(own, ["revision", column], "left")
    return out


def current_sources(sources: DataFrame, revisions: DataFrame) -> DataFrame:
    """(source, provider, system, revision, version, imported_at): every source with its current revision, nulls where it has none."""
    own = revisions.select("source", F.col("revision").alias("current"), "version", "imported_at")
    return sources.join(own, ["source", "current"], "left").select("source", "provider", "system", F.col("current").alias("revision"), "version", "imported_at")


def import_catalogs(files: DataFrame, aliases: DataFrame, blobs: DataFrame, now: int, keep: int = 2) -> dict[str, DataFrame]:
    """All tables that an import of files(path, content) makes, up to the audit of every entry.

    aliases(algo, digest, blob) and blobs(blob, size, resident) say what is stored. Several files of one provider and
    system are its revisions in the order of their paths; the last is current, and the ``keep`` newest stay materialised,
    that is, entries and claims of older ones are not kept. Files that cannot be read are rows of ``errors``.

    sources(source, provider, system, current); revisions(revision, source, path, version, date, imported_at, rank, kept);
    entries(revision, entry, name, description, cloneof_id, romof_id, ...); claims(claim, entry, kind, name, size, digests,
    status, optional, identity); links(identity, blob, basis); states(identity, state); audit(entry, required, ..., state).
    """
    parsed = cut(entries_of(files))
    errors = parsed.where("error IS NOT NULL").select("path", "error")
    good = parsed.where("error IS NULL")
    header = good.groupBy("path").agg(F.first("header", ignorenulls=True).alias("header"))
    named = header.select("path", C.provider(F.col("header")["homepage"], F.col("header")["author"]).alias("provider"), F.coalesce(F.col("header")["name"], F.lit("unknown")).alias("system"), F.col("header")["version"].alias("version"), F.col("header")["date"].alias("date"))
    revisions = numbered(named, [F.asc("path")], "revision", 16)
    ids = numbered(named.select("provider", "system").distinct(), [F.asc("provider"), F.asc("system")], "source", 16)
    revisions = cut(revisions.join(ids, ["provider", "system"]).withColumn("imported_at", F.lit(now).cast("long")))
    revisions = cut(newest(revisions, ["source"], [F.desc("revision")], keep))
    current = revisions.where("rank = 1").select("source", F.col("revision").alias("current"))
    sources = ids.join(current, "source", "left")
    kept = good.join(revisions.where("kept").select("path", "revision"), "path")
    entries = cut(numbered(kept, [F.asc("revision"), F.asc("seq")], "entry"))
    claims = entries.select("revision", "entry", F.posexplode("claims").alias("at", "c")).select("revision", "entry", "at", "c.*")
    claims = cut(numbered(claims, [F.asc("entry"), F.asc("at")], "claim"))
    unified = cut(identity.unify(claims.select(F.col("claim").cast("long").alias("claim"), "size", "sha256", "sha1", "md5", "crc32")))
    claims = cut(claims.join(unified, "claim", "left"))
    known = identity.identity_tuples(claims.select("claim", "size", "sha256", "sha1", "md5", "crc32"), unified)
    links = cut(identity.link_blobs(known, aliases, blobs))
    here = blobs.select("blob", "resident", F.lit(False).alias("grounded_verified"), F.lit(False).alias("grounded_claimed"))
    states = cut(audit.identity_status(links.join(here, "blob")))
    required = C.required(F.col("status"), F.col("optional"), "nodump")
    rollup = audit.entry_rollup(claims.join(revisions.where("rank = 1").select("revision"), "revision", "left_semi"), states, required)
    of_current = entries.join(revisions.where("rank = 1").select("revision"), "revision", "left_semi")
    audited = audit.with_entry_state(of_current.select("entry", "revision", "name"), rollup).fillna(0)
    return {"errors": errors, "sources": sources, "revisions": revisions, "entries": resolve_parents(entries), "claims": claims, "links": links, "states": states, "audit": audited}


def candidates_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(entry, name, cloneof, required, held, system) for selection.one_game_one_rom(): what each current entry requires, and how much of it is verified here."""
    held = tables["audit"].select("entry", "required", F.col("have_verified").alias("held"))
    system = tables["revisions"].join(tables["sources"].select("source", "current"), "source").where("revision = current").select("revision", "system")
    return tables["entries"].join(system, "revision").join(held, "entry").select("entry", "name", F.col("cloneof_id").alias("cloneof"), "required", "held", "system")
