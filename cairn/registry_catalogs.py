"""Queries over catalogs: files made from the driver's tables are read back, imported, selected from, laid out.

A catalog is a part's brand; its entries are parts; their files' digests follow from p_partkey % 500, so parts share contents.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import columns as C
from cairn.operators import byteops, identity, importing, layout, selection, store, views
from cairn.registered import fixture, query
from cairn.session import shared_dir
from cairn.sources import catalogs, containers, detectors, files

_PART = "SELECT p_partkey AS id, p_brand AS brand, 'part ' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_partkey % 500 AS BIGINT) AS c, p_partkey % 500 + 1 AS size, p_partkey % 17 = 0 AS nodump, p_partkey % 5 = 0 AS plain, p_partkey % 7 = 0 AS optional, CASE WHEN p_partkey % 4 <> 0 AND p_partkey > 4 THEN 'part ' || CAST(p_partkey - p_partkey % 4 AS VARCHAR) END AS parent FROM part"
_DIGESTS = "md5('c' || CAST(c AS VARCHAR)) AS md5, CASE WHEN NOT plain THEN sha1('c' || CAST(c AS VARCHAR)) END AS sha1"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, f"SELECT *, {_DIGESTS} FROM ({_PART}) p")


def _joined(rows: DataFrame, key: str, order: str, piece, head, tail) -> DataFrame:
    """(path, content): one file a key, its entries in order."""
    whole = rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, piece.alias("x")))), lambda s: s["x"]), "").alias("body"))
    return whole.select(F.col(key).alias("path"), F.concat(head, F.col("body"), tail).cast("binary").alias("content"))


def _attr(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')))


def _xml_files(spark: SparkSession, sf: str) -> DataFrame:
    rom = F.concat(F.lit('<rom name="f.bin"'), _attr("size", F.col("size")), _attr("md5", F.col("md5")), _attr("sha1", F.upper("sha1")), _attr("status", F.when(F.col("nodump"), "nodump")), _attr("optional", F.when(F.col("optional"), "yes")), F.lit(' serial="x"/>'))
    game = F.concat(F.lit("<game"), _attr("name", F.col("name")), _attr("cloneof", F.col("parent")), F.lit("><description>d &amp; e</description><unknown/>"), rom, F.lit('<release name="r" region="USA"/></game>\n'))
    head = F.concat(F.lit('<?xml version="1.0"?>\n<!DOCTYPE datafile SYSTEM "datafile.dtd">\n<datafile><header><name>'), F.col("brand"), F.lit("</name><version>1</version><homepage>https://example.org</homepage><author>Maker</author></header>\n"))
    return _joined(_parts(spark, sf), "brand", "id", game, head, F.lit("</datafile>"))


@query(f"SELECT brand AS path, name, parent AS cloneof, size, md5, sha1, CASE WHEN nodump THEN 'nodump' ELSE 'good' END AS status, optional FROM (SELECT *, {_DIGESTS} FROM ({_PART}) p) x")
def read_logiqx(spark, sf):
    """Catalogs in XML, entry by entry."""
    entries = catalogs.entries_of(_xml_files(spark, sf))
    return entries.select("path", "name", "cloneof", F.col("claims")[0].alias("c")).select("path", "name", "cloneof", F.col("c.size").alias("size"), "c.md5", "c.sha1", "c.status", "c.optional")


@query(f"SELECT brand AS path, name, size, md5 FROM (SELECT *, {_DIGESTS} FROM ({_PART}) p) x")
def export_round_trip(spark, sf):
    """Catalogs written as XML and read again."""
    text = catalogs.export_xml(catalogs.entries_of(_xml_files(spark, sf)))
    again = catalogs.entries_of(text.select("path", F.col("xml").cast("binary").alias("content")))
    return again.select("path", "name", F.col("claims")[0]["size"].alias("size"), F.col("claims")[0]["md5"].alias("md5"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS path, 's' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 3 = 1 THEN 's' || CAST(s_suppkey - 1 AS VARCHAR) END AS cloneof, s_suppkey % 9 = 0 AS is_device, s_suppkey % 13 = 0 AS is_bios, CAST(s_suppkey % 4 AS BIGINT) AS n_devices, CASE WHEN s_suppkey % 2 = 0 THEN 'disk' ELSE 'rom' END AS kind FROM supplier")
def read_listxml(spark, sf):
    """Machines with devices and disks."""
    rows = fixture(spark, sf, "SELECT s_nationkey, s_suppkey AS id FROM supplier")
    yes = lambda c: F.when(c, "yes")
    file = F.when(F.col("id") % 2 == 0, F.lit('<disk name="d" sha1="' + "a" * 40 + '"/>')).otherwise(F.lit('<rom name="r" size="0x10" crc="1f"/>'))
    machine = F.concat(F.lit("<machine"), _attr("name", F.concat(F.lit("s"), F.col("id").cast("string"))), _attr("cloneof", F.when(F.col("id") % 3 == 1, F.concat(F.lit("s"), (F.col("id") - 1).cast("string")))), _attr("isdevice", yes(F.col("id") % 9 == 0)), _attr("isbios", yes(F.col("id") % 13 == 0)), F.lit("><year>1990</year>"), file, F.repeat(F.lit('<device_ref name="z80"/>'), (F.col("id") % 4).cast("int")), F.lit('<chip type="cpu"/></machine>'))
    entries = catalogs.entries_of(_joined(rows, "s_nationkey", "id", machine, F.lit('<mame build="1">'), F.lit("</mame>")).withColumn("path", F.col("path").cast("string")))
    return entries.select("path", "name", "cloneof", "is_device", "is_bios", F.size("devices").cast("long").alias("n_devices"), F.col("claims")[0]["kind"].alias("kind"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS path, 's' || CAST(s_suppkey AS VARCHAR) AS name, 'p' || CAST(s_suppkey % 5 AS VARCHAR) AS publisher, CAST(s_suppkey % 3 + 1 AS BIGINT) AS n_files, CAST(16 * (s_suppkey % 3 + 1) AS BIGINT) AS bytes FROM supplier")
def read_softlist(spark, sf):
    """Software with parts and data areas; directives without a name are no files."""
    rows = fixture(spark, sf, "SELECT s_nationkey, s_suppkey AS id FROM supplier")
    area = F.concat(F.lit('<part name="cart" interface="i"><dataarea name="rom">'), F.repeat(F.lit('<rom name="f" size="0x10" crc="1"/><rom size="8" offset="8" loadflag="continue"/>'), (F.col("id") % 3 + 1).cast("int")), F.lit("</dataarea></part>"))
    software = F.concat(F.lit("<software"), _attr("name", F.concat(F.lit("s"), F.col("id").cast("string"))), F.lit("><publisher>p"), (F.col("id") % 5).cast("string"), F.lit("</publisher>"), area, F.lit("</software>"))
    entries = catalogs.entries_of(_joined(rows, "s_nationkey", "id", software, F.lit('<softwarelist name="l">'), F.lit("</softwarelist>")).withColumn("path", F.col("path").cast("string")))
    total = F.aggregate("claims", F.lit(0).cast("long"), lambda a, c: a + c["size"])
    return entries.select("path", "name", F.col("manufacturer").alias("publisher"), F.size("claims").cast("long").alias("n_files"), total.alias("bytes"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS path, 's ' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 7 = 0 AS is_bios, lpad(lower(printf('%x', s_suppkey)), 8, '0') AS crc32, CAST(s_suppkey AS BIGINT) AS size FROM supplier")
def read_paren(spark, sf):
    """Catalogs in parenthesised text."""
    rows = fixture(spark, sf, "SELECT s_nationkey, s_suppkey AS id FROM supplier")
    kind = F.when(F.col("id") % 7 == 0, "resource").otherwise("game")
    game = F.concat(kind, F.lit(' (\n\tname "s '), F.col("id").cast("string"), F.lit('"\n\trom ( name a.bin size '), F.col("id").cast("string"), F.lit(" crc "), F.lower(F.hex(F.col("id"))), F.lit(" )\n)\n"))
    entries = catalogs.entries_of(_joined(rows, "s_nationkey", "id", game, F.lit('clrmamepro (\n\tname "N"\n)\n'), F.lit("")).withColumn("path", F.col("path").cast("string")))
    return entries.select("path", "name", "is_bios", F.col("claims")[0]["crc32"].alias("crc32"), F.col("claims")[0]["size"].alias("size"))


_HEADS = "SELECT n_nationkey AS id, CASE n_nationkey % 8 WHEN 0 THEN '<?xml version=\"1.0\"?><datafile>' WHEN 1 THEN '  <mame build=\"1\">' WHEN 2 THEN '<!DOCTYPE softwarelist SYSTEM \"softwarelist.dtd\">' WHEN 3 THEN 'clrmamepro (' WHEN 4 THEN 'emulator (' WHEN 5 THEN '[CREDITS]' WHEN 6 THEN '[DAT]' ELSE 'plain ' || n_name END AS head FROM nation"


@query(f"SELECT id, CASE id % 8 WHEN 0 THEN 'logiqx' WHEN 1 THEN 'listxml' WHEN 2 THEN 'softlist' WHEN 3 THEN 'paren' WHEN 4 THEN 'paren' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'unsupported' END AS format FROM ({_HEADS}) x")
def sniff_formats(spark, sf):
    """Formats by their first bytes; what is known and not supported is said so."""
    return fixture(spark, sf, _HEADS).select("id", catalogs.sniffed(F.col("head")).alias("format"))


@query("SELECT path, count(*) FILTER (WHERE ok) AS entries, count(*) FILTER (WHERE NOT ok) AS errors FROM (SELECT CAST(n_regionkey AS VARCHAR) AS path, n_regionkey <> 2 AS ok FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT CAST(r_regionkey AS VARCHAR), false FROM region WHERE r_regionkey IN (2, 3)) x GROUP BY path")
def scan_errors(spark, sf):
    """A file of an unknown format, and one that breaks off, are rows with an error; the rest is read."""
    rows = fixture(spark, sf, "SELECT n_regionkey, n_nationkey AS id FROM nation")
    made = _joined(rows, "n_regionkey", "id", F.lit('<game name="g"><rom name="r" size="1"/></game>'), F.when(F.col("n_regionkey") == 2, "what is this").otherwise("<datafile>"), F.when(F.col("n_regionkey") == 3, "<game").otherwise("</datafile>"))
    read = catalogs.entries_of(made.withColumn("path", F.col("path").cast("string")))
    return read.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("entries"), F.count_if(F.col("error").isNotNull()).alias("errors"))


_TERMS = "SELECT DISTINCT p_name AS name, 'g' || substr(p_name, 1, 2) AS grp FROM part"


@query(f"SELECT lower(name) AS term, grp AS \"group\" FROM ({_TERMS}) x")
def clonelist(spark, sf):
    """A clone list in JSON, as terms and groups; patterns are left out."""
    title = F.to_json(F.struct(F.col("name").alias("searchTerm")))
    one = F.concat(F.lit('{"group":'), F.to_json(F.struct("grp")).substr(F.lit(8), F.length("grp") + 2), F.lit(',"titles":['), F.array_join(F.sort_array(F.collect_list(title)), ","), F.lit(',{"searchTerm":".*","nameType":"regex"}]}'))
    groups = fixture(spark, sf, _TERMS).groupBy("grp").agg(one.alias("x"))
    doc = groups.agg(F.concat(F.lit('{"variants":['), F.array_join(F.sort_array(F.collect_list("x")), ","), F.lit("]}")).cast("binary").alias("content"))
    return catalogs.clonelist_of(doc)


# ---- import and selection

_STORED = "SELECT DISTINCT c AS blob, CASE WHEN c % 7 = 0 THEN size + 1 ELSE size END AS size, c % 2 = 0 AS resident, c FROM ({}) p WHERE c % 3 <> 0".format(_PART)


@query(
    f"WITH p AS ({_PART}) SELECT brand AS system, name, CASE WHEN nodump OR optional THEN 0 ELSE 1 END AS required, CASE WHEN NOT nodump AND NOT optional AND c % 3 <> 0 AND c % 7 <> 0 AND c % 2 = 0 THEN 1 ELSE 0 END AS have_verified, "
    "CASE WHEN NOT nodump AND NOT optional AND NOT (c % 3 <> 0 AND c % 7 <> 0 AND c % 2 = 0) THEN 1 ELSE 0 END AS missing, CASE WHEN nodump OR optional THEN 3 WHEN c % 3 <> 0 AND c % 7 <> 0 AND c % 2 = 0 THEN 0 ELSE 2 END AS state, "
    "CASE WHEN parent IN (SELECT name FROM p q WHERE q.brand = p.brand) THEN parent END AS parent FROM p"
)
def import_audit(spark, sf):
    """Catalog files imported and audited in one job: entries with their parents and states."""
    stored = fixture(spark, sf, _STORED)
    text = F.concat(F.lit("c"), F.col("c").cast("string"))
    aliases = stored.select(F.lit("md5").alias("algo"), F.md5(text).alias("digest"), "blob").union(stored.select(F.lit("sha1"), F.sha1(text), "blob"))
    t = importing.import_catalogs(_xml_files(spark, sf), aliases, stored.select("blob", "size", "resident"), 0)
    system = t["revisions"].select("revision", "system")
    entries = t["entries"].select("revision", "entry", "cloneof_id")
    up = t["entries"].select(F.col("entry").alias("cloneof_id"), F.col("name").alias("parent"))
    rows = t["audit"].join(system, "revision").join(entries.drop("revision"), "entry").join(up, "cloneof_id", "left")
    return rows.select("system", "name", F.col("required").cast("int").alias("required"), F.col("have_verified").cast("int").alias("have_verified"), F.col("missing").cast("int").alias("missing"), "state", "parent")


_GAMES = (
    "SELECT p_partkey AS entry, p_name || ' (' || CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'Europe' ELSE 'Japan' END || ') (' || CASE WHEN p_partkey % 2 = 0 THEN 'En' ELSE 'Fr' END || ')' || CASE p_size % 4 WHEN 0 THEN ' (Rev B)' WHEN 1 THEN ' (Rev 99999999999)' ELSE ' (Rev ' || CAST(p_size AS VARCHAR) || ')' END "
    "|| CASE WHEN p_size % 5 = 0 THEN ' (Beta 1)' ELSE '' END AS name, CAST(NULL AS BIGINT) AS cloneof, CAST(p_size % 3 AS BIGINT) AS required, CAST(p_size % 2 AS BIGINT) AS held, p_name, p_size, p_brand AS brand FROM part"
)
_SCORE = "CASE WHEN required > 0 AND held = required THEN 0 ELSE 1 END, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, CASE WHEN entry % 2 = 0 THEN 1 ELSE 0 END, CASE p_size % 4 WHEN 0 THEN -2 WHEN 1 THEN 0 ELSE -p_size END, name, entry"
_LISTED = "SELECT DISTINCT lower(p_name) AS term, 'g' || lower(substr(p_name, 1, 2)) AS grp FROM part WHERE length(p_name) % 2 = 0"


@query(f"WITH c AS ({_GAMES}), l AS ({_LISTED}), f AS (SELECT c.*, CASE WHEN grp IS NOT NULL THEN 'group:' || grp ELSE 'name:' || lower(p_name) END AS family FROM c LEFT JOIN l ON lower(p_name) = term) SELECT family, entry FROM (SELECT family, entry, row_number() OVER (PARTITION BY family ORDER BY {_SCORE}) AS n FROM f) x WHERE n = 1")
def one_game_one_rom(spark, sf):
    """One entry of each family, by a clone list and by names."""
    listed = fixture(spark, sf, _LISTED).withColumnRenamed("grp", "group")
    return selection.one_game_one_rom(fixture(spark, sf, _GAMES), ["USA", "jp"], ["fr"], clonelist=listed)


@query(f"WITH c AS (SELECT *, CASE WHEN entry % 4 <> 0 AND entry > 4 THEN entry - entry % 4 END AS parent FROM ({_GAMES}) g), f AS (SELECT *, 'entry:' || CAST(coalesce(parent, entry) AS VARCHAR) AS family FROM c) SELECT family, entry FROM (SELECT family, entry, row_number() OVER (PARTITION BY family ORDER BY {_SCORE.split(', ', 1)[1]}) AS n FROM f) x WHERE n = 1")
def one_game_clones(spark, sf):
    """One entry of each family of clones, whatever is held."""
    games = fixture(spark, sf, _GAMES).withColumn("cloneof", F.when((F.col("entry") % 4 != 0) & (F.col("entry") > 4), F.col("entry") - F.col("entry") % 4))
    return selection.one_game_one_rom(games, ["USA", "jp"], ["fr"], strict=True)


@query("SELECT p_brand AS brand, count(*) AS entries, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)) AS with_large FROM part GROUP BY p_brand")
def flagged_entries(spark, sf):
    """Entries per catalog, and how many have a claim of a kind: an EXISTS inside an aggregate, by a distinct flag."""
    flag = fixture(spark, sf, "SELECT l_partkey AS entry FROM lineitem WHERE l_quantity > 45").distinct().withColumn("flag", F.lit(True))
    return fixture(spark, sf, _GAMES).join(flag, "entry", "left").groupBy("brand").agg(F.count(F.lit(1)).alias("entries"), F.count_if("flag").alias("with_large"))


_IDS = "SELECT p_partkey AS identity, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 500 + 1 AS BIGINT) END AS size, CAST(NULL AS VARCHAR) AS sha256, CASE WHEN p_partkey % 5 <> 0 THEN sha1('c' || CAST(p_partkey % 500 AS VARCHAR)) END AS sha1, md5('c' || CAST(p_partkey % 500 AS VARCHAR)) AS md5, CAST(NULL AS VARCHAR) AS crc32, CAST(p_partkey % 500 AS BIGINT) AS c FROM part"


@query(
    f"WITH i AS ({_IDS}), b AS ({_STORED}), strong AS (SELECT identity, b.blob AS blob, CASE WHEN sha1 IS NOT NULL THEN 2 ELSE 1 END AS basis FROM i JOIN b ON b.c = i.c WHERE i.size IS NULL OR i.size = b.size) "
    "SELECT * FROM strong UNION ALL SELECT identity, 1000 + i.c, -1 FROM i WHERE size IS NULL AND sha1 IS NOT NULL AND i.c % 2 = 0"
)
def link_blobs(spark, sf):
    """Contents of identities: all known digests and the size must fit; disk images by the sha1 that they declare."""
    stored = fixture(spark, sf, _STORED)
    text = F.concat(F.lit("c"), F.col("c").cast("string"))
    aliases = stored.select(F.lit("md5").alias("algo"), F.md5(text).alias("digest"), "blob").union(stored.select(F.lit("sha1"), F.sha1(text), "blob"))
    disks = fixture(spark, sf, "SELECT DISTINCT CAST(p_partkey % 500 AS BIGINT) AS c FROM part WHERE p_partkey % 500 % 2 = 0")
    aliases = aliases.union(disks.select(F.lit("disk_sha1"), F.sha1(F.concat(F.lit("c"), F.col("c").cast("string"))), F.col("c") + 1000))
    return identity.link_blobs(fixture(spark, sf, _IDS).drop("c"), aliases, stored.select("blob", "size"))


_CONFLICTS = "SELECT doc_id AS claim, CAST(length(text) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS sha256, sha1(text) AS sha1, CASE WHEN doc_id % 2 = 0 THEN md5(text || CAST(doc_id % 3 AS VARCHAR)) END AS md5, CAST(NULL AS VARCHAR) AS crc32 FROM documents"


@query(
    f"WITH c AS ({_CONFLICTS}), keyed AS (SELECT claim, size, sha1, md5 FROM c), firsts AS (SELECT size, sha1, md5, min(claim) AS claim FROM keyed GROUP BY size, sha1, md5), "
    # among claims of one sha1, each md5 makes an identity; claims without md5 join the oldest, and the first md5 after a lone claim without one is absorbed by it
    "ordered AS (SELECT sha1, md5, claim, row_number() OVER (PARTITION BY sha1 ORDER BY claim) AS n FROM firsts), lead_ AS (SELECT sha1, min(claim) FILTER (WHERE md5 IS NULL) AS bare, min(claim) FILTER (WHERE md5 IS NOT NULL) AS full_ FROM firsts GROUP BY sha1), "
    "ids AS (SELECT f.sha1 AS sha1, f.md5 AS md5, CASE WHEN f.md5 IS NULL THEN least(l.bare, coalesce(l.full_, l.bare)) WHEN f.claim = l.full_ THEN least(f.claim, coalesce(l.bare, f.claim)) ELSE f.claim END AS identity FROM firsts f JOIN lead_ l ON l.sha1 = f.sha1) "
    "SELECT c.claim AS claim, ids.identity AS identity FROM c JOIN ids ON ids.sha1 = c.sha1 AND ids.md5 IS NOT DISTINCT FROM c.md5"
)
def unify_conflicts(spark, sf):
    """Claims that share a sha1 and differ in md5 are several identities; which one a claim without md5 joins depends on the order."""
    return identity.unify(fixture(spark, sf, _CONFLICTS))


# ---- layout

_VIEW = "SELECT p_partkey AS entry, p_name || CASE WHEN p_partkey % 9 = 0 THEN '//x' || chr(92) || 'y' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '.bin' ELSE '' END AS name, sha256(CAST(p_partkey AS VARCHAR)) AS hash, CAST(p_size AS BIGINT) AS size, p_brand || CAST(p_partkey % 40 AS VARCHAR) AS family, CASE WHEN p_type LIKE 'S%' THEN 0 ELSE 1 END AS rank, -p_size AS rev FROM part"


@query(
    f"""WITH c AS ({_VIEW}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank, rev, entry) AS n FROM c) y WHERE n = 1),
p AS (SELECT entry, hash, size, CASE WHEN regexp_matches(name, '^[A-Za-z]') THEN upper(substr(name, 1, 1)) ELSE '#' END || '/' || trim(regexp_replace(replace(name, chr(92), '/'), '/+', '/', 'g'), '/') AS path, name FROM best WHERE size <= 45),
q AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY entry, name) = 1 THEN path WHEN regexp_matches(path, '^.+\\.[^.]*$') THEN regexp_replace(path, '^(.+)(\\.[^.]*)$', '\\1 (' || substr(hash, 1, 8) || ')\\2') ELSE path || ' (' || substr(hash, 1, 8) || ')' END AS fp FROM p),
full_ AS (SELECT split_part(fp, '/', 1) AS dir FROM q GROUP BY 1 HAVING count(DISTINCT split_part(fp, '/', 2)) > 60)
SELECT CASE WHEN split_part(fp, '/', 1) IN (SELECT dir FROM full_) AND split_part(fp, '/', 3) = '' THEN split_part(fp, '/', 1) || '/' || CASE WHEN regexp_matches(split_part(fp, '/', 2), '^[A-Za-z]') THEN upper(substr(split_part(fp, '/', 2), 1, 1)) ELSE '#' END || '/' || split_part(fp, '/', 2) ELSE fp END AS path, entry, hash, size FROM q"""
)
def view_manifest(spark, sf):
    """A view: one of each family, paths repaired, collisions numbered, overfull directories in buckets."""
    view = views.ViewDef("parts", one_per_family=True, score=("rank", "rev"), profile=views.Profile(max_size=45, directory_limit=60))
    return views.evaluate(view, fixture(spark, sf, _VIEW))


@query("SELECT p_partkey AS entry, 'x/' || CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END || '_' AS path FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END)")
def view_snapshot(spark, sf):
    """A manifest written as a snapshot: sorted, each path once, with a device's characters."""
    rows = fixture(spark, sf, "SELECT min(p_partkey) AS entry, CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END || '?.' AS name, 'h' AS hash, CAST(1 AS BIGINT) AS size FROM part GROUP BY CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END || '?.'")
    return views.snapshot(views.evaluate(views.ViewDef("v", "x/{name}", profile="everdrive"), rows)).select("entry", "path")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND NOT p_name LIKE '%n' THEN p_name || '.chd' WHEN p_size % 2 = 0 THEN p_name || '.CHD' ELSE p_name END AS file FROM part")
def disk_names(spark, sf):
    rows = fixture(spark, sf, "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'disk' ELSE 'rom' END AS kind, CASE WHEN p_size % 2 = 0 AND p_name LIKE '%n' THEN p_name || '.CHD' ELSE p_name END AS name FROM part")
    return rows.select("id", layout.file_name(F.col("name"), F.col("kind")).alias("file"))


_MACHINES = "SELECT s_suppkey AS machine, s_suppkey % 9 = 0 AS is_device FROM supplier"
_DEVICES = "SELECT s_suppkey AS machine, s_suppkey * 3 % 90 + 9 AS device FROM supplier UNION ALL SELECT s_suppkey, -s_suppkey FROM supplier WHERE s_suppkey % 4 = 0"


@query(f"WITH RECURSIVE m AS ({_MACHINES}), d AS ({_DEVICES}), r(root, node) AS (SELECT machine, machine FROM m WHERE NOT is_device UNION SELECT root, device FROM r JOIN d ON node = d.machine WHERE device IN (SELECT machine FROM m)) SELECT root AS set, count(*) AS n FROM r JOIN d ON node = d.machine WHERE device NOT IN (SELECT machine FROM m) GROUP BY root")
def dangling_devices(spark, sf):
    """References to devices that are not there, by set."""
    return layout.dangling_devices(fixture(spark, sf, _MACHINES), fixture(spark, sf, _DEVICES))


# ---- names and numbers

_NAMES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) || ' Games in 1! - ' ELSE '' END || p_name || ' ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (USA, Europe)' ELSE ' (USA, Beta)' END || CASE WHEN p_partkey % 5 = 0 THEN ' -' ELSE '' END || '.bin' AS name FROM part"


@query(
    f"WITH n AS ({_NAMES}), a AS (SELECT id, name, regexp_replace(name, '^[0-9]+ Games in 1! - ', '') AS r1 FROM n), b AS (SELECT *, replace(r1, '(USA, Europe)', '(U,E)') AS r2 FROM a), c AS (SELECT *, regexp_replace(regexp_replace(r2, '\\.bin$', ''), '[ .-]+$', '') || '.bin' AS r3 FROM b) "
    "SELECT id, CASE WHEN length(name) <= 40 THEN name WHEN length(r1) <= 40 THEN r1 WHEN length(r2) <= 40 THEN r2 WHEN length(r3) <= 40 THEN r3 ELSE substr(regexp_replace(r3, '\\.bin$', ''), 1, 36) || '.bin' END AS fitted FROM c"
)
def fitted_names(spark, sf):
    """File names cut to 40 bytes by rules before they are cut short."""
    return fixture(spark, sf, _NAMES).select("id", byteops.fit_component_udf(40)("name").alias("fitted"))


_ODD = "SELECT p_partkey AS id, p_name || CASE p_partkey % 5 WHEN 0 THEN '/..' WHEN 1 THEN chr(92) || 'a' WHEN 2 THEN ':?. ' WHEN 3 THEN '' ELSE '//b' END AS name FROM part"


@query(
    f"WITH o AS ({_ODD}) SELECT id, replace(replace(name, '/', '_'), chr(92), '_') AS component, CASE id % 5 WHEN 0 THEN regexp_replace(name, '/\\.\\.$', '/_') WHEN 1 THEN replace(name, chr(92), '/') WHEN 4 THEN replace(name, '//', '/') ELSE name END AS path, "
    "regexp_replace(regexp_replace(name, '[\"*/:<>?|]|' || chr(92) || chr(92), '_', 'g'), '[. ]+$', '') AS fat, CASE WHEN id % 5 IN (0, 1, 4) THEN false ELSE true END AS canonical FROM o"
)
def safe_names(spark, sf):
    """Names made fit for paths."""
    rows = fixture(spark, sf, _ODD)
    return rows.select("id", C.safe_component(F.col("name")).alias("component"), C.safe_name(F.col("name")).alias("path"), C.fat_component(F.col("name")).alias("fat"), C.canonical_path(F.col("name")).alias("canonical"))


_RAW = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '0x' || lower(hex(c_custkey)) WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN ' ' || CAST(c_custkey AS VARCHAR) || ' ' ELSE 'none' END AS size, CASE WHEN c_custkey % 3 = 0 THEN 'xyz' ELSE hex(c_custkey) END AS crc, CASE c_custkey % 3 WHEN 0 THEN 'https://a.b' WHEN 1 THEN 'WWW.a.b' ELSE c_name END AS home, CASE c_custkey % 3 WHEN 0 THEN 'p/' || c_name WHEN 1 THEN '/x' ELSE c_name || '/s/t' END AS source, CASE c_custkey % 4 WHEN 0 THEN 'EOF' WHEN 1 THEN '-10' WHEN 2 THEN '1F' ELSE 'ffff' END AS spec FROM customer"


@query(
    f"WITH r AS ({_RAW}) SELECT id, CASE WHEN id % 4 <> 3 THEN CAST(id AS BIGINT) END AS size, CASE WHEN id % 3 <> 0 THEN lpad(lower(crc), 8, '0') END AS crc, id % 3 IN (0, 1) AS is_url, CASE WHEN id % 3 = 2 THEN home ELSE 'me' END AS provider, "
    "CASE id % 3 WHEN 0 THEN 'p' WHEN 2 THEN regexp_replace(source, '/s/t$', '') END AS source_provider, CASE id % 3 WHEN 0 THEN regexp_replace(source, '^p/', '') WHEN 2 THEN 's/t' END AS source_system, CASE id % 4 WHEN 0 THEN CAST(100 AS BIGINT) WHEN 1 THEN 84 WHEN 2 THEN 31 END AS place FROM r"
)
def parsed_values(spark, sf):
    """Sizes, digests, addresses, sources and offsets as catalogs write them."""
    rows = fixture(spark, sf, _RAW)
    source = C.split_source(F.col("source"))
    return rows.select("id", C.size_number(F.col("size")).alias("size"), C.crc_hex(F.col("crc")).alias("crc"), C.url_shaped(F.col("home")).alias("is_url"), C.provider(F.col("home"), F.lit("me")).alias("provider"), source["provider"].alias("source_provider"), source["system"].alias("source_system"), C.header_offset(F.col("spec"), F.lit(100).cast("long")).alias("place"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS state FROM orders")
def decoded_states(spark, sf):
    rows = fixture(spark, sf, "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS code FROM orders")
    return rows.select("id", C.decode(F.col("code"), {0: "running", 1: "done", 2: "failed", 3: "interrupted"}).alias("state"))


@query("SELECT s_suppkey AS id, CAST(s_suppkey // 100 * 90 AS BIGINT) AS share, CAST(s_suppkey % 7 * 1024 AS BIGINT) AS fixed, CASE WHEN s_suppkey % 2 = 0 THEN 'assemble@1' ELSE 'c0ffee#run' END AS op, CASE WHEN s_suppkey % 2 = 0 THEN 'assemble' ELSE 'run' END AS verb, CASE s_suppkey % 3 WHEN 0 THEN 'transform' WHEN 1 THEN 'extractor' ELSE 'other' END AS world FROM supplier")
def settings_and_ops(spark, sf):
    """Watermarks, the names under which operations are indexed, and their worlds."""
    rows = fixture(spark, sf, "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'x:transform@1' WHEN 1 THEN 'x:extractor@1' ELSE 'x:transform@1.0.0' END AS w FROM supplier")
    component = F.when(F.col("id") % 2 != 0, "c0ffee")
    op = C.op_index_name(F.lit("assemble"), F.lit(1), component, F.lit("run"))
    return rows.select("id", C.watermark("90%", F.col("id")).alias("share"), (F.col("id") % 7 * C.watermark("1k", F.col("id"))).cast("long").alias("fixed"), op.alias("op"), C.route_verb(op).alias("verb"), C.world(F.col("w"), "x").alias("world"))


# ---- files, containers, bytes


@F.pandas_udf(T.BinaryType())
def _zip_of(texts: pd.Series) -> pd.Series:
    def one(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a/text.txt", text.encode(), zipfile.ZIP_DEFLATED)
            z.writestr("stored.bin", text.encode()[:10])
        return out.getvalue()

    return texts.map(one)


@F.pandas_udf(T.BinaryType())
def _deflated(texts: pd.Series) -> pd.Series:
    def one(text: str) -> bytes:
        packer = zlib.compressobj(wbits=-15)
        return packer.compress(text.encode()) + packer.flush()

    return texts.map(one)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, 'a/text.txt' AS member, 'deflate' AS method, CAST(strlen(text) AS BIGINT) AS size FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'stored.bin', 'stored', least(strlen(text), 10) FROM documents")
def zip_members(spark, sf):
    """Members of zip files by their central directories."""
    made = fixture(spark, sf, "SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents").select("path", _zip_of("text").alias("content"))
    return files.zip_members(made).where("note IS NULL").select("path", "member", "method", "size")


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def inflate_windows(spark, sf):
    """Deflate windows back to bytes."""
    packed = fixture(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", _deflated("text").alias("b"))
    return packed.select("doc_id", F.md5(byteops.inflate("b")).alias("md5"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 5 END AS version, CASE WHEN c_custkey % 3 <> 0 THEN sha1(c_name) END AS sha1, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 = 0 END AS has_parent FROM customer")
def disk_headers(spark, sf):
    """Headers of compressed disk images: version, declared digest, whether there is a parent."""
    rows = fixture(spark, sf, "SELECT c_custkey AS id, sha1(c_name) AS sha1 FROM customer")
    mark = F.when(F.col("id") % 3 == 0, F.lit(b"ComprHD?")).otherwise(F.lit(b"MComprHD"))
    parent = F.when(F.col("id") % 2 == 0, F.repeat(F.lit("ab"), 20)).otherwise(F.repeat(F.lit("00"), 20))
    content = F.concat(mark, F.unhex(F.lit("0000007c00000005")), F.unhex(F.repeat(F.lit("00"), 68)), F.unhex("sha1"), F.unhex(parent))
    head = files.disk_header(F.col("content"))
    return rows.select("id", content.alias("content")).select("id", *(c.alias(k) for k, c in head.items()))


@query("SELECT n_regionkey AS region, md5(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS md5, CAST(sum(length(n_name) + 1) AS BIGINT) AS size, CAST(0 AS BIGINT) AS changed FROM nation GROUP BY n_regionkey")
def scan_folder(spark, sf):
    """Files below a folder with their digests; a second scan finds none changed."""
    folder = f"{shared_dir(spark).rstrip('/')}/cairn-scan-{spark.sparkContext.applicationId}"
    rows = fixture(spark, sf, "SELECT n_regionkey AS region, n_nationkey AS id, n_name FROM nation")
    rows.repartition("region").sortWithinPartitions("region", "id").select("region", F.col("n_name").alias("value")).write.mode("overwrite").partitionBy("region").text(folder)
    found = files.scan(spark, folder).where("path LIKE '%/region=%'")
    known = files.ingest(found)
    changed = files.changed(found, known).agg(F.count(F.lit(1)).alias("changed"))
    region = F.regexp_extract("path", "region=([0-9]+)", 1).cast(rows.schema["region"].dataType).alias("region")
    return known.select(region, "md5", "size").crossJoin(changed)  # one row


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '7z' WHEN 1 THEN 'rar5' WHEN 2 THEN 'zip' END AS kind FROM pages")
def archive_kinds(spark, sf):
    """Archives by their first bytes."""
    rows = fixture(spark, sf, "SELECT page_id, url FROM pages")
    marks = [F.lit(containers.ARCHIVES[k]) for k in ("7z", "rar5", "zip")]
    head = F.when(F.col("page_id") % 4 == 0, marks[0]).when(F.col("page_id") % 4 == 1, marks[1]).when(F.col("page_id") % 4 == 2, marks[2]).otherwise(F.lit(b""))
    return rows.select("page_id", containers.archive_kind(F.concat(head, F.col("url").cast("binary"))).alias("kind"))


@query("SELECT conv_id AS path, sha256(text) AS sha256, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place, CAST(strlen(text) AS BIGINT) AS len FROM conversations")
def scan_packs(spark, sf):
    """Sealed packs, one a conversation, and the members that their tables list."""
    rows = fixture(spark, sf, "SELECT conv_id, turn, text FROM conversations")
    members = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"].cast("binary"))
    packs = rows.groupBy(F.col("conv_id").alias("path")).agg(members.alias("m")).select("path", containers.seal_udf("m").alias("content"))
    return containers.scan_packs(packs).where("note IS NULL").select("path", "sha256", F.col("offset").alias("place"), "len")


def _narc(spark: SparkSession, sf: str) -> DataFrame:
    """A nested archive a nation: its customers' names, and every fifth nation's broken."""
    rows = fixture(spark, sf, "SELECT c_nationkey, c_custkey, c_name FROM customer")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import struct

        names = [n.encode() for n in pdf.sort_values("c_custkey").c_name]
        at, table = 0, b""
        for n in names:
            table += struct.pack("<II", at, at + len(n))
            at += len(n)
        blocks = b"BTAF" + struct.pack("<IHH", 12 + len(table), len(names), 0) + table + b"BTNF" + struct.pack("<I", 16) + b"\0" * 8
        image = b"".join(names) + b"\xff" * 5
        blocks += b"GMIF" + struct.pack("<I", 8 + len(image)) + image
        nation = int(pdf.c_nationkey.iloc[0])
        head = b"NARC" + b"\xfe\xff" + struct.pack("<HIHH", 1, 16 + len(blocks), 16, 3)
        return pd.DataFrame({"path": [nation], "content": [(b"BROKEN" if nation % 5 == 0 else b"") + head + blocks]})

    return rows.groupBy("c_nationkey").applyInPandas(build, "path long, content binary")


@query("SELECT c_nationkey AS path, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE count(*) END AS pieces, CAST(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE sum(length(c_name)) END AS BIGINT) AS bytes, CAST(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 5 END AS BIGINT) AS filled, c_nationkey % 5 = 0 AS refused FROM customer GROUP BY c_nationkey")
def container_layouts(spark, sf):
    """Nested archives as coverage maps; broken ones are refused."""
    rows = containers.layouts(_narc(spark, sf), "narc")
    piece, fill = F.col("part") == "piece", F.col("part") == "fill"
    return rows.groupBy("path").agg(F.count_if(piece).alias("pieces"), F.coalesce(F.sum(F.when(piece, F.col("len"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(fill, F.col("len"))), F.lit(0)).alias("filled"), F.max(F.col("note").isNotNull()).alias("refused"))


def _cartridges(spark: SparkSession, sf: str) -> DataFrame:
    """A cartridge image a nation: a header, a program, its customers' names as files, and every fifth header broken."""
    rows = fixture(spark, sf, "SELECT c_nationkey, c_custkey, c_name FROM customer")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import struct

        names = [n.encode() for n in pdf.sort_values("c_custkey").c_name]
        nation, head = int(pdf.c_nationkey.iloc[0]), bytearray(0x200)
        table_at, at = 0x240, 0x240 + 8 * len(names)
        table = b""
        for n in names:
            table += struct.pack("<II", at, at + len(n))
            at += len(n)
        for place, value in ((0x20, 0x200), (0x2C, 0x30), (0x48, table_at), (0x4C, len(table))):
            struct.pack_into("<I", head, place, value)
        struct.pack_into("<H", head, 0x15E, byteops.crc16(bytes(head[:0x15E])) ^ (nation % 5 == 0))
        return pd.DataFrame({"path": [nation], "content": [bytes(head) + b"P" * 0x30 + b"\0" * 0x10 + table + b"".join(names) + b"\xff" * 9]})

    return rows.groupBy("c_nationkey").applyInPandas(build, "path long, content binary")


@query("SELECT c_nationkey AS path, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE count(*) END AS files, CAST(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE sum(length(c_name)) + 512 + 48 + 16 + 8 * count(*) + 9 END AS BIGINT) AS covered, CAST(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 25 END AS BIGINT) AS filled FROM customer GROUP BY c_nationkey")
def cartridge_layouts(spark, sf):
    """Cartridge images covered to the last byte; those with a wrong checksum are refused."""
    rows = containers.layouts(_cartridges(spark, sf), "cartridge")
    is_file = F.col("name").startswith("file/")
    return rows.groupBy("path").agg(F.count_if(F.coalesce(is_file, F.lit(False))).alias("files"), F.coalesce(F.sum("len"), F.lit(0)).alias("covered"), F.coalesce(F.sum(F.when(F.col("part") == "fill", F.col("len"))), F.lit(0)).alias("filled"))


@query("SELECT o_orderkey AS entry, CASE WHEN o_custkey % 3 = 1 THEN 'second' ELSE 'first' END AS note, CAST(o_custkey % 3 AS INTEGER) AS revision FROM orders")
def insert_by_revision(spark, sf):
    """Entries written by revision; one revision written again replaces itself only."""
    folder = f"{shared_dir(spark).rstrip('/')}/cairn-entries-{spark.sparkContext.applicationId}"
    rows = fixture(spark, sf, "SELECT o_orderkey AS entry, CAST(o_custkey % 3 AS INTEGER) AS revision FROM orders")
    store.bulk_insert(rows.withColumn("note", F.lit("first")), folder, "revision")
    store.bulk_insert(rows.where("revision = 1").withColumn("note", F.lit("second")), folder, "revision")
    return spark.read.parquet(folder).select("entry", "note", "revision")


_DETECTOR = b"""<detector><name>Sample</name><author>a</author><version>1</version>
<rule start_offset="4" end_offset="EOF" operation="none"><data offset="0" value="48454144" result="true"/></rule>
<rule start_offset="0" end_offset="-2"><and offset="0" mask="F0" value="70"/><file size="8" operator="greater"/></rule>
<rule start_offset="2"><data offset="FFFF" value="00" result="false"/></rule></detector>"""


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 4 ELSE 0 END AS start_at, CAST(CASE WHEN id % 3 <> 0 AND regexp_matches(name, '^[p-z]') AND length(name) > 8 THEN length(name) - 2 WHEN id % 3 = 0 THEN length(name) + 4 ELSE length(name) END AS BIGINT) AS end_at, CASE WHEN id % 3 = 0 OR (regexp_matches(name, '^[p-z]') AND length(name) > 8) THEN 'Sample' END AS detector FROM (SELECT p_partkey AS id, lower(p_name) AS name FROM part) x")
def detect_headers(spark, sf):
    """Where files' data starts and ends, by a detector's rules; a test outside the file fails its rule."""
    rows = fixture(spark, sf, "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'HEAD' ELSE '' END || lower(p_name) AS content FROM part")
    found = detectors.detect(rows, [detectors.parse(_DETECTOR)], "id")
    return found.select("id", F.col("start").cast("int").alias("start_at"), F.col("end").alias("end_at"), "detector")


_HEX = "upper(sha256(c_name))"


@query(
    f"SELECT c_custkey AS id, regexp_replace({_HEX}, '(..)(..)', '\\2\\1', 'g') AS byte_swap, regexp_replace({_HEX}, '(..)(..)(..)(..)', '\\4\\3\\2\\1', 'g') AS word_swap, regexp_replace({_HEX}, '(..)(..)(..)(..)', '\\3\\4\\1\\2', 'g') AS word_byte_swap, regexp_replace(translate({_HEX}, '0123456789ABCDEF', '084C2A6E195D3B7F'), '(.)(.)', '\\2\\1', 'g') AS bit_swap FROM customer"
)
def byte_orders(spark, sf):
    """Bytes, pairs, groups and bits turned round."""
    rows = fixture(spark, sf, "SELECT c_custkey AS id, sha256(c_name) AS h FROM customer").select("id", F.unhex("h").alias("b"))
    return rows.select("id", *(F.hex(byteops.swapped(kind)("b")).alias(name) for kind, name in (("byte", "byte_swap"), ("word", "word_swap"), ("word-byte", "word_byte_swap"), ("bit", "bit_swap"))))


@query(f"SELECT s_suppkey AS id, CAST(list_reduce(list_concat([65535], list_transform(string_split(s_name, ''), lambda c: ascii(c))), lambda a, x: xor(a >> 8, [{', '.join(map(str, byteops.CRC16))}][(xor(a, x) & 255) + 1])) AS INTEGER) AS crc16 FROM supplier")
def checksums(spark, sf):
    rows = fixture(spark, sf, "SELECT s_suppkey AS id, s_name FROM supplier")
    return rows.select("id", byteops.crc16_udf(F.col("s_name").cast("binary")).alias("crc16"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS seq, least(16384, strlen(text) - i * 16384) AS len FROM documents, range(0, 2000) r(i) WHERE i * 16384 < strlen(text)")
def outboard_groups(spark, sf):
    """Groups of 16 KiB with their digests, by which a range can be verified."""
    return byteops.outboard(fixture(spark, sf, "SELECT doc_id, text FROM documents"), "doc_id", "text").where(F.length("sha256") == 64).select("doc_id", "seq", "len")


@query("SELECT conv_id AS owner, lower(hex(encode('<'))) || string_agg(lower(hex(encode(substr(text, 1, 5)))) || '2a2a', '' ORDER BY turn, text) AS data FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM conversations) c WHERE length(text) >= 5 GROUP BY conv_id")
def assemble_segments(spark, sf):
    """Outputs of literals, slices of sources and fills."""
    rows = fixture(spark, sf, "SELECT conv_id, turn, text FROM conversations").withColumn("text", F.regexp_replace("text", "[^ -~]", "?")).where("length(text) >= 5")
    rows = rows.withColumn("source", F.concat_ws(":", "conv_id", "turn", "text"))
    none = F.lit(None)
    place = lambda n: F.struct("turn", "text", F.lit(n).alias("n"))
    shape = lambda owner, seq, source, size, fill, literal: [owner.alias("owner"), seq.alias("seq"), source.cast("string").alias("source"), F.lit(0).cast("long").alias("offset"), size.cast("long").alias("len"), fill.cast("int").alias("fill"), literal.cast("binary").alias("literal")]
    slices = rows.select(*shape(F.col("conv_id"), place(1), F.col("source"), F.lit(5), none, none))
    fills = rows.select(*shape(F.col("conv_id"), place(2), none, F.lit(2), F.lit(42), none))
    heads = rows.select("conv_id").distinct().select(*shape(F.col("conv_id"), F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("").alias("text"), F.lit(0).alias("n")), none, none, none, F.lit("<")))
    sources = rows.select("source", F.col("text").cast("binary").alias("data")).distinct()
    return byteops.assemble_segments(slices.unionByName(fills).unionByName(heads), sources).select("owner", F.lower(F.hex("data")).alias("data"))


@query("SELECT conv_id, substr(hex(encode(string_agg(text, '' ORDER BY turn, text))), 201, 600) AS data FROM conversations GROUP BY conv_id")
def serve_ranges(spark, sf):
    """Bytes 100 to 400 of every assembled conversation."""
    rows = fixture(spark, sf, "SELECT conv_id, struct(turn, text) AS seq, text AS data FROM conversations")
    return byteops.serve_range(byteops.assemble(rows, "conv_id", "seq"), "conv_id", 100, 400).select("conv_id", F.hex("data").alias("data"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'identity@1' WHEN 1 THEN 'swap-byte@1' ELSE 'swap-word@1' END AS op, CASE c_custkey % 3 WHEN 0 THEN " + _HEX + f" WHEN 1 THEN regexp_replace({_HEX}, '(..)(..)', '\\2\\1', 'g') ELSE regexp_replace({_HEX}, '(..)(..)(..)(..)', '\\4\\3\\2\\1', 'g') END AS data FROM customer")
def apply_operations(spark, sf):
    """Each row through the operation that it names."""
    rows = fixture(spark, sf, "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'identity@1' WHEN 1 THEN 'swap-byte@1' ELSE 'swap-word@1' END AS op, sha256(c_name) AS h FROM customer")
    return byteops.apply_operations(rows.select("id", "op", F.unhex("h").alias("data"))).select("id", "op", F.hex("data").alias("data"))


# ---- store


@query("SELECT page_id, sha256(html) AS hash FROM pages WHERE substr(sha256(html), 1, 1) = 'a'")
def hash_prefix(spark, sf):
    rows = fixture(spark, sf, "SELECT page_id, sha256(html) AS hash FROM pages")
    return rows.where(C.hex_prefix(F.unhex("hash"), "A"))


@query("SELECT min(doc_id) AS key, sha256(text) AS hash FROM documents GROUP BY 2")
def put_contents(spark, sf):
    """Contents put twice are there once; the first put counts."""
    rows = fixture(spark, sf, "SELECT doc_id AS key, sha256(text) AS hash FROM documents")
    first = rows.groupBy("hash").agg(F.min("key").alias("key")).select("key", "hash")
    return store.insert_missing(first.where("key % 2 = 0"), first, ["hash"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS BIGINT) ELSE CAST(c_custkey AS BIGINT) END AS size, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def upsert_contents(spark, sf):
    """Rows replaced by key; a size that is known is not lost to a null."""
    old = fixture(spark, sf, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS BIGINT) ELSE CAST(c_custkey AS BIGINT) END AS size, 'old' AS state FROM customer WHERE c_custkey % 4 <> 0")
    new = fixture(spark, sf, "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS BIGINT) ELSE CAST(c_custkey AS BIGINT) END END AS size, 'new' AS state FROM customer WHERE c_custkey % 2 = 0")
    return store.upsert(old, new, ["id"], ["size"])


@query("SELECT d.doc_id AS wanted, b.doc_id AS found FROM documents d JOIN documents b ON md5(d.text) = md5(b.text) WHERE d.doc_id <> b.doc_id")
def digest_lookup(spark, sf):
    """Which other contents carry a digest: several may."""
    aliases = fixture(spark, sf, "SELECT doc_id AS found, 'md5' AS algo, md5(text) AS digest FROM documents")
    return aliases.select(F.col("found").alias("wanted"), "algo", "digest").join(aliases, ["algo", "digest"]).where("wanted <> found").select("wanted", "found")


_KEYS = "SELECT DISTINCT o_custkey AS key FROM orders"
_USES = f"SELECT key, key + 1 AS part FROM ({_KEYS}) k WHERE key % 2 <> 0 UNION ALL SELECT key, key - 8 AS part FROM ({_KEYS}) k WHERE key % 10 = 0"


@query(
    f"WITH gone AS (SELECT key FROM ({_KEYS}) k WHERE key % 2 <> 0 AND key % 3 <> 0 AND key % 5 <> 0), uses AS ({_USES}) SELECT key, 'reviewed' AS cause FROM gone "
    "UNION ALL SELECT DISTINCT part, 'cascade' FROM uses WHERE key IN (SELECT key FROM gone) AND part NOT IN (SELECT part FROM uses WHERE key NOT IN (SELECT key FROM gone)) AND part NOT IN (SELECT key FROM gone)"
)
def delete_orphans(spark, sf):
    """Reviewed rows that are still orphans and not marked to keep go, and with them the parts that nothing else uses."""
    keys = fixture(spark, sf, _KEYS)
    candidates = store.kept_back(keys.where("key % 3 <> 0"), keys.where("key % 5 = 0"), "key")
    return store.delete_reviewed(keys.where("key % 2 <> 0"), candidates, fixture(spark, sf, _USES), "key")


@query("SELECT doc_id AS hash, CASE WHEN doc_id % 23 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'corrupt' ELSE 'valid' END AS result FROM documents WHERE CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) * 100 < 30 * 256")
def scrub_sample(spark, sf):
    """A repeatable sample of the store hashed again."""
    docs = fixture(spark, sf, "SELECT doc_id AS hash, text FROM documents")
    found = docs.where("hash % 23 <> 0").select("hash", F.sha2(F.when(F.col("hash") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return store.scrub(docs.select("hash", F.sha2("text", 256).alias("digest")), found, percent=30)
