"""Small golden scenarios for operators that the driver tables do not exercise."""

import io
import zipfile

import pytest

from cairn.functions import columns as C
from cairn.operators import audit, byteops, diff, identity, queue, selection, store
from cairn.plans import graph
from cairn.sources import catalogs, files
from pyspark.sql import functions as F


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 5000)]
    got = dict(pairs(graph.connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert {got[i] for i in range(201)} == {0}
    assert {got[i] for i in range(1000, 1051)} == {1000}
    assert got[5000] == 5000


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_grounding_diamond_cycle_and_empty_inputs(spark):
    make = lambda rows: spark.createDataFrame(rows, "recipe long, node string")
    inputs = make([(1, "a"), (2, "a"), (3, "b"), (3, "c"), (4, "x"), (5, "y")])
    outputs = make([(1, "b"), (2, "c"), (3, "d"), (4, "y"), (5, "x"), (6, "free")])
    recipes = spark.createDataFrame([(i,) for i in range(1, 7)], "recipe long")
    got = {r.node for r in graph.grounded(recipes, inputs, outputs, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a", "b", "c", "d", "free"}
    found = graph.grounded(recipes, inputs, outputs, spark.createDataFrame([("a",)], "node string"))
    assert dict(pairs(graph.witnesses(found, inputs, outputs))) == {"b": 1, "c": 2, "d": 3, "free": 6}


def test_chain_top(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "node long, parent long")
    assert {top for _, top in pairs(graph.chain_top(chain))} == {0}


def test_grounding_of_mutual_inverses(spark):
    two = spark.createDataFrame([(1,), (2,)], "recipe long")
    inputs = spark.createDataFrame([(1, "p"), (2, "q")], "recipe long, node string")
    outputs = spark.createDataFrame([(1, "q"), (2, "p")], "recipe long, node string")
    for seed, want in ((["p"], {"p", "q"}), (["q"], {"p", "q"}), ([], set())):
        seeds = spark.createDataFrame([(s,) for s in seed], "node string")
        assert {r.node for r in graph.grounded(two, inputs, outputs, seeds).collect()} == want


CLAIM = "claim long, size long, sha256 string, sha1 string, md5 string, crc32 string"


@pytest.mark.parametrize(
    ("claims", "want"),
    [
        ([(1, 5, None, "s", "m", None), (2, 5, None, "s", None, None)], {1: 1, 2: 1}),  # same sha1 in two catalogs
        ([(1, None, None, "s", "m1", None), (2, None, None, "s", "m2", None)], {1: 1, 2: 2}),  # md5 conflict
        ([(1, 5, None, None, None, "c"), (2, 5, None, None, None, "c"), (3, 6, None, None, None, "c")], {1: 1, 2: 1, 3: 3}),
        ([(1, None, None, None, None, "c"), (2, None, None, None, None, None)], {1: None, 2: None}),  # unidentifiable
        ([(1, 5, None, None, "m", None), (2, 5, None, "s", None, None), (3, 5, None, "s", "m", None)], {1: 1, 2: 1, 3: 1}),  # absorbed by the grown tuple
        ([(i, 0, "z", "z", "z", "0") for i in range(1, 51)], {i: 1 for i in range(1, 51)}),  # one empty file
    ],
)
def test_unify(spark, claims, want):
    got = dict(pairs(identity.unify(spark.createDataFrame(claims, CLAIM))))
    # an identity keeps its number only up to the choice of survivor: compare as partitions
    parts = lambda d: {frozenset(k for k in d if d[k] == v and v is not None) for v in d.values()} - {frozenset()}
    assert parts(got) == parts(want)
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}


def test_link_blobs(spark):
    ids = spark.createDataFrame([(1, 5, None, "s", "m", None), (2, None, None, None, "m", None)], "identity long, size long, sha256 string, sha1 string, md5 string, crc32 string")
    alias = spark.createDataFrame([("sha1", "s", 7), ("md5", "m", 7), ("md5", "m", 8)], "algo string, digest string, blob long")
    blobs = spark.createDataFrame([(7, 5), (8, 9)], "blob long, size long")
    assert pairs(identity.link_blobs(ids, alias, blobs)) == [(1, 7, 2), (2, 7, 1), (2, 8, 1)]


def test_audit_six_states(spark):
    links = spark.createDataFrame(
        [(1, 3, True, False, False, 1), (2, 1, False, False, True, 2), (3, 0, True, False, False, 3), (4, 2, False, False, False, 4), (5, 0, False, False, False, 5)],
        "identity long, basis int, resident boolean, grounded_verified boolean, grounded_claimed boolean, blob long",
    )
    peers = spark.createDataFrame([(4,), (4,)], "blob long")
    states = audit.identity_status(links, peers)
    assert dict(pairs(states)) == {1: 4, 2: 3, 3: 1, 4: 2, 5: 0}
    claims = spark.createDataFrame([(10, i, 0, False) for i in (1, 2, 3, 4, 5, 6)] + [(11, 1, 0, False), (11, 5, 2, False), (12, 5, 0, True)], "entry long, identity long, status int, optional boolean")
    roll = audit.entry_rollup(claims, states, C.required(F.col("status"), F.col("optional")))
    assert pairs(roll) == [(10, 6, 1, 1, 1, 1, 3), (11, 1, 1, 0, 0, 0, 0)]
    entries = spark.createDataFrame([(10,), (11,), (12,)], "entry long")
    assert dict(pairs(audit.with_entry_state(entries, roll).select("entry", "state"))) == {10: 2, 11: 0, 12: 3}
    assert audit.totals(roll).first().asDict() == {"entries": 2, "complete": 1, "verified": 2, "probable": 1, "missing": 2, "claimed": 1, "peer": 1}


def test_sync_and_dirty(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, size long")
    b = spark.createDataFrame([("y", 3), ("z", 1)], "path string, size long")
    assert pairs(diff.sync_plan(a, b)) == [("x", "copy"), ("y", "replace"), ("z", "delete")]
    assert diff.is_dirty(a, b) and not diff.is_dirty(a, a)


def test_upsert_keeps_known_sizes(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k long, size long, n string")
    new = spark.createDataFrame([(1, None, "c"), (3, 9, "d")], "k long, size long, n string")
    assert pairs(store.upsert(old, new, ["k"], ["size"])) == [(1, 5, "c"), (2, 6, "b"), (3, 9, "d")]
    assert pairs(store.insert_missing(old, new, ["k"])) == [(1, 5, "a"), (2, 6, "b"), (3, 9, "d")]


def test_within_budget_ties(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(20)], "id long, size long")
    assert [r.id for r in selection.within_budget(rows, "size", ["-size", "id"], 35, 4).orderBy("id").collect()] == [0, 1, 2, 3]


def test_queue_lifecycle(spark):
    q = spark.createDataFrame([(1, "a", 0, 5, 0), (2, "a", 2, 9, 0), (3, "a", 2, 1, 100), (1, "low", 0, 1, 0)], "item long, analyzer string, priority int, enqueued_at long, leased_until long")
    got = queue.claim(q, "a", 10, 50, 60, ["low"])
    assert [(r["item"], r["leased_until"]) for r in got.collect()] == [(2, 110)]
    leased = queue.lease(q, got)
    assert queue.claim(leased, "a", 10, 60, 60, ["low"]).count() == 0
    rest, done = queue.complete(leased, spark.createDataFrame([], "item long, analyzer string, outcome int"), spark.createDataFrame([(2, "a", 0)], "item long, analyzer string, outcome int"))
    assert rest.count() == 3 and done.count() == 1


def test_translate_merges_adjacent_pieces(spark):
    s = spark.createDataFrame([("o", 1, 4, "x", 0), ("o", 2, 4, "x", 4), ("o", 3, 4, "y", 0)], "owner string, seq int, len long, src string, at long")
    got = byteops.translate(s, "owner", 2, 10, ["seq"], "len", "src", "at")
    assert pairs(got.select("src", "src_start", "piece_start", "piece_len")) == [("x", 2, 2, 6), ("y", 0, 8, 2)]


def test_cut_points_survive_an_insertion():
    import random

    data = random.Random(1).randbytes(200_000)
    ends = byteops.cut_points(data, 512, 2048, 8192)
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"inserted" + data
    ends = byteops.cut_points(moved, 512, 2048, 8192)
    again = [moved[a:b] for a, b in zip([0, *ends], ends)]
    assert b"".join(again) == moved
    assert sum(c in chunks for c in again) > 0.8 * len(again)


def test_small_functions(spark):
    row = spark.createDataFrame([("Game (USA, Europe) (Rev B) (Proto 1)", "ab", "0x1F")], "name string, crc string, size string").select(
        C.base_name(F.col("name")).alias("base"), C.paren_tokens(F.col("name")).alias("tokens"), C.crc_hex(F.col("crc")).alias("crc"), C.size_number(F.col("size")).alias("size"),
        C.is_dev(C.paren_tokens(F.col("name"))).alias("dev"), C.revision(C.paren_tokens(F.col("name"))).alias("rev"), C.canonical_path(F.lit("a/../b")).alias("bad"), C.fat_component(F.lit('a:b?. ')).alias("fat"), C.watermark("33%", F.lit(250)).alias("mark"),
    ).first()
    assert row.base == "game" and row.tokens == ["USA", "Europe", "Rev B", "Proto 1"] and row.crc == "000000ab" and row["size"] == 31
    assert row.dev and row.rev == 2 and not row.bad and row.fat == "a_b_" and row.mark == 66


def test_byte_orders_and_names(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04"),)], "b binary")
    got = df.select(byteops.swapped("byte")("b").alias("x"), byteops.swapped("word")("b").alias("y"), byteops.swapped("word-byte")("b").alias("z"), byteops.swapped("bit")("b").alias("w")).first()
    assert (bytes(got.x), bytes(got.y), bytes(got.z), bytes(got.w)) == (b"\x02\x01\x04\x03", b"\x04\x03\x02\x01", b"\x03\x04\x01\x02", b"\x80\x40\xc0\x20")
    assert byteops.crc16(b"123456789") == 0x4B37


XML = b"""<?xml version="1.0"?><datafile><header><name>T</name></header>
<game name="b" cloneof="a"><description>B &amp; b</description><rom name="r1" size="4" crc="ab" sha1="%s" status="baddump" serial="7"/><release name="b" region="USA"/></game>
<game name="a" isbios="yes"><description>A</description><rom name="r0" size="0x10" crc="00000001" mia="yes"/><unknown x="1"/></game></datafile>""" % (b"f" * 40)
SOFT = b"""<softwarelist name="l"><software name="s"><year>1990</year><publisher>P</publisher><part name="cart" interface="i"><dataarea name="rom"><rom name="x" size="8" crc="1"/><rom size="8" offset="8" loadflag="continue"/></dataarea></part></software></softwarelist>"""
PAREN = b'clrmamepro ( name "N" )\ngame ( name "g 1" description "G" year 1991 rom ( name "r.bin" size 3 crc 0a ) sample s1 )\nresource ( name bios rom ( name b size 1 crc 1 ) )'


def test_catalog_readers_and_round_trip(spark):
    files_df = spark.createDataFrame([("x.xml", bytearray(XML)), ("s.xml", bytearray(SOFT)), ("c.dat", bytearray(PAREN))], "path string, content binary")
    entries = catalogs.entries_of(files_df)
    got = {(r.path, r.name): r for r in entries.collect()}
    assert len(got) == 5
    b = got["x.xml", "b"]
    assert b.cloneof == "a" and b.claims[0].crc32 == "000000ab" and b.claims[0].status == "baddump" and b.claims[0].attrs == {"serial": "7"} and b.releases[0].region == "USA"
    assert got["x.xml", "a"].claims[0]["size"] == 16 and got["x.xml", "a"].claims[0].mia
    assert [c.attrs["part"] for c in got["s.xml", "s"].claims] == ["cart"] and got["s.xml", "s"].manufacturer == "P"
    assert got["c.dat", "bios"].is_bios and [c.kind for c in got["c.dat", "g 1"].claims] == ["rom", "sample"]
    xml = catalogs.export_xml(entries.where("path = 'x.xml'")).first().xml
    again = catalogs.entries_of(spark.createDataFrame([("y.xml", bytearray(xml.encode()))], "path string, content binary"))
    assert [(r.name, r.claims[0].name, r.claims[0].crc32, r.claims[0]["size"]) for r in again.orderBy("seq").collect()] == [("a", "r0", "00000001", 16), ("b", "r1", "000000ab", 4)]
    with pytest.raises(ValueError):
        catalogs.sniff(b"[CREDITS]\n")


def test_clonelist(spark):
    content = b'{"variants":[{"group":"g","titles":[{"searchTerm":"One"},{"searchTerm":"Two"}]}]}'
    assert pairs(catalogs.clonelist_of(spark.createDataFrame([(bytearray(content),)], "content binary"))) == [("one", "g"), ("two", "g")]


def test_zip_members_and_scan(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("s.bin", b"stored")
        z.writestr(zipfile.ZipInfo("d.bin"), b"d" * 100, zipfile.ZIP_DEFLATED)
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no zip")
    scanned = files.scan(spark, str(tmp_path))
    rows = {(r.member or "-"): r for r in files.zip_members(scanned).collect()}
    assert buffer.getvalue()[rows["s.bin"].offset :][:6] == b"stored" and rows["d.bin"].method == "deflate" and rows["-"].note.startswith("unreadable")
    table = files.ingest(scanned).cache()
    assert files.changed(scanned, table).count() == 0 and files.changed(scanned, table.where("path LIKE '%a.zip'")).count() == 1


@pytest.mark.parametrize("every", [1, 2, 20])
def test_queue_stream(spark, sf, tmp_path, every):
    import shutil

    from cairn.operators.queue import promote
    from cairn.streaming import queue_stream

    (tmp_path / "in").mkdir()
    for i in range(2):
        shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / f"e{i}.parquet")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = queue_stream.deduplicated(queue_stream.read_events(spark, str(tmp_path / "in"), schema), late="60 days")
    as_rows = lambda b: b.select(F.col("user_id").alias("item"), F.lit("a").alias("analyzer"), F.lit(2).alias("priority"), F.col("event_id").alias("enqueued_at"), F.lit(0).cast("long").alias("leased_until"))
    run = queue_stream.merge_into_queue(events, as_rows, str(tmp_path / "q"), str(tmp_path / "c"), every)
    run.awaitTermination(120)
    assert len(list((tmp_path / "q").glob("merged-*"))) == (1 if every <= 2 else 0)
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("m"))
    assert pairs(queue_stream.read_queue(spark, str(tmp_path / "q")).select("item", "enqueued_at")) == pairs(want)
