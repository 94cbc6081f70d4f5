"""Catalog import, selection, views, detectors, containers and byte assembly: golden scenarios."""

import struct

import pytest
from cairn.functions import columns as C
from cairn.operators import byteops, identity, importing, selection, views
from cairn.sources import catalogs, containers, detectors
from pyspark.sql import functions as F

CLAIM = "claim long, size long, sha256 string, sha1 string, md5 string, crc32 string"


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.identity, set()).add(r.claim)
    return sorted(sorted(v) for k, v in out.items() if k is not None)


@pytest.mark.parametrize(
    ("claims", "want"),
    [
        # one sha1, two md5: the claim without md5 joins whoever is oldest
        ([(1, None, None, "s", "m1", None), (2, None, None, "s", "m2", None), (3, None, None, "s", None, None)], [[1, 3], [2]]),
        # the first md5 after a bare claim is absorbed by it, the second is not
        ([(1, None, None, "s", None, None), (2, None, None, "s", "m1", None), (3, None, None, "s", "m2", None)], [[1, 2], [3]]),
        # crc nominates, but without a size it does not identify
        ([(1, 5, None, "s", None, "c"), (2, None, None, None, "m", "c"), (3, 5, None, None, None, "c")], [[1, 3], [2]]),
        # a claim ties two identities together
        ([(1, None, None, "s", None, None), (2, None, None, None, "m", None), (3, None, None, "s", "m", None), (4, None, None, None, "m", None)], [[1, 2, 3, 4]]),
    ],
)
def test_unify_depends_on_the_order(spark, claims, want):
    assert groups(identity.unify(spark.createDataFrame(claims, CLAIM)).collect()) == want


def test_fold_equals_the_aggregation(spark):
    """Groups that an aggregation settles, folded all the same."""
    rows = [(i, 5 if i % 2 else None, None, f"s{i % 7}" if i % 3 else None, f"m{i % 7}", f"c{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, CLAIM)
    folded = identity.folded(df.withColumn("component", F.substring("md5", 2, 1).cast("long")))
    assert groups(folded.collect()) == groups(identity.unify(df).collect())


def test_import_keeps_two_revisions_and_reports_errors(spark):
    xml = lambda v, body: f'<datafile><header><name>S</name><version>{v}</version><author>A</author></header>{body}</datafile>'.encode()
    game = '<game name="{0}"><rom name="f" size="1" md5="{1}"/></game>'
    files = [("1.xml", xml(1, game.format("old", "a" * 32))), ("2.xml", xml(2, game.format("g", "a" * 32))), ("3.xml", xml(3, game.format("g", "a" * 32) + '<game name="h" cloneof="g"><rom name="f" size="1" md5="' + "b" * 32 + '" status="nodump"/></game>')), ("bad.xml", b"[DAT]\n")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    aliases = spark.createDataFrame([("md5", "a" * 32, 7)], "algo string, digest string, blob long")
    blobs = spark.createDataFrame([(7, 1, True)], "blob long, size long, resident boolean")
    t = importing.import_catalogs(df, aliases, blobs, 5)
    assert [(r.path, "not supported" in r.error) for r in t["errors"].collect()] == [("bad.xml", True)]
    assert sorted((r.version, r.kept) for r in t["revisions"].collect()) == [("1", False), ("2", True), ("3", True)]
    source = t["sources"].first()
    assert (source.provider, source.system) == ("A", "S") and source.current == t["revisions"].where("version = '3'").first().revision
    assert sorted((r.name, r.required, r.have_verified, r.state) for r in t["audit"].collect()) == [("g", 1, 1, 0), ("h", 0, 0, 3)]
    assert t["claims"].count() == 3 and t["entries"].where("name = 'h'").first().cloneof_id == t["entries"].where("name = 'g'").agg(F.max("entry")).first()[0]
    picked = importing.candidates_of(t)
    assert selection.one_game_one_rom(picked, [], [], group="system").count() == 1  # h is a clone of g
    assert importing.import_catalogs(df.limit(0), aliases, blobs, 5)["audit"].count() == 0


def test_selection_rules(spark):
    rows = [(1, "Game (Japan)", None, 1, 1), (2, "Game (USA) (Beta)", None, 1, 0), (3, "Game (USA)", None, 1, 0), (4, "Other (Europe) (Rev 2)", None, 0, 0), (5, "Other (Europe) (Rev A)", None, 0, 0), (6, "Game 2 (USA)", None, 1, 1)]
    df = spark.createDataFrame(rows, "entry long, name string, cloneof long, required long, held long")
    pick = lambda **more: sorted(r.entry for r in selection.one_game_one_rom(df, ["us"], [], **more).collect())
    assert pick() == [1, 4, 6] and pick(strict=True) == [3, 4, 6]
    listed = spark.createDataFrame([("game 2 (usa)", "game"), ("game", "game")], "term string, group string")
    assert pick(strict=True, clonelist=listed) in ([3, 4], [4, 6]) and pick(clonelist=listed) == [4, 6]


def test_paths_settle_in_order(spark):
    rows = [(1, "a.bin", "h1"), (2, "a.bin", "h2"), (3, "a (h2).bin", "h3"), (4, "a.bin", "h2"), (5, "a.bin", "h5")]
    df = spark.createDataFrame(rows, "id long, path string, hash string")
    got = selection.number_collisions(df, "path", [F.asc("id")], F.concat(F.lit(" ("), F.col("hash"), F.lit(")")))
    assert {r.id: r.final_path for r in got.collect()} == {1: "a.bin", 2: "a (h2).bin", 3: "a (h2) (h3).bin", 5: "a (h5).bin"}


def test_views_repair_and_refuse(spark):
    for bad in ({"profile": "odd"}, {"template": "x"}, {"one_per_family": True}, {"one_per_family": True, "score": ("s",), "merge_mode": "split"}):
        with pytest.raises(ValueError):
            views.ViewDef("v", **bad)
    rows = spark.createDataFrame([(1, "a:b", "aaaaaaaa1", 1), (2, "a?b", "bbbbbbbb1", 1), (3, "..", "c", 1), (4, "x\\..//y", "d", 1), (5, "big", "e", 1 << 40)], "entry long, name string, hash string, size long")
    got = views.evaluate(views.ViewDef("v", "{name}", profile="fat32"), rows)
    assert {r.path for r in got.collect()} == {"_", "a_b", "a_b (bbbbbbbb)", "x/_/y"}
    assert views.snapshot(got).count() == 4
    with pytest.raises(ValueError):
        views.snapshot(got.union(got))
    many = spark.createDataFrame([(i, f"{'ab'[i % 2]}{i}.bin", f"{i:08}", 1) for i in range(9)] + [(20, "A/a0.bin", "ffffffff", 1)], "entry long, name string, hash string, size long")
    got = {r.entry: r.path for r in views.evaluate(views.ViewDef("v", "{name}", profile=views.Profile(directory_limit=4)), many).collect()}
    assert got[1] == "B/b1.bin" and got[20] == "A/a0.bin" and got[0] == "A/a0 (00000000).bin" and len(set(got.values())) == 10


@pytest.mark.parametrize(
    ("name", "most", "want"),
    [
        ("short.bin", 40, "short.bin"),
        ("2 Games in 1! - Long Name.bin", 20, "Long Name.bin"),
        ("3 in 1 - x.bin", 10, "x.bin"),
        ("Name (USA, Europe) (Rev 1).bin", 24, "Name (U,E) (Rev 1).bin"),
        ("Name (USA, Beta) -().bin", 21, "Name (USA, Beta).bin"),
        ("éééééééé.bin", 11, "ééé.bin"),
        ("x" * 30, 5, "xxxxx"),
        ("." + "y" * 30, 6, ".yyyyy"),
    ],
)
def test_names_that_fit(name, most, want):
    assert byteops.fit_component(name, most) == want and len(want.encode()) <= most


def test_long_numbers_are_no_revisions(spark):
    rows = spark.createDataFrame([("a (Rev 99999999999) (Rev 3)",), ("b (Rev 99999999999999999999999)",), ("c (Rev B, Rev 2)",)], "name string")
    assert [r.v for r in rows.select(C.revision(C.paren_tokens(F.col("name"))).alias("v")).collect()] == [3, 0, 2]


DETECTOR = b"""<detector><name>D</name>
<rule start_offset="10" end_offset="EOF" operation="byteswap"><data offset="0" value="4E4553"/></rule>
<rule start_offset="0" end_offset="-4"><or offset="-4" mask="0F" value="FF" result="false"/><file size="PO2"/></rule>
<rule><xor offset="1" mask="FF00" value="0001"/></rule></detector>"""


def test_detectors():
    d = detectors.parse(DETECTOR)
    assert d.decide(b"NES" + b"x" * 15) == (16, 18, "byteswap") and detectors.real_data(b"NES" + b"x" * 13 + b"ab", 16, 18, "byteswap") == b"ba"
    assert d.decide(b"NES" + b"x" * 14) is None  # an odd block, and no other rule
    assert d.decide(b"abcd" * 2) == (0, 4, "none") and d.decide(b"") is None  # a test outside the file fails even with result="false"
    assert d.decide(b"a\xff\x01") == (0, 3, "none")
    for bad in (b"<detector><name>x</name></detector>", b"<detector><rule/></detector>", b"<detector><name>x</name><rule><odd/></rule></detector>", b"<detector><name>x</name><rule><and offset='0' mask='FF' value='FFFF'/></rule></detector>", b"no xml", b"<detector><name>x</name><rule operation='odd'/></detector>"):
        with pytest.raises(ValueError):
            detectors.parse(bad)


def cartridge():
    head = bytearray(0x200)
    for at, value in ((0x20, 0x200), (0x2C, 16), (0x30, 0x220), (0x3C, 8), (0x40, 0x228), (0x44, 8), (0x48, 0x230), (0x4C, 16)):
        struct.pack_into("<I", head, at, value)
    struct.pack_into("<H", head, 0x15E, byteops.crc16(bytes(head[:0x15E])))
    table = struct.pack("<IIII", 0x250, 0x255, 0x255, 0x255)
    return bytes(head) + b"A" * 16 + b"\xff" * 16 + b"B" * 8 + b"N" * 8 + table + b"\0" * 16 + b"hello" + b"xyz"


def test_layouts_cover_or_refuse(spark):
    data = cartridge()
    rows = list(containers.coverage(data, containers.cartridge_layout(data)))
    assert [(k, n) for k, n, *_ in rows] == [("piece", "header"), ("piece", "arm9.bin"), ("fill", ""), ("piece", "arm7.bin"), ("piece", "names"), ("piece", "files"), ("fill", ""), ("piece", "file/00000.bin"), ("literal", "")]
    assert sum(r[3] for r in rows) == len(data) and rows[2][4] == 255
    for bad in (data[:100], b"x" + data[1:], b"NARC" + data):
        with pytest.raises(containers.Refused):
            list(containers.coverage(bad, containers.cartridge_layout(bad)))
    with pytest.raises(containers.Refused):
        list(containers.coverage(b"abcdef", [("a", 0, 4), ("b", 3, 2)]))
    got = containers.layouts(spark.createDataFrame([(1, bytearray(data)), (2, None)], "path int, content binary"), "cartridge").collect()
    assert sum(r["len"] or 0 for r in got) == len(data) and [r.note[:7] for r in got if r.path == 2] == ["refused"]


def test_packs_are_proved_before_they_are_believed():
    pack = containers.seal([b"one", b"", b"three"])
    assert [(o, n) for _, o, n in containers.pack_members(pack)] == [(0, 3), (3, 0), (3, 5)]
    for bad in (pack[:-1], pack[:20] + b"\x00" + pack[21:], b"x" + pack, pack + b"x", b"", b"short"):
        with pytest.raises((containers.Refused, struct.error)):
            containers.pack_members(bad)
    with pytest.raises(ValueError):
        containers.seal([])


SEGMENT = "owner string, seq int, source string, offset long, len long, fill int, literal binary"


def test_assembly_of_segments(spark):
    sources = spark.createDataFrame([("s", bytearray(b"0123456789"))], "source string, data binary")
    rows = [("o", 2, "s", 3, 4, None, None), ("o", 1, None, None, None, None, bytearray(b"<")), ("o", 3, None, None, 2, 42, None), ("p", 1, "s", 9, 1, None, None)]
    df = spark.createDataFrame(rows, SEGMENT)
    assert {r.owner: bytes(r.data) for r in byteops.assemble_segments(df, sources).collect()} == {"o": b"<3456**", "p": b"9"}
    assert {r.owner: r["size"] for r in byteops.output_sizes(df).collect()} == {"o": 7, "p": 1}
    for bad in (("o", 1, "s", 8, 4, None, None), ("o", 1, "none", 0, 1, None, None), ("o", 1, "s", 0, 0, None, None), ("o", 1, None, None, None, None, bytearray(5000)), ("o", 1, None, None, 3, 300, None), ("o", 1, "s", 0, 1, 1, None), ("o", 1, None, None, 1, None, None)):
        with pytest.raises(Exception, match="segment|slice"):
            byteops.assemble_segments(spark.createDataFrame([bad], SEGMENT), sources).collect()


def test_operations_by_name(spark):
    with pytest.raises(ValueError):
        byteops.operation("identity@1")(lambda c: c)
    with pytest.raises(Exception, match="unknown operation"):
        byteops.apply_operations(spark.createDataFrame([("odd@1", bytearray(b"x"))], "op string, data binary")).collect()


def test_statuses_and_clone_lists(spark):
    xml = b'<datafile><game name="g"><rom name="r" size="1" status="strange"/></game></datafile>'
    (r,) = catalogs.entries_of(spark.createDataFrame([("x", bytearray(xml))], "path string, content binary")).collect()
    assert r.claims[0].status == "good" and r.claims[0].attrs == {"status": "strange"}
    doc = b'{"variants":[{"group":"g","titles":[{"searchTerm":"A"},{"searchTerm":".*","nameType":"regex"}]}]}'
    df = spark.createDataFrame([(bytearray(doc),)], "content binary")
    assert [tuple(x) for x in catalogs.clonelist_of(df).collect()] == [("a", "g")] and catalogs.skipped_terms(df).first().skipped == 1


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from cairn import session

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    fake = type("Spark", (), {"sparkContext": Context(), "conf": type("Conf", (), {"get": lambda self, key, default=None: default})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)
