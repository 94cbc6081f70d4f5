"""Readers of catalog files: three XML dialects, parenthesised text and clone lists."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = "kind string, name string, size long, crc32 string, md5 string, sha1 string, sha256 string, status string, mia boolean, optional boolean, merge_name string, attrs map<string,string>"
ENTRY = (
    "path string, format string, seq int, name string, description string, year string, manufacturer string, cloneof string, romof string, sampleof string, "
    "is_bios boolean, is_device boolean, is_mechanical boolean, runnable boolean, attrs map<string,string>, "
    f"claims array<struct<{CLAIM.replace(' string', ':string').replace(' long', ':long').replace(' boolean', ':boolean').replace(' map', ':map')}>>, "
    "releases array<struct<name:string,region:string,language:string,date:string,is_default:boolean>>, devices array<string>, header map<string,string>, error string"
)

# What the attributes of catalog formats are called.
_ENTRY_KNOWN = ("name", "cloneof", "romof", "sampleof", "isbios", "isdevice", "ismechanical", "runnable")
_CLAIM_KNOWN = ("name", "size", "crc", "md5", "sha1", "sha256", "status", "mia", "optional", "merge")
_STATUSES = ("good", "baddump", "nodump", "verified")


def sniff(head: bytes) -> str | None:
    """Format of a catalog file by its first 4096 bytes; None if unknown, an error for a known but unsupported one."""
    text = head[:4096].decode("utf-8", "replace").lstrip("\ufeff \t\r\n")
    if text.startswith(("[CREDITS]", "[DAT]")):
        raise ValueError("this catalog format is recognised but not supported")
    if text.lower().startswith("clrmamepro") or re.match(r"(emulator|game|machine|resource)\s*\(", text):
        return "paren"
    if text.startswith("<"):
        for tag, kind in (("mame", "listxml"), ("softwarelist", "softlist"), ("datafile", "logiqx")):
            if f"<{tag}" in text or f"{tag}.dtd" in text:
                return kind
    return None


def sniffed(head: Column) -> Column:
    """sniff() as a column expression over a file's head as text; "unsupported" for what sniff() refuses."""
    text = F.regexp_replace(head, r"^[\ufeff \t\r\n]+", "")
    out = F.lit(None).cast("string")
    for tag, kind in (("datafile", "logiqx"), ("softwarelist", "softlist"), ("mame", "listxml")):
        out = F.when(text.startswith("<") & (text.contains(f"<{tag}") | text.contains(f"{tag}.dtd")), kind).otherwise(out)
    return F.when(text.rlike(r"^\[(CREDITS|DAT)\]"), "unsupported").when(text.rlike(r"^((?i)clrmamepro)|^(emulator|game|machine|resource)\s*\("), "paren").otherwise(out)


def number(text: str | None) -> int | None:
    if not text:
        return None
    text = text.strip().lower()
    try:
        return int(text, 16) if text.startswith("0x") else int(text)
    except ValueError:
        return None


def digest(text: str | None, width: int) -> str | None:
    text = (text or "").strip().lower()
    if not re.fullmatch(r"[0-9a-f]+", text) or len(text) > width:
        return None
    return text.rjust(width, "0") if width == 8 else text if len(text) == width else None


def claim(kind: str, a: dict[str, str]) -> dict:
    """A claim of its attributes; a status that is not known counts as good and is kept among the attributes."""
    status = a.get("status") or a.get("flags") or "good"
    unknown = {} if status in _STATUSES else {"status": status}
    return {
        "kind": kind, "name": a.get("name"), "size": number(a.get("size")), "crc32": digest(a.get("crc"), 8), "md5": digest(a.get("md5"), 32), "sha1": digest(a.get("sha1"), 40), "sha256": digest(a.get("sha256"), 64),
        "status": status if status in _STATUSES else "good", "mia": a.get("mia") == "yes", "optional": a.get("optional") == "yes", "merge_name": a.get("merge"), "attrs": {k: v for k, v in a.items() if k not in _CLAIM_KNOWN} | unknown,
    }


def entry(a: dict[str, str], claims: list, releases: list, devices: list, text: dict[str, str | None]) -> dict:
    yes = lambda k: a.get(k) == "yes"
    return {
        "name": a.get("name"), "description": text.get("description"), "year": text.get("year"), "manufacturer": text.get("manufacturer") or text.get("publisher"), "cloneof": a.get("cloneof"), "romof": a.get("romof"), "sampleof": a.get("sampleof"),
        "is_bios": yes("isbios"), "is_device": yes("isdevice"), "is_mechanical": yes("ismechanical"), "runnable": a.get("runnable", "yes") != "no", "attrs": {k: v for k, v in a.items() if k not in _ENTRY_KNOWN}, "claims": claims, "releases": releases, "devices": devices,
    }


def parse_xml(data: bytes) -> Iterator[dict]:
    """Entries of a Logiqx, listxml or software-list file, one at a time; unknown attributes are kept, unknown elements skipped."""
    header: dict[str, str] = {}
    depth_entries = {"game", "machine", "software"}
    for event, node in ET.iterparse(io.BytesIO(data), events=("end",)):
        if node.tag == "header":
            header = {c.tag: (c.text or "").strip() for c in node if len(c) == 0}
        if node.tag not in depth_entries:
            continue
        claims, releases, devices, text = [], [], [], {}
        for child in node:
            if child.tag in ("rom", "disk", "sample"):
                claims.append(claim(child.tag, child.attrib))
            elif child.tag == "release":
                releases.append({"name": child.get("name"), "region": child.get("region"), "language": child.get("language"), "date": child.get("date"), "is_default": child.get("default") == "yes"})
            elif child.tag == "device_ref":
                devices.append(child.get("name"))
            elif child.tag == "part":
                for area in child:
                    for x in area:
                        if x.tag in ("rom", "disk") and x.get("name"):  # directives without a name load parts of the claim before
                            claims.append(claim(x.tag, dict(x.attrib) | {"part": child.get("name", ""), "area": area.get("name", "")}))
            elif len(child) == 0 and child.text:
                text[child.tag] = child.text.strip()
        yield entry(node.attrib, claims, releases, devices, text) | {"header": header}
        node.clear()


_PAREN = re.compile(r'"([^"]*)"|([()])|([^\s()"]+)')


def parse_paren(text: str) -> Iterator[dict]:
    """Entries of parenthesised text: name ( key value key ( ... ) ), with quoted values and no escapes."""
    tokens = [(q, p, w) for q, p, w in _PAREN.findall(text)]
    at = 0

    def block() -> list[tuple[str, object]]:
        nonlocal at
        out: list[tuple[str, object]] = []
        while at < len(tokens) and tokens[at][1] != ")":
            key = tokens[at][2] or tokens[at][0]
            at += 1
            if at < len(tokens) and tokens[at][1] == "(":
                at += 1
                out.append((key.lower(), block()))
                at += 1
            elif at < len(tokens):
                out.append((key.lower(), tokens[at][2] or tokens[at][0]))
                at += 1
        return out

    header: dict[str, str] = {}
    while at < len(tokens):
        kind = (tokens[at][2] or tokens[at][0]).lower()
        at += 2
        body = block()
        at += 1
        flat = {k: v for k, v in body if isinstance(v, str)}
        if kind in ("clrmamepro", "emulator"):
            header = flat
            continue
        claims = [claim(k, {a: b for a, b in v if isinstance(b, str)}) for k, v in body if k in ("rom", "disk") and isinstance(v, list)]
        claims += [claim("sample", {"name": v}) for k, v in body if k == "sample" and isinstance(v, str)]
        text = {k: flat.pop(k) for k in ("description", "year", "manufacturer") if k in flat}
        flat.pop("sample", None)
        made = entry(flat | ({"isbios": "yes"} if kind == "resource" else {}), claims, [], [], text)
        yield made | {"header": header}


def parse(data: bytes) -> tuple[str, Iterator[dict]]:
    kind = sniff(data)
    if kind is None:
        raise ValueError("unknown catalog format")
    return kind, parse_paren(data.decode("utf-8", "replace")) if kind == "paren" else parse_xml(data)


def entries_of(files: DataFrame) -> DataFrame:
    """ENTRY rows of binary files(path, content); files are parsed one by one and stream their entries.

    A file that cannot be read ends in a row with an error and no entry; the entries before the fault stay, and so do other files.
    """
    names = [f.split()[0] for f in re.sub(r"<.*?>+", "", ENTRY).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                kind, rows, seq = None, [], -1
                try:
                    kind, found = parse(bytes(content or b""))
                    for seq, e in enumerate(found):
                        rows.append({"path": path, "format": kind, "seq": seq} | e | {"error": None})
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows = []
                except (ValueError, ET.ParseError, IndexError) as bad:
                    rows.append(dict.fromkeys(names) | {"path": path, "format": kind, "seq": seq + 1, "error": str(bad)})
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, ENTRY)


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    return entries_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def claims_of(entries: DataFrame) -> DataFrame:
    """One row per claim, with its place in the entry."""
    return entries.where("error IS NULL").select("path", "seq", F.col("name").alias("entry"), F.posexplode("claims").alias("at", "c")).select("path", "seq", "entry", "at", "c.*")


def clonelist_of(files: DataFrame) -> DataFrame:
    """(term, group) of clone-list JSON files(path, content): search terms in lower case; regular-expression terms are skipped (skipped_terms() counts them)."""
    return _titles(files).where(f"NOT ({_PATTERN})").select(F.lower("t.searchTerm").alias("term"), "group")


_PATTERN = "coalesce(t.nameType, '') IN ('regex', 'regexFree')"


def skipped_terms(files: DataFrame) -> DataFrame:
    """One row: how many terms of clone lists are regular expressions."""
    return _titles(files).where(_PATTERN).agg(F.count(F.lit(1)).alias("skipped"))


def _titles(files: DataFrame) -> DataFrame:
    variant = "variants array<struct<group:string, titles:array<struct<searchTerm:string, nameType:string>>>>"
    parsed = files.select(F.from_json(F.col("content").cast("string"), variant).alias("j"))
    return parsed.select(F.explode("j.variants").alias("v")).select(F.col("v.group").alias("group"), F.explode("v.titles").alias("t"))


def export_xml(entries: DataFrame) -> DataFrame:
    """(path, xml): a deterministic Logiqx rendering per catalog, entries by name and claims in order."""

    def esc(c):
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def attr(name: str, c):
        return F.when(c.isNull(), "").otherwise(F.concat(F.lit(f' {name}="'), esc(c.cast("string")), F.lit('"')))

    def rom(c):
        fields = [("name", c["name"]), ("size", c["size"]), ("crc", c["crc32"]), ("md5", c["md5"]), ("sha1", c["sha1"]), ("sha256", c["sha256"]), ("merge", c["merge_name"]), ("status", F.when(c["status"] != "good", c["status"])), ("mia", F.when(c["mia"], "yes")), ("optional", F.when(c["optional"], "yes"))]
        return F.concat(F.lit("<"), c["kind"], *(attr(k, v) for k, v in fields), F.lit("/>"))

    one = F.concat(F.lit("<game"), attr("name", F.col("name")), attr("cloneof", F.col("cloneof")), attr("romof", F.col("romof")), attr("isbios", F.when(F.col("is_bios"), "yes")), F.lit("><description>"), esc(F.coalesce("description", "name")), F.lit("</description>"), F.array_join(F.transform("claims", rom), ""), F.lit("</game>"))
    ordered = F.sort_array(F.collect_list(F.struct("name", "seq", one.alias("x"))))
    return entries.groupBy("path").agg(ordered.alias("xs")).select("path", F.concat(F.lit('<?xml version="1.0"?><datafile>'), F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</datafile>")).alias("xml"))
