"""Scalar rules of the catalog domain as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Audit states of an identity, best last.
IDENTITY_STATES = {"missing": 0, "claimed": 1, "peer": 2, "probable": 3, "verified": 4}
# States of an entry, and the code for one without required claims.
ENTRY_STATES = {"verified": 0, "claimed": 1, "missing": 2, "nodump": 3}
# Other names of regions, and tokens that mark development versions.
REGION_ALIASES = {"us": "usa", "eu": "europe", "jp": "japan"}
DEV_FLAGS = ("beta", "proto", "prototype", "sample", "demo", "alpha", "debug")


def required(status: Column, optional: Column, nodump: str | int = 2) -> Column:
    """A claim counts towards its entry unless it is a known non-dump or optional."""
    return (status != F.lit(nodump)) & ~optional


def entry_state(n_required: Column, missing: Column, claimed: Column) -> Column:
    """0 verified, 1 claimed, 2 missing, 3 nothing required."""
    return (
        F.when(n_required.isNull() | (n_required == 0), 3)
        .when(missing > 0, 2)
        .when(claimed > 0, 1)
        .otherwise(0)
    )


def size_or_null(size: Column) -> Column:
    """Aggregate: the sum of sizes, or null when any row has none."""
    return F.when(F.count(F.lit(1)) == F.count(size), F.sum(size))


def wanted_digest(sha256: Column, sha1: Column, md5: Column, crc32: Column) -> Column:
    """"algorithm:hex" of the strongest digest that is known."""
    named = zip(("sha256", "sha1", "md5", "crc32"), (sha256, sha1, md5, crc32), strict=True)
    return F.coalesce(*(F.concat(F.lit(f"{name}:"), F.lower(value)) for name, value in named))


def only_one(value: Column) -> Column:
    """Aggregate: the group's value if it has a single row, else null."""
    return F.when(F.count(F.lit(1)) == 1, F.max(value))


def decode(code: Column, names: dict[int, str]) -> Column:
    """Name of an enum code; an unknown code is an error, a null stays null."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.when(code.isNull(), F.lit(None)).when(code.isin(*names), table[code]).otherwise(F.raise_error(F.concat(F.lit("unknown code "), code.cast("string"))))


def contains_ignoring_case(text: Column, part: str) -> Column:
    """Substring match without wildcards."""
    return F.lower(text).contains(part.lower())


def hex_prefix(digest: Column, prefix: str) -> Column:
    return F.lower(F.hex(digest)).startswith(prefix.lower())


def hash_sample(hex_digest: Column, percent: int) -> Column:
    """Keep rows whose first digest byte times 100 is below percent times 256: repeatable, unlike sample()."""
    return F.conv(F.substring(hex_digest, 1, 2), 16, 10).cast("int") * 100 < percent * 256


def shard_of(hex_digest: Column, fanout: int) -> Column:
    """Shard of a digest by its first byte."""
    return F.floor(F.conv(F.substring(hex_digest, 1, 2), 16, 10).cast("int") * fanout / 256).cast("int")


def paren_tokens(name: Column) -> Column:
    """Comma-separated tokens of every parenthesised group, trimmed, without empty ones."""
    groups = F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda t: F.trim(t)), lambda t: t != "")


def base_name(name: Column) -> Column:
    """Text before the first parenthesis, single-spaced, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.substring_index(name, "(", 1), r"\s+", " ")))


def axis_rank(tokens: Column, priorities: list[str]) -> Column:
    """Place of the best token in a priority list, its length when none is in it."""
    wanted = F.array(*map(F.lit, priorities))
    spots = F.filter(F.transform(tokens, lambda t: F.array_position(wanted, t)), lambda p: p > 0)
    return F.coalesce(F.array_min(spots) - 1, F.lit(len(priorities))).cast("int")


def region_tokens(tokens: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in REGION_ALIASES.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(aliases[F.lower(t)], F.lower(t)))


def is_dev(tokens: Column) -> Column:
    """A token that is a development flag, alone or followed by a space."""
    return F.exists(tokens, lambda t: F.lower(t).rlike("^(" + "|".join(DEV_FLAGS) + ")( .*)?$"))


def revision(tokens: Column) -> Column:
    """Rev N is N, Rev A is 1, Rev B is 2; 0 without one. A number beyond 32 bits is no revision, and the next token counts."""
    marks = F.transform(tokens, lambda t: F.regexp_extract(F.lower(t), r"^rev ([0-9]+|[a-z])$", 1))
    numbers = F.transform(marks, lambda m: F.when(m.rlike("^[a-z]$"), (F.ascii(m) - 96).cast("long")).when(m != "", m.try_cast("long")))
    return F.coalesce(F.get(F.filter(numbers, lambda n: n < 1 << 32), F.lit(0)), F.lit(0).cast("long"))


def alpha_bucket(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z]"), F.upper(F.substring(name, 1, 1))).otherwise("#")


def safe_component(name: Column) -> Column:
    """A name fit for one path component."""
    cleaned = F.regexp_replace(name, r"[/\\\x00]", "_")
    return F.when(cleaned.isin("", ".", ".."), "_").otherwise(cleaned)


def safe_name(name: Column) -> Column:
    """A relative path: backslashes count as slashes, empty components go, every other one is made safe; "_" if nothing is left."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.when(F.size(parts) == 0, "_").otherwise(F.array_join(F.transform(parts, safe_component), "/"))


def with_suffix(path: Column, suffix: Column) -> Column:
    """The path with a suffix before its extension (what follows the last dot, unless that is the first character)."""
    stem = F.regexp_extract(path, r"^(?s)(.+)\.[^.]*$", 1)
    return F.when(stem == "", F.concat(path, suffix)).otherwise(F.concat(stem, suffix, F.substring(path, F.length(stem) + 1, F.length(path))))


def expand_template(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def canonical_path(path: Column) -> Column:
    """Relative, without empty, dot or dot-dot components and without a backslash or NUL."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~path.rlike(r"[\\\x00]")


def fat_component(name: Column) -> Column:
    """Characters that FAT forbids in a path component become underscores; trailing dots and spaces go."""
    cleaned = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f"*/:<>?\\|]', "_"), r"[. ]+$", "")
    return F.when(cleaned == "", "_").otherwise(cleaned)


def crc_hex(text: Column) -> Column:
    """A crc32 in hex, padded on the left to eight digits; null if it is none."""
    plain = F.lower(F.trim(text))
    return F.when(plain.rlike("^[0-9a-f]{1,8}$"), F.lpad(plain, 8, "0"))


def size_number(text: Column) -> Column:
    """Decimal or 0x-prefixed sizes."""
    plain = F.lower(F.trim(text))
    return F.when(plain.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(plain, 3, 20), 16, 10).cast("long")).when(plain.rlike("^[0-9]{1,18}$"), plain.cast("long"))


def url_shaped(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"^(https?://|www\.)"), F.lit(False))


def provider(homepage: Column, author: Column) -> Column:
    """Who publishes a catalog: its homepage unless that is empty or an address, else its author, else "unknown"."""
    own = F.trim(homepage)
    return F.coalesce(F.when((own != "") & ~url_shaped(own), own), author, F.lit("unknown"))


def split_source(text: Column) -> Column:
    """provider/system as a struct; null unless both are there."""
    parts = F.struct(F.regexp_extract(text, r"^([^/]+)/(?s)(.+)$", 1).alias("provider"), F.regexp_extract(text, r"^([^/]+)/(?s)(.+)$", 2).alias("system"))
    return F.when(text.rlike(r"^[^/]+/(?s).+$"), parts)


def op_index_name(name: Column, major: Column, component: Column, export: Column) -> Column:
    """Under what an operation is indexed: component#export if it comes from a component, else name@major."""
    return F.when(component.isNotNull(), F.concat(component, F.lit("#"), export)).otherwise(F.concat(name, F.lit("@"), major.cast("string")))


def world(text: Column, prefix: str) -> Column:
    """What kind of component a world names: "transform", "extractor", or "other" for any other spelling."""
    return F.when(text == f"{prefix}:transform@1", "transform").when(text == f"{prefix}:extractor@1", "extractor").otherwise("other")


def route_verb(op_name: Column) -> Column:
    """What a route says an operation does: the part after "#", else the part before "@"."""
    return F.when(op_name.contains("#"), F.regexp_extract(op_name, r"^[^#]*#(?s)(.*)$", 1)).otherwise(F.substring_index(op_name, "@", 1))


def watermark(spec: str, total: Column) -> Column:
    """'off' is null, 'N%' is total / 100 * N with the division first, otherwise bytes with K, M, G or T."""
    spec = spec.strip().lower()
    if spec == "off":
        return F.lit(None).cast("long")
    if spec.endswith("%"):
        return (F.floor(total / 100) * int(spec[:-1])).cast("long")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return F.lit(int(spec[:-1]) * units[spec[-1]] if spec[-1] in units else int(spec)).cast("long")


def header_offset(spec: Column, size: Column) -> Column:
    """Offsets of header rules: EOF, a hex number, or minus a hex number counted from the end; outside the file is null."""
    number = F.conv(F.regexp_replace(spec, "^-", ""), 16, 10).cast("long")
    at = F.when(spec == "EOF", size).when(spec.startswith("-"), size - number).otherwise(number)
    return F.when((at >= 0) & (at <= size), at)
