"""Entity resolution of partial-hash claims, and their links to stored content."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.graph import connected_components
from cairn.session import cut

DIGESTS = ("sha256", "sha1", "md5", "crc32")


def strength(sha256: Column, sha1: Column, md5: Column, crc32: Column, size: Column) -> Column:
    """3 sha256, 2 sha1, 1 md5, 0 crc32 with a size, null if nothing identifies the content."""
    return F.when(sha256.isNotNull(), 3).when(sha1.isNotNull(), 2).when(md5.isNotNull(), 1).when(crc32.isNotNull() & size.isNotNull(), 0)


def distinct_tuples(claims: DataFrame) -> DataFrame:
    """Equal tuples of claims(claim, size, digests...) collapse to the first claim before any graph work.

    A zero-byte file shared by every entry is then one node and not a mega-component.
    """
    return claims.groupBy("size", *DIGESTS).agg(F.min("claim").alias("claim"))


def candidate_groups(tuples: DataFrame) -> DataFrame:
    """(claim, component): tuples chained by any shared digest value. Others can never be merged."""
    values = tuples.select("claim", F.explode(F.array(*(F.struct(F.lit(i).alias("algo"), F.col(d).alias("value")) for i, d in enumerate(DIGESTS)))).alias("d")).where("d.value IS NOT NULL").select("claim", "d.algo", "d.value")
    least = values.groupBy("algo", "value").agg(F.min("claim").alias("first"))
    edges = values.join(least, ["algo", "value"]).select(F.col("claim").alias("src"), F.col("first").alias("dst")).distinct()
    return connected_components(edges).select(F.col("node").alias("claim"), "component")


class Folder:
    """The sequential rule: a claim joins the strongest compatible identity, which then absorbs others it is compatible with."""

    def __init__(self):
        self.ids: dict[int, dict] = {}
        self.holders: dict[tuple, list[int]] = {}  # (digest kind, value) -> identities, oldest first

    @staticmethod
    def conflict(a: dict, b: dict) -> bool:
        return any(a[f] is not None and b[f] is not None and a[f] != b[f] for f in (*DIGESTS, "size"))

    @staticmethod
    def agrees(a: dict, b: dict) -> bool:
        same = lambda f: a[f] is not None and a[f] == b[f]
        return same("sha256") or same("sha1") or same("md5") or (same("crc32") and same("size"))

    @staticmethod
    def rank(a: dict) -> int:
        return 3 if a["sha256"] is not None else 2 if a["sha1"] is not None else 1 if a["md5"] is not None else 0 if a["crc32"] is not None and a["size"] is not None else -1

    def nominees(self, claim: dict) -> list[int]:
        """Identities sharing a digest value, in lookup order sha256, sha1, md5, crc32, then by age."""
        out: dict[int, None] = {}
        for f in DIGESTS:
            if claim[f] is not None:
                for i in sorted(self.holders.get((f, claim[f]), ())):
                    if "into" not in self.ids[i]:
                        out.setdefault(i)
        return list(out)

    def add(self, claim_id: int, claim: dict) -> int | None:
        if self.rank(claim) < 0:
            return None
        fit = [i for i in self.nominees(claim) if not self.conflict(self.ids[i], claim) and self.agrees(self.ids[i], claim)]
        if not fit:
            self.ids[claim_id] = {f: None for f in (*DIGESTS, "size")}
            self.grow(claim_id, claim)
            return claim_id
        keep = max(fit, key=lambda i: (self.rank(self.ids[i]), -i))
        self.grow(keep, claim)
        for other in fit:
            if other != keep and not self.conflict(self.ids[keep], self.ids[other]) and self.agrees(self.ids[keep], self.ids[other]):
                self.grow(keep, self.ids[other])
                self.ids[other] = {f: None for f in (*DIGESTS, "size")} | {"into": keep}
        return keep

    def grow(self, i: int, more: dict) -> None:
        own = self.ids[i]
        for f in (*DIGESTS, "size"):
            if own[f] is None and more[f] is not None:
                own[f] = more[f]
                if f != "size":
                    self.holders.setdefault((f, more[f]), []).append(i)

    def final(self, i: int) -> int:
        while "into" in self.ids[i]:
            i = self.ids[i]["into"]
        return i


def folded(rows: DataFrame) -> DataFrame:
    """(claim, identity) of (component, claim, size, digests) rows: each component folded in claim order, many components a task."""
    fields = (*DIGESTS, "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, got, now = Folder(), [], None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([None if i is None else folder.final(i) for _, i in got], pa.int64())], names=["claim", "identity"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["component"] != now and got:
                    yield flush()
                    folder, got = Folder(), []
                now = row["component"]
                got.append((row["claim"], folder.add(row["claim"], {f: row[f] for f in fields})))
        if got:
            yield flush()

    return rows.select("component", "claim", *fields).repartition("component").sortWithinPartitions("component", "claim").mapInArrow(run, "claim long, identity long")


def unify(claims: DataFrame) -> DataFrame:
    """(claim, identity) for claims(claim long, size long, digests string); identity: the smallest claim id of it, null if unidentifiable.

    Claims fold in claim order inside their candidate group; groups share no digest
    value, so folding them apart gives the sequential result. A group in which nothing conflicts and all
    claims share a digest (or crc32 and size) is one identity whatever the order: that is
    decided by an aggregation, and only other groups are folded, one in a task's memory at a time.
    """
    tuples = cut(distinct_tuples(claims))
    grouped = cut(tuples.join(candidate_groups(tuples), "claim", "left").withColumn("component", F.coalesce("component", "claim")))
    alike = [(F.coalesce(F.min(f) == F.max(f), F.lit(True))) for f in (*DIGESTS, "size")]
    everywhere = lambda f: F.count(f) == F.count(F.lit(1))
    shared = everywhere("sha256") | everywhere("sha1") | everywhere("md5") | (everywhere("crc32") & everywhere("size"))
    groups = cut(grouped.groupBy("component").agg(F.min("claim").alias("first"), (reduce(Column.__and__, alike) & shared).alias("one"), (F.count(F.lit(1)) == 1).alias("single")))
    plain = grouped.join(groups.where("one OR single"), "component").select("claim", F.when(F.col("one"), F.col("first")).alias("identity"))  # a single claim that identifies nothing has none
    hard = grouped.join(groups.where("NOT one AND NOT single").select("component"), "component")
    found = plain.unionByName(folded(hard))
    same = [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in ("size", *DIGESTS)]
    of_tuple = tuples.join(found, "claim", "left").select("size", *DIGESTS, "identity")
    return claims.alias("a").join(of_tuple.alias("b"), reduce(Column.__and__, same), "left").select("a.claim", "b.identity")


def link_blobs(identities: DataFrame, aliases: DataFrame, blobs: DataFrame) -> DataFrame:
    """(identity, blob, basis): blobs that carry every known digest of an identity and its size where known.

    identities(identity, size, digests), aliases(algo, digest, blob), blobs(blob, size). The basis is the
    strength of what is known. An identity that knows a sha1 but no size is also linked, with basis -1, to
    disk images that declare this sha1 (aliases with algo "disk_sha1"), unless it is linked already.
    """
    known = identities.select("identity", "size", F.explode(F.array(*(F.struct(F.lit(d).alias("algo"), F.col(d).alias("digest")) for d in DIGESTS))).alias("k")).where("k.digest IS NOT NULL").select("identity", "size", "k.algo", "k.digest")
    wanted = known.groupBy("identity").agg(F.count(F.lit(1)).alias("wanted"))
    carried = aliases.select("algo", "digest", "blob").distinct()
    hits = known.join(carried, ["algo", "digest"]).groupBy("identity", "blob").agg(F.count(F.lit(1)).alias("hits"), F.first("size").alias("size"))
    full = hits.join(wanted, "identity").where("hits = wanted").join(blobs.select("blob", F.col("size").alias("blob_size")), "blob").where("size IS NULL OR size = blob_size")
    ranks = identities.select("identity", strength(*(F.col(d) for d in ("sha256", "sha1", "md5", "crc32", "size"))).alias("basis"))
    strong = full.join(ranks.where("basis IS NOT NULL"), "identity").select("identity", "blob", "basis")
    declared = identities.where("size IS NULL AND sha1 IS NOT NULL").select("identity", F.col("sha1").alias("digest")).join(carried.where("algo = 'disk_sha1'"), "digest").select("identity", "blob", F.lit(-1).alias("basis"))
    return strong.unionByName(declared.join(strong, ["identity", "blob"], "left_anti"))


def identity_tuples(claims: DataFrame, unified: DataFrame) -> DataFrame:
    """(identity, size, digests) from claims(claim, size, digests) and unify()'s result: what is known of every identity."""
    joined = claims.join(unified.where("identity IS NOT NULL"), "claim")
    return joined.groupBy("identity").agg(*(F.max(f).alias(f) for f in ("size", *DIGESTS)))
