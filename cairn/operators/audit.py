"""Availability of catalog entries: identity states, entry roll-ups, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import IDENTITY_STATES, entry_state


def identity_status(links: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """Stage 1: the best state of each identity over its linked blobs.

    links(identity, basis, resident, grounded_verified, grounded_claimed, blob).
    Tested in this order: verified, probable, peer, claimed, missing. Identities
    without a blob get no row.
    """
    if peers is not None:
        links = links.join(peers.select("blob").distinct().withColumn("peer", F.lit(True)), "blob", "left").withColumn("peer", F.coalesce("peer", F.lit(False)))
    else:
        links = links.withColumn("peer", F.lit(False))
    solid = F.col("basis") >= 1
    here = F.col("resident") | F.col("grounded_verified")
    state = (
        F.when(solid & here, IDENTITY_STATES["verified"])
        .when(solid & F.col("grounded_claimed"), IDENTITY_STATES["probable"])
        .when(F.col("peer"), IDENTITY_STATES["peer"])
        .when((F.col("basis") <= 0) & here, IDENTITY_STATES["claimed"])
        .otherwise(IDENTITY_STATES["missing"])
    )
    return links.groupBy("identity").agg(F.max(state).alias("state"))


def entry_rollup(claims: DataFrame, states: DataFrame, required: Column, entry: str = "entry", identity: str = "identity") -> DataFrame:
    """Stage 2: per entry, how many required claims are in which state (a claim without a state is missing)."""
    rows = claims.where(required).join(states.select(F.col("identity").alias(identity), "state"), identity, "left")
    s = F.coalesce("state", F.lit(0))
    return rows.groupBy(entry).agg(
        F.count(F.lit(1)).alias("required"),
        F.count_if(s == 4).alias("have_verified"),
        F.count_if(s == 1).alias("have_claimed"),
        F.count_if(s == 2).alias("peer_avail"),
        F.count_if(s == 3).alias("probable"),
        F.count_if((s == 0) | (s == 3)).alias("missing"),
    )


def with_entry_state(entries: DataFrame, rollup: DataFrame, entry: str = "entry") -> DataFrame:
    """All entries with their state; entries without claims count as nothing required (3)."""
    joined = entries.join(rollup, entry, "left")
    return joined.withColumn("state", entry_state(F.col("required"), F.col("missing"), F.col("have_claimed")))


def report(rollup: DataFrame) -> DataFrame:
    """One row per audited entry: probable claims are split out of the missing ones."""
    return rollup.withColumn("truly_missing", F.greatest(F.col("missing") - F.col("probable"), F.lit(0))).withColumn("complete", F.col("missing") == 0)


def totals(rollup: DataFrame) -> DataFrame:
    """One row for the whole report; entries without claims are not in it."""
    rows = report(rollup)
    return rows.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if("complete").alias("complete"),
        F.sum("have_verified").alias("verified"),
        F.sum("probable").alias("probable"),
        F.sum("truly_missing").alias("missing"),
        F.sum("have_claimed").alias("claimed"),
        F.sum("peer_avail").alias("peer"),
    )


def state_histogram(entries: DataFrame, by: str) -> DataFrame:
    """Entries of each state per group, in one pass."""
    return entries.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), *(F.count_if(F.col("state") == code).alias(name) for code, name in enumerate(("verified", "claimed", "missing", "nodump"))))
