"""Queries over whole tables against brute force."""

from collections import defaultdict

import pytest

from cairn import registry


def read(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def reach(hops, seed):
    seen, todo = {seed}, [seed]
    while todo:
        for x in hops[todo.pop()] - seen:
            seen.add(x)
            todo.append(x)
    return seen


@pytest.mark.parametrize("mode", ["non_merged", "split", "merged"])
def test_rendering_all_claims(spark, sf, mode):
    machines = {m for (m,) in read(spark, sf, "supplier", "s_suppkey")}
    device = {m: m % 9 == 0 for m in machines}
    alone = {m: m % 9 == 0 or m % 13 == 0 for m in machines}
    top = {m: m - m % 4 if m % 4 and m > 4 else m for m in machines}
    hops = defaultdict(set, {m: {m * 3 % 90 + 9 - m * 3 % 90 % 9} for m in machines if m % 5 < 2})
    users = defaultdict(set)
    for m in machines:
        if not device[m]:
            for x in reach(hops, m):
                users[x].add(m)
    claims = read(spark, sf, "lineitem", "l_partkey", "l_linenumber", "l_suppkey")
    best = {}
    for part, line, machine in claims:
        merges = line % 3 == 0
        if mode == "non_merged":
            sets = users[machine]
        elif mode == "split":
            sets = set() if merges else {machine}
        else:
            sets = set() if merges else {machine if alone[machine] else top[machine]}
        for s in sets:
            key = s, f"f{part % 50}", part % 200
            best[key] = min(best.get(key, 1 << 60), part * 10 + line)
    got = registry.QUERIES[f"render_{mode}_all"](spark, sf).select("set", "file", "claim").collect()
    assert sorted(map(tuple, got)) == sorted((s, f, c) for (s, f, _), c in best.items())


@pytest.fixture(scope="module")
def edges(spark, sf):
    customer = dict(read(spark, sf, "orders", "o_orderkey", "o_custkey"))
    return {(2 * customer[o], 2 * p + 1) for o, p in read(spark, sf, "lineitem", "l_orderkey", "l_partkey") if o in customer}


def components_of(edges):
    both, found = defaultdict(set), {}
    for a, b in edges:
        both[a].add(b)
        both[b].add(a)
    for node in sorted(both):
        if node not in found:
            found.update(dict.fromkeys(reach(both, node), node))
    return found


def test_components_over_all_edges(spark, sf, edges):
    got = registry.QUERIES["components_all"](spark, sf).select("node", "component").collect()
    assert sorted(map(tuple, got)) == sorted(components_of(edges).items())


def test_downstream_over_all_edges(spark, sf, edges):
    hops = defaultdict(set)
    for a, b in edges:
        hops[a if a % 4 == 0 else b].add(b if a % 4 == 0 else a)
    got = registry.QUERIES["downstream_all"](spark, sf).select("root", "node").collect()
    assert sorted(map(tuple, got)) == sorted((seed, x) for seed in list(hops) for x in reach(hops, seed))


def test_attribution_over_all_edges(spark, sf, edges):
    comp, size = components_of(edges), dict(read(spark, sf, "part", "p_partkey", "p_size"))
    sources = defaultdict(set)
    for customer, nation in read(spark, sf, "customer", "c_custkey", "c_nationkey"):
        if 2 * customer in comp:
            sources[comp[2 * customer]].add(nation)
    blobs, total = defaultdict(int), defaultdict(int)
    for part, n in size.items():
        for source in sources.get(comp.get(2 * part + 1), ()):
            blobs[source] += 1
            total[source] += n
    got = registry.QUERIES["attribution_all"](spark, sf).select("source", "blobs", "bytes").collect()
    assert sorted(map(tuple, got)) == sorted((s, n, total[s]) for s, n in blobs.items())
