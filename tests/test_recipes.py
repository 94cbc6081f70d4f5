"""Recipes, eviction, routes, jobs and state: brute force over whole tables, and small golden scenarios."""

import random

import pytest
from cairn import registry
from cairn.operators import jobs, recipes, recon, state
from cairn.plans import graph
from pyspark.sql import functions as F


def grounded(recipes_, inputs, outputs, seeds):
    found = set(seeds)
    while True:
        more = {n for r in recipes_ if inputs.get(r, set()) <= found for n in outputs.get(r, set())} - found
        if not more:
            return found
        found |= more


@pytest.fixture(scope="module")
def world(spark, sf):
    from cairn.registry_graph import Recipes

    r = Recipes(spark, sf)
    verify = {x.recipe: x.verify for x in r.recipes.collect()}
    seek = {x.recipe: x.seek_class for x in r.recipes.collect()}
    inputs, outputs = {}, {}
    for x in r.inputs.collect():
        inputs.setdefault(x.recipe, set()).add(x.node)
    for x in r.outputs.collect():
        outputs.setdefault(x.recipe, set()).add(x.node)
    size = {x.node: x["size"] or 0 for x in r.contents.collect()}
    seeds = {x.node for x in r.seeds.collect()}
    pinned = {x.node for x in r.pinned.collect()}
    return verify, seek, inputs, outputs, size, seeds, pinned


def test_evictable_over_all_contents(spark, sf, world):
    verify, _, inputs, outputs, _, seeds, _ = world
    made = {n for ns in outputs.values() for n in ns}
    want = {n: n in grounded(verify, inputs, outputs, seeds - {n}) for n in seeds & made}
    got = {r.node: r.held for r in registry.QUERIES["evictable"](spark, sf).collect()}
    assert got == want and len(set(want.values())) == 2


def test_evictable_takes_out_what_rests_on_a_seed_only(spark, monkeypatch):
    """Every seed leads to every derived content through some recipe; only what derivations rest on is looked at."""
    n, m = 12, 12
    ins, outs, k = [], [], 0
    for made in range(m):  # each derived content can be made of any one seed
        for seed in range(n):
            ins.append((k, f"s{seed:02}"))
            outs.append((k, f"d{made:02}"))
            k += 1
    for seed in range(n):  # and each seed of the first derived content
        ins.append((k, "d00"))
        outs.append((k, f"s{seed:02}"))
        k += 1
    ins.append((k, "s05"))  # besides, one that rests on a single seed, and that seed's only other recipe needs it
    outs.append((k, "only"))
    r = spark.createDataFrame([(x,) for x in range(k + 1)], "recipe long")
    i, o = spark.createDataFrame(ins, "recipe long, node string"), spark.createDataFrame(outs, "recipe long, node string")
    seeds = spark.createDataFrame([(f"s{x:02}",) for x in range(n)], "node string")
    pairs, plain = [], graph.closure

    def closure(*args):
        found = plain(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(graph, "closure", closure)
    held = graph.grounded_without(graph.grounded(r, i, o, seeds), r, i, o, seeds, seeds).collect()
    assert {x.node for x in held if x.held} == {f"s{x:02}" for x in range(n)} and pairs and sum(pairs) <= 2 * (n + m + 1)


def greedy(verify, seek, inputs, outputs, size, seeds, pinned, target):
    trusted = [r for r, v in verify.items() if v == 3]
    best = {}
    for r in trusted:
        for n in outputs[r] & seeds:
            best[n] = min(best.get(n, 9), seek[r])
    left, out = set(seeds), []
    for n in sorted(best, key=lambda n: (best[n], -size[n], n)):
        if sum(size[x] for x in left) <= target:
            break
        if n not in pinned and n in grounded(trusted, inputs, outputs, left - {n}):
            left.discard(n)
            out.append(n)
    return out


def test_evict_plan_is_the_greedy_one(spark, sf, world):
    verify, seek, inputs, outputs, size, seeds, pinned = world
    target = sum(size[n] for n in seeds) * 3 // 4
    got = [r.node for r in registry.QUERIES["evict_plan"](spark, sf).orderBy("place").collect()]
    assert got == greedy(verify, seek, inputs, outputs, size, seeds, pinned, target) and got


def tables(spark, recipe_rows, ins, outs, contents):
    return (
        spark.createDataFrame(recipe_rows, "recipe long, op string, verify int, source int, seek_class int"),
        spark.createDataFrame(ins, "recipe long, position long, node string"),
        spark.createDataFrame(outs, "recipe long, node string"),
        spark.createDataFrame(contents, "node string, size long, resident boolean"),
    )


def test_eviction_of_a_cycle(spark):
    """Two contents that make each other: one goes, the other stays, whichever the order prefers."""
    r, i, o, c = tables(spark, [(1, "a@1", 3, 0, 0), (2, "b@1", 3, 0, 2), (3, "c@1", 3, 0, 1)], [(1, 0, "p"), (2, 0, "q"), (3, 0, "q")], [(1, "q"), (2, "p"), (3, "z")], [("p", 5, True), ("q", 3, True), ("z", 2, True)])
    none = c.select("node").limit(0)
    assert [x.node for x in recipes.evict_plan(r, i, o, c, none, 0).orderBy("place").collect()] == ["q", "z"]
    assert [x.node for x in recipes.evict_plan(r, i, o, c, none, 8).orderBy("place").collect()] == ["q"]
    assert recipes.evict_plan(r, i, o, c, none, 10).count() == 0
    assert [x.node for x in recipes.evict_plan(r, i, o, c, c.where("node = 'q'").select("node"), 0).orderBy("place").collect()] == ["z", "p"]


def test_evict_plan_on_random_graphs(spark):
    rng = random.Random(7)
    for _ in range(3):
        nodes = [f"n{k:02}" for k in range(16)]
        rows, ins, outs, inputs, outputs, verify, seek = [], [], [], {}, {}, {}, {}
        for k in range(22):
            made, *used = rng.sample(nodes, rng.randint(2, 4))
            verify[k], seek[k] = rng.choice([3, 3, 3, 1]), rng.randint(0, 2)
            rows.append((k, "x@1", verify[k], 0, seek[k]))
            ins += [(k, p, n) for p, n in enumerate(used)]
            outs.append((k, made))
            inputs[k], outputs[k] = set(used), {made}
        size = {n: rng.randint(1, 9) for n in nodes}
        seeds = set(rng.sample(nodes, 12))
        r, i, o, c = tables(spark, rows, ins, outs, [(n, size[n], n in seeds) for n in nodes])
        got = [x.node for x in recipes.evict_plan(r, i, o, c, c.select("node").limit(0), 5).orderBy("place").collect()]
        assert got == greedy(verify, seek, inputs, outputs, size, seeds, set(), 5)


def test_why_blocked(spark):
    r, i, o, c = tables(spark, [(1, "a@1", 3, 0, 0), (2, "b@1", 2, 0, 0), (3, "c@1", 1, 0, 0), (4, "d@1", 0, 0, 0), (5, "e@1", 3, 0, 0), (6, "f@1", 3, 0, 0)], [(1, 0, "x"), (2, 0, "x"), (3, 0, "x"), (4, 0, "x"), (5, 0, "lost"), (6, 0, "b")], [(1, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "b"), (6, "b")], [("a", 1, True), ("b", 1, True), ("x", 1, True), ("lost", 1, False), ("pin", 1, True)])
    found = graph.grounded(r.where("verify = 3"), i, o, c.where("resident").select("node"))
    held = graph.grounded_without(found, r.where("verify = 3"), i, o, c.where("resident").select("node"), c.select("node"))
    rows = recipes.why_blocked(r, i, o, c, c.where("node = 'pin'").select("node"), found, held)
    got = sorted((x.node, x.recipe or 0, x.reason) for x in rows.collect())
    assert got == [("a", 0, "evictable"), ("b", 2, "poisoned"), ("b", 3, "not licensed yet"), ("b", 4, "never verified"), ("b", 5, "inputs cannot be rebuilt"), ("b", 6, "breaks its own grounding"), ("lost", 0, "not resident"), ("pin", 0, "pinned"), ("x", 0, "no recipe")]


def test_fetch_walk_of_cycles(spark):
    r, i, o, c = tables(spark, [(k, "a@1", 2 if k == 9 else 1, 0, 0) for k in range(1, 10)], [(1, 0, "b"), (2, 0, "a"), (3, 0, "leaf"), (4, 0, "here"), (9, 0, "here")], [(1, "a"), (2, "b"), (3, "b"), (4, "c"), (9, "bad")], [("here", 9, True), ("leaf", 4, False), ("a", 1, False), ("b", 2, False), ("c", 3, False), ("bad", 5, False)])
    walk = lambda *wants: {x.node: x.outcome for x in recipes.fetch_walk(spark.createDataFrame([(w,) for w in wants], "node string"), r, i, o, c).collect()}
    assert walk("a") == {"a": "supported", "b": "supported", "leaf": "fetch"}  # b does not go back to a
    assert walk("b") == {"a": "fetch", "b": "supported"} or walk("b") == {"a": "supported", "b": "supported", "leaf": "fetch"}
    assert walk("c", "bad", "unknown") == {"c": "supported", "here": "supported", "bad": "fetch", "unknown": "fetch"}
    with pytest.raises(RuntimeError):
        recipes.fetch_walk(spark.createDataFrame([("a",)], "node string"), r, i, o, c, most=1)


def test_fetch_walk_without_cycles_has_no_bound(spark):
    """Recipes that lead into no cycle are followed by a closure: ``most`` bounds only what the driver walks."""
    r, i, o, c = tables(spark, [(k, "a@1", 1, 0, 0) for k in range(1, 4)], [(1, 0, "b"), (1, 1, "x"), (2, 0, "a"), (3, 0, "c")], [(1, "c"), (2, "b"), (3, "c")], [("a", 1, True), ("x", 1, False)])
    got = {x.node: x.outcome for x in recipes.fetch_walk(spark.createDataFrame([("c",)], "node string"), r, i, o, c, most=1).collect()}
    assert got == {"a": "supported", "b": "supported", "c": "supported", "x": "fetch"}


def test_sync_savings_of_a_walk_without_bound(spark):
    r, i, o, c = tables(spark, [(1, "a@1", 1, 0, 0), (2, "a@1", 1, 0, 0)], [(1, 0, "b"), (1, 1, "x"), (2, 0, "a")], [(1, "c"), (2, "b")], [("a", 1, True), ("b", 5, False), ("c", 10, False), ("x", 3, False)])
    want = spark.createDataFrame([("c",)], "node string")
    got = recipes.sync_savings(recipes.fetch_walk(want, r, i, o, c, most=1), c, want).first()
    assert tuple(got) == (10, 3, 1, 70)


def test_sync_savings_sorts_a_bounded_part_in_a_task(spark, sf, monkeypatch):
    """The recipes' lines are dealt by recipe into parts of so many rows, whatever the session's number of shuffle partitions; the result is the same."""
    from cairn import registered
    from cairn.registry_graph import Recipes

    want = registry.QUERIES["sync_savings"](spark, sf).first()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(registered, "ROWS_A_TASK", 300, raising=False)
    r = Recipes(spark, sf)
    for rows in (r.recipes, r.inputs, r.outputs):
        parts = [x["count"] for x in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
        assert len(parts) == lines // 300 and max(parts) <= 450
    assert registry.QUERIES["sync_savings"](spark, sf).first() == want and want["wanted"] > 0


def test_fetch_walk_of_repeated_rows(spark):
    r, i, o, c = tables(spark, [(1, "a@1", 1, 0, 0), (2, "a@1", 1, 0, 0), (3, "a@1", 1, 0, 0)], [(1, 0, "b"), (1, 1, "x"), (2, 0, "c"), (3, 0, "x")], [(1, "c"), (2, "b"), (3, "d")], [("b", 5, False), ("c", 10, False), ("d", 2, False), ("x", 3, False)])
    want = spark.createDataFrame([("c",), ("d",)], "node string")
    once = sorted(recipes.fetch_walk(want, r, i, o, c).collect())
    assert once == sorted(recipes.fetch_walk(want, r.union(r), i.union(i), o.union(o), c).collect()) and once == [("b", "fetch"), ("c", "supported"), ("d", "supported"), ("x", "fetch")]


def test_fetch_walk_on_random_graphs(spark):
    """The walk as its definition has it, one content after the other, on graphs with and without cycles."""
    rng = random.Random(11)
    for up in (0.05, 0.3):
        n = 40
        rows, ins, outs, routes = [], [], [], {}
        for k in range(60):
            made = rng.randrange(3, n)
            used = rng.sample(range(made if rng.random() >= up else n), rng.randint(1, 3))
            rows.append((k, "x@1", 1, 0, 0))
            ins += [(k, p, f"n{u:02}") for p, u in enumerate(used)]
            outs.append((k, f"n{made:02}"))
            routes.setdefault(f"n{made:02}", []).append([f"n{u:02}" for u in used])
        here = {f"n{k:02}" for k in range(n) if rng.random() < 0.2}
        wants, want = [f"n{k:02}" for k in (39, 38, 20, 5, 1)], {}

        def visit(node, path, routes=routes, here=here, want=want):
            if node in want or node in path:
                return
            route = None if node in here else next((x for x in routes.get(node, []) if node not in x and not path & set(x)), None)
            for x in route or []:
                visit(x, path | {node})
            want[node] = "supported" if node in here or route is not None else "fetch"

        for w in sorted(wants):
            visit(w, frozenset())
        r, i, o, c = tables(spark, rows, ins, outs, [(f"n{k:02}", 1, f"n{k:02}" in here) for k in range(n)])
        assert {x.node: x.outcome for x in recipes.fetch_walk(spark.createDataFrame([(w,) for w in wants], "node string"), r, i, o, c).collect()} == want


def test_chains_of_any_length(spark):
    n = 1000
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert graph.closure(chain, spark.createDataFrame([(0,), (990,)], "root long")).count() == n + 1 + 11
    m = 70
    one = spark.createDataFrame([(i, i) for i in range(m)], "recipe long, node long")
    made = spark.createDataFrame([(i, i + 1) for i in range(m)], "recipe long, node long")
    found = graph.grounded(one.select("recipe"), one, made, spark.createDataFrame([(0,)], "node long"))
    assert {(r.node, r.round) for r in found.collect()} == {(i, i) for i in range(m + 1)}


def test_long_parent_chains_are_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.chain_top(spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "node long, parent long"))


def test_coded_symbols_have_their_density_and_decode(spark):
    import numpy as np

    checks = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    _, symbols = recon.symbols_of(checks, 256)
    share = np.bincount(symbols, minlength=256) / len(checks)
    law = 1 / (1 + np.arange(256) / 2)
    assert np.abs(share / law - 1)[:64].max() < 0.12 and abs(share[64:].sum() / law[64:].sum() - 1) < 0.03
    rng = random.Random(5)
    keys = rng.sample(range(10**9), 3000)
    make = lambda ks: spark.createDataFrame([(k,) for k in ks], "key long")
    a, b = keys[:2900], keys[100:]
    for n in (200, 300, 400):  # the difference has 200 keys
        rows = [tuple(r) for r in recon.subtract(recon.encode(make(a), "key", n), recon.encode(make(b), "key", n)).collect()]
        ours, theirs, done = recon.peel(rows, n, recon.key_check)
        if done:
            break
    assert done and ours == set(keys[:100]) and theirs == set(keys[2900:])
    with pytest.raises(ValueError):
        recon.peel([(0, 5, recon.key_check(5), 1), (1, 5, recon.key_check(5), 1), (2, 5, recon.key_check(5), 1), (3, 5, recon.key_check(5), 1)], 2, recon.key_check)


def test_states_and_rehabilitation(spark):
    r = spark.createDataFrame([(1, 0), (2, 2), (3, 3), (4, 1)], "recipe long, verify int")
    after, refused = recipes.set_states(r, spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 3), (9, 1)], "recipe long, verify int"))
    assert sorted((x.recipe, x.verify) for x in after.collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]
    assert sorted((x.recipe, x.verify, x.wanted) for x in refused.collect()) == [(2, 2, 1), (3, 3, 1)]
    back = recipes.rehabilitated(r, spark.createDataFrame([(2,), (3,)], "recipe long"))
    assert sorted((x.recipe, x.verify) for x in back.collect()) == [(1, 0), (2, 0), (3, 3), (4, 1)]


def test_revisions_and_settings(spark):
    sources = spark.createDataFrame([("p", "s", 3), ("p", "t", None)], "provider string, system string, current long")
    assert state.current_revision(sources, "p", "s") == 3
    with pytest.raises(LookupError):
        state.current_revision(sources, "p", "x")
    with pytest.raises(ValueError):
        state.current_revision(sources, "p", "t")
    rows = spark.range(2500).withColumnRenamed("id", "k")
    assert state.page(rows, ["k"]).count() == 200 and state.page(rows, ["k"], 5000).count() == 1000 and state.page(rows, ["k"], 0).first()["total"] == 2500


def test_kept_jobs(spark):
    ledger = spark.createDataFrame([(k, "a", 0 if k == 1 else 1, k, k) for k in range(1, 8)], "job long, kind string, state int, started long, finished long")
    assert sorted(r.job for r in jobs.kept_jobs(ledger, 2).collect()) == [1, 6, 7]
    guard = spark.createDataFrame([("a", 5)], "holder string, until long")
    assert jobs.release_guard(guard, "a").count() == 0 and jobs.release_guard(guard, "b").count() == 1


def test_digest_of_any_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    assert state.digest(rows).first() == state.digest(rows.repartition(3, "k")).first()
    assert state.digest(rows).first() != state.digest(rows.distinct()).first() and state.digest(rows.limit(0)).first().n == 0


def test_labels_of_components_survive_many_rounds(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}
    text = spark.createDataFrame(edges, "src long, dst long").select(F.col("src").cast("string"), F.col("dst").cast("string"))
    assert len({r.component for r in graph.connected_components(text).collect()}) == len(set(got.values()))
