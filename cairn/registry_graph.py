"""Queries over recipes: trust modes, routes, eviction, reconciliation.

Every order is a recipe whose output is its greatest part and whose inputs are the others; parts are contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import recipes as R
from cairn.operators import recon, state, store
from cairn.plans import graph
from cairn.registered import fixture, query

_LINE = "SELECT DISTINCT l_orderkey AS recipe, l_partkey AS node FROM lineitem"
_OUT = f"SELECT recipe, max(node) AS node FROM ({_LINE}) x GROUP BY recipe HAVING count(*) >= 2"
_IN = f"SELECT a.recipe AS recipe, a.node AS position, a.node AS node FROM ({_LINE}) a JOIN ({_OUT}) b ON a.recipe = b.recipe AND a.node <> b.node"
_RECIPES = f"SELECT recipe, CASE WHEN recipe % 3 = 0 THEN 'deflate@1' WHEN recipe % 3 = 1 THEN 'assemble@1' ELSE 'c0ffee#unpack' END AS op, CAST(recipe % 4 AS INTEGER) AS verify, CAST(recipe % 2 AS INTEGER) AS source, CAST(recipe % 3 AS INTEGER) AS seek_class FROM ({_OUT}) x"
_CONTENTS = "SELECT p_partkey AS node, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) END AS size, p_partkey % 2 <> 0 AS resident FROM part"
_PINNED = "SELECT p_partkey AS node FROM part WHERE p_size = 7"


class Recipes:
    """The fixture's tables."""

    def __init__(self, spark: SparkSession, sf: str):
        run = lambda sql: fixture(spark, sf, sql, {"lineitem": "l_orderkey"})
        self.recipes, self.inputs, self.outputs, self.contents = run(_RECIPES), run(_IN), run(_OUT), run(_CONTENTS)
        self.seeds, self.pinned = self.contents.where("resident").select("node"), run(_PINNED)


_WITH = f"WITH inp AS ({_IN}), outp AS ({_OUT}), rec AS ({_RECIPES}), con AS ({_CONTENTS}), pin AS ({_PINNED})"


def _rounds(rec: str, seeds: str, rounds: int = 8, prefix: str = "g") -> str:
    """CTEs that unroll the grounding of recipes ``rec`` (a SELECT of recipe) from ``seeds`` (a SELECT of node), with the round of every node."""
    parts = [f"{prefix}rec AS ({rec})", f"{prefix}0 AS (SELECT node, 0 AS round FROM ({seeds}) s)"]
    for k in range(1, rounds + 1):
        before = f"SELECT node FROM {prefix}{k - 1}"
        parts.append(
            f"{prefix}{k} AS (SELECT node, round FROM {prefix}{k - 1} UNION ALL SELECT DISTINCT node, {k} AS round FROM outp WHERE recipe IN (SELECT recipe FROM {prefix}rec) "
            f"AND recipe NOT IN (SELECT recipe FROM inp WHERE node NOT IN ({before})) AND node NOT IN ({before}))"
        )
    return ", ".join(parts)


_MODES = {"eviction": "verify = 3", "audit-verified": "verify = 3 OR (verify = 1 AND source = 0)", "audit-claimed": "verify IN (1, 3)"}
_RESIDENT = "SELECT node FROM con WHERE resident"


@query(
    f"{_WITH}, "
    + ", ".join(_rounds(f"SELECT recipe FROM rec WHERE {cond}", _RESIDENT, 8, p) for p, cond in zip("abc", _MODES.values(), strict=True))
    + " "
    + " UNION ALL ".join(f"SELECT '{mode}' AS mode, node FROM {p}8" for p, mode in zip("abc", _MODES, strict=True))
)
def trust_modes(spark, sf):
    """Contents grounded in each trust mode."""
    r = Recipes(spark, sf)
    out = None
    for mode in _MODES:
        trusted = r.recipes.where(graph.trusted(mode, F.col("verify"), F.col("source")))
        one = graph.grounded(trusted, r.inputs, r.outputs, r.seeds).select(F.lit(mode).alias("mode"), "node")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"{_WITH}, {_rounds('SELECT recipe FROM rec WHERE verify <> 2', _RESIDENT)}, ready AS (SELECT i.recipe AS recipe, max(round) AS at FROM inp i LEFT JOIN g8 ON g8.node = i.node GROUP BY i.recipe HAVING count(*) = count(round)) "
    "SELECT g8.node AS node, g8.round AS round, min(ready.recipe) AS recipe FROM g8 JOIN outp ON outp.node = g8.node JOIN ready ON ready.recipe = outp.recipe JOIN grec ON grec.recipe = outp.recipe WHERE g8.round > 0 AND ready.at < g8.round GROUP BY g8.node, g8.round"
)
def route_plan(spark, sf):
    """For every content that is not here but can be made: when, and by which recipe first."""
    r = Recipes(spark, sf)
    usable = r.recipes.where("verify <> 2")
    found = graph.grounded(usable, r.inputs, r.outputs, r.seeds)
    live = usable.select("recipe")
    first = graph.witnesses(found, r.inputs.join(live, "recipe", "left_semi").select("recipe", "node"), r.outputs.join(live, "recipe", "left_semi"))
    return found.where("round > 0").join(first, "node").select("node", "round", "recipe")


@query()
def evictable(spark, sf):
    """Every resident content with a recipe: is it still grounded when its own bytes are gone?"""
    r = Recipes(spark, sf)
    found = graph.grounded(r.recipes, r.inputs, r.outputs, r.seeds)
    made = r.outputs.select("node").distinct()
    return graph.grounded_without(found, r.recipes, r.inputs, r.outputs, r.seeds, r.seeds.join(made, "node", "left_semi"))


@query()
def evict_plan(spark, sf):
    """What to drop, in the policy's order, to come down to three quarters of the resident bytes."""
    r = Recipes(spark, sf)
    resident = r.contents.where("resident").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return R.evict_plan(r.recipes, r.inputs, r.outputs, r.contents, r.pinned, resident * 3 // 4)


@query(
    f"{_WITH}, {_rounds('SELECT recipe FROM rec WHERE verify = 3', _RESIDENT)} SELECT node, count(*) AS reasons, min(reason) AS first_reason FROM ("
    "SELECT con.node AS node, CASE WHEN NOT resident THEN 'not resident' WHEN con.node IN (SELECT node FROM pin) THEN 'pinned' WHEN con.node NOT IN (SELECT node FROM outp) THEN 'no recipe' ELSE "
    "CASE rec.verify WHEN 2 THEN 'poisoned' WHEN 1 THEN 'not licensed yet' WHEN 0 THEN 'never verified' ELSE 'licensed' END END AS reason "
    "FROM con LEFT JOIN outp ON outp.node = con.node AND con.resident AND con.node NOT IN (SELECT node FROM pin) LEFT JOIN rec ON rec.recipe = outp.recipe) x GROUP BY node"
)
def why_blocked(spark, sf):
    """Per content, how many reasons keep its bytes here, and one of them; what licensed recipes lack is one word here, since SQL would need a fixpoint for each."""
    r = Recipes(spark, sf)
    trusted = r.recipes.where("verify = 3")
    found = graph.grounded(trusted, r.inputs, r.outputs, r.seeds)
    none = r.contents.select("node", F.lit(False).alias("held")).limit(0)
    rows = R.why_blocked(r.recipes, r.inputs, r.outputs, r.contents, r.pinned, found, none)
    licensed = F.when(F.col("reason").isin("inputs cannot be rebuilt", "breaks its own grounding"), "licensed").otherwise(F.col("reason"))
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("reasons"), F.min(licensed).alias("first_reason"))


@query(f"{_WITH} SELECT c.node AS node, size, min(seek_class) AS seek_class FROM con c JOIN outp o ON o.node = c.node JOIN rec r ON r.recipe = o.recipe WHERE resident AND verify = 3 GROUP BY c.node, size")
def eviction_order(spark, sf):
    r = Recipes(spark, sf)
    return R.eviction_order(r.recipes, r.outputs, r.contents)


@query(f"{_WITH} SELECT DISTINCT c.node AS node, size FROM con c JOIN outp o ON o.node = c.node JOIN rec r ON r.recipe = o.recipe WHERE resident AND verify = 1")
def license_pool(spark, sf):
    r = Recipes(spark, sf)
    return R.license_pool(r.recipes, r.outputs, r.contents)


@query(f"{_WITH} SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS contents, count(*) FILTER (WHERE size IS NULL) AS sizeless FROM con WHERE resident")
def resident_bytes(spark, sf):
    return Recipes(spark, sf).contents.where("resident").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("contents"), F.count_if(F.col("size").isNull()).alias("sizeless"))


_SNAPSHOTS = "SELECT CAST(o_custkey AS VARCHAR) AS snapshot, l_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
_TAGS = "SELECT CAST(c_custkey AS VARCHAR) AS snapshot FROM customer WHERE c_acctbal < 0"
_IMAGES = "SELECT CAST(c_custkey AS VARCHAR) AS snapshot, c_nationkey AS node FROM customer"


@query(f"SELECT DISTINCT node FROM ({_SNAPSHOTS} UNION ALL {_IMAGES}) x WHERE snapshot IN ({_TAGS})")
def pin_protection(spark, sf):
    """Contents that tagged snapshots and images keep."""
    return R.pinned(fixture(spark, sf, _SNAPSHOTS), fixture(spark, sf, _TAGS), fixture(spark, sf, _IMAGES))


@query(f"{_WITH} SELECT DISTINCT node FROM inp WHERE node NOT IN (SELECT node FROM con WHERE resident)")
def missing_inputs(spark, sf):
    r = Recipes(spark, sf)
    return R.missing_inputs(r.inputs, r.contents)


_WANTS = "SELECT p_partkey AS node FROM part WHERE p_size = 50"
_WALK = f"""{_WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, want AS ({_WANTS}), firsts AS (SELECT outp.node AS node, min(rec.recipe) AS recipe FROM outp JOIN rec ON rec.recipe = outp.recipe JOIN con ON con.node = outp.node WHERE verify <> 2 AND NOT resident GROUP BY outp.node),
walk(node) AS (SELECT node FROM want UNION SELECT inp.node FROM walk JOIN firsts ON firsts.node = walk.node JOIN inp ON inp.recipe = firsts.recipe),
told AS (SELECT walk.node AS node, CASE WHEN resident OR firsts.recipe IS NOT NULL THEN 'supported' ELSE 'fetch' END AS outcome FROM walk JOIN con ON con.node = walk.node LEFT JOIN firsts ON firsts.node = walk.node)"""


@query(f"{_WALK} SELECT node, outcome FROM told")
def fetch_walk(spark, sf):
    """What to fetch for the wanted contents. Inputs are smaller than outputs here, so no recipe is circular and SQL can follow the first ones."""
    r = Recipes(spark, sf)
    return R.fetch_walk(fixture(spark, sf, _WANTS), r.recipes, r.inputs, r.outputs, r.contents)


@query(f"{_WALK}, s AS (SELECT (SELECT coalesce(sum(size), 0) FROM want JOIN con ON con.node = want.node) AS wanted, (SELECT coalesce(sum(size), 0) FROM told JOIN con ON con.node = told.node WHERE outcome = 'fetch') AS fetched, (SELECT count(*) FROM told WHERE outcome = 'fetch') AS n_fetched) SELECT CAST(wanted AS BIGINT) AS wanted, CAST(fetched AS BIGINT) AS fetched, n_fetched, CAST(CASE WHEN wanted > 0 THEN floor(greatest(wanted - fetched, 0) * 100.0 / wanted) ELSE 0 END AS BIGINT) AS savings_pct FROM s")
def sync_savings(spark, sf):
    r, wants = Recipes(spark, sf), fixture(spark, sf, _WANTS)
    return R.sync_savings(R.fetch_walk(wants, r.recipes, r.inputs, r.outputs, r.contents), r.contents, wants)


@query(f"{_WITH}, {_rounds('SELECT recipe FROM rec WHERE op = ' + chr(39) + 'assemble@1' + chr(39) + ' AND source = 0 AND seek_class = 1 AND verify IN (1, 3)', 'SELECT node FROM con WHERE resident AND node % 5 <> 0')} SELECT node FROM g8")
def affine_carveout(spark, sf):
    """Contents that can be read in place; here seek class 1 plays the affine one."""
    r = Recipes(spark, sf)
    affine = r.recipes.withColumn("seek_class", F.when(F.col("seek_class") == 1, 0).otherwise(2))
    return R.affine_carveout(affine, r.inputs, r.outputs, r.contents.where("resident AND node % 5 <> 0").select("node"))


_PATHS = "SELECT p_partkey AS node, 'dir' || CAST(p_size AS VARCHAR) || '/' || p_name AS path FROM part WHERE p_size < 20"


@query(
    f"{_WITH}, pat AS ({_PATHS}), lab AS (SELECT i.recipe AS recipe, i.position AS position, coalesce(regexp_replace(path, '^.*/', ''), substr(sha256(CAST(i.node AS VARCHAR)), 1, 8) || '…') AS label, resident FROM inp i JOIN con c ON c.node = i.node LEFT JOIN pat p ON p.node = i.node), "
    "joined AS (SELECT recipe, string_agg(label, ' + ' ORDER BY position) AS labels, bool_and(resident) AS here FROM lab GROUP BY recipe) "
    "SELECT o.node AS node, o.recipe AS recipe, CASE WHEN op = 'c0ffee#unpack' THEN 'unpack' ELSE split_part(op, '@', 1) END || ' ← ' || labels AS route, here AS source_present FROM outp o JOIN rec r ON r.recipe = o.recipe JOIN joined j ON j.recipe = o.recipe WHERE verify <> 2"
)
def readable_routes(spark, sf):
    r = Recipes(spark, sf)
    hashed = r.contents.withColumn("hash", F.sha2(F.col("node").cast("string"), 256))
    return R.readable_routes(r.recipes, r.inputs, r.outputs, hashed, fixture(spark, sf, _PATHS))


@query(f"{_WITH} SELECT o.node AS node, r.recipe AS recipe, op, verify, (SELECT count(*) FROM inp WHERE inp.recipe = r.recipe) AS n_inputs FROM outp o JOIN rec r ON r.recipe = o.recipe")
def recipe_lookup(spark, sf):
    """Every content's producers, with how many inputs each has."""
    r = Recipes(spark, sf)
    n = r.inputs.groupBy("recipe").agg(F.count(F.lit(1)).alias("n_inputs"))
    return R.producers(r.recipes, r.outputs).join(n, "recipe").select("node", "recipe", "op", "verify", "n_inputs")


@query(f"{_WITH}, uses AS (SELECT node, count(DISTINCT recipe) AS uses FROM inp GROUP BY node) SELECT inp.recipe AS recipe, inp.node AS node, size, uses FROM inp JOIN uses ON uses.node = inp.node JOIN con ON con.node = inp.node")
def rebuild_inputs(spark, sf):
    r = Recipes(spark, sf)
    return R.rebuild_inputs(r.inputs, r.outputs, r.contents)


_KNOWN = "SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS size, true AS resident FROM part WHERE p_retailprice < 1200"


@query(f"WITH known AS ({_KNOWN}), named AS ({_LINE}) SELECT node, size, resident FROM known UNION ALL SELECT DISTINCT node, CAST(NULL AS BIGINT), false FROM named WHERE recipe IN (SELECT recipe FROM ({_OUT}) o) AND node NOT IN (SELECT node FROM known)")
def index_recipes(spark, sf):
    """Contents after recipes were indexed: what they name and nobody knew is there without bytes."""
    r = Recipes(spark, sf)
    ins = r.inputs.groupBy("recipe").agg(F.array_sort(F.collect_list("node")).alias("inputs"))
    outs = r.outputs.select("recipe", F.array("node").alias("outputs"))
    return R.index_recipes(fixture(spark, sf, _KNOWN), ins.join(outs, "recipe"))[0]


_CHANGES = f"SELECT recipe, CAST(recipe % 7 % 4 AS INTEGER) AS verify FROM ({_OUT}) x WHERE recipe % 5 <> 0"
_LEGAL = "(a = 0 AND b IN (1, 2, 3)) OR (a = 1 AND b IN (2, 3)) OR (a = 3 AND b = 2)"


@query(f"{_WITH}, x AS (SELECT rec.recipe AS recipe, rec.verify AS a, c.verify AS b FROM rec LEFT JOIN ({_CHANGES}) c ON c.recipe = rec.recipe) SELECT recipe, CASE WHEN {_LEGAL} THEN b ELSE a END AS verify, b IS NOT NULL AND NOT ({_LEGAL}) AS refused FROM x")
def state_changes(spark, sf):
    """Verify states after changes, of which illegal ones are refused."""
    r = Recipes(spark, sf)
    after, refused = R.set_states(r.recipes, fixture(spark, sf, _CHANGES))
    return after.join(refused.select("recipe", F.lit(True).alias("refused")), "recipe", "left").select("recipe", "verify", F.coalesce("refused", F.lit(False)).alias("refused"))


_REPLAYS = "SELECT doc_id AS recipe, CAST(doc_id % 4 AS INTEGER) AS verify, sha256(text) AS claimed, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS rebuilt, CASE WHEN doc_id % 11 = 0 THEN 'no space' END AS error FROM documents"


@query(f"SELECT recipe, CASE WHEN verify = 2 THEN 2 WHEN rebuilt IS NULL THEN verify WHEN rebuilt <> claimed THEN 2 ELSE 3 END AS verify, CASE WHEN verify = 2 THEN 'was failed' WHEN rebuilt IS NULL THEN 'not replayed: no space' WHEN rebuilt <> claimed THEN 'claim failure' ELSE 'replayed' END AS note FROM ({_REPLAYS}) x")
def replay(spark, sf):
    """States after replays: right bytes license a recipe, wrong ones poison it, an error of the machine does neither."""
    return R.replayed(fixture(spark, sf, _REPLAYS))


@query(f"{_WITH} SELECT recipe, op FROM rec WHERE split_part(op, '#', 1) NOT IN ('c0ffee') OR op NOT LIKE '%#%'")
def quarantine(spark, sf):
    """Recipes that may serve ranges: none whose component is quarantined."""
    r = Recipes(spark, sf)
    named = r.recipes.withColumn("component", F.when(F.col("op").contains("#"), F.substring_index("op", "#", 1)))
    return R.not_quarantined(named, spark.createDataFrame([("c0ffee",), (None,)], "component string")).select("recipe", "op")


@query(f"{_WITH} SELECT node FROM con WHERE resident AND node NOT IN (SELECT outp.node FROM outp JOIN rec ON rec.recipe = outp.recipe WHERE verify <> 2)")
def underived_roots(spark, sf):
    r = Recipes(spark, sf)
    return R.roots(r.contents, r.recipes, r.outputs)


@query(
    f"{_WITH} SELECT 'plans' AS scope, recipe AS id FROM rec WHERE op = 'assemble@1' AND seek_class = 0 AND verify <> 2 UNION ALL SELECT 'roots', node FROM con WHERE resident AND node NOT IN (SELECT outp.node FROM outp JOIN rec ON rec.recipe = outp.recipe WHERE verify <> 2) "
    "UNION ALL SELECT DISTINCT 'peer outputs', node FROM outp WHERE recipe IN (SELECT recipe FROM rec WHERE source = 1)"
)
def reconcile_scopes(spark, sf):
    r = Recipes(spark, sf)
    return R.reconcile_scopes(r.contents, r.recipes, r.outputs)


@query(
    f"{_WITH}, aff AS (SELECT recipe FROM rec WHERE seek_class = 0 AND verify <> 2), own AS (SELECT i.recipe AS recipe, i.node AS node, size FROM inp i JOIN aff ON aff.recipe = i.recipe LEFT JOIN con ON con.node = i.node), uses AS (SELECT node, count(DISTINCT recipe) AS n FROM own GROUP BY node), "
    "good AS (SELECT recipe FROM own JOIN uses ON uses.node = own.node GROUP BY recipe HAVING count(*) = count(size) AND sum(size) > 0 AND sum(CASE WHEN n >= 2 THEN size ELSE 0 END) * 100 >= sum(size) * 50) "
    "SELECT min(o.recipe) AS recipe, o.node AS node, size AS freed FROM outp o JOIN good ON good.recipe = o.recipe JOIN con ON con.node = o.node WHERE resident GROUP BY o.node, size"
)
def swap_plan(spark, sf):
    r = Recipes(spark, sf)
    return R.swap_plan(r.recipes, r.inputs, r.outputs, r.contents)


_EDGES = "SELECT DISTINCT 2 * o_custkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity <= 3 AND l_linenumber = 1"
_HOPS = f"SELECT src AS a, dst AS b FROM ({_EDGES}) e WHERE src % 4 = 0 UNION SELECT dst, src FROM ({_EDGES}) e WHERE src % 4 <> 0"


@query(
    f"WITH RECURSIVE h AS ({_HOPS}), seed AS (SELECT a AS n FROM h GROUP BY a ORDER BY count(*) DESC, a LIMIT 1), down(node) AS (SELECT n FROM seed UNION SELECT b FROM down JOIN h ON node = a), up(node) AS (SELECT n FROM seed UNION SELECT a FROM up JOIN h ON node = b), "
    "both_ways AS (SELECT a, b FROM h UNION SELECT b, a FROM h), comp(node) AS (SELECT n FROM seed UNION SELECT b FROM comp JOIN both_ways ON node = a) "
    "SELECT node, CASE WHEN node IN (SELECT node FROM down) THEN 'makes' WHEN node IN (SELECT node FROM up) THEN 'derived-from' ELSE 'related' END AS relation FROM comp WHERE node <> (SELECT n FROM seed)"
)
def relations(spark, sf):
    """The component of the node with most edges: what it makes, what it derives from, what is only related."""
    hops = fixture(spark, sf, _HOPS)
    seed = hops.groupBy("a").count().orderBy(F.desc("count"), "a").first()["a"]
    return graph.relations(hops, F.lit(seed).cast("long"), "a", "b")


@query(
    f"WITH RECURSIVE h AS ({_HOPS}), seen(node) AS (SELECT min(a) FROM h UNION SELECT b FROM seen JOIN h ON node = a) SELECT DISTINCT a AS node FROM h WHERE a NOT IN (SELECT node FROM seen)"
)
def unreachable(spark, sf):
    """Nodes with an edge that the smallest node does not lead to."""
    hops = fixture(spark, sf, _HOPS)
    seen = graph.closure(hops, hops.agg(F.min("a").alias("root")), "a", "b").select("node")
    return hops.select(F.col("a").alias("node")).distinct().join(seen, "node", "left_anti")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 97 = 0 THEN 'remote' ELSE 'local' END AS side FROM orders WHERE (o_orderkey % 97 = 0) <> (o_orderkey % 89 = 0)")
def coded_symbols(spark, sf):
    """Reconcile two peers' keys by coded symbols: the decoded difference, with its side."""
    keys = fixture(spark, sf, "SELECT o_orderkey AS key FROM orders")
    return recon.reconcile(keys.where("key % 97 <> 0"), keys.where("key % 89 <> 0"), "key")


@query(f"{_WITH}, big AS (SELECT node, size FROM con WHERE resident AND size IS NOT NULL) SELECT node, size, (SELECT count(*) FROM big) AS total FROM big ORDER BY size DESC, node LIMIT 50 OFFSET 10")
def contents_page(spark, sf):
    """The second page of the resident contents by size, with the number of all."""
    r = Recipes(spark, sf)
    rows = r.contents.where("resident AND size IS NOT NULL").select("node", "size", (-F.col("size")).alias("o"))
    return state.page(rows, ["o", "node"], 50, 10).drop("o")


@query(f"SELECT DISTINCT 't' || c_custkey AS tag FROM customer WHERE c_acctbal < 0 AND CAST(c_custkey AS VARCHAR) IN (SELECT snapshot FROM ({_SNAPSHOTS}) s WHERE node = (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 1))")
def pins_of(spark, sf):
    """The tags that keep the content of most snapshots."""
    snapshots = fixture(spark, sf, _SNAPSHOTS)
    tags = fixture(spark, sf, "SELECT 't' || CAST(c_custkey AS VARCHAR) AS tag, CAST(c_custkey AS VARCHAR) AS snapshot FROM customer WHERE c_acctbal < 0")
    return R.pins_of(snapshots, tags, F.lit(snapshots.groupBy("node").count().orderBy(F.desc("count"), "node").first()["node"]))


@query(f"{_WITH} SELECT recipe, op, (SELECT count(DISTINCT node) FROM outp WHERE outp.recipe = rec.recipe) AS outputs FROM rec WHERE verify = 2")
def failed_recipes(spark, sf):
    r = Recipes(spark, sf)
    return R.failed(r.recipes, r.outputs)


@query(f"WITH RECURSIVE h AS ({_HOPS}), seen(node) AS (SELECT max(a) FROM h UNION SELECT b FROM seen JOIN h ON node = a) SELECT node FROM seen ORDER BY node LIMIT 10")
def reachable_page(spark, sf):
    """The first ten nodes that the greatest node leads to: the limit comes after the order, so it always cuts the same."""
    hops = fixture(spark, sf, _HOPS)
    return graph.closure(hops, hops.agg(F.max("a").alias("root")), "a", "b").select("node").orderBy("node").limit(10)


@query(f"{_WITH} SELECT CAST(sum(CASE WHEN resident THEN size END) AS BIGINT) AS on_disk, CAST(sum(size) AS BIGINT) AS represented, count(*) FILTER (WHERE size IS NULL) AS sizeless FROM con")
def storage_totals(spark, sf):
    return store.storage_totals(Recipes(spark, sf).contents)
