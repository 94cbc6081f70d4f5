"""Recipes: their index, verify states, routes, and what may be dropped because recipes can rebuild it.

Tables: recipes(recipe, op, verify, source, seek_class), inputs(recipe, position, node),
outputs(recipe, node), contents(node, size, resident). Nodes are contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import route_verb
from cairn.operators.selection import numbered
from cairn.plans.graph import grounded, grounded_without, reached
from cairn.session import cut

# Verify states, and the changes of state that are legal.
PENDING, VERIFIED, FAILED, REPLAYED = 0, 1, 2, 3
TRANSITIONS = ((PENDING, VERIFIED), (PENDING, REPLAYED), (PENDING, FAILED), (VERIFIED, REPLAYED), (VERIFIED, FAILED), (REPLAYED, FAILED))


# ---- the index


def index_recipes(contents: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents, inputs, outputs) after incoming(recipe, inputs array, outputs array): hashes not seen before become contents without bytes.

    A recipe names each input by its position; repeated outputs count once.
    """
    inputs = incoming.select("recipe", F.posexplode("inputs").alias("position", "node"))
    outputs = incoming.select("recipe", F.explode("outputs").alias("node")).distinct()
    unknown = inputs.select("node").union(outputs.select("node")).distinct().join(contents.select("node"), "node", "left_anti")
    absent = unknown.select("node", F.lit(None).cast("long").alias("size"), F.lit(False).alias("resident"))
    return contents.select("node", "size", "resident").unionByName(absent), inputs, outputs


def producers(recipes: DataFrame, outputs: DataFrame, node: Column | None = None) -> DataFrame:
    """Recipes with the content that each makes; of one content, or of all."""
    rows = outputs.join(recipes, "recipe")
    return rows if node is None else rows.where(F.col("node") == node)


def consumers(inputs: DataFrame) -> DataFrame:
    """(node, recipes): in how many recipes each content is an input."""
    return inputs.groupBy("node").agg(F.count_distinct("recipe").alias("recipes"))


def rebuild_inputs(inputs: DataFrame, outputs: DataFrame, contents: DataFrame) -> DataFrame:
    """(recipe, node, size, uses) for every input of a recipe that makes something: how many recipes share it."""
    rows = inputs.select("recipe", "node").distinct().join(outputs.select("recipe").distinct(), "recipe", "left_semi")
    return rows.join(consumers(inputs).withColumnRenamed("recipes", "uses"), "node").join(contents.select("node", "size"), "node").select("recipe", "node", "size", "uses")


# ---- verify states


def legal(before: Column, after: Column) -> Column:
    """May a recipe's verify state change so? Failed is final, and no state follows itself."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TRANSITIONS))
    return F.array_contains(pairs, F.struct(before.cast("int").alias("a"), after.cast("int").alias("b")))


def set_states(recipes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes, refused) after changes(recipe, verify); illegal ones change nothing and are listed with the state they met."""
    met = recipes.join(changes.select("recipe", F.col("verify").alias("wanted")), "recipe", "left")
    ok = F.col("wanted").isNotNull() & legal(F.col("verify"), F.col("wanted"))
    after = met.withColumn("verify", F.when(ok, F.col("wanted")).otherwise(F.col("verify"))).drop("wanted")
    return after, met.where(F.col("wanted").isNotNull() & ~legal(F.col("verify"), F.col("wanted"))).select("recipe", "verify", "wanted")


def rehabilitated(recipes: DataFrame, which: DataFrame) -> DataFrame:
    """Failed recipes that an operator takes back are pending again: the only way out of that state."""
    back = which.select("recipe").distinct().withColumn("__back", F.lit(True))
    return recipes.join(back, "recipe", "left").withColumn("verify", F.when((F.col("verify") == FAILED) & F.col("__back"), PENDING).otherwise(F.col("verify"))).drop("__back")


def replayed(claims: DataFrame) -> DataFrame:
    """(recipe, verify, note) from claims(recipe, verify, claimed, rebuilt, error): the state after a replay.

    Bytes that differ from the claim poison the recipe; an error of the environment (nothing rebuilt) changes nothing; the right bytes license it, whatever it was but failed.
    """
    wrong = F.col("rebuilt").isNotNull() & ~F.col("rebuilt").eqNullSafe(F.col("claimed"))
    after = F.when(F.col("verify") == FAILED, FAILED).when(wrong, FAILED).when(F.col("rebuilt").isNull(), F.col("verify")).otherwise(REPLAYED)
    note = F.when(F.col("verify") == FAILED, "was failed").when(wrong, "claim failure").when(F.col("rebuilt").isNull(), F.concat(F.lit("not replayed: "), F.coalesce("error", F.lit("unknown")))).otherwise("replayed")
    return claims.select("recipe", after.alias("verify"), note.alias("note"))


def not_quarantined(routes: DataFrame, quarantine: DataFrame, key: str = "component") -> DataFrame:
    """Routes whose component is not on the quarantine list; routes without a component stay."""
    return routes.join(quarantine.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


# ---- routes


def readable_routes(recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, contents: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, recipe, route, source_present) for every recipe that has not failed: "verb ← a + b".

    An input is named by the last part of the first of its paths(node, path), else by the first eight digits of its hash.
    """
    first = paths.groupBy("node").agg(F.min("path").alias("path"))
    named = inputs.join(contents.select("node", "hash", "resident"), "node").join(first, "node", "left")
    label = F.coalesce(F.substring_index("path", "/", -1), F.concat(F.substring("hash", 1, 8), F.lit("…")))
    ordered = F.sort_array(F.collect_list(F.struct("position", label.alias("label"))))  # a recipe's inputs
    of_recipe = named.groupBy("recipe").agg(F.array_join(F.transform(ordered, lambda x: x["label"]), " + ").alias("labels"), F.min(F.col("resident").cast("int")).alias("here"))
    rows = outputs.join(recipes.where(F.col("verify") != FAILED), "recipe").join(of_recipe, "recipe", "left")
    verb = route_verb(F.col("op"))
    return rows.select("node", "recipe", F.when(F.coalesce("labels", F.lit("")) == "", verb).otherwise(F.concat(verb, F.lit(" ← "), F.col("labels"))).alias("route"), (F.coalesce("here", F.lit(1)) == 1).alias("source_present"))


def best_seek_class(contents: DataFrame, routes: DataFrame) -> DataFrame:
    """(node, seek_class): 0 for resident contents, else the best of the routes(node, verify, seek_class) that have not failed, else 2 (opaque)."""
    best = routes.where(F.col("verify") != FAILED).groupBy("node").agg(F.min("seek_class").alias("best"))
    return contents.join(best, "node", "left").select("node", F.coalesce(F.when(F.col("resident"), 0), "best", F.lit(2)).alias("seek_class"))


def affine_carveout(recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, verified: DataFrame) -> DataFrame:
    """(node): contents that can be read in place. They are verified and resident, or made by a local, affine, verified assembly of such."""
    tight = recipes.where((F.substring_index("op", "@", 1) == "assemble") & (F.col("source") == 0) & (F.col("seek_class") == 0) & F.col("verify").isin(VERIFIED, REPLAYED))
    return grounded(tight, inputs, outputs, verified).select("node")


def fetch_walk(wants: DataFrame, recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, contents: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(node, outcome): what has to be fetched to hold the wanted contents, and what is supported.

    A resident content is supported. Another takes its first recipe (by id, not failed) none of whose inputs is being
    walked already, and walks these; without one it is fetched. Each content is settled once, in the order of
    the walk, so the result depends on that order where recipes form cycles.

    A content from which first recipes lead into no cycle always takes its first recipe: what is being walked above it
    would have to be among its own inputs. So where first recipes lead into no cycle the walk is a closure over them, of any
    size. Only contents that lead into one are walked one by one on the driver, with all their recipes; more
    than ``most`` rows of these are an error.
    """
    usable = recipes.where(F.col("verify") != FAILED).select("recipe")
    made = outputs.join(usable, "recipe", "left_semi").select("recipe", "node")
    absent = cut(made.join(contents.where("resident").select("node"), "node", "left_anti").select("recipe", "node"))
    firsts = cut(absent.where("node IS NOT NULL").groupBy("node").agg(F.min("recipe").alias("recipe")))
    # distinct after the join: of first recipes only
    used = inputs.select("recipe", F.col("node").alias("input")).where("input IS NOT NULL")
    steps = cut(firsts.join(used, "recipe").select("recipe", "node", "input").distinct())
    asked = cut(wants.select(F.col(wants.columns[0]).alias("node")).where("node IS NOT NULL").distinct())
    near = cut(reached(steps, asked, "node", "input"))
    loose = _cyclic(steps.join(near, "node", "left_semi"), firsts.join(near, "node", "left_semi"))
    if loose is not None:
        walked, exits = _walk_cycles(asked, loose, steps, firsts, absent, inputs, contents, most)
        near = cut(reached(steps.join(walked, "node", "left_anti"), exits, "node", "input").unionByName(walked.select("node")).distinct())
    here = contents.where("resident").select("node").distinct().withColumn("here", F.lit(True))
    told = near.join(here, "node", "left").join(firsts.select("node", F.lit(True).alias("made")), "node", "left")
    outcome = F.when(F.coalesce("here", "made", F.lit(False)), "supported").otherwise("fetch")
    if loose is None:
        return cut(told.select("node", outcome.alias("outcome")))
    return cut(told.join(walked, "node", "left").select("node", F.coalesce("outcome", outcome).alias("outcome")))


def _cyclic(steps: DataFrame, firsts: DataFrame) -> DataFrame | None:
    """(node): contents from which steps(recipe, node, input) of firsts(recipe, node) lead into a cycle; None where there are none."""
    ways = steps.agg(F.count_if(F.col("input") >= F.col("node")).alias("up"), F.count_if(F.col("input") <= F.col("node")).alias("down")).first()
    if not ways["up"] or not ways["down"]:  # every step leads the same way along the order of contents
        return None
    leaves = steps.select(F.col("input").alias("node")).distinct().join(firsts, "node", "left_anti")
    free = grounded(firsts.select("recipe"), steps.select("recipe", F.col("input").alias("node")), firsts, leaves)
    loose = cut(firsts.select("node").join(free, "node", "left_anti"))
    return None if loose.isEmpty() else loose


def _walk_cycles(asked: DataFrame, loose: DataFrame, steps: DataFrame, firsts: DataFrame, absent: DataFrame, inputs: DataFrame, contents: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Walk what may lead into a cycle on the driver: (node, outcome) of it, and (node), the other contents that the walk enters.

    Such contents may take another recipe than their first, so all that they reach by any recipe counts.
    """
    absent = absent.distinct()
    hops = absent.join(inputs.select("recipe", F.col("node").alias("input")).distinct(), "recipe")
    near = cut(reached(hops, asked, "node", "input"))
    loose = _cyclic(steps.join(near, "node", "left_semi"), firsts.join(near, "node", "left_semi"))
    edges = cut(loose.join(absent, "node").join(inputs.select("recipe", "position", F.col("node").alias("input")), "recipe", "left").select("node", "recipe", "position", "input"))
    if edges.count() + loose.count() > most:
        raise RuntimeError("the walk reaches too many contents in or above cycles")
    routes: dict = {}
    for r in edges.orderBy("node", "recipe", "position").collect():
        of_recipe = routes.setdefault(r["node"], {}).setdefault(r["recipe"], [])
        if r["input"] is not None:
            of_recipe.append(r["input"])
    settled: dict = {}
    outside = {n for ins in routes.values() for used in ins.values() for n in used} - routes.keys()
    # wants outside need no place in the order: what they walk leads into no cycle
    for want in sorted(r[0] for r in asked.join(loose, "node", "left_semi").collect()):
        _walk(want, outside, routes, settled)
    node = f"node {loose.schema['node'].dataType.simpleString()}"
    spark = loose.sparkSession
    walked = spark.createDataFrame(sorted((n, o) for n, o in settled.items() if n in routes), f"{node}, outcome string")
    entered = spark.createDataFrame(sorted((n,) for n in settled if n not in routes), node)
    return cut(walked), cut(entered.union(asked.join(loose, "node", "left_anti")).distinct())


def _walk(start, here: set, routes: dict, settled: dict) -> None:
    path: dict = {}  # contents being walked, with the inputs still to do
    todo = [start]
    while todo:
        node = todo[-1]
        if node in path:
            if path[node]:
                nearest = path[node].pop(0)
                if nearest not in settled and nearest not in path:
                    todo.append(nearest)
            else:
                del path[node]
                settled[node] = "supported"
                todo.pop()
            continue
        if node in settled:
            todo.pop()
            continue
        if node in here:
            settled[node] = "supported"
            todo.pop()
            continue
        route = next((ins for _, ins in sorted(routes.get(node, {}).items()) if node not in ins and not any(i in path for i in ins)), None)
        if route is None:
            settled[node] = "fetch"
            todo.pop()
        else:
            path[node] = list(route)


def sync_savings(walk: DataFrame, contents: DataFrame, wants: DataFrame) -> DataFrame:
    """One row: bytes wanted, bytes to fetch, and the share of the wanted bytes that need not be fetched, in percent."""
    sized = walk.join(contents.select("node", "size", "resident"), "node", "left")
    fetched = sized.agg(F.coalesce(F.sum(F.when(F.col("outcome") == "fetch", F.col("size"))), F.lit(0)).alias("fetched"), F.count_if(F.col("outcome") == "fetch").alias("n_fetched"))
    wanted = wants.select(F.col(wants.columns[0]).alias("node")).distinct().join(contents, "node").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("wanted"))
    both = fetched.crossJoin(wanted)  # one row each
    return both.select("wanted", "fetched", "n_fetched", F.when(F.col("wanted") > 0, F.floor(F.greatest(F.col("wanted") - F.col("fetched"), F.lit(0)) * 100 / F.col("wanted"))).otherwise(0).cast("long").alias("savings_pct"))


# ---- eviction


def pinned(snapshots: DataFrame, tags: DataFrame, image_inputs: DataFrame | None = None) -> DataFrame:
    """(node): contents that tagged snapshots(snapshot, node) serve, and the inputs of tagged images(snapshot, node)."""
    rows = snapshots.select("snapshot", "node")
    if image_inputs is not None:
        rows = rows.unionByName(image_inputs.select("snapshot", "node"))
    return rows.join(tags.select("snapshot").distinct(), "snapshot", "left_semi").select("node").distinct()


def pins_of(snapshots: DataFrame, tags: DataFrame, node: Column) -> DataFrame:
    """(tag): the tags(tag, snapshot) whose snapshot serves a content."""
    serving = snapshots.where(F.col("node") == node).select("snapshot").distinct()
    return tags.join(serving, "snapshot", "left_semi").select("tag").distinct()


def failed(recipes: DataFrame, outputs: DataFrame) -> DataFrame:
    """(recipe, op, outputs): recipes that a replay has poisoned, with how many contents they claim to make."""
    n = outputs.groupBy("recipe").agg(F.count_distinct("node").alias("outputs"))
    return recipes.where(F.col("verify") == FAILED).join(n, "recipe", "left").select("recipe", "op", F.coalesce("outputs", F.lit(0)).cast("long").alias("outputs"))


def missing_inputs(image_inputs: DataFrame, contents: DataFrame) -> DataFrame:
    """(node): distinct inputs of images whose bytes are not here."""
    return image_inputs.select("node").distinct().join(contents.where("resident").select("node"), "node", "left_anti")


def eviction_order(recipes: DataFrame, outputs: DataFrame, contents: DataFrame) -> DataFrame:
    """(node, size, seek_class): resident contents with a replayed recipe, by best seek class, then largest, then node: the policy's order."""
    best = outputs.join(recipes.where(F.col("verify") == REPLAYED), "recipe").groupBy("node").agg(F.min("seek_class").alias("seek_class"))
    return contents.where("resident").join(best, "node").select("node", "size", "seek_class").orderBy("seek_class", F.desc_nulls_last("size"), "node")


def license_pool(recipes: DataFrame, outputs: DataFrame, contents: DataFrame) -> DataFrame:
    """(node, size): resident contents with a verified recipe that a replay here could license, largest first."""
    candidates = outputs.join(recipes.where(F.col("verify") == VERIFIED), "recipe").select("node").distinct()
    return contents.where("resident").join(candidates, "node", "left_semi").select("node", "size").orderBy(F.desc_nulls_last("size"), "node")


def evict_plan(recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, contents: DataFrame, protected: DataFrame, target: int) -> DataFrame:
    """(node, size, place): the contents to drop, in policy order, until resident bytes are at most ``target``.

    Greedy and exact: a content is dropped if it is not protected and, with all drops before it, still grounded by what
    remains. Contents that are not grounded without themselves can never be dropped, since drops only take support
    away; one batched fixpoint finds them. The others are tried in runs of the order: if all of a run are
    grounded when the whole run is gone, each was when its turn came; else the run is halved. So the number of
    fixpoints follows the number of contents that other drops strand, not the number of contents.
    """
    trusted = cut(recipes.where(F.col("verify") == REPLAYED).select("recipe"))
    resident = cut(contents.where("resident").select("node", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    seeds = resident.select("node")
    spare = (resident.agg(F.sum("size")).first()[0] or 0) - target
    order = eviction_order(recipes, outputs, contents).join(protected.select("node"), "node", "left_anti")
    empty = resident.limit(0).withColumn("place", F.lit(0).cast("long"))
    if spare <= 0:
        return empty
    found = cut(grounded(trusted, inputs, outputs, seeds))
    alone = grounded_without(found, trusted, inputs, outputs, seeds, order.select("node")).where("held").select("node")
    ranked = numbered(order.join(alone, "node", "left_semi").withColumn("size", F.coalesce("size", F.lit(0)).cast("long")), [F.asc("seek_class"), F.desc("size"), F.asc("node")], "place")
    ranked = cut(ranked.select("node", "size", F.col("place").cast("long").alias("place")))
    dropped = empty

    def freed() -> int:
        return dropped.agg(F.sum("size")).first()[0] or 0

    todo = [(1, ranked.count())]
    while todo and freed() < spare:
        low, high = todo.pop()
        if low > high:
            continue
        run = ranked.where(F.col("place").between(low, high))
        gone = dropped.select("node").union(run.select("node"))
        left = grounded(trusted, inputs, outputs, seeds.join(gone, "node", "left_anti")).select("node")
        if run.join(left, "node", "left_anti").isEmpty():
            dropped = cut(dropped.unionByName(run))
        elif low < high:
            half = (low + high) // 2
            todo += [(half + 1, high), (low, half)]
    # of the drops only as many, in order, as the target needs
    return _first_bytes(dropped, spare)


def _first_bytes(dropped: DataFrame, spare: int) -> DataFrame:
    from cairn.operators.selection import within_budget

    return cut(within_budget(dropped, "size", ["place"], spare).select("node", "size", "place"))


def why_blocked(recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, contents: DataFrame, protected: DataFrame, found: DataFrame, evictable: DataFrame) -> DataFrame:
    """(node, recipe, reason) for every content: why its bytes cannot go, recipe by recipe; recipe is null where one reason holds for all.

    ``found``: contents grounded by replayed recipes; ``evictable``: (node, held) of grounded_without().
    """
    marks = contents.join(protected.select("node").distinct().withColumn("pin", F.lit(True)), "node", "left").join(evictable.select("node", "held"), "node", "left")
    some = outputs.select("node").distinct().withColumn("made", F.lit(True))
    marks = marks.join(some, "node", "left")
    general = F.when(~F.col("resident"), "not resident").when(F.col("pin"), "pinned").when(F.col("made").isNull(), "no recipe").when(F.col("held"), "evictable")
    marks = cut(marks.select("node", general.alias("reason")))
    lost = inputs.join(found.select("node"), "node", "left_anti").select("recipe").distinct().withColumn("lost", F.lit(True))
    rows = marks.where("reason IS NULL").select("node").join(outputs, "node").join(recipes.select("recipe", "verify"), "recipe").join(lost, "recipe", "left")
    special = F.when(F.col("verify") == FAILED, "poisoned").when(F.col("verify") == VERIFIED, "not licensed yet").when(F.col("verify") == PENDING, "never verified").when(F.col("lost"), "inputs cannot be rebuilt").otherwise("breaks its own grounding")
    return marks.where("reason IS NOT NULL").select("node", F.lit(None).cast(recipes.schema["recipe"].dataType).alias("recipe"), "reason").unionByName(rows.select("node", "recipe", special.alias("reason")))


def roots(contents: DataFrame, recipes: DataFrame, outputs: DataFrame) -> DataFrame:
    """(node): resident contents that no recipe makes, failed ones aside."""
    made = outputs.join(recipes.where(F.col("verify") != FAILED), "recipe", "left_semi").select("node")
    return contents.where("resident").select("node").join(made, "node", "left_anti")


def reconcile_scopes(contents: DataFrame, recipes: DataFrame, outputs: DataFrame) -> DataFrame:
    """(scope, id): what a peer offers: affine assembly recipes, underived contents, and the outputs of recipes that came from peers."""
    plans = recipes.where((F.substring_index("op", "@", 1) == "assemble") & (F.col("seek_class") == 0) & (F.col("verify") != FAILED))
    foreign = outputs.join(recipes.where(F.col("source") == 1), "recipe", "left_semi")
    one = lambda name, rows, key: rows.select(F.lit(name).alias("scope"), F.col(key).alias("id")).distinct()
    return one("plans", plans, "recipe").unionByName(one("roots", roots(contents, recipes, outputs), "node")).unionByName(one("peer outputs", foreign, "node"))


def swap_plan(recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, contents: DataFrame, percent: int = 50) -> DataFrame:
    """(recipe, node, freed): contents to replace by their pieces, one recipe each: the smallest whose inputs are shared enough.

    Only affine recipes count; ``freed`` is the content's size, and the pieces are those that store.pack_sets() packs.
    """
    from cairn.operators.store import sharing

    affine = recipes.where((F.col("seek_class") == 0) & (F.col("verify") != FAILED)).select("recipe")
    own = inputs.join(affine, "recipe", "left_semi").join(contents.select("node", "size"), "node", "left")
    good = sharing(own.select("recipe", F.col("node").alias("blob"), "size"), percent)
    chosen = outputs.join(good.select("recipe"), "recipe", "left_semi").groupBy("node").agg(F.min("recipe").alias("recipe"))
    return chosen.join(contents.where("resident").select("node", "size"), "node").select("recipe", "node", F.col("size").alias("freed"))
