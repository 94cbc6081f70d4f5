"""Fixpoint loops over edge tables: components, closures and AND/OR reachability.

Every loop is a driver-side sequence of DataFrame rounds that ends when a round adds
nothing; no number of rounds is set. Only row counts, observed by the writes
themselves, reach the driver; vertex and edge sets stay distributed. Lineage is cut by
tables in the shared folder, and a round's tables are removed once nothing reads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import counted, cut, release

#: A growing set is kept as so many tables at most before they are merged into one.
PIECES = 12
#: Rows of a loop's table that one task writes.
ROWS_A_FILE = 100_000


class Found:
    """A set that grows by one table a round; merged now and then, so no round rewrites all of it."""

    def __init__(self, first: DataFrame):
        self.pieces = [first]

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.pieces)

    def add(self, more: DataFrame, keep: DataFrame | None = None) -> None:
        self.pieces.append(more)
        if len(self.pieces) > PIECES:
            old, self.pieces = self.pieces, [cut(self.table())]
            release(*(p for p in old if p is not keep))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every vertex of an undirected edge table with the smallest vertex of its component.

    Contracting min-label rounds: each vertex points at the smallest vertex in its
    closed neighbourhood, pointers are jumped to their roots, and edges are
    rewritten between roots. Each round at least halves the vertices of every
    unfinished component, so a path of n vertices needs about log2(n) rounds, and
    a round about log2(n) jumps. The smallest vertex never points elsewhere, so it labels its component.
    Aggregations are partial before they shuffle, so a hub vertex costs one row
    per task and not one row per edge. Self loops and null endpoints are ignored,
    except that a self loop registers its vertex.

    Returns (node, component), one row per vertex seen.
    """
    base, n = counted(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct())
    few = -(-n // ROWS_A_FILE)  # no later table is larger than the first
    labels = base.select(F.col("u").alias("node")).union(base.select("v")).distinct().withColumn("component", F.col("node"))
    live, old = base.where("u <> v"), []
    while n:
        parent = cut(fewer(live.union(live.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), few))
        moved = 1
        while moved:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).cast("int").alias("moved"))
            old.append(parent)
            parent, moved = moving(fewer(jumped, few))
        a = parent.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = parent.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        old += [live]
        live, n = counted(fewer(live.join(a, "u").join(b, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), few))
        to = parent.select(F.col("node").alias("component"), "root")
        labels = labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        release(*(t for t in old if t is not base))
        old = []
    return cut(labels)


def fewer(df: DataFrame, files: int) -> DataFrame:
    """Written as ``files`` files at most: small tables of a loop in few, so that the next round starts few tasks."""
    return df.coalesce(max(1, files)) if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def moving(jumped: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) written, and how many pointers moved."""
    from pyspark.sql import Observation

    seen = Observation()
    out = cut(jumped.observe(seen, F.coalesce(F.sum("moved"), F.lit(0)).alias("n")).select("node", "root"))
    return out, int(seen.get["n"])


def doubled(hops: DataFrame, n: int, least: float = 0.5, most: float = 2.0) -> list[DataFrame]:
    """Hop tables of 1, 2, 4, ... steps, for as long as they are about as large as the first.

    On long chains that covers any length in a few tables; on graphs that branch, or are shallow, it ends after the first.
    """
    out, size = [hops], n
    while size and len(out) < 40:
        last = out[-1]
        step = last.join(last.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")).where("node <> next").distinct()
        table, size = counted(step)
        if not least * n <= size <= most * n:
            release(table)
            break
        out.append(table)
    return out


def closure(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(root, node) pairs reachable along directed edges from every seed root, itself included.

    ``seeds`` has one column, root. A frontier loop: each round joins only the
    pairs found in the last one, so work follows the result's size. Where hops can be doubled (long
    chains), a round takes all their doublings.
    """
    hops, n = counted(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node IS NOT NULL AND next IS NOT NULL AND node <> next").distinct())
    frontier, size = counted(seeds.select(F.col(seeds.columns[0]).alias("root")).where("root IS NOT NULL").distinct().withColumn("node", F.col("root")))
    found, tables = Found(frontier), doubled(hops, n)
    while size:
        step = frontier.join(hops, "node").select("root", F.col("next").alias("node"))
        for table in tables[1:]:
            step = cut(step.union(step.join(table, "node").select("root", F.col("next").alias("node"))).distinct())
        frontier, size = counted(step.distinct().join(found.table(), ["root", "node"], "left_anti"))
        found.add(frontier, frontier)
    return found.table()


def reached(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node): what directed edges lead to from any of the seeds (one column), the seeds included.

    closure() for all seeds together: a node counts once, whatever the number of seeds that lead to it.
    """
    hops, n = counted(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node IS NOT NULL AND next IS NOT NULL AND node <> next").distinct())
    frontier, size = counted(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL").distinct())
    found, tables = Found(frontier), doubled(hops, n)
    while size:
        step = frontier.join(hops, "node").select(F.col("next").alias("node"))
        for table in tables[1:]:
            step = cut(step.union(step.join(table, "node").select(F.col("next").alias("node"))).distinct())
        frontier, size = counted(step.distinct().join(found.table(), "node", "left_anti"))
        found.add(frontier, frontier)
    return found.table()


def trusted(mode: str, verify: Column, source: Column) -> Column:
    """Recipes that count in a trust mode, by their verify state and where they come from."""
    # Verify states (1 verified, 3 replayed here) and sources (0 local) that each mode accepts.
    modes = {"eviction": verify == 3, "audit-verified": (verify == 3) | ((verify == 1) & (source == 0)), "audit-claimed": verify.isin(1, 3)}
    return F.coalesce(modes[mode], F.lit(False))


def grounded(recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, seeds: DataFrame) -> DataFrame:
    """AND/OR fixpoint: nodes that are seeds or outputs of a recipe all of whose inputs are grounded.

    recipes(recipe), inputs(recipe, node), outputs(recipe, node), seeds(node). A
    recipe without inputs fires at once. Each round counts down, per recipe, the inputs that
    became grounded in the round before, instead of testing all inputs again.
    Returns (node, round), round 0 for seeds.
    """
    live = recipes.select("recipe").distinct()
    needs = cut(inputs.select("recipe", "node").distinct().join(live, "recipe", "left_semi"))
    makes = cut(outputs.select("recipe", "node").distinct().join(live, "recipe", "left_semi"))
    # inputs still missing per recipe
    waiting = cut(live.join(needs.groupBy("recipe").agg(F.count(F.lit(1)).alias("missing")), "recipe", "left").fillna(0, ["missing"]))
    fresh, _ = counted(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("round", F.lit(0)))
    found, fired = Found(fresh), waiting.where("missing = 0").select("recipe")
    number, size = 0, 1
    while size:
        number += 1
        paid = fresh.join(needs, "node").groupBy("recipe").agg(F.count(F.lit(1)).alias("paid"))
        # recipes that have fired leave the table
        left = cut(waiting.where("missing > 0").join(paid, "recipe", "left").select("recipe", (F.col("missing") - F.coalesce("paid", F.lit(0))).alias("missing")))
        done = left.where("missing = 0").select("recipe")
        fired = fired.union(done) if number == 1 else done
        fresh, size = counted(makes.join(fired, "recipe").select("node").distinct().join(found.table(), "node", "left_anti").withColumn("round", F.lit(number)))
        release(waiting)
        waiting = left
        found.add(fresh, fresh)
    return found.table()


def grounded_without(found: DataFrame, recipes: DataFrame, inputs: DataFrame, outputs: DataFrame, seeds: DataFrame, tests: DataFrame) -> DataFrame:
    """(node, held): for every tested seed, whether it is still grounded when its own seed is gone. All in one batch.

    ``found`` is grounded()'s result with all seeds. Every derived node keeps one derivation (its witness). Without a seed,
    only the nodes whose own derivation rests on it can fall; all others stand. So what is taken out for a seed is what it leads to
    along witnesses, and not all that it leads to through any recipe. Seeds with a recipe that none of that is an input
    of are held; for the others, what was taken out is put back recipe by recipe.
    """
    found = cut(found.select("node", "round"))
    usable = recipes.select("recipe").distinct()
    needs = cut(inputs.select("recipe", "node").distinct().join(usable, "recipe", "left_semi"))
    blocked = needs.join(found.select("node"), "node", "left_anti").select("recipe").distinct()
    live = cut(usable.join(blocked, "recipe", "left_anti"))
    needs, makes = cut(needs.join(live, "recipe", "left_semi")), cut(outputs.select("recipe", "node").distinct().join(live, "recipe", "left_semi"))
    own = seeds.select("node").distinct()
    asked = cut(tests.select("node").distinct().join(own, "node", "left_semi"))
    by = witnesses(found, needs, makes)
    step = cut(needs.join(by.withColumnRenamed("node", "dst"), "recipe").select(F.col("node").alias("src"), "dst").distinct())
    could = asked.join(makes.select("node").distinct(), "node", "left_semi")  # the others have no recipe that could put them back
    down = cut(closure(step, could).withColumnRenamed("root", "test"))
    # at once: recipes of the tested seed itself, none of whose inputs fell
    first = cut(could.join(makes, "node").select(F.col("node").alias("test"), "recipe"))
    broken = first.join(needs, "recipe").join(down, ["test", "node"], "left_semi").select("test", "recipe").distinct()
    sure = cut(first.join(broken, ["test", "recipe"], "left_anti").select("test").distinct())
    down = cut(down.join(sure, "test", "left_anti"))
    # recipes that could put something back, with the fallen inputs that they wait for
    makers = down.join(makes, "node").select("test", "recipe", F.col("node").alias("made")).distinct()
    open_inputs = makers.select("test", "recipe").distinct().join(needs, "recipe").join(down, ["test", "node"]).select("test", "recipe", "node")
    waits = cut(open_inputs)
    missing = makers.select("test", "recipe").distinct().join(waits.groupBy("test", "recipe").agg(F.count(F.lit(1)).alias("missing")), ["test", "recipe"], "left").fillna(0, ["missing"])
    missing, makers = cut(missing), cut(makers)
    fired = missing.where("missing = 0").select("test", "recipe")
    back, size = counted(makers.join(fired, ["test", "recipe"]).select("test", F.col("made").alias("node")).distinct())
    held = Found(back)
    while size:
        paid = back.join(waits, ["test", "node"]).groupBy("test", "recipe").agg(F.count(F.lit(1)).alias("paid"))
        left = cut(missing.where("missing > 0").join(paid, ["test", "recipe"], "left").select("test", "recipe", (F.col("missing") - F.coalesce("paid", F.lit(0))).alias("missing")))
        back, size = counted(makers.join(left.where("missing = 0"), ["test", "recipe"]).select("test", F.col("made").alias("node")).distinct().join(held.table(), ["test", "node"], "left_anti"))
        release(missing)
        missing = left
        held.add(back, back)
    again = held.table().where("test = node").select("node").union(sure).withColumn("held", F.lit(True))
    return asked.join(again, "node", "left").select("node", F.coalesce("held", F.lit(False)).alias("held"))


def chain_top(parents: DataFrame, max_doublings: int = 5) -> DataFrame:
    """(node, top): the end of each node's chain of parents, by pointer jumping; over 2^max_doublings hops (32, the rule of catalogs) is an error.

    parents(node, parent), parent null at a top.
    """
    jump = cut(parents.select("node", F.coalesce("parent", "node").alias("top")))
    for _ in range(max_doublings + 1):
        up = jump.select(F.col("node").alias("top"), F.col("top").alias("above"))
        then = jump.join(up, "top", "left").select("node", F.coalesce("above", "top").alias("root"), (F.coalesce("above", "top") != F.col("top")).cast("int").alias("moved"))
        old, (jump, moved) = jump, moving(then)
        release(old)
        jump = jump.withColumnRenamed("root", "top")
        if not moved:
            return jump
    raise RuntimeError("parent chain is too long or has a cycle")


def witnesses(found: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(node, recipe): a derivation that is free of cycles, the smallest recipe that could first make each derived node.

    ``found`` is grounded()'s result. A recipe is ready in the round after its last
    input; a node's witness is ready by the round in which the node was found.
    """
    ready = inputs.join(found.select("node", F.col("round").alias("at")), "node", "left").groupBy("recipe").agg(F.max("at").alias("at"), F.count_if(F.col("at").isNull()).alias("open")).where("open = 0")
    made = outputs.join(ready.select("recipe", "at"), "recipe", "left").join(inputs.select("recipe").distinct().withColumn("needs", F.lit(True)), "recipe", "left")
    usable = made.where("needs IS NULL OR at IS NOT NULL").select("recipe", "node", F.coalesce("at", F.lit(-1)).alias("at"))
    return usable.join(found.where("round > 0"), "node").where("at < round").groupBy("node").agg(F.min("recipe").alias("recipe"))


def relations(edges: DataFrame, seed: Column, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, relation) for a seed's whole component: what the seed makes, what it derives from, and what is only related."""
    own = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    start = own.sparkSession.range(1).select(seed.alias("root"))
    down = closure(own, start).select("node").withColumn("down", F.lit(True))
    up = closure(own, start, "dst", "src").select("node").withColumn("up", F.lit(True))
    whole = closure(own.union(own.select("dst", "src")), start)
    named = whole.where("node <> root").join(down, "node", "left").join(up, "node", "left")
    return named.select("node", F.when(F.col("down"), "makes").when(F.col("up"), "derived-from").otherwise("related").alias("relation"))
