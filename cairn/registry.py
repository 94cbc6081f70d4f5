"""Every query of the library: name -> (spark, sf_dir) -> DataFrame, and its SQL for comparison.

The driver tables stand in for catalog tables: orders are entries and lineitems their
claims; parts are contents; customers and parts make lineage edges; events are a work
queue; pages give paths; conversations give segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import audit, byteops, diff, identity, layout, queue, recipes, selection, store
from cairn.plans import graph
from cairn.registered import ORACLES, QUERIES, query
from cairn.session import table as t

# ---------------------------------------------------------------- audit

_STATE = "CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END"
_ROLL_SQL = f"""states AS (SELECT p_partkey AS ident, {_STATE} AS state FROM part WHERE p_partkey % 13 <> 0),
roll AS (SELECT l_orderkey AS entry, count(*) AS required,
  count(*) FILTER (WHERE coalesce(state,0)=4) AS have_verified, count(*) FILTER (WHERE coalesce(state,0)=1) AS have_claimed,
  count(*) FILTER (WHERE coalesce(state,0)=2) AS peer_avail, count(*) FILTER (WHERE coalesce(state,0)=3) AS probable,
  count(*) FILTER (WHERE coalesce(state,0) IN (0,3)) AS missing
  FROM lineitem LEFT JOIN states ON l_partkey = ident WHERE l_returnflag <> 'A' AND NOT (l_linestatus = 'F' AND l_linenumber > 5) GROUP BY l_orderkey)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("identity"), F.expr(_STATE).alias("state"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("identity"), F.col("l_returnflag").alias("status"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 5)).alias("optional"))


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.entry_rollup(_claims(spark, sf), _states(spark, sf), C.required(F.col("status"), F.col("optional"), "A"))


@query(f"WITH {_ROLL_SQL} SELECT o_orderkey AS entry, coalesce(required,0) AS required, coalesce(have_verified,0) AS have_verified, coalesce(have_claimed,0) AS have_claimed, coalesce(peer_avail,0) AS peer_avail, coalesce(probable,0) AS probable, coalesce(missing,0) AS missing, CASE WHEN required IS NULL OR required = 0 THEN 3 WHEN missing > 0 THEN 2 WHEN have_claimed > 0 THEN 1 ELSE 0 END AS state FROM orders LEFT JOIN roll ON o_orderkey = entry")
def audit_rollup(spark, sf):
    entries = t(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"))
    return audit.with_entry_state(entries, _rollup(spark, sf)).fillna(0)


@query(f"WITH {_ROLL_SQL} SELECT count(*) AS entries, count(*) FILTER (WHERE missing = 0) AS complete, CAST(sum(have_verified) AS BIGINT) AS verified, CAST(sum(probable) AS BIGINT) AS probable, CAST(sum(greatest(missing - probable, 0)) AS BIGINT) AS missing, CAST(sum(have_claimed) AS BIGINT) AS claimed, CAST(sum(peer_avail) AS BIGINT) AS peer FROM roll")
def audit_report_totals(spark, sf):
    return audit.totals(_rollup(spark, sf))


@query(f"WITH {_ROLL_SQL}, st AS (SELECT o_orderpriority, CASE WHEN required IS NULL OR required = 0 THEN 3 WHEN missing > 0 THEN 2 WHEN have_claimed > 0 THEN 1 ELSE 0 END AS state FROM orders LEFT JOIN roll ON o_orderkey = entry) SELECT o_orderpriority, count(*) AS entries, count(*) FILTER (WHERE state=0) AS verified, count(*) FILTER (WHERE state=1) AS claimed, count(*) FILTER (WHERE state=2) AS missing, count(*) FILTER (WHERE state=3) AS nodump FROM st GROUP BY o_orderpriority")
def state_histogram(spark, sf):
    entries = t(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"), "o_orderpriority")
    return audit.state_histogram(audit.with_entry_state(entries, _rollup(spark, sf)), "o_orderpriority")


@query("""SELECT l_partkey AS identity, max(CASE WHEN l_linenumber >= 2 AND (l_linestatus='O' OR l_returnflag='R') THEN 4 WHEN l_linenumber >= 2 AND l_returnflag='A' THEN 3 WHEN l_suppkey % 10 = 0 THEN 2 WHEN l_linenumber < 2 AND (l_linestatus='O' OR l_returnflag='R') THEN 1 ELSE 0 END) AS state FROM lineitem GROUP BY l_partkey""")
def identity_states(spark, sf):
    links = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("identity"), (F.col("l_linenumber") - 1).alias("basis"), (F.col("l_linestatus") == "O").alias("resident"), (F.col("l_returnflag") == "R").alias("grounded_verified"), (F.col("l_returnflag") == "A").alias("grounded_claimed"), F.col("l_suppkey").alias("blob"))
    peers = t(spark, sf, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("blob"))
    return audit.identity_status(links, peers)


@query("SELECT o_orderkey AS entry, coalesce(CASE WHEN count(*) = count(nullif(l_linenumber, 7)) THEN CAST(sum(l_linenumber) AS BIGINT) END, -1) AS size, CASE WHEN count(*) = 1 THEN max(CASE WHEN l_returnflag = 'R' THEN 'sha256:' || l_partkey ELSE 'crc32:' || l_partkey END) END AS wanted FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' GROUP BY o_orderkey")
def size_and_wanted(spark, sf):
    rows = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_returnflag <> 'N'")
    size = C.size_or_null(F.expr("nullif(l_linenumber, 7)")).cast("long")
    part, none = F.col("l_partkey").cast("string"), F.lit(None).cast("string")
    wanted = C.wanted_digest(F.when(F.col("l_returnflag") == "R", part), none, none, part)
    return rows.groupBy(F.col("o_orderkey").alias("entry")).agg(F.coalesce(size, F.lit(-1)).alias("size"), C.only_one(wanted).alias("wanted"))


# ---------------------------------------------------------------- joins and anti joins

_REFERENCED = ("l_quantity > 49", "l_discount < 0.005 AND l_tax > 0.06", "l_linenumber = 7 AND l_quantity > 40", "l_returnflag = 'A' AND l_quantity < 5", "l_tax > 0.079 AND l_linenumber = 1", "l_quantity < 2 AND l_linenumber = 2", "l_suppkey = 7")

@query("SELECT r_name, n_name, min(l_partkey) AS first_part, max(l_suppkey) AS last_supp, count(*) AS n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE o_orderstatus='F' GROUP BY r_name, n_name")
def held_core_join(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.min("l_partkey").alias("first_part"), F.max("l_suppkey").alias("last_supp"), F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id AS doc_id, coalesce(quality, -1) AS quality, quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def missing_left(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("quality").isNull().alias("unlabelled"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def roots_anti(spark, sf):
    return t(spark, sf, "customer").select("c_custkey").join(t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_partkey FROM part WHERE " + " AND ".join(f"NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND {c})" for c in _REFERENCED))
def orphan_7way(spark, sf):
    line = t(spark, sf, "lineitem")
    refs = [line.where(c).select("l_partkey") for c in _REFERENCED]
    return store.unreferenced(t(spark, sf, "part").select("p_partkey"), "p_partkey", refs)


@query("SELECT o_custkey AS key, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN 500 END), 1000) AS marked_at FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey")
def orphan_marking(spark, sf):
    orders = t(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    marks = orders.where("o_orderstatus = 'P'").select("key").distinct().withColumn("marked_at", F.lit(500))
    return store.orphan_marks(orders.select("key"), marks, "key", 1000)


@query("SELECT doc_id AS item, analyzer FROM documents CROSS JOIN (VALUES ('chunk'), ('header'), ('noop')) a(analyzer) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND ((analyzer = 'chunk' AND quality = 1) OR (analyzer = 'header' AND toxic = 1)))")
def unanalyzed_cross(spark, sf):
    labels = t(spark, sf, "labels")
    done = labels.where("quality = 1").select(F.col("doc_id").alias("item"), F.lit("chunk").alias("analyzer")).union(labels.where("toxic = 1").select(F.col("doc_id").alias("item"), F.lit("header").alias("analyzer")))
    analyzers = spark.createDataFrame([("chunk",), ("header",), ("noop",)], "analyzer string")
    return queue.enqueue_unanalyzed(t(spark, sf, "documents").select(F.col("doc_id").alias("item")), analyzers, done, 0).select("item", "analyzer")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def alias_pivot(spark, sf):
    rows = store.digests(t(spark, sf, "documents").select("doc_id", "text"), F.col("text").cast("binary"))
    return store.alias_tuples(store.alias_rows(rows, "doc_id", ["md5", "sha1", "sha256"]), "doc_id", ["md5", "sha1", "sha256"])


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_key, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    return store.dedup_content(t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", "doc_id")


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n_orders, count(*) FILTER (WHERE o_orderstatus='F') AS n_final FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def correlated_counts(spark, sf):
    counts = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")).join(counts, "custkey", "left").fillna(0)


@query("SELECT p_partkey AS partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) OR p_size > 45 AS eligible FROM part")
def semi_under_or(spark, sf):
    big = t(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("partkey")).distinct().withColumn("hit", F.lit(True))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), "p_size").join(big, "partkey", "left").select("partkey", (F.col("hit").isNotNull() | (F.col("p_size") > 45)).alias("eligible"))


# ---------------------------------------------------------------- aggregates

@query("SELECT o_orderstatus AS namespace, o_orderpriority AS residency, count(*) AS n, count(*) FILTER (WHERE o_custkey % 10 = 0) AS sizeless, CAST(sum(CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END) AS BIGINT) AS bytes FROM orders GROUP BY 1, 2")
def by_class(spark, sf):
    size = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))
    return t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("namespace"), F.col("o_orderpriority").alias("residency")).agg(F.count(F.lit(1)).alias("n"), F.count_if(size.isNull()).alias("sizeless"), F.sum(size).alias("bytes"))


@query("SELECT l_suppkey AS blob, count(DISTINCT l_orderkey) AS recipes, min(l_partkey) AS first_part, max(l_linenumber) AS last_line FROM lineitem GROUP BY l_suppkey")
def distinct_evidence(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("blob")).agg(F.count_distinct("l_orderkey").alias("recipes"), F.min("l_partkey").alias("first_part"), F.max("l_linenumber").alias("last_line"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, string_agg(url, chr(10) ORDER BY url) AS paths FROM pages GROUP BY 1")
def listagg_paths(spark, sf):
    t(spark, sf, "pages").select("url").createOrReplaceTempView("cairn_pages")
    return spark.sql(r"SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, listagg(url, '\n') WITHIN GROUP (ORDER BY url) AS paths FROM cairn_pages GROUP BY 1")


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS positive, count(*) FILTER (WHERE value <= 50) AS negative FROM events GROUP BY event_type")
def analysis_counts(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("positive"), F.count_if(F.col("value") <= 50).alias("negative"))


@query("WITH uses AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS u FROM lineitem GROUP BY 1) SELECT l_orderkey AS recipe, CAST(sum(CASE WHEN u >= 33 THEN l_linenumber ELSE 0 END) AS BIGINT) AS shared, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem JOIN uses USING (l_partkey) GROUP BY 1 HAVING sum(CASE WHEN u >= 33 THEN l_linenumber ELSE 0 END) * 100 >= sum(l_linenumber) * 60")
def swap_fraction_threshold(spark, sf):
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    uses = line.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("u"))
    shared = F.sum(F.when(F.col("u") >= 33, F.col("l_linenumber")).otherwise(0))
    rows = line.join(uses, "l_partkey").groupBy(F.col("l_orderkey").alias("recipe")).agg(shared.alias("shared"), F.sum("l_linenumber").alias("total"))
    return rows.where("shared * 100 >= total * 60")


@query("""WITH r AS (SELECT l_orderkey AS recipe, l_partkey AS blob, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_linenumber END AS size FROM lineitem),
u AS (SELECT blob, count(DISTINCT recipe) AS n FROM r GROUP BY blob)
SELECT recipe, CAST(sum(CASE WHEN n >= 2 THEN size ELSE 0 END) AS BIGINT) AS shared, CAST(sum(size) AS BIGINT) AS total FROM r JOIN u USING (blob) GROUP BY recipe
HAVING count(*) = count(size) AND sum(size) > 0 AND sum(CASE WHEN n >= 2 THEN size ELSE 0 END) * 100 >= sum(size) * 80""")
def swap_fraction(spark, sf):
    r = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("blob"), F.expr("CASE WHEN l_linenumber = 6 THEN NULL ELSE l_linenumber END").alias("size"))
    return store.sharing(r, 80)


@query("SELECT s_suppkey AS source, coalesce(max(l_orderkey), 0) + 1 AS next_seq FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linenumber = 7 AND l_quantity < 5 GROUP BY s_suppkey")
def max_with_empty_groups(spark, sf):
    line = t(spark, sf, "lineitem").where("l_linenumber = 7 AND l_quantity < 5").groupBy(F.col("l_suppkey").alias("source")).agg(F.max("l_orderkey").alias("m"))
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("source")).join(line, "source", "left").select("source", (F.coalesce("m", F.lit(0)) + 1).alias("next_seq"))


# ---------------------------------------------------------------- ranking, retention, budgets

_BRANDS = ["Brand#11", "Brand#22", "Brand#33"]


@query("""WITH c AS (SELECT p_name AS family, CASE WHEN p_retailprice < 1500 THEN 0 ELSE 1 END AS held, CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#22' THEN 1 WHEN 'Brand#33' THEN 2 ELSE 3 END AS rank, -p_size AS rev, p_partkey AS id FROM part)
SELECT family, held, rank, rev, id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY held, rank, rev, id) AS n FROM c) WHERE n = 1""")
def one_per_family(spark, sf):
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _BRANDS)), F.col("p_brand")), F.lit(0)) - 1, F.lit(len(_BRANDS))).cast("int")
    c = t(spark, sf, "part").select(F.col("p_name").alias("family"), F.when(F.col("p_retailprice") < 1500, 0).otherwise(1).alias("held"), rank.alias("rank"), (-F.col("p_size")).alias("rev"), F.col("p_partkey").alias("id"))
    return selection.best_struct(c, ["family"], ["held", "rank", "rev"], ["id"])


@query(r"""WITH n AS (SELECT p_partkey, p_name || ' (' || CASE WHEN p_size % 3 = 0 THEN 'US' ELSE 'Japan' END || ', ' || p_brand || ') (Rev ' || CASE WHEN p_size % 2 = 0 THEN 'B' ELSE CAST(p_size AS VARCHAR) END || ')' || CASE WHEN p_size % 5 = 0 THEN ' (Beta 1)' ELSE '' END AS name FROM part)
SELECT p_partkey AS id, lower(trim(split_part(name, '(', 1))) AS base, CASE WHEN name LIKE '% (US,%' THEN 0 ELSE 2 END AS region, name LIKE '%(Beta 1)' AS dev, CASE WHEN name LIKE '%(Rev B)%' THEN 2 ELSE CAST(regexp_extract(name, 'Rev ([0-9]+)', 1) AS INTEGER) END AS rev, len(regexp_extract_all(name, '\(')) + 1 AS n_tokens FROM n""")
def name_tokens(spark, sf):
    name = F.concat("p_name", F.lit(" ("), F.when(F.col("p_size") % 3 == 0, "US").otherwise("Japan"), F.lit(", "), "p_brand", F.lit(") (Rev "), F.when(F.col("p_size") % 2 == 0, "B").otherwise(F.col("p_size").cast("string")), F.lit(")"), F.when(F.col("p_size") % 5 == 0, " (Beta 1)").otherwise(""))
    rows = t(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("tokens", C.paren_tokens(F.col("name")))
    return rows.select(F.col("p_partkey").alias("id"), C.base_name(F.col("name")).alias("base"), C.axis_rank(C.region_tokens(F.col("tokens")), ["usa", "europe"]).alias("region"), C.is_dev(F.col("tokens")).alias("dev"), C.revision(F.col("tokens")).cast("int").alias("rev"), F.size("tokens").cast("long").alias("n_tokens"))


@query("SELECT o_custkey, o_orderkey, rank, rank <= 2 AS kept FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)")
def keep_two_newest(spark, sf):
    rows = selection.newest(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2)
    return rows.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"), "kept")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE event_type = 'view' OR n <= 3")
def prune_jobs(spark, sf):
    rows = t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return selection.prune(rows, F.col("event_type") == "view", [F.desc("ts"), F.desc("event_id")], 3, ["user_id"]).select("user_id", "event_id")


@query("SELECT p_partkey, freed_before FROM (SELECT p_partkey, coalesce(CAST(sum(p_size) OVER (ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS freed_before FROM part) WHERE freed_before < 20000")
def evict_budget(spark, sf):
    return selection.within_budget(t(spark, sf, "part").select("p_partkey", "p_size"), "p_size", ["-p_size", "p_partkey"], 20000, 8).select("p_partkey", "freed_before")


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS path, right('0000' || CAST(p_partkey % 50 AS VARCHAR), 4) AS h FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) AS n FROM a),
c AS (SELECT id, CASE WHEN n = 1 THEN path ELSE path || ' (' || h || ')' END AS final_path, n FROM b)
SELECT id, final_path FROM (SELECT *, row_number() OVER (PARTITION BY final_path ORDER BY n, id) AS m FROM c) WHERE m = 1""")
def path_collisions(spark, sf):
    rows = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"), F.expr("right(concat('0000', CAST(p_partkey % 50 AS string)), 4)").alias("h"))
    return selection.number_collisions(rows, "path", [F.asc("id")], F.concat(F.lit(" ("), F.col("h"), F.lit(")"))).select("id", "final_path")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def largest_fifty(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#0000') ORDER BY c_name, c_custkey LIMIT 200 OFFSET 100")
def name_paging(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", "c_name").where(C.contains_ignoring_case(F.col("c_name"), "R#0000"))
    return rows.orderBy("c_name", "c_custkey").offset(100).limit(200)


@query("SELECT o_orderkey AS entry FROM orders o WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < TIMESTAMP '1997-01-01' AND p.o_orderstatus = 'F') ORDER BY 1 LIMIT 200")
def lightup(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    cut = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    before = orders.where((F.col("o_orderdate") < cut) & (F.col("o_orderstatus") == "F")).select("o_custkey").distinct()
    return orders.where(F.col("o_orderdate") >= cut).join(before, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("entry")).orderBy("entry").limit(200)


# ---------------------------------------------------------------- differences

_OLD = "SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN 'k' || doc_id END AS stable_key, 'n' || (doc_id * 3 % 1009) || '-' || doc_id AS name, sha256(text) AS fp FROM documents WHERE doc_id % 10 <> 0"
_NEW = "SELECT doc_id + 1000000 AS id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 9 <> 0 THEN 'k' || doc_id END AS stable_key, CASE WHEN doc_id % 4 = 0 THEN 'renamed' || doc_id ELSE 'n' || (doc_id * 3 % 1009) || '-' || doc_id END AS name, sha256(CASE WHEN doc_id % 6 = 0 THEN text || 'x' ELSE text END) AS fp FROM documents WHERE doc_id % 11 <> 0"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}),
m1 AS (SELECT max(o.id) AS old_id, n.id AS new_id FROM o JOIN n USING (stable_key) GROUP BY n.id),
o2 AS (SELECT * FROM o WHERE id NOT IN (SELECT old_id FROM m1)), n2 AS (SELECT * FROM n WHERE id NOT IN (SELECT new_id FROM m1)),
m2 AS (SELECT max(o2.id) AS old_id, n2.id AS new_id FROM o2 JOIN n2 USING (name) GROUP BY n2.id),
o3 AS (SELECT * FROM o2 WHERE id NOT IN (SELECT old_id FROM m2)), n3 AS (SELECT * FROM n2 WHERE id NOT IN (SELECT new_id FROM m2)),
m3 AS (SELECT a.id AS old_id, b.id AS new_id FROM (SELECT fp, min(id) AS id FROM o3 GROUP BY fp HAVING count(*) = 1) a JOIN (SELECT fp, min(id) AS id FROM n3 GROUP BY fp HAVING count(*) = 1) b USING (fp)),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
x AS (SELECT CASE WHEN o.fp <> n.fp THEN 'rehashed' WHEN o.name <> n.name THEN 'renamed' END AS change, old_id, new_id FROM m JOIN o ON o.id = old_id JOIN n ON n.id = new_id)
SELECT * FROM x WHERE change IS NOT NULL
UNION ALL SELECT 'removed', id, -1 FROM o3 WHERE id NOT IN (SELECT old_id FROM m3)
UNION ALL SELECT 'added', -1, id FROM n3 WHERE id NOT IN (SELECT new_id FROM m3)""")
def revision_diff(spark, sf):
    t(spark, sf, "documents").select("doc_id", "text").createOrReplaceTempView("cairn_documents")
    sql = lambda s: spark.sql(s.replace("FROM documents", "FROM cairn_documents").replace("sha256(text)", "sha2(text, 256)").replace("sha256(CASE WHEN doc_id % 6 = 0 THEN text || 'x' ELSE text END)", "sha2(CASE WHEN doc_id % 6 = 0 THEN text || 'x' ELSE text END, 256)"))
    return diff.revision_diff(sql(_OLD), sql(_NEW)).fillna(-1, ["old_id", "new_id"])


@query("SELECT o_orderkey AS key, 'local' AS side FROM orders WHERE o_orderkey % 10 <> 0 AND NOT (o_orderkey % 7 <> 0) UNION ALL SELECT o_orderkey, 'remote' FROM orders WHERE o_orderkey % 7 <> 0 AND NOT (o_orderkey % 10 <> 0)")
def set_reconcile(spark, sf):
    keys = t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return diff.symmetric_difference(keys.where("key % 10 <> 0"), keys.where("key % 7 <> 0"), "key")


@query("SELECT coalesce(m.p, i.p) AS path, CASE WHEN i.s IS NULL THEN 'copy' WHEN m.s IS NULL THEN 'delete' WHEN m.s <> i.s THEN 'replace' ELSE 'keep' END AS action FROM (SELECT url AS p, page_id % 50 AS s FROM pages WHERE page_id % 5 <> 0) m FULL JOIN (SELECT url AS p, page_id % 60 AS s FROM pages WHERE page_id % 3 <> 0) i ON m.p = i.p")
def sync_plan(spark, sf):
    pages = t(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return diff.sync_plan(pages.where("page_id % 5 <> 0").selectExpr("path", "page_id % 50 AS size"), pages.where("page_id % 3 <> 0").selectExpr("path", "page_id % 60 AS size"))


@query("SELECT l_orderkey AS entry, sha256(string_agg(line, chr(10) ORDER BY line)) AS fp FROM (SELECT l_orderkey, 'v' || l_partkey || '|' || CASE WHEN l_suppkey % 3 = 0 THEN 'n' ELSE 'v' || l_suppkey END || '|v' || l_returnflag AS line FROM lineitem) GROUP BY l_orderkey")
def content_fingerprints(spark, sf):
    rows = t(spark, sf, "lineitem").selectExpr("l_orderkey AS entry", "l_partkey", "nullif(l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END) AS supp", "l_returnflag")
    return diff.content_fingerprint(rows, "entry", ["l_partkey", "supp", "l_returnflag"])


# ---------------------------------------------------------------- lineage

_EDGES = "SELECT DISTINCT 2 * o_custkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity <= 3 AND l_linenumber = 1"


def _edges(spark: SparkSession, sf: str, chosen: str = "l_quantity <= 3 AND l_linenumber = 1") -> DataFrame:
    line = t(spark, sf, "lineitem").where(chosen).select("l_orderkey", "l_partkey")
    return line.join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(root, node) AS (SELECT a, a FROM b UNION SELECT root, b.b FROM reach JOIN b ON node = b.a)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def components(spark, sf):
    return graph.connected_components(_edges(spark, sf))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), hop AS (SELECT src AS a, dst AS b FROM e WHERE src % 4 = 0 UNION SELECT dst, src FROM e WHERE src % 4 <> 0),
reach(root, node) AS (SELECT DISTINCT a, a FROM hop WHERE a % 10 = 0 UNION SELECT root, hop.b FROM reach JOIN hop ON node = hop.a) SELECT root, node FROM reach""")
def downstream(spark, sf):
    e = _edges(spark, sf)
    hops = e.where("src % 4 = 0").union(e.where("src % 4 <> 0").select("dst", "src"))
    return graph.closure(hops, hops.where("src % 10 = 0").select("src"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(root, node) AS (SELECT a, a FROM b UNION SELECT root, b.b FROM reach JOIN b ON node = b.a),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
claimed AS (SELECT DISTINCT component, c_nationkey AS source FROM comp JOIN customer ON node = 2 * c_custkey)
SELECT source, count(*) AS blobs, CAST(sum(p_size) AS BIGINT) AS bytes FROM comp JOIN claimed USING (component) JOIN part ON node = 2 * p_partkey + 1 GROUP BY source""")
def attribution(spark, sf):
    """Parts reachable from each nation's customers; a part counts in every nation it serves."""
    return _attributed(spark, sf, graph.connected_components(_edges(spark, sf)))


def _attributed(spark: SparkSession, sf: str, comp: DataFrame) -> DataFrame:
    claimed = comp.join(t(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").alias("source")), "node").select("component", "source").distinct()
    parts = t(spark, sf, "part").select((F.col("p_partkey") * 2 + 1).alias("node"), "p_size")
    return comp.join(parts, "node").join(claimed, "component").groupBy("source").agg(F.count(F.lit(1)).alias("blobs"), F.sum("p_size").alias("bytes"))


@query()
def components_all(spark, sf):
    """Components over the edges of all lineitems."""
    return graph.connected_components(_edges(spark, sf, "true"))


@query()
def downstream_all(spark, sf):
    """What every node leads to over the edges of all lineitems."""
    e = _edges(spark, sf, "true")
    hops = e.where("src % 4 = 0").union(e.where("src % 4 <> 0").select("dst", "src"))
    return graph.closure(hops, hops.select("src"))


@query()
def attribution_all(spark, sf):
    """Attribution over the edges of all lineitems."""
    return _attributed(spark, sf, graph.connected_components(_edges(spark, sf, "true")))


def _recipes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("node")).distinct()
    outputs = line.groupBy("recipe").agg(F.max("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    inputs = line.join(outputs.select("recipe", F.col("node").alias("made")), "recipe").where("node <> made").select("recipe", "node")
    return outputs.select("recipe"), inputs, outputs


def _ground_sql(seeds: str, rounds: int = 10) -> str:
    parts = ["line AS (SELECT DISTINCT l_orderkey AS recipe, l_partkey AS node FROM lineitem)", "outp AS (SELECT recipe, max(node) AS node FROM line GROUP BY recipe HAVING count(*) >= 2)", "inp AS (SELECT line.recipe, line.node FROM line JOIN outp ON line.recipe = outp.recipe AND line.node <> outp.node)", f"g0 AS (SELECT p_partkey AS node FROM part WHERE {seeds})"]
    for k in range(1, rounds + 1):
        parts.append(f"g{k} AS (SELECT node FROM g{k - 1} UNION SELECT node FROM outp WHERE recipe NOT IN (SELECT recipe FROM inp WHERE node NOT IN (SELECT node FROM g{k - 1})))")
    return "WITH " + ", ".join(parts) + f" SELECT node FROM g{rounds}"


@query(_ground_sql("p_partkey % 2 <> 0"))
def grounding(spark, sf):
    recipes, inputs, outputs = _recipes(spark, sf)
    return graph.grounded(recipes, inputs, outputs, t(spark, sf, "part").where("p_partkey % 2 <> 0").select(F.col("p_partkey").alias("node"))).select("node")


@query("SELECT p_partkey AS node, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 0 END, (SELECT min(l_linenumber % 3) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'A'), 2) AS seek_class FROM part")
def seek_class(spark, sf):
    routes = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.when(F.col("l_returnflag") == "A", recipes.FAILED).otherwise(recipes.VERIFIED).alias("verify"), (F.col("l_linenumber") % 3).alias("seek_class"))
    contents = t(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 3 == 0).alias("resident"))
    return recipes.best_seek_class(contents, routes)


# ---------------------------------------------------------------- identities

@query("""WITH RECURSIVE c AS (SELECT min(doc_id) AS claim, sha256(text) AS h FROM documents GROUP BY text)
SELECT doc_id AS claim, claim AS identity FROM documents JOIN c ON sha256(text) = h""")
def unify_identity(spark, sf):
    """Claims with partly hidden digests; every text has one claim with all of them, so identities are texts."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    d = store.digests(docs, F.col("text").cast("binary")).drop("text")
    first = Window.partitionBy("sha256")
    d = d.withColumn("lead", F.min("doc_id").over(first) == F.col("doc_id"))
    hide = lambda c, m, r: F.when(F.col("lead") | (F.col("doc_id") % m != r), F.col(c))
    claims = d.select(F.col("doc_id").alias("claim"), hide("size", 5, 9).alias("size"), hide("sha256", 3, 0).alias("sha256"), hide("sha1", 3, 1).alias("sha1"), F.col("md5"), hide("crc32", 2, 1).alias("crc32"))
    return identity.unify(claims)


# ---------------------------------------------------------------- bytes, paths, queues

@query("SELECT conv_id, turn, length(text) AS len, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM conversations")
def prefix_sum(spark, sf):
    segments = t(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"))
    return byteops.segment_offsets(segments, "conv_id", ["turn"]).withColumnRenamed("offset", "pos")


@query("SELECT conv_id, turn, greatest(pos, 100) AS piece_start, least(400, pos + len) - greatest(pos, 100) AS piece_len FROM (SELECT conv_id, turn, length(text) AS len, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM conversations) WHERE pos < 400 AND pos + len > 100 AND len > 0")
def translate_range(spark, sf):
    segments = t(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"))
    return byteops.translate(segments, "conv_id", 100, 400, ["turn"]).select("conv_id", "turn", "piece_start", "piece_len")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS data FROM conversations GROUP BY conv_id")
def assemble(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("data"))
    return byteops.assemble(rows, "conv_id", "turn").withColumn("data", F.col("data").cast("string"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS seq, substr(text, CAST(i * 500 + 1 AS BIGINT), 500) AS chunk FROM documents, range(0, 1000) r(i) WHERE i * 500 < length(text)")
def fixed_chunks(spark, sf):
    return byteops.fixed_chunks(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 500)


@query()
def content_chunks(spark, sf):
    return byteops.content_chunks(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 256, 1024, 4096)


@query("SELECT doc_id, substr(sha256(text), 1, 2) AS byte FROM documents WHERE CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) * 100 < 20 * 256")
def hash_sample(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.where(C.hash_sample(F.col("h"), 20)).select("doc_id", F.substring("h", 1, 2).alias("byte"))


@query("SELECT CAST('0x' || substr(h, 1, 2) AS INTEGER) * 16 // 256 AS shard, count(*) AS n, min(h) AS first, max(h) AS last FROM (SELECT sha256(text) AS h FROM documents) GROUP BY 1")
def shard_batches(spark, sf):
    rows = t(spark, sf, "documents").select(F.sha2("text", 256).alias("h"))
    return rows.groupBy(C.shard_of(F.col("h"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))


_PATH_SQL = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query(f"WITH p AS ({_PATH_SQL}), x AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p) SELECT dir, count(*) AS n_children FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i-1], '/') AS dir, string_split(path, '/')[i] AS child FROM x) GROUP BY dir")
def directory_children(spark, sf):
    return layout.directory_children(_paths(spark, sf), "path")


@query(f"WITH p AS ({_PATH_SQL}) SELECT split_part(path, '/', 1) AS child, bool_or(contains(path, '/')) AS is_dir, count(*) AS n_files FROM p GROUP BY 1")
def prefix_listing(spark, sf):
    return layout.listing(_paths(spark, sf), "path", "")


@query("WITH n AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1) SELECT p_partkey, p_brand || '/' || CASE WHEN c > 80 THEN CASE WHEN regexp_matches(p_name, '^[A-Za-z]') THEN upper(substr(p_name, 1, 1)) ELSE '#' END || '/' ELSE '' END || p_name AS final_path FROM part JOIN n USING (p_brand)")
def dir_bucket(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    return layout.bucket_overfull(rows, "p_brand", "p_name", 80, C.alpha_bucket(F.col("p_name"))).select("p_partkey", "final_path")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, sf):
    return t(spark, sf, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


_QUEUE = "SELECT event_id AS item, event_type AS analyzer, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS priority, epoch(ts) AS enqueued_at, CASE WHEN user_id % 3 = 0 THEN 100 ELSE 0 END AS leased_until FROM events"


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select(F.col("event_id").alias("item"), F.col("event_type").alias("analyzer"), F.expr("CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END").alias("priority"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("enqueued_at"), F.when(F.col("user_id") % 3 == 0, 100).otherwise(0).cast("long").alias("leased_until"))


@query(f"WITH q AS ({_QUEUE}) SELECT item, priority, 650 AS leased_until FROM q WHERE analyzer = 'purchase' AND leased_until <= 50 ORDER BY priority DESC, enqueued_at, item LIMIT 25")
def queue_topk(spark, sf):
    return queue.claim(_queue(spark, sf), "purchase", 25, 50, 600, ["signup"]).select("item", "priority", F.col("leased_until").cast("int").alias("leased_until"))


@query("SELECT user_id AS item, 'sweep' AS analyzer, max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS priority, CAST(min(event_id) AS BIGINT) AS enqueued_at, CAST(0 AS BIGINT) AS leased_until FROM events GROUP BY user_id")
def promote_max(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("item"), F.lit("sweep").alias("analyzer"), F.expr("CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END").alias("priority"), F.col("event_id").alias("enqueued_at"), F.lit(0).cast("long").alias("leased_until"))
    return queue.promote(rows.where("enqueued_at % 2 = 0"), rows.where("enqueued_at % 2 <> 0"))


@query("SELECT set, piece, CAST(coalesce(sum(size) OVER (PARTITION BY set ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM (SELECT min(l_orderkey) AS set, l_partkey AS piece, min(p_size) AS size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey) WHERE set IN (SELECT set FROM (SELECT min(l_orderkey) AS set FROM lineitem GROUP BY l_partkey) GROUP BY set HAVING count(*) >= 4)")
def pack_sets(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("set"), F.col("l_partkey").alias("piece"), F.col("p_size").alias("size"))
    return store.pack_sets(rows, 4).select("set", "piece", F.col("offset").alias("pos"))


@query("SELECT o_custkey AS image, o_orderkey AS file, CAST(ceil(o_totalprice / 4096) AS BIGINT) AS clusters, CAST(CASE WHEN ceil(o_totalprice / 4096) > 0 THEN coalesce(sum(ceil(o_totalprice / 4096)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 ELSE 0 END AS BIGINT) AS first_cluster FROM orders")
def cluster_layout(spark, sf):
    files = t(spark, sf, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("file"), "o_totalprice")
    return layout.cluster_layout(files, "image", ["file"], "o_totalprice", 4096).select("image", "file", "clusters", "first_cluster")


# ---------------------------------------------------------------- merge modes: suppliers as machines, their parts as claims

_MACHINES = "SELECT s_suppkey AS machine, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey > 4 THEN s_suppkey - s_suppkey % 4 END AS parent, s_suppkey % 9 = 0 AS is_device, s_suppkey % 13 = 0 AS is_bios FROM supplier"
_ALL_MCLAIMS = "SELECT l_partkey * 10 + l_linenumber AS claim, l_suppkey AS machine, 'f' || (l_partkey % 50) AS file, CAST(l_partkey % 200 AS VARCHAR) AS hash, CASE WHEN l_linenumber % 3 = 0 THEN 'm' END AS merge_name FROM lineitem"
_MCLAIMS = f"{_ALL_MCLAIMS} WHERE l_orderkey % 20 = 1"
_DEVICES = "SELECT s_suppkey AS machine, s_suppkey * 3 % 90 + 9 - (s_suppkey * 3 % 90) % 9 AS device FROM supplier WHERE s_suppkey % 5 < 2"


def _machine_set(spark: SparkSession, sf: str, claims: str = _MCLAIMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    t(spark, sf, "supplier").createOrReplaceTempView("cairn_supplier")
    t(spark, sf, "lineitem").createOrReplaceTempView("cairn_lineitem")
    run = lambda s: spark.sql(s.replace("FROM supplier", "FROM cairn_supplier").replace("FROM lineitem", "FROM cairn_lineitem").replace("VARCHAR", "STRING"))
    return run(_MACHINES), run(claims), run(_DEVICES)


@query(f"WITH RECURSIVE m AS ({_MACHINES}), c AS ({_MCLAIMS}), d AS ({_DEVICES}), r(root, node) AS (SELECT machine, machine FROM m WHERE NOT is_device UNION SELECT root, device FROM r JOIN d ON node = machine) SELECT root AS set, file, min(claim) AS claim FROM r JOIN c ON node = machine GROUP BY root, file, hash")
def render_non_merged(spark, sf):
    return layout.render_sets(*_machine_set(spark, sf), "non-merged")


@query(f"WITH m AS ({_MACHINES}), c AS ({_MCLAIMS}) SELECT machine AS set, file, min(claim) AS claim FROM c JOIN m USING (machine) WHERE merge_name IS NULL GROUP BY machine, file, hash")
def render_split(spark, sf):
    return layout.render_sets(*_machine_set(spark, sf), "split")


@query(f"WITH RECURSIVE m AS ({_MACHINES}), c AS ({_MCLAIMS}), up(node, top) AS (SELECT machine, machine FROM m UNION SELECT up.node, m.parent FROM up JOIN m ON up.top = m.machine WHERE m.parent IS NOT NULL), tops AS (SELECT node, min(top) AS top FROM up GROUP BY node), x AS (SELECT CASE WHEN is_device OR is_bios THEN c.machine ELSE top END AS set, file, hash, claim FROM c JOIN m ON m.machine = c.machine JOIN tops ON node = c.machine WHERE merge_name IS NULL) SELECT set, file, min(claim) AS claim FROM x GROUP BY set, file, hash")
def render_merged(spark, sf):
    return layout.render_sets(*_machine_set(spark, sf), "merged")


@query(ORACLES["render_non_merged"].replace(_MCLAIMS, _ALL_MCLAIMS))
def render_non_merged_all(spark, sf):
    return layout.render_sets(*_machine_set(spark, sf, _ALL_MCLAIMS), "non-merged")


@query(ORACLES["render_split"].replace(_MCLAIMS, _ALL_MCLAIMS))
def render_split_all(spark, sf):
    return layout.render_sets(*_machine_set(spark, sf, _ALL_MCLAIMS), "split")


@query(ORACLES["render_merged"].replace(_MCLAIMS, _ALL_MCLAIMS))
def render_merged_all(spark, sf):
    return layout.render_sets(*_machine_set(spark, sf, _ALL_MCLAIMS), "merged")


# ---------------------------------------------------------------- routes, evidence

@query("SELECT p_partkey AS node, CAST(coalesce((SELECT min(l_orderkey) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'R'), -1) AS BIGINT) AS recipe FROM part WHERE p_partkey % 2 = 0")
def first_route(spark, sf):
    """The smallest usable recipe of every content that is not stored."""
    routes = t(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("node")).agg(F.min("l_orderkey").alias("recipe"))
    return t(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("node")).join(routes, "node", "left").select("node", F.coalesce("recipe", F.lit(-1)).cast("long").alias("recipe"))


@query("SELECT s.hash AS hash, CASE WHEN f.digest IS NULL THEN 'missing' WHEN f.digest = s.digest THEN 'valid' ELSE 'corrupt' END AS result FROM (SELECT doc_id AS hash, sha256(text) AS digest FROM documents) s LEFT JOIN (SELECT doc_id AS hash, sha256(CASE WHEN doc_id % 17 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 23 <> 0) f ON s.hash = f.hash")
def scrub(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("hash"), "text")
    found = docs.where("hash % 23 <> 0").select("hash", F.sha2(F.when(F.col("hash") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return store.scrub(docs.select("hash", F.sha2("text", 256).alias("digest")), found)


def _more() -> None:
    """The other registries: their queries join this module's tables on import."""
    from cairn import registry_catalogs, registry_graph, registry_index  # noqa: F401


_more()
