"""Queries over the index: the work queue's life, the job ledger, pointer tables, paging, state snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import diff, jobs, queue, state
from cairn.registered import fixture, query

_QUEUE = "SELECT event_id AS item, event_type AS analyzer, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS priority, CAST(event_id % 1000 AS BIGINT) AS enqueued_at, CAST(CASE WHEN user_id % 3 = 0 THEN 100 ELSE 0 END AS BIGINT) AS leased_until FROM events"


@query(f"SELECT item, analyzer, greatest(priority, CASE WHEN item IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 0 END) AS priority FROM ({_QUEUE}) q")
def bump_matched(spark, sf):
    """Items that a catalog names move up a tier."""
    named = fixture(spark, sf, "SELECT o_orderkey AS item FROM orders WHERE o_orderstatus = 'F'")
    return queue.bump(fixture(spark, sf, _QUEUE), named).select("item", "analyzer", "priority")


@query(f"SELECT DISTINCT q.item AS item FROM ({_QUEUE}) q WHERE q.item IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def matched_items(spark, sf):
    """Queue rows that a catalog names."""
    named = fixture(spark, sf, "SELECT o_orderkey AS item FROM orders WHERE o_orderstatus = 'F'")
    return fixture(spark, sf, _QUEUE).join(named, "item", "left_semi").select("item").distinct()


@query(f"SELECT item, analyzer, CAST(CASE WHEN analyzer = 'click' AND priority = 1 AND leased_until > 50 THEN 700 WHEN analyzer = 'view' THEN 0 ELSE leased_until END AS BIGINT) AS leased_until FROM ({_QUEUE}) q")
def leases(spark, sf):
    """Leases renewed by their holders and released for one analyzer."""
    q = fixture(spark, sf, _QUEUE)
    held = q.where("analyzer = 'click' AND leased_until > 50").select("item", "analyzer")
    renewed = queue.renew(q, held, 100, 600)
    return queue.release(renewed, F.col("analyzer") == "view").select("item", "analyzer", "leased_until")


@query(f"SELECT analyzer, outcome, count(*) AS n FROM (SELECT analyzer, CASE WHEN item % 3 = 0 THEN 1 ELSE 0 END AS outcome FROM ({_QUEUE}) q WHERE item % 2 = 0) x GROUP BY analyzer, outcome UNION ALL SELECT analyzer, -1, count(*) FROM ({_QUEUE}) q WHERE item % 2 <> 0 GROUP BY analyzer")
def complete_items(spark, sf):
    """Outcomes recorded, negative ones too, and what is left in the queue (outcome -1)."""
    q = fixture(spark, sf, _QUEUE)
    results = q.where("item % 2 = 0").select("item", "analyzer", F.when(F.col("item") % 3 == 0, 1).otherwise(0).alias("outcome"))
    rest, done = queue.complete(q, results.limit(0), results)
    both = done.select("analyzer", "outcome").unionByName(rest.select("analyzer", F.lit(-1).alias("outcome")))
    return both.groupBy("analyzer", "outcome").agg(F.count(F.lit(1)).alias("n"))


_ABSENT = "SELECT p_partkey AS item FROM part WHERE p_size > 25"


@query(f"SELECT 'named' AS mode, count(*) AS n FROM ({_ABSENT}) a WHERE item IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT 'all', count(*) FROM ({_ABSENT}) a UNION ALL SELECT 'off', 0")
def absent_eligible(spark, sf):
    """Absent items that may be analysed under each policy."""
    absent, named = fixture(spark, sf, _ABSENT), fixture(spark, sf, "SELECT l_partkey AS item FROM lineitem WHERE l_quantity > 49")
    one = lambda mode: queue.absent_eligible(absent, named, mode).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
    return one("named").unionByName(one("all")).unionByName(one("off"))


@query(f"SELECT analyzer, CASE WHEN analyzer = 'purchase' THEN 1 ELSE item % 2 END AS outcome, count(*) AS n FROM ({_QUEUE.replace('CASE WHEN user_id % 3 = 0 THEN 100 ELSE 0 END', '0')}) q GROUP BY 1, 2")
def sweep_rounds(spark, sf):
    """The queue worked off in rounds, an earlier class of analyzers before a later one."""
    q = fixture(spark, sf, _QUEUE).withColumn("leased_until", F.lit(0).cast("long"))
    names = sorted(r[0] for r in q.select("analyzer").distinct().collect())  # a handful of analyzers
    classes = [[n for n in names if n != "purchase"], ["purchase"]]
    analyze = lambda rows: rows.select("item", "analyzer", F.when(F.col("analyzer") == "purchase", 1).otherwise((F.col("item") % 2).cast("int")).alias("outcome"))
    _, done = jobs.sweep(q, classes, analyze, 1_000_000, 10)
    return done.groupBy("analyzer", "outcome").agg(F.count(F.lit(1)).alias("n"))


_LEDGER = "SELECT event_id AS job, event_type AS kind, CAST(CASE WHEN value > 90 THEN 0 WHEN value > 20 THEN 1 ELSE 2 END AS INTEGER) AS state, CAST(event_id * 7 % 100003 AS BIGINT) AS started, CASE WHEN value <= 90 THEN CAST(event_id * 7 % 100003 + 5 AS BIGINT) END AS finished FROM events"


@query(f"SELECT kind, job, finished FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY finished DESC, job DESC) AS n FROM ({_LEDGER}) l WHERE state = 1) x WHERE n = 1")
def newest_jobs(spark, sf):
    """The last job of each kind that ended well."""
    return jobs.newest_finished(fixture(spark, sf, _LEDGER))


@query(f"SELECT job, kind, started FROM (SELECT * FROM ({_LEDGER}) l ORDER BY started DESC, job DESC LIMIT 20) x")
def recent_jobs(spark, sf):
    """The last twenty jobs, oldest first."""
    return jobs.recent(fixture(spark, sf, _LEDGER), 20).select("job", "kind", "started")


@query(f"SELECT job, CASE WHEN state = 0 AND job % 2 = 0 THEN 1 WHEN state = 0 THEN 3 ELSE state END AS state, CAST(CASE WHEN state = 0 AND job % 2 = 0 THEN 200000 WHEN state = 0 THEN 300000 ELSE finished END AS BIGINT) AS finished FROM ({_LEDGER}) l")
def job_ledger(spark, sf):
    """Jobs that end, and running ones that a restart finds."""
    ledger = fixture(spark, sf, _LEDGER)
    fresh = ledger.where("job % 5 = 0")
    ledger = jobs.insert(ledger.where("job % 5 <> 0"), fresh)
    ended = ledger.where("job % 2 = 0").select("job", F.lit(1).alias("state"), F.lit(200000).cast("long").alias("finished"))
    return jobs.interrupt_running(jobs.finalize(ledger, ended), 300000).select("job", "state", "finished")


@query("SELECT 'a' AS holder, CAST(150 AS BIGINT) AS until, 'a,refused,a,b,b' AS story, count(*) AS n FROM region".replace("'a' AS holder, CAST(150 AS BIGINT)", "'b' AS holder, CAST(260 AS BIGINT)"))
def exclusive_guard(spark, sf):
    """One holder at a time: granted, refused to another, renewed, taken over when expired."""
    guard = spark.createDataFrame([], "holder string, until long")
    story = []
    for who, now in (("a", 0), ("b", 50), ("a", 60), ("b", 170), ("b", 200)):
        guard, granted = jobs.claim_guard(guard, who, now, 60 if who == "b" else 100)
        story.append(who if granted else "refused")
    n = fixture(spark, sf, "SELECT count(*) AS n FROM region")
    return guard.select("holder", "until", F.lit(",".join(story)).alias("story")).crossJoin(n)  # one row


_LOG = "SELECT c_mktsegment AS name, c_custkey AS seq, c_name AS hash, c_custkey % 7 = 0 AS deleted FROM customer"


@query(f"SELECT name, seq, hash FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS n FROM ({_LOG}) l) x WHERE n = 1 AND NOT deleted")
def latest_tags(spark, sf):
    """Tags as they stand: the last row of each name, unless it was deleted."""
    return state.latest(fixture(spark, sf, _LOG), "name", ["seq"], "deleted").select("name", "seq", "hash")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000_') OR starts_with(c_name, 'Customer#0000000')")
def prefix_scan(spark, sf):
    """Keys with a prefix, in which an underscore is an underscore."""
    rows = fixture(spark, sf, "SELECT c_custkey, c_name FROM customer")
    return state.with_prefix(rows, "c_name", "Customer#00000_").union(state.with_prefix(rows, "c_name", "Customer#0000000"))


_CONFIG = "SELECT CASE r_regionkey WHEN 0 THEN 'evict:high' WHEN 1 THEN 'gc:grace-secs' WHEN 2 THEN 'gc:keep:abc' WHEN 3 THEN 'gc:keep:def' ELSE 'other' END AS key, CASE r_regionkey WHEN 0 THEN '50%' WHEN 1 THEN '60' ELSE r_name END AS value FROM region"


@query(f"SELECT CAST(500 AS BIGINT) AS high, CAST(850 AS BIGINT) AS low, 60 AS grace, 50 AS share, 4 AS pack_members, true AS pack, string_agg(substr(key, 9), ',' ORDER BY key) AS keep FROM ({_CONFIG}) c WHERE key LIKE 'gc:keep:%'")
def policy_settings(spark, sf):
    """Settings with their defaults, and what is marked to keep."""
    config = fixture(spark, sf, _CONFIG)
    values = state.policy(config, F.lit(1000))
    keep = state.keep_marks(config).agg(F.array_join(F.sort_array(F.collect_list("hash")), ",").alias("keep"))
    return keep.select(*((v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()), "keep")


_GRANTS = "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'ann' ELSE 'bob' END AS user, c_nationkey AS view FROM customer WHERE c_acctbal > 5000 AND c_nationkey % 3 = 0"


@query(f"SELECT 'ann' AS user, count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT view FROM ({_GRANTS}) g WHERE g.user = 'ann') UNION ALL SELECT 'owner', count(*) FROM supplier")
def visible_rows(spark, sf):
    """What a friend and the owner see."""
    rows, grants = fixture(spark, sf, "SELECT s_suppkey, s_nationkey FROM supplier"), fixture(spark, sf, _GRANTS)
    one = lambda user, owner: state.visible(rows, "s_nationkey", grants, user, owner).agg(F.count(F.lit(1)).alias("n")).select(F.lit(user).alias("user"), "n")
    return one("ann", False).unionByName(one("owner", True))


_FOUND = "SELECT url AS path, page_id FROM pages WHERE contains(lower(url), 'example')"


@query(f"SELECT path, page_id, (SELECT count(*) FROM ({_FOUND}) f) AS total FROM ({_FOUND}) g ORDER BY path, page_id LIMIT 30 OFFSET 10")
def find_files(spark, sf):
    """A page of the files whose path holds a piece of text, with the number of all."""
    rows = fixture(spark, sf, "SELECT url AS path, page_id FROM pages")
    return state.page(state.find_files(rows, "EXAMPLE"), ["path", "page_id"], 30, 10)


@query("SELECT o_orderkey, o_orderpriority, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 200")
def capped_list(spark, sf):
    """The first 200 rows, shown in another order, with the number of all."""
    rows = fixture(spark, sf, "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders")
    own = state.filtered(rows, o_orderstatus="P", o_custkey=None).select("o_orderkey", "o_orderpriority")
    return state.capped(own, ["o_orderkey"], 200, ["o_orderpriority", "o_orderkey"])


@query("SELECT l_partkey AS identity, min(sha256(CAST(l_suppkey AS VARCHAR))) AS hash FROM lineitem GROUP BY l_partkey")
def smallest_hash(spark, sf):
    """One content of each identity: that of the smallest hash."""
    rows = fixture(spark, sf, "SELECT l_partkey AS identity, sha256(CAST(l_suppkey AS VARCHAR)) AS hash, l_suppkey FROM lineitem")
    return rows.groupBy("identity").agg(F.min(F.struct("hash", "l_suppkey")).alias("x")).select("identity", "x.hash")


@query("SELECT blob, kind, value FROM (SELECT doc_id AS blob, 'alias' AS kind, md5(text) AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT l_partkey, 'recipe', CAST(min(l_orderkey) AS VARCHAR) FROM lineitem GROUP BY l_partkey) x WHERE blob IN (SELECT min(doc_id) + 1 FROM documents)")
def blob_detail(spark, sf):
    """All that is known of one content: digests, where it came from, what uses it."""
    one = fixture(spark, sf, "SELECT min(doc_id) + 1 AS blob FROM documents")
    docs = fixture(spark, sf, "SELECT doc_id AS blob, md5(text) AS md5, source FROM documents").join(F.broadcast(one), "blob", "left_semi")  # one row
    uses = fixture(spark, sf, "SELECT l_partkey AS blob, l_orderkey FROM lineitem").join(F.broadcast(one), "blob", "left_semi").groupBy("blob").agg(F.min("l_orderkey").cast("string").alias("value"))
    return docs.select("blob", F.lit("alias").alias("kind"), F.col("md5").alias("value")).unionByName(docs.select("blob", F.lit("source").alias("kind"), F.col("source").alias("value"))).unionByName(uses.select("blob", F.lit("recipe").alias("kind"), "value"))


@query("SELECT s_suppkey AS source, s_name AS provider, max(l_orderkey) AS revision, CASE WHEN max(l_orderkey) IS NULL THEN NULL ELSE max(l_orderkey) % 9 END AS version FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49 GROUP BY s_suppkey, s_name")
def current_sources(spark, sf):
    """Sources with their current revision, if they have one."""
    from cairn.operators.importing import current_sources as listed

    revisions = fixture(spark, sf, "SELECT l_suppkey AS source, l_orderkey AS revision, l_orderkey % 9 AS version FROM lineitem WHERE l_quantity > 49").distinct().withColumn("imported_at", F.lit(0))
    last = revisions.groupBy("source").agg(F.max("revision").alias("current"))
    sources = fixture(spark, sf, "SELECT s_suppkey AS source, s_name AS provider, 'x' AS system FROM supplier").join(last, "source", "left")
    return listed(sources, revisions).select("source", "provider", "revision", "version")


@query("SELECT n_regionkey AS revision, a.n_nationkey AS entry, b.id AS cloneof_id FROM (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || CAST((n_nationkey + 1) % 30 AS VARCHAR) END AS cloneof FROM nation) a LEFT JOIN (SELECT n_regionkey AS r, 'n' || CAST(n_nationkey % 6 AS VARCHAR) AS name, min(n_nationkey) AS id FROM nation GROUP BY 1, 2) b ON b.r = a.n_regionkey AND b.name = a.cloneof")
def resolve_parents(spark, sf):
    """Parents by name inside their revision; unknown names stay unresolved."""
    from cairn.operators.importing import resolve_parents as resolved

    rows = fixture(spark, sf, "SELECT n_regionkey AS revision, n_nationkey AS entry, 'n' || CAST(n_nationkey % 6 AS VARCHAR) AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || CAST((n_nationkey + 1) % 30 AS VARCHAR) END AS cloneof, CAST(NULL AS VARCHAR) AS romof FROM nation")
    return resolved(rows).select("revision", "entry", "cloneof_id")


@query("SELECT 'same' AS pair, false AS dirty UNION ALL SELECT 'other', true")
def dirty_tables(spark, sf):
    """Do two tables hold the same rows, repeats counted?"""
    rows = fixture(spark, sf, "SELECT l_partkey, l_suppkey FROM lineitem")
    again = rows.repartition(3, "l_suppkey")
    more = rows.unionByName(rows.limit(1))
    return spark.createDataFrame([("same", diff.is_dirty(rows, again)), ("other", diff.is_dirty(rows, more))], "pair string, dirty boolean")


@query(
    "WITH d AS (SELECT sha256('v' || CAST(n_nationkey AS VARCHAR) || '|v' || n_name || '|' || CASE WHEN n_regionkey = 2 THEN 'n' ELSE 'v' || CAST(n_regionkey AS VARCHAR) END) AS d FROM nation), s AS (SELECT CAST('0x' || substr(d, 1, 8) AS BIGINT) % 16 AS s, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM d GROUP BY 1) "
    "SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY s)) AS digest FROM s"
)
def state_digest(spark, sf):
    """A digest of a table that does not depend on the order of its rows."""
    return state.digest(fixture(spark, sf, "SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS n_regionkey FROM nation"), 16)


@query("SELECT CAST(3 AS BIGINT) AS snapshots, CAST(3 AS BIGINT) AS newest")
def mint_snapshots(spark, sf):
    """Snapshots are made when something changed, and only then."""
    a, b = fixture(spark, sf, "SELECT r_regionkey, r_name FROM region"), fixture(spark, sf, "SELECT n_nationkey, n_name FROM nation")
    log = spark.createDataFrame([], "seq long, digest string, at long")
    log = state.mint(log, {"a": a, "b": b}, {}, 1)
    log = state.mint(log, {"a": a, "b": b}, {"a": a, "b": b}, 2)
    log = state.mint(log, {"a": a.limit(2), "b": b}, {"a": a, "b": b}, 3)
    log = state.mint(log, {"a": a, "b": b}, {"a": a.limit(2), "b": b}, 4)
    mine = log.where("at < 4").union(log.where("at = 4")).select("digest")
    newest = state.newest_valid(log, mine).select(F.col("seq").alias("newest"))
    return log.agg(F.count(F.lit(1)).alias("snapshots")).crossJoin(newest)  # one row each


@query(
    "SELECT 'blobs' AS tbl, count(DISTINCT sha256(text)) AS n FROM documents UNION ALL SELECT 'aliases', count(DISTINCT sha256(text)) * 2 FROM documents UNION ALL SELECT 'analyses', count(DISTINCT sha256(text)) FROM documents JOIN labels ON documents.doc_id = labels.doc_id WHERE quality IS NOT NULL"
)
def recover_tables(spark, sf):
    """Tables rebuilt from the store and the restored batches."""
    docs = fixture(spark, sf, "SELECT doc_id, sha256(text) AS hash, md5(text) AS md5, sha1(text) AS sha1, length(text) AS size FROM documents")
    aliases = docs.select("hash", F.lit("md5").alias("algo"), F.col("md5").alias("digest")).union(docs.select("hash", F.lit("sha1"), "sha1"))
    lost = spark.createDataFrame([("gone", "md5", "x")], "hash string, algo string, digest string")
    labels = fixture(spark, sf, "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL")
    analyses = docs.join(labels, "doc_id").select("hash", F.lit("header").alias("analyzer"), F.col("quality").alias("outcome"))
    tables = state.recover(docs, aliases.union(lost), analyses)
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT CAST(CAST('0x' || substr(h, 1, 2) AS INTEGER) * 16 // 256 AS INTEGER) AS shard, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM (SELECT DISTINCT sha256(text) AS h FROM documents) x GROUP BY 1")
def sharded_batches(spark, sf):
    """Batches by the first byte of the hash, sorted, with a digest each."""
    return state.sharded(fixture(spark, sf, "SELECT DISTINCT sha256(text) AS h FROM documents"), "h", 16)
