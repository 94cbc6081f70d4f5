"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of distinct five-word shingles (a text of fewer words
is one shingle), hashed to 64 bits. A document leaks an item when it holds at
least ``containment`` of the item's shingles. An
item of q shingles is indexed by its bottom-m MinHash sketch, its m smallest
hashes, with m = q - ceil(containment q) + 1: a document that misses at most q -
ceil(containment q) of the shingles holds one of any m of them, so the search loses
nothing whatever the lengths.

Items are partitioned by size (a class for each power of two of q). Every class has its
own index, its own bound on the hashes that it holds (the longer its items, the
smaller) and the least number of shingles that a document needs to leak one of its items.
A document asks a class only if it is long enough, and only for its hashes within the class's bound.

Candidates are verified by exact shingle containment on the whole text. Index, items and
candidates are broadcast after their rows have been counted (``most_broadcast``), so that texts
stay where they are; beyond that the joins shuffle. Results are pairs; a hot item costs one row
per document that holds it.

Texts are compared in lower case. Items or documents without words match nothing;
rows with a null id are not reported; repeated rows are reported once, and of rows that share
an id the one that holds most counts; other
columns are ignored; with either table empty the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.sqltext import with_shingles
from cairn.session import cut


def sketch_index(items: DataFrame, containment: float) -> DataFrame:
    """(size_class, hash, item, least) for the bottom-m hashes of (item, sh) rows; least: shingles a document needs."""
    sized = items.withColumn("q", F.size("sh")).withColumn("size_class", F.floor(F.log2("q")).cast("int"))
    sized = sized.withColumn("least", F.ceil(F.col("q") * containment - 1e-9).cast("int"))
    smallest = F.slice(F.sort_array("sh"), F.lit(1), F.col("q") - F.col("least") + 1)
    return sized.select("size_class", F.explode(smallest).alias("hash"), "item", "least")


def probes(classes: list) -> Column:
    """Array of the keys that a document with shingles ``sh`` asks for, from (size_class, top, least) rows; a key stands for a hash in a class."""

    def asked(size_class: int, top: int, least: int) -> Column:
        within = F.filter("sh", lambda h: (h <= F.lit(top)) & (F.size("sh") >= least))
        return F.transform(within, lambda h: F.xxhash64(h, F.lit(size_class)))

    return F.concat(*(asked(row["size_class"], row["top"], row["least"]) for row in classes))


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = 0.75, most_broadcast: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item id, n_item_shingles, n_shared, containment) for every document that leaks an item."""
    own = with_shingles(items.where(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("t")), "t", "sh")
    own = cut(own.where(F.size("sh") > 0).select("item", "sh").dropDuplicates(["item", "sh"]))
    index = cut(sketch_index(own, containment))
    classes = index.groupBy("size_class").agg(F.max("hash").alias("top"), F.min("least").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("size_class").collect()  # one row per power of two of item sizes
    size = own.agg(F.sum(F.size("sh"))).first()[0] or 0

    def small(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= most_broadcast else rows

    texts = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("t"))
    asked = with_shingles(texts, "t", "sh").select("doc", F.explode(probes(classes)).alias("key")) if classes else texts.select("doc", F.lit(0).cast("long").alias("key")).limit(0)
    held = small(index.select(F.xxhash64("hash", "size_class").alias("key"), "item"), sum(row["n"] for row in classes))
    candidates = cut(asked.join(held, "key").select("doc", "item").distinct())
    n = candidates.count()
    sets = with_shingles(texts.join(small(candidates.select("doc").distinct(), n), "doc", "left_semi"), "t", "sh").select("doc", "sh")
    pairs = sets.join(small(candidates, n), "doc").join(small(own.select("item", F.col("sh").alias("item_sh")), size), "item")
    exact = pairs.select("doc", "item", F.size("item_sh").cast("long").alias("q"), F.size(F.array_intersect("item_sh", "sh")).cast("long").alias("n_shared"))
    # filtered after the aggregation: a filter before it would be pushed down and spell the shingles out for every word
    best = exact.groupBy("doc", "item", "q").agg(F.max("n_shared").alias("n_shared"))
    found = best.where(F.col("n_shared") >= F.col("q") * containment - 1e-9)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("q").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))


#: The same result for documents (doc_id, text) and benchmark (item_id, text), in DuckDB's SQL.
ORACLE = r"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT 'i', item_id, lower(text) FROM benchmark),
worded AS (SELECT side, id, list_filter(regexp_split_to_array(coalesce(t, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM texts WHERE id IS NOT NULL),
shingled AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [CAST(len(w) AS VARCHAR) || ':' || array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
sizes AS (SELECT id AS item_id, count(*) AS q FROM shingled WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, z.q AS n_item_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / z.q AS containment
FROM shingled d JOIN shingled i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' JOIN sizes z ON z.item_id = i.id
GROUP BY d.id, i.id, z.q HAVING count(*) * 4 >= z.q * 3
"""
