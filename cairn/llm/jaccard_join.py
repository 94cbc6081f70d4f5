"""N-gram Jaccard self-join by signature trees, as connected classes of documents.

1. Shingles are hashed to 64 bits. Exact equal sets form a class (digest).
2. Candidates are found without loss by prefix filtering: under one global order of
   shingles, two sets of Jaccard >= t share one of their first n - ceil(t n) + 1
   shingles. The order puts rare shingles first, by powers of two of their counts over all
   documents: blocks deal their shingles by hash, and every part answers each block with their levels and numbers,
   so nothing is broadcast and no filter fills up. A shingle of one set only takes its place in the prefix but
   need not be sent anywhere: texts with a quarter of their shingles to themselves end here.
3. Sets that share a prefix shingle form a bucket. Buckets get signature trees: nodes
   hold the OR of token bitmaps and size ranges, and a dual traversal prunes node
   pairs by their greatest possible overlap and compares the rest exactly. Pairs
   that are connected already are skipped, so a group of n near copies costs
   about n comparisons. Three rounds, each with the components that are known so far:
   first every set meets the others of one of its buckets, in parts of ``chunk`` shingles, so that a
   large group of copies is spread over many tasks and shrinks to one component a part; then
   one set of each component of a bucket meets the others; then buckets that still
   hold several components are joined whole (part by part of ``large`` shingles beyond that size).
   Only that last step is quadratic, in the parts of a single bucket.
4. The links' components, labelled by the smallest id, are the result.

Nothing is capped or sampled. Only texts in buckets meet.

Null texts have no shingles and link with nothing, like texts without words. Rows
with a null id get a null component and link with nothing. Rows that share an id
are one document: each row has its own n_shingles, all have one component, and what any of
them links to is linked. Equal texts are linked; other columns are ignored; ids may be of any type that has an
order; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import blocks as B
from cairn.llm.common import small_batches, thrifty, type_of
from cairn.llm.ngram_lm import part_bits_for
from cairn.llm.signature_tree import spanning_links
from cairn.plans.graph import connected_components
from cairn.session import cut, release, written

N = 5
SHORT = np.uint64(0xA24BAED4963EE407)
KEY_BITS = 48
ID_BITS = 24
#: Characters in a block: all its sets are held at once.
BLOCK = 8_000_000


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every 5-word window of one document's word hashes; of the whole if shorter."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < N:
        h = SHORT + np.uint64(n)
        with np.errstate(over="ignore"):
            for w in words:
                h = B.mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
        return np.array([h], dtype=np.uint64)
    h = np.zeros(n - N + 1, dtype=np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - N + 1 + k]
    return B.mix(h)


def sets_of(block: B.Block) -> list[np.ndarray]:
    """Sorted distinct shingles of every document of a block."""
    hashes = B.mix(B.word_hashes(block))
    return [np.unique(shingle_hashes(hashes[t])) for t in block.tokens]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def sketched(rows: DataFrame, percent: int, id_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, node, n_shingles, digest) per document, candidate edges (u, v) between nodes, and the table that both read."""
    part_bits = part_bits_for(B.part_count(rows))
    n_parts = 1 << part_bits
    small_batches(rows.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for at, block in enumerate(B.blocks_of(batches, B.word_tokens, BLOCK)):
            name = str(task << 40 | at << 24)
            sets = sets_of(block)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            one_each = {d: i for i, d in reversed(list(enumerate(digests))) if len(sets[i]) and block.ids[i] is not None}  # equal sets share a digest; one of them stands for all
            picks = np.array(sorted(one_each.values()), dtype=np.int64)
            yield B.rows_to_batch([(zlib.crc32(name.encode()), name, B.DOCS, 0, B.pack(B.ids_to_bytes(block.ids, block.id_type), B.planes(sizes), b"".join(digests)))])
            if not len(picks):
                continue
            keys, ranks, counts = np.unique(np.concatenate([sets[i] for i in picks.tolist()]) >> np.uint64(64 - KEY_BITS), return_inverse=True, return_counts=True)
            bounds = np.searchsorted(keys, np.arange(n_parts + 1, dtype=np.uint64) << np.uint64(KEY_BITS - part_bits))
            steps, starts = np.diff(ranks, prepend=0), np.cumsum(sizes[picks])[:-1]
            steps[starts] = ranks[starts]
            out = [(zlib.crc32(name.encode()), name, B.HEADER, -1, B.pack(B.planes(bounds), B.planes(picks), B.planes(sizes[picks]), B.planes(steps)))]
            out += [(p, name, B.WORDS, p, B.pack(B.planes(np.diff(keys[a:b], prepend=np.uint64(0))), B.planes(counts[a:b]))) for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]
            yield B.rows_to_batch(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            others = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] == B.WORDS:
                    fields = B.unpack(row[4])
                    held.setdefault(row[3], []).append((row[1], np.cumsum(B.from_planes(fields[0]), dtype=np.uint64), B.from_planes(fields[1])))
                else:
                    others.append(row)
            if others:
                yield B.rows_to_batch(others)
        for part, blocks in held.items():
            keys, where = np.unique(np.concatenate([k for _, k, _ in blocks]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([c for _, _, c in blocks])).astype(np.int64)
            levels = np.searchsorted(1 << np.arange(1, 40), counts, side="right")  # 0: of one set only
            numbers = np.cumsum(levels > 0)
            at = 0
            for name, own, _ in blocks:
                mine = where[at : at + len(own)]
                at += len(own)
                level = levels[mine]
                yield B.rows_to_batch([(zlib.crc32(name.encode()), name, B.WORDS, part, B.pack(B.planes(level), B.planes(np.diff(numbers[mine[level > 0]], prepend=0))))])

    def prefixes(name: str, header: bytes, answers: list[tuple]) -> list[tuple]:
        bounds, picks, sizes, steps = (B.from_planes(f).astype(np.int64) for f in B.unpack(header))
        levels, numbers = np.zeros(bounds[-1], dtype=np.int64), np.zeros(bounds[-1], dtype=np.int64)
        for part, payload in answers:
            fields = B.unpack(payload)
            span = slice(bounds[part], bounds[part + 1])
            levels[span] = B.from_planes(fields[0])
            numbers[span][levels[span] > 0] = np.cumsum(B.from_planes(fields[1]).astype(np.int64))
        chosen, nodes = [], []
        for i, step in zip(picks.tolist(), np.split(steps, np.cumsum(sizes)[:-1]), strict=True):
            ranks = np.cumsum(step)
            level = levels[ranks]
            shared = ranks[level > 0]
            p = prefix_length(len(ranks), percent) - (len(ranks) - len(shared))  # the set's own shingles come first and meet nothing
            if p > 0:
                chosen.append(shared[np.argsort(level[level > 0], kind="stable")[:p]])
                nodes.append(np.full(len(chosen[-1]), i, dtype=np.int64))
        if not chosen:
            return []
        rank, node = np.concatenate(chosen), np.concatenate(nodes)
        order = np.argsort(rank, kind="stable")
        rank, node = rank[order], node[order]
        cuts = np.searchsorted(rank, bounds).tolist()
        return [(p, name, B.WORDS, p, B.pack(B.planes(np.diff(numbers[rank[a:b]], prepend=0)), B.planes(node[a:b]))) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, header, answers = None, b"", []
        for batch in batches:
            for _, block, kind, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == B.HEADER:  # the first row of a block
                    if name is not None and (out := prefixes(name, header, answers)):
                        yield B.rows_to_batch(out)
                    name, header, answers = block, payload, []
                else:
                    answers.append((part, payload))
        if name is not None and (out := prefixes(name, header, answers)):
            yield B.rows_to_batch(out)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sizes, digests = B.unpack(payload)
                sizes = B.from_planes(sizes).astype(np.int64)
                nodes = int(first) + np.arange(len(sizes))
                yield pa.RecordBatch.from_arrays([B.ids_from_bytes(ids), pa.array(nodes), pa.array(sizes), pa.array([digests[16 * i : 16 * i + 16] for i in range(len(sizes))], pa.binary())], names=["id", "node", "n_shingles", "digest"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, first, _, part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields = B.unpack(payload)
                held.setdefault(part, []).append((np.cumsum(B.from_planes(fields[0]), dtype=np.uint64), B.from_planes(fields[1]).astype(np.int64) + int(first)))
        for parts in held.values():
            key, node = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = np.repeat(node[starts], np.diff(np.append(starts, len(key))))
            pairs = np.unique(np.stack([node, least], axis=1)[node != least], axis=0)  # each node with the least of its bucket
            for a in range(0, len(pairs), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + 200_000, 0]), pa.array(pairs[a : a + 200_000, 1])], names=["u", "v"])

    table = written(B.deal(rows.mapInArrow(thrifty(sketch), B.ROW_SCHEMA), n_parts, "slot").mapInArrow(thrifty(answer), B.ROW_SCHEMA))
    docs = table.where(F.col("kind") == B.DOCS).select("block", "payload").mapInArrow(thrifty(documents), f"id {id_type}, node long, n_shingles long, digest binary")
    asked = B.deal(table.where(F.col("kind") != B.DOCS), n_parts, "slot", "block", "kind").mapInArrow(thrifty(choose), B.ROW_SCHEMA)
    edges = B.deal(asked, n_parts, "slot").mapInArrow(thrifty(meet), "u long, v long")
    return docs, edges, table


def tree_links(tasks: DataFrame, id_type: str, percent: int) -> DataFrame:
    """(src, dst) ids that link, from (cluster, i, j, chunk, id, digest, known, text) rows dealt and sorted by cluster and chunk pair."""
    small_batches(tasks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, texts = None, [], [], B.Block()
        found: list[tuple] = []
        arrow = pa.null()

        def links() -> list[tuple]:
            if len(ids) < 2:
                return []
            sets = sets_of(texts)
            kept = [x for x in range(len(ids)) if xxhash.xxh3_128_digest(sets[x].tobytes()) == sides[x][1]]  # rows that share an id may hold other texts
            left, right = [x for x in kept if sides[x][0] == key[1]], [x for x in kept if sides[x][0] != key[1]]
            return [(ids[a], ids[b]) for a, b in spanning_links(sets, left, right, percent, [known for _, _, known in sides])]

        def pairs() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], arrow), pa.array([b for _, b in found], arrow)], names=["src", "dst"])

        for batch in batches:
            arrow = batch.schema.field("id").type
            for cluster, i, j, chunk, one, digest, known, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (cluster, i, j):
                    found += links()
                    key, ids, sides, texts = (cluster, i, j), [], [], B.Block()
                ids.append(one)
                sides.append((chunk, digest, known))
                texts.add(None, "", B.word_tokens(texts, text or ""))
            if len(found) > 10_000:
                yield pairs()
                found = []
        found += links()
        if found:
            yield pairs()

    return tasks.mapInArrow(thrifty(run), f"src {id_type}, dst {id_type}")


def with_texts(rows: DataFrame, chosen: DataFrame, most_broadcast: int) -> DataFrame:
    """Rows of ``chosen`` (with their id) and the texts of these ids.

    A short list is broadcast, so that other texts stay where they are. A longer one is shuffled, and of the texts only
    those whose id's hash is in a table of 2^ID_BITS bits, so that not all texts are shuffled.
    """
    if chosen.count() <= most_broadcast:
        return rows.join(F.broadcast(chosen), "id")
    return likely(rows, chosen).join(chosen, "id")


def likely(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (id, text) whose id's hash is that of a chosen id."""
    small_batches(rows.sparkSession)
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("place")
    mark = np.zeros(1 << ID_BITS, dtype=bool)
    mark[chosen.select(place).distinct().toArrow().column(0).to_numpy()] = True  # 2^ID_BITS numbers at most
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(mark))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column(2).to_numpy()])).select(["id", "text"])

    return rows.select("id", "text", place).mapInArrow(thrifty(some), rows.schema)


def parts_of(members: DataFrame, shingles: int) -> DataFrame:
    """Members (id, cluster, n, ...) with k, the number of parts of about ``shingles`` of their cluster, and their own part."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / shingles).cast("int").alias("k"))
    return members.join(sizes, "cluster").withColumn("chunk", F.pmod(F.hash("id", "digest"), "k"))


def part_links(rows: DataFrame, dealt: DataFrame, id_type: str, percent: int, most_broadcast: int, pairwise: bool) -> DataFrame:
    """Links within each part of (id, cluster, digest, known, chunk, k) members; ``pairwise``: between the parts of a cluster too."""
    texts = with_texts(rows, dealt.select("id", "cluster", "digest", "known", "chunk", "k"), most_broadcast)
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)) if pairwise else F.col("chunk")
    tasks = texts.withColumn("other", other).select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "digest", "known", "text")
    tasks = tasks.repartition(B.part_count(rows), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    return cut(tree_links(tasks, id_type, percent))


def mixed_buckets(now: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cluster, id, digest, n, known) of the buckets that hold sets of two or more components."""
    label = now.select("id", "known").distinct()
    told = cut(candidates.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst"))
    mixed = told.groupBy("dst").agg((F.least(F.min("a"), F.min("b")) < F.greatest(F.max("a"), F.max("b"))).alias("open")).where("open").select("dst")
    left = told.join(mixed, "dst")
    rows = left.select(F.col("dst").alias("cluster"), F.col("src").alias("id")).union(left.select("dst", "dst")).distinct()
    return cut(rows.join(now, "id"))


def bucket_links(rows: DataFrame, members: DataFrame, candidates: DataFrame, id_type: str, percent: int, chunk: int, large: int, most_broadcast: int) -> DataFrame:
    """(src, dst): links that connect exactly what chains of similar sets connect, among members (id, n, digest).

    ``candidates`` has (src, dst) for each set and the least set of each of its buckets; buckets with the same least set are one.
    """
    both = candidates.select(F.col("src").alias("id"), F.col("dst").alias("cluster")).union(candidates.select("dst", "dst"))
    home = both.groupBy("id").agg(F.min("cluster").alias("cluster"))
    unknown = F.concat(F.hex("digest"), F.col("id").cast("string")).alias("known")  # each set is a component of its own
    links = part_links(rows, cut(parts_of(members.join(home, "id"), chunk).select("*", unknown)), id_type, percent, most_broadcast, False)

    def known_now(links: DataFrame) -> DataFrame:
        label = connected_components(links).select(F.col("node").alias("id"), F.col("component").cast("string").alias("known"))
        return cut(members.join(label, "id", "left").withColumn("known", F.coalesce("known", F.col("id").cast("string"))))

    mixed = mixed_buckets(known_now(links), candidates)
    if mixed.isEmpty():
        return links
    heads = mixed.groupBy("cluster", "known").agg(F.min(F.struct("id", "digest", "n")).alias("h")).select("cluster", "known", "h.*")
    links = cut(links.union(part_links(rows, cut(parts_of(heads, large).where("k = 1")), id_type, percent, most_broadcast, False)))
    rest = mixed_buckets(known_now(links), candidates)
    if rest.isEmpty():
        return links
    return links.union(part_links(rows, cut(parts_of(rest, large)), id_type, percent, most_broadcast, True))


def join_documents(docs: DataFrame, percent: int = 75, hot_bits: int = 1 << 27, chunk: int = 100_000, large: int = 4_000_000, most_broadcast: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every document.

    ``hot_bits`` has no effect: the filter whose size it set is gone.
    """
    id_type = type_of(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own, edges, table = sketched(rows, percent, id_type)
    own = cut(own)
    real = own.where("id IS NOT NULL")
    classes = cut(real.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n")))
    by_node = cut(real.join(classes, "digest", "left").select("id", "node", "rep"))
    # documents whose rows hold different texts: their classes are one, under the document's own id
    several = cut(by_node.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("rep").alias("texts")).where("least < most OR (texts > 0 AND texts < n_rows)").select("id"))
    a, b = by_node.select(F.col("node").alias("u"), F.col("rep").alias("src")), by_node.select(F.col("node").alias("v"), F.col("rep").alias("dst"))
    candidates = cut(edges.join(a, "u").join(b, "v").where("src <> dst").select("src", "dst").distinct())
    release(table)
    ids = candidates.select(F.col("src").alias("id")).union(candidates.select("dst")).distinct()
    members = cut(ids.join(classes.select(F.col("rep").alias("id"), "n", "digest"), "id"))
    links = bucket_links(rows, members, candidates, id_type, percent, chunk, large, most_broadcast)
    of_several = by_node.where("rep IS NOT NULL").join(several, "id").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    found = connected_components(links.union(of_several)).select(F.col("node").alias("rep"), "component")
    labelled = cut(classes.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")))
    of_id = cut(found.join(several, F.col("rep") == F.col("id")).select("id", F.col("component").alias("of_id")))  # for their rows without words
    out = own.join(labelled, "digest", "left").join(of_id, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "of_id", "id")).alias("component_id"))
