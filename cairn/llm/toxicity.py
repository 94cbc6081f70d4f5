"""Toxicity by weak supervision.

1. Voters. A lexicon is induced from the labelled rows outside the held-out fold:
   whole words and word beginnings that toxic documents have and others lack, each
   a voter of its own; general insult lists and writing patterns add more voters.
2. A generative label model sees only the votes of a bounded sample. Each voter
   has a vote distribution per class; labelled rows anchor the classes, all other
   rows are soft-assigned by expectation maximisation. Correlations are estimated
   from the votes' residuals given the class: voters whose residuals correlate
   form a group, and each vote counts 1 / (group share) of its log-likelihood.
3. A linear classifier is trained on the posterior labels, over voter counts and
   text shape, and scores every document in one narrow pass without a shuffle.

Samples (``n_labelled``, ``n_unlabelled`` expected documents by a hash of the id, each
id once) and the lexicon (``n_voters``) are bounded parameters; scoring covers all
rows and whole texts. A null text counts as empty and gets a score; a null id is scored, never
held out, never sampled; null labels are ignored, of several labels of an id the
largest counts; repeated rows are scored each;
with too few labels of either kind the general lists vote alone; other columns are
ignored or, where asked for, kept in a struct, so no name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import fold_is, give_back, small_batches, thrifty
from cairn.llm.linear import Linear, fit_logistic
from cairn.llm.pretoken import Memo
from cairn.llm.quality import labelled_sample, sampled_texts
from cairn.llm.style import N_SHAPE, describe

# General insults, by language.
GENERAL = {
    "en": "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown garbage imbecile filth vermin".split(),
    "fr": "idiot imbécile crétin connard ordure salaud minable stupide débile".split(),
    "de": "idiot dummkopf trottel arschloch abschaum schwachkopf widerlich erbärmlich".split(),
    "es": "idiota imbécil estúpido basura escoria patético asqueroso payaso".split(),
}
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¿¡«»“”„…"
#: e^-14 for each key: among millions of keys less than a handful pass by chance.
LEAST_EVIDENCE = 14.0
#: A key is a voter only if at least this share of its labelled documents is toxic.
LEAST_SHARE = 0.75
#: Labelled rows of either kind; with fewer the general lists vote alone.
LEAST_LABELS = 10
PREFIXES = (3, 4, 5, 6, 7, 8)


def normal(word: str) -> str:
    return word.strip(_EDGE)


def keys_of(word: str) -> list[str]:
    """The lexicon keys a word may match: itself and its beginnings."""
    w = normal(word)
    return ["w:" + w, *("p:" + w[:k] for k in PREFIXES if len(w) > k)] if w else []


def count_keys(rows: DataFrame) -> DataFrame:
    """(key, label) -> number of documents, from (label, text) rows; counted per task before the shuffle."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            flat = [(k, i, n) for i in (0, 1) for k, n in counts[i].items()]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.int64())], names=["key", "label", "n"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for word in set((text or "").lower().split()):
                    found.update(keys_of(word))
                counts[1 if label else 0].update(found)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(thrifty(run), "key string, label int, n long").groupBy("key").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"))


def induced(rows: DataFrame, most: int) -> tuple[list[str], dict[int, int]]:
    """Up to ``most`` keys that mark toxic rows, strongest first, no one of them the beginning of another."""
    sizes = {int(r[0]): int(r[1]) for r in rows.groupBy("label_value").count().collect()}
    n1, n0 = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if n1 < LEAST_LABELS or n0 < LEAST_LABELS:
        return [], sizes
    # evidence (nats) that a key's documents are toxic more often than others, by the Chernoff bound
    base = n1 / (n1 + n0)
    n, share = F.col("n1") + F.col("n0"), F.col("n1") / (F.col("n1") + F.col("n0"))
    evidence = F.col("n1") * F.log(share / base) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strongest = (
        count_keys(rows.select("label_value", "text"))
        .where((n >= 3) & (share > F.lit(LEAST_SHARE)))
        .withColumn("weight", evidence)
        .where(F.col("weight") >= LEAST_EVIDENCE)
        .orderBy(F.desc("weight"), F.desc(F.length("key")), "key")
        .limit(24 * most)
        .collect()
    )
    kept: list[str] = []
    for row in strongest:
        key = row["key"]
        body = key[2:]
        if any(body.startswith(k[2:]) or k[2:].startswith(body) for k in kept):
            continue
        kept.append(key)
        if len(kept) == most:
            break
    return kept, sizes


class Voters:
    """Counts lexicon hits and reads patterns off a text."""

    def __init__(self, keys: list[str]):
        general = {w for words in GENERAL.values() for w in words}
        self.keys = keys
        self.index = {k: i for i, k in enumerate(keys)}
        self.general = frozenset(general)
        self.n_lexicon = len(keys) + 1
        self.cache = Memo(self.match)
        self.names = [*keys, "general list", "any lexicon", "some lexicon", "much lexicon", "dense lexicon", "shouting", "bangs", "symbols"]

    def match(self, word: str) -> tuple[int, ...]:
        hits = [self.index[k] for k in keys_of(word) if k in self.index]
        if normal(word) in self.general:
            hits.append(self.n_lexicon - 1)
        return tuple(hits)

    def features(self, text: str | None) -> np.ndarray:
        """Lexicon counts (log), total hits, hit rate, then text shape."""
        words = (text or "").lower().split()
        counts = np.zeros(self.n_lexicon, dtype=np.float32)
        total = 0
        for hits in filter(None, map(self.cache.__getitem__, words)):
            total += 1
            for i in hits:
                counts[i] += 1
        out = np.empty(self.n_lexicon + 2 + N_SHAPE, dtype=np.float32)
        out[: self.n_lexicon] = np.log1p(counts)
        out[self.n_lexicon] = math.log1p(total)
        out[self.n_lexicon + 1] = min(1.0, 20.0 * total / max(1, len(words)))
        out[self.n_lexicon + 2 :] = describe(text)[-N_SHAPE:]
        return out

    def votes(self, x: np.ndarray) -> np.ndarray:
        """1: toxic, -1: clean, 0: abstains; columns as ``names``."""
        n = self.n_lexicon
        shape = x[:, n + 2 :]
        columns = [
            (x[:, :n] > 0).astype(np.int8),
            np.where(x[:, n] > 0, 1, -1)[:, None],
            np.where(x[:, n] > math.log(2.5), 1, 0)[:, None],
            np.where(x[:, n] > math.log(4.5), 1, 0)[:, None],
            np.where(x[:, n + 1] > 0.1, 1, 0)[:, None],
            np.where(shape[:, 5] > 0.5, 1, 0)[:, None],
            np.where(shape[:, 7] > 0.8, 1, 0)[:, None],
            np.where(shape[:, 6] > 0.5, 1, 0)[:, None],
        ]
        return np.concatenate(columns, axis=1).astype(np.int8)


class LabelModel:
    """Vote distributions per class with correlation groups, fitted by semi-supervised EM."""

    def fit(self, votes: np.ndarray, known: np.ndarray, rounds: int = 25, link: float = 0.5) -> LabelModel:
        """``known``: 1 or 0 where labelled, -1 elsewhere."""
        anchored = known >= 0
        prior = np.clip(known[anchored].mean() if anchored.any() else 0.1, 0.005, 0.995)
        q = np.where(anchored, known, prior).astype(float)
        if not anchored.any():
            q = np.where(votes.sum(axis=1) > 0, 0.9, 0.05)
        one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        self.share = np.ones(votes.shape[1])
        for step in range(rounds):
            n1, n0 = q.sum(), (1 - q).sum()
            self.prior = float(np.clip(n1 / len(q), 0.005, 0.995))
            self.p1 = (np.einsum("i,ijk->jk", q, one_hot) + 0.1) / (n1 + 0.3)
            self.p0 = (np.einsum("i,ijk->jk", 1 - q, one_hot) + 0.1) / (n0 + 0.3)
            if step == rounds // 2:
                self.share = self.group(votes, q, link)
            q = np.where(anchored, known, self.posterior(votes))
        return self

    @staticmethod
    def group(votes: np.ndarray, q: np.ndarray, link: float) -> np.ndarray:
        """1 / size of each voter's group of voters that stay correlated given the class."""
        rest = votes.astype(float)
        for weight in (q, 1 - q):
            if weight.sum() > 0:
                rest = rest - np.outer(weight, (weight @ votes) / weight.sum())
        spread = rest.std(axis=0)
        safe = np.where(spread > 1e-9, spread, 1.0)
        correlation = (rest.T @ rest) / len(rest) / np.outer(safe, safe) - np.outer(rest.mean(0), rest.mean(0)) / np.outer(safe, safe)
        close = np.abs(correlation) >= link
        np.fill_diagonal(close, True)
        return 1.0 / close.sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = votes.astype(int) + 1
        columns = np.arange(votes.shape[1])
        odds = (np.log(self.p1[columns, at]) - np.log(self.p0[columns, at])) * self.share
        z = odds.sum(axis=1) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def feature_rows(rows: DataFrame, voters: Voters, keep: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(voters.keys)
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(shared.value)
        for batch in batches:
            if batch.num_rows:
                x = [own.features(t).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=[keep, "x"])

    return rows.mapInArrow(thrifty(run), f"`{keep}` int, x binary")


def train(docs: DataFrame, labels: DataFrame, n_labelled: int, n_unlabelled: int, n_voters: int, fold: tuple[int, int], id_col: str, text_col: str) -> tuple[Voters, Linear | None]:
    known = labelled_sample(labels, "toxic", None, n_labelled, fold, id_col)
    picked = sampled_texts(docs, known, min(1.0, n_unlabelled / max(1, docs.count())), 5, id_col, text_col)
    picked = picked.select(F.coalesce(F.col("label_value").cast("int"), F.lit(-1)).alias("label_value"), F.col("__text").alias("text"))
    picked = picked.persist()  # a bounded sample, used twice
    try:
        keys, sizes = induced(picked.where("label_value >= 0"), n_voters)
        voters = Voters(keys)
        rows = feature_rows(picked, voters, "label_value").toPandas()
    finally:
        picked.unpersist()
    if rows.empty or min(sizes.get(1, 0), sizes.get(0, 0)) < LEAST_LABELS:
        return voters, None
    x = np.frombuffer(b"".join(rows.x), dtype=np.float32).reshape(len(rows), -1)
    label = rows.label_value.to_numpy()
    votes = voters.votes(x)
    model = LabelModel().fit(votes, label)
    return voters, fit_logistic(x, model.posterior(votes), epochs=60)


def scored(docs: DataFrame, labels: DataFrame, columns: list[str], n_labelled: int = 12000, n_unlabelled: int = 8000, n_voters: int = 64, fold: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__row, __score): a struct of the named columns of every document, and its score."""
    voters, model = train(docs, labels, n_labelled, n_unlabelled, n_voters, fold, id_col, text_col)
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast((voters.keys, model))  # a few thousand numbers
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fitted = shared.value
        own = Voters(keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([own.features(t) for t in batch.column(1).to_pylist()])
            scores = fitted.score(x) if fitted else np.where(x[:, own.n_lexicon] > 0, 0.9, 0.05)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(float))], names=["__row", "__score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return rows.mapInArrow(thrifty(run), T.StructType([rows.schema["__row"], T.StructField("__score", T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (4, 2), threshold: float = 0.3, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    own = scored(docs, labels, [id_col], fold=fold, id_col=id_col, **options).select("__row.*", "__score")
    return own.select(id_col, fold_is(id_col, *fold).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents with a score under the threshold, with all their own columns."""
    return scored(docs, labels, docs.columns, **options).where(F.col("__score") < threshold).select("__row.*")
