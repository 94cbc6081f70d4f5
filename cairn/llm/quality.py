"""Quality classification by positive-unlabelled learning.

Trusted positives (labels.quality = 1 outside the held-out fold) and unlabelled
web text train a linear model that minimises the non-negative unbiased risk; the
class prior is estimated from scores on samples that the scorer for it did not
see. Both samples are bounded (``n_positive``, ``n_unlabelled`` expected documents,
picked by a hash of the id, whatever the corpus size; an id counts once, however often it occurs); scoring covers every row
and whole texts in one narrow pass without a shuffle.

A null text counts as empty; empty texts get a score too. A null id is scored,
never held out and never sampled. Labels of rows with null quality are ignored;
of an id with several labels the largest counts, of an id with several texts the one of the least hash;
repeated rows are scored each; an empty documents or labels table gives an empty
result or a constant score of the prior 0.5; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fold_is, give_back, map_rows, type_of, uniform
from cairn.llm.linear import Linear, class_prior, fit_logistic, fit_pu
from cairn.llm.style import N_FEATURES, describe_all


def labelled_sample(labels: DataFrame, column: str, value: int | None, most: int, fold: tuple[int, int], id_col: str = "doc_id") -> DataFrame:
    """(__id, label_value): about ``most`` ids with a label outside the held-out fold, picked by a hash of the id."""
    rows = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull() & ~fold_is(id_col, *fold))
    if value is not None:
        rows = rows.where(F.col(column) == value)
    ids = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(column).alias("label_value"))
    return ids.where(uniform(F.col("__id"), 1) < min(1.0, most / max(1, ids.count())))


def sampled_texts(docs: DataFrame, known: DataFrame, share: float, salt: int, id_col: str, text_col: str) -> DataFrame:
    """(label_value, also, __text) of one text per id: all ids in ``known``, and a ``share`` of all ids (``also``) by a hash.

    Repeated ids are settled by partial aggregation, so a hot id reaches no task as more than one row a task.
    """
    own = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    also = uniform(F.col("__id"), salt) < share
    picked = own.join(F.broadcast(known), "__id", "left").where(F.col("label_value").isNotNull() | also)  # ``known`` is a bounded sample
    one = picked.groupBy("__id").agg(F.max("label_value").alias("label_value"), F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    return one.select("label_value", also.alias("also"), "__text")


def train(docs: DataFrame, labels: DataFrame, n_positive: int, n_unlabelled: int, fold: tuple[int, int], id_col: str, text_col: str) -> tuple[Linear | None, float]:
    known = labelled_sample(labels, "quality", 1, n_positive, fold, id_col)
    picked = sampled_texts(docs, known, min(1.0, n_unlabelled / max(1, docs.count())), 2, id_col, text_col)
    picked = picked.select(F.col("label_value").isNotNull().cast("int").alias("role"), "also", "__text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = describe_all(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in x], pa.binary())], names=["role", "also", "x"])

    rows = map_rows(picked, run, "role int, also boolean, x binary").toPandas()
    if rows.empty:
        return None, 0.5
    x = np.frombuffer(b"".join(rows.x), dtype=np.float32).reshape(-1, N_FEATURES)
    role, also = rows.role.to_numpy() == 1, rows.also.to_numpy(dtype=bool)
    positive, unlabelled = x[role], x[also | ~role]
    if len(positive) < 10 or len(unlabelled) < 10:
        return None, 0.5
    rng = np.random.default_rng(3)
    p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    p1, p2, u1, u2 = positive[p[::2]], positive[p[1::2]], unlabelled[u[::2]], unlabelled[u[1::2]]
    target = np.concatenate([np.ones(len(p1)), np.zeros(len(u1))])
    weight = np.concatenate([np.full(len(p1), 1 / len(p1)), np.full(len(u1), 1 / len(u1))])
    probe = fit_logistic(np.concatenate([p1, u1]), target, weight, epochs=20)
    prior = class_prior(probe.score(p2), probe.score(u2))
    return fit_pu(positive, unlabelled, prior), prior


def score_quality(docs: DataFrame, labels: DataFrame, n_positive: int = 6000, n_unlabelled: int = 12000, fold: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    model, prior = train(docs, labels, n_positive, n_unlabelled, fold, id_col, text_col)
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        fitted = shared.value
        scores = fitted.score(describe_all(texts)) if fitted else np.full(len(texts), prior)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(float))], names=[id_col, "score"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    scored = map_rows(rows, run, f"`{id_col}` {type_of(docs, id_col)}, score double")
    return scored.select(id_col, fold_is(id_col, *fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
