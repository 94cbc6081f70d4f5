"""Every operator on odd tables: id types, clashing columns, repeated ids, very long texts, ties, nothing at all."""

import random
from decimal import Decimal

import public_tokenizers as P
import pytest
from cairn.llm import bpe, chat, decontaminate, jaccard_join, ngram_lm, quality, rules, token_counts, toxicity
from cairn.llm.common import without
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LABELS = "doc_id long, quality int, toxic int"


def texts(n=12):
    rng = random.Random(2)
    out = [" ".join(rng.choices([w + str(rng.randrange(99)) for w in WORDS], k=60)) for _ in range(n)]
    return [*out, out[0], out[1] + " tail", "", None]


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], LABELS)
    items = spark.createDataFrame([(1, " ".join(texts()[3].split()[:20]))], "item_id long, text string")
    return {
        "op1": lambda df: quality.score_quality(df, labels),
        "op2": ngram_lm.score_texts,
        "op3": rules.judge,
        "op6": jaccard_join.join_documents,
        "op7": lambda df: bpe.digests(bpe.encode_decode(df, RANKS, P.PATTERN)),
        "op8": lambda df: decontaminate.find_leaks(df, items),
        "op9": lambda df: toxicity.score_toxicity(df, labels),
        "op10": lambda df: token_counts.count_tokens(df, JSON, P.PATTERN),
    }


OPS = ["op1", "op10", "op2", "op3", "op6", "op7", "op8", "op9"]
TYPES = {"int": int, "smallint": int, "string": str, "decimal(20,2)": Decimal, "date": lambda i: __import__("datetime").date(2020, 1, 1 + i)}


@pytest.mark.parametrize("kind", sorted(TYPES))
@pytest.mark.parametrize("op", OPS)
def test_any_id_type(spark, op, kind):
    if kind == "date" and op in ("op1", "op9"):
        pytest.skip("labels have numbers as ids")
    make = TYPES[kind]
    rows = [(make(i), t) for i, t in enumerate(texts())] + [(None, "no id")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = operators(spark)[op](df)
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    found = {r.doc_id: r for r in got.collect()}
    if op == "op8":
        assert set(found) == {make(3)}
    else:
        assert set(found) == {i for i, _ in rows}
    if op == "op6":
        assert found[make(12)].component_id == make(0) and found[make(13)].component_id == min(make(1), make(13)) and found[None].component_id is None


@pytest.mark.parametrize("op", OPS)
def test_clashing_columns_and_no_rows(spark, op):
    run = operators(spark)[op]
    plain = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    names = [c for c in run(plain).columns if c not in ("doc_id", "text")]
    names = sorted({*names, "id", "doc", "item", "t", "sh", "w", "node", "rep", "n", "k", "chunk", "hash", "label_value", "x", "train", "lang"})
    clash = plain.select("*", *(F.lit("clash").alias(c) for c in names))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(run(clash)) == order(run(plain))
    assert run(clash.limit(0)).count() == 0


@pytest.mark.parametrize("op", OPS)
def test_very_long_texts(spark, op):
    rng = random.Random(4)
    long = " ".join(rng.choices(WORDS, k=1_700_000))  # 10 MB
    one_word, spaces = "a" * 3_000_000, " " * 5_000_000
    df = spark.createDataFrame([(1, long), (2, one_word), (3, spaces), (4, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in operators(spark)[op](df).collect()}
    if op != "op8":
        assert set(got) == {1, 2, 3, 4}
    if op == "op6":
        assert got[4].component_id == 1 and got[3].n_shingles == 0
    if op == "op10":
        assert got[1].n_bytes == len(long) and got[1].n_tokens == got[4].n_tokens
    if op == "op3":
        assert got[1].n_words == 1_700_000


def test_repeated_ids_are_one_document(spark):
    a, b, c = texts()[:3]
    rows = [(5, a), (5, b), (2, a), (3, b), (7, c), (7, None), (7, c), (8, c + " end"), (9, ""), (9, "")]
    got = jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 2), (2, 2), (3, 2), (7, 7), (8, 7), (9, 9)}
    assert sorted(r.n_shingles for r in got if r.doc_id == 7) == [0, 56, 56]


def test_samples_hold_an_id_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(i, "other") for i in range(2, 30)] + [(None, "lost")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)] * 40 + [(2, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], LABELS)
    known = quality.labelled_sample(labels, "quality", None, 100, (3, 1))
    assert {(r["__id"], r.label_value) for r in known.collect()} <= {(1, 1), (2, 1)}
    picked = quality.sampled_texts(docs, known, 1.0, 2, "doc_id", "text")
    assert picked.count() == 29
    assert quality.sampled_texts(docs, known, 0.0, 2, "doc_id", "text").count() == known.count()


@pytest.mark.parametrize("most", [0, 100])
def test_without(spark, most):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k long, v string")
    got = without(rows, spark.createDataFrame([(2,), (2,), (None,)], "other long"), "k", most)
    assert sorted((r.k or 0, r.v) for r in got.collect()) == [(0, "c"), (1, "a")]


@pytest.mark.parametrize("most", [0, 1000])
def test_leaks_of_every_size_class(spark, most):
    rng = random.Random(6)
    item = {k: " ".join(f"i{k}w{j}" for j in range(k)) for k in (1, 4, 5, 6, 9, 17, 40, 200, 1500)}
    rows, want = [], set()
    for n, (k, text) in enumerate(item.items()):
        filler = " ".join(rng.choices(WORDS, k=400))
        words = text.split()
        rows += [(2 * n, text if k < 5 else f"{filler} {text.upper()} {filler}"), (2 * n + 1, f"{filler} {' '.join(words[: k // 2])} {filler}")]
        want.add((2 * n, k))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(item.items()), "item_id long, text string"), most_broadcast=most)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_pipeline_stages_on_odd_tables(spark, sf):
    import corpus_pipeline

    names = [c for c in spark.read.parquet(f"{sf}/documents.parquet").columns if c not in ("doc_id", "text")]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 AND toxic = 0 AND n_chars > 1500").orderBy("doc_id").limit(4).collect()]
    rows = [(1, good[0]), (1, good[0]), (2, good[0] + " tail"), (3, good[1]), (3, good[2]), (None, good[3]), (None, f"{good[3]} {bench} {good[3]}"), (4, None), (5, ""), (5, ""), (6, f"{good[1][:900]} {bench}")]
    df = spark.createDataFrame(rows, "doc_id int, text string").select("*", *(F.lit(None).cast("string").alias(c) for c in names), *(F.lit("x").alias(c) for c in ("score", "held_out", "predicted", "kept", "n_words", "component_id", "item_id", "n_shared", "h", "row", "count", "label_value")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, sf)
        assert got.columns == df.columns, name
        assert stage(spark, df.limit(0), sf).count() == 0
        kept = [(r.doc_id, r.text) for r in got.collect()]
        assert set(kept) <= set(rows)
        if name == "toxicity":
            assert sorted(map(str, kept)) == sorted(map(str, rows))
        elif name == "quality_rules":
            assert not any(not t for _, t in kept) and (1, good[0]) in kept
        elif name == "ngram_jaccard_join":
            assert sorted(str(i) for i, _ in kept) == sorted(["1", "3", "4", "5", "6", "None", "None"])
        else:
            assert len(kept) == len(rows) - 2 and not any(bench in (t or "") for _, t in kept)
    last = corpus_pipeline.encode(spark, df, sf)
    assert last.count() == len(rows) and corpus_pipeline.encode(spark, df.limit(0), sf).count() == 0


def test_chat_ties_and_long_texts(spark):
    long = "x" * 10_000_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "y"), (3, 0, "user", "b"), (3, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "user", "b")]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.collapse_and_render(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {2: (2, 1), 3: (2, 2)}


def test_vocabularies_that_are_not_handled():
    import json

    spec = json.load(open(JSON))
    token_counts.refuse_unknown(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "x", "special": False}]}):
        with pytest.raises(ValueError):
            token_counts.refuse_unknown(spec | change)
