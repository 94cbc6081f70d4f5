"""Distances and verdicts of the quality rules, and the pipeline's filters, against brute force over a whole table."""

import math
import re
from collections import Counter

import pytest
import regex
from cairn.llm import rules
from cairn.llm.queries import QUERIES

KINDS = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}")


def divergence(p, q):
    """Jensen-Shannon distance, base 2."""
    out = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0.0) + (b * math.log2(b / m) if b else 0.0)
    return math.sqrt(max(out / 2, 0.0))


def described(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    joined = "".join(words)
    lower, upper, digits = (len(regex.findall(k, joined)) for k in KINDS)
    symbols, marks = len(re.findall(r"[#*$%&|<>]", text)), len(re.findall(r"[.,;:!?'\"()-]", joined))
    classes = [lower, upper, digits, symbols, marks, max(0, len(joined) - lower - upper - digits - symbols - marks)]
    hits = Counter(w.lower() for w in words if w.lower() in set(rules.BINS))
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), len(joined), classes, hits, failed


def test_distances_and_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    all_ = {r.doc_id: (r.lang if r.lang in rules.COMMON else rules.OTHER, *described(r.text or "")) for r in docs}
    chars, bins, totals = {}, {}, Counter()
    for lang, n, size, classes, hits, _ in all_.values():
        if n >= 50 and classes[3] * 50 <= size and classes[1] * 4 <= size:
            chars[lang] = [a + b for a, b in zip(chars.get(lang, [0] * 6), classes, strict=True)]
            bins.setdefault(lang, Counter()).update(hits)
            totals[lang] += n
    references = {k: ([c / sum(chars[k]) for c in chars[k]], [bins[k][b] / totals[k] for b in rules.BINS] + [(totals[k] - sum(bins[k].values())) / totals[k]]) for k in chars}
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, sf).collect()}
    assert set(got) == set(all_)
    for i, (_, n, size, classes, hits, failed) in all_.items():
        r = got[i]
        own_chars = [c / max(1, size) for c in classes]
        own_bins = [hits[b] / max(1, n) for b in rules.BINS] + [(n - sum(hits.values())) / max(1, n)]
        by_char = min(divergence(own_chars, c) for c, _ in references.values())
        by_word = min(divergence(own_bins, b) for _, b in references.values())
        assert r.char_distance == pytest.approx(by_char, abs=1e-9)
        assert r.word_distance == pytest.approx(by_word, abs=1e-9)
        most = 0.45 if n >= 100 else 0.60
        if abs(by_char + by_word - most) > 1e-9:
            assert r.kept == (not failed and by_char + by_word <= most)


def test_pipeline_filters_follow_their_operators(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in QUERIES["op9_toxicity"](spark, sf).collect() if r.score < 0.3}
    kept = {r.doc_id for r in corpus_pipeline.reject_low_quality(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in QUERIES["op3_quality_rules"](spark, sf).collect() if r.kept}
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in QUERIES["op6_ngram_jaccard_join"](spark, sf).collect() if r.doc_id == r.component_id}
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r.doc_id for r in QUERIES["op8_benchmark_decontamination"](spark, sf).collect()}
