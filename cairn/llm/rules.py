"""Quality rules with a distribution check, in DataFrame operations only.

Base rules: at least 50 words, and at most half of the words inside three-word
windows that the text repeats. Distribution rules: the text's character classes
and its common words are compared with language references by Jensen-Shannon
distance, and a text far from every reference is rejected: the distances to the
nearest reference of each kind may sum to ``max_divergence``. References are sums
over the whole table, one per language that has a common-word list and one for all
other languages; texts with many symbols or capitals are left out of them, other junk is in
them, so they describe the corpus as it is and not clean text alone. Guard: the histograms of texts under ``min_words`` words are thin, so
these are held to ``short_divergence`` only (and under 50 words the base rules decide).

Two narrow passes over the text and one tiny aggregation; no text is shuffled.
Null texts have no words and fail the base rules; a null lang counts as another
language; a null id is carried through; repeated rows are judged each; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.sqltext import SPACES, window_hashes, words

# The most common short words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his this".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par pas sur au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
}
BINS = sorted({w for ws in COMMON.values() for w in ws})
OTHER = "other"
CLASSES = ("n_lower", "n_upper", "n_digits", "n_symbols", "n_marks", "n_rest")
SYMBOLS = "#*$%&|<>"


def base_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to the rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__w", words(F.col(text_col).cast("string"))).withColumn("__h", window_hashes("__w", 3))
    # sorted hashes: equal neighbours are repeated windows
    rows = rows.withColumn("__s", F.sort_array("__h")).withColumn("__d", F.expr("array_distinct(filter(__s, (x, i) -> i > 0 AND x = get(__s, i - 1)))"))
    few = "filter(sequence(0, size(__h) - 1), i -> array_contains(__d, get(__h, i)))"
    rows = rows.withColumn("__t", F.expr("CASE WHEN size(__d) > 64 THEN sort_array(transform(__h, (h, i) -> struct(h AS h, i AS i))) END"))
    many = "sort_array(transform(filter(__t, (x, i) -> coalesce(x.h = get(__t, i - 1).h, false) OR coalesce(x.h = get(__t, i + 1).h, false)), x -> x.i))"
    rows = rows.withColumn("__p", F.expr(f"CASE WHEN size(__d) = 0 THEN CAST(array() AS array<int>) WHEN size(__d) <= 64 THEN {few} ELSE {many} END"))
    covered = "aggregate(__p, struct(-1 AS last, 0L AS c), (a, p) -> struct(p + 2 AS last, a.c + p + 2 - greatest(a.last, p - 1) AS c), a -> a.c)"
    lines = F.expr(f"filter(split(coalesce(CAST(`{text_col}` AS string), ''), '\n', -1), x -> btrim(x, '{SPACES}') <> '')")
    rows = rows.withColumn("__l", lines)
    return rows.select(
        *docs.columns,
        F.col("__w"),
        F.array_join("__w", "").alias("__j"),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
    ).withColumn("word_chars", F.length("__j").cast("long"))


def histograms(rows: DataFrame) -> DataFrame:
    """Add the character classes and __hits, the bins (from 1) of the common words in the text."""
    bins = ", ".join("'" + b + "'" for b in BINS)
    longest = max(len(b.encode()) for b in BINS)
    rest = rows.withColumn("__r", F.regexp_replace("__j", r"\p{Ll}+", ""))
    rest = rest.withColumn("n_upper", F.length("__r") - F.length(F.regexp_replace("__r", r"\p{Lu}+", "")))
    rest = rest.withColumn("n_digits", F.length(F.regexp_replace("__r", r"[^\p{Nd}]+", "")))
    rest = rest.withColumn("n_marks", F.length(F.regexp_replace("__r", r"[^.,;:!?'\"()-]+", "")))
    rest = rest.withColumn("n_lower", F.col("word_chars") - F.length("__r"))
    rest = rest.withColumn("n_rest", F.greatest(F.length("__r") - F.col("n_upper") - F.col("n_digits") - F.col("n_marks") - F.col("n_symbols"), F.lit(0)))
    return rest.withColumn("__hits", F.expr(f"filter(transform(filter(__w, w -> octet_length(w) <= {longest}), w -> array_position(array({bins}), lower(w))), p -> p > 0)"))


def language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise(OTHER)


def references(rows: DataFrame, lang_col: str, least_words: int) -> dict[str, tuple[list[float], list[float]]]:
    """Per language: shares of the character classes, and of the common-word bins with all other words last.

    Summed over all texts of ``least_words`` words or more in which symbols are at most 2 % and capitals at most 25 %.

    A few hundred sums reach the driver, whatever the corpus.
    """
    # conditions stand inside expressions, not in filters: the optimiser would push a filter down through every definition above
    plain = (F.col("n_words") >= least_words) & (F.col("n_symbols") * 50 <= F.col("word_chars")) & (F.col("n_upper") * 4 <= F.col("word_chars"))
    own = histograms(rows).withColumn("__ok", plain)
    long_enough = own.select(language(F.col(lang_col)).alias("__lang"), *(F.when(F.col("__ok"), F.col(c)).alias(c) for c in ("n_words", *CLASSES, "__hits")))
    # a row for each common word of a text; the text's own sums stand on the first
    hits = long_enough.select("__lang", "n_words", *CLASSES, F.posexplode_outer("__hits").alias("at", "bin"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    sums = hits.groupBy("__lang", "bin").agg(F.count("bin").alias("n"), *(F.sum(F.when(first, F.col(c))).cast("double").alias(c) for c in (*CLASSES, "n_words"))).collect()
    out = {}
    for lang in {row["__lang"] for row in sums}:
        own = [row for row in sums if row["__lang"] == lang]
        chars = [sum(row[c] or 0.0 for row in own) for c in CLASSES]
        bins = [0.0] * len(BINS)
        for row in own:
            if row["bin"]:
                bins[row["bin"] - 1] = float(row["n"])
        bins.append(max(0.0, sum(row["n_words"] or 0.0 for row in own) - sum(bins)))
        if sum(chars) and sum(bins):
            out[lang] = ([c / sum(chars) for c in chars], [b / sum(bins) for b in bins])
    return out


def char_distance(reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) between the row's character classes and a reference."""
    total = F.lit(0.0)
    for name, q in zip(CLASSES, reference, strict=True):
        p = F.col(name) / F.col("__n")
        m = (p + F.lit(q)) / 2
        total = total + F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        if q > 0:
            total = total + q * F.log2(F.lit(q) / m)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def word_distance(reference: list[float]) -> Column:
    """The same for the common-word bins, from the bins that the row has: __k holds (bin, share)."""
    values = "array(" + ", ".join(f"{q!r}D" for q in reference) + ")"
    term = f"""aggregate(__k, struct(0.0D AS d, 0.0D AS q), (a, s) -> struct(
        a.d + s.p * log2(s.p / ((s.p + {values}[s.b]) / 2)) + CASE WHEN {values}[s.b] > 0 THEN {values}[s.b] * log2({values}[s.b] / ((s.p + {values}[s.b]) / 2)) ELSE 0.0D END AS d,
        a.q + {values}[s.b] AS q), a -> sqrt(greatest((a.d + greatest(1.0D - a.q, 0.0D)) / 2, 0.0D)))"""
    return F.expr(" ".join(term.split()))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def judged(docs: DataFrame, columns: list[str], min_words: int = 100, max_divergence: float = 0.45, short_divergence: float = 0.60, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """MEASURES for every row, and __row, a struct of the named columns (so no name can clash)."""
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__text"), lang.alias("__lang_of"))
    counted = base_counts(own, "__text")
    known = references(counted, "__lang_of", 50)
    rows = histograms(counted).withColumn("__n", F.greatest(F.col("word_chars"), F.lit(1)).cast("double"))
    rows = rows.withColumn("__k", F.expr("transform(array_distinct(__hits), k -> struct(CAST(k - 1 AS int) AS b, size(filter(__hits, x -> x = k)) / CAST(n_words AS double) AS p))"))
    others = f"struct({len(BINS)} AS b, (n_words - size(__hits)) / CAST(greatest(n_words, 1) AS double) AS p)"
    rows = rows.withColumn("__k", F.expr(f"CASE WHEN n_words > size(__hits) THEN concat(__k, array({others})) ELSE __k END"))
    if known:
        chars = [char_distance(c) for c, _ in known.values()]
        bins = [word_distance(b) for _, b in known.values()]
        rows = rows.withColumn("char_distance", F.least(*chars) if len(chars) > 1 else chars[0]).withColumn("word_distance", F.least(*bins) if len(bins) > 1 else bins[0])
    else:
        rows = rows.withColumn("char_distance", F.lit(0.0)).withColumn("word_distance", F.lit(0.0))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    far = F.col("char_distance") + F.col("word_distance") > F.when(F.col("n_words") >= min_words, max_divergence).otherwise(short_divergence)
    measures = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "char_distance", "word_distance", (~failed & ~far).alias("kept"))
    # out of a generator: a filter on a measure is then not pushed down and spelled out through all definitions
    return rows.select("__row", F.explode_outer(F.array(measures)).alias("__m")).select("__row", "__m.*")


def judge(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, *MEASURES) for every row."""
    return judged(docs, [id_col], **options).select("__row.*", *MEASURES)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, with all their own columns."""
    return judged(docs, docs.columns, **options).where("kept").select("__row.*")
