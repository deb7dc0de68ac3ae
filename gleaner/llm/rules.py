"""Quality rules: one threshold table, compiled into one projection of built-in
functions over length, symbol, stop-word and line figures of a text.

Nulls and empty texts have no words, no symbols and no lines; they fail the base
rule. Very long texts are read whole. Ties and repeated rows get equal results.
Columns other than the text pass through untouched; clashing ones (figures,
base_failed, kept) are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, texts, words_of

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that for it as with was on are be by this from at or an "
    "le la les de des du et un une que qui dans pour par sur en au est pas avec "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch für "
    "el los las del y por con para una su al lo como más esta"
).split()

#: figure, its column as (numerator, denominator) names, least, most. A text that
#: lies outside any row of the table is not kept.
RULES = (
    ("words", "n_words", None, 20, 10_000_000),
    ("mean word length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols a word", "n_symbols", "n_words", 0.0, 0.25),
    ("exclamations a word", "n_exclaim", "n_words", 0.0, 0.3),
    ("stop words a word", "n_stop", "n_words", 0.03, 1.0),
    ("repeated lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def repeat_words(words: Column, size: int = 8) -> Column:
    """Words that lie in a window of `size` words found twice or more."""

    def covered(h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            near = lambda x, j: (x.getField("h") == F.get(s, j).getField("h"))
            same = F.filter(s, lambda x, k: F.coalesce(near(x, k - 1), F.lit(False)) | F.coalesce(near(x, k + 1), F.lit(False)))
            at = F.sort_array(F.transform(same, lambda x: x.getField("i")))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1_000_000).alias("end"))
            step = lambda a, i: F.struct((a["n"] + F.lit(size) - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + size).alias("end"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(rows, marked))

    # a word is hashed once, a window is the hash of its words' hashes: no window is held as a string
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), covered))


def figures(text: Column | str = "text") -> list[Column]:
    """The figures of a text, as columns over an array column `_words`."""
    t, w = text_of(text), F.col("_words")
    chars = F.length(F.array_join(w, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    as_long = lambda c, name: c.cast("long").alias(name)
    return [
        as_long(F.size(w), "n_words"),
        as_long(chars, "word_chars"),
        as_long(F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")), "n_symbols"),
        as_long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"),
        as_long(F.size(lines), "n_lines"),
        as_long(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))), "n_exclaim"),
        as_long(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))), "n_stop"),
        as_long(repeat_words(w), "n_repeat_words"),
    ]


def verdict(rules=RULES) -> Column:
    """All rows of the table as one condition; a ratio over zero passes."""
    ok = F.lit(True)
    for _, top, below, least, most in rules:
        x = F.col(top).cast("double")
        if below:
            x = F.when(F.col(below) > 0, x / F.col(below))
        ok = ok & F.coalesce(x.between(least, most), F.lit(True))
    return ok


def quality_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """df plus the figures, base_failed and kept."""
    named = [c for c in df.columns if c not in {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_exclaim", "n_stop", "n_repeat_words", "base_failed", "kept", "_words"}]
    x = df.withColumn("_words", words_of(text)).select(*named, *figures(text))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return x.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaim", "n_stop", "n_lines", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = " AND ".join(f"coalesce(CAST({t} AS DOUBLE) BETWEEN {lo} AND {hi}, true)" if not b else f"coalesce((CASE WHEN {b} > 0 THEN CAST({t} AS DOUBLE) / {b} END) BETWEEN {lo} AND {hi}, true)" for _, t, b, lo, hi in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) > 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS k FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaim,
 CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop, CAST(len(l) AS BIGINT) AS n_lines
 FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT *, (NOT base_failed AND {rules}) AS kept FROM b"""


QUERIES = {"op3_rules": op3_rules}
ORACLES = {"op3_rules": _sql()}
