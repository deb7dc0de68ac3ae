"""Words of a text, as built-in column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits, underscores and apostrophes: the same on every regex engine.
RUN = r"[\p{L}\p{Nd}_']+"
SHORTEST, LONGEST = 2, 45

#: Words that are not indexed unless a list of one's own is given (see read_stop_words).
STOP_WORDS = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him his how "
    "i if in into is it its just like me more most my no nor not now of off on once only or other our out over own same "
    "she should so some such than that the their them then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with would you your".split()
)

#: Weight of a word by the block it stands in; other blocks weigh 1.
WEIGHTS = {"title": 5.0, "h1": 4.0, "h2": 3.0, "h3": 2.5, "h4": 2.0, "h5": 1.8, "h6": 1.5}


def runs(text: Column) -> Column:
    """Lower-cased runs of word characters, apostrophes trimmed."""
    found = F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))
    return F.transform(found, lambda w: F.btrim(w, F.lit("'")))


def is_valid_word(w: Column, stop: Iterable[str] | None = STOP_WORDS) -> Column:
    """2 to 45 ASCII letters, and no stop word."""
    ok = F.length(w).between(SHORTEST, LONGEST) & w.rlike("^[a-zA-Z]+$")
    return ok & ~w.isin(sorted(stop)) if stop else ok


def tokens(text: Column, stop: Iterable[str] | None = STOP_WORDS) -> Column:
    """The words of a text that count, in order: array<string>."""
    return F.filter(runs(F.coalesce(text, F.lit(""))), lambda w: is_valid_word(w, stop))


def block_weight(tag: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in WEIGHTS.items():
        out = F.when(tag == name, weight).otherwise(out)
    return out


def document_blocks(text: Column) -> Column:
    """A plain text as blocks: its first line is the title, the rest a paragraph."""
    t = F.coalesce(text, F.lit(""))
    first = F.substring_index(t, "\n", 1)
    rest = F.substring(t, F.length(first) + 2, F.length(t))
    return F.array(F.struct(F.lit("title").alias("tag"), first.alias("text")), F.struct(F.lit("p").alias("tag"), rest.alias("text")))


def read_stop_words(spark, path: str) -> frozenset[str]:
    """One word a line; trimmed, lower-cased, blank lines skipped. Without the file
    there are none."""
    try:
        rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w != ''").limit(100_000).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return frozenset()
    return frozenset(r.w for r in rows)
