"""Snippets: page text, a window around the first query word, highlighting."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Replacements that turn HTML into plain text, in this order (pattern, replacement;
#: fixed values).
CLEANING = (
    (r"(?is)<script\b.*?</script>", " "),
    (r"(?is)<style\b.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"<[^>]+>", " "),
    ("&nbsp;|\u00A0", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&#[0-9]+;", " "),
    (r"&[a-zA-Z0-9#]+;", " "),
    (r"[\x00-\x08\x0B-\x1F\x7F]", ""),
    (r"\s*[\r\n]+\s*", " "),
    (r"\s*[.,!?]+\s*", ". "),
    (r"\.+", "."),
    (r"\s+", " "),
)
NO_PREVIEW = "No preview available for this result."
REACH, NARROW = 150, 100
#: A letter, digit or underscore: what a word may not border on to be whole.
INNER = r"[\p{L}\p{Nd}_]"


def replaced(text: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, *r), rules, text)


def clean_html(html: Column) -> Column:
    return F.trim(replaced(F.coalesce(html, F.lit("")), CLEANING))


def highlight(text: Column, words: list[str]) -> Column:
    """Whole words, in any case, wrapped in <strong>; all in one pass, so that marks
    aren't searched for words."""
    if not words:
        return text
    found = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, f"(?i)(?<!{INNER})(?:{found})(?!{INNER})", "<strong>$0</strong>")


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def snippet(text: Column, words: list[str]) -> Column:
    """The sentence around the first of the words that occurs (query order; the start
    of the text if none does), REACH characters each way at most. Where no word is in
    it, NARROW characters each way. Dots tell that text was left out. Places count
    from 0."""

    def place(t: Column) -> Column:
        low = F.lower(t)
        return F.coalesce(*(F.nullif(F.instr(low, w.lower()), F.lit(0)) - 1 for w in words), F.lit(0)) if words else F.lit(0)

    def part(t: Column, start: Column, end: Column) -> Column:
        return F.trim(F.substring(t, start + 1, end - start))

    def begin(t: Column, at: Column) -> Column:
        """The last end of a sentence in reach, or as far as that is."""
        near = F.greatest(at - REACH - 1, F.lit(0))
        head = F.substring(t, near + 1, at - near)
        return F.when(head.contains(". "), near + F.length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1))).otherwise(F.greatest(at - REACH, F.lit(0)))

    def finish(t: Column, at: Column) -> Column:
        stop = F.instr(F.substring(t, at + 1, F.lit(REACH + 1)), ". ")
        return F.when(stop > 0, at + stop + 1).otherwise(F.least(F.length(t), at + REACH))

    def shown(t: Column, at: Column, start: Column, end: Column) -> Column:
        body = part(t, start, end)
        has = reduce(lambda a, w: a | F.lower(body).contains(w.lower()), words, F.lit(False))
        low, high = F.greatest(at - NARROW, F.lit(0)), F.least(F.length(t), at + NARROW)
        kept = F.when(has, body).otherwise(part(t, low, high))
        kept = replaced(kept, ((r"\s+", " "), (r"\s*[.,!?]+\s*", ". "), (r"\.+", "."), (r"^[^a-zA-Z0-9]+", ""), (r"[^a-zA-Z0-9]+$", "")))
        more = F.when(has, end).otherwise(high) < F.length(t)
        dots = lambda c: F.when(c, F.lit("...")).otherwise(F.lit(""))
        return F.concat(dots(start > 0), highlight(kept, words), dots(more))

    def around(t: Column) -> Column:
        return _let(place(t), lambda at: _let(F.struct(begin(t, at).alias("a"), finish(t, at).alias("z")), lambda w: shown(t, at, w["a"], w["z"])))

    return F.coalesce(_let(text, lambda t: F.when(F.length(t) > 0, around(t))), F.lit(NO_PREVIEW))
