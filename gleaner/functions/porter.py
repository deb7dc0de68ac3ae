"""Porter's stemmer (Porter 1980, the author's later revision) as regular
expressions: a chain of CASE expressions.

A first step writes a consonant y as Y, so that a vowel is one of aeiouy and
measures are plain patterns; the last step writes it back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_V, _C = "[aeiouy]", "[^aeiouy]"
M0 = f"^{_C}*{_V}+{_C}"  # measure over 0
M1 = f"^{_C}*({_V}+{_C}+)({_V}+{_C})"  # over 1
ONE = f"^{_C}*{_V}+{_C}+{_V}*$"  # exactly 1
HAS_VOWEL = _V
CVC = f"{_C}{_V}[^aeiouywxY]$"
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|YY)$"  # but ll, ss, zz

STEP3 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP4 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP5 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def steps(matches: Callable[[str, str], str]) -> list[Callable[[str], str]]:
    """Each step as a function from the SQL of a word to the SQL of the next form;
    matches(x, pattern) is the engine's test."""

    def cut(x: str, n: int, tail: str = "") -> str:
        stem = f"left({x}, length({x}) - {n})"
        return f"({stem} || '{tail}')" if tail else stem

    def ends(x: str, tail: str) -> str:
        return f"right({x}, {len(tail)}) = '{tail}'"

    def ladder(x: str, rules: list[tuple[str, str, str]]) -> str:
        """(ending, pattern of the stem, new ending), longest endings first: the
        first ending that fits decides."""
        arms = "".join(f" WHEN {ends(x, a)} THEN CASE WHEN {matches(cut(x, len(a)), p)} THEN {cut(x, len(a), z)} ELSE {x} END" for a, p, z in rules)
        return f"CASE{arms} ELSE {x} END"

    pairs = lambda text, p: sorted(((a, p, z) for a, z in (r.split(":") for r in text.split())), key=lambda r: -len(r[0]))
    plural = lambda x: f"CASE WHEN {ends(x, 'sses')} OR {ends(x, 'ies')} THEN {cut(x, 2)} WHEN {ends(x, 'ss')} THEN {x} WHEN {ends(x, 's')} THEN {cut(x, 1)} ELSE {x} END"
    # a mark tells that ed or ing went, for the step after
    past = lambda x: (
        f"CASE WHEN {ends(x, 'eed')} THEN CASE WHEN {matches(cut(x, 3), M0)} THEN {cut(x, 1)} ELSE {x} END"
        f" WHEN {ends(x, 'ed')} AND {matches(cut(x, 2), HAS_VOWEL)} THEN {cut(x, 2, '*')}"
        f" WHEN {ends(x, 'ing')} AND {matches(cut(x, 3), HAS_VOWEL)} THEN {cut(x, 3, '*')} ELSE {x} END"
    )
    mend = lambda x: (
        f"CASE WHEN right({x}, 1) <> '*' THEN {x} WHEN {matches(cut(x, 1), '(at|bl|iz)$')} THEN {cut(x, 1, 'e')}"
        f" WHEN {matches(cut(x, 1), DOUBLED)} THEN {cut(x, 2)}"
        f" WHEN {matches(cut(x, 1), ONE)} AND {matches(cut(x, 1), CVC)} THEN {cut(x, 1, 'e')} ELSE {cut(x, 1)} END"
    )
    last_y = lambda x: f"CASE WHEN lower(right({x}, 1)) = 'y' AND {matches(cut(x, 1), HAS_VOWEL)} THEN {cut(x, 1, 'i')} ELSE {x} END"

    def fifth(x: str) -> str:
        arms = ""
        for a in sorted(STEP5.split(), key=lambda a: -len(a)):
            more = f" AND {matches(cut(x, 3), '[st]$')}" if a == "ion" else ""
            arms += f" WHEN {ends(x, a)} THEN CASE WHEN {matches(cut(x, len(a)), M1)}{more} THEN {cut(x, len(a))} ELSE {x} END"
        return f"CASE{arms} ELSE {x} END"

    final_e = lambda x: (
        f"CASE WHEN right({x}, 1) = 'e' AND ({matches(cut(x, 1), M1)} OR ({matches(cut(x, 1), M0)} AND NOT {matches(cut(x, 1), CVC)})) THEN {cut(x, 1)} ELSE {x} END"
    )
    final_l = lambda x: f"CASE WHEN {ends(x, 'll')} AND {matches(cut(x, 1), M1)} THEN {cut(x, 1)} ELSE {x} END"
    return [plural, past, mend, last_y, lambda x: ladder(x, pairs(STEP3, M0)), lambda x: ladder(x, pairs(STEP4, M0)), fifth, final_e, final_l]


def stems(words: DataFrame, col: str = "word") -> DataFrame:
    """words plus stem. Meant for a vocabulary, where each word is stemmed once."""
    out = words.withColumn("_w", F.regexp_replace(F.regexp_replace(col, "^y", "Y"), "([aeiouy])y", "$1Y"))
    for step in steps(lambda x, p: f"regexp_like({x}, '{p}')"):
        out = out.withColumn("_w", F.expr(step("_w")))
    return out.withColumn("stem", F.when(F.length(col) > 2, F.lower("_w")).otherwise(F.col(col))).drop("_w")


def stem_text(text: str | None) -> str:
    """A text with every run of letters stemmed and all else as it was."""
    return re.sub("[A-Za-z]+", lambda m: stem_word(m[0]), text or "")


def stem_texts(df: DataFrame, col: str = "value") -> DataFrame:
    """df with a text column stemmed in place; each batch stems a word once."""
    at = df.columns.index(col)

    def run(it):
        known: dict[str, str] = {}
        for b in it:
            if len(known) > 200_000:
                known.clear()
            swap = lambda m: known.get(m[0]) or known.setdefault(m[0], stem_word(m[0]))
            new = pa.array([None if t is None else re.sub("[A-Za-z]+", swap, t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def stem_word(word: str) -> str:
    """One word on the driver (queries are short), by the same patterns."""
    w = word.lower()
    if len(w) <= 2:
        return w
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    has = lambda p, x: re.search(p, x) is not None
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    gone = ""
    if w.endswith("eed"):
        w = w[:-1] if has(M0, w[:-3]) else w
    else:
        for tail in ("ed", "ing"):
            if w.endswith(tail) and has(HAS_VOWEL, w[: -len(tail)]):
                w, gone = w[: -len(tail)], tail
                break
    if gone:
        if has("(at|bl|iz)$", w):
            w += "e"
        elif has(DOUBLED, w):
            w = w[:-1]
        elif has(ONE, w) and has(CVC, w):
            w += "e"
    if w[-1:].lower() == "y" and has(HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for text in (STEP3, STEP4):
        for a, z in sorted((r.split(":") for r in text.split()), key=lambda r: -len(r[0])):
            if w.endswith(a):
                w = w[: -len(a)] + z if has(M0, w[: -len(a)]) else w
                break
    for a in sorted(STEP5.split(), key=lambda a: -len(a)):
        if w.endswith(a):
            ok = has(M1, w[: -len(a)]) and (a != "ion" or has("[st]$", w[:-3]))
            w = w[: -len(a)] if ok else w
            break
    if w.endswith("e") and (has(M1, w[:-1]) or (has(M0, w[:-1]) and not has(CVC, w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and has(M1, w[:-1]):
        w = w[:-1]
    return w.lower()
