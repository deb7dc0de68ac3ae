"""Query strings to a small tree.

A query is one component, or two around the first operator found, looked for in the
order OR, AND, NOT (capitals, a space on both sides). A component in double quotes
is a phrase. Terms are lower-cased words between white space; punctuation stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.porter import stem_word
from ..functions.text import STOP_WORDS

OPERATORS = ("OR", "AND", "NOT")


@dataclass(frozen=True)
class Term:
    key: str  # what is looked up
    word: str  # as it was typed


@dataclass(frozen=True)
class Component:
    terms: tuple[Term, ...]
    phrase: bool = False


@dataclass(frozen=True)
class Both:
    op: str
    left: Component
    right: Component


def terms_of(text: str, stem: bool, drop_stop_words: bool = False) -> tuple[Term, ...]:
    """Distinct terms in query order."""
    out: dict[str, Term] = {}
    for w in text.lower().split():
        if drop_stop_words and w in STOP_WORDS:
            continue
        key = stem_word(w) if stem else w
        out.setdefault(key, Term(key, w))
    return tuple(out.values())


def component(text: str, stem: bool, drop_stop_words: bool = False) -> Component:
    text = text.strip()
    quoted = text.startswith('"') and text.endswith('"')
    return Component(terms_of(text.strip('"') if quoted else text, stem, drop_stop_words), quoted)


def parse(query: str | None, stem: bool = False, drop_stop_words: bool = False) -> Component | Both | None:
    """None for a blank query."""
    text = (query or "").strip()
    if not text:
        return None
    for op in OPERATORS:
        left, found, right = text.partition(f" {op} ")
        if found and left.strip() and right.strip():
            return Both(op, component(left, stem, drop_stop_words), component(right, stem, drop_stop_words))
    return component(text, stem, drop_stop_words)


def query_words(tree: Component | Both | None) -> list[Term]:
    """All terms, left then right, repeats kept."""
    if tree is None:
        return []
    if isinstance(tree, Both):
        return [*tree.left.terms, *tree.right.terms]
    return list(tree.terms)
