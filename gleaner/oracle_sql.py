"""DuckDB counterparts that share no table, pattern or step with the code they check:
stems, page text, snippets, highlighting and HTML blocks, each worked out another way."""

from __future__ import annotations

# ---- Porter's stemmer, over the shape of a word -----------------------------------
#
# shape: c or v for each letter. Rules are rows, and the longest ending that fits decides.

PORTER_RULES = """
rules(step, ending, new) AS (VALUES
 (3, 'ational', 'ate'), (3, 'tional', 'tion'), (3, 'enci', 'ence'), (3, 'anci', 'ance'), (3, 'izer', 'ize'),
 (3, 'bli', 'ble'), (3, 'alli', 'al'), (3, 'entli', 'ent'), (3, 'eli', 'e'), (3, 'ousli', 'ous'),
 (3, 'ization', 'ize'), (3, 'ation', 'ate'), (3, 'ator', 'ate'), (3, 'alism', 'al'), (3, 'iveness', 'ive'),
 (3, 'fulness', 'ful'), (3, 'ousness', 'ous'), (3, 'aliti', 'al'), (3, 'iviti', 'ive'), (3, 'biliti', 'ble'),
 (3, 'logi', 'log'),
 (4, 'icate', 'ic'), (4, 'ative', ''), (4, 'alize', 'al'), (4, 'iciti', 'ic'), (4, 'ical', 'ic'), (4, 'ful', ''),
 (4, 'ness', ''),
 (5, 'al', ''), (5, 'ance', ''), (5, 'ence', ''), (5, 'er', ''), (5, 'ic', ''), (5, 'able', ''), (5, 'ible', ''),
 (5, 'ant', ''), (5, 'ement', ''), (5, 'ment', ''), (5, 'ent', ''), (5, 'ion', ''), (5, 'ou', ''), (5, 'ism', ''),
 (5, 'ate', ''), (5, 'iti', ''), (5, 'ous', ''), (5, 'ive', ''), (5, 'ize', ''))"""


def _shape(x: str) -> str:
    letter = (
        "CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 'v' "
        "WHEN ch = 'y' AND ends_with(s, 'c') THEN 'v' ELSE 'c' END"
    )
    return f"list_reduce(list_prepend('', string_split({x}, '')), lambda s, ch: s || {letter})"


def _measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'v+c+'))"


def _cvc(x: str, shape: str) -> str:
    return f"(ends_with({shape}, 'cvc') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def porter(words: str) -> str:
    """CTEs over a relation with the column word, the last one `stemmed` (word, stem)."""
    doubled = "(length(b) > 1 AND right(b, 1) = b[-2] AND ends_with(sb, 'c') AND right(b, 1) NOT IN ('l', 's', 'z'))"

    def ladder(step: int, source: str, least: int, more: str = "true") -> str:
        return f"""
f{step} AS (SELECT word, any_value(w) AS w, arg_max(ending, length(ending)) AS ending, arg_max(new, length(ending)) AS new
 FROM {source} LEFT JOIN rules ON step = {step} AND ends_with(w, ending) GROUP BY word),
g{step} AS (SELECT *, CASE WHEN ending IS NOT NULL THEN left(w, length(w) - length(ending)) END AS b FROM f{step}),
p{step} AS (SELECT word, CASE WHEN b IS NULL OR b = '' THEN w WHEN {_measure(_shape("b"))} > {least} AND {more} THEN b || new ELSE w END AS w
 FROM g{step})"""

    return f"""{PORTER_RULES},
p0 AS (SELECT word, word AS w FROM {words} WHERE length(word) > 2),
p1 AS (SELECT word, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2)
 WHEN ends_with(w, 'ss') OR NOT ends_with(w, 's') THEN w ELSE left(w, length(w) - 1) END AS w FROM p0),
a2 AS (SELECT word, w, CASE WHEN ends_with(w, 'eed') THEN 'eed' WHEN ends_with(w, 'ed') THEN 'ed' WHEN ends_with(w, 'ing') THEN 'ing' ELSE '' END AS tail
 FROM p1),
b2 AS (SELECT *, left(w, length(w) - length(tail)) AS b FROM a2),
c2 AS (SELECT *, CASE WHEN b = '' THEN '' ELSE {_shape("b")} END AS sb FROM b2),
p2 AS (SELECT word, CASE WHEN tail = '' OR sb = '' THEN w
 WHEN tail = 'eed' THEN CASE WHEN {_measure("sb")} > 0 THEN left(w, length(w) - 1) ELSE w END
 WHEN NOT contains(sb, 'v') THEN w
 WHEN right(b, 2) IN ('at', 'bl', 'iz') THEN b || 'e'
 WHEN {doubled} THEN left(b, length(b) - 1)
 WHEN {_measure("sb")} = 1 AND {_cvc("b", "sb")} THEN b || 'e' ELSE b END AS w FROM c2),
py AS (SELECT word, CASE WHEN length(w) > 1 AND ends_with(w, 'y') AND contains({_shape("left(w, length(w) - 1)")}, 'v')
 THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM p2),
{ladder(3, "py", 0)},
{ladder(4, "p3", 0)},
{ladder(5, "p4", 1, "(ending <> 'ion' OR right(b, 1) IN ('s', 't'))")},
e6 AS (SELECT word, w, left(w, length(w) - 1) AS b FROM p5),
s6 AS (SELECT *, CASE WHEN b = '' THEN '' ELSE {_shape("b")} END AS sb FROM e6),
p6 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({_measure("sb")} > 1 OR ({_measure("sb")} = 1 AND NOT {_cvc("b", "sb")})) THEN b ELSE w END AS w
 FROM s6),
p7 AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {_measure(_shape("left(w, length(w) - 1)"))} > 1 THEN left(w, length(w) - 1) ELSE w END AS w
 FROM p6),
stemmed AS (SELECT word, w AS stem FROM p7 UNION ALL SELECT word, word FROM {words} WHERE length(word) <= 2)"""


#: Whole texts with their runs of letters stemmed.
STEM_TEXT = f"""WITH pieces AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i
 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS x FROM documents)),
vocabulary AS (SELECT DISTINCT lower(piece) AS word FROM pieces WHERE regexp_matches(piece, '^[A-Za-z]')),
{porter("vocabulary")},
joined AS (SELECT doc_id, string_agg(coalesce(stem, piece), '' ORDER BY i) AS value
 FROM pieces LEFT JOIN stemmed ON word = lower(piece) AND regexp_matches(piece, '^[A-Za-z]') GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(value, '') END AS value FROM documents LEFT JOIN joined USING (doc_id)"""


# ---- page text, snippets ------------------------------------------------------------


def clean(html: str) -> str:
    """Page text: scripts, styles and comments cut out by their ends, tags after them."""
    out = f"coalesce({html}, '')"
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, '<{tag}\\b(?:[^<]|<[^/]|</[^{tag[0]}])*</{tag}>', ' ', 'gi')"
    out = f"regexp_replace({out}, '<!--(?:[^-]|-[^-]|--[^>])*-->', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    out = f"replace(replace({out}, '&nbsp;', ' '), chr(160), ' ')"
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{name}', '{sign}')"
    out = f"regexp_replace({out}, '&(#[0-9]+|[a-zA-Z0-9#]+);', ' ', 'g')"
    plain = "c = chr(10) OR c = chr(9) OR ord(c) > 31 AND ord(c) <> 127"
    out = f"array_to_string(list_filter(string_split({out}, ''), lambda c: {plain}), '')"
    return squeeze(f"regexp_replace({out}, '[ \\t]*\\n[ \\t\\n]*', ' ', 'g')")


def squeeze(text: str) -> str:
    """Runs of sentence signs, with the blanks around them, become a full stop and a
    blank; other blanks become one."""
    out = f"regexp_replace({text}, '[ \\t\\n]*[.,!?]+[ \\t\\n]*', '. ', 'g')"
    out = f"regexp_replace({out}, '[.][.]+', '.', 'g')"
    return f"trim(regexp_replace({out}, '[ \\t\\n]+', ' ', 'g'))"


def marked(text: str, words: list[str]) -> str:
    """Whole words in <strong>: the text is cut into words and what lies between."""
    names = ", ".join(f"'{w.lower()}'" for w in words)
    run = "[\\p{L}\\p{Nd}_]"
    cut = f"regexp_extract_all({text}, '{run}+|[^\\p{{L}}\\p{{Nd}}_]+')"
    return f"array_to_string(list_transform({cut}, lambda x: CASE WHEN lower(x) IN ({names}) THEN '<strong>' || x || '</strong>' ELSE x END), '')"


def snippets(source: str, words: list[str], key: str = "doc_id", text: str = "t") -> str:
    """CTEs over a relation of page texts, the last one `snippets` (key, snippet)."""
    found = ", ".join(f"nullif(strpos(lower({text}), '{w}'), 0)" for w in words)
    has = " OR ".join(f"contains(lower(body), '{w}')" for w in words)
    return f"""
sn1 AS (SELECT {key}, {text} AS t, coalesce({found}, 1) - 1 AS hit FROM {source}),
sn2 AS (SELECT *, substr(t, greatest(hit - 151, 0) + 1, hit - greatest(hit - 151, 0)) AS head, substr(t, hit + 1, 151) AS tail FROM sn1),
sn3 AS (SELECT *, strpos(reverse(head), ' .') AS back, strpos(tail, '. ') AS fore FROM sn2),
sn4 AS (SELECT *, CASE WHEN back > 0 THEN hit - back - 1 ELSE greatest(hit - 150, 0) END AS a,
 CASE WHEN fore > 0 THEN hit + fore + 1 ELSE least(length(t), hit + 150) END AS z FROM sn3),
sn5 AS (SELECT *, trim(substr(t, a + 1, z - a)) AS body FROM sn4),
sn6 AS (SELECT *, ({has}) AS has FROM sn5),
sn7 AS (SELECT *, CASE WHEN has THEN z ELSE least(length(t), hit + 100) END AS stop,
 CASE WHEN has THEN body ELSE trim(substr(t, greatest(hit - 100, 0) + 1, least(length(t), hit + 100) - greatest(hit - 100, 0))) END AS kept FROM sn6),
sn8 AS (SELECT *, regexp_replace(regexp_replace({squeeze("kept")}, '^[^a-zA-Z0-9]+', ''), '[^a-zA-Z0-9]+$', '') AS said FROM sn7),
snippets AS (SELECT {key}, CASE WHEN t = '' THEN 'No preview available for this result.'
 ELSE (CASE WHEN a > 0 THEN '...' ELSE '' END) || {marked("said", words)} || (CASE WHEN stop < length(t) THEN '...' ELSE '' END) END AS snippet FROM sn8)"""


# ---- HTML blocks of pages -------------------------------------------------------------

_LISTED = "title|h[1-6]|p|div|li|span|article|section"


def _text(html: str) -> str:
    """The text of a piece of a page: inline tags vanish, others part words."""
    out = f"regexp_replace({html}, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs')"
    out = f"regexp_replace({out}, '</?(?:a|b|i|em|strong|u|code|small)(?: [^>]*)?>', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '<!--.*?-->', '', 'gs'), '<[^>]*>', ' ', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


#: CTEs, the last one `html_blocks` (doc_id, seq, tag, text). The page is cut before
#: every listed element; one that holds others reaches to its end tag, one that
#: doesn't to its end tag or the next cut.
HTML_BLOCKS = f"""
cuts AS (SELECT page_id, string_split(regexp_replace(html, '<({_LISTED})([ >])', chr(1) || '<\\1\\2', 'g'), chr(1)) AS x FROM pages),
cut AS (SELECT page_id, x, unnest(range(2, len(x) + 1)) AS i FROM cuts),
opened AS (SELECT page_id, i, regexp_extract(x[i], '^<([a-z0-9]+)', 1) AS tag, split_part(x[i], '</article>', 1) AS own,
 array_to_string(x[i:], '') AS rest FROM cut),
reached AS (SELECT page_id, i, tag, CASE WHEN tag IN ('article', 'section', 'div', 'span')
 THEN CASE WHEN contains(rest, '</' || tag || '>') THEN left(rest, strpos(rest, '</' || tag || '>') - 1) ELSE rest END
 WHEN contains(own, '</' || tag || '>') THEN left(own, strpos(own, '</' || tag || '>') - 1) ELSE own END AS html FROM opened),
said AS (SELECT page_id AS doc_id, i, tag, {_text("html")} AS text FROM reached),
html_blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS seq, tag, text FROM said WHERE text <> '')"""
