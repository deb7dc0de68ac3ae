"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. It is rendered
on successive prefixes of a conversation, each from its first turn on. Each output
must extend the one before; what it adds is the span of the new turn. Where it
doesn't, the template rewrites history, and the first such turn is reported, however
far back the change lies. Within a span, the part that carries the text is found by
rendering the prefix with two probe texts in the turn's place: what both outputs
share in front and behind is the frame. Spans that carry assistant texts are the
loss mask. A class is a template that may carry state: one object of it renders all
prefixes of one conversation.

The default template marks turns by control strings and escapes those (and the
escape character) inside roles and texts, so the output can be read back exactly.
Its object remembers the turns that it has escaped, so that a prefix costs what its
output costs to join and compare: quadratic in the turns of one conversation, with
three renderings a turn. `local` is an option, off unless asked for: it renders a turn after
the previous one alone, for templates known to look no further back.

Null roles and texts count as empty. Turns that share a number are ordered by role
and text, null turns come first, and repeated rows are turns of their own. Rows of
a null conv_id form one conversation. A conversation is one row of the result, so
one task holds it, very long texts and all; Arrow limits a row to 2 GB. Empty tables
give no conversations; columns besides the four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

Template = Callable[[list[tuple[str, str]]], str] | type

OPEN, CLOSE, ESCAPE = "<|turn|>", "<|end|>", "\\"
#: Strings that steer common chat models (fixed values), escaped inside texts.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if ESCAPE in text else text


class Marked:
    """The default template. Line ends in a role are escaped as well. Remembers the
    turns of its conversation."""

    def __init__(self):
        self.known: dict[tuple[str, str], str] = {}

    def turn(self, turn: tuple[str, str]) -> str:
        if turn not in self.known:
            role, text = turn
            self.known[turn] = f"{OPEN}{escape(role).replace(chr(10), ESCAPE + 'n')}\n{escape(text)}{CLOSE}\n"
        return self.known[turn]

    def __call__(self, turns: list[tuple[str, str]]) -> str:
        return "".join(map(self.turn, turns))


def marked(turns: list[tuple[str, str]]) -> str:
    """The default template as a plain function."""
    return Marked()(turns)


def read_back(out: str) -> list[tuple[str, str]]:
    """The turns of a string that marked() made."""
    turns, at = [], 0
    for m in _TURN.finditer(out):
        if m.start() != at:
            break
        at = m.end()
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], m[1], flags=re.S)
        turns.append((role, unescape(m[2])))
    if at != len(out):
        raise ValueError(f"not a sequence of marked turns after character {at}")
    return turns


@dataclass
class Rendered:
    text: str
    #: (start, end, content start, content end) of each turn
    spans: list[tuple[int, int, int, int]]
    #: first turn whose rendering changes what came before, or None
    rewrites: int | None


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def render(template: Template, turns: list[tuple[str, str]], local: bool = False, probes: tuple[str, str] = ("a", "b")) -> Rendered:
    """Render successive prefixes, compare each output with the one before and locate
    each turn. local: the template is known not to look beyond the previous turn."""
    template = template() if isinstance(template, type) else template
    parts, spans, at, rewrites, whole = [], [], 0, None, ""
    for k, (role, text) in enumerate(turns):
        past = turns[max(0, k - 1) : k] if local else turns[:k]
        before = template(past) if local or not k else whole
        after = template([*past, (role, text)])
        if not after.startswith(before):
            rewrites = k
            break
        span, start = after[len(before) :], len(before)
        x, y = (template([*past, (role, p)])[start:] for p in probes)
        head = _shared(x, y)
        tail = min(_shared(x[::-1], y[::-1]), len(x) - head - len(probes[0]))
        spans.append((at, at + len(span), at + head, at + len(span) - tail))
        parts.append(span)
        at += len(span)
        whole = after
    return Rendered("".join(parts), spans, rewrites)


EXTRA = (-7, (("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")))


def conversations(df: DataFrame) -> DataFrame:
    """conv_id and its turns in order, one row each."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(df: DataFrame, template: Template = Marked, local: bool = False, role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss (spans of the texts of `role` as start and
    end), rewrites (turn number or null). A conversation whose template rewrites
    history is rendered up to that turn."""

    def run(it):
        for b in it:
            ids, rows = b.column(0), b.column(1).to_pylist()
            done = [render(template, [(t["role"], t["text"]) for t in turns], local) for turns in rows]
            loss = [[{"start": s[2], "end": s[3]} for t, s in zip(turns, r.spans, strict=False) if t["role"] == role] for turns, r in zip(rows, done, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t) for t in rows], pa.int64()), pa.array([r.text for r in done]), pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([r.rewrites for r in done], pa.int64())],
                names=["conv_id", "n_turns", "formatted", "loss", "rewrites"],
            )

    kind = df.schema["conv_id"].dataType.simpleString()
    return conversations(df).mapInArrow(run, f"conv_id {kind}, n_turns long, formatted string, loss array<struct<start:long,end:long>>, rewrites long")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""

    def run(it):
        for b in it:
            out = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                out.append((len(turns), said, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark, 256)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, turns = EXTRA
    extra = spark.createDataFrame([(conv, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.unionByName(extra)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\|turn\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') AS x,
 regexp_replace(replace(role, '\', '\\'), '(<)(\|turn\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') AS y FROM c)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(8 + length(replace(y, chr(10), '\n')) + 1 + length(x) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

QUERIES = {"op9_chat": op9_chat}
ORACLES = {"op9_chat": SQL}
