"""Benchmark decontamination: an inverted index of test items, searched by every
training passage.

Items are indexed by BM25. Document frequencies and the average length are those of
the whole benchmark, however it is cut. An impact is divided by the score the item
has against itself, so one threshold means the same for short and long items.
Passages are windows of two strides of words, moved on by one; an item's stride is
the power of two from 32 that is no less than its own number of words, so each text
span as long as an item lies inside one of its passages, and other items don't
matter. A passage is a query. A first bound is worked out for all passages of a
batch at once: to an item, its rarer words in the passage can add their impacts, and
all of its common words (LIGHT of its score at most) theirs. Where no item's bound
reaches the threshold no pivot exists and the search is over. Others go through
block-max WAND, which returns every item above the threshold. A retrieved item
counts when the passage holds OVERLAP of its five-word runs, and half of those of
its question and of its answer (a column of answers, or else the last third of its
words).

Indexes hold items of one stride, BLOCK_WORDS words or so of them; PASS_BLOCKS are
broadcast at once and searched in one reading of the documents. Null or empty items
and texts have no words and match nothing. Items of fewer than five words are one
run. Very long texts are searched whole, a passage at a time. Ties and repeated rows
get equal results, and every one of repeated items is reported; columns of documents
pass through `decontaminate`, whatever their names, and `leaks` reads key and text
alone. An empty benchmark leaves all documents clean; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Lookup, Scratch, batches, chunks, mix, span_hashes, string_bytes, table, texts, word_spans

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
#: Words of the items of one index (an index takes about 60 bytes a word), and
#: indexes that are broadcast at once.
BLOCK_WORDS, PASS_BLOCKS = 500_000, 4
SHORTEST = 32
BLOCK = 64
#: Share of an item's own score that its commonest words hold, which the first
#: bound takes for granted.
LIGHT = 0.2


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of n words; shorter sequences are one run."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix(out)


def item_words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    s, e, _ = word_spans(buf, np.array([0, len(buf)]), plain=True)
    return span_hashes(LOWER[buf], s, e) if len(s) else np.zeros(0, np.uint64)


def stride_of(n: int) -> int:
    return max(SHORTEST, 1 << max(0, n - 1).bit_length())


@dataclass
class Figures:
    """Of a whole benchmark: items, words an item, and the document frequency of
    terms (sorted), at least of those that the index has."""

    items: int
    average: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Figures:
        terms, df = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
        return cls(len(words), float(np.mean([len(w) for w in words] or [0])), terms, df)


class Index:
    """Postings of items with impacts, largest impacts of terms and of blocks."""

    def __init__(self, items: list[tuple[int, str]], answers: list[str | None] | None = None, figures: Figures | None = None):
        self.ids = [i for i, _ in items]
        words = [item_words(text) for _, text in items]
        figures = figures or Figures.of(words)
        self.parts = []
        for k, w in enumerate(words):
            own = (answers or [None] * len(words))[k]
            n = len(item_words(own)) or max(SHINGLE, len(w) // 3)
            cut = max(0, len(w) - n)
            runs = [np.unique(shingles(x)) for x in (w, w[:cut] if cut >= SHINGLE else w, w[cut:])]
            self.parts.append(runs)
        self.length = [len(w) for w in words]
        length = np.array(self.length, float)
        self.longest = int(length.max(initial=0))
        self.stride = stride_of(self.longest)
        doc = np.repeat(np.arange(len(words)), length.astype(int))
        terms, inv = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        pair, tf = np.unique(inv.astype(np.int64) * max(1, len(words)) + doc, return_counts=True)
        term, item = pair // max(1, len(words)), pair % max(1, len(words))
        df = np.bincount(term, minlength=len(terms))
        whole = figures.df[np.searchsorted(figures.terms, terms)] if len(terms) else df
        idf = np.log1p((figures.items - whole + 0.5) / (whole + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(1.0, figures.average)))
        own = np.bincount(item, impact, len(words))
        impact = impact / np.maximum(own[item], 1e-12)
        self.lookup = Lookup(terms)
        self.start = np.r_[0, np.cumsum(df)].astype(int)
        self.item, self.impact = item.astype(np.int32), impact
        self.most = np.append(np.maximum.reduceat(impact, self.start[:-1]) if len(terms) else np.zeros(0), 0.0)
        self.lists: dict[int, tuple] = {}
        # postings of rarer words: by item, from the commonest word on, what is beyond LIGHT
        order = np.lexsort((term, -whole[term], item))
        total = np.cumsum(impact[order])
        before = total - impact[order] - np.r_[0.0, total][np.searchsorted(item[order], item[order])]
        rare = np.ones(len(order), bool)
        rare[order] = before + impact[order] > LIGHT
        self.rare_start = np.r_[0, np.cumsum(np.bincount(term[rare], minlength=len(terms) + 1))].astype(int)
        self.rare_item, self.rare_impact = item[rare].astype(np.int64), impact[rare]
        self.need = THRESHOLD - np.bincount(item[~rare], impact[~rare], len(words)) - 1e-9

    def postings(self, t: int) -> tuple[list, list, list, list]:
        """Items and impacts of a term; last item and largest impact of its blocks."""
        if t not in self.lists:
            a, b = self.start[t], self.start[t + 1]
            item, impact = self.item[a:b], self.impact[a:b]
            edge = np.arange(0, b - a, BLOCK)
            ends = np.minimum(edge + BLOCK, b - a) - 1
            self.lists[t] = (item.tolist(), impact.tolist(), item[ends].tolist(), np.maximum.reduceat(impact, edge).tolist())
        return self.lists[t]

    def search(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item, score) of all items whose score for the terms reaches the
        threshold, by block-max WAND."""
        end = len(self.ids)
        cur = []  # [current item, place, largest impact, postings]
        for t in terms.tolist():
            p = self.postings(t)
            cur.append([p[0][0], 0, self.most[t], p])
        out = []

        def seek(c: list, to: int) -> None:
            items, k = c[3][0], c[1]
            step = 1
            while k + step < len(items) and items[k + step] < to:
                step *= 2
            low, high = k + step // 2, min(k + step, len(items))
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if items[mid] < to else (low, mid)
            c[1], c[0] = low, items[low] if low < len(items) else end

        while True:
            cur.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cur):
                if c[0] == end:
                    break
                bound += c[2]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            at = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == at:
                pivot += 1
            # the blocks that would hold the pivot
            near, reach = 0.0, end
            for c in cur[: pivot + 1]:
                lasts, highs = c[3][2], c[3][3]
                b = c[1] // BLOCK
                while b < len(lasts) and lasts[b] < at:
                    b += 1
                if b < len(lasts):
                    near += highs[b]
                    reach = min(reach, lasts[b] + 1)
            if near < threshold:  # nothing up to the nearest block end can reach it
                if pivot + 1 < len(cur):
                    reach = min(reach, cur[pivot + 1][0])
                for c in cur[: pivot + 1]:
                    if c[0] < max(reach, at + 1):
                        seek(c, max(reach, at + 1))
            elif cur[0][0] == at:
                score = sum(c[3][1][c[1]] for c in cur[: pivot + 1])
                if score >= threshold:
                    out.append((at, score))
                for c in cur[: pivot + 1]:
                    seek(c, at + 1)
            else:
                for c in cur[:pivot]:
                    if c[0] < at:
                        seek(c, at)

    def matches(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(row, item, score, overlap, that of the question, that of the answer)."""
        s, e, row = word_spans(buf, off, plain=True)
        if not len(s) or not self.longest:
            return
        h = span_hashes(LOWER[buf], s, e)
        term = self.lookup(h)
        stride = self.stride
        many = np.bincount(row, minlength=len(off) - 1)
        first = np.cumsum(many) - many
        windows = np.where(many > 0, np.maximum(1, -(-(many - stride) // stride)), 0)
        base = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(many)), windows)
        a = first[owner] + (np.arange(len(owner)) - base[owner]) * stride
        z = np.minimum(a + 2 * stride, first[owner] + many[owner])
        # bounds of (passage, item): a word lies in the passage that starts at its stride and in the one before
        hits = self.rare_start[term + 1] - self.rare_start[term]
        at = np.repeat(np.flatnonzero(hits), hits[hits > 0])
        slot = self.rare_start[term[at]] + np.arange(len(at)) - np.repeat(np.cumsum(hits[hits > 0]) - hits[hits > 0], hits[hits > 0])
        step = (at - first[row[at]]) // stride
        k, item, impact = base[row[at]] + step, self.rare_item[slot], self.rare_impact[slot]
        own, prior = step < windows[row[at]], step > 0
        key = np.r_[k[own], k[prior] - 1] * len(self.ids) + np.r_[item[own], item[prior]]
        pairs, inv = np.unique(key, return_inverse=True)
        reach = np.bincount(inv, np.r_[impact[own], impact[prior]], len(pairs))
        likely = np.unique(pairs[reach >= self.need[pairs % len(self.ids)]] // len(self.ids))
        best: dict = {}
        for w in likely.tolist():
            t = np.unique(term[a[w] : z[w]])
            t = t[t < len(self.most) - 1]
            found = self.search(t)
            if not found:
                continue
            runs = np.unique(shingles(h[a[w] : z[w]]))
            short: dict = {}
            for item, score in found:
                share = []
                for part in self.parts[item]:
                    own = runs
                    if len(part) and (n := self._run(item)) < SHINGLE:
                        own = short.setdefault(n, np.unique(shingles(h[a[w] : z[w]], n)))
                    share.append(float(np.isin(part, own).mean()) if len(part) else 1.0)
                if share[0] >= OVERLAP and min(share) >= OVERLAP / 2:
                    key = (int(owner[w]), item)
                    best[key] = max(best.get(key, (0.0,)), (share[0], score, share[1], share[2]))
        for (r, item), (share, score, q, ans) in sorted(best.items()):
            yield r, item, score, share, q, ans

    def _run(self, item: int) -> int:
        return min(SHINGLE, self.length[item])


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", answer: str | None = None, block_words: int = BLOCK_WORDS) -> Iterator[list[Index]]:
    """Indexes of all items, PASS_BLOCKS at a time. answer: a column with the last
    words of the item's text that are its answer."""
    scratch = Scratch(benchmark.sparkSession)
    rows = benchmark.select(F.col(key).alias("i"), F.col(text).alias("t"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a")).where("t IS NOT NULL")

    def read(it):
        for b in it:
            words = [item_words(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([stride_of(len(w)) for w in words], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))], names=[*b.schema.names, "n", "stride", "terms"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    items = scratch.write(rows.mapInArrow(read, f"{kinds}, n long, stride long, terms array<long>"), "items")
    dfs = scratch.write(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    count, average = items.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    found = []
    for stride, words in sorted(items.groupBy("stride").agg(F.sum("n")).collect()):  # a row for each power of two
        blocks = max(1, -(-words // block_words))
        for k in range(blocks):
            part = items.where((F.col("stride") == stride) & (F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k))
            own = sorted(part.select("i", "t", "a").toArrow().to_pylist(), key=lambda r: (r["i"] is not None, r["i"], r["t"]))
            if not own:
                continue
            df = part.select(F.explode("terms").alias("term")).distinct().join(dfs, "term").toArrow()
            terms = df.column("term").to_numpy().view(np.uint64)
            order = np.argsort(terms)
            found.append(Index([(r["i"], r["t"]) for r in own], [r["a"] for r in own], Figures(count, average, terms[order], df.column("df").to_numpy()[order])))
            if len(found) == PASS_BLOCKS:
                yield found
                found = []
    if found:
        yield found


def leaks(docs: DataFrame, some: list[Index], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that it holds."""
    sent = docs.sparkSession.sparkContext.broadcast(some)

    def run(it):
        for b in it:
            ids = b.column(0)
            buf, off = string_bytes(b.column(1))
            out = []
            for i, j in chunks(off):
                for index in sent.value:
                    out += [(r + i, index.ids[item], *x) for r, item, *x in index.matches(buf[off[i] : off[j]], off[i : j + 1] - off[i])]
            if out:
                r, item, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], names=["id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
    return found.withColumnRenamed("id", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item."""
    for some in indexes(benchmark):
        sent, at = docs.sparkSession.sparkContext.broadcast(some), docs.columns.index(text)

        def run(it, sent=sent, at=at):
            for b in it:
                buf, off = string_bytes(b.column(at))
                clean = np.ones(b.num_rows, bool)
                for i, j in chunks(off):
                    for index in sent.value:
                        for r, *_ in index.matches(buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                            clean[r + i] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


NOTHING = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    docs, out = texts(spark, sf_dir, "documents", "doc_id", "text"), spark.createDataFrame([], NOTHING)
    for some in indexes(table(spark, sf_dir, "benchmark")):
        out = out.union(leaks(docs, some))
    return out.withColumn("score", F.round("score", 9))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
_RUNS = "list_distinct(list_transform(range(1, greatest(len({x}) - r + 2, 2)), lambda i: array_to_string({x}[i:i + r - 1], ' ')))"
#: Scores of all passages with all items that share a word with them, without an index,
#: bounds or hashes; then the same overlaps.
SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
m AS (SELECT *, len(w) AS n, greatest({SHORTEST}, CAST(2 ** ceil(log2(greatest(len(w), 1))) AS BIGINT)) AS stride, row_number() OVER () AS u FROM i),
c AS (SELECT *, least({SHINGLE}, n) AS r, greatest(0, n - greatest({SHINGLE}, n // 3)) AS cut FROM m),
total AS (SELECT count(*) AS items, avg(n) AS average FROM m),
tf AS (SELECT u, any_value(n) AS n, any_value(stride) AS stride, term, count(*) AS tf FROM (SELECT u, n, stride, unnest(w) AS term FROM m) GROUP BY u, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT u, stride, term, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / greatest(1, average))) AS x
 FROM tf JOIN df USING (term), total),
impact AS (SELECT u, stride, term, x / sum(x) OVER (PARTITION BY u) AS x FROM raw),
d AS (SELECT doc_id, {_WORDS} AS w, row_number() OVER () AS v FROM documents),
p AS (SELECT doc_id, v, stride, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - stride) / stride) AS BIGINT)))) AS j
 FROM d, (SELECT DISTINCT stride FROM m WHERE n > 0) WHERE len(w) > 0),
passage AS (SELECT doc_id, v, stride, j, w[j * stride + 1:j * stride + 2 * stride] AS w FROM p),
terms AS (SELECT DISTINCT v, stride, j, unnest(w) AS term FROM passage),
scored AS (SELECT v, stride, j, u, sum(x) AS score FROM terms JOIN impact USING (stride, term) GROUP BY v, stride, j, u HAVING sum(x) >= {THRESHOLD}),
both_ AS (SELECT q.doc_id, c.item_id, s.v, s.u, s.score, r, q.w AS a, c.w AS w, CASE WHEN cut >= {SHINGLE} THEN c.w[1:cut] ELSE c.w END AS question, c.w[cut + 1:] AS answer
 FROM scored s JOIN passage q USING (v, stride, j) JOIN c USING (u)),
runs AS (SELECT *, {_RUNS.format(x="a")} AS ra, {_RUNS.format(x="w")} AS rw, {_RUNS.format(x="question")} AS rq, {_RUNS.format(x="answer")} AS rn FROM both_),
shares AS (SELECT *, len(list_intersect(rw, ra)) / len(rw) AS overlap, len(list_intersect(rq, ra)) / len(rq) AS question_overlap,
 len(list_intersect(rn, ra)) / len(rn) AS answer_overlap FROM runs),
best AS (SELECT *, row_number() OVER (PARTITION BY v, u ORDER BY overlap DESC, score DESC, question_overlap DESC, answer_overlap DESC) AS k
 FROM shares WHERE overlap >= {OVERLAP} AND least(overlap, question_overlap, answer_overlap) >= {OVERLAP / 2})
SELECT doc_id, item_id, round(score, 9) AS score, overlap, question_overlap, answer_overlap FROM best WHERE k = 1"""

QUERIES = {"op5_decontam": op5_decontam}
ORACLES = {"op5_decontam": SQL}
