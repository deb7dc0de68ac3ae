"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

Counts of all five-byte runs (words lower-cased, padded at both ends) are taken
from every labelled training text, by class, in one map-side combined aggregate.
The highest order is estimated per class with absolute discounting; all lower
orders come from continuation counts that both classes share, so a rare expression
falls back to the same distribution in both models and says little either way.

A word's evidence is the difference of its log-likelihoods under the two models; a
text's is the length-normalised likelihood ratio of toxic text, in which some words
are drawn from the toxic model, to ordinary text, beside its strongest expression.
Logistic calibration turns these into a score; it is fitted on a bounded sample of
the labelled rows (`calibration_rows`), each read by models without the counts of its
own of FOLDS folds. The final models count all folds.

A model of up to MODEL_RUNS runs is sent to all tasks. A larger one stays in tables:
the distinct words of the texts are scored by joins with them, order by order, and
texts by a join with their words. Both give the same scores, and neither leaves out
a run.

Null or empty texts have no words and get the calibrated score of no evidence; very
long ones are read whole, in blocks. Ties and repeated rows get equal scores; other
columns pass through, but for a clashing one named score, which is replaced. Without
labelled rows of both classes every text gets the share of label 1, or 0. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import EMPTY, LOWER, Lookup, Scratch, batches, checked_broadcast, chunks, held_out, span_hashes, string_bytes, table, texts, word_spans

ORDER = 5
DISCOUNT = 0.75
CALIBRATION_ROWS = 3000
#: Runs of a model that driver and workers hold (about 90 bytes each).
MODEL_RUNS = 3_000_000
#: Supposed share of expressions among the words of a toxic text.
RATE = 0.01
FIGURES = ("rate", "ratio", "length", "strong", "most")


def grams(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Packed runs of 1 to ORDER bytes ending at each place of the padded words,
    the places to score, and the word of each place."""
    n = e - s
    width = n + ORDER  # ORDER - 1 blanks before, one after
    at = np.cumsum(width) - width
    total = int(width.sum())
    word = np.repeat(np.arange(len(s)), width)
    k = np.arange(total) - at[word] - (ORDER - 1)
    inside = (k >= 0) & (k < n[word])
    flat = np.full(total, 32, np.uint64)
    flat[inside] = LOWER[buf[(s[word] + k)[inside]]]
    out, g = [], flat
    out.append(flat)
    for j in range(1, ORDER):
        g = g.copy()
        g[j:] |= flat[:-j] << np.uint64(8 * j)
        out.append(g)
    return out, k >= 0, word


@dataclass
class Model:
    """disc[k]: discounted share of a run of k + 1 bytes; gam[k]: weight of the
    lower order after it; the last order has a column for each class."""

    lookups: list = field(default_factory=list)
    disc: list = field(default_factory=list)
    gam: list = field(default_factory=list)
    weights: np.ndarray | None = None  # calibration: bias and the weight of each figure
    prior: float = 0.0

    @classmethod
    def fit(cls, gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
        m = cls()
        order = np.argsort(gram)
        keys, count = gram[order], np.stack([toxic[order], ordinary[order]], 1).astype(float)
        tables = [(keys, count)]
        for k in range(ORDER - 1, 0, -1):  # the different left neighbours of each shorter run, both classes together
            low, n = np.unique(tables[0][0] & np.uint64((1 << (8 * k)) - 1), return_counts=True)
            tables.insert(0, (low, n.astype(float)[:, None]))
        for k in range(1, ORDER):  # what only stands before a byte, blanks above all, has no count but a weight
            keys, n = tables[k - 1]
            bare = np.setdiff1d(tables[k][0] >> np.uint64(8), keys)
            order = np.argsort(keys := np.r_[keys, bare])
            tables[k - 1] = (keys[order], np.r_[n, np.zeros((len(bare), n.shape[1]))][order])
        for k, (keys, n) in enumerate(tables):
            own = n.shape[1]
            m.lookups.append(Lookup(keys))
            if k == 0:
                m.disc.append(np.append((n[:, 0] + 0.5) / (n.sum() + 128), 0.5 / (n.sum() + 128)).astype(np.float32)[:, None])
                continue
            ctx, inv = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.stack([np.bincount(inv, n[:, c], len(ctx)) for c in range(own)], 1)
            kinds = np.stack([np.bincount(inv, n[:, c] > 0, len(ctx)) for c in range(own)], 1)
            disc = np.maximum(n - DISCOUNT, 0) / np.maximum(total[inv], 1)
            gam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
            m.disc.append(np.vstack([disc, np.zeros((1, own))]).astype(np.float32))
            low = np.ones((len(tables[k - 1][0]) + 1, own), np.float32)
            low[m.lookups[k - 1](ctx)] = gam
            low[-1] = 1
            m.gam.append(low)
        return m

    def words(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word, over its length."""
        if not len(s):
            return np.zeros(0)
        g, keep, word = grams(buf, s, e)
        rows = [look(x) for look, x in zip(self.lookups, g, strict=True)]
        p = self.disc[0][rows[0]]
        for k in range(1, ORDER):
            before = np.roll(rows[k - 1], 1)
            p = self.disc[k][rows[k]] + self.gam[k - 1][before] * p
        llr = (np.log(p[:, 0] + 1e-12) - np.log(p[:, 1] + 1e-12)) * keep
        return np.bincount(word, llr, len(s)) / (e - s + 1)


class Scorer:
    """Figures of whole texts; remembers the evidence of words it has met."""

    def __init__(self, model: Model, bits: int = 19):
        self.m, self.mask = model, np.uint64((1 << bits) - 1)
        self.keys, self.vals = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.float32)

    def figures(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text: the likelihood ratio of "one word in a hundred is an
        expression" to "none is", over its length and whole; the log of its
        length; the share of strong words; its strongest word."""
        n = len(off) - 1
        out = np.zeros((n, len(FIGURES)))
        s, e, row = word_spans(buf, off, plain=True)
        if not len(s):
            return out
        h = span_hashes(LOWER[buf], s, e)
        slot = h & self.mask
        val = self.vals[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            _, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            new = np.concatenate([self.m.words(buf, s[x], e[x]) for x in np.array_split(at, max(1, len(at) // 20000))])
            val[miss] = new[inv]
            self.keys[slot[at]], self.vals[slot[at]] = h[at], new
        whole = val.astype(float) * (e - s + 1)
        many = np.bincount(row, minlength=n)
        has = np.flatnonzero(many)
        out[:, 1] = np.bincount(row, np.log1p(np.expm1(np.minimum(whole, 30)) * RATE), n)
        out[:, 0] = out[:, 1] / np.maximum(many, 1)
        out[:, 0], out[:, 1] = np.arcsinh(100 * out[:, 0]), np.arcsinh(out[:, 1])
        out[:, 2] = np.log(np.maximum(many, 1))
        out[:, 3] = np.bincount(row, whole > 3, n) / np.maximum(many, 1)
        out[has, 4] = np.maximum.reduceat(whole, np.searchsorted(row, has))
        return out

    def __call__(self, col: pa.Array) -> np.ndarray:
        buf, off = string_bytes(col)
        parts = [self.figures(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
        return np.concatenate(parts) if parts else np.zeros((0, len(FIGURES)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> np.ndarray:
    """Weights (bias first, on the raw figures) by Newton steps."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + ridge * (w @ w) / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return np.r_[w[0] - (w[1:] * mean / sd).sum(), w[1:] / sd]


FOLDS = 4
COUNTS = tuple(f"{c}{k}" for c in ("toxic", "ordinary") for k in range(FOLDS))


def count_grams(df: DataFrame, text: str, label: str, fold: str) -> DataFrame:
    """gram, and how often it stands in the texts of each class and fold."""

    def run(it):
        for b in it:
            buf, off = string_bytes(b.column(0))
            y, of = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            column = np.where(y > 0, of, of + FOLDS)
            for i, j in chunks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, row = word_spans(part, o, plain=True)
                if not len(s):
                    continue
                _, first, inv = np.unique(span_hashes(LOWER[part], s, e), return_index=True, return_inverse=True)
                own = column[i:j][row]
                times = [np.bincount(inv, own == k, len(first)) for k in range(2 * FOLDS)]
                g, keep, word = grams(part, s[first], e[first])
                key, inv = np.unique(g[-1][keep], return_inverse=True)
                word = word[keep]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *(pa.array(np.bincount(inv, w[word]).astype(np.int64)) for w in times)], names=["gram", *COUNTS])

    parts = df.select(F.col(text).alias("t"), F.col(label).alias("y"), F.col(fold).cast("long").alias("f")).mapInArrow(run, ", ".join(f"{c} long" for c in ("gram", *COUNTS)))
    return parts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def lower(runs: DataFrame, k: int) -> DataFrame:
    """key, a, b: the different left neighbours of each run of k bytes, for both classes."""
    n = F.count("*").cast("double")
    return runs.groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(n.alias("a"), n.alias("b"))


@dataclass
class Tables:
    """The model in tables: runs of each order (key, a, b: counts of both classes) and
    their contexts (ctx, totals and kinds)."""

    runs: list
    ends: list
    total: float
    scratch: Scratch
    weights: np.ndarray | None = None
    prior: float = 0.0

    @classmethod
    def fit(cls, counts: DataFrame, toxic: Column, ordinary: Column) -> Tables:
        scratch = Scratch(counts.sparkSession)
        top = counts.select(F.col("gram").alias("key"), toxic.cast("double").alias("a"), ordinary.cast("double").alias("b")).where("a + b > 0")
        runs = [scratch.write(top, "runs")]
        for k in range(ORDER - 1, 0, -1):
            runs.insert(0, scratch.write(lower(runs[0], k), "runs"))
        ends = []
        for t in runs[1:]:
            sums = [f(c) for c in ("a", "b") for f in (lambda c: F.sum(c).alias(f"total_{c}"), lambda c: F.sum((F.col(c) > 0).cast("double")).alias(f"kinds_{c}"))]
            ends.append(scratch.write(t.groupBy(F.shiftrightunsigned("key", 8).alias("ctx")).agg(*sums), "contexts"))
        return cls(runs, ends, runs[0].agg(F.sum("a")).first()[0], scratch)

    def evidence(self, grams: DataFrame) -> DataFrame:
        """grams: g (distinct) -> g, llr: log-likelihood of its last byte, toxic minus ordinary."""
        first = self.runs[0].select(F.col("key").alias("_k"), F.col("a").alias("_n"))  # a row a byte
        x = grams.join(F.broadcast(first), F.col("g").bitwiseAND(255) == F.col("_k"), "left")
        p = (F.coalesce("_n", F.lit(0.0)) + 0.5) / (self.total + 128)
        x = x.select("g", p.alias("pa"), p.alias("pb"))
        for k in range(2, ORDER + 1):
            key, ctx = F.col("g").bitwiseAND((1 << 8 * k) - 1), F.shiftrightunsigned(F.col("g").bitwiseAND((1 << 8 * k) - 1), 8)
            x = x.withColumn("key", key).withColumn("ctx", ctx).join(self.runs[k - 1], "key", "left").join(self.ends[k - 2], "ctx", "left")
            p = []
            for c in ("a", "b"):
                total = F.col(f"total_{c}")
                own = F.coalesce(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1.0)), F.lit(0.0))
                gam = F.when(total > 0, DISCOUNT * F.col(f"kinds_{c}") / total).otherwise(1.0)
                p.append((own + gam * F.col(f"p{c}")).alias(f"p{c}"))
            x = x.select("g", *p)
        return x.select("g", (F.log(F.col("pa") + 1e-12) - F.log(F.col("pb") + 1e-12)).alias("llr"))

    def figures(self, df: DataFrame, text: str) -> DataFrame:
        """name (digest of a text) and the figures of every different text."""
        write = self.scratch.write
        of = digest(F.col(text))

        def read(it):
            for b in it:
                buf, off = string_bytes(b.column(1))
                for i, j in chunks(off):
                    part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                    s, e, row = word_spans(part, o, plain=True)
                    if not len(s):
                        continue
                    h = span_hashes(LOWER[part], s, e)
                    order = np.lexsort((h, row))
                    edge = np.flatnonzero(np.r_[True, (np.diff(row[order]) != 0) | (h[order][1:] != h[order][:-1])])
                    first, times = order[edge], np.diff(np.r_[edge, len(order)])
                    low = LOWER[part].tobytes()
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[first] + i)), pa.array(h[first].view(np.int64)), pa.array([low[x:y] for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)], pa.binary()), pa.array(times)], names=["name", "wh", "word", "times"])

        def spell(it):
            for b in it:
                buf, off = string_bytes(b.column(1).cast(pa.large_binary()))
                g, keep, word = grams(buf, off[:-1], off[1:])
                if keep.any():
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(word[keep])), pa.array(g[-1][keep].view(np.int64))], names=["wh", "g"])

        texts_ = df.select(of.alias("name"), F.col(text).alias("t")).dropDuplicates(["name"])
        held = write(texts_.mapInArrow(read, "name binary, wh long, word binary, times long"), "words")
        words = held.groupBy("wh").agg(F.min("word").alias("word"))
        spelt = write(words.mapInArrow(spell, "wh long, g long"), "spelt")
        llr = write(self.evidence(spelt.select("g").distinct()), "evidence")
        whole = write(spelt.join(llr, "g").groupBy("wh").agg(F.sum("llr").alias("whole")), "whole")
        x = held.select("name", "wh", "times").join(checked_broadcast(whole, whole.count()), "wh")
        many, ratio = F.sum("times"), F.sum(F.col("times") * F.log1p(F.expm1(F.least("whole", F.lit(30.0))) * RATE))
        x = x.groupBy("name").agg(many.alias("many"), ratio.alias("sum"), F.sum(F.when(F.col("whole") > 3, F.col("times")).otherwise(0)).alias("n_strong"), F.max("whole").alias("most"))
        return x.select("name", F.asinh(100 * F.col("sum") / F.col("many")).alias("rate"), F.asinh("sum").alias("ratio"), F.log("many").alias("length"), (F.col("n_strong") / F.col("many")).alias("strong"), "most")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def with_figures(df: DataFrame, text: str, model: Model | Tables, names=FIGURES, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) plus the figures, or score if that is the name asked for."""
    df = df.drop(*names)
    shown = [c for c in df.columns if keep is None or c in keep]
    if isinstance(model, Tables):
        found = model.figures(df, text).withColumnRenamed("name", "_name")
        x = df.select(*shown, digest(F.col(text)).alias("_digest")).join(found, F.col("_digest") == F.col("_name"), "left")
        cols = [F.coalesce(F.col(c), F.lit(0.0)) for c in FIGURES]
        if names == FIGURES:
            return x.select(*shown, *(c.alias(a) for c, a in zip(cols, FIGURES, strict=True)))
        return x.select(*shown, score_of(model, cols).alias(names[0]))
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [df.columns.index(c) for c in shown]
    at = df.columns.index(text)

    def run(it):
        scorer = Scorer(sent.value)
        for b in it:
            f = scorer(b.column(at))
            cols = list(f.T) if names == FIGURES else [probability(sent.value, f)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=[*shown, *names])

    return df.mapInArrow(run, T.StructType([df.schema.fields[k] for k in kept] + [T.StructField(c, T.DoubleType()) for c in names]))


def fit(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS, model_runs: int | None = None) -> Model | Tables:
    """docs: doc_id, text; labels: doc_id, y (0 or 1), training rows only. The model
    returned has the counts of all of them."""
    labels = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y")).where("y IS NOT NULL")
    labels = labels.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)))
    n, n1 = labels.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    known = checked_broadcast(labels, n)
    docs = docs.select("doc_id", "text")
    counts = Scratch(docs.sparkSession).write(count_grams(docs.join(known, "doc_id"), "text", "y", "fold"), "counts")
    runs, *sums = counts.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in COUNTS)).first()
    prior = float(n1) / n if n else 0.0
    if not runs or n1 == 0 or n1 == n:
        return Model(prior=prior)
    sums = np.array(sums).reshape(2, FOLDS)
    # folds without which texts of both classes are left to count
    folds = [k for k in range(FOLDS) if sums[:, k].any() and (sums.sum(1) > sums[:, k]).all()]
    if runs <= (MODEL_RUNS if model_runs is None else model_runs):
        # every run, whatever its count: the lower orders are made of all of them
        kind = "int" if sums.max() < 1 << 31 else "long"
        rows = counts.select("gram", *(F.col(c).cast(kind) for c in COUNTS)).toArrow()
        gram = rows.column("gram").to_numpy().view(np.uint64)
        count = np.stack([rows.column(c).to_numpy() for c in COUNTS], 1).reshape(-1, 2, FOLDS)
        del rows

        def model(without: int | None) -> Model | Tables:
            own = count.sum(2) - (0 if without is None else count[:, :, without])
            seen = own.any(1)
            return Model.fit(gram[seen], own[seen, 0], own[seen, 1])
    else:

        def model(without: int | None) -> Model | Tables:
            a, b = (sum((F.col(f"{c}{k}") for k in range(FOLDS) if k != without), F.lit(0)) for c in ("toxic", "ordinary"))
            return Tables.fit(counts, a, b)

    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
    rows = [with_figures(docs.join(F.broadcast(sample.where(F.col("fold") == k)), "doc_id"), "text", model(k), keep=["y"]).toPandas() for k in folds]
    m = model(None)
    m.prior = prior
    x = pd.concat(rows) if rows else pd.DataFrame({"y": []})
    if x.y.nunique() == 2:
        x = x.sort_values([*FIGURES, "y"])  # the same sums however the rows arrive
        m.weights = logistic(x[list(FIGURES)].to_numpy(), x.y.to_numpy(float))
    return m


def probability(m: Model | Tables, f: np.ndarray) -> np.ndarray:
    if m.weights is None:
        return np.full(len(f), m.prior)
    return 1 / (1 + np.exp(-np.clip(m.weights[0] + f @ m.weights[1:], -30, 30)))


def score_of(m: Tables, figures: list[Column]) -> Column:
    """The same as a column."""
    if m.weights is None:
        return F.lit(m.prior)
    z = F.lit(float(m.weights[0]))
    for w, c in zip(m.weights[1:], figures, strict=True):
        z = z + float(w) * c
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def score(df: DataFrame, model: Model | Tables, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`, so that texts needn't come back) plus score, the
    chance that a text is toxic; a column of that name is replaced."""
    if isinstance(model, Model) and not model.lookups:
        return df.drop("score").select(*(keep or [c for c in df.columns if c != "score"])).withColumn("score", F.lit(model.prior))
    return with_figures(df, text, model, ("score",), keep)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("y"))
    out = score(docs, fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict = {}
