"""Quality classifier of supervised subword embeddings.

A text is the average of learned vectors of its hashed words, its hashed runs of
three and four bytes, and a mark for every word that repeats the one before. A
softmax over two classes reads the average. Vectors and softmax are trained
together by numpy stochastic gradient descent on a bounded sample of labelled rows
(`sample_rows` of each class, chosen by hash of the id); the class shares of all
labelled rows correct the bias. Whole texts are read, whatever their length: what
the driver holds at once of their features is bounded by bytes (HELD), and blocks of
the sample are streamed into the descent. Scoring is one table lookup a feature, as
the softmax of an average of vectors is linear in them.

Null and empty texts have no features and get the score of the bias. Ties and
repeated rows get equal scores; a clashing column named score is replaced, others
pass through. With rows of one class only, every text gets the share of label 1 (0.5
without any label). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, batches, chunks, held_out, span_hashes, string_bytes, table, texts, word_spans

BITS = 18
DIM = 8
SAMPLE_ROWS = 2000
EPOCHS = 6
#: The bucket of the mark for repeated words, behind all hashed ones.
REPEAT = 1 << BITS
#: Bytes of features that the driver holds at once.
HELD = 48 << 20


def features(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) pairs of every feature of the texts."""
    out = []
    s, e, row = word_spans(buf, off)
    if len(s):
        h = span_hashes(buf, s, e)
        out.append(((h & np.uint64((1 << BITS) - 1)).astype(np.int32), row))
        again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        out.append((np.full(len(again), REPEAT, np.int32), row[again]))
    rows = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    b = buf.astype(np.uint32)
    for n in (3, 4):
        if len(b) < n:
            continue
        x = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            x |= b[k : len(b) - n + 1 + k] << np.uint32(8 * k)
        x = ((x ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inside = rows[: len(x)] == rows[n - 1 :]
        out.append((x[inside].astype(np.int32), rows[: len(x)][inside]))
    return out


@dataclass
class Model:
    logit: np.ndarray  # of each bucket: its vector times the difference of the softmax weights
    bias: float

    def __call__(self, col: pa.Array) -> np.ndarray:
        buf, off = string_bytes(col)
        parts = [self.logits(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
        x = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def logits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, many = np.zeros(n), np.zeros(n)
        for bucket, row in features(buf, off):
            total += np.bincount(row, self.logit[bucket], n)
            many += np.bincount(row, minlength=n)
        return self.bias + total / np.maximum(many, 1)


def bags(df: DataFrame, text: str, label: str) -> DataFrame:
    """h (hash of the id), y and the features of each text: buckets and counts as bytes."""

    def run(it):
        for b in it:
            buf, off = string_bytes(b.column(2))
            idx, cnt = [], []
            for i in range(b.num_rows):
                part = buf[off[i] : off[i + 1]]
                f = [x for x, _ in features(part, np.array([0, len(part)]))]
                k, c = np.unique(np.concatenate(f) if f else np.zeros(0, np.int32), return_counts=True)
                idx.append(k.astype(np.int32).tobytes())
                cnt.append(c.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["h", "y", "idx", "cnt"])

    return df.select(F.xxhash64("doc_id").alias("h"), F.col(label).cast("int").alias("y"), F.col(text).alias("t")).mapInArrow(run, "h long, y int, idx binary, cnt binary")


def train(blocks: Callable[[], Iterable[list]], many: tuple[int, int], shares: tuple[float, float], seed: int = 7, epochs: int = EPOCHS, rate: float = 0.5) -> Model:
    """blocks(): the sample, block by block, as (y, buckets, counts) of each text, in
    the same order each time; many: texts of either class; shares of the two classes
    among all labels."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / DIM, 1 / DIM, ((1 << BITS) + 1, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    w[:] = rng.uniform(-1, 1, w.shape)
    steps, done = epochs * sum(many), 0
    for _ in range(epochs):
        for bag in blocks():
            for i in rng.permutation(len(bag)):
                y, idx, cnt = bag[i]
                lr, done = rate * (1 - done / steps), done + 1
                if not len(idx):
                    continue
                share = cnt / cnt.sum()
                x = share @ vec[idx]
                z = x @ w + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                grad = w @ p
                w -= lr * np.outer(x, p)
                bias -= 0.1 * lr * p
                # a feature's step is its share of the text, scaled up to the text's number of features
                vec[idx] -= (lr * np.minimum(share * len(idx), 10.0))[:, None] * grad
    prior = np.log(shares[1] / shares[0]) - np.log(many[1] / many[0])
    return Model((vec @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0] + prior))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, held: int = HELD) -> Model:
    """docs: doc_id, text; labels: doc_id, y (0 or 1), training rows only."""
    labels = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    n0, n1 = labels.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(np.zeros((1 << BITS) + 1, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    ids = [labels.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    rows = Scratch(docs.sparkSession).write(bags(sample, "text", "y"), "bags")
    size, m0, m1 = rows.agg(F.coalesce(F.sum(F.length("idx") + F.length("cnt")), F.lit(0)), F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not m0 or not m1:
        return Model(np.zeros((1 << BITS) + 1, np.float32), float(np.log(n1 / n0)))
    parts = -(-size // held) or 1

    def block(k: int) -> list:
        t = (rows.where(F.pmod(F.col("h"), F.lit(parts)) == k) if parts > 1 else rows).toArrow()
        order = np.lexsort((t.column("y").to_numpy(), t.column("h").to_numpy()))  # the same order however the rows arrive
        y, idx, cnt = (t.column(c).to_pylist() for c in ("y", "idx", "cnt"))
        return [(y[i], np.frombuffer(idx[i], np.int32), np.frombuffer(cnt[i], np.float32)) for i in order]

    whole = block(0) if parts == 1 else None
    return train(lambda: [whole] if parts == 1 else map(block, range(parts)), (m0, m1), (n0 / (n0 + n1), n1 / (n0 + n1)))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`, so that texts needn't come back) plus score, the
    chance of label 1."""
    df = df.drop("score")
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    kept = [k for k, c in enumerate(df.columns) if keep is None or c in keep]

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(sent.value(b.column(at)))], names=[*(b.schema.names[k] for k in kept), "score"])

    return df.mapInArrow(run, T.StructType([df.schema.fields[k] for k in kept] + [T.StructField("score", T.DoubleType())]))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("y"))
    out = score(docs, fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict = {}
