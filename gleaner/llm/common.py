"""Shared plumbing: table access, scratch tables in the shared folder, and
numpy views over Arrow string columns."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete_at_exit, shared_dir, shuffles_dropped
from ..sources.store import spread

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast after it was counted (about 16 bytes each).
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of texts; one of fewer splits than there are cores is dealt out."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df, {"pages": "page_id"}.get(name, "doc_id"))


def batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the Arrow batches that Python workers get (long texts count)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


class Scratch:
    """Tables written below the shared folder: they cut lineage and survive the
    loss of executors. The shuffle files of what was written go at once; drop()
    removes tables that nothing reads any more; what is left goes when the driver
    ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(delete_at_exit, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            delete_at_exit(self.spark, df._scratch_path)


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted rows stay under limit; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def held_out(doc_id: Column | str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_of(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(c: Column | str = "text") -> Column:
    return F.filter(F.split(text_of(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(c: Column | str = "text") -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("long")


def whole_groups(it: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows that come sorted by integer keys, as tables of whole groups
    (at least `least` rows but for the last) and the edges of the groups."""
    carry = None
    for b in _ended(it):
        if b is not None:
            t = pa.Table.from_batches([b])
            carry = t if carry is None else pa.concat_tables([carry, t])
            if carry.num_rows < least:
                continue
        if carry is None or not carry.num_rows:
            return
        new = np.zeros(carry.num_rows - 1, bool)
        for k in keys:
            x = carry.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        edges = np.r_[0, np.flatnonzero(new) + 1, carry.num_rows]
        if b is not None:
            edges = edges[:-1]  # the last group may go on
        if len(edges) > 1:
            yield carry.slice(0, int(edges[-1])), edges
        carry = carry.slice(int(edges[-1])) if b is not None else None


def _ended(it):
    yield from it
    yield None


# ---- numpy views -------------------------------------------------------------


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(off: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 1 << 16)
        p = np.full(m, _P, np.uint64)
        q = np.full(m, pow(_P, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _POW, _INV = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(buf: np.ndarray, off: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; plain: words are runs of letters and
    digits (any non-ASCII byte counts as a letter) instead of non-spaces."""
    word = ~(_PLAIN if plain else _SPACE)[buf]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]  # texts lie end to end: a word ends with its text
    starts[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e), all at once by prefix sums; long
    buffers go in blocks of spans."""
    if len(buf) <= 2 * block or not len(s):
        return _span_hashes(buf, s, e)
    if (s[1:] < s[:-1]).any():
        order = np.argsort(s, kind="stable")
        out = np.empty(len(s), np.uint64)
        out[order] = span_hashes(buf, s[order], e[order], block)
        return out
    out, i = [], 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(s, s[i] + block, "left")))
        out.append(_span_hashes(buf[s[i] : e[i:j].max()], s[i:j] - s[i], e[i:j] - s[i]))
        i = j
    return np.concatenate(out)


def _span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    p, q = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=sums[1:])
    return mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64))


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Lookup:
    """Open-addressing table from 64-bit keys to rows, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.rows = np.full(1 << bits, EMPTY), np.full(1 << bits, len(keys), np.int32)
        left, at = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            free = self.keys[at] == EMPTY
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.rows[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; a key that isn't there gets the row after the last."""
        at = mix(keys) & self.mask
        found = self.keys[at]
        out = self.rows[at].copy()
        left = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            found = self.keys[at[left]]
            out[left] = self.rows[at[left]]
            left = left[(found != keys[left]) & (found != EMPTY)]
        return out
