"""Suffix-array deduplication: repeated byte strings of a length, across documents.

Documents are packed into batches, and batches into bundles. In every WINDOW-byte
string the run of ANCHOR bytes with the least hash is its anchor, so equal strings
have equal anchors wherever they stand. Neighbouring strings with one anchor make a
segment of less than two windows. Anchors that only one document has are out of the
question; segments of the others are dealt to parts by anchor, equal ones of a
bundle once, with the smallest id that has them. An anchor of more than HOT
documents is cut into its single strings, dealt by their own hash, so no task gets a
whole common passage, and a bundle tells of an anchor once.

What bundles and parts send each other is one row for each pair, of arrays that are
cut by one sort: the work is linear in bytes, and only the number of rows grows with
bundles times parts (each of BUNDLE_BYTES and PART_BYTES of text). Inside a part
SUBS subsets are solved one after the other.

Each subset leaves out segments that share no half window around a place of the
anchor with another (by hash), and sorts the windows of the others column by column,
in the rounds of a multi-document transform whose columns are not kept: every round
puts one more symbol in front of each window's suffix. A round reads the suffixes in
order, one after the other, and sends each on to the file of its new symbol; the
files, in symbol order, are the next round's order. As all windows have one length,
the suffixes of a round are ranked by those of the round before alone, and only the
newest layer is kept. Small layers stay in memory, larger ones go through files on
disk (of the task alone, gone with it). In the final order common prefixes of
neighbours tell which windows are equal, and the smallest id of a class is the first
document that holds it.

A byte goes if a WINDOW-byte string that covers it also starts in a document of a
smaller id; strings are judged on the input. Null texts are empty; texts shorter
than WINDOW lose nothing; rows of one id don't remove each other; a null id comes
after all others. Texts of more than BATCH_BYTES are worked on in slices that overlap
by a window, one at a time. Columns besides key and text play no part, whatever
their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, mix, span_hashes, string_bytes, texts

WINDOW = 50
ANCHOR = 20
MOST_WINDOWS = 48
HOT = 1024
NOWHERE, OFTEN, MULTI = 100, 101, 128
#: Text that is worked on at once (about 50 bytes of arrays for each).
BATCH_BYTES = 1 << 20
#: Text of a bundle and of a part. Rows between them are (corpus / BUNDLE_BYTES) *
#: (corpus / PART_BYTES): raise both with the memory of executors.
BUNDLE_BYTES = PART_BYTES = 64 << 20
SUBS = 16
#: Anchors, and bytes of segments, that a bundle gathers before it sends them.
MOST_ANCHORS, MOST_BYTES = 1 << 20, 10 << 20
#: Bytes of one Arrow batch.
SENT = 2 << 20
#: Documents that a round holds in memory (about 16 bytes each).
CHUNK = 8 << 20
NO_ID = np.int64(2**63 - 1)

_pack = lambda x, level=1: zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x).tobytes())
_unpack = lambda b, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def binary_rows(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of values[edges[i] : edges[i + 1]]."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // len(values) if len(values) else 1
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(values)])


def sent(names: list[str], cols: list[pa.Array], size: np.ndarray):
    """Record batches of the rows, each of about SENT bytes (size: bytes of each)."""
    block = (np.cumsum(size) - size) // SENT
    edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(size)] if len(size) else np.zeros(1, int)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in cols], names=names)


def squeezed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column as binary_rows() makes it, long rows compressed; a last byte
    tells."""
    cuts = zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
    return pa.array([_pack(values[a:z]) + b"\x01" if z - a >= 4096 else values[a:z].tobytes() + b"\x00" for a, z in cuts], pa.binary())


def unsqueezed(x: bytes) -> np.ndarray:
    return _unpack(x[:-1], np.uint8) if x[-1] else np.frombuffer(x, np.uint8)[:-1]


def joined(col: pa.Array, kind) -> np.ndarray:
    """The bytes of all rows of a binary column as one array."""
    found = [np.frombuffer(x, kind) for x in col.to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, kind)


PACKED = "bundle long, seq int, ids binary, sizes binary, data binary, more boolean"


def packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Batches of documents: bundle, seq, ids, sizes, data (compressed bytes); more:
    the batch is a slice of one text, whose next slice is the next batch."""

    def run(it):
        bundle, seq, held, in_bundle = TaskContext.get().partitionId() << 32, 0, 0, 0
        ids, bufs, sizes = [], [], []

        def flush(more: bool = False):
            nonlocal bundle, seq, ids, bufs, sizes, held, in_bundle
            data = np.concatenate(bufs)
            row = [pa.array([bundle]), pa.array([seq], pa.int32()), *(pa.array([_pack(x)]) for x in (np.concatenate(ids), np.concatenate(sizes))), pa.array([_pack(data, 3)]), pa.array([more])]
            seq, ids, bufs, sizes, held, in_bundle = seq + 1, [], [], [], 0, in_bundle + len(data)
            if in_bundle >= BUNDLE_BYTES and not more:
                bundle, seq, in_bundle = bundle + 1, 0, 0
            return pa.RecordBatch.from_arrays(row, names=["bundle", "seq", "ids", "sizes", "data", "more"])

        for b in it:
            own = b.column(0).cast(pa.int64()).fill_null(NO_ID.item()).to_numpy()
            buf, off = string_bytes(b.column(1))
            i = 0
            while i < len(own):
                if off[i + 1] - off[i] > BATCH_BYTES:  # slices of one text, each with the windows that start in it
                    if ids:
                        yield flush()
                    for at in range(off[i], off[i + 1], BATCH_BYTES):
                        last = at + BATCH_BYTES >= off[i + 1]
                        bufs = [buf[at : off[i + 1] if last else min(off[i + 1], at + BATCH_BYTES + WINDOW - 1)]]
                        ids, sizes = [own[i : i + 1]], [np.array([len(bufs[0])], np.int64)]
                        yield flush(not last)
                    i += 1
                    continue
                j = max(i + 1, int(np.searchsorted(off, off[i] + BATCH_BYTES - held, "right")) - 1)
                ids.append(own[i:j])
                bufs.append(buf[off[i] : off[j]])
                sizes.append(np.diff(off[i : j + 1]))
                held, i = held + int(off[j] - off[i]), j
                if held >= BATCH_BYTES * 7 // 8:
                    yield flush()
        if ids:
            yield flush()

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, PACKED)


def anchor_hashes(buf: np.ndarray) -> np.ndarray:
    """The hash of the ANCHOR bytes at each place that has as many."""
    n = len(buf)
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.ndarray((n,), "<u8", raw, strides=(1,))
    h = word[: n - ANCHOR + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8 : n - ANCHOR + 9]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += word[12 : n - ANCHOR + 13]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Batch:
    """Documents of one batch and the segments of their strings."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = _unpack(ids, np.int64)
        self.off = np.r_[0, np.cumsum(_unpack(sizes, np.int64))]
        self.buf = _unpack(data, np.uint8)
        self.segments()

    def segments(self) -> None:
        """start, windows, row and anchor of each segment; the distinct anchors."""
        n, w = len(self.buf), WINDOW - ANCHOR + 1
        self.start = np.zeros(0, np.int64)
        self.windows, self.row, self.anchor = self.start, self.start, np.zeros(0, np.uint64)
        self.distinct, self.inv = self.anchor, self.start
        if n < WINDOW:
            return
        h = anchor_hashes(self.buf)
        self.hash, low, span = h, h, 1
        while span * 2 <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        sizes = np.diff(self.off)
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: n - WINDOW + 1]
        whole = rows == np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[WINDOW - 1 :]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
        new[1:] |= whole[1:] != whole[:-1]
        edge = np.flatnonzero(new)
        length = np.diff(np.r_[edge, len(low)])
        keep = whole[edge]
        edge, length = edge[keep], length[keep]
        pieces = -(-length // MOST_WINDOWS)  # runs of one repeated anchor may be long
        k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = np.repeat(edge, pieces) + k * MOST_WINDOWS
        self.windows = np.minimum(MOST_WINDOWS, np.repeat(length, pieces) - k * MOST_WINDOWS)
        self.row, self.anchor = rows[self.start], low[self.start]
        self.distinct, self.inv = np.unique(self.anchor, return_inverse=True)

    def documents(self) -> np.ndarray:
        """How many documents have each distinct anchor."""
        pairs = np.unique(self.inv * np.int64(len(self.ids)) + self.row) // max(1, len(self.ids))
        return np.bincount(pairs, minlength=len(self.distinct))

    def strings(self, flag: np.ndarray) -> None:
        """flag: 0, 1 (shared) or 2 (shared by many) of each distinct anchor. Of the
        shared segments start, length in windows, row and distinct string; of each
        distinct string its hash, a place, length, least id and the name to deal by."""
        f = flag[self.inv] if len(self.inv) else np.zeros(0, np.uint8)
        one, many = np.flatnonzero(f == 1), np.flatnonzero(f == 2)
        n = self.windows[many]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.s = np.r_[self.start[one], np.repeat(self.start[many], n) + k]
        self.n = np.r_[self.windows[one], np.ones(len(k), np.int64)]
        self.r = np.r_[self.row[one], np.repeat(self.row[many], n)]
        h = span_hashes(self.buf, self.s, self.s + self.n + WINDOW - 1) if len(self.s) else np.zeros(0, np.uint64)
        name = np.r_[mix(self.anchor[one] + np.uint64(1)), mix(h[len(one) :])]
        self.h, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.at, self.len = self.s[first], self.n[first]
        self.least = np.full(len(first), NO_ID)
        np.minimum.at(self.least, self.of, self.ids[self.r])
        self.name = name[first]
        self.single = first >= len(one)

    def marks(self) -> None:
        """Where the anchor lies in each distinct string (NOWHERE for single windows,
        OFTEN where it lies at several places), and whether two rows hold it."""
        self.mark = np.full(len(self.at), NOWHERE, np.uint8)
        some = np.flatnonzero(~self.single)
        start, last = self.at[some], self.len[some] - 1 + WINDOW - ANCHOR
        if len(some):
            anchor = np.full(len(some), ~np.uint64(0))
            for k in range(WINDOW - ANCHOR + 1):
                np.minimum(anchor, self.hash[start + k], out=anchor)
            place, times = np.zeros(len(some), np.uint8), np.zeros(len(some), np.uint8)
            for k in range(int(last.max()) + 1):
                here = (self.hash[np.minimum(start + k, len(self.hash) - 1)] == anchor) & (k <= last)
                place[here] = k
                times += here
            self.mark[some] = np.where(times > 1, np.uint8(OFTEN), place)
        rows = np.bincount(self.of, minlength=len(self.at))
        self.mark += np.where(rows > 1, np.uint8(MULTI), np.uint8(0))


def spans_of(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the spans, one span after the other."""
    total = int(size.sum())
    kind = np.int32 if max(total, int((at + size).max(initial=0))) < 1 << 31 else np.int64
    out = np.repeat((at - (np.cumsum(size) - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def column_order(text: np.ndarray, places: np.ndarray, chunk: int = CHUNK) -> list:
    """Column-wise construction over the windows at `places`, documents of WINDOW
    bytes each. Round by round every document gets one more symbol in front of its
    suffix: its new rank is by that symbol, then by the rank it had. The columns of the
    transform (a round's symbols in rank order) are not kept. More than `chunk`
    documents go through one file for each symbol, written and read from front to
    end. Returns arrays or files of places, in order."""
    files: list = [places.astype(np.int32)]
    for depth in range(WINDOW - 1, -1, -1):
        if len(files) == 1 and len(files[0]) <= chunk:
            files = [files[0][np.argsort(text[files[0] + depth], kind="stable")]]
            continue
        columns: dict = {}
        for some in _read(files, chunk):
            symbols = text[some + depth]
            order = np.argsort(symbols, kind="stable")
            symbols = symbols[order]
            cut = np.flatnonzero(np.diff(symbols)) + 1
            for x, c in zip(np.split(some[order], cut), symbols[np.r_[0, cut]].tolist(), strict=True):
                if c not in columns:
                    columns[c] = tempfile.TemporaryFile()
                columns[c].write(x.tobytes())
        files = [columns[c] for c in sorted(columns)]
    return files


def _read(files: list, chunk: int):
    for f in files:
        if isinstance(f, np.ndarray):
            yield from (f[k : k + chunk] for k in range(0, len(f), chunk))
        else:
            with f:
                f.seek(0)
                while data := f.read(4 * chunk):
                    yield np.frombuffer(data, np.int32)


def first_holders(data: np.ndarray, off: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Segments (bytes, offsets, smallest ids) -> for each of their windows, one
    segment after the other, the smallest id that holds the same bytes."""
    n = np.diff(off) - WINDOW + 1
    places = spans_of(off[:-1], n)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    slot = np.zeros(len(data), np.int32)
    slot[places] = np.arange(len(places), dtype=np.int32)
    first = np.full(len(places), NO_ID)
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))

    def close(p: np.ndarray) -> np.ndarray:
        """Settle the classes of a run of ordered places; the last stays open."""
        same = np.ones(len(p) - 1, bool)
        for k in (*range(0, WINDOW - 7, 8), WINDOW - 8):  # common prefixes of neighbours, as far as a window reaches
            x = word[p + k]
            same &= x[1:] == x[:-1]
        edge = np.r_[0, np.flatnonzero(~same) + 1]
        at = slot[p]
        low = np.minimum.reduceat(least[owner[at]], edge)
        first[at] = np.repeat(low, np.diff(np.r_[edge, len(p)]))
        return p[edge[-1] :]

    open_ = np.zeros(0, np.int32)
    for p in _read(column_order(data, places), CHUNK):
        open_ = close(np.concatenate([open_, p]))
    return first


def partners(data: np.ndarray, off: np.ndarray, mark: np.ndarray, least: np.ndarray):
    """The first of each distinct segment, the distinct one of each, its smallest
    id, and the distinct ones to insert: those found twice, and those that share
    their anchor, at any place of it, with half of the rest of a window on one side
    of it with another. A window that two segments share covers that much on one
    side of the anchor that it holds, which is one of the anchor's places in each."""
    _, one, inv, many = np.unique(span_hashes(data, off[:-1], off[1:]), return_index=True, return_inverse=True, return_counts=True)
    own = np.full(len(one), NO_ID)
    np.minimum.at(own, inv, least)
    again = many > 1
    again |= np.bincount(inv, mark >= MULTI, len(one)) > 0
    place, side = mark[one].astype(np.int64) % MULTI, (WINDOW - ANCHOR) // 2
    of = np.flatnonzero(place < NOWHERE)
    at = off[one[of]] + place[of]
    often = np.flatnonzero(place == OFTEN)
    if len(often):
        size = off[one[often] + 1] - off[one[often]]
        h = anchor_hashes(data[spans_of(off[one[often]], size)])
        begin, places = np.cumsum(size) - size, size - ANCHOR + 1
        least_of = h[begin[:, None] + np.arange(WINDOW - ANCHOR + 1)].min(1)
        seg = np.repeat(np.arange(len(often)), places)
        here = np.flatnonzero(h[spans_of(begin, places)] == least_of[seg])
        seg, k = seg[here], here - (np.cumsum(places) - places)[seg[here]]
        of, at = np.r_[of, often[seg]], np.r_[at, off[one[often[seg]]] + k]
    for lo, hi in ((at - side, at + ANCHOR), (at, at + ANCHOR + side)):
        can = np.flatnonzero((lo >= off[one[of]]) & (hi <= off[one[of] + 1]))
        if len(can):
            _, key, count = np.unique(span_hashes(data, lo[can], hi[can]), return_inverse=True, return_counts=True)
            again[of[can[count[key] > 1]]] = True
    return one, inv, own, np.flatnonzero(again)


def bounds(x: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal values."""
    return np.r_[0, np.flatnonzero(np.diff(x)) + 1, len(x)] if len(x) else np.zeros(1, np.int64)


def anchor_rows(bundle: int, names: list[np.ndarray], docs: list[np.ndarray], parts: int):
    """Rows p, bundle, anchors, docs of a bundle's anchors (or of a share of them)."""
    key, first = np.unique(np.concatenate(names), return_inverse=True)
    many = np.minimum(np.bincount(first, np.concatenate(docs), len(key)), 65535).astype(np.uint16)
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = bounds(part[order])
    # the upper 40 bits name an anchor within its part; a clash only asks for more than needed
    short = np.ascontiguousarray((key[order] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
    n = len(edges) - 1
    cols = [pa.array(part[order][edges[:-1]].astype(np.int32)), pa.array(np.full(n, bundle)), binary_rows(short, edges), binary_rows(many[order], edges)]
    return sent(["p", "bundle", "anchors", "docs"], cols, np.diff(edges) * 7)


def shared_anchors(packs: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """bundle, p, anchors, flag: the bundle's anchors of part p that other documents
    have too, and 1, or 2 for more than `hot` documents."""

    def emit(it):
        now, names, docs, held = None, [], [], 0
        for b in it:
            for r in b.to_pylist():
                if names and (r["bundle"] != now or held > MOST_ANCHORS):
                    yield from anchor_rows(now, names, docs, parts)
                    names, docs, held = [], [], 0
                now, x = r["bundle"], Batch(r["ids"], r["sizes"], r["data"])
                if len(x.distinct):
                    names.append(x.distinct)
                    docs.append(x.documents())
                    held += len(x.distinct)
        if names:
            yield from anchor_rows(now, names, docs, parts)

    def judge(t: pa.Table) -> pa.Table:
        docs = [len(x) // 2 for x in t.column("docs").to_pylist()]
        names = np.zeros((sum(docs), 8), np.uint8)
        names[:, :5] = joined(t.column("anchors"), np.uint8).reshape(-1, 5)
        keys, inv = np.unique(names.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(inv, joined(t.column("docs"), np.uint16), len(keys))
        flag = ((total > 1).astype(np.uint8) + (total > hot))[inv]
        found = np.flatnonzero(flag)
        edges = np.searchsorted(found, np.r_[0, np.cumsum(docs)])
        return pa.table({"bundle": t.column("bundle"), "p": t.column("p"), "anchors": binary_rows(np.ascontiguousarray(names[found, :5]), edges), "flag": binary_rows(flag[found], edges)})

    rows = packs.mapInArrow(emit, "p int, bundle long, anchors binary, docs binary")
    return rows.groupBy("p").applyInArrow(judge, "bundle long, p int, anchors binary, flag binary").where("length(flag) > 0")


def bundles(packs: DataFrame, *others: DataFrame) -> DataFrame:
    """The tables (bundle and others' columns) as rows of one bundle after the other:
    first what others say of it, then its batches in order."""
    cols = ["bundle", "kind", "seq", "a", "b", "c", "more"]
    out = packs.select("bundle", F.lit(len(others)).alias("kind"), "seq", F.col("ids").alias("a"), F.col("sizes").alias("b"), F.col("data").alias("c"), "more")
    for k, df in enumerate(others):
        said = [F.col(c) for c in df.columns if c not in ("bundle", "p")] + [F.lit(None).cast("binary")]
        out = out.union(df.select("bundle", F.lit(k).alias("kind"), F.col("p").alias("seq"), *(c.alias(a) for c, a in zip(said[:3], "abc", strict=True)), F.lit(False).alias("more")))
    return out.select(cols).repartition("bundle").sortWithinPartitions("bundle", "kind", "seq")


class Told:
    """What parts say of a bundle, row by row; looked up when all is there."""

    def __init__(self, parts: int):
        self.parts, self.rows, self.keys = np.uint64(parts), [], None

    def add(self, p: int, *columns: bytes) -> None:
        self.rows.append((p, *columns))

    def gathered(self) -> tuple[np.ndarray, list[bytes]]:
        """Parts, and each column as one string."""
        p, *columns = zip(*self.rows, strict=True) if self.rows else ((), (), (), ())
        return np.array(p, np.uint64), [b"".join(c) for c in columns]

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those asked for that are there, and where they are."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        same = np.flatnonzero(self.keys[at] == asked)
        return same, at[same]


class Flags(Told):
    """The shared anchors of a bundle."""

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        """0, 1 or 2 of each anchor."""
        if self.keys is None:
            p, (short, flag, *_) = self.gathered()
            flag = np.frombuffer(flag, np.uint8)
            names = np.zeros((len(flag), 8), np.uint8)
            names[:, 3:] = np.frombuffer(short, np.uint8).reshape(-1, 5)
            keys = names.view(np.uint64).ravel() | np.repeat(p, np.array([len(r[2]) for r in self.rows], np.int64))
            order = np.argsort(keys)
            self.keys, self.flag, self.rows = keys[order], flag[order], []
        out = np.zeros(len(anchors), np.uint8)
        same, at = self.find((anchors >> np.uint64(24) << np.uint64(24)) | (anchors % self.parts))
        out[same] = self.flag[at]
        return out


class Answers(Told):
    """Of a bundle's strings that lose something, by hash: the smallest id that holds
    the whole string, and a bit for each window that a smaller one holds."""

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.keys is None:
            _, columns = self.gathered()
            keys, own, bits = (np.frombuffer(c, k) for c, k in zip(columns, (np.uint64, np.int64, np.uint64), strict=True))
            order = np.argsort(keys)
            self.keys, self.own, self.bits, self.rows = keys[order], own[order], bits[order], []
        own, bits = np.full(len(h), NO_ID), np.zeros(len(h), np.uint64)
        same, at = self.find(h)
        own[same], bits[same] = self.own[at], self.bits[at]
        return own, bits


class Asked:
    """Strings of a bundle on their way to the parts."""

    def __init__(self):
        self.held, self.rows = 0, []

    def add(self, x: Batch) -> None:
        if len(x.h):
            size = x.len + WINDOW - 1
            self.rows.append((x.h, x.name, x.len, x.mark, x.least, x.buf[spans_of(x.at, size)]))
            self.held += int(size.sum())

    def send(self, bundle: int, parts: int):
        """Rows p, bundle, data, windows (lengths, marks and subsets) and least."""
        if not self.rows:
            return
        h, name, n, mark, least, data = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.held, self.rows = 0, []
        size = n + WINDOW - 1
        start = np.cumsum(size) - size
        _, first, of, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        low = np.full(len(first), NO_ID)
        np.minimum.at(low, of, least)
        multi = np.bincount(of, mark >= MULTI, len(first)) + (times > 1) > 0
        bucket = (name[first] % np.uint64(parts * SUBS)).astype(np.int64)
        order = np.lexsort((bucket // parts, bucket % parts))
        first, bucket, low, multi = first[order], bucket[order], low[order], multi[order]
        edges = bounds(bucket % parts)
        figures = np.stack([n[first].astype(np.uint8), mark[first] % np.uint8(MULTI) + np.where(multi, MULTI, 0).astype(np.uint8), (bucket // parts).astype(np.uint8)], 1)
        upto = np.r_[0, np.cumsum(size[first])]
        cols = [pa.array((bucket % parts)[edges[:-1]].astype(np.int32)), pa.array(np.full(len(edges) - 1, bundle)), squeezed(data[spans_of(start[first], size[first])], upto[edges]), binary_rows(figures, edges), binary_rows(low, edges)]
        yield from sent(["p", "bundle", "data", "windows", "least"], cols, np.diff(upto[edges]) + 11 * np.diff(edges))


def answers(packs: DataFrame, flags: DataFrame, parts: int) -> DataFrame:
    """bundle, p, h, own, bits: what Answers says of the bundle's strings of part p."""

    def emit(it):
        now, flagged, asked = None, None, Asked()
        for b in it:
            for r in b.to_pylist():
                if r["bundle"] != now:
                    yield from asked.send(now, parts)
                    now, flagged = r["bundle"], Flags(parts)
                if not r["kind"]:
                    flagged.add(r["seq"], r["a"], r["b"])
                    continue
                x = Batch(r["a"], r["b"], r["c"])
                x.strings(flagged(x.distinct))
                x.marks()
                asked.add(x)
                if asked.held > MOST_BYTES:
                    yield from asked.send(now, parts)
        yield from asked.send(now, parts)

    def solve(t: pa.Table) -> pa.Table:
        figures = [np.frombuffer(x, np.uint8).reshape(-1, 3) for x in t.column("windows").to_pylist()]
        least = [np.frombuffer(x, np.int64) for x in t.column("least").to_pylist()]
        data = [unsqueezed(x) for x in t.column("data").to_pylist()]
        upto = [np.r_[0, np.cumsum(f[:, 0].astype(np.int64) + WINDOW - 1)] for f in figures]
        out = []
        for q in range(SUBS):
            cut = [(int(np.searchsorted(f[:, 2], q)), int(np.searchsorted(f[:, 2], q, "right"))) for f in figures]
            row = np.repeat(np.arange(len(cut)), [z - a for a, z in cut])
            if not len(row):
                continue
            some = np.concatenate([f[a:z] for f, (a, z) in zip(figures, cut, strict=True)])
            own = np.concatenate([x[a:z] for x, (a, z) in zip(least, cut, strict=True)])
            text = np.concatenate([d[u[a] : u[z]] for d, u, (a, z) in zip(data, upto, cut, strict=True)])
            h, first, bits = solved(text, some[:, 0].astype(np.int64), some[:, 1], own)
            tell = np.flatnonzero((bits != 0) | (own > first) | (some[:, 1] >= MULTI))
            out.append((row[tell], h[tell], first[tell], bits[tell]))
        row, h, first, bits = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(t.num_rows + 1))
        return pa.table({"bundle": t.column("bundle"), "p": t.column("p"), "h": binary_rows(h[order], edges), "own": binary_rows(first[order], edges), "bits": binary_rows(bits[order], edges)})

    rows = bundles(packs, flags).mapInArrow(emit, "p int, bundle long, data binary, windows binary, least binary")
    return rows.groupBy("p").applyInArrow(solve, "bundle long, p int, h binary, own binary, bits binary").where("length(h) > 0")


def solved(data: np.ndarray, n: np.ndarray, mark: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (n windows each) -> their hashes, the smallest id of each, and the bits
    of its windows that a smaller id holds."""
    size = n + WINDOW - 1
    off = np.r_[0, np.cumsum(size)]
    one, inv, own, some = partners(data, off, mark, least)
    bits = np.zeros(len(one), np.uint64)
    if len(some):
        kept, many = data[spans_of(off[one[some]], size[one[some]])], n[one[some]]
        first = first_holders(kept, np.r_[0, np.cumsum(size[one[some]])], own[some])
        begin = np.cumsum(many) - many
        k = (np.arange(len(first)) - np.repeat(begin, many)).astype(np.uint64)
        bits[some] = np.bitwise_or.reduceat((first < np.repeat(own[some], many)).astype(np.uint64) << k, begin)
    return span_hashes(data, off[:-1], off[1:]), own[inv], bits[inv]


def begun(x: Batch, flagged: Flags, told: Answers) -> np.ndarray:
    """Starts of the batch's windows that a smaller id holds, in order."""
    x.strings(flagged(x.distinct))
    own, bits = told(x.h)
    some = np.flatnonzero(((own != NO_ID) | (bits != 0))[x.of])  # of the others nothing was said
    s, n, of, ids = x.s[some], x.n[some], x.of[some], x.ids[x.r[some]]
    later, first = np.flatnonzero(ids > own[of]), np.flatnonzero((ids == own[of]) & (bits[of] != 0))
    k = np.arange(WINDOW, dtype=np.uint64)
    found = [spans_of(s[later], n[later])]
    for part in np.array_split(first, max(1, len(first) // 65536)):
        row, place = np.nonzero((bits[of[part]][:, None] >> k) & np.uint64(1))
        found.append(s[part][row] + place)
    return np.unique(np.concatenate(found))


def covered(starts: np.ndarray, n: int, lead: int = 0) -> np.ndarray:
    """Which of n bytes lie in a window of the starts, or are among the first `lead`."""
    step = np.zeros(n + WINDOW + 1, np.int32)
    step[starts] += 1
    step[starts + WINDOW] -= 1
    out = np.cumsum(step[:n]) > 0
    out[:lead] = True
    return out


class Slices:
    """A text that comes in slices: digest, counts and runs so far."""

    def __init__(self):
        self.sha, self.bytes, self.removed, self.spans, self.lead, self.inside = hashlib.sha256(), 0, 0, [], 0, False

    def add(self, buf: np.ndarray, starts: np.ndarray, n: int) -> None:
        """n bytes of buf are the slice's own."""
        gone = covered(starts, len(buf), self.lead)[:n]
        self.lead = max(0, int(starts[-1]) + WINDOW - n, self.lead - n) if len(starts) else max(0, self.lead - n)
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        runs = [[int(a) + self.bytes, int(z) + self.bytes] for a, z in zip(edge[::2], edge[1::2], strict=True)]
        if self.inside and runs and runs[0][0] == self.bytes:
            self.spans[-1][1] = runs.pop(0)[1]
        self.spans += runs
        self.inside = bool(n) and bool(gone[-1])
        self.sha.update(buf[:n][~gone].tobytes())
        self.bytes, self.removed = self.bytes + n, self.removed + int(gone.sum())


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row; spans: also the
    removed runs as (start, end) bytes."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    packs = scratch.write(packed(df, key, text), "packs")
    # parts grow with the corpus: one takes the segments of PART_BYTES of text or so
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packs.count() * BATCH_BYTES // PART_BYTES))
    flags = scratch.write(shared_anchors(packs, parts), "flags")
    told = scratch.write(answers(packs, flags, parts), "answers")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def result(ids, n_bytes, n_removed, runs, digest):
        cols = [pa.array(ids, mask=ids == NO_ID), pa.array(n_bytes), pa.array(n_removed), pa.array([len(x) for x in runs], pa.int64()), pa.array(digest)]
        names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if spans:
            cols.append(pa.array([[{"start": a, "end": z} for a, z in x] for x in runs], run_type))
            names.append("spans")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def finish(it):
        now = flagged = said = slices = None
        for b in it:
            for r in b.to_pylist():
                if r["bundle"] != now:
                    now, flagged, said = r["bundle"], Flags(parts), Answers(parts)
                if r["kind"] == 0:
                    flagged.add(r["seq"], r["a"], r["b"])
                    continue
                if r["kind"] == 1:
                    said.add(r["seq"], r["a"], r["b"], r["c"])
                    continue
                x = Batch(r["a"], r["b"], r["c"])
                starts = begun(x, flagged, said)
                if r["more"] or slices is not None:
                    slices = slices or Slices()
                    slices.add(x.buf, starts, BATCH_BYTES if r["more"] else len(x.buf))
                    if not r["more"]:
                        yield result(x.ids, np.array([slices.bytes]), np.array([slices.removed]), [slices.spans], [slices.sha.hexdigest()])
                        slices = None
                    continue
                gone = covered(starts, len(x.buf))
                total = np.r_[0, np.cumsum(gone)]
                edge = np.zeros(len(gone) + 1, bool)  # texts lie end to end: a run ends with its text
                edge[1:-1] = gone[1:] != gone[:-1]
                cut = np.flatnonzero(edge)
                cut = np.unique(np.r_[cut, x.off])
                run = cut[:-1][gone[cut[:-1]]] if len(gone) else np.zeros(0, np.int64)
                stop = cut[np.searchsorted(cut, run) + 1] if len(run) else run
                row = np.searchsorted(x.off, run, "right") - 1
                runs: list = [[] for _ in x.ids]
                for a, z, k in zip(run.tolist(), stop.tolist(), row.tolist(), strict=True):
                    runs[k].append((a - int(x.off[k]), z - int(x.off[k])))
                kept = x.buf[~gone].tobytes()
                at = x.off - total[x.off]
                digest = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield result(x.ids, np.diff(x.off), np.diff(total[x.off]), runs, digest)

    schema = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:long,end:long>>" if spans else "")
    out = scratch.write(bundles(packs, flags, told).mapInArrow(finish, schema), "kept")
    scratch.drop(packs, flags, told)
    return out


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark, 16)
    return remove_repeats(texts(spark, sf_dir, "documents", "doc_id", "text"))


#: The same from all windows of all texts, in hexadecimal digits: a window goes if a
#: smaller id has it, windows that touch are one run, and what lies between runs stays.
SQL = f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, {2 * WINDOW}) AS s FROM (SELECT *, unnest(range(0, n - {WINDOW - 1})) AS k FROM n WHERE n >= {WINDOW})),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, k FROM w JOIN f USING (s) WHERE first < doc_id),
e AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {WINDOW} THEN 0 ELSE 1 END AS begins FROM g),
r AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM e),
spans AS (SELECT doc_id, min(k) AS a, max(k) + {WINDOW} AS z FROM r GROUP BY doc_id, run),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM spans GROUP BY doc_id),
pieces AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
 UNION ALL SELECT doc_id, coalesce(last, 0), n FROM n LEFT JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(kept.h)) AS kept_sha256 FROM n LEFT JOIN gone USING (doc_id) JOIN kept USING (doc_id)"""

QUERIES = {"op8_substrings": op8_substrings}
ORACLES = {"op8_substrings": SQL}
