"""Sharding by best-fit-decreasing bin packing.

Rows of equal text form indivisible groups. Groups of equal bytes are alike to the
packer, so it works on the number of groups of each size: sizes in falling order
enter the tightest bin that still has room, found in a balanced tree of remaining
capacities; a run of equal groups fills one tightest bin after the other, which is
what placing them one by one would do. A group larger than an even share gets a
bin to itself. The capacity is the smallest for which the wanted number of bins
suffices.

All sizes are packed by this one rule, however many there are; where a group goes
depends on no bound. The driver keeps 16 bytes for each different size, of which T
bytes of text can have no more than the square root of 2 T, unpacks EXACT of them at
a time and hands on what goes where in blocks of RUNS. Groups are placed by their
number among the groups of their size.

Null texts count as empty ones; very long ones are only measured and hashed. Ties and
repeated rows are rows of their own: groups keep them together, and slots number
them all. Numbers within a size or a shard follow a hash and come from counts of its
ranges, so no task gets a whole size or shard, and no number depends on the ranges.
Empty tables give no rows; further columns pass through `shard_table`, and clashing
names (size, shard, slot) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, text_of, texts

SHARDS = 40
OVERHEAD = 16
#: Different sizes that the driver unpacks at a time.
EXACT = 20_000
#: Runs of groups that go to a table at a time.
RUNS = 1_000_000
#: Rows of a range of hashes that one task numbers.
BUCKET_ROWS = 250


class Tree:
    """AA tree of (remaining capacity, bin): insert, delete, and the least entry
    not below a bound, all in logarithmic time."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # [key, level, left, right]

    @staticmethod
    def _skew(t):
        left = t[2]
        if left is not None and left[1] == t[1]:
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        right = t[3]
        if right is not None and right[3] is not None and right[3][1] == t[1]:
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def insert(self, key) -> None:
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def delete(self, key) -> None:
        def level(t):
            return 0 if t is None else t[1]

        def take(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[2] = take(t[2], key)
            elif key > t[0]:
                t[3] = take(t[3], key)
            elif t[2] is None:
                return t[3]
            elif t[3] is None:
                return t[2]
            else:
                x = t[2]
                while x[3] is not None:
                    x = x[3]
                t[0] = x[0]
                t[2] = take(t[2], x[0])
            least = min(level(t[2]), level(t[3])) + 1
            if least < t[1]:
                t[1] = least
                if level(t[3]) > least:
                    t[3][1] = least
            t = self._skew(t)
            if t[3] is not None:
                t[3] = self._skew(t[3])
                if t[3][3] is not None:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3] is not None:
                t[3] = self._split(t[3])
            return t

        self.root = take(self.root, key)

    def ceiling(self, key):
        t, best = self.root, None
        while t is not None:
            if t[0] >= key:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int, int]]:
    """sizes: (size, how many), falling. Gives (size, bin, how many) runs in
    placing order; new bins open as needed."""
    tree, bins = Tree(), 0
    for size, many in sizes:
        while many:
            found = tree.ceiling((size, -1))
            if found is None:
                room, b, bins = max(capacity, size), bins, bins + 1
            else:
                tree.delete(found)
                room, b = found
            k = min(many, room // size) if size else many
            yield size, b, k
            many -= k
            tree.insert((room - k * size, b))


def unpacked(sizes: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    for i in range(0, len(sizes), block):
        yield from sizes[i : i + block].tolist()


def packing(sizes: np.ndarray, shards: int, block: int = EXACT) -> Iterator[tuple[int, int, int]]:
    """sizes: (size, how many) in any order. Gives runs (size, shard, how many) over at
    most `shards` shards, by falling size."""
    sizes = sizes[np.argsort(-sizes[:, 0], kind="stable")]
    total, left = int(sizes[:, 0] @ sizes[:, 1]), shards
    while len(sizes) and left > 1 and int(sizes[0, 0]) * left > total:  # larger than an even share: a shard of its own
        size = int(sizes[0, 0])
        yield size, shards - left, 1
        total, left = total - size, left - 1
        sizes[0, 1] -= 1
        sizes = sizes[int(not sizes[0, 1]) :]
    if not len(sizes):
        return
    fits = lambda c: all(b < left for _, b, _ in best_fit(unpacked(sizes, block), c))
    low = high = max(-(-total // left), int(sizes[0, 0]))
    step = max(1, low // 1000)
    while not fits(high):
        low, high, step = high + 1, high + step, step * 2
    while low < high and high - low > max(1, high // 1_000_000):
        mid = (low + high) // 2
        if fits(mid):
            high = mid
        else:
            low = mid + 1
    for size, b, many in best_fit(unpacked(sizes, block), high):
        yield size, b + shards - left, many


def pack(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    return list(packing(np.array(sizes, np.int64).reshape(-1, 2), shards))


def plan_of(runs: Iterator[tuple[int, int, int]], scratch: Scratch) -> tuple[DataFrame, int]:
    """Runs by falling size as a table (bytes, _first, _last, shard) of the groups of each
    size that go to a shard, by their number, and how many runs there are."""
    names, kinds = ["bytes", "_first", "_last", "shard"], [np.int64, np.int64, np.int64, np.int32]
    parts, n, size, upto = [], 0, None, 0
    while block := list(islice(runs, RUNS)):
        rows = np.empty((len(block), 4), np.int64)
        for i, (s, shard, many) in enumerate(block):
            first = upto if s == size else 0
            size, upto = s, first + many
            rows[i] = s, first, upto, shard
        n += len(block)
        columns = [pa.array(np.ascontiguousarray(rows[:, i], kind)) for i, kind in enumerate(kinds)]
        parts.append(scratch.write(scratch.spark.createDataFrame(pa.table(columns, names)), "plan"))
    if not parts:
        parts = [scratch.spark.createDataFrame([], "bytes long, _first long, _last long, shard int")]
    return reduce(DataFrame.union, parts), n


def fill(load: list[int], rest: int) -> list[tuple[int, int]]:
    """(shard, bytes of smaller groups up to which it is filled), tightest room first:
    all that get any are filled to one level. shard_table does without it."""
    order = sorted(range(len(load)), key=lambda b: (load[b], b))
    level, open_, left = load[order[0]], 0, rest
    while open_ < len(order):
        open_ += 1
        above = load[order[open_]] if open_ < len(order) else None
        if above is None or (above - level) * open_ >= left:
            level += -(-left // open_)
            break
        left, level = left - (above - level) * open_, above
    out, upto = [], 0
    for b in reversed(order[:open_]):
        upto += level - load[b]
        out.append((b, upto))
    return out


def number(df: DataFrame, by: str, keys: list[str], buckets: Column, name: str) -> DataFrame:
    """df plus name: gapless numbers from 0 within `by`, in the order of a hash of the
    keys. A window numbers one range of hashes of one value, of which there are
    `buckets`; prefix sums of their counts do the rest."""
    df = df.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(*keys), 33))  # 31 bits
    df = df.withColumn("_bucket", F.shiftright(F.col("_hash") * buckets.cast("long"), 31))
    counts = df.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    within = df.withColumn("_k", F.row_number().over(W.partitionBy(by, "_bucket").orderBy("_hash", *keys)))
    out = within.join(counts.drop("_n"), [by, "_bucket"])
    return out.withColumn(name, (F.col("_k") - 1 + F.coalesce("_before", F.lit(0))).cast("long")).drop("_hash", "_bucket", "_k", "_before")


def shard_table(df: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS, exact: int = EXACT) -> DataFrame:
    """df without its text, plus size, shard and slot; join by key to get texts. exact:
    sizes that the driver unpacks at a time, which changes no result."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    df = df.drop("size", "shard", "slot", "_group")
    df = df.withColumn("size", (F.octet_length(text_of(text)) + OVERHEAD).cast("long")).withColumn("_group", F.unhex(F.sha2(text_of(text), 256)))
    df = scratch.write(df.drop(text), "keys")
    groups = scratch.write(df.groupBy("_group").agg(F.sum("size").alias("bytes")), "groups")
    n = groups.count()
    sizes = scratch.write(groups.groupBy("bytes").agg(F.count("*").alias("n")), "sizes")
    held = sizes.select("bytes", "n").toArrow()
    held = np.stack([c.to_numpy().astype(np.int64) for c in held.columns], axis=1)
    plan, n_runs = plan_of(packing(held, shards, exact), scratch)
    numbered = number(groups, "bytes", ["_group"], F.lit(max(1, -(-n // BUCKET_ROWS))), "_rank")
    placed = numbered.join(checked_broadcast(plan, n_runs), "bytes").where("_rank >= _first AND _rank < _last").select("_group", "shard")
    placed = scratch.write(placed, "placed")
    dealt = scratch.write(df.join(placed, "_group"), "dealt")
    rows = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    most = F.array(*(F.lit(max(1, -(-rows.get(i, 0) // BUCKET_ROWS))) for i in range(shards)))
    return number(dealt, "shard", [key, "_group"], F.element_at(most, F.col("shard") + 1), "slot").drop("_group")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_table(texts(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(text_of().cast("binary")).alias("text_crc32")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict = {}
