"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: texts are lower-cased (A-Z only) and cut into words; every run of three
words, repeats included, is hashed by XXH64; a bit is set if more than half of the
hashes have it. A text of fewer words is one run; a text without words has the
fingerprint zero and is linked like any other.

Search: each of the 64 bit places gets a random non-zero vector of RADIUS + 1 bits.
Every non-zero vector v of that length makes a mask of the places whose vector has
odd inner product with v. At most RADIUS differing places span too little to meet
all v, so some mask covers none of them: every pair within the radius agrees on a
mask and meets in that table. Pairs that meet are verified exactly.

Equal fingerprints are one node, named by their smallest id. A bucket of one mask
yields a spanning forest of its verified links, not all of its pairs. The nodes of a
bucket of more than BUCKET are masked again, by another family, within the bucket,
until none is larger: as each family covers every pair within the radius, so does
each of its nodes' new buckets, and as different nodes differ somewhere, masks of a
few families leave no large bucket. Components come from alternating star
contractions over written tables.

Null texts count as empty; very long ones are read whole. Ties and repeated rows fall
into one component; an empty table gives none. Rows with a null id are kept, with a
null component. Columns besides key and text play no part in `near_groups`, whatever
their names, and pass through `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, batches, checked_broadcast, chunks, string_bytes, texts, whole_groups, word_spans

RADIUS = 3
SHINGLE = 3
BUCKET = 1024
SEED = 2024


def masks(radius: int = RADIUS, seed: int = SEED) -> np.ndarray:
    """2^(radius+1) - 1 masks of 64 bits that cover every difference of `radius` places."""
    rng = np.random.default_rng(seed)
    own = rng.integers(1, 1 << (radius + 1), 64)
    out = []
    for v in range(1, 1 << (radius + 1)):
        out.append(sum(1 << i for i in range(64) if bin(int(own[i]) & v).count("1") & 1))
    return np.array(out, np.uint64)


def fingerprints(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One uint64 a text."""
    n = len(off) - 1
    out = np.zeros(n, np.uint64)
    low = LOWER[buf]
    s, e, row = word_spans(low, off)
    if not len(s):
        return out
    # words of a text joined by single spaces: move every word to its new place
    width = e - s + 1
    at = np.cumsum(width) - width
    flat = np.full(int(width.sum()), 32, np.uint8)
    inside = np.arange(len(flat)) - np.repeat(at, width)
    word = inside < np.repeat(e - s, width)
    flat[word] = low[(np.repeat(s, width) + inside)[word]]
    many = np.bincount(row, minlength=n)
    first = np.cumsum(many) - many
    runs = np.maximum(many - shingle + 1, (many > 0).astype(int))
    owner = np.repeat(np.arange(n), runs)
    k = first[owner] + np.arange(len(owner)) - (np.cumsum(runs) - runs)[owner]
    last = np.minimum(k + shingle, first[owner] + many[owner]) - 1
    a, b = at[k].tolist(), (at[last] + e[last] - s[last]).tolist()
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    has = np.flatnonzero(runs)
    edge = (np.cumsum(runs) - runs)[has]
    half = runs[has] // 2
    for lo in range(0, 64, 8):  # eight places at a time keep the bit matrix small
        bits = np.unpackbits(((h >> np.uint64(lo)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        total = np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
        for i in range(8):
            out[has] |= np.where(total[:, i] > half, np.uint64(1 << (lo + i)), np.uint64(0))
    return out


def with_fingerprint(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (the 64 bits as a signed long)."""

    def run(it):
        for b in it:
            buf, off = string_bytes(b.column(1))
            fp = [fingerprints(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _forest(fp: np.ndarray, node: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among fp."""
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1
        for k in near[root[near] != root[i]].tolist():
            a, b = find(i), find(k)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node[i], node[k]))
    return out


def masked(rows: DataFrame, radius: int, family: int) -> DataFrame:
    """rows: fp, node, key -> each once for every mask of a family, in a bucket of its
    bucket."""
    each = [F.struct(F.lit(i).alias("i"), F.lit(int(m) - (1 << 64) if m >= 1 << 63 else int(m)).cast("long").alias("m")) for i, m in enumerate(masks(radius, SEED + family).tolist())]
    rows = rows.select("fp", "node", "key", F.explode(F.array(*each)).alias("t"))
    return rows.select("fp", "node", F.xxhash64("key", F.col("t.i"), F.col("fp").bitwiseAND(F.col("t.m"))).alias("key"))


def links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """nodes: fp, node (distinct fingerprints) -> a, b: links that connect what is
    within the radius."""
    rows, plain, family = nodes.select("fp", "node", F.lit(0).cast("long").alias("key")), None, 0
    while True:
        rows = masked(rows, radius, family)
        hot = scratch.write(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "hot")
        n, family = hot.count(), family + 1
        if not n:
            plain = rows if plain is None else plain.union(rows)
            break
        side = checked_broadcast(hot, n)
        own = rows.join(side, "key", "left_anti").select("fp", "node", "key")
        plain = own if plain is None else plain.union(own)
        rows = scratch.write(rows.join(side, "key", "left_semi").select("fp", "node", "key"), "large")

    def run(it):
        """Rows come sorted by bucket."""
        for t, edges in whole_groups(it, ["key"]):
            fp, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, z = [node[near]], [node[near + 1]]
            for g in np.flatnonzero(size > 2).tolist():
                if found := _forest(fp[edges[g] : edges[g + 1]], node[edges[g] : edges[g + 1]], radius):
                    x = np.array(found)
                    a.append(x[:, 0])
                    z.append(x[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], names=["a", "b"])

    out = plain.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")
    return out.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: u > v -> u, v: v is the smallest node that u reaches (roots are left
    out). Large and small star contractions until nothing moves."""
    e, before = scratch.write(edges, "edges"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = scratch.write(least, "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.write(large, "large")
        least2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.union(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(30,0)"))).first())
        scratch.drop(e, least, large, least2)
        e = new
        if now == before:
            return e
        before = now


def near_groups(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """key, fp (signed long) and component (smallest key reachable) of every row."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    fps = scratch.write(with_fingerprint(df, text, key), "fp")
    nodes = scratch.write(fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    found = components(links(nodes.select("fp", F.col("node").cast("long").alias("node")), scratch, radius), scratch)
    roots = scratch.write(nodes.join(found, nodes.node == found.u, "left").select("fp", F.coalesce("v", "node").alias("component")), "roots")
    out = fps.join(roots, "fp", "left")
    return out.select(F.col("id").alias(key), "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of df that are the smallest id of their component. Rows of a null id
    stay; of rows that share that id, each stays."""
    found = near_groups(df.select(key, text), text, key, radius)
    gone = found.where(F.col("component") != F.col(key)).select(F.col(key).alias("_gone")).distinct()
    gone = Scratch(df.sparkSession).write(gone, "gone")
    return df.join(checked_broadcast(gone, gone.count()), F.col(key) == F.col("_gone"), "left_anti")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    out = near_groups(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _sql() -> str:
    """The same without masks: XXH64 from its definition (all figures modulo 2^64, bytes
    as hexadecimal digits), all pairs of fingerprints, and closure by recursion."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    whole = f"{1 << 64}::UHUGEINT"
    mod = lambda x: f"(({x}) % {whole})"
    times = lambda x, p: mod(f"({x}) * {p}::UHUGEINT")
    turn = lambda x, n: f"({mod(f'({x}) * {1 << n}::UHUGEINT')} + ({x}) // {1 << (64 - n)}::UHUGEINT)"
    eight = lambda h, at: "('0x' || " + " || ".join(f"substr({h}, 2 * ({at}) + {2 * k + 1}, 2)" for k in range(7, -1, -1)) + ")::UBIGINT::UHUGEINT"
    four = lambda h, at: "('0x' || " + " || ".join(f"substr({h}, 2 * ({at}) + {2 * k + 1}, 2)" for k in range(3, -1, -1)) + ")::UBIGINT::UHUGEINT"
    lane = lambda acc, h, at: times(turn(mod(f"({acc}) + {times(eight(h, at), p2)}"), 31), p1)
    seeds = [(42 + p1 + p2) % 2**64, 42 + p2, 42, (42 - p1) % 2**64]
    lanes = ", ".join(f"list_reduce(list_prepend({v % 2**64}::UHUGEINT, list_transform(range(0, n // 32), lambda j: {eight('h', f'32 * j + {8 * i}')})), lambda a, x: {times(turn(mod(f'a + {times("x", p2)}'), 31), p1)}) AS v{i + 1}" for i, v in enumerate(seeds))
    begun = mod(" + ".join(turn(f"v{i}", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18))))
    for i in range(1, 5):
        begun = mod(f"{times(f'xor({begun}, {times(turn(times(f"v{i}", p2), 31), p1)})', p1)} + {p4}::UHUGEINT")
    tail8 = mod(f"{times(turn(f'xor(a, {times(turn(times("x", p2), 31), p1)})', 27), p1)} + {p4}::UHUGEINT")
    tail4 = mod(f"{times(turn(f'xor(a, {times(four("h", "d"), p1)})', 23), p2)} + {p3}::UHUGEINT")
    tail1 = times(turn(f"xor(a, {times('x', p5)})", 11), p1)
    steps = [("a1", f"CASE WHEN n >= 32 THEN {begun} ELSE {42 + p5}::UHUGEINT END"), ("a2", mod("a1 + n::UHUGEINT"))]
    parts = ", ".join(f"sum((x >> {b}) & 1) AS b{b}" for b in range(64))
    bits = " + ".join(f"(CASE WHEN 2 * b{b} > many THEN {1 << b}::UHUGEINT ELSE 0 END)" for b in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM d WHERE len(w) > 0),
u AS (SELECT s, hex(s) AS h, length(hex(s)) // 2 AS n FROM (SELECT DISTINCT s FROM g)),
v AS MATERIALIZED (SELECT *, {lanes} FROM u),
k1 AS MATERIALIZED (SELECT s, h, n, {steps[0][1]} AS a1 FROM v),
k2 AS MATERIALIZED (SELECT s, h, n, {steps[1][1]} AS a2, n - n % 8 AS c, n - n % 8 + (n % 8) // 4 * 4 AS e FROM k1),
k3 AS MATERIALIZED (SELECT s, h, n, c AS d, e, list_reduce(list_prepend(a2, list_transform(range(n // 32 * 4, c // 8), lambda j: {eight("h", "8 * j")})), lambda a, x: {tail8}) AS a FROM k2),
k4 AS MATERIALIZED (SELECT s, h, n, e, CASE WHEN e > d THEN {tail4} ELSE a END AS a4 FROM k3),
k5 AS MATERIALIZED (SELECT s, list_reduce(list_prepend(a4, list_transform(range(e, n), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::UBIGINT::UHUGEINT)), lambda a, x: {tail1}) AS a5 FROM k4),
k6 AS MATERIALIZED (SELECT s, {times(f"xor(a5, a5 // {1 << 33}::UHUGEINT)", p2)} AS a6 FROM k5),
k7 AS MATERIALIZED (SELECT s, {times(f"xor(a6, a6 // {1 << 29}::UHUGEINT)", p3)} AS a7 FROM k6),
x AS MATERIALIZED (SELECT s, xor(a7, a7 // {1 << 32}::UHUGEINT)::UBIGINT AS x FROM k7),
t AS (SELECT doc_id, count(*) AS many, {parts} FROM g JOIN x USING (s) GROUP BY doc_id),
f AS MATERIALIZED (SELECT d.doc_id, coalesce({bits}, 0::UHUGEINT)::UBIGINT AS fp FROM d LEFT JOIN t USING (doc_id)),
q AS MATERIALIZED (SELECT fp, min(doc_id) AS id FROM f GROUP BY fp),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM q a, q b WHERE bit_count(xor(a.fp, b.fp)::HUGEINT) <= {RADIUS}),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN q USING (fp) JOIN least USING (id)"""


QUERIES = {"op10_simhash": op10_simhash}
ORACLES = {"op10_simhash": _sql()}
