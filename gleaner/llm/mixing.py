"""Mixing sources to target weights by the cube method.

Every document has an expected number of copies, its source's target over its
source's size. The whole part is taken for sure; the fraction is an inclusion
probability that the cube method rounds to 0 or 1 while it holds the number of
documents and of words of every source: within a block of documents of one source
the probabilities walk along the null space of the two balance constraints until
at most two of a block are left between 0 and 1. What is left of all blocks, with
RESERVE others, is dealt into blocks again. In the end all but LANDING of a source's
open documents fly, and the last are landed by a linear programme over all their
outcomes: of those whose words bring the source within NEAR of its target, a draw
whose mean is the probabilities.

Documents of more than OUTSIZE of their source's target go first, by the same
programme, with what the others hold and could hold as a supply of words; of many,
each, from the largest on, is rounded while all the others make up for its words in
proportion to their room, so the walk stays in the null space of the words. Then the
others' probabilities are what that left them. Where there are fewer than FEW
others, all go together. A source of COPIES documents or fewer is landed at once,
over all numbers of whole copies (0 to 3) of each.

Every step keeps the mean of a probability, so over many seeds a document is taken
as often as its rate says. Where no draw among near outcomes can have that mean (a
source of few or very unequal documents), nearness goes first, and the draw's mean
is as close as near outcomes allow; where no outcome is near, the nearest are used.

Blocks hold BLOCK documents or so, whatever the size of a source, so a hot source
is many blocks, and a task walks one block after another. Targets come from the
table of sources, however many there are. Random draws come from a generator seeded
by the block, and blocks from hashes of the ids, so reruns agree. A document of no
words takes nothing (null and empty texts too). A null source is a source of its
own. Repeated ids are rows of their own, told apart by an occurrence number of rows
of one id, source and size. Very long texts are only counted. Columns of documents
other than the four named ones play no part, whatever their names; `mixed` passes
them through. An empty table gives an empty mix.
"""

from __future__ import annotations

import random
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import numbered
from .common import Scratch, batches, checked_broadcast, n_words, texts, whole_groups

BLOCK = 256
#: A document of more than this share of its source's target is settled before the
#: others, if there are FEW others at least, whose probabilities then make up for it.
OUTSIZE = 0.05
FEW = 64
LANDING = 12
#: Units of ordinary size of each source that are kept open for the last turn.
RESERVE = 128
#: Share of a source's target that a landing may miss, if outcomes that near have the
#: right mean, or that the next one has.
NEAR = (0.005, 0.01)
#: Sources of no more documents are landed over whole copies.
COPIES = 7
TINY = 1e-9
CAP = 3.0
#: Rows of one id, source and size that one task tells apart.
ALIKE = 4096


def targets(sizes: dict, weights=(1, 2, 3), cap: float = CAP) -> dict:
    """Share out 100 % of all sizes by weight; what exceeds cap times a source's
    size goes to the others by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, rest = {}, order, float(sum(sizes.values()))
    while left:
        whole = sum(weight[s] for s in left)
        full = [s for s in left if rest * weight[s] / whole > cap * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / whole for s in left}
        out |= {s: cap * sizes[s] for s in full}
        rest -= sum(out[s] for s in full)
        left = [s for s in left if s not in out]
    return out


def flight(p: list[float], size: list[float], rng: random.Random, units: list[int] | None = None) -> list[int]:
    """Walk the probabilities of the units (all by default) in place, three open
    ones at a time: they span a line on which both balances hold. Returns the one
    or two units that stay open."""
    open_ = [i for i in (range(len(p)) if units is None else units) if 0 < p[i] < 1]
    active: list[int] = []
    while True:
        while len(active) < 3 and open_:
            active.append(open_.pop())
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = [c - b, a - c, b - a]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = [1.0, -1.0]
        else:
            return active
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(active, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(active, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            x = p[i] + step * v
            p[i] = 0.0 if x < TINY else 1.0 if x > 1 - TINY else x
        active = [i for i in active if 0 < p[i] < 1]


def average(outcomes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """Chances of the outcomes (rows) whose mean is p, or as near to p as can be (sum
    of absolute differences), and that difference: a linear programme, by the simplex
    method from the outcome nearest to p."""
    m, n = outcomes.shape
    first = int(np.abs(outcomes - p).sum(1).argmin())
    sign = np.where(p >= outcomes[first], 1.0, -1.0)
    # columns: m outcomes, then n surpluses, then n shortfalls
    basis = np.r_[first, np.where(sign > 0, m, m + n) + np.arange(n)]
    right = np.r_[1.0, p]

    def column(j: int) -> np.ndarray:
        if j < m:
            return np.r_[1.0, outcomes[j]]
        out = np.zeros(n + 1)
        out[1 + (j - m) % n] = 1.0 if j < m + n else -1.0
        return out

    for turn in range(50 * (n + 1)):
        inverse = np.linalg.inv(np.stack([column(j) for j in basis], 1))
        level = inverse @ right
        price = (basis >= m).astype(float) @ inverse
        gain = np.r_[-(price[0] + outcomes @ price[1:]), 1 - price[1:], 1 + price[1:]]
        if gain.min() > -1e-9:
            break
        enter = int(gain.argmin()) if turn < 20 * (n + 1) else int(np.flatnonzero(gain < -1e-9)[0])
        move = inverse @ column(enter)
        some = np.flatnonzero(move > 1e-11)
        ratio = np.maximum(level[some], 0) / move[some]
        tied = some[ratio <= ratio.min() + 1e-12]
        basis[tied[basis[tied].argmin()]] = enter
    chance = np.zeros(m)
    own = basis < m
    np.add.at(chance, basis[own], np.maximum(level[own], 0))
    return chance / chance.sum(), float(np.abs(level[~own]).sum())


@lru_cache(maxsize=16)
def grid(n: int, most: int) -> np.ndarray:
    """All rows of n numbers from 0 to most."""
    return np.array(list(product(range(most + 1), repeat=n)), float)


def outcome(s: np.ndarray, p: np.ndarray, base: float, goal: float, near, rng: random.Random, most: int = 1, under: float = 0.0, over: float = 0.0) -> np.ndarray:
    """Numbers 0 to `most` of each unit: drawn with mean p from all those that bring
    base plus their words within a share `near` of goal (a miss between -under and
    over counts as none), or else from the nearest."""
    all_ = grid(len(s), most)
    off = base + all_ @ s - goal
    off = np.maximum(0.0, np.maximum(off - over, -under - off))
    best = None
    for share in near:
        some = all_[off <= max(off.min(), share * goal) + TINY]
        chance, miss = average(some, p)
        if best is None or miss < best[2] - 1e-9:
            best = some, chance, miss
        if miss < 1e-7:
            break
    some, chance, _ = best
    upto = np.cumsum(chance)
    return some[min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), len(some) - 1)]


def settle(p: list[float], size: list[float], big: list[int], rng: random.Random, under: float = 0.0, over: float = 0.0) -> tuple[float, float]:
    """Round the units `big` in place, in that order, each while all other open units,
    and a supply of `over` words taken and `under` not, make up for its words in
    proportion to their room. One that they can't make up for stays open. Returns
    what is left of the supply."""
    x, s = np.array(p), np.array(size)
    whole = under + over
    for k in big:
        if not 0 < x[k] < 1:
            continue
        room = np.minimum(x / (1 - x[k]), (1 - x) / x[k])
        room[(x <= 0) | (x >= 1)] = 0
        room[k] = 0
        ready = min(over / (1 - x[k]), under / x[k])
        total = float(room @ s) + ready
        if total < s[k]:
            continue
        part = s[k] / total
        step = 1 - x[k] if rng.random() < x[k] else -x[k]
        x -= part * room * step
        over, under = over - part * ready * step, under + part * ready * step
        x[k] = float(step > 0)
        x[x < TINY] = 0
        x[x > 1 - TINY] = 1
        over, under = max(0.0, min(whole, over)), max(0.0, min(whole, under))
    p[:] = x.tolist()
    return under, over


def land(p: list[float], size: list[float], rng: random.Random, goal: float | None = None, under: float = 0.0, over: float = 0.0) -> None:
    """Round all of p in place. goal: the words that the source should take. Others
    outside p hold `over` words now and could hold `under` more, so what is missed by
    that much is made up for.

    Up to LANDING + 2 open units are drawn together. Of more, those of more than
    OUTSIZE of goal come first: all but the last LANDING + 2 of them are settled, and
    these are drawn, with the rest as a supply of words. Then LANDING units, one of
    each class of size, are set aside, the others fly, and those set aside and those
    still open are drawn."""
    goal = sum(x * s for x, s in zip(p, size, strict=True)) if goal is None else goal
    still = lambda units: [i for i in units if 0 < p[i] < 1]

    def draw(units: list[int], under: float, over: float) -> float:
        """Round the units; the words that they take beyond what was expected."""
        s, q = np.array([size[i] for i in units]), np.array([p[i] for i in units])
        got = outcome(s, q, goal - float(q @ s), goal, NEAR, rng, 1, under, over)
        for i, b in zip(units, got.tolist(), strict=True):
            p[i] = b
        return float((got - q) @ s)

    def stratified(units: list[int]) -> list[int]:
        """LANDING units set aside, the others flown: what stays open."""
        units = sorted(units, key=lambda i: (size[i], i))
        if len(units) <= LANDING + 2:
            return units
        aside = {units[int((k + rng.random()) * len(units) / LANDING)] for k in range(LANDING)}
        fly = [i for i in units if i not in aside]
        rng.shuffle(fly)
        return sorted(aside) + flight(p, size, rng, fly)

    open_ = still(range(len(p)))
    if len(open_) > LANDING + 2:
        big = sorted((i for i in open_ if size[i] > OUTSIZE * goal), key=lambda i: (-size[i], i))
        under, over = settle(p, size, big[: -LANDING - 2], rng, under, over)
        if left := still(big):
            left, apart = stratified(left), set(big)
            rest = [i for i in still(range(len(p))) if i not in apart]
            have, room = sum(p[i] * size[i] for i in rest), sum((1 - p[i]) * size[i] for i in rest)
            excess = draw(left, under + room, over + have)
            # those outside p and the rest give or take their parts of the excess
            share = min(1.0, excess / (over + have)) if excess > 0 else max(-1.0, excess / max(under + room, TINY))
            for i in rest:
                p[i] -= p[i] * share if share > 0 else (1 - p[i]) * share
                p[i] = 0.0 if p[i] < TINY else 1.0 if p[i] > 1 - TINY else p[i]
            over, under = (over - over * share, under + over * share) if share > 0 else (over - under * share, under + under * share)
        open_ = stratified(still(range(len(p))))
    if open_:
        draw(open_, under, over)


COLUMNS = ("src", "block", "h", "n", "p", "goal", "under", "over")


def _walk(df: DataFrame, how: str, seed: int) -> DataFrame:
    """df: COLUMNS and others -> the same with p moved, block by block (flight), or
    rounded (land, or copies for whole numbers of copies); sorted blocks lie one
    after the other in a task. Rows without a block stay as they are."""
    names = df.columns
    at = names.index("p")

    def run(it):
        for t, edges in whole_groups(it, ["src", "block"], 8192):
            col = {c: t.column(c).to_numpy() for c in COLUMNS}
            out = col["p"].copy()
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rng = random.Random(f"{seed}|{how}|{col['src'][a]}|{col['block'][a]}")
                p, size = col["p"][a:z].tolist(), col["n"][a:z].astype(float).tolist()
                if how == "copies":
                    s, q = np.array(size), np.array(p)
                    p = outcome(s, q, 0.0, float(q @ s), NEAR, rng, int(CAP))
                else:
                    p = [0.0 if x < TINY else 1.0 if x > 1 - TINY else x for x in p]
                    if how == "land":
                        land(p, size, rng, col["goal"][a], col["under"][a], col["over"][a])
                    else:
                        flight(p, size, rng)
                out[a:z] = p
            yield from t.set_column(at, "p", pa.array(out)).to_batches(max_chunksize=65536)

    blocks = df.where("block IS NOT NULL").repartition("src", "block").sortWithinPartitions("src", "block", "h", "n", "_name", "_again")
    moved = blocks.mapInArrow(run, df.schema)
    return moved.union(df.where("block IS NULL")) if how == "flight" else moved


def cube(df: DataFrame, scratch: Scratch, seed: int = 11, block: int = BLOCK, name: str = "cube") -> DataFrame | None:
    """df: src, h (hash of a row), n (size), p (0 to 1), goal, under and over (as in
    land), and other columns -> the same with p 0 or 1; None for no rows."""
    columns, done, rest, turn = df.columns, [], df, 0
    while True:
        many = rest.groupBy("src").count()
        most, n = many.agg(F.max("count"), F.count("*")).first()
        if not n:
            break
        last = most <= 4 * block
        blocks = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(turn), "h"), F.ceil(F.col("count") / block).cast("long"))
        if not last:
            blocks = F.when(F.pmod(F.xxhash64(F.lit("reserve"), "h"), F.col("count")) >= RESERVE, blocks)
        keyed = rest.join(checked_broadcast(many, n), "src").withColumn("block", blocks.cast("long")).select(*columns, "block")
        walked = scratch.write(_walk(keyed, "land" if last else "flight", seed + turn), f"{name}{turn}")
        done.append(walked.where("p <= 0 OR p >= 1").select(columns))
        if last:
            break
        rest, turn = walked.where("p > 0 AND p < 1").select(columns), turn + 1
    out = None
    for x in done:
        out = x if out is None else out.union(x)
    return out


def goals(sizes: DataFrame, weights, scratch: Scratch, cap: float = CAP) -> DataFrame:
    """sizes: source, size -> the same with src (its number in code-point order, null
    last) and target. What every unit of weight gets is found by rounds over the
    table: sources it would bring above the cap take the cap, and the rest is shared
    anew, until none is above."""
    s = numbered(sizes, [F.col("source").asc_nulls_last()], "src", lambda df: scratch.write(df, "sources"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = scratch.write(s.withColumn("weight", weight), "numbered")
    total = float(s.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    each, before = total / (s.agg(F.sum("weight")).first()[0] or 1.0), 0
    while True:
        full = F.lit(each) * F.col("weight") > cap * F.col("size")
        n, held, left = s.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == before or not left:
            break
        each, before = (total - cap * held) / left, n
    return s.withColumn("target", F.least(F.lit(each) * F.col("weight"), cap * F.col("size"))).drop("weight")


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=(1, 2, 3), seed: int = 11) -> DataFrame:
    """Per document: key, size, source_size, target of its source, copies, taken,
    _source, and _again, its number among the rows of that key, source and size."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), n_words(text).alias("n"))
    counted = scratch.write(rows.groupBy("_key", "source", "n").agg(F.count("*").alias("_times")), "counted")
    sizes = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("_times")).alias("size"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("_times"))), F.lit(0)).alias("sized"))
    plan = goals(sizes, weights, scratch).withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0))
    few = F.col("sized") <= COPIES
    plan = plan.withColumn("whole", F.when(few, 0.0).otherwise(F.floor(F.col("rate") + 1e-9).cast("double"))).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    plan = scratch.write(plan.select("src", "source", F.col("size").alias("source_size"), "target", "whole", "p", few.alias("copies")), "plan")
    n = plan.count()
    x = counted.join(checked_broadcast(plan, n), counted.source.eqNullSafe(plan.source)).drop(plan.source)
    x = _told_apart(x).withColumn("_name", F.col("_key").cast("string"))
    x = scratch.write(x.withColumn("h", F.xxhash64("_name", "source", "n", "_again")), "rows")
    open_ = x.where("p > 1e-9 AND n > 0").withColumn("goal", F.col("target")).withColumn("under", F.lit(0.0)).withColumn("over", F.lit(0.0))
    closed = x.where("NOT (p > 1e-9 AND n > 0)").withColumn("p", F.lit(0.0))
    # by source: the words of the others, and what they and the outsized would take
    words = F.col("n").cast("double")
    big = F.col("n") > OUTSIZE * F.col("target")
    small = F.when(~big, words)
    rest = open_.where("NOT copies").groupBy("src").agg(F.count(small).alias("others"), F.count(F.when(big, 1)).alias("bigs"), F.sum(F.col("p") * words).alias("all"), F.coalesce(F.sum(small), F.lit(0.0)).alias("words"), F.coalesce(F.sum(F.col("p") * small), F.lit(0.0)).alias("small"))
    rest = scratch.write(rest.withColumn("together", (F.col("others") < FEW) | (F.col("bigs") == 0)), "shares")
    names = open_.columns
    split = open_.where("NOT copies").join(checked_broadcast(rest, n), "src")
    first = split.where(big & ~F.col("together")).withColumn("under", F.col("words") - F.col("small")).withColumn("over", F.col("small")).select(names)
    settled = cube(first, scratch, seed, name="outsized")
    fly = split.where(~big | F.col("together"))
    if settled is not None:
        had = settled.groupBy("src").agg(F.sum(F.col("n") * F.col("p")).alias("had"))
        left = F.greatest(F.lit(0.0), F.col("all") - F.col("had")) / F.col("words")
        fly = fly.join(checked_broadcast(had, n), "src", "left").withColumn("p", F.when(F.col("had").isNull(), F.col("p")).otherwise(F.least(F.lit(1.0), left)))
    flown = cube(fly.select(names), scratch, seed)
    pairs = open_.where("copies").withColumn("block", F.lit(0).cast("long"))
    landed = scratch.write(_walk(pairs, "copies", seed), "copies").select(names)
    shown = ["_key", "n", "source", "source_size", "target", "whole", "p", "_again"]
    out = closed.select(shown)
    for part in (settled, flown, landed):
        if part is not None:
            out = out.union(part.select(shown))
    copies = (F.col("whole") + F.col("p")).cast("int")
    return out.select(F.col("_key").alias(key), F.col("n").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("n") * copies).alias("taken"), F.col("source").alias("_source"), "_again")


def _told_apart(df: DataFrame) -> DataFrame:
    """A row for each of _times, with its number _again; many alike are dealt out."""
    runs = F.explode(F.sequence(F.lit(0), ((F.col("_times") - 1) / ALIKE).cast("long")))
    few, many = df.where(F.col("_times") <= ALIKE), df.where(F.col("_times") > ALIKE)
    few = few.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    many = many.withColumn("_run", runs).repartition("_key", "source", "n", "_run")
    upto = F.least(F.col("_times"), (F.col("_run") + 1) * ALIKE)
    many = many.withColumn("_again", F.explode(F.sequence(F.col("_run") * ALIKE + 1, upto))).drop("_run")
    return few.unionByName(many).drop("_times")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=(1, 2, 3)) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that agree in id,
    source and size are numbered, and each is taken as its number is."""
    scratch = Scratch(docs.sparkSession)
    taken = mix_sources(docs, key, source, text, weights).select(F.col(key).alias("_k"), "_source", F.col("size").alias("_n"), "_again", F.col("copies").alias("_copies"))
    taken = scratch.write(taken, "taken")
    alike = scratch.write(taken.where("_again = 2").select("_k", "_source", "_n"), "alike")
    n = alike.count()
    rows = docs.withColumn("_size", n_words(text))

    def same(t: DataFrame) -> Column:
        return rows[key].eqNullSafe(t["_k"]) & rows[source].cast("string").eqNullSafe(t["_source"]) & (rows["_size"] == t["_n"])

    def repeated(df: DataFrame) -> DataFrame:
        return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)

    plain, side = rows, checked_broadcast(alike, n)
    if n:
        plain = rows.join(side, same(side), "left_anti")
        again = scratch.write(rows.join(side, same(side), "left_semi").withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "repeated")
        again = _places(again.withColumn("_gk", F.col(key)).withColumn("_gs", F.col(source).cast("string")).withColumn("_gn", F.col("_size")))
    counts = taken.where("_copies > 0")
    # taken grows with docs: a shuffle at every size
    out = repeated(plain.join(counts.hint("merge"), same(counts)))
    if n:
        alike_too = again["_gk"].eqNullSafe(counts["_k"]) & again["_gs"].eqNullSafe(counts["_source"]) & (again["_gn"] == counts["_n"])
        out = out.union(repeated(again.join(counts.hint("merge"), alike_too & (again["_place"] == counts["_again"]))))
    return out


def _places(rows: DataFrame) -> DataFrame:
    """rows (written, with _part and _id) plus _place: numbers from 1 within _gk, _gs
    and _gn. One task numbers what one task wrote of a group; sums of the counts
    before do the rest."""
    group = ["_gk", "_gs", "_gn"]
    counts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*(F.col(c).alias(f"{c}_") for c in (*group, "_part")), F.coalesce(before, F.lit(0)).alias("_before"))
    x = rows.withColumn("_own", F.row_number().over(W.partitionBy(*group, "_part").orderBy("_id")))
    same = x["_part"] == counts["_part_"]
    for c in group:
        same = same & x[c].eqNullSafe(counts[f"{c}_"])
    return x.join(counts, same).withColumn("_place", F.col("_own") + F.col("_before"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark, 65536)
    return mix_sources(texts(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mixing": op4_mixing}
ORACLES: dict = {}
