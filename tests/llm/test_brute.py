"""Operators against plain versions of themselves, at their bounds and on hot groups."""

import collections
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import chat, common, decontam, extract, mixing, quality, sharding, simhash, substrings, toxicity

from .pages import PAGES
from .test_llm import AWKWARD, LONG, awkward, brute_fp, brute_repeats, components_of, none  # noqa: F401

SF = "/root/testdata/sf0.01"


# ---- 1: averages of vectors, softmax


def brute_quality(model, text):
    """One word and one run of bytes at a time."""
    b, total, n, before = (text or "").encode(), 0.0, 0, None
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", b):
        w = np.frombuffer(m[0], np.uint8)
        h = int(common.span_hashes(w, np.array([0]), np.array([len(w)]))[0])
        total, n = total + float(model.logit[h & ((1 << quality.BITS) - 1)]), n + 1
        if m[0] == before:
            total, n = total + float(model.logit[quality.REPEAT]), n + 1
        before = m[0]
    for size in (3, 4):
        for k in range(len(b) - size + 1):
            x = (int.from_bytes(b[k : k + size], "little") ^ size) * 0x9E3779B1 & 0xFFFFFFFF
            total, n = total + float(model.logit[x >> (32 - quality.BITS)]), n + 1
    return 1 / (1 + math.exp(-(model.bias + total / max(n, 1))))


def test_quality_brute(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    labels = common.table(spark, SF, "labels").select("doc_id", F.col("quality").alias("y"))
    model = quality.fit(docs, labels, sample_rows=100)
    some = docs.orderBy("doc_id").limit(60)
    for r in quality.score(some, model).collect():
        assert r.score == pytest.approx(brute_quality(model, r.text), abs=1e-6)


def test_quality_streams(spark):
    """The sample in blocks of bounded bytes trains a model that tells the classes apart."""
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    labels = common.table(spark, SF, "labels").select("doc_id", F.col("quality").alias("y"))
    held = labels.where(common.held_out("doc_id"))
    model = quality.fit(docs, labels.where(~common.held_out("doc_id")), held=1 << 20)
    rows = quality.score(docs.join(held, "doc_id"), model, keep=["y"]).collect()
    assert rows[0].__fields__ == ["y", "score"]
    assert np.mean([(r.score >= 0.5) == (r.y == 1) for r in rows]) > 0.95


# ---- 2: Kneser-Ney from the definition


def brute_kneser_ney(counts, run):
    """Chance of the last byte of a five-byte run in each class; counts: run -> (toxic, ordinary)."""
    orders = {5: dict(counts)}
    for k in range(4, 0, -1):
        left = collections.defaultdict(set)
        for g in orders[k + 1]:
            left[g[1:]].add(g[:1])
        orders[k] = {g: (len(x), len(x)) for g, x in left.items()}
    total = sum(n[0] for n in orders[1].values())
    p = [(orders[1].get(run[-1:], (0, 0))[0] + 0.5) / (total + 128)] * 2
    for k in range(2, 6):
        ctx = run[-k:-1]
        after = [n for g, n in orders[k].items() if g[:-1] == ctx]
        for c in range(2):
            whole, kinds = sum(n[c] for n in after), sum(n[c] > 0 for n in after)
            own = orders[k].get(run[-k:], (0, 0))[c]
            p[c] = max(own - 0.75, 0) / max(whole, 1) + (0.75 * kinds / whole if whole else 1.0) * p[c]
    return p


def test_toxicity_brute(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words[: 40 + 20 * (i % 2)], k=12))) for i in range(40)]
    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in rows:
        for w in t.split():
            padded = b"    " + w.encode() + b" "
            for k in range(5, len(padded) + 1):
                counts[padded[k - 5 : k]][1 - i % 2] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, y int"))
    for w in [*words[:25], "zebra", "abz", "e"]:
        want = 0.0
        for k in range(5, len(w) + 6):
            a, b = brute_kneser_ney(counts, (b"    " + w.encode() + b" ")[k - 5 : k])
            want += math.log(a + 1e-12) - math.log(b + 1e-12)
        buf = np.frombuffer(w.encode(), np.uint8)
        got = model.words(buf, np.array([0]), np.array([len(buf)]))[0]
        assert got * (len(w) + 1) == pytest.approx(want, abs=1e-4)


def test_toxicity_tables(spark, awkward, none):  # noqa: F811
    """A model that stays in tables gives the scores of one that is sent."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    labels = common.table(spark, "/root/testdata/sf0.001", "labels").select("doc_id", F.col("toxic").alias("y"))
    sent, tables = toxicity.fit(docs, labels), toxicity.fit(docs, labels, model_runs=0)
    assert isinstance(tables, toxicity.Tables) and tables.weights == pytest.approx(sent.weights, rel=1e-3, abs=1e-3)
    of = lambda m, df: sorted(((r.doc_id is None, r.doc_id), round(r.score, 4)) for r in toxicity.score(df, m).collect())
    assert of(sent, docs) == of(tables, docs)
    assert of(sent, awkward) == of(tables, awkward) and toxicity.score(none, tables).count() == 0
    assert toxicity.score(awkward, tables).columns == toxicity.score(awkward, sent).columns


def test_toxicity_finds_few(spark):
    """From 50 toxic examples, some without any toxic word."""
    rows = toxicity.op2_toxicity(spark, SF).where("held_out").join(common.table(spark, SF, "labels"), "doc_id").collect()
    bad = [r.predicted for r in rows if r.toxic]
    assert sum(bad) >= 0.8 * len(bad) and sum(r.predicted for r in rows if not r.toxic) <= 0.03 * len(rows)


# ---- 4: mixing


def test_average():
    """The programme's draw has the mean asked for, or one as near as outcomes allow."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        p = rng.random(n)
        chance, miss = mixing.average(mixing.grid(n, 1), p)
        assert miss < 1e-8 and chance @ mixing.grid(n, 1) == pytest.approx(p, abs=1e-8) and chance.min() >= 0
    chance, miss = mixing.average(np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([0.4, 0.3]))
    assert miss == pytest.approx(0.6) and chance == pytest.approx([0.7, 0.3])


@pytest.mark.parametrize("kind", ["even", "led", "few large", "many large", "steep"])
def test_inclusion(kind):
    """Over 400 seeds documents are taken as often as their probability says, and every
    draw is near its target."""
    rng = random.Random(5)
    size = {
        "even": [float(rng.randint(20, 900)) for _ in range(120)],
        "led": [4000.0, 2500.0, 1800.0] + [float(x) for x in range(5, 95)],
        "few large": [900.0] * 3 + [float(rng.randint(10, 60)) for _ in range(160)],
        "many large": [float(rng.randint(700, 1300)) for _ in range(30)] + [float(rng.randint(5, 30)) for _ in range(100)],
        "steep": [1000.0 * 0.9**k + 3 for k in range(80)],
    }[kind]
    p0, taken, words = 0.37, np.zeros(len(size)), []
    for seed in range(400):
        p = [p0] * len(size)
        mixing.land(p, size, random.Random(seed))
        assert set(p) <= {0.0, 1.0}
        taken, words = taken + p, [*words, sum(a * b for a, b in zip(p, size, strict=True))]
    goal = p0 * sum(size)
    noise = math.sqrt(p0 * (1 - p0) / 400)
    assert np.abs(taken / 400 - p0).max() < 4.5 * noise and abs((taken / 400 - p0).mean()) < 3 * noise
    assert max(abs(w - goal) for w in words) <= 0.03 * goal


def test_supply():
    """Outsized units alone, with the rest of their source as a supply of words."""
    taken, over = np.zeros(4), 300.0
    for seed in range(400):
        p = [0.5, 0.5, 0.5, 0.5]
        mixing.land(p, [100.0, 90.0, 80.0, 70.0], random.Random(seed), goal=470.0, under=300.0, over=over)
        taken += p
        assert abs(sum(a * b for a, b in zip(p, [100, 90, 80, 70], strict=True)) - 170) <= 300 + 1
    assert np.abs(taken / 400 - 0.5).max() < 0.12


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_every_source_near(spark, sf):
    docs = common.table(spark, sf, "documents")
    got = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 0.03 * by.target).all()


def test_small_sources(spark):
    """Sources of 1, 2, 5, 10 and 20 documents: whole copies come as near as any copies do."""
    rng = random.Random(8)
    sizes = {f"s{n}": [rng.randint(5, 400) for _ in range(n)] for n in (1, 2, 5, 10, 20)} | {"rest": [50] * 200}
    rows = [(s, n) for s in sizes for n in sizes[s]]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    got = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (got.copies <= 3).all() and (got.taken == got.copies * got["size"]).all()
    for s, x in got.groupby("source"):
        target, can = x.target.iloc[0], {0}
        for n in sizes[s]:
            can = {c + k * n for c in can for k in range(4)} if len(sizes[s]) <= mixing.COPIES else {c + k * n for c in can for k in (int(target / sum(sizes[s]) + 1e-9), int(target / sum(sizes[s]) + 1e-9) + 1)}
        least = min(abs(c - target) for c in can)
        assert abs(x.taken.sum() - target) <= max(0.011 * target, least + 1e-6)


def test_targets_in_tables(spark):
    rng = random.Random(9)
    for n in (1, 3, 40):
        sizes = {f"s{i:03d}": rng.choice((0, 1, 5, 1000, 10**6)) for i in range(n)} | {None: 77}
        df = spark.createDataFrame([(s, z) for s, z in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.goals(df, (1, 2, 3), common.Scratch(spark)).collect()}
        assert got == pytest.approx(mixing.targets(sizes))


def test_many_sources(spark):
    """Targets of more sources than a driver should hold."""
    n = 1_200_000
    sizes = spark.range(n).select(F.col("id").cast("string").alias("source"), (F.col("id") % 7 + 1).alias("size"))
    got = mixing.goals(sizes, (1, 2, 3), common.Scratch(spark)).agg(F.count("*"), F.sum("target"), F.sum("size"), F.max(F.col("target") / F.col("size"))).first()
    assert got[0] == n and got[1] == pytest.approx(got[2]) and got[3] <= 3 + 1e-9


def test_mixed_repeats(spark, monkeypatch):
    """Rows that agree in id, source and size: what the mix takes of them comes out, each by its number."""
    monkeypatch.setattr(mixing, "ALIKE", 7)
    rows = [(1, "one two three", "a", i) for i in range(30)] + [(None, f"null {i}", "b", i) for i in range(25)] + [(i, "x " * (i % 9), "c", i) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark long").repartition(5)
    want = mixing.mix_sources(docs).groupBy("doc_id", "_source", "size").agg(F.sum("copies").alias("n")).collect()
    got = collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed(docs).collect())
    assert {(r.doc_id, r["_source"], r["size"]): r.n for r in want if r.n} == dict(got)
    marks = collections.Counter((r.doc_id, r.mark) for r in mixing.mixed(docs).collect())
    assert max(marks.values()) <= 3


# ---- 5: decontamination


def test_index_in_blocks(spark):
    """However the benchmark is cut, scores and matches are those of one cut by length alone."""
    bench, docs = common.table(spark, SF, "benchmark"), common.table(spark, SF, "documents").select("doc_id", "text")

    def found(words):
        passes = list(decontam.indexes(bench, block_words=words))
        rows = [r for some in passes for r in decontam.leaks(docs, some).collect()]
        return sum(len(p) for p in passes), sorted((r.doc_id, r.item_id, round(r.score, 9), round(r.overlap, 9), round(r.question_overlap, 9)) for r in rows)

    few, whole = found(decontam.BLOCK_WORDS)
    many, cut = found(50)
    assert many > 4 * few and cut == whole and len(whole) > 10


def test_long_items_leave_short_ones_alone(spark):
    """An item's score doesn't depend on the lengths of others but by the average."""
    words = [f"w{i}" for i in range(400)]
    short, long_ = " ".join(words[:20]), " ".join(words[50:390])
    docs = spark.createDataFrame([(1, "x y z " * 40 + short + " q r s" * 40), (2, long_), (3, " ".join(words[:14]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, short), (2, long_), (3, "a b"), (3, "a b")], "item_id long, text string")
    rows = [r for some in decontam.indexes(items) for r in decontam.leaks(docs, some).collect()]
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 2)}
    answers = items.withColumn("answer", F.lit("w18 w19"))
    cut = docs.select("doc_id", F.replace("text", F.lit("w18 w19"), F.lit("gone")).alias("text"))
    rows = [r for some in decontam.indexes(answers.where("item_id = 1"), answer="answer") for r in decontam.leaks(cut, some).collect()]
    assert not rows  # the question is there, the answer isn't


# ---- 6: sharding


def test_fill():
    rng = random.Random(13)
    for _ in range(200):
        load = [rng.randint(0, 500) for _ in range(rng.randint(1, 8))]
        rest = rng.randint(0, 3000)
        bins = sharding.fill(load, rest)
        after, before = list(load), 0
        for b, upto in bins:
            after[b], before = after[b] + upto - before, upto
        assert 0 <= before - rest <= len(load) + 1
        filled = [after[b] for b, _ in bins]
        assert max(filled) - min(filled) <= 0 and all(load[b] >= max(filled) - 1 for b in range(len(load)) if b not in dict(bins))
        rooms = [x for _, x in bins]
        assert [z - a for a, z in zip([0, *rooms], rooms)] == sorted(z - a for a, z in zip([0, *rooms], rooms))


@pytest.mark.parametrize("exact", [20_000, 200, 1])
def test_sharding_exact(spark, exact):
    """Groups whole, shards near equal, slots gapless, at any number of sizes that the driver packs."""
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    rows = sharding.shard_table(docs, shards=7, exact=exact).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(rows["size"] == [len(texts[i].encode()) + 16 for i in rows.doc_id])
    assert rows.assign(t=[texts[i] for i in rows.doc_id]).groupby("t").shard.nunique().max() == 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    load = rows.groupby("shard")["size"].sum()
    most = max(len(t.encode()) + 16 for t in texts.values())
    assert load.max() - load.min() <= (0.001 * load.mean() if exact == 20_000 else 2 * most)


def test_sharding_has_no_switch(spark, monkeypatch):
    """Bounds on what is held at a time change no row, and every group goes where best fit puts one of its size."""
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    rows_of = lambda **bound: sorted(map(tuple, sharding.shard_table(docs, shards=7, **bound).select("doc_id", "size", "shard", "slot").collect()))
    want = rows_of()
    assert rows_of(exact=20) == want
    monkeypatch.setattr(sharding, "RUNS", 30)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    assert rows_of(exact=1) == want
    group, at = collections.Counter(), {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, size, shard, _ in want:
        group[texts[doc_id]] += size
        at[texts[doc_id]] = shard
    runs = sharding.pack(list(collections.Counter(group.values()).items()), 7)
    assert collections.Counter((group[t], b) for t, b in at.items()) == collections.Counter((s, b) for s, b, k in runs for _ in range(k))


def test_packing_many_sizes():
    """More sizes than are unpacked at a time: even, and none lost."""
    rng = np.random.default_rng(3)
    sizes = np.stack([rng.permutation(60_000)[:45_000] + 17, rng.integers(1, 4, 45_000)], axis=1)
    load, left = np.zeros(40), dict(sizes.tolist())
    runs = list(sharding.packing(sizes, 40))
    for s, b, k in runs:
        load[b] += s * k
        left[s] -= k
    assert not any(left.values()) and load.max() - load.min() < 0.00005 * load.mean()
    assert runs == list(sharding.packing(sizes[::-1], 40, block=100))


# ---- 7: extraction


def test_hand_written_pages():
    """Pages that the writer never saw."""
    labeller, right, wrong, missed = extract.model(), 0, 0, 0
    assert len(PAGES) >= 30
    for _, html, want in PAGES:
        got = extract.main_texts([html], labeller)[0]
        a, b = collections.Counter(got.split("\n") if got else []), collections.Counter(want)
        right, wrong, missed = right + sum((a & b).values()), wrong + sum((a - b).values()), missed + sum((b - a).values())
    assert 2 * right / (2 * right + wrong + missed) > 0.95


def test_tokenizer():
    words = lambda p: " ".join(b[0] for b in extract.blocks(p))
    assert words("<p>a<svg/>b<svg><text>no</text></svg>c") == "abc"
    assert words("<p data-x=it's>a</p><p title='>'>b</p><p title=\"a > b\">c</p><p x='open>d</p>") == "a b c d"
    assert words("<p>a</p><textarea><p>b</p><select>c") == "a b c" and words("<p>a</p><script>b") == "a"
    assert words("<h2>a</h3><p>b") == "a b" and extract.blocks("<h2>a</h3><p>b")[1][1] == ("<p",)
    assert extract.blocks("<div class='h1 head'><p>a")[0][1] == ("<div", "h", "head", "<p")


def test_long_page(spark):
    """A page of some megabytes, of many blocks and of one, is read whole."""
    page = "<nav><a href=/>Home</a></nav><article><h1>Long</h1>" + "<p>One long sentence with words, and more of them.</p>" * 20_000 + "</article>"
    one = "<article><h1>One</h1><p>" + "A sentence with words, and one more. " * 40_000 + "</p></article>"
    df = spark.createDataFrame([(1, page), (2, one), (3, None)], "page_id long, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r.page_id: r for r in extract.extract(df).collect()}
    assert got[1].text.count("\n") >= 20_000 and got[1].text.endswith("more of them.") and got[2].n_chars > 1_400_000 and got[3].text == ""


# ---- 8: repeated strings


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def kept(df, **more):
    return sorted(tuple(r[c] for c in COLS) for r in substrings.remove_repeats(df, **more).collect())


def test_repeats_whole_table(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    assert kept(docs) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_long_texts_in_slices(spark, monkeypatch):
    """Texts longer than a batch, with repeats across the ends of slices, in many bundles and parts."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", 700)
    monkeypatch.setattr(substrings, "BUNDLE_BYTES", 2500)
    monkeypatch.setattr(substrings, "MOST_BYTES", 3000)
    monkeypatch.setattr(substrings, "MOST_ANCHORS", 300)
    rng = random.Random(31)
    pool = ["".join(rng.choices("abcdefg ", k=rng.randint(60, 900))) for _ in range(14)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices("klmnop", k=rng.randint(0, 300))) for _ in range(rng.choice((1, 2, 12))))) for i in range(60)]
    rows += [(90, "z" * 5000), (91, "z" * 1399), (92, "é" * 900), (93, "q" * 701), (94, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("bundle", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    assert kept(df) == brute_repeats(rows)
    texts = dict(rows)
    for r in substrings.remove_repeats(df, spans=True).collect():
        b = bytearray((texts[r.doc_id] or "").encode())
        for s in reversed(r.spans):
            del b[s.start : s.end]
        assert hashlib.sha256(bytes(b)).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans


def test_null_ids(spark):
    """A null id comes after all others, and two of them don't remove each other."""
    rng = random.Random(41)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=120)) for _ in range(3))
    rows = [(7, a + b), (None, "x" * 20 + a[:90] + c), (None, "y" * 30 + c), (9, b[20:] + "z" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes), r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df).collect())
    want = brute_repeats([(10**9 if i is None else i, t) for i, t in rows])
    assert sorted((n, r, h) for (_, _, n), r, h in got) == sorted((n, r, h) for _, n, r, _, h in want) and got[-1][1] + got[-2][1] == 90


def test_linear_in_parts():
    """What a bundle sends costs about the same at a hundred parts and at a hundred thousand."""
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(5000)]
    packs = []
    for _ in range(16):
        buf = " ".join(words[i] for i in rng.integers(0, 5000, 330_000)).encode()[: 2 << 20]
        packs.append((substrings._pack(np.arange(1)), substrings._pack(np.array([len(buf)])), substrings._pack(np.frombuffer(buf, np.uint8))))
    took = {}
    for parts in (100, 100_000, 100, 100_000):
        began, names, docs, asked = time.process_time(), [], [], substrings.Asked()
        for p in packs:
            x = substrings.Batch(*p)
            names.append(x.distinct)
            docs.append(x.documents())
        flags = substrings.Flags(parts)
        for b in substrings.anchor_rows(1, names, docs, parts):
            for r in b.to_pylist():
                flags.add(r["p"], r["anchors"], b"\x01" * (len(r["anchors"]) // 5))
        for p in packs[:8]:
            x = substrings.Batch(*p)
            x.strings(flags(x.distinct))
            x.marks()
            asked.add(x)
        sum(b.num_rows for b in asked.send(1, parts))
        took[parts] = time.process_time() - began
    assert took[100_000] <= 1.5 * took[100]


# ---- 9: chat


def test_late_rewrites(spark):
    """A template that changes a turn three back is found out, in the query's own path."""
    fades = lambda t: "".join(f"[{r}]{x if k >= len(t) - 3 else '...'}" for k, (r, x) in enumerate(t))
    turns = [("user", "a1"), ("assistant", "b2"), ("user", "c3"), ("assistant", "d4"), ("user", "e5")]
    assert chat.render(fades, turns).rewrites == 3
    df = spark.createDataFrame([(1, k, r, x) for k, (r, x) in enumerate(turns)] + [(2, k, r, x) for k, (r, x) in enumerate(turns[:3])], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.rewrites for r in chat.format_chats(df, fades).collect()} == {1: 3, 2: None}
    assert {r.conv_id: r.rewrites for r in chat.format_chats(df).collect()} == {1: None, 2: None}


def test_prefixes_are_whole():
    """Every prefix is rendered from its first turn on."""
    seen = []

    def spy(turns):
        seen.append(len(turns))
        return chat.marked(turns)

    chat.render(spy, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])
    assert seen.count(4) == 3 and seen.count(3) == 3 and max(seen) == 4


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} </s> " * 3) for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_chats(df)).first()
    want = "".join(t for _, k, r, t in rows if r == "assistant")
    assert got.n_turns == 1500 and got.loss_sha256 == hashlib.sha256(want.encode()).hexdigest()


# ---- 10: simhash


def test_simhash_table(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    fps = [(int(r.doc_id), brute_fp(r.text)) for r in docs]
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, SF).collect()}
    assert all(got[i].fingerprint == f"{x:016x}" for i, x in fps)
    assert {i: r.component_id for i, r in got.items()} == components_of(fps)


def test_masks_end():
    """After four families no bucket can hold many more than BUCKET different fingerprints."""
    families = [[int(m) for m in simhash.masks(3, simhash.SEED + f)] for f in range(4)]
    free = max(64 - bin(a | b | c | d).count("1") for a, b, c, d in itertools.product(*families))
    assert 1 << free <= 2 * simhash.BUCKET
    for f in families:
        rng = random.Random(f[0])
        for _ in range(500):
            d = sum(1 << i for i in rng.sample(range(64), 3))
            assert any(m & d == 0 for m in f)


def test_long_chain(spark):
    """Components of a path take as many rounds as they need."""
    scratch = common.Scratch(spark)
    edges = spark.range(1, 3000).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert simhash.components(edges, scratch).agg(F.max("v"), F.count("*")).first() == (0, 2999)


def test_awkward_sizes():
    assert len(AWKWARD) == 9 and len(LONG) > 400_000 and xxhash.xxh64_intdigest(b"", 42) > 0
