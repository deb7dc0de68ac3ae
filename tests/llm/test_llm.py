"""Operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import chat, common, decontam, extract, mixing, quality, registry, rules, sharding, simhash, substrings, toxicity

from ..helpers import check

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and another thing. " * 20_000
AWKWARD = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4), (3, "same text here", "en", "s", 14), (4, "same text here", "en", "s", 14), (4, "same text here", "en", "s", 14), (5, LONG, "en", "t", len(LONG)), (None, "no id at all", "en", None, 12), (6, "x\x00y é ß 漢字 \U0001f600", "en", "t", 5)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for c in ("score", "size", "shard", "slot", "kept", "n_words", "fp", "component", "label", "title"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.limit(0)


def test_registry():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)}
    assert set(registry.oracles()) <= names


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, sf, name):
    check(spark, sf, registry.queries()[name], registry.oracles()[name])


# ---- 1, 2: classifiers


@pytest.mark.parametrize("name,label", [("op1_quality", "quality"), ("op2_toxicity", "toxic")])
def test_held_out(spark, name, label):
    sf = "/root/testdata/sf0.1"
    rows = registry.queries()[name](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").toPandas()
    assert rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    rank = held.score.rank().to_numpy()
    y = held[label].to_numpy() == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > (0.99 if label == "quality" else 0.93)


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifier_edges(spark, awkward, none, kind):
    labels = spark.createDataFrame([(3, 1), (5, 0), (6, 1), (1, 0)], "doc_id long, y int")
    for known in (labels, labels.limit(0), labels.where("y = 1")):
        model = kind.fit(awkward.select("doc_id", "text"), known)
        got = kind.score(awkward, model).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.text == "same text here"}) == 1
        assert kind.score(none, model).count() == 0


def test_kneser_ney_sums_to_one():
    """The chances of all bytes after a seen context add up to one, in both models."""
    text = b"abcab abcabd abd bbca"
    buf = np.frombuffer(text, np.uint8)
    s, e, _ = common.word_spans(buf, np.array([0, len(buf)]), plain=True)
    g, keep, _ = toxicity.grams(buf, s, e)
    keys, inv = np.unique(g[-1][keep], return_inverse=True)
    ones = np.bincount(inv)
    m = toxicity.Model.fit(keys, ones, ones // 2)
    ctx = int.from_bytes(b"  ab", "big")
    total = np.zeros(2)
    for c in range(256):
        last = [np.array([((ctx << 8) | c) & ((1 << 8 * (k + 1)) - 1)], np.uint64) for k in range(5)]
        before = [np.array([ctx & ((1 << 8 * (k + 1)) - 1)], np.uint64) for k in range(5)]
        p = m.disc[0][m.lookups[0](last[0])]
        for k in range(1, 5):
            p = m.disc[k][m.lookups[k](last[k])] + m.gam[k - 1][m.lookups[k - 1](before[k - 1])] * p
        total += p[0]
    assert total == pytest.approx([1, 1], abs=0.02)


def test_toxicity_counts_every_text(spark):
    """The model's counts are those of all labelled texts, whatever fold they are in."""
    docs = spark.createDataFrame([(i, f"plain words {'zqxj' * (i % 2)} n{i}v") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    m = toxicity.fit(docs, labels)
    for i in range(40):
        last = np.array([int.from_bytes(f" n{i}v "[-5:].encode(), "big")], np.uint64)
        assert m.disc[-1][m.lookups[-1](last)].any() and m.weights is not None


def test_toxicity_keeps_rare_runs(spark):
    """No run is left out of a model of more than two million."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, 20_000).astype(np.uint8)).decode() for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, y int"))
    runs = {t[k : k + 5] for t in texts for k in range(len(t) - 4)}
    assert len(runs) > 2_000_000 and len(m.disc[-1]) - 1 >= len(runs)


# ---- 3: rules


def test_rules_brute(spark, awkward, none):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("a b c the of".split(), k=rng.randint(0, 40))) for _ in range(60)] + [r[1] for r in AWKWARD] + ["one two three four five six seven eight " * 2, "x\nx\n\nx\ny"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in rules.quality_rules(df).collect():
        t = texts[r.doc_id] or ""
        w = WORDS.findall(t)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {x for x in runs if runs.count(x) > 1} if len(runs) < 1000 else set(runs)
        if len(runs) < 1000:
            covered = {i + k for i, x in enumerate(runs) if x in many for k in range(8)}
            assert r.n_repeat_words == len(covered)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(awkward).count() == len(AWKWARD) and rules.quality_rules(none).count() == 0


# ---- 4: mixing


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, "c": 1, None: 50})
    assert sum(t.values()) == pytest.approx(251) and t["c"] == 3
    assert t["b"] == pytest.approx(2 * t["a"]) and t[None] == pytest.approx(t["a"])
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flight_keeps_balance():
    rng = random.Random(2)
    p, size = [rng.random() for _ in range(300)], [float(rng.randint(1, 900)) for _ in range(300)]
    n, words = sum(p), sum(a * b for a, b in zip(p, size, strict=True))
    left = mixing.flight(p, size, rng)
    assert len(left) <= 2 and sum(p) == pytest.approx(n) and sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(words)


def test_mixing(spark, sf, awkward, none):
    got = mixing.op4_mixing(spark, "/root/testdata/sf0.1").toPandas()
    docs = common.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "source").toPandas()
    by = got.merge(docs, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), own=("source_size", "first"))
    assert ((by.taken - by.target).abs() < 0.03 * by.target).all() and (by["size"] == by.own).all()
    assert (got.taken <= 3 * got["size"]).all() and len(got) == len(docs)
    again = mixing.op4_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert again.equals(mixing.op4_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True))
    assert mixing.mix_sources(awkward).count() == len(AWKWARD) and mixing.mix_sources(none).count() == 0
    assert mixing.mixed(awkward).columns == awkward.columns and mixing.mixed(none).count() == 0


def test_mixing_outsized(spark, sf):
    """Few or long texts: within 1 % of target, or as near as any choice of whole documents gets."""
    sizes = {"few": [900, 800, 700, 40, 30, 20, 10], "led": [4000, 2500, 1800, *range(5, 95)], "plain": [20] * 300}
    rows = [(s, n) for s in sizes for n in sizes[s]]
    made = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    for docs in (made, common.table(spark, sf, "documents")):
        got = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
        for _, x in got.groupby("source"):
            target, taken, whole = x.target.iloc[0], x.taken.sum(), int(x.target.iloc[0] / x.source_size.iloc[0] + 1e-9)
            sums = {whole * x["size"].sum()}
            for n in x["size"]:
                sums |= {s + n for s in sums}
            assert abs(taken - target) <= max(0.01 * target, 1.01 * min(abs(s - target) for s in sums) + 0.5)


# ---- 5: decontamination


def test_search_finds_all():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12)))) for i in range(500)]
    index = decontam.Index(items)
    for _ in range(60):
        buf = np.frombuffer(" ".join(rng.choices(vocab, k=30)).encode(), np.uint8)
        s, e, _ = common.word_spans(buf, np.array([0, len(buf)]), plain=True)
        t = np.unique(index.lookup(common.span_hashes(buf, s, e)))
        t = t[t < len(index.most) - 1]
        want = {}
        for x in t.tolist():
            for item, impact in zip(*index.postings(x)[:2], strict=True):
                want[item] = want.get(item, 0) + impact
        for threshold in (0.3, 0.6, 0.9):
            assert {i for i, _ in index.search(t, threshold)} == {i for i, v in want.items() if v >= threshold}


def test_leaks_brute(spark, sf, awkward, none):
    bench = common.table(spark, sf, "benchmark").toPandas()
    docs = common.table(spark, sf, "documents").toPandas()
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    items = {i: runs(words(t)) for i, t in zip(bench.item_id, bench.text, strict=True)}
    want = set()
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        own = runs(words(t))
        want |= {(d, i) for i, r in items.items() if len(r & own) >= 0.8 * len(r)}
    got = decontam.op5_decontam(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (4, "and another thing word and another thing word")], "item_id long, text string")
    for x in (items, items.limit(0)):
        clean = decontam.decontaminate(awkward, x)
        assert clean.columns == awkward.columns
        assert clean.count() == (len(AWKWARD) - 4 if x is items else len(AWKWARD))
    assert decontam.decontaminate(none, items).count() == 0


# ---- 6: sharding


def test_tree():
    rng, tree, held = random.Random(4), sharding.Tree(), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            tree.delete(held.pop(rng.randrange(len(held))))
        else:
            key = (rng.randrange(50), rng.randrange(10**6))
            tree.insert(key)
            held.append(key)
        ask = (rng.randrange(55), -1)
        assert tree.ceiling(ask) == min((k for k in held if k >= ask), default=None)


def test_packing():
    rng = random.Random(5)
    sizes = {}
    for _ in range(2000):
        s = int(rng.lognormvariate(5, 1))
        sizes[s] = sizes.get(s, 0) + 1
    runs = sharding.pack(list(sizes.items()), 40)
    load = np.zeros(40)
    for s, b, k in runs:
        load[b] += s * k
    assert load.max() - load.min() < 0.02 * load.mean()
    assert {s: sum(k for z, _, k in runs if z == s) for s in sizes} == sizes
    plain = [(10, 3), (6, 2), (4, 5), (1, 1)]
    one_by_one, rooms = [], []
    for s, n in plain:
        for _ in range(n):
            fit = min(((r, b) for b, r in enumerate(rooms) if r >= s), default=None)
            if fit is None:
                rooms.append(12)
                fit = (12, len(rooms) - 1)
            rooms[fit[1]] -= s
            one_by_one.append((s, fit[1]))
    assert [(s, b) for s, b, k in sharding.best_fit(plain, 12) for _ in range(k)] == one_by_one
    big = sharding.pack([(1000, 1), (1, 90)], 10)
    assert max(sum(s * k for s, b, k in big if b == x) for x in range(1, 10)) == 10
    assert sharding.pack([], 40) == []


def test_sharding(spark, sf, awkward, none):
    got = sharding.op6_sharding(spark, sf).toPandas()
    docs = common.table(spark, sf, "documents").toPandas().set_index("doc_id")
    assert all(r.size == len(docs.text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs.text[r.doc_id].encode()) for r in got.itertuples(index=False) if not hasattr(r.size, "__call__"))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.merge(docs.reset_index(), on="doc_id").groupby("text").shard.nunique().max() == 1
    rows = sharding.shard_table(awkward).toPandas()
    assert len(rows) == len(AWKWARD) and rows[rows.doc_id.isin([3, 4])].shard.nunique() == 1
    assert sharding.shard_table(none).count() == 0


# ---- 7: extraction


def test_extraction(spark):
    pages = extract.synthetic(150, seed=77)
    labels = extract.model().scores([extract.vectors(p) for p, _ in pages])
    good = sum(((s >= 0.5) == (y > 0.5)).sum() for s, (_, y) in zip(labels, pages, strict=True))
    assert good >= 0.98 * sum(len(y) for _, y in pages)
    html = "<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p>One\n two &lt;b&gt;.<p>Three &copy;</article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, html, 0), (2, None, 0), (3, "", 0), (4, "<", 0), (1, html, 0)], "page_id long, html string, text int")
    got = {r.page_id: r for r in extract.extract(df).collect()}
    assert got[1].text == "T & t\nOne two <b>.\nThree ©" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and extract.extract(df.limit(0)).count() == 0


def test_heads_and_deep_paths():
    """Only head and title elements are left out before the labeller; open heads end; outer containers count."""
    words = lambda p: " ".join(b[0] for b in extract.blocks(p))
    head = "<html><head><title>No</title><meta name=x>"
    assert words(head + "<body><h1 class=entry-title>A</h1><p class=title>B</p><div class=post-head><p>C</div>") == "A B C"
    assert words(head + "<p>A<p>B") == words("<title>No<div>A</div>B") == words(head + "<b>A</b><p>B") == "A B"
    say = "".join(f"<p>Ana fien chor deen gaha. Istko lami, naor paqu rest th{i}.</p>" for i in range(4))
    got = extract.main_texts([head + f"<body><h1 class='entry-title'>Chor deen</h1><article>{say}</article>", head + f"</head><body><div class='post-head'><article><h1>Chor</h1>{say}</article></div>"], extract.model())
    assert all(len(t.split("\n")) == 5 for t in got)
    deep = lambda outer, inner: outer + "".join(f"<div class='w{'abcdefghijklmnop'[k]}q row'>" for k in range(12)) + inner + "</div>" * 12
    a, b = (extract.vectors(extract.blocks(deep(x, "<p>Ana fien.</p>")))[0] for x in ("<div class=comments>", "<article>"))
    assert not np.array_equal(a[: extract.PATH_DIM], b[: extract.PATH_DIM])
    page = f"<html><head></head><body>{deep('<article class=post>', '<h1>Chor deen</h1>' + say)}</article>{deep('<div class=comments>', '<p>Vowi xeyo.</p>' * 3)}</div>"
    assert "th3" in extract.main_texts([page], extract.model())[0] and "Vowi" not in extract.main_texts([page], extract.model())[0]


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    net = extract.Lstm(rng, 3, 4)
    net.w = net.w.astype(np.float64)
    x, mask = rng.standard_normal((5, 2, 3)), np.ones((5, 2), bool)
    mask[3:, 1] = False
    out, tape = net.run(x, mask, True)
    dw, _ = net.back(x, tape, np.ones_like(out))
    for i, j in ((0, 0), (2, 7), (5, 12)):
        keep, net.w[i, j] = net.w[i, j], net.w[i, j] + 1e-3
        up = net.run(x, mask)[0].astype(float).sum()
        net.w[i, j] = keep - 1e-3
        down = net.run(x, mask)[0].astype(float).sum()
        net.w[i, j] = keep
        assert dw[i, j] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=2e-2)


# ---- 8: repeated strings


def brute_repeats(rows, w=50):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - w + 1):
            first[b[k : k + w]] = min(first.get(b[k : k + w], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if first[b[k : k + w]] < i:
                gone[k : k + w] = b"\x01" * w
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_brute(spark, monkeypatch, none):
    rng = random.Random(6)
    pool = ["".join(rng.choices("ab é", k=rng.randint(30, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choices("abcd", k=rng.randint(0, 70))) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(200, "Of " * 200), (201, "Of " * 150), (202, "z" * 49), (203, "z" * 50), (204, "z" * 50), (204, "z" * 50), (205, None), (206, "y\x00" * 40), (207, "y\x01" * 40), (208, "y\x00" * 26)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = lambda: sorted(tuple(r[c] for c in cols) for r in substrings.remove_repeats(df).collect())
    want = brute_repeats(rows)
    assert got() == want
    assert substrings.remove_repeats(none).count() == 0
    for r in substrings.remove_repeats(df, spans=True).where("n_removed > 0").collect():
        assert len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_unequal_runs(spark):
    """Texts that share a prefix, then a run of one byte or phrase of different lengths."""
    rng, rows = random.Random(12), []
    for k in range(40):
        shared, unit = "".join(rng.choices("abcdefgh ", k=120)), rng.choice(["-", "=", "- ", "of the ", "na na, ", "word again and "])
        for n in (rng.randint(20, 35), rng.randint(50, 70)):
            rows.append((len(rows), shared + (unit * 70)[:n] + "".join(rng.choices("klmnop ", k=80))))
        rows.append((len(rows), shared[60:] + (unit * 3)[:21] + "".join(rng.choices("qrstuv ", k=80))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect()) == brute_repeats(rows)


def test_columns_through_files():
    """Small chunks send every round through files; the order is that of sorting."""
    rng = np.random.default_rng(7)
    text = np.concatenate([rng.integers(97, 100, 3000).astype(np.uint8), np.zeros(60, np.uint8)])
    places = np.arange(2900)
    want = [bytes(text[p : p + 50]) for p in sorted(places.tolist(), key=lambda p: (bytes(text[p : p + 50]), p))]
    for chunk in (100, 1 << 20):
        order = np.concatenate(list(substrings._read(substrings.column_order(text, places, chunk), chunk)))
        assert [bytes(text[p : p + 50]) for p in order] == want


def test_common_passage(spark, monkeypatch):
    """A name of many documents is cut into single windows, with the same result."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=220))
    rows = [(i, "".join(rng.choices("klmnop ", k=90)) + passage + "".join(rng.choices("qrstuv ", k=90))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    source = substrings.shared_anchors
    for hot in (5, 10_000):
        monkeypatch.setattr(substrings, "shared_anchors", lambda p, n, hot=hot: source(p, n, hot))
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect())
        assert got == brute_repeats(rows)


# ---- 9: chat


def test_round_trip():
    rng = random.Random(9)
    bits = ["<", "|", "turn", "|>", "\\", "</s>", "[INST]", "[", "/INST]", "\n", "é", "<|end|>", "<|", "n", "<<SYS>>"]
    make = lambda k: "".join(rng.choices(bits, k=rng.randint(0, k)))
    for _ in range(1500):
        turns = [(make(3), make(8)) for _ in range(rng.randint(0, 4))]
        out = chat.marked(turns)
        assert chat.read_back(out) == turns
        for local in (True, False):
            r = chat.render(chat.marked, turns, local)
            assert r.text == out and r.rewrites is None
            assert [chat.unescape(out[s[2] : s[3]]) for s in r.spans] == [t for _, t in turns]


def test_rewriting_templates():
    counts = lambda t: f"{len(t)} turns\n" + chat.marked(t)
    assert chat.render(counts, [("user", "a")]).rewrites == 0
    hides = lambda t: "".join(f"[{r}]{x if k == len(t) - 1 else ''}" for k, (r, x) in enumerate(t))
    assert chat.render(hides, [("user", "a"), ("assistant", "b")]).rewrites == 1
    plain = chat.render(lambda t: "".join(f"{r}: {x}\n" for r, x in t), [("user", "a"), ("assistant", "bb")])
    assert plain.rewrites is None and plain.text[plain.spans[1][2] : plain.spans[1][3]] == "bb"


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 0, None, "hi"), (None, None, "user", ""), (2, 5, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1} and got[2].loss_chars == 300_000 and got[1].loss_chars == 0
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- 10: simhash


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def test_masks_cover():
    ms, rng = simhash.masks(), random.Random(10)
    assert len(ms) == 15
    for _ in range(3000):
        d = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 3)))
        assert any(int(m) & d == 0 for m in ms)


def components_of(fps):
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(fps):
        for j, y in fps[:a]:
            if bin(x ^ y).count("1") <= 3:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in fps}


def test_simhash_brute(spark, sf, awkward, none):
    docs = common.table(spark, sf, "documents").select("doc_id", "text").toPandas()
    fps = [(int(i), brute_fp(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, sf).collect()}
    assert all(got[i].fingerprint == f"{x:016x}" for i, x in fps)
    assert {i: r.component_id for i, r in got.items()} == components_of(fps)
    rows = simhash.near_groups(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.component for r in rows if r.doc_id in (3, 4)} == {3} and {r.component for r in rows if r.doc_id is None} == {None}
    assert {r.component for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_groups(none).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(awkward).collect() if r.doc_id is not None) == [0, 3, 5, 6]


def test_large_buckets(spark, monkeypatch):
    """A bucket that is dealt in blocks loses no link."""
    rng = random.Random(11)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << i for i in rng.sample(range(20), rng.randint(0, 5))) for _ in range(150)}
    fps = [(i, x) for i, x in enumerate(sorted(fps))]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in fps], "fp long, node long")
    for bucket in (16, 10_000):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        scratch = common.Scratch(spark)
        found = {r.u: r.v for r in simhash.components(simhash.links(nodes, scratch), scratch).collect()}
        assert {i: found.get(i, i) for i, _ in fps} == components_of(fps)
