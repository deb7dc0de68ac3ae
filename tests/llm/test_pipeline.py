import collections
import re

import corpus_pipeline as C
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing, toxicity
from gleaner.llm.common import held_out, table

from .test_llm import AWKWARD, awkward, brute_fp, components_of  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of every stage, run one after the other."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in C.STAGES:
        new = stage(spark, docs, SF).persist()
        out[name] = (docs, new)
        docs = new
    return out


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_order(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, (docs, new) in stages.items():
        assert name == "sharding" or new.columns == docs.columns


def test_toxicity(spark, stages):
    """Kept are the rows whose text the model, read here, scores below the threshold; hardly any clean one goes."""
    docs, new = stages["toxicity"]
    labels = table(spark, SF, "labels")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("y")))
    scorer, want = toxicity.Scorer(model), collections.Counter()
    for r in docs.collect():
        if toxicity.probability(model, scorer(pa.array([r.text])))[0] < C.TOXIC_FROM:
            want[tuple(r)] += 1
    assert rows_of(new) == want
    kept = new.join(labels, "doc_id")
    assert kept.where("toxic = 0").count() >= 0.97 * labels.where("toxic = 0").count()
    words = re.compile(r"\b(idiot|moron|scum|trash|loser|clown|pathetic|worthless|stupid|disgusting)\b")
    bad = [r for r in docs.collect() if len(words.findall((r.text or "").lower())) >= 2]
    assert len(bad) > 40 and not {r.doc_id for r in bad} & {r.doc_id for r in new.collect()}


def test_near_duplicates(stages):
    docs, new = stages["near_duplicates"]
    root = components_of([(int(r.doc_id), brute_fp(r.text)) for r in docs.collect()])
    assert rows_of(new) == collections.Counter(tuple(r) for r in docs.collect() if root[r.doc_id] == r.doc_id)


def test_decontamination(spark, stages):
    docs, new = stages["decontamination"]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    items = [runs(words(r.text)) for r in table(spark, SF, "benchmark").collect()]
    clean = collections.Counter(tuple(r) for r in docs.collect() if not any(len(i & runs(words(r.text))) >= 0.8 * len(i) for i in items))
    assert rows_of(new) == clean and sum(clean.values()) < docs.count()


def test_mixing(stages):
    """Every source near its target, no row more than three times, and the rows are those of the input."""
    docs, new = stages["mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source, taken = collections.Counter(), collections.Counter()
    for r in docs.collect():
        source[r.source] += size(r.text)
    times = rows_of(new)
    for r in new.collect():
        taken[r.source] += size(r.text)
    assert set(times) <= set(rows_of(docs)) and max(times.values()) <= 3
    for s, target in mixing.targets(dict(source)).items():
        assert abs(taken[s] - target) <= 0.03 * target


def test_sharding(stages):
    docs, new = stages["sharding"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = new.toPandas()
    assert sorted(rows.doc_id) == sorted(r.doc_id for r in docs.collect()) and sorted(rows.shard.unique()) == list(range(40))
    assert (rows["size"] == [len(texts[i].encode()) + 16 for i in rows.doc_id]).all()
    assert rows.groupby("doc_id").shard.nunique().max() == 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_run_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    assert C.run(spark, sf).count() > 0
    empty = table(spark, sf, "documents").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_awkward(spark, awkward):  # noqa: F811
    """Nulls, empty and long texts, repeated rows and clashing columns through every stage."""
    sf, got = "/root/testdata/sf0.001", {}
    for name, stage in C.STAGES:
        got[name] = stage(spark, awkward, sf)
        if name != "sharding":
            assert got[name].columns == awkward.columns
    assert got["toxicity"].count() == len(AWKWARD) and got["decontamination"].count() == len(AWKWARD)
    ids = sorted(((r.doc_id is None, r.doc_id) for r in got["near_duplicates"].collect()))
    assert [i for _, i in ids] == [0, 3, 5, 6, None]
    assert got["sharding"].count() == len(AWKWARD) and set(got["sharding"].columns) == {"doc_id", "size", "text_crc32", "shard", "slot"}
    mixed = [(r.doc_id, len((r.text or "").split())) for r in got["mixing"].collect()]
    assert all(n for _, n in mixed) and np.isin([i for i, _ in mixed if i is not None], [3, 4, 5, 6]).all()
