"""Classifiers on held-out rows, language models and neighbours against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann, crossentropy, quality, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def rates(scored, labels, name):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", name).collect()
    good, bad = [r for r in rows if r[1] == 1], [r for r in rows if r[1] == 0]
    return sum(r[0] for r in good) / len(good), sum(r[0] for r in bad) / len(bad)


def test_quality(labelled, docs, empty):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.train(*labelled, fold)
    true, false = rates(quality.predict(labelled[0], model).withColumn("held_out", ~fold), labelled[1], "quality")
    assert true > 0.95 and false < 0.2
    assert 0.6 < model.prior < 0.99
    got = quality.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.predict(empty, model).count() == 0
    none = quality.train(labelled[0], labelled[1].limit(0), fold)
    assert quality.predict(docs, none).where("predicted = 1").count() == 0


def test_risk_does_not_go_below_zero():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.2, 0.05, (6000, len(quality.STYLE))), rng.normal(0.6, 0.05, (2000, len(quality.STYLE)))
    model = quality.fit(good[:3000], np.vstack([good[3000:], bad]))
    assert abs(model.prior - 0.6) < 0.15
    assert model.score(good).mean() > 0.8 > 0.2 > model.score(bad).mean()


def test_toxicity(labelled, docs, empty):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = toxicity.train(*labelled, fold)
    true, false = rates(toxicity.predict(labelled[0], model).withColumn("held_out", ~fold), labelled[1], "toxic")
    assert true > 0.7 and false < 0.1
    got = toxicity.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predict(empty, model).count() == 0


def test_swapped_sentences():
    out = toxicity.swaps({"the", "muslim,", "boys", "girls"}, 0)
    assert ([("muslim,")], []) in out and (["boys"], []) in out and all(inn != ["girls"] for _, inn in out)
    assert sum(o == ["muslim,"] for o, _ in out) == 1 + toxicity.SWAPS
    (gone, put), = toxicity.swaps({"no", "group"}, 3)
    assert not gone and put[0] in toxicity._KIND


def test_swaps_keep_group_mentions_neutral():
    """Mentions on both sides, mostly in toxic texts: fewer neutral mentions are flagged than without the penalty, and toxic texts still are."""
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(60)]

    def text(toxic, mention):
        return sorted({*rng.sample(filler, 12), *([rng.choice(["vile", "scum", "filth"])] if toxic and rng.random() < 0.9 else []), *([rng.choice(["muslim", "gay", "women"])] if mention else [])})

    labels = np.array([int(i % 3 == 0) for i in range(900)])
    texts = [text(t, rng.random() < (0.7 if t else 0.08)) for t in labels]
    fair, plain = toxicity.fit(texts, labels), toxicity.fit(texts, labels, penalty=0.0)
    neutral = [" ".join(text(False, True)) for _ in range(300)]
    toxic = [" ".join([*text(False, k % 2), "scum"]) for k in range(300)]
    flagged = [sum(m.score(t) >= 0.3 for t in neutral) for m in (fair, plain)]
    assert flagged[0] < 15 and flagged[0] < flagged[1] / 3
    assert sum(fair.score(t) >= 0.3 for t in toxic) > 270
    changes = [np.mean([abs(m.score(t) - m.score(t.replace("muslim", "christian").replace("gay", "straight").replace("women", "men"))) for t in neutral]) for m in (fair, plain)]
    assert changes[0] < changes[1] / 3


@pytest.mark.parametrize("hot", [0, 3, 1 << 17])
def test_cross_entropy_is_the_models(docs, empty, spark, monkeypatch, hot):
    """Whether none, some or all words and pairs are counted beforehand."""
    monkeypatch.setattr(crossentropy, "FREQUENT", hot)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "Ee", "f g"]) for _ in range(rng.randint(0, 30))), i % 3 == 0) for i in range(40)] + [(50, None, None), (51, "", True), (52, "w3 w5", False), (53, "w65539 w5 " * 70_000, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    got = {r["doc_id"]: r for r in crossentropy.score(df, F.col("target")).collect()}
    tokens = {i: (t or "").lower().split() for i, t, _ in rows}
    path = {i: ["|", *ts, "|"] for i, ts in tokens.items()}

    def losses(ids):
        context = Counter(w for i in ids for w in path[i][:-1])
        two = Counter(p for i in ids for p in zip(path[i], path[i][1:]))
        mass, base = crossentropy.MASS, crossentropy.BASE_WORDS
        p = lambda u, w: (two[u, w] + mass / base) / (context[u] + mass)
        return {i: -sum(math.log(p(u, w)) for u, w in zip(path[i], path[i][1:])) / (len(path[i]) - 1) for i in path}

    background, target = losses(list(path)), losses([i for i, _, t in rows if t])
    assert set(got) == set(path)
    for i, r in got.items():
        assert r["n_tokens"] == len(tokens[i])
        assert abs(r["background_loss"] - background[i]) < 1e-4 and abs(r["target_loss"] - target[i]) < 1e-4
        assert abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-9
    assert crossentropy.score(docs, F.col("lang") == "en").count() == docs.count()
    assert crossentropy.score(empty, F.col("lang") == "en").count() == 0


def test_vocabulary_has_no_cap(spark):
    """200,000 words of one occurrence each are told apart, and from those of two."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(10_000)), k % 2 == 0) for k in range(20)]
    rows += [(100, rows[3][1], False)]
    got = {r["doc_id"]: r["background_loss"] for r in crossentropy.score(spark.createDataFrame(rows, "doc_id long, text string, target boolean"), F.col("target")).collect()}
    once = [v for k, v in got.items() if k not in (3, 100)]
    assert max(once) - min(once) < 1e-3 and got[3] == pytest.approx(got[100]) and got[3] < min(once) - 0.3


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect()
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids = sorted(data)
    found = hits = 0
    for q in (i for i in ids if i % 20 == 0):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(abs(r["score"] - data[q] @ data[r["vec_id"]]) < 1e-9 for r in mine)
        best = sorted((i for i in ids if i != q), key=lambda i: (-(data[q] @ data[i]), i))[:20]
        hits, found = hits + len({r["vec_id"] for r in mine} & set(best)), found + 20
    assert hits / found >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 2.0]), (8, [-1.0, 0.0]), (9, [float("inf"), 0.0]), (1, [1.0, 0.0]), (8, [-0.5, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = ann.search(df, df.where("vec_id in (0, 3, 4)"), k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.0), (0, 4, 8, -1.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id in (3, 4)"), df, k=3).count() == 0
