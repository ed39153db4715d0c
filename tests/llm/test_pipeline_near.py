"""The pipeline's near-duplicates against brute force over exact Jaccard similarities."""

import random
import string

import corpus_pipeline
from lodestack.llm import simhash


def shingles(text, k=5):
    words = text.lower().split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_kept(rows, least):
    """Smallest id of each component over pairs of `least` or more."""
    sets, up = [shingles(t) for _, t in rows], [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= least:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return {i for (i, _), x in zip(rows, up) if i == x}


def near_texts(rng, groups, size=300):
    """Of each group a text and copies with 1 to 18 words changed: similarities from 0.97 to under 0.6, chains among them."""
    rows = []
    for _ in range(groups):
        base = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(size)]
        rows.append((len(rows), " ".join(base)))
        for n in (1, 4, 7, 9, 12, 15, 18):
            words = list(base)
            for at in rng.sample(range(size), n):
                words[at] = f"other{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_stage_keeps_what_is_unlike(spark, monkeypatch):
    rows = near_texts(random.Random(21), 25)
    want = brute_kept(rows, 0.8)
    assert 60 < len(want) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want
    monkeypatch.setattr(simhash, "SHIFT_RUN", 4)  # runs as of large groups
    monkeypatch.setattr(simhash, "LISTED", 2)  # and crowds
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want


def test_graded_copies_of_one_text(spark, monkeypatch):
    """Hundreds of copies of one text with a few to many changes: the classes of brute force, listed or as a crowd."""
    rng = random.Random(4)
    base = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            words[at] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    want = brute_kept(rows, 0.8)
    assert 20 < len(want) < 390
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for listed in (32, 5):
        monkeypatch.setattr(simhash, "LISTED", listed)
        got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
        assert len(got ^ want) <= 4  # what the bands miss of the pairs that alone connect their class
