"""Each stage of the pipeline, and all of them in turn, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_bpe_packing import check_packed, library
from test_pipeline_near import brute_kept
from test_warc_sharding_rules import brute_counts

import corpus_pipeline
from lodestack.llm import quality

SF = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def passes(text):
    text = text or ""
    n, chars, symbols, dup, lines, repeat = brute_counts(text)
    letters, capitals = sum(map(str.isalpha, text)), len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or chars < 2 * n or chars > 14 * n or 10 * dup > 3 * lines or 10 * capitals > 4 * letters or 10 * letters < 6 * chars)


def shown(rows):
    return Counter(map(tuple, rows))


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The common odd rows with clashing columns, and rows that share an id or have none."""
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    more = [(1, words, "en", "s", 5, 1, "k", 2, 3), (1, words.replace("word", "other"), "en", "s", 5, 1, "k", 2, 3), (None, words.replace("word", "third"), "en", "s", 5, 1, "k", 2, 3), (None, words, "en", "s", 5, 1, "k", 2, 3), (7, words, "en", "s", 5, 1, "k", 2, 3)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).coalesce(3)


def test_quality_classifier(spark, odd, empty):
    got = corpus_pipeline.quality_classifier(spark, odd, SF)
    assert got.columns == odd.columns
    fold = corpus_pipeline.F.crc32(corpus_pipeline.F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.train(odd.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"), fold)
    rows = odd.collect()
    scores = model.score(np.array([quality.style(r["text"]) for r in rows]))
    assert shown(got.collect()) == shown(r for r, s in zip(rows, scores) if s >= 0.3)
    assert corpus_pipeline.quality_classifier(spark, empty, SF).count() == 0


def test_quality_rules(spark, odd, empty):
    got = corpus_pipeline.quality_rules(spark, odd, SF)
    assert got.columns == odd.columns
    kept = [r for r in odd.collect() if passes(r["text"])]
    assert kept and shown(got.collect()) == shown(kept)
    assert corpus_pipeline.quality_rules(spark, empty, SF).count() == 0


def test_near_duplicates(spark, odd, empty):
    got = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert got.columns == odd.columns
    rows = got.collect()
    # ids that are shared or missing hold back nobody whose text is like no other's
    texts = Counter(r["text"] for r in rows)
    assert max(texts.values()) == 1 and sum(not (t or "").strip() for t in texts) == 1
    assert {(r["doc_id"], (r["text"] or "")[:5]) for r in rows if (r["text"] or "").startswith(("worda", "other", "third"))} == {(1, "worda"), (1, "other"), (None, "third")}
    assert shown(rows) <= shown(odd.collect())
    assert corpus_pipeline.near_duplicates(spark, empty, SF).count() == 0


def test_pack(spark, odd, empty):
    wanted = [(r["doc_id"], (*library(r["text"]), 2)) for r in odd.collect() if r["doc_id"] not in (None, 1, 7)]
    got = corpus_pipeline.pack(spark, odd.where("doc_id is not null and doc_id not in (1, 7)"), SF).collect()
    assert check_packed(got, wanted, 4096) < 0.5
    assert corpus_pipeline.pack(spark, empty, SF).count() == 0


def test_run(spark):
    """All stages over a whole table: the rows that plain Python leaves, and every token of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = corpus_pipeline.F.crc32(corpus_pipeline.F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"), fold)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [r for r, s in zip(rows, model.score(np.array([quality.style(t) for _, t in rows]))) if s >= 0.3]
    rows = [r for r in rows if passes(r[1])]
    keep = brute_kept(rows, 0.8)
    rows = [r for r in rows if r[0] in keep]
    got = corpus_pipeline.run(spark, SF).collect()
    assert 50 < len(rows) == len({r["doc_id"] for r in got})
    assert check_packed(got, [(i, (*library(t), 2)) for i, t in rows], 4096) < 0.05
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "SimHash near-dedup", "packing"]


def test_very_long_and_very_many(spark):
    rng = random.Random(1)
    long = " ".join(str(rng.random()) for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000)] + [(10 + i, "same words again and again in every one of these") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == {1, 3, 10}
    assert corpus_pipeline.quality_rules(spark, df, SF).count() == 0
