"""Every registered query as it is registered, over a whole small table: against DuckDB where SQL has it, else against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_bpe_packing import LIBRARY, check_packed, library
from test_simhash import brute_components, brute_fingerprint
from test_warc_sharding_rules import check_shards

from lodestack.llm import crossentropy, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    want = [dict(zip(rel.columns, row)) for row in rel.fetchall()]
    assert sorted(rel.columns) == names
    assert Counter(map(repr, df.select(names).collect())) == Counter("Row(" + ", ".join(f"{c}={w[c]!r}" for c in names) + ")" for w in want)


def test_op1(spark, texts):
    got = queries.op1_simhash(spark, SF).collect()
    texts = sorted(texts)
    fps = [brute_fingerprint(t) for _, t in texts]
    root = brute_components(fps, 3)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{f:016x}", texts[k][0]) for (i, _), f, k in zip(texts, fps, root)]


def test_op2(spark, texts):
    def row(i, t):
        ids = library(t)
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, queries.op2_bpe(spark, SF).collect())) == Counter(row(*x) for x in texts)


def test_op4(spark, texts):
    check_shards(queries.op4_sharding(spark, SF).collect(), texts, 16, 1)


@pytest.mark.parametrize(("name", "parts", "fold"), [("op5_toxicity", 4, 2), ("op9_quality", 5, 0)])
def test_classifiers(spark, texts, name, parts, fold):
    got = queries.QUERIES[name](spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op6(spark, texts):
    assert check_packed(queries.op6_packing(spark, SF).collect(), [(i, (*library(t), 2)) for i, t in texts], 4096) < 0.05


def test_op7(spark):
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    mine, hits = {}, 0
    for r in queries.op7_ann(spark, SF).collect():
        mine.setdefault(r["query_id"], {})[r["rank"]] = r
    assert set(mine) == {i for i in data if i % 20 == 0}
    for q, rows in mine.items():
        assert sorted(rows) == list(range(1, 21))
        best = sorted((i for i in data if i != q), key=lambda i: (-(data[q] @ data[i]), i))[:20]
        found = [(-rows[k]["score"], rows[k]["vec_id"]) for k in sorted(rows)]
        assert found == sorted(found) and all(abs(-s - data[q] @ data[i]) < 1e-9 for s, i in found)
        hits += len({i for _, i in found} & set(best))
    assert hits / (20 * len(mine)) >= 0.9


def test_op8(spark, texts):
    target = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id").collect()}
    path = {i: ["", *(t or "").lower().split(), ""] for i, t in texts}
    models = []
    for ids in (path, target):
        models.append((Counter(w for i in ids for w in path[i][:-1]), Counter(p for i in ids for p in zip(path[i], path[i][1:]))))
    got = {r["doc_id"]: r for r in queries.op8_lm_scoring(spark, SF).collect()}
    assert set(got) == set(path)
    mass, base = crossentropy.MASS, crossentropy.BASE_WORDS
    for i, words in path.items():
        loss = [-sum(math.log((two[p] + mass / base) / (one[p[0]] + mass)) for p in zip(words, words[1:])) / (len(words) - 1) for one, two in models]
        assert abs(got[i]["background_loss"] - loss[0]) < 1e-4 and abs(got[i]["target_loss"] - loss[1]) < 1e-4


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
