"""The closest existing record: vectors of every kind against each pair worked out by itself, and no pair is a row."""

import math
import random

from pyspark.sql import functions as F

from lodestack.operators import scoring, search
from lodestack.plans import catalog


def vectors(n, seed):
    rng = random.Random(seed)
    odd = [None, [], [0.0, 0.0, 0.0], [-0.0, 0.0, 0.0], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 1.0, 1.0], [1e200, 1.0, 1.0], [1e-200, 0.0, 0.0], [1.0, 2.0], [1.0], [1.0, 1.0, 1.0], [3.0, 3.0, 3.0], [-1.0, -1.0, -1.0]]
    return [(i, rng.choice(["a", "b", "c", None]), odd[i] if i < len(odd) else [rng.choice([rng.gauss(0, 1), -1.0, 0.5]) for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(n)]


def pair_by_pair(c, e, by):
    sim = F.coalesce(scoring.clamp(search.cosine(F.col("cv"), F.col("v"))), F.lit(0.0))
    pairs = c.select(F.col("g").alias("cg"), F.col("k"), F.col("v").alias("cv")).join(e, F.col("cg") == F.col("g") if by else F.lit(True))
    best = pairs.groupBy("k").agg(F.max(F.struct(sim.alias("s"), (-F.col("e")).alias("e"))).alias("b"))
    return {(r["k"], -r["b"]["e"], r["b"]["s"]) for r in best.collect()}


def test_closest_is_the_best_of_all_pairs(spark, monkeypatch):
    c = spark.createDataFrame([(i % 90, g, v) for i, g, v in vectors(110, 1)], "k long, g string, v array<double>")  # keys repeat
    e = spark.createDataFrame([(1000 - i, g, v) for i, g, v in vectors(150, 2)] + [(5000 + i, "a", [1.0, 1.0, 1.0]) for i in range(40)], "e long, g string, v array<double>")
    for block in (32 << 20, 2000):
        monkeypatch.setattr(scoring, "BLOCK_BYTES", block)
        for by in (None, "g"):
            found = scoring.closest(c, e, "k", "v", "e", "v", by).collect()
            assert {(r["k"], r["closest"], r["similarity"]) for r in found} == pair_by_pair(c, e, by) and len(found) == len({r["k"] for r in found})
    assert scoring.closest(c, e.where("false"), "k", "v", "e", "v").count() == 0 and scoring.closest(c.where("false"), e, "k", "v", "e", "v", "g").count() == 0


def test_blocks_are_small(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scoring, "BLOCK_PRODUCTS", 7)
    rng = random.Random(4)
    side = lambda n: pa.table({"v": pa.chunked_array([pa.array([0] * n)]), "id": pa.chunked_array([pa.array(range(n))]), "vec": pa.chunked_array([pa.array([[rng.choice([-1.0, 1.0, 2.0]) for _ in range(3)] for _ in range(n)])])})
    c, e = side(60), side(50)
    small = scoring.closest_in_block(c, e).to_pylist()
    monkeypatch.undo()
    assert small == scoring.closest_in_block(c, e).to_pylist() and len(small) == 60


def joined_pairs(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    return "CoGroup" not in plan or any("e_vec" in line for line in plan.splitlines() if "Join" in line)


def test_no_pair_is_a_row_in_confidence_overall(spark):
    assert not joined_pairs(spark, "confidence_overall")


def test_no_pair_is_a_row_in_existing_similarity(spark):
    assert not joined_pairs(spark, "existing_similarity")


def test_no_pair_is_a_row_in_existing_in_group(spark):
    assert not joined_pairs(spark, "existing_in_group")
