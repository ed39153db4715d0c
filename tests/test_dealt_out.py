"""Files are read in many tasks though they lie in one partition, and chunks of long texts are given out in parts."""

import pandas as pd

from lodestack.operators import chunking
from lodestack.plans import catalog
from lodestack.sources import files


def test_small_files_are_dealt_out(spark):
    rows = spark.createDataFrame([(f"f{k}.py", ".py", bytearray(b"def f():\n    return 1\n")) for k in range(40)], "source_path string, suffix string, content binary").coalesce(1)
    found = files.extract(rows)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 40
    assert "REPARTITION_BY_NUM" in catalog.python_units(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_long_texts_are_given_out_in_parts(spark, monkeypatch):
    made = []

    class Rows:
        schema = spark.createDataFrame([(1, "a")], "k long, t string").schema

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            made.extend(run(iter([pd.DataFrame({"k": range(10), "t": ["a b c\nd"] * 10})])))

    monkeypatch.setattr(chunking, "CHARS_AT_ONCE", 20)
    chunking.chunk_lines(Rows(), "k", "t", 2)
    whole = pd.concat(made)
    assert len(made) > 2 and sorted(set(whole["k"])) == list(range(10)) and len(whole) == 10
