"""Layout over words held by page: the same as over words a row each, and neither words nor lines are shuffled."""

import random

from pyspark.sql import functions as F

from lodestack.operators import layout
from lodestack.plans import catalog
from lodestack.sources import pages

SF = "/root/testdata/sf0.001"


def shuffles(df):
    """What is shuffled, a line of the plan each."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in line]


def test_section_units_shuffles_texts_only(spark):
    found = shuffles(catalog.section_units(spark, SF))
    assert found and all("REPARTITION_BY_COL" in line for line in found)


def printed(spark, seed=5):
    rng = random.Random(seed)
    words, tables = [], []
    for d in range(6):
        for p in range(1, 5):
            for k in range(rng.choice([0, 1, 40])):
                x0, top = rng.choice([1.0, 5.0, 9.0]) + k % 3, rng.choice([10.0, 11.5, 13.5, 30.0, 50.0, 50.5])
                words.append((f"d{d}", p, rng.choice(["a", "b", "1.2 Head", "Page 1", "x"]), x0, x0 + 5, top, top + 8, rng.choice([10.0, 12.0, 14.0]), rng.random() < 0.4))
            for k in range(rng.choice([0, 1, 2])):
                top = rng.choice([5.0, 28.0, 49.0])
                tables.append((f"d{d}", p, 0.0, top + k, 8.0, top + 12, [["a", "b"], ["c", rng.choice("de")], ["f", "g"]]))
    return spark.createDataFrame(words, pages.WORDS), spark.createDataFrame(tables, pages.TABLES)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_pages_give_what_words_give(spark):
    words, tables = printed(spark)
    held = layout.paged(words)
    left = layout.outside_tables(words, tables)
    unpacked = layout.outside_tables(held, tables).select("doc", "page", F.explode("words").alias("w")).select("doc", "page", "w.*").select(*left.columns)
    assert 0 < left.count() < words.count() and rows(unpacked) == rows(left)
    lines = layout.group_lines(words)
    assert rows(layout.group_lines(held)) == rows(lines)
    for least in (1, 3):
        for share in (0.1, 0.5):
            assert rows(layout.without_repeats_within(lines, share=share, least_pages=least)) == rows(layout.without_repeats(lines, share=share, least_pages=least).select(*lines.columns))
    headed, body = layout.classify_headings(lines), {r["doc"]: r["body_size"] for r in layout.body_size(lines).collect()}
    assert {(r["doc"], r["body_size"]) for r in headed.collect()} == set(body.items())
    assert rows(pages.page_units(words, tables)) == rows(pages.page_units(held, tables))


def test_section_paths_shuffles_texts_once(spark):
    found = shuffles(catalog.section_paths(spark, SF))
    assert len(found) == 1 and "REPARTITION_BY_COL" in found[0]


def test_words_outside_tables_sorts_no_words(spark):
    plan = catalog.words_outside_tables(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert " Sort " not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
