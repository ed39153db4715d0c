"""Which texts may be changed by composition: the same as a search for a character outside, in a pass over runs."""

import time

from pyspark.sql import functions as F

from lodestack.functions import text

OUTSIDE = r"[^\x00-\x7F¡-§©«¬®°±¶·»¿-ÿ–—‘’“”•€]"


def test_composed_finds_characters_outside(spark):
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + [0x1F600, 0x2F800]
    texts = [("",), (None,), ("a\nb",), ("éa" * 400_000,), ("éa" * 400_000 + "ﬁ",)] + [("a\né" * (c % 3) + chr(c) + "b–" * (c % 2),) for c in points]
    df = spark.createDataFrame(texts, "t string")
    assert df.where(~F.col("t").rlike(text.COMPOSED).eqNullSafe(F.col("t").rlike(OUTSIDE))).count() == 0


def seconds(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_composed_is_faster_than_a_search_of_all_ranges(spark):
    df = spark.range(400).select(F.concat(F.lit("grüße an alle " * 4000), F.col("id").cast("string")).alias("t")).localCheckpoint()
    took = [min(seconds(df.select(F.col("t").rlike(pattern))) for _ in range(3)) for pattern in (text.COMPOSED, OUTSIDE)]
    assert took[0] * 2 < took[1]
