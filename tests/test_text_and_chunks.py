"""Text functions and chunking: golden cases and brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestack.functions import llm_json, text
from lodestack.operators import chunking


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def brute_normalize(t):
    t = re.sub(r"[\x00-\x08\x0b-\x1f]", "", unicodedata.normalize("NFKC", t))
    t = re.sub(r"(\w)-\n(\w)", r"\1\2", t)
    t = re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_normalize(spark):
    rng = random.Random(0)
    texts = ["a-\nb-\nc", "foo- \nbar", "a\rb", "x\x0cy", "ﬁn  é-\nvie\n\n\n\nz", " \u00a0a\u2003 ", ""] + ["".join(rng.choice("ab -\n\t\r\x0céﬁ½") for _ in range(30)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_text(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [brute_normalize(r["t"]) for r in rows]
    assert one(spark, text.normalize_code(F.col("t")), t="\n  a-\nb  c  \n\n\n\nd\n") == "  a-\nb  c\n\nd"


def test_tokens_and_identifiers(spark):
    assert one(spark, text.keywords(F.col("t")), t="L2R94 foo_bar éa 12ab") == ["l2r94", "foo", "bar", "a", "12", "ab"]
    assert one(spark, text.identifiers(F.col("t")), t="AB12 ab12 x_y 123 a1 é123 12") == ["ab12", "x_y", "123"]
    assert one(spark, text.token_count(F.col("t")), t=None) == 0


@pytest.mark.parametrize(
    ("raw", "ident", "area", "query"),
    [
        ("L2R9479 The train stops", "L2R9479", None, "The train stops"),
        ("15 Speed Enforcement\n15.1.1 Track Based Limits\n2. L2R7983\nBody", "L2R7983", "Speed Enforcement", "15 Speed Enforcement\n15.1.1 Track Based Limits\n2. L2R7983\nBody"),
        ("15.1 Deep Part\n3 Top Part\nx", None, "Top Part", None),
        ("nothing here", None, None, "nothing here"),
        ("AB1", "AB1", None, "AB1"),
    ],
)
def test_requirements(spark, raw, ident, area, query):
    assert one(spark, text.requirement_id(F.col("t")), t=raw) == ident
    assert one(spark, text.functional_area(F.col("t")), t=raw) == area
    if query:
        assert one(spark, text.requirement_query(F.col("t")), t=raw) == query


def test_labels_and_truncation(spark):
    n = F.lit(None).cast("string")
    assert one(spark, text.source_label(F.col("f"), F.col("p"), F.lit("3.1"), n, F.lit("A"), F.lit("m"), F.lit("T")), f="X.pdf", p=12) == "X.pdf > p.12 > 3.1 > A.m"
    assert one(spark, text.source_label(F.col("f"), F.col("p"), F.lit(""), n, n, n, F.lit("T")), f="X", p=0) == "X > T"
    assert one(spark, text.budgeted(F.col("t"), F.lit(10)), t="aaaaaaa\nbbbbbbbb") == "aaaaaaa" + text.TRUNCATION_MARK
    assert one(spark, text.budgeted(F.col("t"), F.lit(10)), t="aa\nbbbbbbbbbbbb") == "aa\nbbbbbbb" + text.TRUNCATION_MARK
    assert one(spark, text.budgeted(F.col("t"), F.lit(0)), t=" long ") == "long"
    assert one(spark, text.choose(F.col("t"), llm_json.TECHNIQUES, "X"), t="boundary value") == "Boundary Value Analysis"
    assert one(spark, text.choose(F.col("t"), llm_json.YES_NO, "Yes"), t=" no ") == "No"
    assert one(spark, text.choose(F.col("t"), llm_json.YES_NO, "Yes"), t="") == "Yes"
    assert one(spark, text.strip_fence(F.col("t")), t="```python\nx = 1\n```") == "x = 1"
    assert one(spark, text.round_half_even(F.col("t").cast("double")), t="0.0625") == 0.062


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('text ```json\n{"a": [1]}\n``` more', {"a": [1]}),
        ('so: {"a": "x } y"} and } this', {"a": "x } y"}),
        ('{"a": [{"b": 1}, {"b": "cut', {"a": [{"b": 1}]}),
        ('{"a": [{"b": "q\\"}"}, {"b', {"a": [{"b": 'q"}'}]}),
        ("no json", None),
        ('{"a": 1, "b', None),
        (None, None),
    ],
)
def test_tolerant_json(raw, want):
    import json

    got = llm_json.tolerant(raw)
    assert (json.loads(got) if got else None) == want


def test_parse_cases(spark):
    raw = '```json\n{"test_cases": [{"description": ["a ", " ", "b"], "test_type": "NEGATIVE", "folder": null}, 5, {"description": " "}, {"description": "c", "retired": "true", "folder": "F"}]}\n```'
    rows = llm_json.parse_cases(spark.createDataFrame([(1, raw), (2, "none"), (3, '{"test_cases": []}')], "k int, raw string"), "raw", F.lit("R1"), F.lit("D")).orderBy("k", "s_no").collect()
    assert [(r["k"], r["s_no"], r["description"], r["folder"], r["test_type"], r["retired"]) for r in rows] == [(1, 1, "a\nb", "D", "Negative", "False"), (1, 2, "c", "F", "Positive", "True")]


def test_packing_carries_overlap_without_a_second_look():
    piece = " ".join(["w"] * 500)
    assert [len(c.split()) for c in chunking.pack([piece] * 3, 512, 50, "\n\n")] == [500, 1000, 1000]
    long = " ".join(["v"] * 700)
    assert [len(c.split()) for c in chunking.pack([piece, long, piece], 512, 50, " ")] == [500, 512, 188, 500]
    assert chunking.pack(["a", "b", "c"], 2, 0, " ") == ["a b", "c"]


def test_lines_and_rows():
    code = "def f():\n" + "\n".join(f"    x = {i}" for i in range(10))
    made = chunking.line_chunks(code, 11)
    assert all(c.startswith("def f():\n") for c in made) and [c.count("\n") for c in made] == [3, 3, 3, 1]
    assert chunking.line_chunks("a b c", 2) == ["a b c"]
    rows = [(2, "a b"), (3, "c"), (4, "d e f g h"), (5, "i")]
    assert chunking.row_chunks(rows, 4, 2) == [("a b\nc", 2, 3), ("d e f g", 4, 4), ("h", 4, 4), ("i", 5, 5)]


def test_native_splits_are_the_folds(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b.", "c!", "d?", "e\n\nf"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.hard_split(F.col("t"), 7).alias("h"), chunking.sentences(F.col("t")).alias("s"), chunking.paragraphs(F.col("t")).alias("p")).collect()
    for r in rows:
        assert r["h"] == chunking._groups_of_words(r["t"], 7)
        assert r["s"] == [s for s in re.split(r"(?<=[.!?])\s+", r["t"].strip()) if s]
        assert r["p"] == [p for p in re.split(r"\n\s*\n", r["t"].strip()) if p.strip()]
