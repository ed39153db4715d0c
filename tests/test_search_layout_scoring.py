"""Ranking, layout and scoring against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestack.operators import layout, scoring, search


def test_bm25_is_the_formula(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12)))) for i in range(30)]
    query = "a b b z"
    tokens = {i: t.split() for i, t in docs}
    df, n = Counter(w for ts in tokens.values() for w in set(ts)), len(docs)
    mean = sum(map(len, tokens.values())) / n
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    score = {i: sum(idf.get(w, 0) * ts.count(w) * 2.5 / (ts.count(w) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for w in query.split()) for i, ts in tokens.items()}
    want = sorted((i for i, s in score.items() if s > 1e-12), key=lambda i: (-score[i], i))[:5]
    got = search.KeywordIndex.build(spark.createDataFrame(docs, "id long, t string"), "id", "t").search(query, 5).collect()
    assert [r["id"] for r in got] == want and all(abs(r["score"] - score[r["id"]]) < 1e-9 for r in got)


def test_fusion_keeps_ties_in_order(spark):
    dense = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, similarity double")
    keyword = spark.createDataFrame([(3, 5.0), (1, 4.0)], "id long, score double")
    rows = search.fuse(dense, keyword, 5, 60, 1.0, 1.0).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 3, 2] and rows[0]["matched_by"] == ["dense", "keyword"] and rows[1]["matched_by"] == ["keyword"]
    assert [r["id"] for r in search.fuse(dense, keyword, 5, keyword_weight=0).orderBy("rank").collect()] == [1, 2]


def test_context_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, "l", "t", "x" * 50), (2, "l", "t", "y" * 50), (3, "l", "t", "z")], "position int, label string, doc_type string, text string")
    assert search.assemble_context(hits, 10).first()["blocks"] == 1
    assert search.assemble_context(hits, 125).first()["context"].count("---") == 1
    assert search.assemble_context(hits, 80).first()["blocks"] == 1  # the short third isn't skipped to


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0])], "id long, v array<float>")
    rows = search.dense_topk(v, v.where("id = 1"), 10, "id", "v").collect()
    assert [(r["id"], r["similarity"]) for r in rows] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_section_paths_are_a_stack(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for d in range(30):
        stack = []
        for i in range(40):
            level = rng.choice([None, None, 1, 2, 3, 4, 5, 6])
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, f"t{i}"))
            rows.append((f"d{d}", i, level, f"t{i}" if level else None))
            want[f"d{d}", i] = (" > ".join(t for _, t in stack), stack[-1][1] if stack else "")
    got = layout.section_paths(spark.createDataFrame(rows, "doc string, i int, level int, title string"), ["i"]).collect()
    assert {(r["doc"], r["i"]): (r["section_path"], r["section_title"]) for r in got} == want


def test_lines_headings_units(spark):
    words = [("d", 1, w, x, x + 5, top, top + 8, size, bold) for w, x, top, size, bold in [("B", 9.0, 11.5, 10.0, False), ("A", 1.0, 10.0, 10.0, False), ("C", 1.0, 13.4, 10.0, False), ("2.1", 1.0, 30.0, 12.0, True), ("Head", 5.0, 30.0, 12.0, True), ("after", 1.0, 50.0, 10.0, False), ("x....4", 1.0, 70.0, 14.0, True), ("body", 1.0, 80.0, 10.0, False)]]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, bottom double, size double, bold boolean")
    lines = layout.classify_headings(layout.group_lines(df))
    got = lines.orderBy("line").collect()
    assert [(r["text"], r["level"]) for r in got] == [("A C B", None), ("2.1 Head", 2), ("after", None), ("x....4", None), ("body", None)]
    tables = spark.createDataFrame([("d", 1, 75.0, "p | q"), ("d", 1, 90.0, "r | s")], "doc string, page int, top double, text string")
    units = layout.section_units(lines, tables).orderBy("unit").collect()
    assert [(r["unit_type"], r["text"], r["table_title"]) for r in units] == [("section_text", "A C B", None), ("section_text", "after\nx....4", None), ("table", "p | q", "x....4"), ("section_text", "body", None), ("table", "r | s", "body")]
    box = spark.createDataFrame([("d", 1, 0.0, 45.0, 100.0, 60.0)], "doc string, page int, x0 double, top double, x1 double, bottom double")
    assert "after" not in [r["text"] for r in layout.outside_tables(df, box).collect()]


def test_tables_and_repeats(spark):
    cells = [[["a", None], ["b\nc", "d"], ["", " "]], [["a", "b"], ["c", "d"], ["e", "f"]], [["a", "b"], ["c", "d"]]]
    rows = spark.createDataFrame([(c,) for c in cells], "c array<array<string>>").select(layout.table_text(F.col("c")).alias("t"), layout.looks_tabular(F.col("c")).alias("ok")).collect()
    assert [r["t"] for r in rows] == ["a | \nb c | d", "a | b\nc | d\ne | f", "a | b\nc | d"] and [r["ok"] for r in rows] == [False, True, False]
    lines = [("d", p, f"Page {p} of 9") for p in range(1, 6)] + [("d", 1, "once"), ("e", 1, "Page 1 of 2"), ("e", 2, "Page 2 of 2")]
    left = layout.without_repeats(spark.createDataFrame(lines, "doc string, page int, text string"), least_pages=3).collect()
    assert sorted(r["text"] for r in left) == ["Page 1 of 2", "Page 2 of 2", "once"]


def test_scoring(spark):
    df = spark.createDataFrame([([0.9, None, 0.5, 0.7, 0.1], "Check AB12 speed limit zz9", ["speed", "ab12"], ["ab12"])], "s array<double>, d string, t array<string>, i array<string>")
    row = df.select(scoring.retrieval(F.col("s")).alias("r"), scoring.grounding(F.col("d"), F.col("t"), F.col("i")).alias("g")).first()
    assert abs(row["r"] - 0.7) < 1e-9 and abs(row["g"] - (0.35 * 2 / 5 + 0.65)) < 1e-9
    empty = spark.createDataFrame([([], "the of")], "s array<double>, d string").select(scoring.retrieval(F.col("s")).alias("r"), scoring.grounding(F.col("d"), F.array(F.lit("x")), F.array(F.lit("x"))).alias("g")).first()
    assert (empty["r"], empty["g"]) == (0.0, 0.0)
    conf = scoring.confidence(spark.createDataFrame([(0.5, 0.5, None), (0.55, 0.55, 0.55), (0.1, 1.2, 0.9)], "retrieval double, grounding double, similarity double")).collect()
    assert [(r["overall"], r["similarity"]) for r in conf] == [(0.5, 0.0), (0.55, 0.55), (0.75, 0.9)] and conf[0]["needs_review"]
    chunks = spark.createDataFrame([("test_case", "L2R9479"), ("test_case", None), ("table", "L2R94"), ("test_case", "X1")], "content_type string, requirement_id string")
    assert scoring.existing_for(chunks, "l2r94_A").count() == 2 and scoring.existing_for(chunks, None).count() == 3
    cases = spark.createDataFrame([("AB12 speed",), ("nothing known",)], "d string")
    vocab = spark.createDataFrame([("AB12 and more speed",), ("other",)], "t string")
    got = {r["d"]: r["grounding"] for r in scoring.grounded(cases, ["d"], "d", vocab, "t").collect()}
    assert got == {"AB12 speed": 1.0, "nothing known": 0.0}


def test_vocabulary_terms_are_distinct(spark):
    chunks = spark.createDataFrame([("the AB12 a",), ("ab12 x_y",)], "t string")
    row = scoring.context_vocabulary(chunks, "t").first()
    assert row["tokens"] == ["ab12", "x", "y"] and row["identifiers"] == ["ab12", "x_y"] and re.match("a", "a")
