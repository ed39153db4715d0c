"""Versions on disk, rows of sheets, static context and examples, prompts, paged documents, uploads, caches."""

import json
import os
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestack.functions import cache, llm_json, text
from lodestack.operators import chunking, incremental, layout
from lodestack.plans import engine, static_context
from lodestack.sources import files, pages, spreadsheet


def rows_of(spark, *rows):
    return spark.createDataFrame([(f"{p}:{k}", p, t) for p, k, t in rows], "chunk_id string, source_path string, text string")


def test_versions_are_whole_or_not_there(spark, tmp_path):
    store = incremental.VersionedTable(spark, f"file://{tmp_path}/t", buckets=8)
    assert store.version() is None and store.read() is None and store.count() == 0
    with pytest.raises(RuntimeError):
        store.vacuum()  # without a current version nothing may go
    store.replace(rows_of(spark, *((f"p{i}", 0, "old") for i in range(40))))
    before = json.loads((tmp_path / "t/versions" / store.version()).read_text())["folders"]
    store.upsert(rows_of(spark, ("p3", 0, "new"), ("p3", 1, "new"), ("p3", 1, "new")), spark.createDataFrame([("p5",)], "source_path string"))
    after = json.loads((tmp_path / "t/versions" / store.version()).read_text())["folders"]
    assert 1 <= sum(before[b] != after.get(b) for b in before) <= 2  # only the buckets of p3 and p5 are written anew
    got = sorted((r["source_path"], r["text"]) for r in store.read().collect())
    assert got == sorted([(f"p{i}", "old") for i in range(40) if i not in (3, 5)] + [("p3", "new")] * 2) and store.count() == 40
    # a writer that died before it published leaves nothing that readers see, and its folder goes
    store._write(rows_of(spark, ("p9", 0, "lost")), 8)
    assert store.count() == 40
    store.vacuum()
    assert store.count() == 40 and {n for n in os.listdir(tmp_path / "t") if n.startswith("data-")} == set(after.values())
    # two writers after the same version: the second is told
    now = store.version()
    store._publish(now, json.loads((tmp_path / "t/versions" / now).read_text()))
    with pytest.raises(RuntimeError):
        store._publish(now, {})
    store.reset(store.read().schema)
    assert store.count() == 0 and store.upsert(rows_of(spark, ("a", 0, "b"))) and store.count() == 1


@pytest.fixture
def kb(tmp_path):
    root = tmp_path / "kb"
    (root / "python_apis").mkdir(parents=True)
    (root / "track_data").mkdir()
    (root / "python_apis" / "api.py").write_text('def set_speed(limit):\n    """Set the speed limit."""\n    return limit\n\n\ndef brake():\n    return 0\n')
    (root / "track_data" / "t_00042.html").write_text('<a name="Blocks"></a><table><tr><td>Name</td></tr><tr><td>speed block 7</td></tr></table>')
    (root / "track_data" / "t_00043.HTM").write_text('<a name="Signals"></a><table><tr><td>Name</td></tr><tr><td>speed signal</td></tr></table>')
    book = spreadsheet.workbook(["S_no", "Requirement", "Description"], [[str(i), f"R{i}", f"speed case {i}"] for i in range(1, 8)])
    (root / "cases.xlsx").write_bytes(book)
    ex = tmp_path / "examples"
    for sub in ("reference_test_cases", "reference_test_scripts"):
        (ex / sub).mkdir(parents=True)
    (ex / "l2r1_a.txt").write_text("first")
    (ex / "L2R1_b.txt").write_text("the requirement " + "long " * 200)
    (ex / "l2r2.txt").write_text("only a requirement")
    (ex / "reference_test_cases" / "L2R1_cases.xlsx").write_bytes(book)
    (ex / "reference_test_scripts" / "L2R1.txt").write_text("step one\nstep two")
    (ex / "reference_test_scripts" / "l2r3_s.txt").write_text("line\n" * 400)
    sources = [{"path": str(root), "document_type": "kb", "subfolders_as_type": True}]
    return tmp_path, files.Config.load(json.dumps({"sources": sources, "static_sources": sources, "examples_dir": str(ex), "max_rows_per_chunk": 3}))


def test_rows_are_taken_together_by_sheet(spark, kb):
    _, config = kb
    found = files.discover(spark, config)
    made = {(r["row_start"], r["row_end"]): r for r in engine.chunks_of(files.extract(found), found, config).where("content_type = 'test_case'").collect()}
    assert set(made) == {(2, 4), (5, 7), (8, 8)} and {r["total_chunks_in_unit"] for r in made.values()} == {3}
    assert made[2, 4]["text"].count("\n") == 2 and made[5, 7]["requirement_id"] == "R4" and made[5, 7]["chunk_index"] == 1 and made[8, 8]["sheet"] == "Sheet1"
    alone = files.Config.load(json.dumps({"sources": [{"path": str(kb[0] / "kb"), "document_type": "kb"}]}))
    single = engine.chunks_of(files.extract(found), found, alone).where("content_type = 'test_case'").orderBy("row_start").collect()
    assert [(r["row_start"], r["chunk_index"]) for r in single] == [(i + 2, i) for i in range(7)]


def test_static_context_and_examples(spark, kb):
    _, config = kb
    static = static_context.StaticContext.scan(spark, config)
    api = static.api("speed limit", 5)
    assert api.startswith("[1] python_apis | api.py > set_speed\ndef set_speed") and "track_data" not in api
    assert static.track("speed", 1).count("[") == 1 and static.track("speed", 0) == "" and static.api("nothing at all", 3) == ""
    examples = static_context.scan_examples(spark, config.examples_dir, config)
    rows = {r["key"]: r for r in examples.collect()}
    assert set(rows) == {"L2R1", "L2R2", "L2R3"} and rows["L2R1"]["requirement"] == "first"  # of L2R1_b and l2r1_a the last by name
    assert rows["L2R2"]["test_cases"] == "" and rows["L2R1"]["test_cases"].startswith("S_no: 1 | Requirement: R1") and "\n\nS_no: 2" in rows["L2R1"]["test_cases"]
    shown = static_context.render_examples(examples, "script", 900)
    first, second = shown.split("\n\n---\n\n")
    assert first == "### Example: L2R1\n\nRequirement:\nfirst\n\nReference script:\nstep one\nstep two"
    assert second.startswith("### Example: L2R3\n\nReference script:\nline") and second.endswith(text.TRUNCATION_MARK) and len(second) < 600
    assert static_context.render_examples(examples, "script", 0) == "" and static_context.scan_examples(spark, "", config).count() == 0


def test_generators_show_static_context(spark, kb):
    root, config = kb
    e = engine.Engine(spark, f"file://{root}/table")
    e.ingest(config)
    assert e.subdivisions(e.store.read()) == ["00042", "00043"]
    (root / "prompts.json").write_text(json.dumps({"test_script": {"system": " be brief ", "user": "$requirement|$test_cases|$api_context|$track_context|$examples"}}))
    prompts = engine.PromptFile(str(root / "prompts.json"))
    seen = []
    client = type("C", (), {"generate": lambda self, *a: seen.append(a) or "x"})()
    static, examples = static_context.StaticContext.scan(spark, config), static_context.scan_examples(spark, config.examples_dir, config)
    assert e.generate_script("speed limit", ["a", "b"], client, prompts, static, examples) == "x"
    system, user = seen[0]
    assert system == "be brief" and user.startswith("speed limit|1. a\n2. b|[1] python_apis") and "### Example: L2R1" in user and "[1] track_data" in user
    (root / "prompts.json").write_text(json.dumps({"test_script": {"system": "other", "user": "$missing"}}))
    os.utime(root / "prompts.json", (time.time() + 5,) * 2)
    with pytest.raises(KeyError):
        e.generate_script("speed limit", ["a"], client, prompts)
    (root / "prompts.json").write_text('{"test_script": {"system": " ", "user": "x"}}')
    os.utime(root / "prompts.json", (time.time() + 9,) * 2)
    with pytest.raises(ValueError, match="no system text"):
        prompts.render("test_script")


def test_paged_documents(spark, tmp_path):
    class Pages:  # words and tables in JSON; defined here, so that it goes to the workers whole
        def read(self, content):
            found = json.loads(content)
            return [tuple(w) for w in found["words"]], [tuple(t) for t in found["tables"]]

    def line(page, top, said, size=10.0, bold=False):
        return [(page, w, 10.0 * k, 10.0 * k + 8, top + 0.5 * (k % 2), top + 10, size, bold) for k, w in enumerate(said.split())]

    words = [w for p in (1, 2, 3) for w in line(p, 5.0, f"Company page {p}")]
    words += line(1, 30.0, "1 Scope", 14.0, True) + line(1, 50.0, "what it covers") + line(1, 70.0, "in table words") + line(2, 30.0, "1.1 Limits", 12.0, True) + line(2, 50.0, "limits hold") + line(3, 50.0, "and go on")
    tables = [(1, 0.0, 68.0, 500.0, 84.0, [["a", "b"], ["c", None], ["d", "e"], ["f", "g"]]), (2, 0.0, 90.0, 50.0, 99.0, [["x", "y"]])]
    (tmp_path / "doc.PDF").write_text(json.dumps({"words": words, "tables": tables}))
    (tmp_path / "bad.pdf").write_text("no JSON")
    config = files.Config.load(json.dumps({"sources": [{"path": str(tmp_path), "document_type": "spec"}]}))
    e = engine.Engine(spark, f"file://{tmp_path}/table", page_reader=Pages())
    counts = e.ingest(config).first()
    assert (counts["files_discovered"], counts["files_failed"], counts["files_processed"]) == (2, 1, 1)
    got = {(r["content_type"], r["section_path"], r["page"], r["table_title"]): r["text"] for r in e.store.read().collect()}
    assert got == {
        ("section_text", "1 Scope", 1, None): "what it covers", ("table", "1 Scope", 1, "what it covers"): "a | b\nc |\nd | e\nf | g",
        ("section_text", "1 Scope > 1.1 Limits", 2, None): "limits hold\nand go on",
    }
    assert layout.LINE_TOLERANCE == 2.0 and engine.Engine(spark, f"file://{tmp_path}/other").ingest(config).first()["files_discovered"] == 0
    assert pages.read_pages(spark.createDataFrame([], "source_path string, content binary"), Pages())[0].count() == 0


def test_uploads(spark):
    rows = [("a.TXT", b" L2R9 speed \xff "), ("b.md", b" \n"), ("c.pdf", b"x"), ("d", b"x"), ("e.txt", b"x" * (files.UPLOAD_BYTES + 1)), ("f.txt", b"y" * files.UPLOAD_BYTES)]
    got = {r["filename"]: r for r in files.uploaded(spark.createDataFrame(rows, "filename string, content binary")).collect()}
    assert got["a.TXT"]["requirement_text"] == "L2R9 speed �" and got["a.TXT"]["requirement_id"] == "L2R9" and got["a.TXT"]["error"] is None
    assert [got[n]["error"] for n in ("b.md", "c.pdf", "d", "e.txt", "f.txt")] == ["empty", "not plain text: .pdf", "not plain text: no extension", "larger than 2 MB", None]


def test_dates_in_spreadsheets():
    assert spreadsheet.dated("45292", False) == "2024-01-01 00:00:00" and spreadsheet.dated("45292.75", False) == "2024-01-01 18:00:00"
    assert spreadsheet.dated("0.25", False) == "06:00:00" and spreadsheet.dated("0", True) == "00:00:00" and spreadsheet.dated("1", False) == "1900-01-01 00:00:00" and spreadsheet.dated("1", True) == "1904-01-02 00:00:00"
    import io
    import zipfile

    book, styled = spreadsheet.workbook(["Date", "N", "Own"], []), io.BytesIO()
    cells = '<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2"><v>45292</v></c><c r="C2" s="2"><v>45292.5</v></c></row></sheetData>'
    styles = f'<styleSheet xmlns="{spreadsheet._NS["m"]}"><numFmts><numFmt numFmtId="164" formatCode="[Red]yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(styled, "w") as new:
        for name in old.namelist():
            data = old.read(name).decode()
            new.writestr(name, data.replace("</sheetData>", cells) if "worksheets" in name else data)
        new.writestr("xl/styles.xml", styles)
    assert spreadsheet.units(styled.getvalue())[0][0] == "Date: 2024-01-01 00:00:00 | N: 45292 | Own: 2024-01-01 12:00:00"


def test_recent_results():
    now = [0.0]
    held = cache.RecentResults(2, 10, clock=lambda: now[0])
    assert held.of("a", lambda: 1) == 1 and held.of("a", lambda: 2) == 1
    held.put("b", None)
    assert held.of("b", lambda: 3) is None and held.get("a") == 1
    held.put("c", 4)
    assert held.get("b", "gone") == "gone" and held.get("a") == 1 and len(held) == 2
    now[0] = 11.0
    assert held.get("a") is None and held.of("c", lambda: 5) == 5
    held.clear()
    assert len(held) == 0


def test_python_sees_only_rows_that_need_it(spark, tmp_path, monkeypatch):
    def counting(what):
        @F.pandas_udf("string")
        def seen(rows: "pandas.Series") -> "pandas.Series":  # noqa: F821
            with open(tmp_path / what, "a") as f:
                f.write("x" * int(rows.notna().sum()))
            return rows

        return seen

    import pandas

    counting.__globals__["pandas"] = pandas
    monkeypatch.setattr(text, "_nfkc", counting("nfkc"))
    monkeypatch.setattr(llm_json, "_tolerant", counting("json"))
    df = spark.createDataFrame([("plain",), ("été – “ça” naïve ß €",), ("ﬁ",), ("é",), (None,)], "t string")
    assert [r[0] for r in df.select(text.nfkc(F.col("t"))).collect()] == ["plain", "été – “ça” naïve ß €", "ﬁ", "é", None]
    assert (tmp_path / "nfkc").read_text() == "xx"
    raw = spark.createDataFrame([('{"a": 1}',), (' {"b": 2} ',), ("said: {}",), ("[1]",), (None,)], "t string")
    raw.select(llm_json.tolerant_json(F.col("t"))).collect()
    assert (tmp_path / "json").read_text() == "xx"


def test_what_is_taken_for_composed_is():
    import re

    safe = [c for c in map(chr, range(0x11000)) if not 0xD800 <= ord(c) < 0xE000 and not re.match(text.COMPOSED, c)]
    assert len(safe) > 200 and all(unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0 for c in safe)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in safe for b in safe)


def test_hard_split_is_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(["word"] * n),)], "t string")
        plan = df.select(F.size(chunking.hard_split(F.col("t"), 100)).alias("n"))
        plan.collect()
        began = time.perf_counter()
        assert plan.first()["n"] == -(-n // 100)
        return time.perf_counter() - began

    assert seconds(100_000) < 5 + 8 * seconds(25_000)


def test_characters_of_other_scripts(spark):
    df = spark.createDataFrame([("é123 L2R9479 ab_cd été_x ٣٤٥ x١٢ naïve12",), ("L2R9é rest",)], "t string")
    got = df.select(text.identifiers(F.col("t")), text.requirement_id(F.col("t")), text.keywords(F.col("t"))).collect()
    assert got[0][0] == ["ab_cd", "٣٤٥"]
    assert got[1][1] == "L2R9é" and "x١٢" in got[0][2]


def test_tokens_of_a_model(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, df = public_tokenizers.path("word_bpe_49k.json"), spark.createDataFrame([("The unbelievable tokenizer!",), ("",), (None,)], "t string")
    own = Tokenizer.from_file(path)
    want = [len(own.encode(t or "", add_special_tokens=False).ids) for t in ("The unbelievable tokenizer!", "", None)]
    assert [r[0] for r in df.select(text.model_token_count(F.col("t"), path)).collect()] == want
    assert [r[0] for r in df.select(text.model_token_count(F.col("t"), "/none")).collect()] == [3, 0, 0]
