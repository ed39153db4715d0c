"""Readers, the versioned table, the engine from files to scored rows, and the stream."""

import json

import pytest

from lodestack.operators import incremental
from lodestack.plans import engine
from lodestack.sources import files, html_report, python_source, sinks, spreadsheet
from lodestack.streaming import ingest

PYTHON = '"""Module."""\nimport os\n\n@deco\nclass A(Base):\n    """Of A."""\n    x = 1\n\n    @prop\n    def m(self):\n        return 1\n\nclass Plain:\n    y = 2\n\nasync def f():\n    pass\n'


def test_python_units():
    got = [(t, k, loc.get("class_name")) for t, k, loc, _ in python_source.units(PYTHON)]
    assert got == [
        ("Module.", "module_docstring", None), ('@deco\nclass A(Base):\n    """Of A."""', "class", None), ("    @prop\n    def m(self):\n        return 1", "function", "A"),
        ("class Plain:\n    y = 2", "class", None), ("async def f():\n    pass", "function", None),
    ]
    assert python_source.units("x = (")[0][1:3] == ("raw_python", {"reason": "syntax_error"})
    assert python_source.units("x = 1")[0][1:3] == ("raw_python", {"reason": "no_top_level_defs"})
    assert files.text_units("class A:\n    def m(self): pass")[0][1] == "class" and files.text_units("import of class goods")[0][1] == "text" and files.text_units(" ") == []


def test_html_sections():
    html = '<title>UP.08880.803.opk</title>Subdivision "Spo kane"<a name="Blocks"></a><table><tr><td>Name</td><td>Leg</td></tr><tr><td> a\n b</td><td> <table><tr><td>x</td><td>y</td></tr><tr><td>z</td></tr></table></td></tr></table><table><tr><td>no</td></tr><tr><td>anchor</td></tr></table><a name="Short"><table><tr><td>1</td></tr></table><a name="U"><table><tr><td>lost<td>kept<br>too</td></tr><tr><td>r</td></tr></table>'
    got = html_report.units(html, "stem")
    assert [(t, loc["section_path"]) for t, _, loc, _ in got] == [("Name | Leg\na b | x y; z", "08880 Spo kane > Blocks"), ("kept; too\nr", "08880 Spo kane > U")]
    assert html_report.report_id("", "track_00123x") == "00123" and html_report.report_id("subdivision 1234567", "none") == "none" and html_report.subdivision_number("12 34x") == "01234" and html_report.subdivision_number(" x ") == "x"


def test_spreadsheets(spark):
    book = spreadsheet.workbook(["S_no", "Requirement", "", "Steps"], [["1", "R<1>", "x", " do "], ["", "", "", ""], ["2", "", "", "é"]])
    got = spreadsheet.units(book)
    assert [(t, loc["row"], more["test_case_id"]) for t, _, loc, more in got] == [("S_no: 1 | Requirement: R<1> | Steps: do", 2, "R<1>_1"), ("S_no: 2 | Steps: é", 4, None)]
    df = spark.createDataFrame([("1", "R1", None), (None, " ", None)], "`#` string, Requirement string, Steps string")
    rows = spreadsheet.serialize(df, ["#", "Requirement", "Steps"]).collect()
    assert [(r["text"], r["unit_test_case_id"]) for r in rows] == [("#: 1 | Requirement: R1", "R1_1")]


class Canned:
    def generate(self, system_prompt, user_prompt, max_tokens=None, num_ctx=None):
        self.seen = user_prompt
        return 'Sure: {"test_cases": [{"description": "Verify L2R9479 speed limit 120", "test_type": "positive"}, {"description": "cut'


@pytest.fixture
def corpus(tmp_path):
    kb = tmp_path / "kb"
    (kb / "track_data").mkdir(parents=True)
    (kb / "a.py").write_text(PYTHON)
    (kb / "note.txt").write_text("The speed limit is 120 for L2R9479.\n\nBrakes apply.")
    (kb / "~$lock.xlsx").write_bytes(b"x")
    (kb / "skip.bin").write_bytes(b"x")
    (kb / "bad.xlsx").write_bytes(b"not a zip")
    (kb / "cases.xlsx").write_bytes(spreadsheet.workbook(["S_no", "Requirement", "Description"], [["1", "L2R9479", "Verify speed limit"]]))
    (kb / "track_data" / "t_00042.html").write_text('<a name="Blocks"></a><table><tr><td>Name</td></tr><tr><td>speed block</td></tr></table>')
    return tmp_path, files.Config.load(json.dumps({"sources": [{"path": str(kb), "document_type": "kb", "subfolders_as_type": True}, {"path": str(tmp_path / "none"), "document_type": "x"}], "base": str(tmp_path)}))


def test_engine_from_files_to_scores(spark, corpus):
    root, config = corpus
    e = engine.Engine(spark, f"file://{root}/table")
    assert e.ingest(config, dry_run=True)["chunks_written"] is not None and e.store.version() is None
    first = e.ingest(config).first()
    assert (first["files_discovered"], first["files_failed"], first["files_skipped"], first["files_processed"]) == (5, 1, 0, 4)
    table = e.store.read()
    assert {r["document_type"] for r in table.select("document_type").distinct().collect()} == {"kb", "track_data"} and table.where("source_path = 'kb/note.txt'").count() == 1
    ids = {r["chunk_id"] for r in table.collect()}
    again = e.ingest(config).first()
    assert again["files_skipped"] == 4 and {r["chunk_id"] for r in e.store.read().collect()} == ids
    (root / "kb" / "a.py").unlink()
    assert e.ingest(config, prune=True).first()["files_pruned"] == 1 and e.store.read().where("source_file = 'a.py'").count() == 0
    e.store.vacuum()
    hits = e.retrieve("speed limit 120").orderBy("position").collect()
    assert hits[0]["pass_ix"] == 0 and hits[-1]["document_type"] == "track_data" and "120" in hits[0]["text"] + hits[1]["text"]
    assert e.retrieve(" ").count() == 0
    prompts = engine.Prompts({"system": "s", "test_cases": "$requirement|$context|$max_test_cases", "test_script": "$requirement $test_cases $context"})
    client = Canned()
    rows = e.generate_cases("L2R9479 speed limit is 120", client, prompts).collect()
    assert len(rows) == 1 and rows[0]["requirement"] == "L2R9479" and rows[0]["grounding"] > 0.5 and rows[0]["closest_existing_source"] == "cases.xlsx" and "speed limit" in client.seen
    assert spreadsheet.sheets(sinks.to_workbook(spark.createDataFrame(rows)))[0][1][1][2] == "Verify L2R9479 speed limit 120"
    with pytest.raises(KeyError):
        prompts.render("none")
    assert e.generate_script("speed", ["a"], type("C", (), {"generate": lambda self, *a: "```py\nx\n```"})(), prompts) == "x"


def test_settings_refuse_what_they_do_not_know():
    with pytest.raises(ValueError):
        files.Config.load('{"sources": [{"path": "a", "document_type": "b"}], "other": 1}')
    with pytest.raises(ValueError):
        files.Config.load('{"sources": []}')
    with pytest.raises(ValueError):
        engine.RetrievalSettings.of(depth=1)
    assert incremental.fingerprint({"a": 1}) != incremental.fingerprint({"a": 2})


def test_stream(spark, corpus, tmp_path):
    root, config = corpus
    seen = []
    q = ingest.upsert_stream(ingest.file_stream(spark, config.sources[0]), lambda units: seen.extend(r["source_path"] for r in units.where("error is null").select("source_path").distinct().collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(set(seen)) == ["kb/a.py", "kb/cases.xlsx", "kb/note.txt", "kb/track_data/t_00042.html"]
