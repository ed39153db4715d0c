"""Spreadsheets: rows under a header as `Header: value` records; .xlsx read and written with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header names, lower-cased, by what they hold.
ALIASES = {
    "requirement_id": ("requirement", "requirement id", "requirement_id", "req id", "reqid"),
    "test_case_id": ("test case id", "test_case_id", "testcaseid", "tc id", "tcid", "case id"),
    "steps": ("steps", "test steps", "test_steps", "step"),
    "expected_result": ("expected result", "expected_result", "expected", "result"),
    "sequence": ("s_no", "s.no", "sno", "sr no", "sl no", "seq", "id", "#"),
}
#: Number formats of the format's own list that show dates or times, and what tells such a format of a file's own.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DATE_CODES = re.compile(r"[ymdhs]", re.I)
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}  # fixed value: the format's name space
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def row_text(columns: list[str]) -> Column:
    """`H: v | H: v` of the columns with a value."""
    pairs = F.array(*(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`").cast("string")))) for c in columns if c))
    return F.array_join(F.array_compact(pairs), " | ")


def serialize(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with `text` and the ids that its header names give; rows without a value are left out."""
    def named(kind: str) -> Column:
        hits = [c for c in columns if c.strip().lower() in ALIASES[kind]]
        return F.nullif(F.trim(F.col(f"`{hits[0]}`").cast("string")), F.lit("")) if hits else F.lit(None).cast("string")

    fallback = F.when(named("requirement_id").isNotNull() & named("sequence").isNotNull(), F.concat(named("requirement_id"), F.lit("_"), named("sequence")))
    ids = {"requirement_id": named("requirement_id"), "test_case_id": F.coalesce(named("test_case_id"), fallback), "steps": named("steps"), "expected_result": named("expected_result")}
    return df.select("*", row_text(columns).alias("text"), *(v.alias(f"unit_{k}") for k, v in ids.items())).where("text <> ''")


def records(sheet: str, rows: list[list[str]]) -> list[tuple]:
    """(text, unit_type, locator, extra) of each row with a value under a header; rows count from 2."""
    if not rows:
        return []
    header, out = [h.strip() for h in rows[0]], []
    places = {k: next((i for i, h in enumerate(header) if h.lower() in names), None) for k, names in ALIASES.items()}
    for no, row in enumerate(rows[1:], 2):
        cells = [c.strip() for c in row]
        pairs = [f"{h}: {c}" for h, c in zip(header, cells) if h and c]
        if not pairs:
            continue
        got = {k: cells[i] or None if i is not None and i < len(cells) else None for k, i in places.items()}
        case = got["test_case_id"] or (f"{got['requirement_id']}_{got['sequence']}" if got["requirement_id"] and got["sequence"] else None)
        out.append((" | ".join(pairs), "test_case", {"sheet": sheet, "row": no}, {"requirement_id": got["requirement_id"], "test_case_id": case, "steps": got["steps"], "expected_result": got["expected_result"]}))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def dated_styles(z: zipfile.ZipFile) -> set[str]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    tree = ElementTree.fromstring(z.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\\\\.|\[[^\]hms][^\]]*\]', "", code)  # noqa: E731  without quoted text, escapes and colours
    own = {int(f.get("numFmtId")) for f in tree.iterfind("m:numFmts/m:numFmt", _NS) if DATE_CODES.search(plain(f.get("formatCode") or ""))}
    return {str(i) for i, x in enumerate(tree.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId") or 0) in own | DATE_FORMATS}


def dated(serial: str, since_1904: bool) -> str:
    """A serial number of days as date and time, or as a time of day below one."""
    days = float(serial)
    moment = timedelta(milliseconds=round(days % 1 * 86_400_000))
    if 0 <= days < 1:
        return str((datetime.min + moment).time())
    whole = int(days // 1)
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if whole < 60 else 30)  # the format has a 29 February 1900
    return str(start + timedelta(whole) + moment)


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(title, rows of cell texts) of a workbook's sheets."""
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        dates, book = dated_styles(z), ElementTree.fromstring(z.read("xl/workbook.xml"))
        kind = book.find("m:workbookPr", _NS)
        since_1904 = kind is not None and kind.get("date1904") in ("1", "true")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in book.find("m:sheets", _NS):
            target = links[s.get(_REL)].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in tree.find("m:sheetData", _NS):
                cells: list[str] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells) + 1)
                    value = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else {"1": "True", "0": "False"}[value.text] if c.get("t") == "b" else dated(value.text, since_1904) if c.get("t", "n") == "n" and c.get("s") in dates else value.text
                gap = int(row.get("r") or len(rows) + 1) - len(rows) - 1
                rows += [[] for _ in range(gap)] + [cells]
            out.append((s.get("name"), rows))
        return out


def units(content: bytes) -> list[tuple]:
    return [u for title, rows in sheets(content) for u in records(title, rows)]


def workbook(header: list[str], rows: list[list], title: str = "Sheet1", widths: list[float] | None = None) -> bytes:
    """An .xlsx file with a frozen header row."""
    def cell(value, style: str = "") -> str:
        return f'<c t="inlineStr"{style}><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>'

    cols = "<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1)) + "</cols>" if widths else ""
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [header, *rows])
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_NS["m"]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>{cols}<sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + xml)
    return out.getvalue()
