"""HTML reports: named anchors followed by tables, one unit a section.

A report is read into a tree of its tables, rows and cells, in which text, anchors and breaks are leaves;
sections are then found by walking the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Where a report's number and name stand.
BODY_ID = re.compile(r"subdivision\s+(\d{3,6})\b", re.I)
TITLE_ID = re.compile(r"<title>[^<]*?\.?(\d{4,6})\.\d+", re.I)
NAME = re.compile(r'Subdivision\s*"([^"]+)"')
STEM_ID = re.compile(r"(\d{3,6})")
LEAST_ROWS, ID_DIGITS = 2, 5

#: What stands between the rows and the cells of a table within a cell, and for a line break.
BETWEEN = {"row": "; ", "cell": " ", "break": "; "}
LEVEL = {"table": "table", "tr": "row", "td": "cell", "th": "cell"}


@dataclass
class Leaf:
    kind: str  # "text", "anchor" or "break"
    value: str = ""


@dataclass
class Branch:
    kind: str  # "report", "table", "row" or "cell"
    parts: list[Leaf | Branch] = field(default_factory=list)
    whole: bool = False  # whether its end was marked: what was left open doesn't count

    def of(self, kind: str) -> Iterator[Branch]:
        return (p for p in self.parts if p.kind == kind and p.whole)

    def leaves(self) -> Iterator[Leaf]:
        for p in self.parts:
            if isinstance(p, Branch):
                yield Leaf(p.kind)
                yield from p.leaves()
            else:
                yield p


class TreeReader(HTMLParser):
    """Builds the tree; a row or a cell outside a table is none, and a new one ends what was open beside it."""

    def __init__(self) -> None:
        super().__init__()
        self.path = [Branch("report")]

    def _within_table(self, kinds: tuple[str, ...]) -> int | None:
        """Place in the path of the outermost open branch of these kinds in the innermost table."""
        at = len(self.path)
        found = None
        while at > 1 and self.path[at - 1].kind != "table":
            at -= 1
            if self.path[at].kind in kinds:
                found = at
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.path[-1].parts.append(Leaf("anchor", dict(attrs).get("name") or ""))
        elif tag == "br":
            self.path[-1].parts.append(Leaf("break"))
        if (kind := LEVEL.get(tag)) is None or (kind != "table" and len(self.path) == 1):
            return
        if kind != "table" and (open_ := self._within_table(("row", "cell") if kind == "row" else ("cell",))) is not None:
            del self.path[open_:]
        branch = Branch(kind)
        self.path[-1].parts.append(branch)
        self.path.append(branch)

    def handle_endtag(self, tag: str) -> None:
        kind = LEVEL.get(tag)
        if kind == "table":
            at = max((i for i, b in enumerate(self.path) if b.kind == "table"), default=None)
        else:
            at = self._within_table((kind,)) if kind else None
        if at is not None:
            self.path[at].whole = True
            del self.path[at:]

    def handle_data(self, data: str) -> None:
        self.path[-1].parts.append(Leaf("text", data))


def cell_text(cell: Branch) -> str:
    """All text of a cell on one line; tables within it are flattened, a separator standing only behind text."""
    said = ""
    for leaf in cell.leaves():
        if leaf.kind == "text":
            said += leaf.value
        elif leaf.kind == "break" or (leaf.kind in BETWEEN and said.strip()):
            said += BETWEEN[leaf.kind]
    return " ".join(said.split())


def sections(html: str) -> Iterator[tuple[str, list[list[str]]]]:
    """(anchor, rows with a filled cell) of each outermost table that an anchor names and that has LEAST_ROWS of them."""
    reader = TreeReader()
    reader.feed(html)
    reader.close()
    anchor = ""
    for part in reader.path[0].parts:
        if part.kind == "anchor":
            anchor = part.value or anchor
        elif part.kind == "table":
            anchor = next((x.value for x in reversed(list(part.leaves())) if x.kind == "anchor" and x.value), anchor)
            rows = [r for r in ([cell_text(c) for c in row.of("cell")] for row in part.of("row")) if any(r)]
            if part.whole:
                if anchor and len(rows) >= LEAST_ROWS:
                    yield anchor, rows
                anchor = ""


def subdivision_number(value: str) -> str:
    """The value's digits, filled up with zeros; the trimmed value if it has none."""
    return "".join(c for c in value if c.isdecimal()).zfill(ID_DIGITS) if any(map(str.isdecimal, value)) else value.strip()


def report_id(html: str, stem: str) -> str:
    """The number in the body, else in the title, else in the file's name, else that name."""
    found = (pattern.search(where) for pattern, where in ((BODY_ID, html), (TITLE_ID, html), (STEM_ID, stem)))
    return next((subdivision_number(m.group(1)) for m in found if m), stem)


def units(html: str, stem: str) -> list[tuple]:
    """(text, unit_type, locator, extra) of each section."""
    number, named = report_id(html, stem), NAME.search(html)
    title = named.group(1).strip() if named else None
    above = f"{number} {title or ''}".strip()

    def unit(place: int, anchor: str, rows: list[list[str]]) -> tuple:
        where = {"section_path": f"{above} > {anchor}", "table_title": anchor, "table": place, "subdivision": number}
        return "\n".join(map(" | ".join, rows)), "table", where | ({"subdivision_name": title} if title else {}), {}

    return [unit(k, *s) for k, s in enumerate(sections(html), start=1)]
