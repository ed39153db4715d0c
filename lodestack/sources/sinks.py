"""Where results go: datasheets, scripts, Parquet and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.llm_json import DATASHEET
from .spreadsheet import workbook

# Columns of the export beside the datasheet's, and column widths.
CONFIDENCE = ("Confidence", "Retrieval", "Grounding", "Similarity", "Closest existing", "Needs review")
WIDTHS = [6, 16, 80, 22, 22, 12, 26, 10, 10, 40]
FIELDS = ("s_no", "requirement", "description", "folder", "optimization_technique", "test_type", "test_technique", "retired", "scorable", "comments")
SCORES = ("overall", "retrieval", "grounding", "similarity", "closest", "needs_review")


def datasheet(cases: DataFrame) -> DataFrame:
    """The datasheet's columns in their order, and the confidence columns that cases have."""
    own = [F.col(f).alias(label) for f, label in zip(FIELDS, DATASHEET)]
    return cases.select(*own, *(F.col(f).alias(label) for f, label in zip(SCORES, CONFIDENCE) if f in cases.columns))


def to_workbook(cases: DataFrame, title: str = "Test cases") -> bytes:
    """An .xlsx of one requirement's cases, by number: a result that a model's output bounds."""
    sheet = datasheet(cases)
    rows = [list(r) for r in sheet.orderBy("S_no").toLocalIterator()]
    return workbook(sheet.columns, rows, title, WIDTHS + [14] * (len(sheet.columns) - len(WIDTHS)))


def script_bytes(script: str, requirement: str | None, stamp: str) -> bytes:
    head = f"# Requirement: {requirement or 'unknown'}\n# Generated: {stamp}\n\n"
    return (head + script).replace("\r\n", "\n").replace("\n", "\r\n").encode()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
