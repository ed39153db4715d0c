"""Paged documents: from a table of words and a table of tables to units.

No library that parses PDF files is part of this engine: a PageReader gives a file's words and tables,
or both tables come from elsewhere. All that follows is windows and joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import layout

WORDS = "doc string, page int, text string, x0 double, x1 double, top double, bottom double, size double, bold boolean"
TABLES = "doc string, page int, x0 double, top double, x1 double, bottom double, cells array<array<string>>"


class PageReader(Protocol):
    """read(content) -> words (page, text, x0, x1, top, bottom, size, bold) and tables (page, x0, top, x1, bottom, cells)."""

    def read(self, content: bytes) -> tuple[list[tuple], list[tuple]]: ...


def read_pages(files: DataFrame, reader: PageReader) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, tables, errors) of files(source_path, content); a file that can't be read is a row (source_path, error)."""
    columns = ["source_path", "error", "word", "table"]
    word, table = ("struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in kinds.split(", ")[1:]) + ">" for kinds in (WORDS, TABLES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [[f.split()[0] for f in kinds.split(", ")[1:]] for kinds in (WORDS, TABLES)]
        for batch in batches:
            for path, content in zip(batch["source_path"], batch["content"]):
                try:
                    words, tables = reader.read(bytes(content))
                except Exception as e:  # noqa: BLE001  one file's failure is a row, not the job's end
                    yield pd.DataFrame([(path, f"{type(e).__name__}: {e}", None, None)], columns=columns)
                    continue
                rows = [(path, None, dict(zip(names[0], w)), None) for w in words] + [(path, None, None, dict(zip(names[1], t))) for t in tables]
                yield pd.DataFrame(rows, columns=columns)

    read = files.select("source_path", "content").mapInPandas(run, f"source_path string, error string, word {word}, table {table}").persist()
    doc = F.col("source_path").alias("doc")
    return (
        read.where("word is not null").select(doc, "word.*"),
        read.where("table is not null").select(doc, "table.*"),
        read.where("error is not null").select("source_path", "error"),
    )


def page_units(words: DataFrame, tables: DataFrame, heading_ratio: float = layout.HEADING_RATIO, table_share: float = layout.REPEAT_SHARE) -> DataFrame:
    """Units (source_path, unit_ix, text, unit_type, locator, extra, error) of words(WORDS), or pages of words, and tables(TABLES).

    Tables that don't look like one go; words within a table are its own; lines and tables that most
    pages repeat go; headings cut the rest into sections.
    """
    real = tables.where(layout.looks_tabular(F.col("cells"))).withColumn("text", layout.table_text(F.col("cells")))
    lines = layout.group_lines(layout.outside_tables(layout.paged(words), real)).where(strip(F.col("text")) != "")
    lines = layout.without_repeats_within(lines, share=layout.REPEAT_SHARE, least_pages=3)
    kept = layout.without_repeats_within(real, share=table_share)
    units = layout.section_units(layout.classify_headings(lines, heading_ratio), kept)
    pairs = {"page": F.col("page").cast("string"), "section_path": F.nullif(F.col("section_path"), F.lit("")), "table": F.col("table").cast("string"), "table_title": F.nullif(F.col("table_title"), F.lit(""))}
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items())), lambda e: e["value"].isNotNull())
    return units.select(
        F.col("doc").alias("source_path"), (F.col("unit") - 1).cast("int").alias("unit_ix"), "text", "unit_type",
        F.map_from_entries(entries).alias("locator"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("extra"), F.lit(None).cast("string").alias("error"),
    )
