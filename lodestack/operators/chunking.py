"""Chunking under token budgets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, strip, words

_BLANK_LINE = re.compile(r"\n\s*\n")
#: Characters of texts whose chunks a Python worker holds before it gives them out.
CHARS_AT_ONCE = 1 << 21
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?U)\n\s*\n"), lambda p: strip(p) != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def hard_split(text: Column, budget: int) -> Column:
    """Words in groups of `budget`: what packing word by word comes to when a word is a token. The text is split once."""

    def groups(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(w), F.lit(1)) - 1) / budget).cast("int"))
        return F.filter(F.transform(starts, lambda g: F.array_join(F.slice(w, g * budget + 1, F.lit(budget)), " ")), lambda c: c != "")

    return bound(words(text), groups)


def _count(text: str) -> int:
    return len(text.split())


def _groups_of_words(text: str, budget: int) -> list[str]:
    w = text.split()
    return [" ".join(w[k : k + budget]) for k in range(0, len(w), budget)]


def pack(pieces: list[str], budget: int, overlap: int, joiner: str) -> list[str]:
    """Greedy fold of pieces into chunks.

    A piece over the budget closes the chunk, is split by words and leaves no overlap behind. The overlap
    taken over is the longest tail within its own budget, but a piece at least, and the chunk's budget is
    not checked again after it: a chunk may come near twice the budget.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for piece in pieces:
        n = _count(piece)
        total = sum(x for _, x in held)
        if n > budget:
            if held:
                out.append(joiner.join(p for p, _ in held))
            held = []
            out += _groups_of_words(piece, budget)
            continue
        if held and total + n > budget:
            out.append(joiner.join(p for p, _ in held))
            tail, size = [], 0
            for p in reversed(held if overlap > 0 else []):
                if tail and size + p[1] > overlap:
                    break
                tail.append(p)
                size += p[1]
            held = tail[::-1]
        held.append((piece, n))
    if held:
        out.append(joiner.join(p for p, _ in held))
    return out


def prose_chunks(text: str, budget: int, overlap: int) -> list[str]:
    pieces: list[str] = []
    for paragraph in filter(str.strip, _BLANK_LINE.split(text.strip())):
        pieces += [s for s in _SENTENCE_END.split(paragraph.strip()) if s] if _count(paragraph) > budget else [paragraph]
    return pack(pieces, budget, overlap, "\n\n")


def line_chunks(text: str, budget: int) -> list[str]:
    """Whole if it fits; else lines under a repeated first line, a line too long for the budget standing alone."""
    if _count(text) <= budget:
        return [text] if text.strip() else []
    header, *body = text.splitlines()
    first, out, held, size = _count(header), [], [], 0
    for line in body:
        n = _count(line)
        if held and first + size + n > budget:
            out.append("\n".join([header, *held]))
            held, size = [], 0
        held.append(line)
        size += n
    if held:
        out.append("\n".join([header, *held]))
    return out or [header]


def row_chunks(rows: list[tuple[int, str]], budget: int, cap: int) -> list[tuple[str, int, int]]:
    """(text, first row, last row) of runs of rows within the budget and the cap; a row over the budget is split by words."""
    out: list[tuple[str, int, int]] = []
    held: list[tuple[int, str, int]] = []

    def close() -> None:
        if held:
            out.append(("\n".join(t for _, t, _ in held), held[0][0], held[-1][0]))
            held.clear()

    for no, text in rows:
        n = _count(text)
        if n > budget:
            close()
            out.extend((part, no, no) for part in _groups_of_words(text, budget))
            continue
        if held and (sum(x for *_, x in held) + n > budget or len(held) >= cap):
            close()
        held.append((no, text, n))
    close()
    return out


def exploded(df: DataFrame, key: str, text: str, make: Callable[[str], list[str]]) -> DataFrame:
    """(key, chunk_index, chunk) by a Python fold over each row's text; rows are folded where they stand."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for k, t in zip(batch[key], batch[text]):
                rows += [(k, i, c) for i, c in enumerate(make(t or ""))]
                size += len(t or "")
                if size > CHARS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_index int, chunk string")


def chunk_text(df: DataFrame, key: str, text: str, budget: int = 512, overlap: int = 50) -> DataFrame:
    return exploded(df, key, text, lambda t: prose_chunks(t, budget, overlap))


def chunk_lines(df: DataFrame, key: str, text: str, budget: int = 512) -> DataFrame:
    return exploded(df, key, text, lambda t: line_chunks(t, budget))


def chunk_rows(df: DataFrame, sheet: list[str], row: str, text: str, budget: int = 512, cap: int = 1) -> DataFrame:
    """(sheet columns, chunk_index, chunk, row_start, row_end). With a cap of 1 each row makes its own, without Python."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in sheet)
    schema = f"{kinds}, chunk_index int, chunk string, row_start int, row_end int"
    if cap == 1:
        split = df.select(*sheet, F.col(row).alias("r"), F.posexplode(F.when(F.size(words(F.col(text))) > budget, hard_split(F.col(text), budget)).otherwise(F.array(F.col(text)))).alias("i", "chunk"))
        place = F.row_number().over(Window.partitionBy(*sheet).orderBy("r", "i")) - 1
        return split.select(*sheet, place.alias("chunk_index"), "chunk", F.col("r").cast("int").alias("row_start"), F.col("r").cast("int").alias("row_end"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, kind="stable")
        made = row_chunks(list(zip(pdf[row], pdf[text])), budget, cap)
        out = pd.DataFrame([(i, *c) for i, c in enumerate(made)], columns=["chunk_index", "chunk", "row_start", "row_end"])
        for c in reversed(sheet):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return df.select(*sheet, row, text).groupBy(*sheet).applyInPandas(run, schema)
