"""Embedders: a protocol, a deterministic default, and embedding each distinct text once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .text import KEYWORD


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedTokens:
    """Unit vectors of signed token hashes: no model, the same on every machine. A text without tokens is the zero vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re

        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for token in re.findall(KEYWORD.removeprefix("(?U)"), text.lower()):
                h = zlib.crc32(token.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm < 1e-12, 1, norm)).tolist()


def embedded(df: DataFrame, text_col: str, embedder: Embedder, vec_col: str = "embedding") -> DataFrame:
    """df with the vector of each row's text; equal texts are embedded once and joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({text_col: batch[text_col], vec_col: embedder.embed(batch[text_col].tolist())})

    distinct = df.select(text_col).where(f"`{text_col}` is not null").distinct()
    return df.join(distinct.mapInPandas(run, f"`{text_col}` string, `{vec_col}` array<float>"), text_col, "left")
