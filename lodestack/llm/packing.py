"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: a bin of class i holds i pieces of capacity // i
tokens. A document is cut greedily: the largest class piece that fits, then the rest again, until a
tail under capacity / 64 is left, whose class is that of its own length. As all pieces of a class are
equally long, a bin's count is fixed, bins fill independently of all others, and a piece's sequence
and offset follow from its number within the class. What is left in the last, unfilled bin of each
class (fewer pieces than one bin holds, whatever the corpus' size) is packed first-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import numbered, trimmed, written

#: Classes whose pieces are cut to a share of the capacity; shorter rests stay whole.
CUT_CLASSES = 64


def cut_lengths(n: int, capacity: int, classes: int = CUT_CLASSES) -> list[int]:
    """The lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        i = -(-capacity // rest)
        piece = capacity // i if i <= classes else rest
        out.append(piece)
        rest -= piece
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) for every piece; a null text is an empty one."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(kept: bpe.PackedTexts, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, which, whole = [], [], []
        for k, ids in enumerate(kept.of_texts(t.as_py() for t in batch.column(1))):
            data = ids + end
            n, at = len(data) // 4, 0
            for length in cut_lengths(n, capacity):
                part = data[4 * at : 4 * (at + length)]
                rows.append((at, length, zlib.crc32(part), n))
                which.append(k)
                if with_ids:
                    whole.append(np.frombuffer(part, "<u4").tolist())
                at += length
        cols = zip(*rows) if rows else [()] * 4
        arrays = [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            arrays.append(pa.array(whole, pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = bpe.packed_ids(path)
        yield from (cut(kept, batch) for batch in batches)
        kept.forget()  # the worker lives on, idle or in other stages
        trimmed()

    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "idx"], ascending=[False, True], kind="stable").reset_index(drop=True)
    used: list[int] = []
    bins, offsets = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    at = 0
    for length, n in rows["length"].value_counts(sort=False).sort_index(ascending=False).items():
        k = 0
        while n:  # equal lengths fill one bin after the other
            if k == len(used):
                used.append(0)
            fit = min(n, (capacity - used[k]) // length)
            bins[at : at + fit] = k
            offsets[at : at + fit] = used[k] + length * np.arange(fit)
            used[k] += fit * length
            at, n, k = at + fit, n - fit, k + 1
    return rows.assign(sequence_id=rows["base"] + bins, offset=offsets)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A null or empty text is the end token alone. Rows with the same id are documents of their own.
    Sequence numbers are gapless from 0. An empty table gives none. Other columns are ignored. A reader
    pads each sequence to the capacity. Ties: pieces of one length are placed by a hash of (id, start,
    checksum), the same in every run.
    """
    laid = written(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    idx = numbered(laid, ["length"], [id_col, "start", "ids_crc32"], "idx", laid.count())
    one = Window.orderBy(F.desc("length"))  # a row a length: under 130
    held = (F.lit(capacity) / F.col("length")).cast("long")
    full = laid.groupBy("length").agg(F.count(F.lit(1)).alias("n")).withColumn("held", held).withColumn("full", (F.col("n") / F.col("held")).cast("long"))
    full = full.withColumn("first", F.sum("full").over(one) - F.col("full")).withColumn("base", F.sum("full").over(Window.partitionBy()))
    placed = idx.join(F.broadcast(full), "length")
    cols = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    inside = F.col("idx") < F.col("full") * F.col("held")
    main = placed.where(inside).withColumn("sequence_id", F.col("first") + F.floor(F.col("idx") / F.col("held"))).withColumn("offset", F.pmod("idx", "held") * F.col("length")).select(cols)
    rest = placed.where(~inside).select(*[c for c in cols if c not in ("sequence_id", "offset")], "idx", "base")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in main.schema)
    return main.unionByName(rest.groupBy((F.col("base") * 0).alias("zero")).applyInPandas(lambda pdf: _first_fit(pdf, capacity)[cols], schema))
