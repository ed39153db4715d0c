"""Reading JSON from model output that has prose, fences or a missing end around it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import choose, strip

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
#: A string literal (possibly unended) or a bracket.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.S)

# Allowed values; and the datasheet's columns in order.
TEST_TYPES = ("Positive", "Negative")
YES_NO = ("Yes", "No")
TRUE_FALSE = ("True", "False")
TECHNIQUES = ("Equivalence Partitioning", "Boundary Value Analysis", "Decision Table", "State Transition", "Error Guessing")
DATASHEET = ("S_no", "Requirement", "Description", "Folder", "Optimization_Technique", "Test_Type", "Test_Technique", "Retired?", "Scorable", "Comments")


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def tolerant(raw: str | None) -> str | None:
    """JSON text of the first object in raw, mended if it was cut off; null if there is none."""
    text = (raw or "").strip()
    if fence := FENCE.search(text):
        text = fence[1].strip()
    if (got := _parsed(text)) is not None:
        return json.dumps(got)
    begin = text.find("{")
    if begin < 0:
        return None
    text = text[begin:]
    open_, good, end = [], None, None
    for m in _MARKS.finditer(text):
        c = m[0]
        if c in "{[":
            open_.append("]" if c == "[" else "}")
        elif c in "}]":
            if open_:
                open_.pop()
            good = (m.end(), "".join(reversed(open_)))  # a value was completed here
            if c == "}" and not open_:
                end = m.end()
                break
    if end and (got := _parsed(text[:end])) is not None:
        return json.dumps(got)
    if good:
        got = _parsed(text[: good[0]].rstrip().rstrip(",") + good[1])
        if isinstance(got, dict):
            return json.dumps(got)
    return None


@F.pandas_udf(StringType())
def _tolerant(raw: pd.Series) -> pd.Series:
    return raw.map(tolerant)


def tolerant_json(raw: Column) -> Column:
    """The native parser decides where it can; only what it refuses is sent to the scanner, which gets nulls of all others."""
    text = strip(raw)
    native = F.coalesce(F.try_parse_json(text).isNotNull() & F.startswith(text, F.lit("{")), F.lit(False))
    return F.when(native, text).otherwise(_tolerant(F.when(~native, raw)))


def _text(value: Column) -> Column:
    """A VARIANT as text: lists as lines of their non-blank members, null as empty."""
    lines = F.filter(F.transform(F.try_variant_get(value, "$", "array<string>"), strip), lambda x: x != "")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_join(lines, "\n")).otherwise(strip(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))))


def parse_cases(df: DataFrame, raw: str, requirement: Column, folder: Column) -> DataFrame:
    """df's columns and a row (s_no, requirement, description, ...) for every usable case of its output.

    Members that aren't objects or have no description are dropped and numbers are dense; output
    without a usable case gives no row.
    """
    keys = [f"`{c}`" for c in df.columns]
    cases = df.withColumn("__v", F.try_parse_json(tolerant_json(F.col(raw))))
    cases = cases.select(*keys, F.posexplode(F.try_variant_get("__v", "$.test_cases", "array<variant>")).alias("__i", "__c")).where(F.schema_of_variant("__c").startswith("OBJECT"))
    get = lambda name: _text(F.try_variant_get("__c", f"$.{name}", "variant"))
    out = cases.select(
        *keys, "__i", requirement.alias("requirement"), get("description").alias("description"), F.coalesce(F.nullif(get("folder"), F.lit("")), folder).alias("folder"),
        F.coalesce(F.nullif(get("optimization_technique"), F.lit("")), F.lit("Default")).alias("optimization_technique"), choose(get("test_type"), TEST_TYPES, "Positive").alias("test_type"),
        choose(get("test_technique"), TECHNIQUES, "Equivalence Partitioning").alias("test_technique"), choose(get("retired"), TRUE_FALSE, "False").alias("retired"), choose(get("scorable"), YES_NO, "Yes").alias("scorable"), get("comments").alias("comments"),
    ).where(F.coalesce(F.col("description"), F.lit("")) != "")
    return out.withColumn("s_no", F.row_number().over(Window.partitionBy(*keys).orderBy("__i"))).drop("__i")
