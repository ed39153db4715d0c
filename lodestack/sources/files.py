"""Discovering files and dispatching them to readers that make units."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import requirement_id, strip
from . import html_report, python_source, spreadsheet

#: Columns of a unit; the struct fields that a reader doesn't have are null.
UNIT = "source_path string, unit_ix int, text string, unit_type string, locator map<string,string>, extra map<string,string>, error string"
READERS = {".xlsx": "spreadsheet", ".xlsm": "spreadsheet", ".py": "python", ".pyi": "python", ".txt": "text", ".html": "html", ".htm": "html"}
# What may be uploaded, and how long it may be.
UPLOADS, UPLOAD_BYTES = (".txt", ".md"), 2 << 20
PYTHON_MARKERS = ("import ", "def ", "class ", "elif ", "self.")


def parsed(text: str):
    """What JSON text holds, or YAML where a parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # optional

        return yaml.safe_load(text)


@dataclass(frozen=True)
class Root:
    path: str
    document_type: str
    subfolders_as_type: bool = False


@dataclass
class Config:
    """Settings of an ingestion; a key that isn't one is an error."""

    sources: list[Root] = field(default_factory=list)
    static_sources: list[Root] = field(default_factory=list)
    examples_dir: str = ""
    base: str = ""
    chunk_max_tokens: int = 512
    chunk_overlap_tokens: int = 50
    max_rows_per_chunk: int = 1
    heading_size_ratio: float = 1.15
    table_repeat_threshold: float = 0.5
    embedding_model: str = "hashed-tokens"

    @classmethod
    def load(cls, text: str) -> Config:
        """From JSON text, or YAML where a parser is installed."""
        raw = parsed(text)
        unknown = set(raw) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if not raw.get("sources"):
            raise ValueError("no sources are configured")
        return cls(**raw | {k: [Root(**s) for s in raw.get(k) or []] for k in ("sources", "static_sources")})


def source_path(path: Column, root: Root, base: str) -> Column:
    """The path below base, or else document_type/path below the root."""
    rel = F.regexp_replace(path, r"^file:/+", "/")
    below = rel.substr(F.lit(len(base.rstrip("/")) + 2), F.length(rel))
    in_root = F.concat(F.lit(f"{root.document_type}/"), rel.substr(F.lit(len(root.path.rstrip("/")) + 2), F.length(rel)))
    return F.when(F.startswith(rel, F.lit(base.rstrip("/") + "/")) & F.lit(base != ""), below).otherwise(in_root)


def document_type(path: Column, root: Root) -> Column:
    rel = F.regexp_replace(path, r"^file:/+", "/").substr(F.lit(len(root.path.rstrip("/")) + 2), F.length(path))
    parts = F.split(rel, "/")
    return F.when(F.lit(root.subfolders_as_type) & (F.size(parts) > 1), parts[0]).otherwise(F.lit(root.document_type))


def glob_of(suffixes: tuple[str, ...]) -> str:
    """A path filter for files of these suffixes in any case, so that others aren't opened."""
    return "*{" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ",".join(suffixes)) + "}"


def discover(spark: SparkSession, config: Config, more: tuple[str, ...] = ()) -> DataFrame:
    """(source_path, source_file, document_type, suffix, file_hash, content) of every readable file below the roots.

    more: suffixes to take beside the readers' own. Lock files (`~$`) and other suffixes are left out
    before a file is opened; a root that isn't there gives nothing.
    """
    wanted, out = (*READERS, *more), None
    for root in config.sources:
        p = spark._jvm.org.apache.hadoop.fs.Path(root.path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            continue
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob_of(wanted)).load(root.path)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
        part = raw.where(suffix.isin(*wanted) & ~F.startswith(name, F.lit("~$")))
        part = part.select(source_path(F.col("path"), root, config.base).alias("source_path"), name.alias("source_file"), document_type(F.col("path"), root).alias("document_type"), suffix.alias("suffix"), F.sha2("content", 256).alias("file_hash"), "content")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "source_path string, source_file string, document_type string, suffix string, file_hash string, content binary")
    return out


def uploaded(files: DataFrame) -> DataFrame:
    """files(filename, content) -> (filename, requirement_text, requirement_id, error) of uploaded requirements.

    Plain text of at most 2 MiB that isn't blank; bytes that aren't UTF-8 are replaced. What is refused has an error and no text.
    """
    text = strip(F.make_valid_utf8(F.col("content").cast("string")))
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    error = F.when(~suffix.isin(*UPLOADS), F.concat(F.lit("not plain text: "), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("no extension"))))
    error = error.when(F.octet_length("content") > UPLOAD_BYTES, F.lit("larger than 2 MB")).when(text == "", F.lit("empty"))
    checked = files.select("filename", F.when(error.isNull(), text).alias("requirement_text"), error.alias("error"))
    return checked.select("filename", "requirement_text", requirement_id(F.col("requirement_text")).alias("requirement_id"), "error")


def looks_like_python(text: str) -> bool:
    if sum(m in text for m in PYTHON_MARKERS) < 2:
        return False
    try:
        compile(text, "<text>", "exec", flags=0x400, dont_inherit=True)  # parse only
    except (SyntaxError, ValueError):
        return False
    return True


def text_units(text: str) -> list[tuple]:
    if not text.strip():
        return []
    return python_source.units(text) if looks_like_python(text) else [(text, "text", {}, {})]


def read_units(path: str, suffix: str, content: bytes) -> list[tuple]:
    """(text, unit_type, locator, extra) of one file."""
    kind = READERS[suffix]
    if kind == "spreadsheet":
        return spreadsheet.units(content)
    text = bytes(content).decode("utf-8", "replace")
    if kind == "python":
        return python_source.units(text)
    if kind == "html":
        return html_report.units(text, path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return text_units(text)


def extract(files: DataFrame) -> DataFrame:
    """Units of files(source_path, suffix, content); a file that can't be read gives one row with the error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source_path", "unit_ix", "text", "unit_type", "locator", "extra", "error"]
        for batch in batches:
            rows = []
            for path, suffix, content in zip(batch["source_path"], batch["suffix"], batch["content"]):
                try:
                    found = read_units(path, suffix, content)
                    rows += [(path, i, t, kind, {k: str(v) for k, v in loc.items() if v is not None}, {k: str(v) for k, v in more.items() if v is not None}, None) for i, (t, kind, loc, more) in enumerate(found)]
                except Exception as e:  # noqa: BLE001  one file's failure is a row, not the job's end
                    rows.append((path, 0, None, None, {}, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=columns)

    # small files lie in few partitions, but take long to read: they are dealt out first, by a number, or else they would be put together again
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("source_path", "suffix", "content").repartition(parts, "source_path").mapInPandas(run, UNIT)
