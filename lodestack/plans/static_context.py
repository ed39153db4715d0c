"""Context that is searched by keywords but never embedded, and worked examples for prompts."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import budgeted, strip
from ..operators import search
from ..sources import files

# Types of the joint corpus, folders of the examples, and the least share of one example.
API_TYPE, TRACK_TYPE = "python_apis", "track_data"
EXAMPLE_PARTS = {"requirement": ("", ".txt"), "test_cases": ("reference_test_cases", ".xlsx"), "script": ("reference_test_scripts", ".txt")}
LABELS = {"test_cases": "Reference test case(s)", "script": "Reference script"}
LEAST_SHARE = 200


class StaticContext:
    """BM25 over one joint corpus of static chunks; a search takes its type after scoring, so statistics are of all of them."""

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks
        self.index = search.KeywordIndex.build(chunks, "chunk_id", "text").kept()

    @classmethod
    def scan(cls, spark: SparkSession, config: files.Config) -> StaticContext:
        """Chunks of the static sources by the same readers as others; files that can't be read are left out."""
        from .engine import chunks_of

        found = files.discover(spark, dataclasses.replace(config, sources=config.static_sources))
        return cls(chunks_of(files.extract(found), found, config))

    def context(self, query: str, k: int, doc_type: str) -> str:
        if k <= 0:
            return ""
        allowed = self.chunks.where(F.col("document_type") == doc_type).select(F.col("chunk_id").alias("id"))
        hits = search.ranked(self.index.search(query, k, allowed), "score", "position").withColumnRenamed("id", "chunk_id")
        return search.format_hits(hits.join(self.chunks, "chunk_id")).first()["context"]

    def api(self, query: str, k: int) -> str:
        return self.context(query, k, API_TYPE)

    def track(self, query: str, k: int) -> str:
        return self.context(query, k, TRACK_TYPE)


def example_key(stem: Column) -> Column:
    return F.upper(strip(F.split(stem, "_", 2)[0]))


def keyed_examples(parts: DataFrame) -> DataFrame:
    """parts(kind, file, text) -> (key, requirement, test_cases, script): by key of the file's name, "" where a key lacks a kind.

    Of several files of a kind and key, the last by name counts.
    """
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    last = parts.groupBy("kind", example_key(stem).alias("key")).agg(F.max_by("text", "file").alias("text"))
    out = None
    for kind in EXAMPLE_PARTS:
        one = last.where(F.col("kind") == kind).select("key", F.col("text").alias(kind))
        out = one if out is None else out.join(one, "key", "full")
    return out.select("key", *(F.coalesce(F.col(k), F.lit("")).alias(k) for k in EXAMPLE_PARTS))


def scan_examples(spark: SparkSession, folder: str, config: files.Config) -> DataFrame:
    """Examples below a folder: requirements as .txt in it, reference cases and scripts in folders of their own; none without it."""
    from .engine import normalized

    parts = None
    for kind, (below, suffix) in EXAMPLE_PARTS.items() if folder else ():
        path = f"{folder.rstrip('/')}/{below}".rstrip("/")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            continue
        raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        units = normalized(files.extract(raw.select(name.alias("source_path"), F.lit(suffix).alias("suffix"), "content")))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_ix", strip(F.col("text")).alias("t")))), lambda u: u["t"]), "\n\n")
        part = units.groupBy(F.col("source_path").alias("file")).agg(joined.alias("text")).withColumn("kind", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], "kind string, file string, text string")
    return keyed_examples(parts)


def example_blocks(examples: DataFrame, kind: str, budget: int) -> DataFrame:
    """(key, block) of the examples that have the kind: all share the budget equally, a requirement gets a quarter of a share."""
    usable = examples.where(strip(F.col(kind)) != "") if budget > 0 else examples.limit(0)
    n = usable.agg(F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.lit(LEAST_SHARE), F.floor(F.lit(budget) / F.col("n")))
    asked = F.when(F.col("requirement") != "", F.concat(F.lit("Requirement:\n"), budgeted(F.col("requirement"), F.floor(share / 4))))
    shown = F.concat(F.lit(f"{LABELS[kind]}:\n"), budgeted(F.col(kind), share))
    return usable.join(F.broadcast(n)).select("key", F.concat_ws("\n\n", F.concat(F.lit("### Example: "), F.col("key")), asked, shown).alias("block"))  # n: one row


def render_examples(examples: DataFrame, kind: str, budget: int) -> str:
    """The blocks in order of their keys, as one text of about the budget; "" without any."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "block"))), lambda x: x["block"]), search.CONTEXT_SEPARATOR)
    return example_blocks(examples, kind, budget).agg(joined.alias("text")).first()["text"]
