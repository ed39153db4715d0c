"""From raw documents to packed sequences: quality classifier, quality rules, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on whole texts; all but the last give back rows of
documents with their columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import packing, quality, rules, simhash
from lodestack.llm.common import picked, written

#: Similarity of five-word shingles at which documents count as copies, and the share of SimHash bits
#: in which two such documents agree on average: 1 - acos(2 * 0.8 / 1.8) / pi.
SIMILARITY, AGREE = 0.8, 0.85
#: Of 256 bits; 38.6 differ on average at that similarity, by a spread of 5.7. Only for candidates.
RADIUS = 62


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts (score of 0.3 or more).

    It learns from labels of rows whose crc32(doc_id) mod 5 is not 0. Null and empty texts are scored
    like any other; other columns pass through.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold)
    return docs.where(quality.scorer(model)("text") >= 0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every rule of the cascade; other columns pass through. Null and empty texts go."""
    return docs.where(rules.first_failed(docs).isNull())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by pairs of SIMILARITY or more the one with the smallest id; other columns pass through.

    Rows are told apart by id and text, so that texts with no id or the same one are judged each by
    itself; null ids come last. Of rows alike in both, one stays. Texts without words are alike.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.withColumn("__row", own)
    found = simhash.similar_documents(keyed, shingle=5, words=4, radius=RADIUS, agree=AGREE, least=SIMILARITY, id_col="__row")
    keys = found.groupBy("__row").agg(F.max(F.col("__row") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    keys = written(keys, "keys")
    kept = picked(keyed, written(keys.where("not stays").select("__row"), "gone"), "__row", "left_anti")
    again = written(keys.where("stays and n > 1").select("__row"), "again")
    if not again.isEmpty():
        kept = picked(kept, again, "__row", "left_anti").unionByName(picked(kept, again, "__row").dropDuplicates(["__row"]))
    return kept.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 4,096 tokens and its offset there."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("packing", pack)]

#: Models, fingerprints and tokens can't be had in SQL; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
