"""The engine: ingesting sources, retrieving context, generating and scoring rows."""

from __future__ import annotations

import dataclasses
import os
import string
import threading
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import llm_json, text
from ..functions.cache import RecentResults
from ..functions.embedding import Embedder, HashedTokens, embedded
from ..operators import chunking, incremental, scoring, search
from ..sources import files, pages
from .static_context import StaticContext, render_examples


class LLMClient(Protocol):
    def generate(self, system_prompt: str, user_prompt: str, max_tokens: int | None = None, num_ctx: int | None = None) -> str: ...


@dataclasses.dataclass
class RetrievalSettings:
    """Effective settings of retrieval and scoring; a key that isn't one is an error."""

    top_k: int = 8
    candidates_per_arm: int = 30
    dense_weight: float = 1.0
    keyword_weight: float = 0.6
    rrf_k: int = 60
    min_similarity: float = 0.0
    max_context_chars: int = 7000
    doc_types: list[str] = dataclasses.field(default_factory=list)
    track_doc_type: str = "track_data"
    track_top_k: int = 4
    review_threshold: float = 0.55
    max_test_cases: int = 20
    api_top_k: int = 6
    static_track_top_k: int = 6
    max_example_chars: int = 6000
    cached_queries: int = 32
    concurrent_generations: int = 1

    @classmethod
    def of(cls, **raw) -> RetrievalSettings:
        unknown = set(raw) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**raw)


class Prompts:
    """Named templates with $names; a missing template or name is an error."""

    def __init__(self, templates: dict[str, str] | None = None):
        self._templates = templates or {}

    @property
    def templates(self) -> dict[str, str]:
        return self._templates

    def render(self, name: str, **values: str) -> str:
        templates = self.templates
        if name not in templates:
            raise KeyError(f"no prompt named {name}; there are {', '.join(sorted(templates)) or 'none'}")
        return string.Template(templates[name]).substitute(values)

    def pair(self, name: str, **values: str) -> tuple[str, str]:
        """(system, user): a prompt's own system text, or the one that all share."""
        return self.render(f"{name}.system" if f"{name}.system" in self.templates else "system").strip(), self.render(name, **values)


class PromptFile(Prompts):
    """Prompts of a JSON file, or YAML where a parser is installed: {name: {system, user}}; read again when the file changes."""

    def __init__(self, path: str, watch: bool = True):
        super().__init__()
        self.path, self.watch, self.seen = path, watch, None

    @property
    def templates(self) -> dict[str, str]:
        changed = os.stat(self.path).st_mtime_ns
        if self.seen is None or (self.watch and changed != self.seen):
            found = files.parsed(Path(self.path).read_text(encoding="utf-8")) or {}
            made = {}
            for name, pair in found.items():
                for part in ("system", "user"):
                    if not str((pair or {}).get(part) or "").strip():
                        raise ValueError(f"{self.path}: {name} has no {part} text")
                made |= {name: pair["user"], f"{name}.system": pair["system"]}
            self._templates, self.seen = made, changed
        return self._templates


CODE_LIKE = ("function", "class", "table")


def normalized(units: DataFrame) -> DataFrame:
    """Units that could be read, normalised by their type; blank ones are left out."""
    u = units.where("error is null").withColumn("text", text.normalize_unit(F.col("text"), F.col("unit_type")))
    return u.where(text.strip(F.col("text")) != "")


def chunks_of(units: DataFrame, discovered: DataFrame, config: files.Config) -> DataFrame:
    """Units -> chunks with their ids and metadata; rows, code-like and prose units take their own ways.

    Spreadsheet rows are taken together by sheet, up to max_rows_per_chunk; such a chunk's ids are its first row's.
    """
    u = normalized(units)
    is_row, lined = F.col("unit_type") == "test_case", F.col("unit_type").isin(*CODE_LIKE)
    unit_key = F.concat_ws("|", F.transform(F.array_sort(F.map_keys("locator")), lambda k: F.concat(k, F.lit("="), F.col("locator")[k])))
    columns = ["source_path", "unit_key", "unit_type", "locator", "extra", "chunk_index", "chunk", "row_start", "row_end", "total_chunks_in_unit"]

    rows = u.where(is_row).withColumn("sheet", F.coalesce(F.col("locator")["sheet"], F.lit(""))).withColumn("row", F.col("locator")["row"].cast("int"))
    sheet = ["source_path", "sheet"]
    of_rows = chunking.chunk_rows(rows, sheet, "row", "text", config.chunk_max_tokens, config.max_rows_per_chunk)
    of_rows = of_rows.withColumn("total_chunks_in_unit", F.count(F.lit(1)).over(Window.partitionBy(*sheet)).cast("int"))
    first = rows.select(*sheet, F.col("row").alias("row_start"), "unit_type", "extra")
    of_rows = of_rows.join(first, [*sheet, "row_start"]).withColumn("locator", F.create_map(F.lit("sheet"), F.col("sheet"))).withColumn("unit_key", F.concat(F.lit("sheet="), F.col("sheet")))

    other = u.where(~is_row).withColumn("unit_key", unit_key).withColumn("key", F.to_json(F.struct("source_path", "unit_ix")))
    made = chunking.chunk_lines(other.where(lined), "key", "text", config.chunk_max_tokens).unionByName(chunking.chunk_text(other.where(~lined), "key", "text", config.chunk_max_tokens, config.chunk_overlap_tokens))
    total = F.count(F.lit(1)).over(Window.partitionBy("key")).cast("int")
    of_others = made.withColumn("total_chunks_in_unit", total).join(other.drop("text"), "key")
    row = F.col("locator")["row"].cast("int")
    of_others = of_others.withColumn("row_start", row).withColumn("row_end", row)

    out = of_rows.select(columns).unionByName(of_others.select(columns)).join(discovered.select("source_path", "source_file", "document_type", "file_hash"), "source_path")
    loc, more = (lambda k: F.col("locator")[k]), (lambda k: F.col("extra")[k])
    is_code = F.lower("source_file").rlike(r"\.pyi?$")
    return out.select(
        text.chunk_id(F.col("source_path"), F.col("unit_key"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"), "source_path", "source_file", "document_type",
        F.col("unit_type").alias("content_type"), "chunk_index", "total_chunks_in_unit", "file_hash", F.lit(config.embedding_model).alias("embedding_model"), F.current_timestamp().alias("ingested_at"),
        loc("section_path").alias("section_path"), loc("page").cast("int").alias("page"), loc("sheet").alias("sheet"), "row_start", "row_end",
        more("requirement_id").alias("requirement_id"), more("test_case_id").alias("test_case_id"), F.when(is_code, F.regexp_replace("source_file", r"\.[^.]*$", "")).alias("module_name"),
        F.coalesce(loc("class_name"), F.when(F.col("unit_type") == "class", loc("name"))).alias("class_name"), F.when(F.col("unit_type") == "function", loc("name")).alias("method_name"),
        loc("table").cast("int").alias("table_index"), loc("table_title").alias("table_title"), loc("subdivision").alias("subdivision"), F.col("chunk").alias("text"),
    ).dropDuplicates(["chunk_id"])


class Engine:
    """An ingested table with its indexes. Parts are made when first asked for, and kept for the table's version.

    page_reader: reads paged documents (.pdf), which are left out without one. Generations wait for each
    other at the gate.
    """

    def __init__(self, spark: SparkSession, table: str, embedder: Embedder | None = None, settings: RetrievalSettings | None = None, page_reader: pages.PageReader | None = None):
        self.spark, self.store = spark, incremental.VersionedTable(spark, table)
        self.embedder, self.settings, self.page_reader = embedder or HashedTokens(), settings or RetrievalSettings(), page_reader
        self._index: tuple[str, search.KeywordIndex] | None = None
        self.vectors, self.results = RecentResults(4096), RecentResults(self.settings.cached_queries)
        self.gate = threading.BoundedSemaphore(self.settings.concurrent_generations)

    def units(self, work: DataFrame, config: files.Config) -> DataFrame:
        """Units of discovered files; paged ones by way of their words and tables."""
        if self.page_reader is None:
            return files.extract(work)
        words, tables, errors = pages.read_pages(work.where("suffix = '.pdf'"), self.page_reader)
        found = files.extract(work.where("suffix <> '.pdf'")).unionByName(pages.page_units(words, tables, config.heading_size_ratio, config.table_repeat_threshold))
        return found.unionByName(errors, allowMissingColumns=True)

    def ingest(self, config: files.Config, dry_run: bool = False, prune: bool = False, reset: bool = False) -> DataFrame:
        """Bring the chunk table up to date with the sources; returns one row of counters.

        Files that are unchanged under the same settings are skipped; files that fail are counted and
        keep their old chunks. New chunks are made and embedded once, in a folder of their own, and
        counted there. With dry_run nothing is embedded or written.
        """
        print_now = incremental.fingerprint({k: v for k, v in dataclasses.asdict(config).items() if k not in ("sources", "static_sources", "examples_dir", "base")})
        found = files.discover(self.spark, config, () if self.page_reader is None else (".pdf",))
        table = None if reset else self.store.read()
        kinds = "source_path string, file_hash string, pipeline_fingerprint string"
        state = self.spark.createDataFrame([], kinds) if table is None else table.select("source_path", "file_hash", "pipeline_fingerprint").distinct()
        listed = found.select("source_path", "file_hash").persist()
        todo = incremental.changed(listed, state, print_now)
        work = found.join(todo.select("source_path"), "source_path", "left_semi")
        units = self.units(work, config).persist()
        failed = units.where("error is not null").select("source_path").distinct()
        fresh = chunks_of(units, work, config).withColumn("pipeline_fingerprint", F.lit(print_now))
        gone = incremental.vanished(state, listed) if prune else state.select("source_path").limit(0)
        with incremental.staged(self.store, None if dry_run else embedded(fresh, "text", self.embedder)) as made:
            counts = incremental.stats(listed, incremental.unchanged(listed, state, print_now), failed, fresh if made is None else made, gone)
            counts = self.spark.createDataFrame(counts.collect(), counts.schema)  # one row, before the table changes
            if made is not None and (reset or table is None):
                self.store.replace(made)
            elif made is not None:
                self.store.upsert(made, gone)
        units.unpersist()
        listed.unpersist()
        return counts

    def index(self) -> tuple[DataFrame, search.KeywordIndex]:
        """The current table and its keyword index, built anew only when the table's version is another."""
        version, table = self.store.version(), self.store.read()
        if self._index is None or self._index[0] != version:
            if self._index is not None:
                self._index[1].stats.unpersist()
                self.results.clear()
            self._index = (version, search.KeywordIndex.build(table, "chunk_id", "text").kept())
        return table, self._index[1]

    def retrieve(self, query: str, doc_types: list[str] | None = None, top_k: int | None = None) -> DataFrame:
        """Chunks of a general pass and of the track pass in order: (position, pass_ix, chunk_id, score, similarity, bm25_score, matched_by, ...).

        Both passes and both arms of each are one plan, whose stages Spark runs side by side.
        """
        (table, index), key = self.index(), (self.store.version(), query, tuple(doc_types or ()), top_k)
        return self.results.of(key, lambda: self._retrieve(table, index, query, doc_types, top_k))

    def _retrieve(self, table: DataFrame, index: search.KeywordIndex, query: str, doc_types: list[str] | None, top_k: int | None) -> DataFrame:
        s = self.settings
        vector = self.spark.createDataFrame([(self.vectors.of(query, lambda: self.embedder.embed([query])[0]),)], "embedding array<float>")
        wanted = doc_types or s.doc_types or None
        out = []
        for k, where in ((top_k or s.top_k, search.metadata_filter(F.col("document_type"), wanted, s.track_doc_type)), (s.track_top_k, search.metadata_filter(F.col("document_type"), [s.track_doc_type]))):
            part, depth = table.where(where), max(k, s.candidates_per_arm)
            dense = search.dense_topk(part, vector, depth, "chunk_id", "embedding", s.min_similarity)
            keyword = index.search(query, depth, part.select(F.col("chunk_id").alias("id")))
            out.append(search.fuse(dense, keyword, k if query.strip() else 0, s.rrf_k, s.dense_weight, s.keyword_weight))
        hits = search.passes(out).withColumnRenamed("id", "chunk_id")
        return hits.join(table.drop("embedding"), "chunk_id")

    def subdivisions(self, hits: DataFrame) -> list[str]:
        """The track subdivisions that hits come from, sorted."""
        return incremental.distinct_subdivisions(hits, self.settings.track_doc_type).first()["subdivisions"]

    def context(self, hits: DataFrame) -> str:
        rows = hits.select("position", F.col("document_type").alias("doc_type"), self.label().alias("label"), "text")
        return search.assemble_context(rows, self.settings.max_context_chars).first()["context"] or ""

    @staticmethod
    def label() -> Column:
        return text.source_label(F.col("source_file"), F.col("page"), F.col("section_path"), F.col("test_case_id"), F.col("class_name"), F.col("method_name"), F.col("table_title"))

    def _asked(self, client: LLMClient, prompt: tuple[str, str]) -> str:
        with self.gate:
            return client.generate(*prompt)

    def _static(self, query: str, static: StaticContext | None) -> dict[str, str]:
        s = self.settings
        return {"api_context": static.api(query, s.api_top_k), "track_context": static.track(query, s.static_track_top_k)} if static else {"api_context": "", "track_context": ""}

    def generate_cases(self, requirement: str, client: LLMClient, prompts: Prompts, static: StaticContext | None = None, examples: DataFrame | None = None, **retrieve) -> DataFrame:
        """Scored test cases of one requirement: parse, retrieve, prompt, read the answer, score.

        The prompt may name $requirement, $context, $api_context, $track_context, $examples and $max_test_cases.
        """
        parsed = self.spark.createDataFrame([(requirement,)], "raw string").select(text.requirement_id(F.col("raw")).alias("id"), text.requirement_query(F.col("raw")).alias("query"), text.functional_area(F.col("raw")).alias("area")).first()
        hits = self.retrieve(parsed["query"], **retrieve).persist()
        shown = "" if examples is None else render_examples(examples, "test_cases", self.settings.max_example_chars)
        values = {"requirement": parsed["query"], "context": self.context(hits), "examples": shown, "max_test_cases": str(self.settings.max_test_cases)} | self._static(parsed["query"], static)
        answer = self._asked(client, prompts.pair("test_cases", **values))
        raw = self.spark.createDataFrame([(answer,)], "raw string")
        cases = llm_json.parse_cases(raw, "raw", F.lit(parsed["id"] or ""), F.lit(parsed["area"] or "")).drop("raw")
        if cases.isEmpty():
            raise ValueError("the model returned no usable test cases")
        strength = hits.agg(scoring.retrieval(F.collect_list("similarity")).alias("retrieval"))  # as many as were asked for
        known = scoring.grounded(cases, ["s_no"], "description", hits, "text")
        existing = embedded(scoring.existing_for(hits, parsed["id"]).select("position", "text"), "text", self.embedder)
        near = scoring.closest(embedded(cases.select("s_no", "description"), "description", self.embedder), existing, "s_no", "embedding", "position", "embedding")
        names = hits.select(F.col("position").alias("closest"), F.col("test_case_id").alias("closest_existing_id"), F.col("source_file").alias("closest_existing_source"))
        scored = cases.join(known, "s_no").join(near, "s_no", "left").join(names, "closest", "left").join(F.broadcast(strength))
        return scoring.confidence(scored, self.settings.review_threshold)

    def generate_script(self, requirement: str, descriptions: list[str], client: LLMClient, prompts: Prompts, static: StaticContext | None = None, examples: DataFrame | None = None) -> str:
        query = "\n".join([requirement, *descriptions])
        cases = "\n".join(f"{i}. {d}" for i, d in enumerate(descriptions, 1))
        shown = "" if examples is None else render_examples(examples, "script", self.settings.max_example_chars)
        values = {"requirement": requirement, "test_cases": cases, "context": self.context(self.retrieve(query)), "examples": shown} | self._static(query, static)
        row = self.spark.createDataFrame([(self._asked(client, prompts.pair("test_script", **values)),)], "raw string")
        return row.select(text.strip_fence(F.col("raw")).alias("s")).first()["s"]
