"""Ranking: BM25, exact dense search, reciprocal-rank fusion, multi-pass retrieval, context assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, keywords, round_half_even, strip

# Fixed values of the ranking formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
CONTEXT_SEPARATOR = "\n\n---\n\n"


@dataclass(frozen=True)
class KeywordIndex:
    """tokens(id, t: the row's keywords, len), stats(term, df, n, avgdl, idf) and counted(term, df, rows, tokens), which these are of.

    Statistics are of the whole collection and the dear part, so keep them (persisted or written) for
    several queries; a query then reads the rows once and counts only the terms it asks for, within them.
    """

    tokens: DataFrame
    stats: DataFrame
    counted: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str) -> KeywordIndex:
        """Over the whole collection. Each row's terms are made distinct within it, and only (term, df, rows, tokens) is shuffled.

        Rows are taken apart once: a row and its length are counted with its first term, or with null for want of one.
        Generators are outer, as an inner one has its array worked out once more to leave out empty ones.
        """
        tokens = docs.select(F.col(id_col).alias("id"), F.coalesce(keywords(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
        tokens = tokens.withColumn("len", F.size("t"))
        terms = tokens.select(bound(F.col("t"), lambda t: F.struct(F.size(t).alias("len"), F.array_distinct(t).alias("terms"))).alias("x")).select("x.len", F.posexplode_outer("x.terms").alias("pos", "term"))
        first = F.coalesce(F.col("pos"), F.lit(0)) == 0
        counted = terms.groupBy("term").agg(F.count("term").alias("df"), F.count_if(first).alias("rows"), F.sum(F.when(first, F.col("len")).otherwise(0)).alias("tokens"))
        whole = counted.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.try_divide(F.sum("tokens"), F.sum("rows")).alias("avgdl"))
        raw = counted.where("df > 0").select("term", "df").join(F.broadcast(whole)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
        mean = raw.agg(F.avg("raw").alias("mean"))
        stats = raw.join(F.broadcast(mean)).select("term", "df", "n", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        return cls(tokens, stats, counted)

    def kept(self) -> KeywordIndex:
        """The index with its counts and statistics held in the executors, and made anew where one is lost."""
        self.counted.persist()  # before the statistics, which then read it
        self.stats.persist()
        return self

    def postings(self, asked: list[str]) -> DataFrame:
        """(id, len, term, tf) of the terms `asked` that a row has, counted within the row, which is taken apart once."""
        times = lambda t, a: F.size(F.filter(t, lambda x: x == F.lit(a)))
        counts = lambda t: F.filter(F.array(*(F.struct(F.lit(a).alias("term"), times(t, a).alias("tf")) for a in asked)), lambda p: p["tf"] > 0)
        if not asked:
            return self.tokens.where("false").select("id", "len", F.lit("").alias("term"), F.lit(0).alias("tf"))
        own = lambda t: bound(F.filter(t, lambda x: x.isin(asked)), counts)
        found = self.tokens.select("id", bound(F.col("t"), lambda t: F.struct(F.size(t).alias("len"), own(t).alias("p"))).alias("x"))
        return found.select("id", "x.len", F.explode_outer("x.p").alias("p")).where("p.tf > 0").select("id", "len", "p.*")

    def scores(self, query: str) -> DataFrame:
        """(id, score) of rows scoring above 0; query tokens count as often as they occur.

        Scores are rounded to nine digits, so that rows that tie do so in whatever order their terms were summed.
        """
        spark, terms = self.tokens.sparkSession, keywords(F.lit(query))
        distinct = spark.range(1).select(terms.alias("t")).first()["t"]  # literals: a query that is no literal is taken apart for every row
        asked = spark.range(1).select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
        weights = self.stats.join(F.broadcast(asked), "term")
        part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        return self.postings(list(dict.fromkeys(distinct or []))).join(F.broadcast(weights), "term").groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")  # weights: a row a query term

    def search(self, query: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The k best, ties to the smaller id; allowed(id): the filter is put on after scoring, as the statistics are global."""
        scored = self.scores(query)
        if allowed is not None:
            scored = scored.join(allowed.select("id"), "id", "left_semi")
        return scored.orderBy(F.desc("score"), "id").limit(max(k, 0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def dense_topk(vectors: DataFrame, query: DataFrame, k: int, id_col: str, vec_col: str, least: float = 0.0) -> DataFrame:
    """(id, similarity) of the k rows most similar to the one query vector; exact, ties to the smaller id."""
    one = query.select(F.col(vec_col).alias("__q")).limit(1)
    scored = vectors.join(F.broadcast(one)).select(F.col(id_col).alias("id"), cosine(F.col(vec_col), F.col("__q")).alias("similarity"))  # one row
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(max(k, 0))


def metadata_filter(doc_type: Column, doc_types: list[str] | None = None, exclude: str | None = None) -> Column:
    """Types asked for win over an exclusion; a null type passes an exclusion."""
    if doc_types:
        return doc_type.isin(*doc_types)
    return ~doc_type.eqNullSafe(F.lit(exclude)) if exclude else F.lit(True)


def ranked(hits: DataFrame, score: str, name: str) -> DataFrame:
    """Add 1-based ranks to the at most k rows of one arm."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "id")))


def fuse(dense: DataFrame, keyword: DataFrame, k: int, rrf_k: int = 60, dense_weight: float = 1.0, keyword_weight: float = 0.6) -> DataFrame:
    """Weighted reciprocal-rank fusion of dense(id, similarity) and keyword(id, score): a full outer join of two ranked lists.

    An arm of weight 0 or less takes no part. Ties keep the dense order, then the keyword order.
    """
    d, w = ranked(dense, "similarity", "dense_rank"), ranked(keyword, "score", "keyword_rank").withColumnRenamed("score", "bm25_score")
    d, w = d.where(F.lit(dense_weight > 0)), w.where(F.lit(keyword_weight > 0))
    part = lambda weight, rank: F.coalesce(F.lit(float(weight)) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))
    both = d.join(w, "id", "full").withColumn("score", part(dense_weight, "dense_rank") + part(keyword_weight, "keyword_rank"))
    by = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(F.col("keyword_rank").isNotNull(), F.lit("keyword"))))
    order = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("keyword_rank")]
    top = both.withColumn("matched_by", by).orderBy(*order).limit(max(k, 0))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def passes(results: list[DataFrame]) -> DataFrame:
    """Results of several passes one after the other, without removing what two passes found."""
    out = None
    for ix, part in enumerate(results):
        part = part.withColumn("pass_ix", F.lit(ix))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("position", F.row_number().over(Window.orderBy("pass_ix", "rank")))


def assemble_context(hits: DataFrame, budget: int) -> DataFrame:
    """hits(position, label, doc_type, text) -> (context, blocks): `[i] type | label` blocks up to the first that overflows.

    The first block stays whatever its length; separators aren't counted.
    """
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("doc_type"), F.lit(" | "), F.col("label"), F.lit("\n"), F.col("text"))
    made = hits.withColumn("block", block).withColumn("cum", F.sum(F.length("block")).over(Window.orderBy("position")))
    kept = made.where((F.col("position") == 1) | (F.col("cum") <= budget))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "block"))), lambda x: x["block"]), CONTEXT_SEPARATOR)
    return kept.agg(joined.alias("context"), F.count(F.lit(1)).alias("blocks"))


def format_hits(hits: DataFrame) -> DataFrame:
    """hits(position, source_file, source_path, method_name, section_path, document_type, text) -> (context): `[i] type | label` blocks of all of them; "" without any."""
    filled = lambda *cols: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols))
    label = F.concat_ws(" > ", F.coalesce(filled("source_file", "source_path"), F.lit("unknown")), filled("method_name", "section_path"))
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.coalesce("document_type", F.lit("static")), F.lit(" | "), label, F.lit("\n"), strip(F.col("text")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", block.alias("block")))), lambda x: x["block"]), CONTEXT_SEPARATOR)
    return hits.agg(joined.alias("context"))


def display_rows(hits: DataFrame, label: Column) -> DataFrame:
    """(chunk_id, source, document_type, similarity, bm25_score, matched_by, excerpt): rounded scores and the first 600 characters."""
    return hits.select(
        "chunk_id", label.alias("source"), F.coalesce(F.col("document_type").cast("string"), F.lit("")).alias("document_type"), round_half_even(F.col("similarity"), 3).alias("similarity"),
        round_half_even(F.col("bm25_score"), 2).alias("bm25_score"), "matched_by", F.substring("text", 1, 600).alias("excerpt"),
    )
