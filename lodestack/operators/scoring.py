"""Confidence of generated rows: retrieval strength, grounding, similarity to existing records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, identifiers, keywords, round_half_even, strip

# Words that don't count as grounding.
STOP_WORDS = (
    "a an and are as at be been being but by for from has have if in into is it its "
    "no not of on or that the then there this to was were when which while with "
    "test scenario verify onboard shall should case step expected result"
).split()
TOKEN_WEIGHT, IDENTIFIER_WEIGHT, PROSE_CAP = 0.35, 0.65, 0.8
WEIGHTS = {"retrieval": 0.3, "grounding": 0.3, "similarity": 0.4}
REVIEW_BELOW = 0.55


def retrieval(similarities: Column) -> Column:
    """Mean of the three best non-null similarities, 0 without any, clamped."""
    best = F.slice(F.sort_array(F.array_compact(similarities), asc=False), 1, 3)
    return clamp(F.coalesce(F.try_divide(F.aggregate(best, F.lit(0.0), lambda a, x: a + x), F.size(best)), F.lit(0.0)))


def content_words(text: Column) -> Column:
    return F.array_except(keywords(text), F.array(*map(F.lit, STOP_WORDS)))


def context_vocabulary(chunks: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """([by,] tokens, identifiers) of all chunks: the distinct terms are found before anything is gathered."""
    by = by or []
    terms = chunks.select(*by, F.explode(F.array_union(F.transform(content_words(F.col(text)), lambda t: F.struct(F.lit("t").alias("k"), t.alias("v"))), F.transform(identifiers(F.col(text)), lambda t: F.struct(F.lit("i").alias("k"), t.alias("v"))))).alias("x")).distinct()
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("x.k") == k, F.col("x.v"))))
    return terms.groupBy(*by).agg(of("t").alias("tokens"), of("i").alias("identifiers"))


def grounding(description: Column, tokens: Column, ids: Column) -> Column:
    own, own_ids = content_words(description), identifiers(description)
    share = lambda a, b: F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))
    overlap = F.coalesce(share(own, tokens), F.lit(0.0))
    scored = F.when(F.size(own_ids) > 0, TOKEN_WEIGHT * overlap + IDENTIFIER_WEIGHT * share(own_ids, ids)).otherwise(PROSE_CAP * overlap)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(clamp(scored))


def grounded(cases: DataFrame, key: list[str], description: str, chunks: DataFrame, text: str) -> DataFrame:
    """(key, grounding) against the vocabulary of all chunks, which stays a distributed table: terms are joined, not gathered."""
    own = cases.select(*key, content_words(F.col(description)).alias("t"), identifiers(F.col(description)).alias("i"))
    known_t = chunks.select(F.explode(content_words(F.col(text))).alias("term")).distinct().withColumn("kind", F.lit("t"))
    known_i = chunks.select(F.explode(identifiers(F.col(text))).alias("term")).distinct().withColumn("kind", F.lit("i"))
    mine = own.select(*key, F.explode_outer("t").alias("term"), F.lit("t").alias("kind")).unionByName(own.select(*key, F.explode("i").alias("term"), F.lit("i").alias("kind")))
    hit = mine.join(known_t.unionByName(known_i).withColumn("hit", F.lit(1)), ["term", "kind"], "left")
    n = lambda k: F.count(F.when((F.col("kind") == k) & F.col("term").isNotNull(), 1))
    m = lambda k: F.count(F.when((F.col("kind") == k) & (F.col("hit") == 1), 1))
    agg = hit.groupBy(*key).agg(n("t").alias("nt"), m("t").alias("mt"), n("i").alias("ni"), m("i").alias("mi"))
    overlap = F.coalesce(F.try_divide("mt", "nt"), F.lit(0.0))
    scored = F.when(F.col("ni") > 0, TOKEN_WEIGHT * overlap + IDENTIFIER_WEIGHT * F.try_divide("mi", "ni")).otherwise(PROSE_CAP * overlap)
    return agg.select(*key, F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(clamp(scored)).alias("grounding"))


def existing_for(chunks: DataFrame, requirement: str | None) -> DataFrame:
    """Test-case chunks of a requirement: those whose id starts with its part before `_`, and those without an id."""
    wanted = requirement.strip().upper().split("_")[0] if requirement else ""
    own = F.upper(F.coalesce(F.col("requirement_id"), F.lit("")))
    return chunks.where((F.col("content_type") == "test_case") & (F.lit(wanted == "") | (own == "") | F.startswith(own, F.lit(wanted))))


#: Bytes of vectors that a block holds of either side, as doubles.
BLOCK_BYTES = 32 << 20
#: Products of a block that are looked at together, and buckets that values of `by` are dealt into.
BLOCK_PRODUCTS, BY_BUCKETS = 1 << 22, 64


def closest(cases: DataFrame, existing: DataFrame, key: str, vec: str, existing_key: str, existing_vec: str, by: str | None = None) -> DataFrame:
    """(key, closest, similarity) of each case over all existing ones; the smaller id of equals; no row without existing ones.

    by: a column of both whose value narrows a case to the existing records that have it.
    Both sides are dealt into blocks of about BLOCK_BYTES, and each block of cases meets each of records in a
    task of its own, by matrix products; what these leave within their error of the best is worked out as
    cosine() does it. A row a case and block is shuffled. Cases and records are counted for that; keys repeat as they like.
    """
    value = F.col(by) if by else F.lit(0)
    c = cases.select(value.alias("v"), F.col(key).alias("id"), F.col(vec).alias("vec"))
    e = existing.select(value.alias("v"), F.col(existing_key).alias("id"), F.col(existing_vec).alias("vec"))
    held = F.coalesce(F.sum((F.greatest(F.size("vec"), F.lit(0)) * 8 + 64).cast("long")), F.lit(0))
    c_bytes, e_bytes = c.agg(held).first()[0], e.agg(held).first()[0]
    least = min(cases.sparkSession.sparkContext.defaultParallelism, e_bytes >> 19)  # tasks, but none for half a megabyte
    c_blocks, e_blocks = max(1, -(-c_bytes // BLOCK_BYTES)), max(1, least, -(-e_bytes // BLOCK_BYTES))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        bucket = F.pmod(F.xxhash64("v"), F.lit(BY_BUCKETS)).alias("b")
        return df.where("v is not null").select(bucket, F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<long>")).alias(other), "v", "id", "vec")

    at = ["b", "cb", "eb"]
    met = dealt(c, "cb", c_blocks, "eb", e_blocks).groupBy(*at).cogroup(dealt(e, "eb", e_blocks, "cb", c_blocks).groupBy(*at))
    kinds = f"id {c.schema['id'].dataType.simpleString()}, e_id {e.schema['id'].dataType.simpleString()}, similarity double"
    pairs = met.applyInArrow(closest_in_block, kinds)
    most = pairs.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("e_id")).alias("below"))).alias("b"))
    return most.select(F.col("id").alias(key), (-F.col("b.below")).alias("closest"), F.col("b.similarity").alias("similarity"))


def closest_in_block(cases: pa.Table, records: pa.Table) -> pa.Table:
    """(id, e_id, similarity) of each case of (v, id, vec) with its closest record of its v.

    No similarity is below 0, so the record of the smallest id stands for all that aren't above 0: vectors that
    are null, zero, of other lengths or hold nulls among them.
    """
    (c_of, c_v), (e_of, e_v) = _rows_by(cases["v"]), _rows_by(records["v"])
    at, ids, similarity = [], [], []
    for v in c_v.keys() & e_v.keys():
        own, other = c_of[c_v[v]], e_of[e_v[v]]
        other_ids = records["id"].take(pa.array(other)).to_numpy()
        best, best_id = np.zeros(len(own)), np.full(len(own), other_ids.min())
        c_vectors, e_vectors = _by_length(cases["vec"].take(pa.array(own))), _by_length(records["vec"].take(pa.array(other)))
        for n in c_vectors.keys() & e_vectors.keys():
            _take_best(*c_vectors[n], e_vectors[n][1], other_ids[e_vectors[n][0]], best, best_id)
        at.append(own)
        ids.append(best_id)
        similarity.append(best)
    kinds = [cases["id"].type, records["id"].type, pa.float64()]
    if not at:
        return pa.table([pa.array([], k) for k in kinds], names=["id", "e_id", "similarity"])
    found = [cases["id"].take(pa.array(np.concatenate(at))), pa.array(np.concatenate(ids), kinds[1]), pa.array(np.concatenate(similarity))]
    return pa.table(found, names=["id", "e_id", "similarity"])


def _rows_by(values: pa.ChunkedArray) -> tuple[list[np.ndarray], dict]:
    """(rows of each value, {value: its place there})."""
    coded = values.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    return np.split(order, ends[:-1]), {v: k for k, v in enumerate(coded.dictionary.to_pylist())}


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (rows, their vectors as doubles)} of those that are neither null, empty nor hold a null."""
    col = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = np.maximum(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = col.flatten()
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    usable = sizes > 0
    if flat.null_count:
        usable &= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(sizes)) == 0
    return {int(n): (rows := np.flatnonzero(usable & (sizes == n)), numbers[starts[rows][:, None] + np.arange(n)]) for n in np.unique(sizes[usable])}


def _take_best(rows: np.ndarray, c: np.ndarray, e: np.ndarray, e_ids: np.ndarray, best: np.ndarray, best_id: np.ndarray) -> None:
    """Put each case's highest similarity, clamped, and the smallest id that has it into best and best_id; equal vectors are met once."""
    order = np.argsort(e_ids, kind="stable")
    e, first = np.unique(e[order] + 0.0, axis=0, return_index=True)  # no -0.0; the first is of the smallest id
    ids = e_ids[order][first]
    c, inverse = np.unique(c + 0.0, axis=0, return_inverse=True)
    with np.errstate(all="ignore"):
        (c_norm, c_unit), (e_norm, e_unit) = _units(c), _units(e)
        error = (c.shape[1] + 16) * 1e-15
        step = max(1, BLOCK_PRODUCTS // len(e))
        top, top_id = np.zeros(len(c)), np.full(len(c), e_ids.min())
        for begin in range(0, len(c), step):
            near = c_unit[begin : begin + step] @ e_unit.T
            least = np.maximum(np.minimum(np.fmax.reduce(near, axis=1), 1.0) - error, -error)
            ci, ei = np.nonzero(~(near < least[:, None]))  # what isn't a number is worked out too
            for k in range(0, len(ci), part := max(1, BLOCK_PRODUCTS // c.shape[1])):
                x, y = ci[k : k + part] + begin, ei[k : k + part]
                made = _cosines(c, c_norm, e, e_norm, x, y)
                order = np.lexsort((ids[y], -made, x))
                order = order[np.diff(x[order], prepend=-1) != 0]
                x, made, found = x[order], made[order], ids[y[order]]
                better = (made > top[x]) | ((made == top[x]) & (found < top_id[x]))
                top[x[better]], top_id[x[better]] = made[better], found[better]
    top, top_id = top[inverse.reshape(-1)], top_id[inverse.reshape(-1)]
    better = (top > best[rows]) | ((top == best[rows]) & (top_id < best_id[rows]))
    best[rows[better]], best_id[rows[better]] = top[better], top_id[better]


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, summed in order; unit vectors): zero for zero, no numbers where squares leave the range of doubles."""
    squares = np.zeros(len(v))
    for k in range(v.shape[1]):
        squares += v[:, k] * v[:, k]
    norm = np.sqrt(squares)
    unit = v / np.where(norm == 0, 1.0, norm)[:, None]
    unit[~np.isfinite(squares) | ((squares < 1e-280) & v.any(axis=1))] = np.nan
    return norm, unit


def _cosines(c: np.ndarray, c_norm: np.ndarray, e: np.ndarray, e_norm: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """clamp(cosine()) of pairs of rows, to the last bit."""
    dot, size = np.zeros(len(x)), c_norm[x] * e_norm[y]
    for k in range(c.shape[1]):
        dot += c[x, k] * e[y, k]
    made = np.where(size == 0, 0.0, dot / size)
    return np.where(np.isnan(made), 1.0, np.clip(made, 0.0, 1.0))


def combine(axes: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the axes that aren't null; 0 without weight."""
    total = sum((F.when(v.isNotNull(), F.lit(weights.get(k, 0.0)) * v).otherwise(0.0) for k, v in axes.items()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(weights.get(k, 0.0))).otherwise(0.0) for k, v in axes.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def confidence(df: DataFrame, review_below: float = REVIEW_BELOW) -> DataFrame:
    """df with retrieval, grounding, similarity (null: no axis) -> those rounded, overall, needs_review (of the unrounded overall)."""
    overall = combine({k: F.col(k) for k in WEIGHTS})
    rounded = {k: round_half_even(clamp(F.coalesce(F.col(k), F.lit(0.0)))) for k in WEIGHTS}
    return df.withColumn("__o", overall).withColumns(rounded).withColumn("overall", round_half_even(clamp(F.col("__o")))).withColumn("needs_review", F.col("__o") < review_below).drop("__o")


def mean_confidence(df: DataFrame) -> DataFrame:
    return df.agg(round_half_even(F.coalesce(F.avg("overall"), F.lit(0.0))).alias("mean_confidence"))


def clean(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit("")))


def dense_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("s_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
