"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt to the cells of an inverted index (centroids fitted on a bounded sample). A vector's
offset from its centroid is turned at random into a space of CODE_LENGTH times as many dimensions and
kept there as its signs, packed, with two correction scalars: the offset's length and its inner product
with its own code. Codes are made once, beside the vector. A query, turned alike and cut to a few bits a
component, meets the packed codes of the cells it looks into by AND and popcount; that estimates its
inner products without bias and with an error bound. Its first cells give the k-th best exact score so
far; of the others only those can matter that may hold a larger inner product, and in them only vectors
whose upper bound reaches that score are reranked in double precision. How many cells a query looks into
is measured on the sample. Equal vectors are searched, and found, once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, written

#: Vectors on which centroids are fitted, at most.
FIT_ROWS = 20_000
#: Centroids, at most; below, so many that a cell has CELL_MEAN vectors on average.
MOST_CELLS, CELL_MEAN = 4_096, 1_024
#: Vectors of a cell that are held against a block of queries at once.
CELL_ROWS = 16_384
#: Queries of a cell that are held against a block of vectors at once.
QUERY_ROWS = 8_192
#: Width of the error bound in standard deviations of the estimate.
BOUND = 2.5
#: Queries of the sample on which probes are measured, and the share of their neighbours that must lie in the cells probed.
PROBE_QUERIES, PROBE_SHARE = 400, 0.97
#: Bits of a code for each dimension, bits that a component of a query is cut to, and queries estimated together.
CODE_LENGTH, QUERY_BITS, TOGETHER = 4, 3, 64
#: Cells that give a query its first scores.
FIRST_CELLS = 2
#: Pairs of a query and a vector that are reranked at once.
PAIRS = 100_000


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random turn of dim dimensions into CODE_LENGTH times as many, which keeps inner products."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((CODE_LENGTH * dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Lloyd's rounds from distinct sample rows; an emptied cell keeps its place."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Rows of c by distance from each of x, the k nearest in any order."""
    k, out = min(k, len(c)), []
    half = (c * c).sum(axis=1) / 2
    for at in range(0, len(x), 2_048):
        d = half - x[at : at + 2_048] @ c.T
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1)))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def ranked_cells(q: np.ndarray, c: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all rows of c for each of q, by the largest inner product their vectors can have, q.c + |q| reach; these bounds)."""
    bound = q @ c.T + np.sqrt((q * q).sum(axis=1))[:, None] * reach
    order = np.argsort(-bound, axis=1, kind="stable")
    return order, np.take_along_axis(bound, order, axis=1)


def measured_probes(sample: np.ndarray, c: np.ndarray, k: int) -> int:
    """Cells that sample queries must look into to meet PROBE_SHARE of their k neighbours in the sample.

    In a larger table neighbours are nearer, and their cells no farther down.
    """
    if len(sample) < 2 or len(c) < 2:
        return len(c)
    cell = nearest(sample, c, 1)[:, 0]
    offset, reach = sample - c[cell], np.full(len(c), -np.inf)
    np.maximum.at(reach, cell, np.sqrt((offset * offset).sum(axis=1)))
    asked = np.random.default_rng(3).permutation(len(sample))[:PROBE_QUERIES]
    place, k = np.empty(len(c), int), min(k, len(sample) - 1)
    places = []
    for i, order in zip(asked, ranked_cells(sample[asked], c, reach)[0]):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        place[order] = np.arange(len(c))
        places.append(place[cell[np.argpartition(-scores, k - 1)[:k]]])
    return int(np.quantile(np.concatenate(places), PROBE_SHARE, method="higher")) + 1


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, inner products of unit offsets with their unit codes) of vectors around their centroids."""
    offset = x - centre
    length = np.sqrt((offset * offset).sum(axis=1))
    turned = (offset @ turn.T) / np.maximum(length, 1e-300)[:, None]
    own = np.abs(turned).sum(axis=1) / math.sqrt(len(turn))
    own[length == 0] = 1.0
    padded = np.zeros((len(x), -(-len(turn) // 64) * 64), bool)
    padded[:, : len(turn)] = turned > 0
    return np.packbits(padded, axis=1, bitorder="little"), length, own


class Codes:
    """Packed codes of a cell's vectors; nothing of them is unpacked."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, own: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.words = np.ascontiguousarray(np.ascontiguousarray(bits).view("<u8").T)
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        self.size, self.centre, self.turn = len(turn), centre, turn
        self.length, self.scale = length, length / np.maximum(own, 1e-9)
        self.spread = self.scale * np.sqrt(np.maximum(1 - own**2, 0) / max(1, self.size - 1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates of <q, x>, half widths of their bounds), queries x vectors."""
        turned = q @ self.turn.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
        cut = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        padded = np.zeros((len(q), len(self.words) * 64), np.uint8)
        padded[:, : self.size] = cut
        shape = len(q), self.words.shape[1]
        inside = np.zeros(shape, np.int32)  # sums of the cut components where the code has a one
        both, ones, sums = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, np.uint32)
        for j in range(QUERY_BITS):
            plane = np.packbits(padded >> j & 1, axis=1, bitorder="little").view("<u8")
            sums.fill(0)
            for w in range(len(self.words)):
                np.bitwise_and(self.words[w], plane[:, w, None], out=both)
                np.bitwise_count(both, out=ones)
                sums += ones
            inside += sums.astype(np.int32) << j
        size = np.sqrt((q * q).sum(axis=1))
        raw = (2 * low[:, None] * self.ones + (2 * step)[:, None] * inside - (low * self.size + step * cut.sum(axis=1))[:, None]) / math.sqrt(self.size)
        estimate = raw * self.scale + (q @ self.centre)[:, None]
        width = BOUND * (size[:, None] * self.spread + (step / math.sqrt(12))[:, None] * self.scale)
        return estimate, width + 1e-6 * size[:, None] * (1 + self.length)


def exact(q: np.ndarray, x: np.ndarray, owner: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products in double precision of the queries and vectors that owner and row pair."""
    out = np.empty(len(owner))
    for at in range(0, len(owner), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = (x[row[part]].astype(np.float64) * q[owner[part]]).sum(axis=1)
    return out


def search_cell(q: np.ndarray, floor: np.ndarray, xid: np.ndarray, x: np.ndarray, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, vector's number, score): of each query the k best in the cell that reach its floor; ties to the smaller id."""
    out, few = [], min(k, len(x))
    for at in range(0, len(q), TOGETHER):
        part, least = q[at : at + TOGETHER], floor[at : at + TOGETHER]
        n = len(part)
        mean, upper = codes.bounds(part)
        upper += mean
        first = np.argpartition(-mean, few - 1, axis=1)[:, :few]
        owner = np.repeat(np.arange(n), few)
        score = exact(part, x, owner, first.ravel())
        if few == k:  # the least of any k scores is one that the k best reach
            least = np.maximum(least, score.reshape(n, k).min(axis=1))
        more = upper >= least[:, None]
        np.put_along_axis(more, first, False, axis=1)
        late_owner, late = np.nonzero(more)
        owner, row = np.r_[owner, late_owner], np.r_[first.ravel(), late]
        score = np.r_[score, exact(part, x, late_owner, late)]
        reached = score >= least[owner]
        owner, row, score = owner[reached], row[reached], score[reached]
        order = np.lexsort((xid[row], -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)  # a row's place among its query's
        best = order[place < k]
        out.append((owner[place < k] + at, row[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query's k nearest found by inner product, nearest first.

    vectors and queries hold (id, vector); a query never finds its own id. probes: the cells that a query
    looks into, those first that can hold the largest inner product, so that vectors may differ in
    length; None measures how many. Vectors that are null, zero, of another length than the first usable
    one's or hold null or non-finite components take no part. Ties go to the smaller id. Of several
    vectors under one id the least in the order of components counts. No usable vector or query gives no
    row; null ids take no part; other columns are ignored.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    digest = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    single = lambda df: usable(df, vec_col).where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(vec_col).alias("v"))
    base = written(single(vectors).select("id", "v", *digest), "vectors")
    first = base.agg(F.min_by(F.size("v"), "id")).first()
    dim = first[0] or 0
    if not dim:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    base = base.where(F.size("v") == dim)
    asked = written(single(queries).where(F.size("v") == dim).select("id", "v", *digest), "queries")
    same = Window.partitionBy("h", "g").orderBy("id")
    # of equal vectors the k + 1 smallest ids can be found, whoever asks; the limit is put on before the shuffle
    members = base.select("h", "g", "id").withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    members = members.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids")
    reps = written(base.select("id", "v").join(members, "id"), "distinct")
    leads = asked.groupBy("h", "g").agg(F.min("id").alias("lead"))
    leads = written(leads, "leads")
    rows = reps.count()
    taken = reps.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()  # bounded
    sample = taken.flatten().to_numpy().reshape(-1, dim).astype(np.float64)
    centres = centroids(sample, max(1, min(MOST_CELLS, rows // CELL_MEAN)))
    turn, n_probes = rotation(dim), min(probes or measured_probes(sample, centres, k), len(centres))
    element = vectors.schema[vec_col].dataType.simpleString()

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1)).astype(np.float64)
                cell = nearest(x, centres, 1)[:, 0]
                bits, length, own = encode(x, centres[cell], turn)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(own)], names=["id", "v", "ids", "cell", "bits", "length", "own"])

    held = reps.select("id", "v", "ids").mapInArrow(deal, f"id {kind}, v {element}, ids array<{kind}>, cell int, bits binary, length double, own double")
    held = written(held, "codes")
    stats = held.groupBy("cell").agg(F.max("length").alias("reach"), F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts")).collect()  # a row a cell
    reach = np.full(len(centres), -np.inf)
    for r in stats:
        reach[r["cell"]] = r["reach"]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                cells, bounds = (r[:, :n_probes] for r in ranked_cells(matrix(part.column(1)).astype(np.float64), centres, reach))
                where = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                place = np.tile(np.arange(cells.shape[1], dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array(cells.ravel().astype(np.int32)), pa.array(place), pa.array(bounds.ravel())], names=["lead", "v", "cell", "place", "bound"])

    lead = asked.join(leads.select(F.col("lead").alias("id")), "id").select(F.col("id").alias("lead"), "v")
    sought = written(lead.mapInArrow(seek, f"lead {kind}, v {element}, cell int, place int, bound double"), "probes")
    parts = spark.createDataFrame([(r["cell"], r["parts"]) for r in stats], "cell int, parts int")
    names, by, order = ["lead", "id", "ids", "score"], ["cell", "part", "block"], Window.partitionBy("lead").orderBy(F.desc("score"), "id")

    def meet(key: tuple, x: pa.Table, q: pa.Table) -> pa.Table:
        kinds = [x.schema.field("id").type, x.schema.field("id").type, x.schema.field("ids").type, pa.float64()]
        if not x.num_rows or not q.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        x, q = x.combine_chunks(), q.combine_chunks()
        one = lambda t, c: t.column(c).chunk(0)
        bits = np.frombuffer(b"".join(one(x, "bits").to_pylist()), np.uint8).reshape(x.num_rows, -1)
        codes = Codes(bits, one(x, "length").to_numpy(), one(x, "own").to_numpy(), centres[key[0].as_py()], turn)
        owner, row, score = search_cell(matrix(one(q, "v")).astype(np.float64), one(q, "floor").to_numpy(), one(x, "id").to_numpy(), matrix(one(x, "v")), codes, k + 1)
        return pa.Table.from_arrays([one(q, "lead").take(pa.array(owner)), one(x, "id").take(pa.array(row)), one(x, "ids").take(pa.array(row)), pa.array(score)], names=names)

    def looked(wanted: DataFrame, name: str) -> DataFrame:
        """Of each query of wanted(lead, v, cell, floor) the k + 1 best that its cells give."""
        # a cell is held in parts, and so are the queries that look into it: no part grows with the data
        blocks = wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
        grid = F.broadcast(parts.join(blocks, "cell"))  # a row a cell
        part, block = F.pmod(F.xxhash64("id"), "parts").cast("int"), F.pmod(F.xxhash64("lead", F.lit(1)), "blocks").cast("int")
        mine = held.join(grid, "cell").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        theirs = wanted.join(grid, "cell").withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = mine.select(*by, "id", "v", "ids", "bits", "length", "own").groupBy(*by).cogroup(theirs.select(*by, "lead", "v", "floor").groupBy(*by))
        found = met.applyInArrow(meet, f"lead {kind}, id {kind}, ids array<{kind}>, score double")
        return written(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), name)  # limited in each part first

    soon = looked(sought.where(F.col("place") < FIRST_CELLS).withColumn("floor", F.lit(float("-inf"))), "soon")
    floors = soon.groupBy("lead").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    later = sought.where(F.col("place") >= FIRST_CELLS).join(floors, "lead", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    best = soon.unionByName(looked(later.where(F.col("bound") * (1 + F.signum("bound") * 1e-9) >= F.col("floor")), "later"))
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("below"), i.alias("vec_id")))))
    best = written(best.groupBy("lead").agg(F.slice(F.sort_array(pairs), 1, k + 1).alias("all")), "found")
    who = looked_up(written(asked.select("id", "h", "g").join(leads, ["h", "g"]).select("id", "lead"), "askers"), best, "lead", rows)
    top = who.select(F.col("id").alias("query_id"), F.slice(F.filter("all", lambda p: p["vec_id"] != F.col("id")), 1, k).alias("all"))
    top = top.select("query_id", F.posexplode("all").alias("pos", "x"))
    return top.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.below")).alias("score"))
