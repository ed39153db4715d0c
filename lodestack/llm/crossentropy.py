"""Language-model scoring by cross-entropy difference.

Two bigram models of one order, smoothing and vocabulary are counted over whole corpora: a target, and
the background, which is all documents. A document's score is its loss a token under the target less
that under the background; the lower, the more it reads like the target. The vocabulary holds every
word: words and word pairs are 64-bit hashes and stay dealt out by them.

The probability of a word after another is (pairs + MASS / BASE_WORDS) / (contexts + MASS), so a loss
is a part of the pair's count less a part of the context's, and each part is looked up by itself: what a
document asks for travels once, to the bucket of its hash, where all that ask for the same are counted
together and answered. Pairs and words that are frequent in a sample are counted beforehand, over all
documents, and sent everywhere, so that no bucket holds a frequent one; the sample decides only which.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Smoothing: the weight, in occurrences, of a uniform word model, and the words that one is over.
MASS, BASE_WORDS = 5.0, 1 << 20
#: Documents of the sample, about, in which frequent pairs and words are sought, and how many of each are counted beforehand.
SAMPLE_DOCS, FREQUENT = 4_000, 1 << 17
#: Of a sampled partition, the keys it puts forward.
PUT_FORWARD = 1 << 16
#: Occurrences a bucket holds on average.
BUCKET_TOKENS = 2_000_000
#: Documents that are dealt together, and their tokens at most.
GROUP_DOCS, GROUP_TOKENS = 1_000, 700_000
#: Words a worker keeps the hashes of.
TABLE_ENTRIES = 400_000
BOUNDARY = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd constant that stands for a text's ends


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class WordKeys(dict):
    """word -> its XXH64; a full table begins anew."""

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


_keys = WordKeys()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of ordered pairs of 64-bit keys."""
    h = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ (b + (a >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def transitions(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, pairs) of a text's transitions, the boundary before the first word and after the last."""
    ids = np.fromiter(map(_keys.__getitem__, words_of(text)), np.uint64)
    ids = np.r_[BOUNDARY, ids, BOUNDARY]
    return ids[:-1], mixed(ids[:-1], ids[1:])


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)


class Known:
    """A sorted table of keys, with a map of their first bits by which most others are told at once."""

    def __init__(self, keys: np.ndarray, bits: int = 21):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[keys >> self.shift] = True

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is in the table, places of those that are)."""
        there = self.seen[keys >> self.shift]
        maybe = np.flatnonzero(there)
        at = np.searchsorted(self.keys, keys[maybe])
        hit = self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == keys[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
        there[maybe[~hit]] = False
        return there, at[hit]


def grouped(batches: Iterator[pa.RecordBatch], docs: int = GROUP_DOCS, tokens: int = GROUP_TOKENS) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, transitions of each, contexts of all, pairs of all) of groups of rows (text, ..) of bounded size; a longer text is a group of its own."""
    rows, parts, size = [], [], 0

    def made() -> tuple:
        return rows, np.array([len(p[0]) for p in parts], np.int64), *(np.concatenate([p[k] for p in parts]) for k in range(2))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            parts.append(transitions(row[0]))
            size += len(parts[-1][0])
            if len(rows) >= docs or size >= tokens:
                yield made()
                rows, parts, size = [], [], 0
    if rows:
        yield made()


def losses(kind: int, counts: np.ndarray) -> np.ndarray:
    """The part of a loss that a context (kind 0) or a pair (kind 1) of so many occurrences makes."""
    return np.log(counts + MASS) if kind == 0 else -np.log(counts + MASS / BASE_WORDS)


def frequent(docs: DataFrame, rows: int) -> list[np.ndarray]:
    """Sorted keys of the contexts and of the pairs that are most frequent in a sample: FREQUENT of each at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        for _, _, *keys in grouped(batches):
            sums = [_summed(np.r_[old, new], np.r_[n, np.ones(len(new), np.int64)]) for (old, n), new in zip(sums, keys)]
        for k, (keys, n) in enumerate(sums):
            top = np.argsort(-n, kind="stable")[:PUT_FORWARD]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), k, np.int32)), pa.array(keys[top].view(np.int64)), pa.array(n[top])], names=["kind", "key", "n"])

    every = max(1, rows // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0) if every > 1 else docs
    counted = sample.select("text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    out = []
    for k in range(2):
        top = counted.where((F.col("kind") == k) & (F.col("n") > 1)).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()  # bounded by FREQUENT
        out.append(np.sort(top.column("key").to_numpy().view(np.uint64)))
    return out


def counted(docs: DataFrame, tables: list[np.ndarray]) -> tuple[int, list[np.ndarray]]:
    """(transitions, counts) over all documents: of each key of both tables, its occurrences in the background and in the target."""
    shared = docs.sparkSession.sparkContext.broadcast([Known(t) for t in tables])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(t.keys)), np.int64) for t in shared.value]
        total = 0
        for rows, sizes, *parts in grouped(batches):
            total += int(sizes.sum())
            inside = np.repeat(np.array([bool(target) for _, target in rows]), sizes)
            for table, part, out in zip(shared.value, parts, sums):
                there, at = table.places(part)
                out[0] += np.bincount(at, minlength=out.shape[1])
                out[1] += np.bincount(at[inside[there]], minlength=out.shape[1])
        columns = [np.array([2]), np.array([0]), np.array([total]), np.array([0])]
        for k, out in enumerate(sums):
            some = np.flatnonzero(out[0])
            columns = [np.r_[c, x] for c, x in zip(columns, (np.full(len(some), k), some, out[0, some], out[1, some]))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["kind", "at", "n", "t"])

    got = docs.select("text", "target").mapInArrow(count, "kind long, at long, n long, t long").groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()  # 2 x FREQUENT rows at most
    kind, at, n, t = (got.column(c).to_numpy() for c in ("kind", "at", "n", "t"))
    out = [np.zeros((2, len(x)), np.int64) for x in tables]
    for k in range(2):
        out[k][:, at[kind == k]] = n[kind == k], t[kind == k]
    return int(n[kind == 2].sum()), out


def score(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row; losses in nats a transition.

    target is true for documents of the target corpus (null: false). A text of n words has n + 1
    transitions; a null or empty text has the one between its boundaries. Documents count in the models
    they belong to, themselves included. Equal texts get equal scores up to the order of summing; rows
    with the same id each give a row; an empty table gives none; other columns are ignored. Two words or
    pairs count as one if their 64-bit hashes are equal. A lost task is run again over the same rows, so
    docs should be a table that is read or something as steady.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    kind = docs.schema["id"].dataType.simpleString()
    tables = frequent(docs, docs.count())
    tokens, counts = counted(docs, tables)
    known = [(Known(t), np.stack([losses(k, c) for c in n], axis=1)) for k, (t, n) in enumerate(zip(tables, counts))]
    shared = spark.sparkContext.broadcast(known)
    buckets, id_type = max(16, tokens // BUCKET_TOKENS), to_arrow_type(docs.schema["id"].dataType)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of documents: a row of what is known of each, and a row of keys for each bucket; contexts go to the odd ones."""
        task = TaskContext.get().partitionId()
        for number, (rows, sizes, *parts) in enumerate(grouped(batches)):
            ids = [i for _, i, _ in rows]
            owner = np.repeat(np.arange(len(rows), dtype=np.uint16), sizes)
            sums, where, keys, owners = np.zeros((len(rows), 2)), [], [], []
            for k, ((table, values), part) in enumerate(zip(shared.value, parts)):
                there, at = table.places(part)
                for m in range(2):
                    sums[:, m] += np.bincount(owner[there], values[at, m], len(rows)) if len(at) else 0
                keys.append(part[~there])
                owners.append(owner[~there])
                where.append((keys[-1] >> np.uint64(32)) % np.uint64(buckets) * np.uint64(2) + np.uint64(1 - k))
            b, keys, owners = np.concatenate(where), np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(b, kind="stable")
            found, starts = np.unique(b[order], return_index=True)
            cut = lambda x: [p.tobytes() for p in np.split(x[order], starts[1:])] if len(x) else []
            group, n = f"{task}-{number}", len(found)
            bits = np.packbits(np.array([bool(flag) for *_, flag in rows])).tobytes()
            head = -1 - zlib.crc32(group.encode()) % (2 * buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([head, *found.astype(np.int64).tolist()], pa.int64()), pa.array([group] * (n + 1)), pa.array([ids] + [None] * n, pa.list_(id_type)), pa.array([sums.tobytes(), *cut(keys)], pa.binary()), pa.array([sizes.tobytes(), *cut(owners)], pa.binary()), pa.array([bits] * (n + 1), pa.binary())],
                names=["bucket", "grp", "ids", "a", "b", "flags"],
            )

    dealt = docs.select("text", "id", "target").mapInArrow(deal, f"bucket long, grp string, ids array<{kind}>, a binary, b binary, flags binary")

    def meet(table: pa.Table) -> pa.Table:
        """A bucket's keys are counted, and each group that sent some gets its documents' sums; what is known passes through."""
        bucket, id_type = table.column("bucket")[0].as_py(), table.schema.field("ids").type
        names = ["grp", "ids", "sums", "sizes"]
        if bucket < 0:
            return pa.Table.from_arrays([table.column(c) for c in ("grp", "ids", "a", "b")], names=names)
        lengths, keys, owners, flags = [], [], [], []
        for a, b, f in zip(*(table.column(c).to_pylist() for c in ("a", "b", "flags"))):
            keys.append(np.frombuffer(a, np.uint64))
            owners.append(np.frombuffer(b, np.uint16))
            flags.append(np.unpackbits(np.frombuffer(f, np.uint8))[owners[-1]].astype(bool))
            lengths.append(len(keys[-1]))
        keys, inside = np.concatenate(keys), np.concatenate(flags)
        found, which, n = np.unique(keys, return_inverse=True, return_counts=True)
        del keys
        both = n, np.bincount(which[inside], minlength=len(found))
        values = np.stack([losses(1 - bucket % 2, c) for c in both], axis=1)
        sums, at = [], 0
        for own, length in zip(owners, lengths):
            mine = values[which[at : at + length]]
            sums.append(np.stack([np.bincount(own, mine[:, m]) for m in range(2)], axis=1).astype(np.float32).tobytes())
            at += length
        return pa.Table.from_arrays([table.column("grp"), pa.nulls(len(sums), id_type), pa.array(sums, pa.binary()), pa.nulls(len(sums), pa.binary())], names=names)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * buckets)
    met = dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(meet, f"grp string, ids array<{kind}>, sums binary, sizes binary")
    # of a group, whose size is bounded, at most a row a bucket
    groups = met.groupBy("grp").agg(F.collect_list(F.when(F.col("ids").isNull(), F.col("sums"))).alias("parts"), *(F.max_by(c, F.col("ids").isNotNull()).alias(c) for c in ("ids", "sums", "sizes")))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
                loss = np.frombuffer(batch.column(2)[k].as_py(), np.float64).reshape(-1, 2).copy()
                for part in sorted(batch.column(0)[k].as_py()):
                    part = np.frombuffer(part, np.float32).reshape(-1, 2)
                    loss[: len(part)] += part
                loss /= sizes[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(1)[k].values, pa.array(sizes - 1), pa.array(loss[:, 1]), pa.array(loss[:, 0])], names=["id", "n_tokens", "target_loss", "background_loss"])

    out = groups.select("parts", "ids", "sums", "sizes").mapInArrow(total, f"id {kind}, n_tokens long, target_loss double, background_loss double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
