"""SimHash near-duplicates: bit-sliced comparison within index buckets, then connected components.

Distinct fingerprints are dealt to buckets in which two within the radius are sure to meet
(`Blocks`, exact: with more blocks than the radius, enough blocks agree) or meet with a stated
probability (`Bands`, for radii that blocks can't serve). A bucket's fingerprints are stored as bit
planes, a machine word holding one bit of 64 of them; distances of whole words of pairs are summed by
carry-save counters that start so that they overflow past the radius, and a block is abandoned as soon
as all its pairs have overflowed. An exact index' bucket gives the edges of a spanning forest, never its
pairs; with bands, rounds link few of each group and the last looks between the groups so found.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, freed, looked_up, mark, picked, written

#: Rows of a bucket above which it is dealt anew by further bits.
REFINE_ROWS = 16_384
#: Runs up to this length are compared by shifts, longer ones by growing components.
SHIFT_RUN = 128
#: Lanes that are compared together.
LANES = 32_768
#: Rounds in which each row is paired with its nearest alone, before all pairs between components are looked at.
ROUNDS = 2
#: Near pairs for each row of a run up to which these are listed; the rows of a run with more belong to crowds, whose sets meet in blocks.
LISTED = 1
#: Elements of sets that a block of a crowd holds.
CROWD_ELEMENTS = 4_000_000
#: Tables of an index that are dealt together, so that what is on disk doesn't grow with their number.
TABLES = 12
_MIX = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # fixed values: odd 64-bit mixing constants


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words of the text with A-Z lower-cased, repeats included.

    Fewer words make one shingle, none make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 x words bits, big-endian; a bit is 1 if set in over half the hashes. None: zero.

    The first 64 come from the hashes themselves, further ones from the hashes mixed anew.
    """
    n, out = len(hashes), []
    for k in range(words):
        h = hashes
        if k:
            h = (h ^ np.uint64(_MIX[k])) * np.uint64(_MIX[k])
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > n).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary) of every row; a null text counts as an empty one, whose fingerprint is zero."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle), words) for t in batch.column(1)]  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fp binary")


@dataclass(frozen=True)
class Blocks:
    """Exact index: bits in `blocks` blocks; two fingerprints within the radius agree in all of some `same` of them."""

    bits: int
    radius: int
    blocks: int

    @classmethod
    def plan(cls, bits: int, radius: int, rows: int) -> Blocks:
        """The fewest blocks that make buckets of 16 on average."""
        for blocks in range(radius + 1, min(bits, radius + 4) + 1):
            if bits * (blocks - radius) / blocks >= math.log2(max(rows, 2)) - 4:
                break
        return cls(bits, radius, blocks)

    def roots(self) -> list[tuple]:
        return [(chosen,) for chosen in itertools.combinations(range(self.blocks), self.blocks - self.radius)]

    def positions(self, path: tuple) -> tuple[list[int], list[int]]:
        """(the bits of the path's last step, the bits that no step has used)."""
        parts = np.array_split(np.arange(self.bits), self.blocks)
        used = np.concatenate([parts[b] for b in path[0]])
        rest = np.setdiff1d(np.arange(self.bits), used)
        for step in path[1:]:
            used = np.array_split(rest, self.radius + 1)[step]
            rest = np.setdiff1d(rest, used)
        return used.tolist(), rest.tolist()

    def steps(self, path: tuple) -> list[int]:
        """How a bucket is dealt anew: as the rest differs in at most `radius` bits, one of radius + 1 parts agrees."""
        return list(range(self.radius + 1)) if len(self.positions(path)[1]) > self.radius else []


@dataclass(frozen=True)
class Bands:
    """Index by `tables` random choices of `width` bits; a pair whose bits agree with chance p is missed with (1 - p**width)**tables."""

    bits: int
    radius: int
    width: int
    tables: int

    @classmethod
    def plan(cls, bits: int, radius: int, rows: int, agree: float, miss: float = 0.005) -> Bands:
        """Buckets of 64 on average; as many tables as a pair agreeing in just a share `agree` of bits needs.

        Pairs of one similarity differ in how many bits agree, so more of them are missed than `miss`: see README.
        """
        width = max(4, math.ceil(math.log2(max(rows, 2))) - 6)
        return cls(bits, radius, width, max(1, math.ceil(math.log(miss) / math.log1p(-(agree**width)))))

    def roots(self) -> list[tuple]:
        return [(t,) for t in range(self.tables)]

    def positions(self, path: tuple) -> tuple[list[int], list[int]]:
        order = np.random.default_rng(path[0]).permutation(self.bits)
        return order[: self.width].tolist(), order[self.width :].tolist()


def _keys(fps: np.ndarray, positions: list[int], salt: int) -> np.ndarray:
    """64-bit hashes of the given bits of fingerprints (n x bytes)."""
    bits = np.unpackbits(fps, axis=1)[:, positions]
    out = np.full(len(fps), salt, np.uint64)
    for at in range(0, len(positions), 32):
        part = bits[:, at : at + 32]
        value = part.astype(np.uint64) @ (np.uint64(1) << np.arange(part.shape[1], dtype=np.uint64))
        out = (out ^ value) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(30)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint8)


def _dealt(df: DataFrame, index: Blocks | Bands, paths: list[tuple], parents: list[tuple] | None) -> DataFrame:
    """df(fp[, key, path]) -> a row (path, key, fp) for each path, or each of paths that goes on from the row's.

    Bytes of fp beyond the index' bits are carried along.
    parents: what the numbers in df's `path` stand for; those in the result's stand for paths.
    """
    width = index.bits // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _matrix(batch.column(0))[:, :width]
            if parents is None:
                jobs = [(k, np.arange(len(fps)), p, None) for k, p in enumerate(paths)]
            else:
                at, keys = batch.column(2).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                jobs = [(k, rows, p, keys) for k, p in enumerate(paths) for rows in [np.flatnonzero(at == number[p[:-1]])] if len(rows)]
            for k, rows, p, keys in jobs:
                new = _keys(fps[rows], index.positions(p)[0], k)
                if keys is not None:
                    new = (new ^ keys[rows]) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(new.view(np.int64)), batch.column(0).take(pa.array(rows))], names=["path", "key", "fp"])

    number = {p: k for k, p in enumerate(parents or [])}
    cols = ["fp"] if parents is None else ["fp", "key", "path"]
    return df.select(cols).mapInArrow(run, "path int, key long, fp binary")


class Counters:
    """Carry-save counters over lanes; they start at 2**k - (radius + 1), so a carry out means: beyond the radius."""

    def __init__(self, words: int, radius: int):
        levels = max(2, (radius).bit_length())
        start = (1 << levels) - (radius + 1)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.level = [np.full(words, full if start >> k & 1 else 0, np.uint64) for k in range(levels)]
        self.over = np.zeros(words, np.uint64)

    @staticmethod
    def _sum(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    def add(self, p: list[np.ndarray]) -> None:
        """Four planes of differing bits."""
        ones, a = self._sum(self.level[0], p[0], p[1])
        self.level[0], b = self._sum(ones, p[2], p[3])
        self.level[1], carry = self._sum(self.level[1], a, b)
        for k in range(2, len(self.level)):
            self.level[k], carry = self.level[k] ^ carry, self.level[k] & carry
        self.over |= carry


def planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints (n x bytes) -> bit planes (bits x words), lane i in bit i % 64 of word i // 64."""
    n = len(fps)
    padded = np.zeros((-(-max(n, 1) // 64) * 64, fps.shape[1]), np.uint8)
    padded[:n] = fps
    bits = np.ascontiguousarray(np.unpackbits(padded, axis=1).T)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _mask(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def within(diff, bits: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Of the wanted lanes, those whose planes diff(k), k < bits, have at most `radius` ones. Stops once none is left."""
    counters = Counters(len(wanted), radius)
    for k in range(0, bits, 4):
        counters.add([diff(k + j) for j in range(4)])
        if k % 16 == 12 and not np.any(wanted & ~counters.over):
            break
    return wanted & ~counters.over


def _near_by_shifts(fps: np.ndarray, run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Near pairs of equal run, each run one stretch of at most SHIFT_RUN rows: lane i is compared with i + d for all d."""
    found, rows = [], np.arange(len(fps))
    d, until = 1, 0
    while len(rows):
        if d >= until:  # go on with the runs that are long enough
            _, where, sizes = np.unique(run[rows], return_inverse=True, return_counts=True)
            rows = rows[sizes[where] > d]
            if not len(rows):
                break
            until = 2 * d
            p, labels = planes(fps[rows]), run[rows]
            bits, words = p.shape
        flags = labels[:-d] == labels[d:] if d < len(rows) else np.zeros(0, bool)
        if flags.any():
            wanted = _mask(flags, words)
            skip, by = divmod(d, 64)
            far = np.zeros((bits, words), np.uint64)
            far[:, : words - skip] = p[:, skip:] >> np.uint64(by)
            if by:
                far[:, : words - skip - 1] |= p[:, skip + 1 :] << np.uint64(64 - by)
            near = _lanes(within(lambda k: p[k] ^ far[k], bits, wanted, radius))
            found += zip(rows[near].tolist(), rows[near + d].tolist())
        d += 1
    return found


def _grown(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of one long run: each row is compared with those that no component has reached."""
    found, left = [], np.arange(len(fps))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        p = planes(fps[left])
        while frontier and len(left):
            at = frontier.pop()
            q = np.unpackbits(fps[at])
            full = np.uint64(0xFFFFFFFFFFFFFFFF)
            near = _lanes(within(lambda k: p[k] ^ full if q[k] else p[k], len(q), _mask(np.ones(len(left), np.uint8), p.shape[1]), radius))
            if len(near):
                found += [(at, x) for x in left[near].tolist()]
                frontier += left[near].tolist()
                left = np.delete(left, near)
                p = planes(fps[left])
    return found


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            up.setdefault(min(a, b), min(a, b))
    return [(x, root(x)) for x in up if root(x) != x]


def _edges(fps: np.ndarray, run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[begins, len(run)])
    short = np.repeat((sizes > 1) & (sizes <= SHIFT_RUN), sizes)
    rows = np.flatnonzero(short)
    out = [(int(rows[a]), int(rows[b])) for a, b in _forest(_near_by_shifts(fps[rows], run[rows], radius))] if len(rows) else []
    for b, n in zip(begins[sizes > SHIFT_RUN].tolist(), sizes[sizes > SHIFT_RUN].tolist()):
        out += [(b + x, b + y) for x, y in _grown(fps[b : b + n], radius)]
    return out


def _distances(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(fps).view("<u8")
    return np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)


def _nearest_of(pairs: np.ndarray, distance: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of near pairs, each row's with its nearest, of equals the one of the smallest rank."""
    a, b = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
    order = np.lexsort((rank[b], np.r_[distance, distance], a))
    a, b = a[order], b[order]
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    return np.stack([a[first], b[first]], axis=1)


def _near_rows(fps: np.ndarray, label: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one long run, (row, near rows of other labels); a pair comes up from both sides unless one has the commonest label, whose rows don't ask."""
    kinds, which, n = np.unique(label, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(which != n.argmax()) if n.max() > 1 else np.arange(len(fps))
    p, full = planes(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in asking.tolist():
        q = np.unpackbits(fps[at])
        yield at, _lanes(within(lambda k: p[k] ^ full if q[k] else p[k], len(q), _mask(label != label[at], p.shape[1]), radius))


def _split_runs(run: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(rows of runs of 2 to SHIFT_RUN, (begin, size) of longer ones)."""
    begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[begins, len(run)])
    short = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHIFT_RUN), sizes))
    return short, [(b, n) for b, n in zip(begins.tolist(), sizes.tolist()) if n > SHIFT_RUN]


def _candidates(rows: np.ndarray, run: np.ndarray, radius: int, width: int, last: bool) -> tuple[list, list]:
    """(pairs, crowd) of near rows of equal run and differing labels; rows are fingerprints, digests and labels.

    Unless last, each row has a pair with its nearest, and no row that is near another is in none. In the last round a short run's
    near pairs are listed if there are no more than LISTED for each of its rows. Else, and of long runs, crowd holds edges of a forest, so
    that the rows of a near pair are in one crowd; nothing is left out, and what is given grows with the rows, not with the pairs.
    """
    fps, label = rows[:, :width], np.ascontiguousarray(rows[:, -8:]).view(np.uint64)[:, 0]
    rank = np.ascontiguousarray(rows[:, width : width + 8]).view(np.uint64)[:, 0]
    short, long = _split_runs(run)
    pairs = short[np.array(_near_by_shifts(fps[short], run[short], radius), np.int64).reshape(-1, 2)] if len(short) else np.zeros((0, 2), np.int64)
    pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    out, crowd = [], []
    if not last:
        out += _nearest_of(pairs, _distances(fps, pairs[:, 0], pairs[:, 1]), rank).tolist()
        for b, n in long:
            least, by = np.full(n, 1 << 30), np.zeros(n, np.int64)  # of rows that don't ask, the nearest that has asked for them
            for at, near in _near_rows(fps[b : b + n], label[b : b + n], radius):
                if len(near):
                    far = _distances(fps[b : b + n], np.full(len(near), at), near)
                    out.append((b + at, b + int(near[np.lexsort((rank[b + near], far))[0]])))
                    nearer = near[far < least[near]]
                    least[nearer], by[nearer] = far[far < least[near]], at
            out += [(b + x, b + int(by[x])) for x in np.flatnonzero(least < 1 << 30).tolist()]
        return out, crowd
    _, which = np.unique(run, return_inverse=True)
    dense = (np.bincount(which[pairs[:, 0]], minlength=len(rows)) > LISTED * np.bincount(which, minlength=len(rows)))[which[pairs[:, 0]]]
    out += pairs[~dense].tolist()
    crowd += _forest(pairs[dense].tolist())
    for b, n in long:
        root = np.arange(n)
        for x, r in _forest(_grown(fps[b : b + n], radius)):
            root[x] = r
        mixed = np.zeros(n, bool)
        mixed[root[label[b : b + n] != label[b + root]]] = True  # what is near only rows of its own label has nothing to be held against
        crowd += [(b + x, b + int(root[x])) for x in np.flatnonzero(mixed[root] & (root != np.arange(n))).tolist()]
    return out, crowd


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprints, run, path, key) of whole buckets of rows (path, key, fp[, another key]), some LANES rows at a time."""
    held, n = [], 0

    def joined() -> tuple:
        return tuple(np.concatenate([h[k] for h in held]) for k in range(4))

    for batch in batches:
        if not batch.num_rows:
            continue
        path, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held.append((_matrix(batch.column(2)), key * 64 + path, path, batch.column(3).to_numpy() if batch.num_columns > 3 else key))
        n += batch.num_rows
        if n >= LANES:
            whole = joined()
            run = whole[1]
            cut = int(np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[-1])  # the last run may go on
            if cut:
                yield tuple(x[:cut] for x in whole)
            held, n = [tuple(x[cut:] for x in whole)], len(run) - cut
    if n:
        yield joined()


def _binary(fps: np.ndarray, rows) -> pa.Array:
    return pa.array([fps[i].tobytes() for i in rows], pa.binary())


def _linked(dealt: DataFrame, pairs_of: Callable) -> DataFrame:
    """Edges (u, v) that pairs_of finds in all buckets (path, key) of dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, runs, _, _ in _runs(batches):
            yield from _edge_batches(fps, pairs_of(fps, runs))

    return dealt.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, "u binary, v binary")


def _edge_batches(fps: np.ndarray, pairs: list, **more: pa.Scalar) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(pairs), 65_536):
        a, b = zip(*pairs[at : at + 65_536])
        yield pa.RecordBatch.from_arrays([_binary(fps, a), _binary(fps, b), *(pa.repeat(v, len(a)) for v in more.values())], names=["u", "v", *more])


FOUND = "u binary, v binary, crowd boolean, path int, key long, fp binary"


def _searched(dealt: DataFrame, pairs_of: Callable, most: int | None) -> DataFrame:
    """What pairs_of finds in buckets (path, key): rows (u, v, crowd); of a bucket of over `most` rows nothing but these: (path, key, fp)."""
    none = pa.scalar(None, pa.int32()), pa.scalar(None, pa.int64()), pa.scalar(None, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for fps, runs, path, key in _runs(batches):
            begins = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            sizes = np.diff(np.r_[begins, len(runs)])
            large = np.repeat(sizes > (most or len(runs)), sizes)
            for at in np.array_split(np.flatnonzero(large), -(-int(large.sum()) // 65_536) or 1):
                if len(at):
                    gone = [pa.nulls(len(at), t) for t in (pa.binary(), pa.binary(), pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*gone, pa.array(path[at]), pa.array(key[at]), _binary(fps, at)], names=names)
            some = np.flatnonzero(~large)
            if len(some):
                for kind, pairs in zip((False, True), pairs_of(fps[some], runs[some])):
                    yield from _edge_batches(fps[some], pairs, crowd=pa.scalar(kind), path=none[0], key=none[1], fp=none[2])

    return dealt.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, FOUND)


def links(distinct: DataFrame, index: Blocks, pairs_of: Callable | None = None) -> DataFrame:
    """Edges (u, v) that connect just what the exact index finds within the radius, at most one a row and table.

    distinct(fp): fingerprints, each once. Buckets of over REFINE_ROWS rows are dealt anew by further
    bits until they are smaller or no bits are left, at which a bucket is bounded by what those bits can hold.
    """
    paths, found = index.roots(), None
    pairs_of = pairs_of or partial(_edges, radius=index.radius)
    dealt = written(_dealt(distinct, index, paths, None), "dealt")
    while True:
        large = dealt.groupBy("path", "key").count().where(F.col("count") > REFINE_ROWS).select("path", "key")
        large = written(large, "large")
        further = [(*p, s) for p in paths for s in index.steps(p)]
        stop = not further or large.isEmpty()
        part = _linked(dealt if stop else dealt.join(large, ["path", "key"], "left_anti"), pairs_of)
        found = part if found is None else found.unionByName(part)
        if stop:
            return found
        dealt = written(_dealt(dealt.join(large, ["path", "key"], "left_semi"), index, further, paths), "dealt")
        paths = further


def _round(labelled: DataFrame, index: Bands, width: int, last: bool) -> tuple[DataFrame, DataFrame, bool]:
    """(found(u, v, crowd), rows(fp) of large buckets, whether there are any) of labelled(fp: fingerprint, digest, label).

    Large buckets, of over REFINE_ROWS rows, are told by the tasks that come upon them. In an early round
    they are taken in parts: a row's nearest in a part is near enough. In the last, any two parts meet but those
    of a large bucket's commonest label: all pairs of differing labels, whatever the size of the bucket.
    """
    pairs_of = partial(_candidates, radius=index.radius, width=width, last=last)
    by, found = ["path", "key"], []

    def searched(dealt: DataFrame, most: int | None) -> DataFrame:
        out = written(_searched(dealt, pairs_of, most), "searched")
        freed(labelled.sparkSession)
        found.append(out.where("u is not null").select("u", "v", "crowd"))
        return out.where("fp is not null").select(*by, "fp")

    roots = index.roots()
    left = [searched(_dealt(labelled, index, roots[at : at + TABLES], None), REFINE_ROWS) for at in range(0, len(roots), TABLES)]
    crowded = reduce(DataFrame.unionByName, left)
    any_left = not crowded.isEmpty()
    if any_left:
        if last:
            rows = _met(crowded.withColumn("label", F.substring("fp", width + 9, 8)), by, F.lit(1), REFINE_ROWS // 2, "fp")
            parted = rows.select("path", F.xxhash64("key", "i", "j").alias("key"), "fp")
        else:
            sizes = written(crowded.groupBy(*by).count(), "large")
            part = F.pmod(F.xxhash64("fp"), F.ceil(2 * F.col("count") / REFINE_ROWS))
            parted = crowded.join(sizes, by).select("path", F.xxhash64("key", part).alias("key"), "fp")
        searched(parted, None)
    return reduce(DataFrame.unionByName, found), crowded.select("fp"), any_left


def _met(rows: DataFrame, by: list[str], weight: Column, most: int, spread: str) -> DataFrame:
    """rows(.., label) of each group, dealt to parts so that any two rows of differing labels meet in some pair (i, j) of parts.

    Parts have about `most` of the weight. Those of a group's commonest label, the last, don't meet each other; so a group of one large
    label and few others grows with its rows. part: the row's own; inside: of the pairs with part i, the one in which its rows meet each other.
    """
    sizes = rows.groupBy(*by, "label").agg(F.sum(weight).alias("n")).groupBy(*by)
    sizes = sizes.agg(F.max_by("label", "n").alias("top"), F.max("n").alias("most"), (F.sum("n") - F.max("n")).alias("others"))
    sizes = sizes.where("others > 0").withColumn("a", F.ceil(F.col("others") / most)).withColumn("b", F.ceil(F.col("most") / most))
    top, at = F.col("label") == F.col("top"), F.xxhash64(spread)
    placed = rows.join(written(sizes, "large"), by).withColumn("part", F.when(top, F.col("a") + F.pmod(at, "b")).otherwise(F.pmod(at, "a")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(top, F.col("a")).otherwise(F.col("a") + F.col("b")) - 1))).where("part <> other")
    met = met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).withColumn("inside", F.col("j") == F.col("a"))
    return met.drop("top", "most", "others", "a", "b", "other")


def crowd_pairs(crowds: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) that connect those rows of a crowd whose sets have a Jaccard similarity of `least` or more.

    crowds(node, root[, label]), sets(node, hashes); rows of one label are connected already. All pairs of a crowd's
    labels are looked at, in blocks of CROWD_ELEMENTS elements of sets of which two meet in a task; a task gives a forest, never its pairs.
    """
    rows = (crowds if "label" in crowds.columns else crowds.withColumn("label", F.col("node"))).join(sets, "node")
    met = _met(rows, ["root"], F.size("hashes") + 1, CROWD_ELEMENTS, "node").select("root", "i", "j", "part", "inside", "node", "label", "hashes")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("part").combine_chunks()
        nodes, sets_ = table.column("node"), table.column("hashes").chunk(0)
        sizes = sets_.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, ids = np.unique(sets_.flatten().to_numpy(), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        flag, filled = np.zeros(int(ids.max(initial=-1)) + 1, bool), np.flatnonzero(sizes)
        group = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        n_own = int((table.column("part").to_numpy() == table.column("i")[0].as_py()).sum())
        first = 0 if table.column("inside")[0].as_py() else n_own
        asked = filled[filled >= first]
        edges = []
        for a in filled[filled < n_own].tolist():
            wanted = (group[asked] != group[a]) & (np.minimum(sizes[asked], sizes[a]) >= least * np.maximum(sizes[asked], sizes[a]))
            if not wanted.any():
                continue
            mine = ids[starts[a] : starts[a] + sizes[a]]
            flag[mine] = True
            both = np.add.reduceat(flag[ids[starts[asked[0]] :]], starts[asked] - starts[asked[0]], dtype=np.int64)
            flag[mine] = False
            alike = asked[wanted & (both / (sizes[a] + sizes[asked] - both) >= least)]
            linked, at = np.unique(group[alike], return_index=True)
            edges += [(a, b) for b in alike[at].tolist()]
            group[np.isin(group, linked)] = group[a]
        u, v = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table({"u": nodes.take(pa.array(u)), "v": nodes.take(pa.array(v))})

    return met.groupBy("root", "i", "j").applyInArrow(compare, "u binary, v binary")


def banded_components(nodes: DataFrame, index: Bands, width: int, verified: Callable[[DataFrame], DataFrame], crowded: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of components over the pairs of nodes(node: fingerprint and digest) that bands find and verified() keeps.

    Rounds first pair each row with its nearest of another component, then all that lie between the
    components so found; a round takes only the rows that had a pair in the one before. verified(pairs(u, v))
    gives those that hold; crowded(crowds(node, root, label)) gives edges that connect what holds within crowds, where
    rows of one label are connected already.
    """
    cut = lambda c: F.substring(c, 1, width + 8)
    labelled = nodes.select(F.concat("node", F.substring("node", width + 1, 8)).alias("fp"))
    tried = edges = found = None
    for turn in range(ROUNDS + 1):
        last, began = turn == ROUNDS, mark()
        pairs, large, any_large = _round(labelled, index, width, last)
        pairs = pairs.select(cut("u").alias("u"), cut("v").alias("v"), "crowd")
        pairs = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "crowd").distinct(), "found")
        if not last:  # a row in no pair has no near row of another component, and never will; what was in a large bucket may have been passed over
            near = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
            near = written((near.unionByName(large.select(cut("fp").alias("node"))) if any_large else near).distinct(), "near")
        listed = pairs.where("not crowd").select("u", "v")
        listed = written(listed if tried is None else listed.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = listed if tried is None else tried.unionByName(listed)
        new = written(verified(listed), "similar")
        if last and not (crowd := written(pairs.where("crowd").select("u", "v"), "crowd-edges")).isEmpty():
            known = components(crowd)
            known = known.join(found.withColumnRenamed("root", "label"), "node", "left") if found is not None else known.withColumn("label", F.col("node"))
            new = new.unionByName(written(crowded(known.withColumn("label", F.coalesce("label", "node"))), "crowd-links"))
        edges = new if edges is None else edges.unionByName(new)
        found = components(edges)
        freed(nodes.sparkSession)
        if not last:
            label = F.when(F.col("root").isNotNull(), F.unhex(F.lpad(F.hex(F.xxhash64("root")), 16, "0")))
            labelled = near.join(found, "node", "left").select(F.concat("node", F.coalesce(label, F.substring("node", width + 1, 8))).alias("fp"))
            labelled = written(labelled, "labelled")
            dropped(nodes.sparkSession, began, "searched", "large", "found")
    return found


def _classes(rows: DataFrame, nodes: DataFrame, found: DataFrame, node: str, n_rows: int, n_nodes: int) -> DataFrame:
    """rows(.., node) with component_id: the least of nodes(node, least) in the node's component by found(node, root)."""
    classes = nodes.join(found.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    classes = written(classes, "classes")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(looked_up(classes, smallest, "root", n_nodes).select(node, "component_id"), "class-ids")
    return looked_up(rows, classes, node, n_rows)


def _star(crowds: DataFrame) -> DataFrame:
    """Edges that connect each crowd, for where nearness is all that is asked."""
    return crowds.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 3, agree: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary, component_id) of every row.

    component_id is the smallest id reachable over links of at most `radius` differing bits, the row's
    own included; null ids count as larger than all others. agree: None takes the exact index; else the
    share of bits in which the least similar pair that matters agrees on average, and bands find it but for
    a few in a hundred. Null and empty texts have the fingerprint zero and are linked like any other; rows with the
    same id or text each give a row; an empty table gives none; other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle, words, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    rows, of_rows = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 64 * words
    if agree is None:
        found = components(links(distinct.select("fp"), Blocks.plan(bits, radius, rows)))
    else:
        digest = F.unhex(F.lpad(F.hex(F.xxhash64("fp")), 16, "0"))
        found = banded_components(distinct.select(F.concat("fp", digest).alias("node")), Bands.plan(bits, radius, rows, agree), 8 * words, lambda pairs: pairs, _star)
        found = found.select(*(F.substring(c, 1, 8 * words).alias(c) for c in ("node", "root")))
    return _classes(fps, distinct.drop("n"), found, "fp", of_rows, rows).select(id_col, "fp", "component_id")


def shingle_sets(docs: DataFrame, shingle: int, words: int, id_col: str, text_col: str, with_set: bool) -> DataFrame:
    """(id, node binary[, hashes array<int>]) of every row: the fingerprint of the set of shingles with the set's XXH64, and
    the set by the first 32 bits of its hashes, which makes one of two in 65,000 elements equal to another of its set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, size, at = [], [], 0, 0
            for k, text in enumerate(batch.column(1)):
                h = np.unique(shingle_hashes(text.as_py(), shingle))  # one text at a time
                nodes.append(fingerprint(h, words) + xxhash.xxh64_digest(h.tobytes()))
                if not with_set:
                    continue
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                size += len(h)
                if size >= 1 << 18 or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at : k + 1], pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int32()))], names=[id_col, "node", "hashes"])
                    nodes, sets, size, at = [], [], 0, k + 1
            if not with_set:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary())], names=[id_col, "node"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, node binary" + (", hashes array<int>" if with_set else ""))


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs(u, v) whose sets(node, hashes) have a Jaccard similarity of `least` or more."""
    of = lambda c, h: sets.select(F.col("node").alias(c), F.col("hashes").alias(h))
    both = pairs.join(of("u", "hu"), "u").join(of("v", "hv"), "v")
    a, b = F.size("hu"), F.size("hv")
    alike = F.least(a, b) >= F.lit(least) * F.greatest(a, b)  # else no overlap is enough
    common = F.when(alike, F.size(F.array_intersect("hu", "hv"))).otherwise(0)
    return both.select("u", "v", common.alias("n"), (a + b).alias("all")).where((F.col("n") > 0) & (F.col("n") / (F.col("all") - F.col("n")) >= least)).select("u", "v")


def similar_documents(docs: DataFrame, shingle: int, words: int, radius: int, agree: float, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: components over pairs of texts whose sets of shingles have a Jaccard similarity of `least` or more.

    Candidates are pairs within the radius that bands find, as in near_duplicates, but fingerprints are of
    the sets; each pair is held against the sets themselves before it counts. Texts without words are
    alike. Rows with the same id or text each give a row; other columns are ignored.
    """
    made = written(shingle_sets(docs, shingle, words, id_col, text_col, False), "nodes")
    nodes = written(made.groupBy("node").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    rows, of_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held: list[DataFrame] = []

    def sets_of(ends: DataFrame) -> DataFrame | None:
        """The sets of nodes, with those that have come up before; nearly all do in the first round."""
        for known in held:
            ends = ends.join(known.select("node"), "node", "left_anti")
        ends = written(ends, "ends")
        if not ends.isEmpty():
            texts = shingle_sets(docs, shingle, words, id_col, text_col, True).drop(id_col)
            held.append(written(picked(texts, ends, "node").dropDuplicates(["node"]), "sets"))
            freed(docs.sparkSession)
        return reduce(DataFrame.unionByName, held) if held else None

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct())
        return pairs if sets is None else similar_pairs(pairs, sets, least)

    def crowded(crowds: DataFrame) -> DataFrame:
        crowds = written(crowds, "crowds")
        return crowd_pairs(crowds, sets_of(crowds.select("node")), least)

    found = banded_components(nodes.select("node"), Bands.plan(64 * words, radius, rows, agree), 8 * words, verified, crowded)
    return _classes(made, nodes.drop("n"), found, "node", of_rows, rows).select(id_col, "component_id")
