"""Near-dedup's last round: what a large bucket or a crowd holds is met whole, and what a task gives grows with its rows."""

import itertools

import numpy as np
import pytest
import xxhash

from lodestack.llm import simhash


def crowded_rows(rng, index, groups):
    """Rows fingerprint, digest and label that share the first band's bucket. groups: (rows, of them with the one common label), each near just its own."""
    band, rows = index.positions((0,))[0], []
    for n, common in groups:
        centre = rng.integers(0, 2, 256).astype(np.uint8)
        for k in range(n):
            bits = centre.copy()
            bits[rng.choice(256, 20, replace=False)] ^= 1
            bits[band] = 0
            fp = np.packbits(bits).tobytes()
            own = xxhash.xxh64_digest(fp)
            rows.append(fp + own + (b"commoner" if k < common else own))
    return rows


def far(a, b):
    return (int.from_bytes(a[:32], "big") ^ int.from_bytes(b[:32], "big")).bit_count()


def find(up, x):
    while up.get(x, x) != x:
        x = up[x]
    return x


# rows of other labels: under half of REFINE_ROWS, between half and the whole, several times that with no common label, several times that with one
@pytest.mark.parametrize("groups", [[(15, 0), (200, 199)], [(50, 0), (200, 199)], [(150, 0), (150, 0)], [(260, 60)]])
def test_large_buckets_of_the_last_round_meet_whole(spark, monkeypatch, groups):
    monkeypatch.setattr(simhash, "REFINE_ROWS", 64)
    monkeypatch.setattr(simhash, "SHIFT_RUN", 16)
    index = simhash.Bands(256, 62, 4, 1)
    rows = crowded_rows(np.random.default_rng(3), index, groups)
    found, _, any_large = simhash._round(spark.createDataFrame([(bytearray(r),) for r in rows], "fp binary"), index, 32, True)
    assert any_large
    listed, up = set(), {}
    for u, v, crowd in found.collect():
        if crowd:
            up[find(up, bytes(u))] = find(up, bytes(v))
        else:
            listed |= {(bytes(u), bytes(v)), (bytes(v), bytes(u))}
    near = [(a, b) for a, b in itertools.combinations(rows, 2) if a[-8:] != b[-8:] and far(a, b) <= 62]
    assert len(near) > 100
    assert [p for p in near if p not in listed and find(up, p[0]) != find(up, p[1])] == []


@pytest.mark.parametrize("size, shift_run", [(30, 128), (30, 16), (120, 128), (120, 16)])
def test_what_a_task_gives_grows_with_its_rows(monkeypatch, size, shift_run):
    monkeypatch.setattr(simhash, "SHIFT_RUN", shift_run)
    index = simhash.Bands(256, 62, 4, 1)
    rows = crowded_rows(np.random.default_rng(5), index, [(size, 0), (3, 0)])
    fps = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    pairs, crowd = simhash._candidates(fps, np.zeros(len(rows), np.int64), 62, 32, True)
    assert len(pairs) + len(crowd) <= len(rows)
    up = {}
    for a, b in [*pairs, *crowd]:
        up[find(up, a)] = find(up, b)
    assert all(find(up, a) == find(up, b) for a, b in itertools.combinations(range(len(rows)), 2) if far(rows[a], rows[b]) <= 62)


def test_crowds_of_labelled_rows(spark, monkeypatch):
    """Rows of one label count as connected; whatever the blocks, all others are held against each other."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(-(2**31), 2**31, 60)).astype(np.int32)
    rows = []
    for i in range(150):
        own = base.copy()
        own[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(-(2**31), 2**31, 1)
        label = bytes([200]) if i % 3 == 0 else bytes([i - i % 7]) if i % 2 else bytes([i])
        rows.append((bytes([i]), bytes([0]), label, [int(x) for x in np.unique(own)]))
    df = spark.createDataFrame(rows, "node binary, root binary, label binary, hashes array<int>")
    want = {}
    first = {}
    for n, _, label, _ in rows:
        want[find(want, n)] = find(want, first.setdefault(label, n))
    alike = [(a, b) for (a, _, la, x), (b, _, lb, y) in itertools.combinations(rows, 2) if la != lb and len({*x} & {*y}) / len({*x} | {*y}) >= 0.8]
    for a, b in alike:
        want[find(want, a)] = find(want, b)
    classes = lambda up: sorted(sorted(n for n, *_ in rows if find(up, n) == r) for r in {find(up, n) for n, *_ in rows})
    assert 1 < len(classes(want)) < 140
    for elements in (4_000_000, 900):
        monkeypatch.setattr(simhash, "CROWD_ELEMENTS", elements)
        edges = [(bytes(u), bytes(v)) for u, v in simhash.crowd_pairs(df.drop("hashes"), df.select("node", "hashes"), 0.8).collect()]
        assert set(edges) <= {*alike, *((b, a) for a, b in alike)}
        got = {}
        for n, _, label, _ in rows:
            got[find(got, n)] = find(got, first[label])
        for a, b in edges:
            got[find(got, a)] = find(got, b)
        assert classes(got) == classes(want)
