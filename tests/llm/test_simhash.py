"""Fingerprints and components against brute force."""

import random
import re
import string

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """index -> smallest index reachable."""
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_documents(docs, empty, texts):
    got = simhash.near_duplicates(docs).collect()
    ids = sorted({i for i, _ in texts})
    fps = [brute_fingerprint(dict(texts)[i]) for i in ids]
    root = dict(zip(ids, (ids[k] for k in brute_components(fps, 3))))
    assert sorted((r["doc_id"], int.from_bytes(r["fp"]), r["component_id"]) for r in got) == sorted((i, fps[ids.index(i)], root[i]) for i, _ in texts)
    assert simhash.near_duplicates(empty).count() == 0


def near_fps(rng, n):
    """Clusters, chains and loners of 64-bit fingerprints."""
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    for _ in range(n // 3):
        out.append(rng.choice(out) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    centre = rng.getrandbits(64)
    return out + [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n // 3)]


def linked(spark, fps, index):
    from lodestack.llm.common import components

    df = spark.createDataFrame([(bytearray(x.to_bytes(index.bits // 8)),) for x in sorted(set(fps))], "fp binary")
    return {int.from_bytes(r["node"]): int.from_bytes(r["root"]) for r in components(simhash.links(df, index)).collect()}


def test_links_are_whole_at_every_block_plan(spark, monkeypatch):
    fps = sorted(set(near_fps(random.Random(3), 300)))
    root = {fps[i]: fps[k] for i, k in enumerate(brute_components(fps, 3))}
    for blocks in (4, 5, 6):
        got = linked(spark, fps, simhash.Blocks(64, 3, blocks))
        assert {x: got.get(x, x) for x in fps} == root
    monkeypatch.setattr(simhash, "REFINE_ROWS", 20)  # hot buckets are dealt anew
    monkeypatch.setattr(simhash, "SHIFT_RUN", 8)
    got = linked(spark, fps, simhash.Blocks(64, 3, 4))
    assert {x: got.get(x, x) for x in fps} == root


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([0, 1, 3, 7, 12]))
def test_kernel(seed, radius):
    rng = random.Random(seed)
    fps = near_fps(rng, 90)
    run = np.sort(np.array([rng.randrange(4) for _ in fps]))
    m = np.frombuffer(b"".join(x.to_bytes(8) for x in fps), np.uint8).reshape(-1, 8)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if run[i] == run[j] and (fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(simhash._near_by_shifts(m, run, radius)) == want
    one = m[run == run[0]]
    forest = simhash._forest(simhash._grown(one, radius))
    local = [int.from_bytes(x.tobytes()) for x in one]
    root = dict(forest)
    assert [root.get(i, i) for i in range(len(local))] == brute_components(local, radius)


def test_bands_find_similar_texts(spark):
    rng = random.Random(9)
    rows = []
    for g in range(40):
        words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(300)]
        rows.append((2 * g, " ".join(words)))
        words[rng.randrange(300)] = "other"
        words[rng.randrange(300)] = "else"
        rows.append((2 * g + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, shingle=5, words=4, radius=50, agree=0.85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def near_copies(rng, n, flips, bits=256):
    """n distinct fingerprints around one centre, some of them nearer to each other than to it."""
    centre = rng.integers(0, 2, bits).astype(np.uint8)
    out = np.tile(centre, (n, 1))
    for row in out:
        row[rng.choice(bits, flips, replace=False)] ^= 1
    return np.packbits(out, axis=1)


def test_crowded_buckets_lose_no_group(spark, monkeypatch):
    """Near copies that fill every band's bucket are one class, and a verification that breaks them up is kept to."""
    monkeypatch.setattr(simhash, "REFINE_ROWS", 400)
    monkeypatch.setattr(simhash, "SHIFT_RUN", 64)
    rng = np.random.default_rng(1)
    for flips, radius in ((6, 30), (20, 62)):
        crowd = near_copies(rng, 3000, flips)
        loose = np.packbits(rng.integers(0, 2, (400, 256)).astype(np.uint8), axis=1)
        fps = sorted({x.tobytes() for x in np.vstack([crowd, loose])})
        df = spark.createDataFrame([(bytearray(x + xxhash.xxh64_digest(x)),) for x in fps], "node binary")
        found = simhash.banded_components(df, simhash.Bands.plan(256, radius, len(fps), 0.85), 32, lambda pairs: pairs, simhash._star).collect()
        assert len(found) == len({x.tobytes() for x in crowd}) and len({bytes(r["root"]) for r in found}) == 1
    first_bit = lambda c: F.hex(F.substring(c, 1, 1)) >= "80"
    half = lambda pairs: pairs.where(first_bit("u") == first_bit("v"))
    star = lambda crowds: crowds.groupBy(first_bit("node")).agg(F.min("node").alias("v"), F.collect_list("node").alias("us")).select(F.explode("us").alias("u"), "v")
    found = simhash.banded_components(df, simhash.Bands.plan(256, 62, len(fps), 0.85), 32, half, star).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(bytes(r["root"]), set()).add(bytes(r["node"])[0] >> 7)
    assert len(kinds) == 2 and all(len(k) == 1 for k in kinds.values()) and len(found) == len({x.tobytes() for x in crowd})


def test_crowds_meet_in_blocks(spark, monkeypatch):
    """Whatever the blocks, the classes of a crowd are those of brute force."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**31), 2**31, 60).astype(np.int32)
    rows = []
    for i in range(120):
        own = base.copy()
        own[rng.choice(60, rng.integers(0, 25), replace=False)] = rng.integers(-(2**31), 2**31)
        rows.append((bytes([i]), bytes([0]) if i < 100 else bytes([100]), [int(x) for x in np.unique(own)]))
    rows.append((bytes([250]), bytes([0]), []))
    df = spark.createDataFrame(rows, "node binary, root binary, hashes array<int>")
    up = {n: n for n, _, _ in rows}
    for a, ra, x in rows:
        for b, rb, y in rows:
            if a < b and ra == rb and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8:
                p, q = up[a], up[b]
                up = {k: min(p, q) if v in (p, q) else v for k, v in up.items()}
    for elements in (4_000_000, 700):
        monkeypatch.setattr(simhash, "CROWD_ELEMENTS", elements)
        from lodestack.llm.common import components

        edges = simhash.crowd_pairs(df.select("node", "root"), df.select("node", "hashes"), 0.8)
        got = {bytes(r["node"]): bytes(r["root"]) for r in components(edges).collect()}
        assert {n: got.get(n, n) for n in up} == up


def test_components(spark, monkeypatch):
    """Chains, hubs and loners, as trees in one task and by stars over many parts."""
    from lodestack.llm import common

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(2500)] + [(5000 + rng.randrange(400), 5000 + rng.randrange(400)) for _ in range(300)] + [(9, 9), (7000, 7001), (7001, 7000)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up}
    for together in (250_000, 60):
        monkeypatch.setattr(common, "EDGES_TOGETHER", together)
        got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: r for x, r in want.items() if x in got} and {x for x in want if want[x] != x} <= set(got)
