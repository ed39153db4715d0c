"""Encoding against the tokenizers library; packing laid out again."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeinth'sdlmrveST .!?0½ΣİßﬁÉé́\x1c\x85 \n<|>你😀"), max_size=40) | st.text(max_size=20))
def test_encoding_is_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.tokenizer(PATH).encode(text) == library(text)


def test_special_tokens_and_long_words():
    for text in ("<|endoftext|>a<|startoftext|>", "ab" * 3000, "!" * 999, "thethethe" * 50):
        ids = library(text)
        assert bpe.tokenizer(PATH).encode(text) == ids
        assert bpe.tokenizer(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_packed_texts_encode_a_word_once(monkeypatch):
    """Chunks that differ by what stands beside their words cost no encoding, in whatever group they are."""
    rng, encoded = random.Random(2), []
    words = ["".join(rng.choice("aeinthsr") for _ in range(rng.randint(4, 9))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) + rng.choice(".,!?;:") * rng.randint(0, 40) for _ in range(300)) for _ in range(40)]
    texts[3:3] = [None, "", " \n", "it's 'sab x'll ''s !'t 'S 12½", "Ab <|endoftext|> 's", "日本 É\u0301 ΣΑΣ İ\x1cq", "\U00020000 a", "\ufdd0\U0001f600x 's"]
    made = bpe.tokenizer(PATH).automaton
    encode = made.encode_words
    monkeypatch.setattr(made, "encode_words", lambda w, final: encoded.extend(w) or encode(w, final))
    monkeypatch.setattr(bpe, "_made", {})
    monkeypatch.setattr(bpe, "GROUP_CHARS", 5_000)
    packed = bpe.packed_ids(PATH)
    packed.group = 5_000
    assert [list(np.frombuffer(b"".join(x) if isinstance(x, list) else x, "<u4")) for x in packed.of_texts(texts)] == list(map(library, texts))
    assert max(Counter(w for w in encoded if w.decode() in words).values()) == 1


def test_packing_workers_hold_few_words(monkeypatch):
    """A worker goes on living in the pipeline's other stages, so what it keeps of texts is small."""
    monkeypatch.setattr(bpe, "_made", {})
    packed = bpe.packed_ids(PATH)
    texts = [" ".join("".join("abcdefghij"[int(d)] for d in str(n)) for n in range(k, k + 1_000)) for k in range(10**6, 10**6 + 450_000, 1_000)]
    got = [b"".join(x) if isinstance(x, list) else x for x in packed.of_texts(texts)]
    assert all(list(np.frombuffer(got[k], "<u4")) == library(texts[k]) for k in (0, 222, 449))
    assert len(packed.new) + len(packed.old) <= 200_000


def test_packing_leaves_no_words_behind(spark, docs):
    """What workers keep of texts goes when a task ends."""
    packing.pieces(docs.repartition(4), PATH, 4096, 2).collect()

    def kept(batches):
        list(batches)
        made = bpe._made.get((PATH, "packed"))
        yield pa.RecordBatch.from_pydict({"n": [-1 if made is None else len(made.new) + len(made.old)]})

    found = [r["n"] for r in spark.range(64).repartition(64).mapInArrow(kept, "n long").collect()]
    assert max(found) == 0


def test_automaton_is_merging_by_rank():
    rng = random.Random(1)
    for _ in range(30):
        tokens, merges = list("abc"), []
        while len(tokens) < 14:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        made = bpe.MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        made.index(lambda label: [ord(c) - 97 for c in label])
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i + 1 < len(parts):
                    if parts[i : i + 2] == [a, b]:
                        parts[i : i + 2] = [a + b]
                    i += 1
            symbols = bytes(ord(c) - 97 for c in word)
            for packed in (*made.encode_words([symbols], 0), made._encode_long(list(symbols))):
                assert [tokens[i] for i in np.frombuffer(packed, "<u4")] == parts


def test_digests(docs, empty, texts):
    def row(i, t):
        ids = library(t)
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, bpe.digest_documents(docs, PATH).collect())) == Counter(row(*x) for x in texts)
    assert bpe.digest_documents(empty, PATH).count() == 0
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, PATH).collect()}
    assert all(got[i]["ids"] == library(t) and got[i]["decoded"] == LIBRARY.decode(library(t), skip_special_tokens=False) for i, t in texts)


def check_packed(rows, wanted, capacity):
    """wanted: Counter of (doc_id, ids). Returns the share of padding."""
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append(r)
    assert sorted(bins) == list(range(len(bins)))
    padding = total = 0
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    for i, n in Counter(i for i, _ in wanted).items():
        ids = next(x for j, x in wanted if j == i)
        found = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in parts[i])
        assert all(k % n == 0 for k in found.values())
        at = 0
        for start, length, crc, tokens in sorted(found):
            assert start == at and tokens == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    return padding / (padding + total)


def test_packing(docs, empty, texts):
    wanted = [(i, (*library(t), 2)) for i, t in texts]
    for capacity in (4096, 64):
        share = check_packed(packing.pack(docs, PATH, capacity=capacity).collect(), wanted, capacity)
        assert share < (0.5 if capacity == 4096 else 0.05)
    assert packing.pack(empty, PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20000), st.sampled_from([64, 4096, 1000]))
def test_cuts(n, capacity):
    lengths = packing.cut_lengths(n, capacity)
    assert sum(lengths) == n and all(0 < x <= capacity for x in lengths)
