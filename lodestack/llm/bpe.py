"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts with one state that loops on every single symbol. Each merge
(left, right) -> joint, in order of rank, puts in one gadget: the arcs `left` now lead to a copy of
their target that lacks the arc `right`, and every state with an arc `left` gets an arc `joint` to
where `right` leads. What it then accepts is exactly what merging by rank produces, one path a word.
The arcs into a state all bear one label, so a state is named by the token read last; the sets of
arcs, which would be the square of the vocabulary, are kept as the differences that the gadgets made
and looked up through a table that fills as transitions are used.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: ASCII characters that are neither letters, digits nor white space.
PUNCTUATION = string.punctuation
#: The table of arcs has 2 to this power entries.
ARC_BITS = 21
#: Characters whose chunks are looked up together.
GROUP_CHARS = 2_000_000
#: Symbols up to which words are encoded side by side.
TOGETHER = 64
#: Entries a worker keeps of each table, twice where old ones are kept too; so memory is bounded.
TABLE_ENTRIES = 300_000
#: The same for single words, and the characters of texts whose words are found together.
WORD_ENTRIES, WORDS_GROUP_CHARS = 100_000, 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Tokens are numbers; `parts` has the two sides of merged ones, `rank` -1 for single symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.ids, self.rank, self.parts = vocab, [-1] * size, [(-1, -1)] * size
        self.labels = [""] * size
        for label, i in vocab.items():
            self.labels[i] = label
        self.rule: dict[int, int] = {}
        self.states = 1
        for k, (a, b) in enumerate(merges):
            left, right, joint = vocab[a], vocab[b], vocab[a + b]
            if max(self.rank[left], self.rank[right]) >= k or self.rank[joint] >= 0:
                raise ValueError(f"merge {k} uses a token before it is made, or makes one twice")
            self._gadget(k, left, right, joint)

    def _gadget(self, k: int, left: int, right: int, joint: int) -> None:
        if self._arc(left, right, k):
            self.states += 1  # the copy of left's target that lacks `right`
            self.rule[left << 32 | right] = k
        self.rank[joint], self.parts[joint] = k, (left, right)

    def _arc(self, last: int, token: int, until: int) -> bool:
        """Whether, after the gadgets of rank <= until, the state reached by `last` has the arc `token`."""
        rank, parts, rule = self.rank, self.parts, self.rule
        while True:
            cut = rule.get(last << 32 | token)
            if cut is not None and cut <= until:
                return False
            r, t = rank[last], rank[token]
            if r < 0 and t < 0:
                return True
            if t < r:  # the state was shared with the right part's until `last` was made
                last, until = parts[last][1], r - 1
            else:  # the arc was put where its left part had one
                token, until = parts[token][0], t

    def index(self, spell) -> None:
        """Lay the tokens out by their symbols as a hashed table of steps (node, symbol) -> node.

        spell(label) gives a label's symbols as numbers under 1024.
        """
        steps: dict[int, int] = {}
        ends = [-1]
        for label, token in self.ids.items():
            node = 0
            for symbol in spell(label):
                node = steps.setdefault(node << 10 | symbol, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = token
        self.steps, self.ends = steps, np.array(ends, np.int32)
        self.bits = (4 * len(steps)).bit_length()
        self.step_keys, self.step_nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for key, node in steps.items():
            at = int(self._slot(np.array([key]), self.bits)[0])
            while self.step_keys[at] >= 0:
                at = (at + 1) & (1 << self.bits) - 1
            self.step_keys[at], self.step_nodes[at] = key, node
        self.arc_keys, self.arc_open = np.full(1 << ARC_BITS, -1, np.int64), np.zeros(1 << ARC_BITS, bool)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where the symbols lead from the nodes; -1: nowhere. A symbol of -1 leads nowhere."""
        keys = nodes.astype(np.int64) << 10 | np.maximum(symbols, 0)
        at, out = self._slot(keys, self.bits), np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(symbols >= 0)
        while len(left):
            seen = self.step_keys[at[left]]
            hit = left[seen == keys[left]]
            out[hit] = self.step_nodes[at[hit]]
            left = left[(seen != keys[left]) & (seen >= 0)]
            at[left] = (at[left] + 1) & (1 << self.bits) - 1
        return out

    def _arcs(self, last: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """allowed() of many pairs, through a table that each new pair overwrites one entry of."""
        keys = last.astype(np.int64) << 32 | tokens
        at = self._slot(keys, ARC_BITS)
        out = self.arc_open[at]
        new = np.flatnonzero(self.arc_keys[at] != keys)
        if len(new):
            found, where = np.unique(keys[new], return_inverse=True)
            arcs = np.array([self._arc(k >> 32, k & 0xFFFFFFFF, 1 << 60) for k in found.tolist()])
            out[new] = arcs[where]
            slots = self._slot(found, ARC_BITS)
            self.arc_keys[slots], self.arc_open[slots] = found, arcs
            clash = self.arc_keys[slots] != found  # two new pairs of one slot: the entry must be of the pair it names
            self.arc_keys[slots[clash]] = -1
        return out

    def encode_words(self, words: list[bytes], final: int) -> list[bytes]:
        """The accepted path over each word's bytes, as little-endian unsigned 32-bit ids; final is added to a word's last symbol.

        All words go forward together: at each place that an accepted path reaches (there is one such
        path at most), the table leads through the tokens that begin there, and those that the path's
        last token has an arc for reach further places.
        """
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        ends = np.cumsum(lengths)
        symbols[ends - 1] += final
        order = np.argsort(lengths, kind="stable")
        while len(order) and lengths[order[-1]] > TOGETHER:  # few; side by side they would be mostly padding
            k = order[-1]
            out[k] = self._encode_long(symbols[ends[k] - lengths[k] : ends[k]].tolist())
            order = order[:-1]
        at, sizes = 0, lengths[order]
        while at < len(order):
            longest = max(8, int(sizes[at]) + 4)
            some = order[at : min(int(np.searchsorted(sizes, longest, "right")), at + (1 << 20) // longest)]
            wide = int(lengths[some[-1]])
            place = np.arange(wide) < lengths[some, None]
            block = np.full((len(some), wide), -1, np.int32)
            block[place] = symbols[((ends - lengths)[some, None] + np.arange(wide))[place]]
            for k, ids in zip(some.tolist(), self._encode_block(block, lengths[some])):
                out[k] = ids
            at += len(some)
        return out

    def _encode_long(self, symbols: list[int]) -> bytes:
        """One word's accepted path, place by place."""
        steps, ends, n = self.steps, self.ends.tolist(), len(symbols)
        last, came, arcs = [-2] * (n + 1), [0] * (n + 1), {}
        last[0] = -1
        for start in range(n):
            before, node = last[start], 0
            if before == -2:
                continue
            for end in range(start, n):
                node = steps.get(node << 10 | symbols[end])
                if node is None:
                    break
                token = ends[node]
                if token >= 0:
                    key = before << 32 | token
                    if start and key not in arcs:
                        arcs[key] = self._arc(before, token, 1 << 60)
                    if not start or arcs[key]:
                        last[end + 1], came[end + 1] = token, start
        out, end = [], n
        while end:
            if last[end] == -2:
                raise ValueError("a symbol is not in the vocabulary")
            out.append(last[end])
            end = came[end]
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def _encode_block(self, symbols: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        n, m = symbols.shape
        last, came = np.full((n, m + 1), -2, np.int32), np.zeros((n, m + 1), np.int32)
        last[:, 0] = -1
        for start in range(m):
            rows = np.flatnonzero(last[:, start] != -2)
            node, before = np.zeros(len(rows), np.int32), last[rows, start]
            for end in range(start, m):
                node = self._step(node, symbols[rows, end])
                on = node >= 0
                rows, node, before = rows[on], node[on], before[on]
                if not len(rows):
                    break
                token = self.ends[node]
                whole = np.flatnonzero(token >= 0)
                if start and len(whole):
                    whole = whole[self._arcs(before[whole], token[whole])]
                last[rows[whole], end + 1], came[rows[whole], end + 1] = token[whole], start
        rows, place, columns = np.arange(n), lengths.copy(), []
        if np.any(last[rows, place] == -2):
            raise ValueError("a symbol is not in the vocabulary")
        while np.any(place > 0):
            columns.append(np.where(place > 0, last[rows, place], -1))
            place = np.where(place > 0, came[rows, place], 0)
        if not columns:
            return [b""] * n
        path = np.stack(columns[::-1], axis=1)
        flat = path[path >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum((path >= 0).sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class WordBPE:
    """The tokenizer of a `word_bpe` file: NFC, lower case, split, byte symbols, merges with word ends.

    Its special tokens are found in the raw text, as the file's library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.newer = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.normalizer = Tokenizer.from_file(path).normalizer
        number = {c: b for b, c in enumerate(byte_symbols())}
        end = self.end

        def spell(label: str) -> list[int]:
            final = bool(end) and label.endswith(end)
            spelt = [number[c] for c in (label[: -len(end)] if final else label)]
            if final:
                spelt[-1] += 256  # a byte at a word's end is a symbol of its own
            return spelt

        self.automaton.index(spell)
        self.labels = {**{i: t for i, t in enumerate(self.automaton.labels)}, **{i: t for t, i in self.added.items()}}
        self.added_ids = {t: struct.pack("<I", i) for t, i in self.added.items()}

    def parts(self, chunk: str) -> list[str]:
        """Words and special tokens of a piece of text without white space (which is never part of a token)."""
        out: list[str] = []
        for part in self.split_added.split(chunk) if self.split_added and "<|" in chunk else [chunk]:
            if part in self.added:
                out.append(part)
            elif part:
                if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
                    # characters newer than this Python's tables: the library's own tables decide
                    out += [w for w, _ in self.newer.pre_tokenize_str(self.normalizer.normalize_str(part))]
                    continue
                if not part.isascii():
                    # letter by letter, as the library does: no rule for a sigma at a word's end
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                core = part.rstrip(PUNCTUATION)
                if core.isalpha():  # letters, then perhaps punctuation, which stays together
                    out.append(core)
                    if len(core) < len(part):
                        out.append(part[len(core) :])
                else:
                    out += self.words.findall(part)
        return out

    def encode_chunks(self, some: list[str]) -> list[bytes]:
        """Packed ids of each chunk; their words are encoded together, each once."""
        parts = [self.parts(c) for c in some]
        words = list({w: None for p in parts for w in p if w not in self.added_ids})
        ids = dict(zip(words, self.automaton.encode_words([w.encode("utf-8", "replace") for w in words], 256 if self.end else 0))) | self.added_ids
        return [b"".join([ids[w] for w in p]) for p in parts]

    def encode(self, text: str) -> list[int]:
        data = b"".join(self.encode_chunks(chunks(text)))
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids) -> str:
        """The labels of the path's arcs, parted by blanks (the file names no decoder)."""
        return " ".join(self.labels[i] for i in ids)


_SPACES = regex.compile(r"\s+")


def chunks(text: str) -> list[str]:
    """text between white space; str.split also parts at four separators that are none here."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in _SPACES.split(text) if x]
    return text.split()


_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


class Kept:
    """chunk -> a value made of its ids; the table in use becomes the old one when full, so memory is bounded."""

    def __init__(self, bpe: WordBPE, make=None, entries: int = TABLE_ENTRIES):
        self.bpe, self.make, self.entries = bpe, make, entries
        self.new: dict = {}
        self.old: dict = {}

    def values(self, docs: list[list[str]]) -> list[list]:
        """Of each document's chunks, the values."""
        out = [list(map(self.new.get, d)) for d in docs]
        gaps = [k for k, v in enumerate(out) if None in v]
        if gaps:
            missing = {c: self.old.get(c) for k in gaps for c, v in zip(docs[k], out[k]) if v is None}
            fresh = [c for c, v in missing.items() if v is None]
            ids = self.bpe.encode_chunks(fresh)
            missing.update(zip(fresh, map(self.make, ids) if self.make else ids))
            for k in gaps:
                out[k] = [missing[c] if v is None else v for c, v in zip(docs[k], out[k])]
            if len(self.new) + len(missing) > self.entries:
                self.old, self.new = self.new, {}
            self.new.update((c, v) for c, v in missing.items() if len(c) <= 64)
        return out

    def of_texts(self, texts: list[str | None]) -> Iterator[list]:
        """The values of each text's chunks; a null text has none."""
        group, size = [], 0
        for text in texts:
            group.append(chunks(text or ""))
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self.values(group)
                group, size = [], 0
        yield from self.values(group)


#: What a character is to the split into words; the last are left to the library's own tables.
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)


def character_kinds() -> np.ndarray:
    """The kind of each character under 2 to the power 17; that of the last one stands for all above, too."""
    every = "".join(map(chr, range(1 << 17)))
    kinds = np.full(1 << 17, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    kinds[[k for k, c in enumerate(every) if unicodedata.category(c) in ("Cn", "Cs")]] = UNSURE
    return kinds


class PackedTexts:
    """Texts -> their ids as little-endian unsigned 32-bit numbers.

    The words of a group of texts are found and told apart in arrays, and only distinct ones of some
    groups are looked up. Texts with special tokens or characters of an unsure kind go chunk by chunk.
    The table of words in use becomes the old one when full, so memory is bounded.
    """

    def __init__(self, bpe: WordBPE, entries: int = WORD_ENTRIES, group: int = WORDS_GROUP_CHARS, together: int = 8):
        self.bpe, self.entries, self.group, self.together, self.chunked, self.kinds = bpe, entries, group, together, Kept(bpe), character_kinds()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of_texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids; a null text has none. Texts are taken a group at a time."""
        found, group, size = [], [], 0
        for text in texts:
            group.append(text or "")
            size += len(text or "")
            if size >= self.group:
                found.append(self.words(group))
                group, size = [], 0
                if len(found) == self.together:
                    yield from self.ids(found)
                    found = []
        yield from self.ids([*found, self.words(group)])

    def forget(self) -> None:
        """Drop what is kept of texts."""
        self.new, self.old, self.chunked = {}, {}, Kept(self.bpe)

    def words(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, dict[int, bytes]]:
        """The words of all texts, how many there are up to each text's end, and the ids of those that go chunk by chunk."""
        special = self.bpe.split_added
        apart = {k for k, t in enumerate(texts) if special and "<|" in t and special.search(t)}
        # letter by letter, as the library does: no rule for a sigma at a word's end
        plain = ["" if k in apart else (t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ")).lower() for k, t in enumerate(texts)]
        while True:
            ends = np.cumsum([len(t) + 1 for t in plain], dtype=np.int64)
            text = "\n".join([*plain, "\n\n"])
            symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            kinds = np.take(self.kinds, symbols, mode="clip")
            unsure = np.flatnonzero(kinds == UNSURE)
            if not len(unsure):
                break
            for k in np.unique(np.searchsorted(ends, unsure, "right")).tolist():
                apart.add(k)
                plain[k] = ""
        starts = self.word_starts(symbols, kinds)
        rest = sorted(apart)
        ids = {k: b"".join(parts) for k, parts in zip(rest, self.chunked.values([chunks(texts[k]) for k in rest]))}
        return self.words_at(text, symbols, kinds, starts).dictionary_encode(), np.searchsorted(starts, ends), ids

    def ids(self, found: list[tuple]) -> Iterator[bytes]:
        every = pa.concat_arrays([words.dictionary for words, _, _ in found]).dictionary_encode()
        ids, codes, at = self.of_words(every.dictionary.to_pylist()), every.indices.to_numpy(), 0
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        for words, bounds, apart in found:
            code = codes[at : at + len(words.dictionary)][words.indices.to_numpy()]
            at += len(words.dictionary)
            n = sizes[code]
            till = np.concatenate([[0], np.cumsum(n)])
            flat = pool[np.repeat(first[code] - till[:-1], n) + np.arange(till[-1])].tobytes()
            ends = (4 * till[bounds]).tolist()
            for k, (a, b) in enumerate(zip([0, *ends], ends)):
                yield apart[k] if k in apart else flat[a:b]

    @staticmethod
    def word_starts(symbols: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where the words begin: runs of letters or of others, single numbers, and an apostrophe with the letters of a short form. Two line ends come last."""
        begins = np.empty(len(kinds), bool)
        begins[0] = True
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        mark = np.flatnonzero((symbols == ord("'")) & begins)
        one, two = symbols[mark + 1], symbols[mark + 1] << 8 | symbols[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        both = np.isin(two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (symbols[mark + 2] < 256)
        begins[mark[short | both] + 1] = False
        begins[mark[short] + 2] = True
        begins[mark[both] + 3] = True
        return np.flatnonzero(begins & (kinds != SPACE))

    @staticmethod
    def words_at(text: str, symbols: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
        data, solid = np.frombuffer(text.encode(), np.uint8), kinds != SPACE
        if len(data) == len(symbols):
            width = solid
        else:
            width = (1 + (symbols >= 0x80).view(np.uint8) + (symbols >= 0x800) + (symbols >= 0x10000)).astype(np.uint8)
            solid, width = np.repeat(solid, width), width * solid
        before = np.cumsum(width, dtype=np.int32)
        offsets = np.append(before[starts] - width[starts], before[-1]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        out = list(map(self.new.get, words))
        gaps = [k for k, v in enumerate(out) if v is None]
        if gaps:
            missing = {words[k]: self.old.get(words[k]) for k in gaps}
            fresh = [w for w, v in missing.items() if v is None]
            if fresh:
                missing.update(zip(fresh, self.bpe.automaton.encode_words(fresh, 256 if self.bpe.end else 0)))
            for k in gaps:
                out[k] = missing[words[k]]
            if len(self.new) + len(missing) > self.entries:
                self.old, self.new = self.new, {}
            self.new.update(islice(((w, v) for w, v in missing.items() if len(w) <= 64), self.entries))
        return out


_made: dict[tuple[str, str], Kept | PackedTexts] = {}


def packed_ids(path: str) -> PackedTexts:
    """One for each worker process and file."""
    key = (path, "packed")
    if key not in _made:
        _made[key] = PackedTexts(tokenizer(path))
    return _made[key]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with id and text -> (id, n_tokens, ids array<int>, decoded). A null text is an empty one."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) without sending ids or decoded text anywhere.

    ids_sha256 is of the decimal ids joined by one blank, decoded_sha256 of the decoded text in UTF-8.
    A null text is an empty one; rows with the same id each give a row; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        key = (path, "digest")
        if key not in _made:

            def digested(data: bytes) -> tuple[str, str, int]:
                ids = struct.unpack(f"<{len(data) // 4}I", data)
                return " ".join(map(str, ids)), bpe.decode(ids), len(ids)

            _made[key] = Kept(bpe, digested)
        kept = _made[key]
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for parts in kept.of_texts(batch.column(1).to_pylist()):
                parts = [p for p in parts if p[2]]
                nums, labels, ns = zip(*parts) if parts else ((), (), ())
                rows.append((sum(ns), sha(" ".join(nums).encode()).hexdigest(), sha(" ".join(labels).encode()).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
