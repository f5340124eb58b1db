"""BPE encoding and decoding: forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged across, so a
text may be cut there: the fragments encode independently and their ids are concatenated. A cut
must also leave the pre-tokenizer's view of both sides alone, so it is only made between
characters, never after white space (the pattern looks ahead from it) and never before an
apostrophe (it may begin a contraction). Most fragments are single words, so each distinct one is
encoded once per task and looked up after that.

Added tokens of the file (``<|endoftext|>``) are taken out of the text first, as the library does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._tables import extended
from ._text import fragment_names, slices, utf8

#: Distinct fragments that a worker remembers; longer fragments are encoded each time.
REMEMBERED, LONGEST = 150_000, 48
#: Fragments encoded at once; ids decoded at once.
ENCODED, DECODED = 2000, 1 << 17
#: Bytes of text encoded at once.
ENCODED_BYTES = 1 << 19
NEVER = np.iinfo(np.int32).max
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # and the second bytes of U+00C0 to U+00FF
_LETTER[0x80:0xC0] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0].., sizes[0] of them, then starts[1].., and so on."""
    out = np.arange(int(sizes.sum()))
    return out + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of two sorted arrays, each once."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])]


class Vocabulary:
    """A byte-level BPE file with its table of certain cuts."""

    def __init__(self, path: str, specials: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("ignore_merges") or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE with the usual pre-tokens and without a normaliser")
        self.path, self.use_specials, self._tokenizer, self._flat = path, specials, None, None
        byte_of = _byte_of()
        ids = spec["model"]["vocab"]
        self.bytes = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])], default=-1) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.specials = []
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
            if specials:
                self.specials.append((t["content"].encode(), t["id"]))
        self.special_id = dict(self.specials)
        self.special = re.compile(b"|".join(re.escape(s) for s in sorted(self.special_id, key=len, reverse=True)) or b"(?!)")
        joined = [np.frombuffer(self.bytes[i], np.uint8).astype(np.int64) for i in ids.values()]
        free = np.ones(1 << 16, bool)
        for t in joined:
            free[t[:-1] << 8 | t[1:]] = False
        left, right = np.divmod(np.arange(1 << 16), 256)
        free &= ~np.isin(left, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
        free &= (left != 0x27) & (right != 0x27) & ((right < 0x80) | (right > 0xBF))
        self.free = free
        # last two bytes of white space beyond ASCII
        self.blank = np.zeros(1 << 16, bool)
        self.blank[[int.from_bytes(chr(c).encode()[-2:]) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0x180E, 0xFEFF)]] = True
        self.known: dict[bytes, np.ndarray] = {}
        # merges: an open table from pairs of ids to ranks
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = np.array([ids[x + y] for x, y in pairs], np.int32)
        self.keys, self.ranks = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, np.int32)
        for rank, (x, y) in enumerate(pairs):
            code = ids[x] << 32 | ids[y]
            place = (code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 43
            while self.keys[place] != -1:
                if self.keys[place] == code:
                    break
                place = (place + 1) & (len(self.keys) - 1)
            else:
                self.keys[place], self.ranks[place] = code, rank
        self.byte_id = np.array([ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int32)

    def cuts(self, data: bytes) -> np.ndarray:
        """Places in data where a fragment certainly begins, without 0."""
        b = np.frombuffer(data, np.uint8)
        if len(b) < 2:
            return np.empty(0, np.int64)
        pair = b[:-1].astype(np.uint16) << 8 | b[1:]
        cut = self.free[pair]
        cut[1:] &= ~self.blank[pair[:-1]]
        return np.flatnonzero(cut) + 1

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
            self._tokenizer.encode_special_tokens = not self.use_specials
        return self._tokenizer

    def _library(self, fragments: list[bytes]) -> list[np.ndarray]:
        """The ids of fragments by the library, remembered where they are short."""
        known = self.known
        out = [known.get(f) for f in fragments]
        new = [i for i, x in enumerate(out) if x is None]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        for a in range(0, len(new), ENCODED):
            part = new[a : a + ENCODED]
            for i, e in zip(part, self.tokenizer.encode_batch([fragments[i].decode() for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.int32)
                if len(fragments[i]) <= LONGEST:
                    known[fragments[i]] = out[i]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids among the merges, NEVER for pairs that don't merge (a negative id is none)."""
        code = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        code[(left < 0) | (right < 0)] = -2
        place = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        rank = np.full(code.shape, NEVER, np.int32)
        todo = np.arange(code.size)
        code, place, flat = code.ravel(), place.ravel(), rank.ravel()
        while len(todo):
            at = place[todo]
            key = self.keys[at]
            hit = key == code[todo]
            flat[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (key != -1)]
            place[todo] = (place[todo] + 1) & (len(self.keys) - 1)
        return flat.reshape(rank.shape)

    def _merge(self, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merges of many words at once: b has a word a row, size of its bytes count. The rows' ids in a row, and their sizes.

        As often as some word has a pair that merges, each word's pair of least rank (of equal ones the leftmost) becomes one id."""
        ids = np.where(np.arange(b.shape[1]) < size[:, None], self.byte_id[b], -1)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        live, size = np.arange(len(ids)), size.copy()
        columns = np.arange(b.shape[1])
        while len(live):
            part = rank[live]
            at = part.argmin(1)
            best = part[np.arange(len(live)), at]
            on = best < NEVER
            live, at, best = live[on], at[on], best[on]
            if not len(live):
                break
            row = np.arange(len(live))
            word = np.take_along_axis(ids[live], np.minimum(columns + (columns > at[:, None]), len(columns) - 1), 1)
            word[:, -1] = -1
            word[row, at] = self.made[best]
            part = np.take_along_axis(rank[live], np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), len(columns) - 2), 1)
            part[:, -1] = NEVER
            part[row, at] = self._rank(word[row, at], word[row, np.minimum(at + 1, len(columns) - 1)])
            part[at + 1 == len(columns), -1] = NEVER
            left = at > 0
            part[row[left], at[left] - 1] = self._rank(word[row[left], at[left] - 1], word[row[left], at[left]])
            ids[live], rank[live] = word, part
            size[live] -= 1
        return ids[columns < size[:, None]], size

    def pieces(self, data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the fragments of data that begin at `at` (its last is the end): which distinct one each is, and the distinct ones' ids in a row and sizes.

        Fragments are told apart by two 64-bit names and their lengths. Those that are plain words (a blank at most, then letters that are
        ASCII or Latin-1) are one pre-token and merged here together; the library encodes the others."""
        b = np.frombuffer(data, np.uint8)
        size = np.diff(at)
        one, two = fragment_names(data, at)
        order = np.argsort(one)
        new = np.ones(len(order), bool)
        new[1:] = one[order][1:] != one[order][:-1]
        first, which = order[new], np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        if (two[first][which] != two).any() or (size[first][which] != size).any():  # two fragments with one name
            first = which = np.arange(len(size))
        start, size = at[:-1][first], size[first]
        odd = ~_LETTER[b]
        odd[1:] |= (b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7))  # signs among the letters
        odd = np.concatenate([[0], np.cumsum(odd)])
        inner = np.minimum(start + (b[np.minimum(start, len(b) - 1)] == 0x20), start + size) if len(b) else start
        plain = (odd[start + size] == odd[inner]) & (size > 1) & (size <= LONGEST)
        sizes = np.zeros(len(first), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((1, 8), (8, 16), (16, LONGEST)):
            rows = np.flatnonzero(plain & (size > low) & (size <= high))
            if len(rows):
                cell = np.minimum(start[rows][:, None] + np.arange(high), len(b) - 1)
                ids, sizes[rows] = self._merge(b[cell], size[rows])
                found.append((rows, ids))
        rows = np.flatnonzero(~plain)
        if len(rows):
            ids = self._library([data[i : i + n] for i, n in zip(start[rows].tolist(), size[rows].tolist(), strict=True)])
            sizes[rows] = np.fromiter(map(len, ids), np.int64, len(ids))
            found.append((rows, np.concatenate(ids)))
        flat = np.empty(int(sizes.sum()), np.int32)
        begin = np.cumsum(sizes) - sizes
        for rows, ids in found:
            flat[ragged(begin[rows], sizes[rows])] = ids
        return which, flat, sizes

    def split_specials(self, text: bytes) -> list[bytes | int]:
        """The text's parts, with the ids of added tokens between them; the earliest, then longest, wins."""
        out: list[bytes | int] = []
        done = 0
        for m in self.special.finditer(text):
            out += [text[done : m.start()], self.special_id[m[0]]]
            done = m.end()
        return [*out, text[done:]]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and, for each text, where its ids begin (one more at the end)."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            for p in self.split_specials(t) if any(s in t for s, _ in self.specials) else [t]:
                parts.append(p)
                owner.append(k)
        data = b"".join(p for p in parts if isinstance(p, bytes))
        begin = np.concatenate([[0], np.cumsum([len(p) if isinstance(p, bytes) else 0 for p in parts])]).astype(np.int64)
        at = merged(self.cuts(data), begin)
        which, ids, sizes = self.pieces(data, at)
        size = sizes[which]
        flat = ids[ragged((np.cumsum(sizes) - sizes)[which], size)]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(at, begin)]
        special = [(i, p) for i, p in enumerate(parts) if not isinstance(p, bytes)]
        if special:
            flat = np.insert(flat, [upto[i] for i, _ in special], [p for _, p in special])
            upto = upto + np.concatenate([[0], np.cumsum([not isinstance(p, bytes) for p in parts])])
        return flat, upto[np.searchsorted(np.array([*owner, len(texts)]), np.arange(len(texts) + 1))]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens' bytes in a row, and how many each has."""
        if self._flat is None:
            self._size = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
            self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        size = self._size[ids]
        return self._flat[ragged((np.cumsum(self._size) - self._size)[ids], size)].tobytes(), size


@lru_cache(maxsize=4)
def vocabulary(path: str, specials: bool = True) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path, specials)


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (text, more) -> the columns of keep (all by default) and ids, an array of token ids.

    path must be readable on the executors. Null texts are empty; empty texts have no ids. A column
    of docs named ids is replaced. Rows stay as they are, repeated ones included."""
    path = path or default_vocabulary()
    kept = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    schema = extended(docs, kept, "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in slices(texts, ENCODED_BYTES):
                flat, at = known.encode(texts[a:b])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in kept), ids], names=[*kept, "ids"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about DECODED ids."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + DECODED, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (ids, more) -> the same columns and decoded, the text. Null or no ids give an empty text.

    A column named decoded is replaced; an id beyond the vocabulary is an error."""
    path = path or default_vocabulary()
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = extended(encoded, kept, "decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            column = batch["ids"]
            flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for a, b in _runs(at):
                data, size = known.decode(flat[at[a] : at[b]])
                upto = np.concatenate([[0], np.cumsum(size)])[at[a : b + 1] - at[a]].tolist()
                text = [data[i:j].decode("utf-8", "replace") for i, j in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in kept), pa.array(text, pa.string())], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)
