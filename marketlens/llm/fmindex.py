"""An FM-index over the words of a run of documents: suffix order, transform, wavelet ranks, sampled places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling word hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def letters() -> np.ndarray:
    """Every byte's letter: digits, a-z and bytes of other scripts stand for themselves, A-Z for a-z, all else is 0."""
    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    word = ((b >= 48) & (b <= 57)) | upper | ((b >= 97) & (b <= 122)) | (b >= 128)
    return np.where(word, np.where(upper, b + 32, b), 0).astype(np.uint8)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Cutter:
    """Words of a byte buffer: their letters, starts, ends and hashes. A hash depends on the word alone."""

    def __init__(self):
        self.letters, self.up, self.down = letters(), powers(BASE, 0), powers(INVERSE, 0)

    def cut(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = self.letters[raw]
        edge = np.diff((low != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(self.up) <= len(raw):
            self.up, self.down = powers(BASE, len(raw)), powers(INVERSE, len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(low * self.up[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start]
        return low, start, end, h ^ (h >> np.uint64(31))


def offsets(size: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def codes(low: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every word, equal for equal letters only; with the hash and an occurrence of each number, in order of the hash."""
    values, first, code = np.unique(h, return_index=True, return_inverse=True)
    size = end - start
    at = offsets(size)
    same = size == size[first][code]
    here, there = at + np.repeat(start, size), at + np.repeat(start[first][code], size)
    differ = low[here] != low[np.minimum(there, len(low) - 1)]
    if same.all() and not differ.any():
        return values, first, code
    # Two words share a hash: number the words by hash and letters.
    words = [(int(x), low[a:b].tobytes()) for x, a, b in zip(h, start, end)]
    seen: dict = {}
    for i, w in enumerate(words):
        seen.setdefault(w, i)
    number = {w: k for k, w in enumerate(sorted(seen))}
    first = np.array([seen[w] for w in sorted(seen)], np.int64)
    return h[first], first, np.fromiter((number[w] for w in words), np.int64, len(words))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` (numbers from 0) in order, by doubling the sorted length of those still tied."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length() + 1) if n else 1
    length = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(length):
        key <<= bits
        key[: max(0, n - j)] |= text[j:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rows = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(rows):
        at = order[rows]
        key = rank[at] * (n + 2) + rank[np.minimum(at + length, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rows = rows[~(new & np.append(new[1:], True))]
        length *= 2
    return order


class Bits:
    """Ones before a place in a packed line of bits."""

    def __init__(self, packed: np.ndarray):
        self.words = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view("<u8")

    def ones(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def wavelet(text: np.ndarray, levels: int) -> list[np.ndarray]:
    """Packed bits of ``text`` level by level, highest bit first; each level puts the zeros of the one above before its ones."""
    out = []
    for level in range(levels - 1, -1, -1):
        one = (text >> level & 1).astype(bool)
        out.append(Bits.pack(one))
        text = np.concatenate([text[~one], text[one]])
    return out


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte: all lowest bytes, then the next ones. Small numbers leave zeros that compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplane(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


#: Columns of a stored shard: bytes and words of every document, gaps between word starts, word sizes, the dictionary (hashes, sizes, letters),
#: rows below each word, wavelet levels, marks of sampled rows and their places.
FIELDS = ["doc_sizes", "counts", "gaps", "sizes", "hashes", "dict_sizes", "dict_letters", "below", "levels", "marks", "places"]


def build(texts: list[bytes], cutter: Cutter, every: int = 8) -> dict[str, bytes]:
    """The index of a shard. Documents end in separators of their own, so no match runs from one into the next."""
    n_docs = len(texts)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    starts_at = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    low, start, end, h = cutter.cut(raw)
    counts = np.diff(np.searchsorted(start, starts_at))
    if len(start):
        values, first, code = codes(low, start, end, h)
    else:
        values, first, code = h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Words and separators in one line: the words of document d start at row heads[d], its separator follows them.
    heads = np.append(0, np.cumsum(counts + 1))
    text = np.empty(len(code) + n_docs, np.int64)
    ends = heads[1:] - 1
    word_rows = np.ones(len(text), bool)
    word_rows[ends] = False
    text[ends], text[word_rows] = np.arange(n_docs), code + n_docs
    order = suffix_order(text)
    before = np.maximum(text[order - 1] - n_docs + 1, 0)  # separators are 0 here
    below = n_docs + np.append(0, np.cumsum(np.bincount(code, minlength=len(values))))
    levels = wavelet(before, max(1, int(len(values)).bit_length()))
    sampled = (order % every == 0) | np.isin(order, heads[:-1])
    size = end - start
    letters_ = low[offsets(size[first]) + np.repeat(start[first], size[first])].tobytes()
    return {"doc_sizes": planes(np.diff(starts_at)), "counts": planes(counts), "gaps": planes(np.diff(start, prepend=0)), "sizes": planes(size), "hashes": values.tobytes(), "dict_sizes": planes(size[first]), "dict_letters": letters_,
            "below": planes(np.diff(below, prepend=0)), "levels": b"".join(x.tobytes() for x in levels), "marks": Bits.pack(sampled).tobytes(), "places": order[sampled].astype("<u4").tobytes()}


class Index:
    """A stored shard, ready for search."""

    def __init__(self, stored: dict[str, bytes]):
        counts = unplane(stored["counts"])
        self.counts, self.heads = counts, np.append(0, np.cumsum(counts + 1))
        self.doc_starts = np.append(0, np.cumsum(unplane(stored["doc_sizes"])))
        self.text_rows = int(self.heads[-1])
        self.hashes = np.frombuffer(stored["hashes"], np.uint64)
        self.dict_ends = np.cumsum(unplane(stored["dict_sizes"]))
        self.dict_letters = stored["dict_letters"]
        self.below = np.cumsum(unplane(stored["below"]))
        n_levels = max(1, len(self.hashes).bit_length())
        packed = np.frombuffer(stored["levels"], "<u8").reshape(n_levels, -1)
        self.levels = [Bits(x) for x in packed]
        self.zeros = [self.text_rows - int(x.before[-1]) for x in self.levels]
        self.marks, self.places = Bits(np.frombuffer(stored["marks"], "<u8")), np.frombuffer(stored["places"], "<u4").astype(np.int64)
        self.gaps, self.sizes = stored["gaps"], stored["sizes"]

    def code(self, word: bytes, h: np.uint64) -> int:
        """The word's number, from 1, or 0 where the shard lacks it; letters are compared."""
        for k in range(int(np.searchsorted(self.hashes, h)), int(np.searchsorted(self.hashes, h, "right"))):
            a, b = (int(self.dict_ends[k - 1]) if k else 0), int(self.dict_ends[k])
            if self.dict_letters[a:b] == word:
                return k + 1
        return 0

    def rank(self, code: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often ``code`` stands in the transform before each of ``at``."""
        line = [np.zeros(len(code), np.int64), *at]
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (code >> len(self.levels) - 1 - k & 1).astype(bool)
            for j, x in enumerate(line):
                ones = level.ones(x)
                line[j] = np.where(one, zeros + ones, x - ones)
        return [x - line[0] for x in line[1:]]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer; the symbol before a row is read on the way down."""
        x, start, code = row, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            one, ones, head = level.get(x), level.ones(x), level.ones(start)
            x, start = np.where(one, zeros + ones, x - ones), np.where(one, zeros + head, start - head)
            code = code << 1 | one
        return self.below[code - 1] + x - start

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the suffixes that start with each row of word numbers, last word first."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_rows, np.int64)
        live = np.flatnonzero((phrases > 0).all(1))
        hi[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            a, b = self.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.below[c - 1] + a, self.below[c - 1] + b
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the line of words of each row's suffix: back to a sampled row, then as many words forward."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, row = np.arange(len(rows)), rows
        while len(left):
            hit = self.marks.get(row)
            out[left[hit]] = self.places[self.marks.ones(row[hit])] + steps
            left, row, steps = left[~hit], row[~hit], steps + 1
            row = self.back(row) if len(row) else row
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word within the shard's bytes."""
        start = np.cumsum(unplane(self.gaps))
        return start, start + unplane(self.sizes)


class Phrases:
    """Phrases to search, once for all shards: distinct words with their hashes, and the phrases of each length."""

    def __init__(self, phrases: list[bytes]):
        words: dict[bytes, int] = {}
        by: dict[int, list[tuple[int, list[int]]]] = {}
        for k, p in enumerate(phrases):
            w = p.split(b" ")
            by.setdefault(len(w), []).append((k, [words.setdefault(x, len(words)) for x in w]))
        self.words = list(words)
        _, _, _, self.hashes = Cutter().cut(np.frombuffer(b" ".join(self.words) + b" ", np.uint8))
        self.by = {n: (np.array([k for k, _ in x]), np.array([w for _, w in x])) for n, x in by.items()}

    def hits(self, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, place and number of words of every occurrence in a shard."""
        code = np.fromiter(map(index.code, self.words, self.hashes), np.int64, len(self.words))
        out = []
        for n, (ids, words) in self.by.items():
            lo, hi = index.find(code[words])
            size = hi - lo
            if size.sum():
                rows = np.repeat(hi - np.cumsum(size), size) + np.arange(int(size.sum()))
                out.append((np.repeat(ids, size), index.locate(rows), np.full(len(rows), n)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def cut_text(text: bytes, cutter: Cutter) -> list[bytes]:
    low, start, end, _ = cutter.cut(np.frombuffer(text, np.uint8)) if text else (None, np.zeros(0, int), np.zeros(0, int), None)
    return [low[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]


def as_bytes(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """Texts as UTF-8 bytes, a few rows at a time; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for at in range(0, len(column), step):
        for t in column.slice(at, step).cast(kind).to_pylist():
            yield t or b""
