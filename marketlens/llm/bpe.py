"""Byte-level BPE: speculate with longest matches, verify every pair, merge exactly where that fails."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import worker_memory

# Fixed value: the split of a text into words, as the vocabulary file's pre-tokenizer states it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 itself, the others from U+0100 on."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    rest = iter(range(0x100, 0x200))
    return {chr(b if b in shown else next(rest)): b for b in range(256)}


class Bpe:
    """Encoder and decoder over the vocabulary of one tokenizer file, given as its JSON text.

    ``remember`` bounds the words and pairs kept between batches; what is forgotten is worked out again.
    """

    def __init__(self, text: str, remember: int = 300_000):
        spec = json.loads(text)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (1 + max([*self.id_of.values(), *self.special.values()]))
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        starts: dict[bytes, set[int]] = {}
        for b in self.id_of:
            if len(b) > 2:
                starts.setdefault(b[:3], {2, 1}).add(len(b))
        self.lengths = {b: sorted(x, reverse=True) for b, x in starts.items()}
        self.single = [self.id_of.get(bytes([b]), -1) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[self.id_of[a], self.id_of[b]] = (rank, self.id_of[a + b])
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.remember, self.words, self.pairs, self.alone = remember, {}, {}, {}
        self.opening, self.following = {}, {}  # white-space chunks at the start of a line, and after a space
        self.failed = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding of one word: the lowest rank first, the leftmost of equals."""
        return self._merge_short(word) if len(word) <= 24 else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        ids, known = [self.single[b] for b in word], self.merges
        found = [known.get(p) for p in zip(ids, ids[1:])]
        while best := min(filter(None, found), default=None):
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = known.get((ids[i - 1], ids[i]))
            if i < len(found):
                found[i] = known.get((ids[i], ids[i + 1]))
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def speculate(self, word: bytes) -> list[int]:
        """The longest token at each place; only lengths that some token with the same three bytes has are tried."""
        out, at, n, known, lengths = [], 0, len(word), self.id_of, self.lengths
        while at < n:
            for size in lengths.get(word[at : at + 3], (2, 1)):
                if (t := known.get(word[at : at + size])) is not None and at + size <= n:
                    out.append(t)
                    at += size
                    break
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are what their bytes encode to."""
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def learn(self, words: list[str]) -> None:
        """Encode unseen words: one batch of proposals, every adjacent pair checked, only failing words merged."""
        raw = [w.encode("utf-8") for w in words]
        plans = [self.speculate(w) for w in raw]
        size = np.fromiter(map(len, plans), np.int64, len(plans))
        flat = np.fromiter((t for p in plans for t in p), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(plans)), size)
        # A sequence is the encoding exactly if each token encodes to itself and each adjacent pair does.
        tokens, where = np.unique(flat, return_inverse=True)
        for t in tokens.tolist():
            if t not in self.alone:
                self.alone[t] = self.merge(self.bytes_of[t]) == [t]
        good = np.fromiter((self.alone[t] for t in tokens.tolist()), bool, len(tokens))[where]
        inside = owner[1:] == owner[:-1]
        code, back = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
        for c in code.tolist():
            if c not in self.pairs:
                self.pairs[c] = self.compatible(c >> 32, c & 0xFFFFFFFF)
        fits = np.fromiter((self.pairs[c] for c in code.tolist()), bool, len(code))[back]
        bad = np.unique(np.concatenate([owner[~good], owner[1:][inside][~fits]]))
        self.failed += len(bad)
        for i in bad.tolist():
            plans[i] = self.merge(raw[i])
        for w, p in zip(words, plans, strict=True):
            self.words[w] = np.array(p, "<u4").tobytes()

    def _words(self, pieces: list[list]) -> list[bytes]:
        """The ids of each list of words; words never seen before are learned together."""
        fresh = {w for words in pieces for w in words if w not in self.words}
        for w in [w for w in fresh if isinstance(w, tuple)]:
            self.words[w] = np.array([self.special[w[0]]], "<u4").tobytes()
            fresh.discard(w)
        if fresh:
            self.learn(sorted(fresh))
        return [b"".join(map(self.words.__getitem__, words)) for words in pieces]

    def _any_text(self, text: str) -> list:
        words: list = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            # Odd parts are the special tokens themselves; a tuple keeps them apart from words.
            words.extend([(part,)] if i % 2 else self.split.findall(part))
        return words

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        No word crosses a single space or line feed between two other characters, so texts without other
        white space are taken chunk by chunk from what is remembered; all others go word by word.
        """
        if max(len(self.words), len(self.opening), len(self.following)) > self.remember:
            self.words, self.opening, self.following = {}, {}, {}
        if len(self.pairs) > self.remember:
            self.pairs = {}
        feed = self._words([["\n"]])[0]
        out: list = []
        odd, again, first, rest = [], [], set(), set()
        for text in texts:
            lines = [line.split(" ") for line in (text or "").split("\n")]
            if not text or any(s in text for s in self.special) or list(chain.from_iterable(lines)) != text.split():
                odd.append((len(out), self._any_text(text or "")))
                out.append(None)
                continue
            coded = self._plain(lines, feed)
            if None in coded:
                first.update(line[0] for line in lines if line[0] not in self.opening)
                rest.update(c for line in lines for c in line[1:] if c not in self.following)
                again.append((len(out), lines))
            out.append(coded)
        done = iter(self._words([*(w for _, w in odd), *map(self.split.findall, [*first, *(" " + c for c in rest)])]))
        for i, _ in odd:
            out[i] = [next(done)]
        self.opening.update(zip(first, done))
        self.following.update(zip(rest, done))
        for i, lines in again:
            out[i] = self._plain(lines, feed)
        return list(map(b"".join, out))

    def _plain(self, lines: list[list[str]], feed: bytes) -> list[bytes | None]:
        """What is remembered of each chunk of a text, line by line."""
        coded: list = []
        for line in lines:
            coded.append(self.opening.get(line[0]))
            coded.extend(map(self.following.get, line[1:]))
            coded.append(feed)
        coded.pop()
        return coded

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _tokenizer(text: str) -> Bpe:
    memory = worker_memory()
    key = ("bpe", hash(text))
    if key not in memory:
        memory[key] = Bpe(text)
    return memory[key]


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[list]:
    """The texts of a batch in runs of about ``most`` characters, so that memory follows the run and not the batch."""
    run, size = [], 0
    for x in column:
        t = x.as_py()
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", carry: list[str] | None = None, ids: bool = True) -> DataFrame:
    """The ``carry`` columns in ``doc``, with ``n_tokens, ids_sha256, decoded_sha256`` and, if asked, the ``ids`` themselves.

    ``tokenizer`` is the JSON text of the vocabulary file (its size is that of the vocabulary); it goes to
    the executors as a broadcast. Texts are encoded whole, in runs of a few MB; the digest columns are taken
    from the ids (little-endian unsigned 32-bit) and from the text decoded out of them.

    A null or empty text has no ids; strings of special tokens in a text become those tokens; repeated rows are
    encoded each; no row is dropped; an empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_d"), F.col(f"`{text_col}`").alias("_t"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([src.schema["_d"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared.value)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("_t")):
                coded = bpe.encode(texts)
                columns = [batch.column("_d").slice(at, len(texts)), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                           pa.array([hashlib.sha256(bpe.decode(c).encode("utf-8")).hexdigest() for c in coded])]
                if ids:
                    columns.append(pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["_d", *[f.name for f in fields]])

    return src.mapInArrow(run, schema).select(F.col("_d").alias("doc"), *[f.name for f in fields])
