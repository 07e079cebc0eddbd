"""A language model by logistic context mixing, over the bits of a code of words.

A text is its lower-cased words and one end. Where the last words were followed elsewhere in the training texts by a
known passage, one bit says whether that passage follows; if it does, its words are done. Every other token is coded by
a path whose length follows its count; a word outside the model's vocabulary by the path of an escape and then by its
bytes, which have a code of their own. So a text is a string of bits, and the product of their probabilities is a
probability of the text.

Each bit is predicted in several hashed contexts from counts of zeros and ones. The predictions, stretched to log-odds,
are added with weights that a gate picks by how much the longer contexts have seen, and a table refines the result by
how such results came out before. Weights and refining table follow each document's own bits, the first of them every
64 bits; the documents of a lot go in step, so that each step is one array operation for all of them.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges

#: Bits of the slot numbers of the tables of words (by last frequent word, by last word): at least and at most. They
#: grow with the training tokens; what doesn't fit in the largest is shared by hashing.
LEAST_BITS, MOST_BITS = 14, 21
#: Bits of the slot numbers of bytes in contexts of 1, 2 and 4 bytes.
BYTE_BITS = (16, 20, 21)
#: Words that are a context by themselves when they came last; words that are coded whole. A node of the words' code
#: below which less than one word in RARE falls is left to the words' own counts, which contexts hardly change.
FREQUENT, VOCABULARY, RARE = 64, 1 << 18, 1 << 12
PRIOR, RATE, GATES, BUCKETS, MOST, INPUTS = 0.4, 0.02, 16, 33, 8.0, 3
#: Where a document's weights are updated: bits since its beginning; after the last one at every further STEP bits.
EDGES, STEP = (64, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096), 4096
#: Passages: words before one that name it; one word in so many begins one; words of one at most.
ANCHOR, PASSAGE, LONGEST = 4, 48, 256
#: Tokens and bytes of rare words that are turned into bits, and bytes of text that are turned into tokens at once.
TOKENS, TEXT = 40_000, 4 << 20
#: A run of one byte that is worth counting.
RUN = re.compile(rb"(.)\1{15,}", re.DOTALL)
#: The kinds of bits.
WORDS, BYTES, FLAGS = 0, 1, 2


def tokens(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words of some texts in turn, number of words of each text): whole texts, in lots of about TEXT bytes.

    A-Z is lower-cased and words are split at ASCII white space; a null text has no words.
    """
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT, side="right")))
        # A copy: Arrow's splitting reads a slice with an offset wrongly.
        some = column.take(pa.array(np.arange(at, upto))).cast(pa.large_string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(some, "")))
        words, per = split.flatten(), np.diff(np.asarray(split.offsets))
        blank = np.asarray(pc.binary_length(words)) == 0  # before the first word and after the last one
        if blank.any():
            owner = np.repeat(np.arange(len(per)), per)
            per = per - np.bincount(owner[blank], minlength=len(per))
            words = words.filter(pa.array(~blank))
        yield words, per
        at = upto


def code(counts: Iterable[int], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(above, side): the node above each symbol and then above each node, and the bit that leads down from there.

    Symbols in the given order are split where the counts (1 at least) halve, so that paths are about as long as a
    Huffman code's, and neighbours, such as words with a common beginning, share nodes, where contexts can tell them
    from others. The top node is 0 and has none above it (-1).
    """
    weight = np.maximum(np.array(list(counts), dtype=np.float64), 1)[order]
    upto, many = np.r_[0, np.cumsum(weight)], len(order)
    above, side = np.full(2 * many - 1, -1, dtype=np.int32), np.zeros(2 * many - 1, dtype=np.uint8)
    todo, nodes = deque([(0, many, -1, 0)]), 0
    while todo:
        a, b, up, bit = todo.popleft()
        if b - a < 2:
            above[order[a]], side[order[a]] = up, bit
            continue
        above[many + nodes], side[many + nodes] = up, bit
        half = (upto[a] + upto[b]) / 2
        at = int(np.searchsorted(upto[a : b + 1], half)) + a
        if at > a + 1 and half - upto[at - 1] < upto[at] - half:
            at -= 1
        at = min(max(at, a + 1), b - 1)
        todo.append((a, at, nodes, 0))
        todo.append((at, b, nodes, 1))
        nodes += 1
    return above, side


def paths(above: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, nodes, bits): the path of symbol s from the top is nodes[ptr[s]:ptr[s+1]] with the bits taken there."""
    many = (len(above) + 1) // 2
    steps, symbols, at = [], np.arange(many), np.arange(many)
    while len(symbols := symbols[above[at] >= 0]):
        at = at[above[at] >= 0]
        steps.append((symbols, above[at], side[at]))
        at = many + above[at]
    length = np.zeros(many, dtype=np.int64)
    for s, _, _ in steps:
        length[s] += 1
    ptr = np.r_[0, np.cumsum(length)]
    nodes, bits = np.zeros(ptr[-1], dtype=np.uint32), np.zeros(ptr[-1], dtype=np.uint8)
    for k, (s, node, bit) in enumerate(steps):
        nodes[ptr[s + 1] - 1 - k], bits[ptr[s + 1] - 1 - k] = node, bit
    return ptr, nodes, bits


def table_bits(tokens_: int) -> int:
    """Bits of the slot numbers of the tables of words for so many training tokens."""
    return min(MOST_BITS, max(LEAST_BITS, int(tokens_).bit_length() - 2))


def spread(context: np.ndarray) -> np.ndarray:
    """A context's share of the hash, to be repeated for the bits that it covers."""
    return context.astype(np.uint32) * np.uint32(0x9E3779B1)


def slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Where a spread context and a spread node meet in a table."""
    h = context ^ node
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.intp)


def spelling(word: bytes) -> bytes:
    """A word with its long runs of one byte written as the byte, a mark and their length in octal digits, all of bytes
    that UTF-8 doesn't have. So a word of 100,000 equal characters takes few bits, and can be told from all others."""
    return RUN.sub(lambda m: m[1] + b"\xf5" + bytes(0xF6 + int(d) for d in f"{len(m[0]):o}"), word) if len(word) > 32 else word


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit values."""
    h = values * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def passages(codes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, key, hash) of the passages of documents, whose words lie between the cuts.

    A passage ends where the next begins, or with its document. A document's first begins after ANCHOR words; others
    where a hash of the two words before says so, and after LONGEST words. key hashes the ANCHOR words before the
    passage, hash the words of it in their order.
    """
    n = len(codes)
    each = mixed(codes.astype(np.int64).view(np.uint64) + np.uint64(1))
    begins = np.zeros(n + 1, dtype=bool)
    begins[2:n] = mixed(each[1 : n - 1] + (each[: max(n - 2, 0)] << np.uint64(1)))[: max(n - 2, 0)] < np.uint64((1 << 64) // PASSAGE)
    for k in range(ANCHOR + 1):
        begins[np.minimum(cut[:-1] + k, cut[1:])] = False
    begins[(cut[:-1] + ANCHOR)[np.diff(cut) > ANCHOR]] = True
    doc_end = lambda at: cut[np.searchsorted(cut, at, side="right")]
    start = np.flatnonzero(begins[:n])
    end = np.minimum(np.r_[start[1:], n], doc_end(start)) if len(start) else start
    more = (end - start - 1) // LONGEST
    if more.any():
        begins[np.repeat(start, more) + LONGEST * (ranges(np.zeros(len(start), dtype=np.int64), more) + 1)] = True
        start = np.flatnonzero(begins[:n])
        end = np.minimum(np.r_[start[1:], n], doc_end(start))
    doc = np.searchsorted(cut, start, side="right") - 1
    if not len(start):
        return doc, start, end, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    key = each[start - 1] * np.uint64(3) + each[start - 2] * np.uint64(5) + each[start - 3] * np.uint64(7) + each[start - 4] * np.uint64(11)
    size = end - start
    inside = ranges(start, size)
    place = (inside - np.repeat(start, size)).astype(np.uint64)
    parts = mixed(each[inside] + place * np.uint64(0xD6E8FEB86659FD93))
    total = np.add.reduceat(parts, np.r_[0, np.cumsum(size)[:-1]])
    return doc, start, end, mixed(key), mixed(total + size.astype(np.uint64))


@dataclass
class Bits:
    """A stream of bits: the place of each in each table, its value, and where each document's bits begin."""

    slots: list[np.ndarray]
    bit: np.ndarray
    cut: np.ndarray
    kind: int


@dataclass
class Coder:
    """The vocabulary (most frequent first) and the codes; ids are positions in it, then the escape, then the end."""

    words: list[bytes]
    counts: list[int] | np.ndarray
    escapes: int
    ends: int

    def __post_init__(self) -> None:
        many = len(self.words)
        spelled = np.bincount(np.frombuffer(b" ".join(self.words) + b" ", dtype=np.uint8), minlength=256)
        self.trees = (
            code([*self.counts, self.escapes, self.ends], [many, many + 1, *sorted(range(many), key=self.words.__getitem__)]),
            code(spelled, list(range(256))),
        )
        self._unfold()

    def _unfold(self) -> None:
        self.escape, self.end = len(self.words), len(self.words) + 1
        self.bits = table_bits(int(np.sum(self.counts)) + self.escapes + self.ends)
        (ptr, nodes, bits), own = paths(*self.trees[0]), np.array([*self.counts, self.escapes, self.ends], dtype=np.float64)
        own = np.maximum(own, 1)
        weight = np.bincount(nodes, np.repeat(own, np.diff(ptr)), minlength=len(own))
        # Nodes come in turn from the top, so those that contexts predict are the first of a path.
        upper = weight[nodes] * RARE >= own.sum()
        size = np.add.reduceat(np.r_[upper, False].astype(np.int64), ptr[:-1]) if len(nodes) else np.zeros(len(own), dtype=np.int64)
        last = np.r_[nodes, 0][np.minimum(ptr[:-1] + size, len(nodes))]
        self.tail = np.where(size < np.diff(ptr), np.log2(np.maximum(weight[last], 1) / own), 0.0)
        self.above = np.bincount(nodes << np.uint32(1) | bits, np.repeat(own, np.diff(ptr)), minlength=2 * max(len(own) - 1, 1)).reshape(-1, 2)
        self.word_code = np.r_[0, np.cumsum(size)], (nodes << np.uint32(1) | bits)[upper]
        ptr, nodes, bits = paths(*self.trees[1])
        self.byte_code = ptr, nodes << np.uint32(1) | bits
        self.set = pa.array(self.words, type=pa.large_binary())

    def __getstate__(self) -> bytes:
        # Words hold no white space, so a space parts them; paths are unfolded again where they are used.
        return zlib.compress(pickle.dumps((b" ".join(self.words), self.counts, self.escapes, self.ends, self.trees)), 1)

    def __setstate__(self, state: bytes) -> None:
        words, self.counts, self.escapes, self.ends, self.trees = pickle.loads(zlib.decompress(state))
        self.words = words.split()
        self._unfold()

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(codes, at, rare): the id of each word, or a number below zero that hashes it, and the words that got one and
        their places."""
        words = words.cast(pa.large_binary())
        codes = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.set), self.escape), dtype=np.int32).copy()
        at = np.flatnonzero(codes == self.escape)
        rare = words.take(pa.array(at)).to_pylist()
        if rare:
            codes[at] = -1 - (np.fromiter(map(zlib.crc32, rare), dtype=np.int64, count=len(rare)) >> 1)
        return codes, at, rare

    @staticmethod
    def _path(code: tuple[np.ndarray, np.ndarray], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, bits, lengths) of the symbols' paths in turn."""
        ptr, steps = code
        start = ptr[symbols]
        length = ptr[symbols + 1] - start
        step = steps.take(ranges(start, length))
        return step >> np.uint32(1), (step & np.uint32(1)).astype(np.uint8), length

    def encode(self, codes: np.ndarray, cut: np.ndarray, rare: list[list[bytes]], told: np.ndarray | None = None) -> tuple[list[Bits], np.ndarray]:
        """The word bits and the byte bits of documents, and what the words' lower nodes cost each document; told says of
        each word whether a passage told it, so that only the others are coded; rare are the rare words among those."""
        many = len(cut) - 1
        ids = np.insert(np.where(codes < 0, np.int32(self.escape), codes), cut[1:], self.end)
        per = np.diff(cut) + 1
        prev = np.r_[np.int32(self.end), ids[:-1]]
        seen = np.where((prev < FREQUENT) | (prev == self.end), np.arange(len(ids)), 0)
        last = prev[np.maximum.accumulate(seen)]
        if told is not None and told.any():
            left = np.insert(~told, cut[1:], True)
            per = np.add.reduceat(left, np.r_[0, np.cumsum(per)[:-1]], dtype=np.int64)
            ids, prev, last = ids[left], prev[left], last[left]
        node, bit, length = self._path(self.word_code, ids)
        tails = np.bincount(np.repeat(np.arange(many), per), self.tail[ids], minlength=many)
        mark = node * np.uint32(0x85EBCA6B)
        bounds = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(per)]]
        word = Bits([node.astype(np.intp), slot(np.repeat(spread(last), length), mark, self.bits), slot(np.repeat(spread(prev), length), mark, self.bits)], bit, bounds, WORDS)

        spelled = [b" ".join(map(spelling, r)) + b" " if r else b"" for r in rare]
        flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        size = np.array([len(s) for s in spelled], dtype=np.int64)
        back, before = [], np.full(len(flat), 1, dtype=np.uint8)
        for k in range(1, 5):  # what precedes the word is always the same space, whatever the document before
            shifted = np.r_[np.full(min(k, len(flat)), 32, dtype=np.uint8), flat[:-k]][: len(flat)]
            before = np.where(before == 32, 32, shifted).astype(np.uint8)
            back.append(before.astype(np.uint32))
        node, bit, length = self._path(self.byte_code, flat.astype(np.int64))
        mark = node * np.uint32(0x85EBCA6B)
        one = back[0]
        two = one | back[1] << np.uint32(8)
        four = two | back[2] << np.uint32(16) | back[3] << np.uint32(24)
        slots = [(np.repeat(one << np.uint32(8), length) | node).astype(np.intp), slot(np.repeat(spread(two), length), mark, BYTE_BITS[1]), slot(np.repeat(spread(four), length), mark, BYTE_BITS[2])]
        return [word, Bits(slots, bit, np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(size)]], BYTES)], tails

    def empty_counts(self) -> list[np.ndarray]:
        """Counts of zeros and ones of each table that is counted: two of words, three of bytes."""
        return [np.zeros(2 << b, dtype=np.uint32) for b in (self.bits, self.bits, *BYTE_BITS)]


def flags(told: list[np.ndarray]) -> Bits:
    """The bits of passages that were expected: rows of (hit, how often it was seen, in three steps) for each document.

    The gate is given by these steps and by how many of the last three such bits were hits.
    """
    size = np.array([len(t) for t in told], dtype=np.int64)
    every = np.concatenate([np.zeros((0, 2), dtype=np.int64), *[t for t in told if len(t)]])
    before = np.zeros(len(every), dtype=np.int64)
    place = ranges(np.zeros(len(size), dtype=np.int64), size)
    for k in (1, 2, 3):
        shifted = np.r_[np.zeros(min(k, len(every)), dtype=np.int64), every[:-k, 0]][: len(every)]
        before += np.where(place >= k, shifted, 0)
    return Bits([np.minimum(before * 4 + every[:, 1], GATES - 1)], every[:, 0].astype(np.uint8), np.r_[0, np.cumsum(size)], FLAGS)


def count(tables: list[np.ndarray], streams: list[Bits]) -> None:
    word, byte = streams
    for table, slots, bit in zip(tables, [*word.slots[1:], *byte.slots], [word.bit] * 2 + [byte.bit] * 3, strict=True):
        np.add.at(table, slots * 2 + bit, np.uint32(1))


def bucket(total: np.ndarray) -> np.ndarray:
    """How much a context has seen, in four steps."""
    return (total > 0).astype(np.uint8) + (total > 3) + (total > 31)


@dataclass
class Mixer:
    """What each document begins with: the weights of each kind of bits and gate, and some results (zeros, ones) of each bucket
    of the refining table, by its own value."""

    weights: np.ndarray = field(default_factory=lambda: np.full((3, GATES, INPUTS), 0.4))

    def prior(self) -> np.ndarray:
        own = 1 / (1 + np.exp(-np.linspace(-MOST, MOST, BUCKETS)))
        return 20 * np.c_[1 - own, own]


@dataclass
class Predictor:
    """For each slot the stretched prediction, in twelfths, and in the last two bits its trust: one number to look up."""

    tables: list[np.ndarray]

    @classmethod
    def of(cls, nodes: np.ndarray, counts: list[np.ndarray]) -> Predictor:
        """From the counts of the words' nodes and those of the other tables, in integers or floats of any size."""
        tables = []
        for pairs in (nodes, *(t.reshape(-1, 2) for t in counts)):
            pairs = pairs.astype(np.float64)
            odds = np.log((pairs[:, 1] + PRIOR) / (pairs[:, 0] + PRIOR))
            tables.append((np.clip(np.rint(odds * 12), -127, 127).astype(np.int16) << 2) + bucket(pairs.sum(axis=1)))
        return cls(tables)

    def __getstate__(self) -> list[bytes]:
        return [zlib.compress(t.tobytes(), 1) for t in self.tables]

    def __setstate__(self, state: list[bytes]) -> None:
        self.tables = [np.frombuffer(zlib.decompress(t), dtype=np.int16) for t in state]

    def inputs(self, stream: Bits) -> tuple[list[np.ndarray], np.ndarray]:
        """(predictions of each table, gate) of each bit."""
        if stream.kind == FLAGS:
            return [np.ones(len(stream.bit), dtype=np.float32)], stream.slots[0].astype(np.intp)
        found = [t.take(s) for t, s in zip(self.tables[3 * stream.kind :], stream.slots, strict=False)]
        gate = (found[2] & 3) * np.int16(4) + (found[1] & 3)
        return [(v >> 2) * np.float32(1 / 12) for v in found], gate.astype(np.intp)


def steps_of(cut: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step (documents, from where, how many bits): what the documents' bits in cut are at that step."""
    size, found, at, number = np.diff(cut), [], 0, 0
    while True:
        upto = EDGES[number] if number < len(EDGES) else at + STEP
        docs = np.flatnonzero(size > at)
        if not len(docs):
            return found
        found.append((docs, cut[docs] + at, np.minimum(size[docs], upto) - at))
        at, number = upto, number + 1


def run(mixer: Mixer, predictor: Predictor, stream: Bits) -> np.ndarray:
    """The cost in bits of each document's bits. Each document begins with the mixer's weights and refining table, which
    follow its own bits, each step being predicted before it is learned from."""
    kind, many = stream.kind, len(stream.cut) - 1
    x, gate = predictor.inputs(stream)
    weights = [np.tile(mixer.weights[kind][:, j], many) for j in range(len(x))]
    results = np.tile(mixer.prior().reshape(-1), many)
    cost = np.zeros(many)
    scale, shift = np.float32((BUCKETS - 1) / (2 * MOST)), np.float32(MOST + 0.5 * 2 * MOST / (BUCKETS - 1))
    todo = steps_of(stream.cut)
    for number, (docs, start, size) in enumerate(todo):
        place = slice(start[0], start[0] + size[0]) if len(docs) == 1 else ranges(start, size)
        doc = np.repeat(docs, size)
        y = stream.bit[place]
        key = gate[place]
        key += doc * GATES
        xs = [v[place] for v in x]
        dot = np.zeros(len(y), dtype=np.float32)
        for w, v in zip(weights, xs, strict=True):
            dot += w.astype(np.float32).take(key) * v
        np.clip(dot, -MOST, MOST, out=dot)
        p = 1 / (1 + np.exp(-dot))
        at = ((dot + shift) * scale).astype(np.intp)
        at += doc * BUCKETS
        pairs = results.reshape(-1, 2)
        final = (pairs[:, 1] / pairs.sum(axis=1)).astype(np.float32).take(at)
        final += p
        final *= np.float32(0.5)
        chance = np.maximum(np.abs(final - (1 - y)), np.float32(2e-5)).astype(np.float64)
        # Up to 64 chances of a document are multiplied before each logarithm.
        parts = -(-size // 64)
        first = np.repeat(np.cumsum(size) - size, parts) + 64 * ranges(np.zeros(len(size), dtype=np.int64), parts)
        cost -= np.bincount(np.repeat(docs, parts), np.log2(np.multiply.reduceat(chance, first)), minlength=many)
        if number + 1 < len(todo):
            at *= 2
            at += y
            results += np.bincount(at, minlength=len(results))
            error = y - p
            step = np.zeros(many)
            step[docs] = RATE / np.sqrt(size)
            step = np.repeat(step, GATES)
            for j, v in enumerate(xs):
                weights[j] += step * np.bincount(key, error * v, minlength=many * GATES)
    return cost
