"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is coded word by word, a word byte by byte, a byte as binary decisions down a Huffman tree chosen by
the byte before it. For every decision six predictors give a logit: the tree itself, the last three and the
last five bytes of the word, the word so far, the word so far after the word before it (all counted over the
whole training text, in hashed tables that grow with it), and the word so far in this document, counted as it is read.
Pairs of words that are expected often have a table of their own; all other pairs are counted too, in one that they share.
A first layer mixes what depends on the word alone, with weights chosen by a gate (how often the long contexts
have been seen), so that a word's own logits are worked out once a worker. A second layer adds the word before and the
document, with gated weights that each document refines as it goes on, every 32 bytes at first.
"""

from __future__ import annotations

import contextlib
import heapq
import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from stemline.llm.common import checkpoint, held, let_go, table

#: Bytes of a word that are spelt together; longer words go in pieces, each as if a word began.
PIECE = 48
#: Words that have a place in the tree, the most frequent that occur twice or more; all others are spelt behind an escape.
#: Every worker holds their decisions (10 MB of words, 40 MB of decisions) and counts; the others' counts meet the documents in a join.
FREQUENT = 200_000
#: Context lengths of the hashed predictors of spelt words; the word so far is the third.
ORDERS = (3, 5)
#: Bits of a slot number, 2 bytes a slot: tables grow with the distinct words and with all words up to these, the memory of a worker.
#: Pairs beyond half of their table, the rarest to be expected (see pair_floor), share the slots of a second one, as large.
LEAST_BITS, WORD_BITS, PAIR_BITS = 14, (20, 22, 22), 23
#: Weights are fitted to all training documents and words, by a last Newton step; one in so many (by a hash) gives it its start, in so many steps.
FIT_SHARE, FIT_STEPS = 32, 3
#: Bytes after which a document's weights learn: STEP at first, then a part of what was read; and their rate.
STEP, PART, RATE = 32, 16, np.float32(0.015)
#: Decisions and documents scored side by side; a text of more than a window goes in windows of so many decisions, its weights going on.
SIDE, LANES, WINDOW = 1 << 18, 1000, 1 << 20
#: Decisions side by side where nothing is learnt on the way: fewer stay in the processor's cache.
FIT_SIDE = 1 << 16
#: Decisions of a gate that are summed together: what is worked out for them stays in the processor's cache.
SORTED = 1 << 13
#: Bytes of text that are looked up together.
LOOKED_UP = 1 << 20
#: Distinct tokens that a task counts before it hands them on.
HELD_TOKENS = 300_000
#: Slices of a table that are summed apart.
SLICES = 64
#: Rows that a worker is given at once: Spark's 10,000 texts are held by the JVM and by the worker, several times over.
ROWS = 1000

END = b"\n"  # never part of a token
_KEEP = b" "  # before the keys of pieces of long words


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def keys_of(tokens: list[bytes]) -> list[bytes]:
    """Tokens as they are counted: with the end, long ones as digests."""
    if tokens and max(map(len, tokens)) >= PIECE:
        tokens = [t if len(t) < PIECE else END + xxh128_digest(t) for t in tokens]
    return [*tokens, END]


def pieces_of(tokens: list[bytes]) -> list[bytes]:
    """Names of what is coded one after the other: words, pieces of long ones, the end."""
    if not tokens or max(map(len, tokens)) < PIECE:
        return [*tokens, END]
    out = []
    for t in tokens:
        if len(t) < PIECE:
            out.append(t)
        else:
            whole = len(t) // PIECE * PIECE
            out += [_KEEP + t[k : k + PIECE] for k in range(0, whole, PIECE)]
            out.append(_KEEP + t[whole:] + b" ")
    return [*out, END]


class Tokens:
    """Tokens of texts: `names` are the distinct ones, the end behind them; `code` has the names' places, text after text, each with its end; `count` says how many each text has."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        listed, count = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy().astype(np.int64)
        code, names = listed.indices.to_numpy(), listed.dictionary.cast(pa.string())
        # no token holds white space, so that all of them are split at once
        self.names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), " ")[0].as_buffer().to_pybytes().split()
        if len(self.names) < len(names):  # what stands before leading and behind trailing white space
            empty = pc.index(names, "").as_py()
            blank = code == empty
            count -= np.diff(np.concatenate([[0], np.cumsum(blank)])[np.concatenate([[0], np.cumsum(count)])])
            code = code[~blank]
            code = code - (code > empty)
        self.code, self.count = np.insert(code.astype(np.intp), np.cumsum(count), len(self.names)), count + 1
        self.names.append(END)
        self.first = np.cumsum(self.count) - self.count

    def numbers(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of what is coded, how many each text has, number of each name, -1 for those of several pieces)."""
        if max(map(len, self.names)) < PIECE:
            found = words.numbers(self.names)
            return found.take(self.code), self.count, found
        pieces = [[n] if len(n) < PIECE else pieces_of([n])[:-1] for n in self.names]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start, found = np.cumsum(size) - size, words.numbers(list(chain.from_iterable(pieces)))
        each = size.take(self.code)
        flat = np.arange(each.sum()) + np.repeat(start.take(self.code) - (np.cumsum(each) - each), each)
        whole = np.fromiter((len(n) < PIECE for n in self.names), bool, len(self.names))
        return found.take(flat), np.add.reduceat(each, self.first), np.where(whole, found.take(start), -1)


def coded(name: bytes) -> bytes:
    """The bytes that a name stands for; no such string begins another one."""
    return name if name == END else name[1:] if name.startswith(_KEEP) else name + b" "


class Table:
    """A large array that is broadcast. It is read into memory of NumPy's own, which comes in large pages where the system has them; scattered lookups in 4 kB pages take three times as long."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __reduce_ex__(self, protocol):
        values = np.ascontiguousarray(self.values)
        return _read_table, (pickle.PickleBuffer(values) if protocol >= 5 else values.tobytes(), values.dtype.str)


def _read_table(data: bytes, kind: str) -> Table:
    return Table(np.frombuffer(data, kind).copy())


# ---- counts as states: two numbers of 8 bits, whole up to 127, then in steps of an eighth of a power of two

def quantised(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts, 1).astype(np.float64)
    steps = np.where(counts < 128, counts, np.minimum(255, 127 + np.rint(8 * np.log2(n / 127))))
    return steps.astype(np.uint8)


def _lookups() -> tuple[np.ndarray, np.ndarray]:
    q = np.arange(256)
    n = np.where(q < 128, q, 127 * 2.0 ** ((q - 127) / 8))
    n0, n1 = np.repeat(n, 256), np.tile(n, 256)
    logit = np.where(n0 + n1 > 0, np.log((n1 + 0.2) / (n0 + 0.2)), 0)
    return logit.astype(np.float32), np.searchsorted([1, 2, 4, 16], n0 + n1, side="right").astype(np.uint8)


#: By state (count of 0 in the high byte, of 1 in the low one): logit, and how often seen (0, 1, 2 to 3, 4 to 15, more).
LOGIT, SEEN = _lookups()
CLASSES = 5
#: Bounds of a logit, and one, as numbers of its kind.
LEAST, MOST, ONE = np.float32(-30), np.float32(30), np.float32(1)
GATES = CLASSES * CLASSES
#: What the longer of two contexts adds to the gate.
GATE = SEEN * np.uint8(CLASSES)


def _without() -> np.ndarray:
    states = np.arange(1 << 16)
    n0, n1 = states >> 8, states & 0xFF
    return np.concatenate([states - 256 * ((n0 > 0) & (n0 < 128)), states - ((n1 > 0) & (n1 < 128))]).astype(np.uint16)


#: States without a 0, then without a 1.
_LESS = _without()


def without(states: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """States without one decision of their own."""
    at = bit.astype(np.intp)
    at <<= 16
    at |= states
    return _LESS.take(at)


# ---- binary decisions

class Trees:
    """For each byte before, a Huffman tree over the 256 bytes; digrams: 256 x 256 counts."""

    def __init__(self, digrams: np.ndarray):
        starts, sizes, nodes, bits = [], [], [], []
        prior = np.zeros((256, 256), np.float32)
        for prev in range(256):
            row = digrams[prev].astype(float)
            row = np.maximum(row, (row.sum() + 256) / 16384)
            heap = [(w, s, s) for s, w in enumerate(row.tolist())]
            heapq.heapify(heap)
            made, weight = [], dict(enumerate(row.tolist()))
            while len(heap) > 1:
                (a, _, i), (b, _, j) = heapq.heappop(heap), heapq.heappop(heap)
                k = 256 + len(made)
                made.append((i, j))
                weight[k] = a + b
                heapq.heappush(heap, (a + b, k, k))
            path: dict[int, tuple] = {256 + len(made) - 1: ()}
            for k in range(len(made) - 1, -1, -1):
                i, j = made[k]
                here = path[256 + k]
                path[i], path[j] = (*here, (k, 0)), (*here, (k, 1))
                prior[prev, k] = min(10.0, max(-10.0, math.log(weight[j] / weight[i])))
            for s in range(256):
                starts.append(len(nodes))
                sizes.append(len(path[s]))
                nodes += [k for k, _ in path[s]]
                bits += [b for _, b in path[s]]
        self.start, self.size = np.array(starts, np.int64), np.array(sizes, np.int64)
        self.node, self.bit, self.prior = np.array(nodes, np.uint8), np.array(bits, np.uint8), prior.ravel()


_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.multiply.accumulate(np.full(PIECE + 1, 0x9E3779B97F4A7C15, np.uint64))


def _laid_out(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, positions to predict, first position of each string): blanks before each, as many as the longest order."""
    pad = b" " * max(ORDERS)
    x = np.frombuffer(b"".join([pad + s for s in strings]), np.uint8)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.cumsum(size + len(pad)) - size
    at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    return x, at, first


def pair_counts(names: list[bytes], n: np.ndarray) -> np.ndarray:
    """65,536 counts of neighbouring bytes, a blank standing before each string."""
    strings = [coded(k) for k in names]
    x, at, _ = _laid_out(strings)
    weight = np.repeat(n.astype(np.float64), np.fromiter(map(len, strings), np.int64, len(strings)))
    return np.bincount(x[at - 1].astype(np.int64) << 8 | x[at], weights=weight, minlength=1 << 16)


class Decisions:
    """The decisions of strings, each coded as if a word began with it."""

    def __init__(self, trees: Trees, strings: list[bytes], short: bool = True):
        """Without `short`, the hashes of the last bytes are left out."""
        x, at, first = _laid_out(strings)
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        prev = x[at - 1].astype(np.intp)
        code = prev << 8 | x[at]
        count = trees.size.take(code)
        of = np.repeat(np.arange(len(at)), count)
        flat = np.arange(len(of)) + (trees.start.take(code) - (np.cumsum(count) - count)).take(of)
        node, self.bit = trees.node.take(flat), trees.bit.take(flat)
        self.size = np.add.reduceat(count, np.cumsum(length) - length) if len(strings) else count  # of each string
        self.prior = trees.prior.take((prev << 8).take(of) | node)
        wide = node.astype(np.uint32)
        h, last = np.zeros(len(at), np.uint32), []
        for k in range(1, max(ORDERS) + 1 if short else 0):
            h = (h + x[at - k] + np.uint32(k)) * np.uint32(0x2C9277B5)
            h ^= h >> np.uint32(15)
            if k in ORDERS:
                last.append(((h * np.uint32(0x85EBCA6B)).take(of) + wide * np.uint32(0x9E3779B1)) * np.uint32(0xC2B2AE35))
        # the word so far: a sum of its bytes' numbers, each times a power that goes with its place
        inside = at - np.repeat(first, length)
        total = np.cumsum(_BYTE[x[at]] * _POWER[inside])
        before = np.concatenate([[np.uint64(0)], total[:-1]]) if len(total) else total
        begin = np.cumsum(length) - length
        so_far = before - np.repeat(before[begin], length)
        so_far = ((so_far ^ so_far >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        word = (so_far.take(of) + wide * np.uint32(0x9E3779B1)) * np.uint32(0xC2B2AE35)
        #: Hashes of the three contexts with the node; the last one is the word so far.
        self.hashes = [*last, word ^ word >> np.uint32(15)]


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.intp)


class Spelling:
    """The first layer: states within words, and weights by gate over (tree, 3 bytes, 5 bytes, word, one)."""

    inputs = len(ORDERS) + 3

    def __init__(self, trees: Trees, states: list[np.ndarray] | None = None, weights: np.ndarray | None = None):
        self.trees, self.states = trees, states
        self.weights = np.full((GATES, self.inputs), 0.3, np.float32) if weights is None else weights

    def __reduce__(self):
        return _read_spelling, (self.trees, None if self.states is None else [Table(s) for s in self.states], self.weights)

    def predictors(self, d: Decisions, own_out: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """(logits of the inputs, gate) of each decision; own_out: as if the decision hadn't been counted."""
        found = [s.take(slots(h, len(s).bit_length() - 1)) for s, h in zip(self.states, d.hashes)]
        if own_out:
            found = [without(s, d.bit) for s in found]
        found = [s.astype(np.intp) for s in found]
        gate = (GATE.take(found[-1]) + SEEN.take(found[-2])).astype(np.intp)
        return [d.prior, *(LOGIT.take(s) for s in found), np.ones(len(d.bit), np.float32)], gate

    def logits(self, d: Decisions) -> np.ndarray:
        if self.states is None:
            return d.prior
        inputs, gate = self.predictors(d)
        return mixed(inputs, self.weights, gate)


def _read_spelling(trees: Trees, states: list[Table] | None, weights: np.ndarray) -> Spelling:
    return Spelling(trees, None if states is None else [t.values for t in states], weights)


def mixed(inputs: list[np.ndarray], weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    out = np.zeros(len(gate), np.float32)
    for w, s in zip(np.ascontiguousarray(weights.T), inputs):
        out += w.take(gate) * s
    return out


def newton_sums(inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weights: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """(gates, inputs + inputs^2): the loss's gradient and curvature in the weights, summed by gate."""
    k = len(inputs)
    out = np.zeros((len(weights), k + k * k))
    order, upto = np.argsort(gate.astype(np.uint8), kind="stable"), np.cumsum(np.bincount(gate, minlength=len(weights)))
    for g, (a, b) in enumerate(zip([0, *upto[:-1].tolist()], upto.tolist())):
        for c in range(a, b, SORTED):
            at = order[c : min(b, c + SORTED)]
            x = np.stack([s.take(at) for s in inputs])
            dot = weights[g] @ x
            p = 1 / (1 + np.exp(-np.minimum(np.maximum(dot, LEAST), MOST)))
            slope, bend = bit.take(at) - p.astype(np.float64), np.maximum(p * (1 - p), 1e-6).astype(np.float64)
            if times is not None:
                slope, bend = slope * times.take(at), bend * times.take(at)
            wide = x.astype(np.float64)
            out[g, :k] += wide @ slope
            out[g, k:] += (wide * bend @ wide.T).ravel()
    return out


def newton_step(weights: np.ndarray, sums: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights after a step; the ridge holds those of rare gates where they were."""
    k = weights.shape[1]
    out = weights.astype(np.float64)
    for g in range(len(weights)):
        step = np.linalg.solve(sums[g, k:].reshape(k, k) + ridge * np.eye(k), sums[g, :k])
        out[g] += step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    return out.astype(np.float32)


# ---- words with a place in the tree

class Vocabulary:
    """Frequent words in the order of their bytes, and the escape behind them, as leaves of a tree that halves their counts.

    A node goes by the leaf that its right branch begins with. Neighbours share
    nodes, so that a node stands for words that begin alike.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, others: float):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[k] for k in order]
        weight = np.concatenate([np.asarray(counts, np.float64)[order], [max(1.0, others)]])
        self.count, n = weight, len(weight)
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        self.prior, self.seen = np.zeros(n, np.float32), np.zeros(n)
        lo, hi = np.zeros(n, np.int64), np.full(n, n)
        here, leaves, nodes, bits = np.arange(n), [], [], []
        while n > 1 and len(here):
            half = np.searchsorted(upto, (upto[lo] + upto[hi]) / 2)
            half -= (np.abs(upto[half - 1] * 2 - upto[lo] - upto[hi]) < np.abs(upto[half] * 2 - upto[lo] - upto[hi])) & (half - 1 > lo)
            half = np.clip(half, lo + 1, hi - 1)
            self.prior[half] = np.log((upto[hi] - upto[half]) / (upto[half] - upto[lo]))
            self.seen[half] = upto[hi] - upto[lo]
            bit = here >= half
            leaves.append(here)
            nodes.append(half)
            bits.append(bit)
            lo, hi = np.where(bit, half, lo), np.where(bit, hi, half)
            more = hi - lo > 1
            here, lo, hi = here[more], lo[more], hi[more]
        leaf = np.concatenate(leaves) if leaves else np.empty(0, np.int64)
        back = np.argsort(leaf, kind="stable")
        self.node = (np.concatenate(nodes)[back] if leaves else leaf).astype(np.int32)
        self.bit = (np.concatenate(bits)[back] if leaves else leaf).astype(np.uint8)
        self.size = np.bincount(leaf, minlength=n)
        self.start = np.cumsum(self.size) - self.size

    def pair_floor(self, slots: int) -> float:
        """Least product of a word's and a node's counts so that no more than half the slots are needed for (word before, node); pairs below go to the shared table."""
        before, node = np.sort(self.count[:-1]), self.seen[self.seen > 0]
        low, high = 0.0, math.log(max(1.0, float(before.max(initial=1)))) + math.log(max(1.0, float(node.max(initial=1)))) + 1
        for _ in range(40):
            mid = (low + high) / 2
            needed = (len(before) - np.searchsorted(before, np.exp(mid) / node)).sum()
            low, high = (mid, high) if needed > slots // 2 else (low, mid)
        return high


_NODE = np.uint32(0x9E3779B1)
#: What is known of a decision of a word, side by side: one lookup finds all of it.
DECISION = np.dtype({"names": ["hash", "logit", "seen", "bit"], "formats": [np.uint32, np.float32, np.float32, np.uint8], "itemsize": 16})


class _Numbers(dict):
    """Numbers of words; an unknown one gets the next and is noted in `new`."""

    new: list[bytes]

    def __missing__(self, name: bytes) -> int:
        number = self[name] = len(self)
        self.new.append(name)
        return number


class Words:
    """Decisions of words by number: those of the tree for good, the others until the next call."""

    def __init__(self, tree: Vocabulary, spelling: Spelling):
        self.tree, self.spelling, escape = tree, spelling, len(tree.words)
        names = tree.words
        self.number, self._new = _Numbers(zip(names, range(escape))), []
        self.escape = slice(int(tree.start[escape]), int(tree.start[escape] + tree.size[escape]))
        self._fixed = {
            "start": tree.start[:escape], "size": tree.size[:escape], "length": np.fromiter((len(coded(n)) for n in names), np.int64, escape), "key": self._keys(names), "count": tree.count[:escape],
            "decisions": np.empty(len(tree.node), DECISION),
        }
        d = self._fixed["decisions"]
        d["hash"], d["bit"], d["logit"] = tree.node.astype(np.uint32) * _NODE, tree.bit, tree.prior.take(tree.node)
        d["seen"] = np.log(np.maximum(tree.seen, 1)).astype(np.float32).take(tree.node)
        self._held: dict[str, np.ndarray] = {}
        self.__dict__.update(self._fixed)
        #: Logarithms of the counts of words before; one that isn't in the tree is like none.
        self.often = np.append(np.log(np.maximum(tree.count[:escape], 1)), -np.inf).astype(np.float32)

    hash, bit, logit, seen = (property(lambda self, k=k: self.decisions[k]) for k in ("hash", "bit", "logit", "seen"))

    @staticmethod
    def _keys(names: list[bytes]) -> np.ndarray:
        return np.fromiter((xxh64_intdigest(n, 42) for n in names), np.uint64, len(names))

    def numbers(self, names: list[bytes]) -> np.ndarray:
        """Numbers of words; those beyond the tree's hold until the next call."""
        for n in self._new:
            del self.number[n]
        self.number.new = self._new = []
        found = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        self._spell(self._new)
        return found

    def _put(self, name: str, values: np.ndarray) -> None:
        """The values behind the tree's."""
        fixed, held = self._fixed[name], self._held.get(name)
        size = len(fixed) + len(values)
        if held is None or size > len(held):
            held = self._held[name] = np.empty(size + len(values) // 2 + 1000, fixed.dtype)
            held[: len(fixed)] = fixed
            self._fixed[name] = held[: len(fixed)]  # no second copy of the tree's
        held[len(fixed) : size] = values
        self.__dict__[name] = held[:size]

    def _spell(self, names: list[bytes]) -> None:
        strings = [coded(n) for n in names]
        d = Decisions(self.spelling.trees, strings, short=self.spelling.states is not None)
        escape = self.escape.stop - self.escape.start
        size = d.size + escape
        start = np.cumsum(size) - size
        spelt = np.ones(int(size.sum()), bool)
        lead = (start[:, None] + np.arange(escape)).ravel()
        spelt[lead] = False
        new = np.empty(len(spelt), DECISION)
        new[lead] = np.tile(self._fixed["decisions"][self.escape], len(names))
        place = np.flatnonzero(spelt)
        for k, values in {"hash": d.hashes[-1], "bit": d.bit, "logit": self.spelling.logits(d), "seen": np.float32(-np.inf)}.items():
            new[k][place] = values
        self._put("decisions", new)
        few = {"start": start + len(self._fixed["decisions"]), "size": size, "length": np.fromiter(map(len, strings), np.int64, len(strings)), "key": self._keys(names), "count": np.full(len(names), np.nan)}
        for k, values in few.items():
            self._put(k, values)

    def befores(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, logarithm of the count) of the word before each word; before a text's first one stands nothing."""
        before = np.concatenate([number[:1], number[:-1]])
        key = (self.key.take(before) >> np.uint64(32)).astype(np.uint32)
        key[first] = 0
        before[first] = none = len(self.tree.words)
        return key, self.often.take(np.minimum(before, none))


def pair_slots(key: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    return slots((key * np.uint32(0x2C9277B5) ^ word) * np.uint32(0x85EBCA6B), bits)


class Pairs:
    """Decisions counted by the word before: those of pairs that are expected often enough in a table of their own, all others in one that they share."""

    def __init__(self, words: Words, bits: int):
        self.words, self.bits, self.floor = words, bits, words.tree.pair_floor(1 << bits)
        self.both = np.zeros(4 << bits, np.uint32)
        self.counts, self.others = self.both[: 2 << bits], self.both[2 << bits :]

    def add(self, texts: list[list[bytes]]) -> None:
        self.count(self.words.numbers(list(chain.from_iterable(texts))), np.cumsum([0, *map(len, texts[:-1])]))

    def count(self, number: np.ndarray, first: np.ndarray) -> None:
        """Count texts by the numbers of their words; first: where each text begins."""
        w = self.words
        key, seen = w.befores(number, first)
        size, start = w.size.take(number), w.start.take(number)
        for a, b in _runs(np.cumsum(size), SIDE):
            n = size[a:b]
            flat = np.arange(n.sum()) + np.repeat(start[a:b] - (np.cumsum(n) - n), n)
            d = w.decisions.take(flat)
            at = pair_slots(np.repeat(key[a:b], n), d["hash"], self.bits)
            at += (d["seen"] + np.repeat(seen[a:b], n) < self.floor).astype(np.intp) << self.bits
            np.add.at(self.both, at << 1 | d["bit"], np.uint32(1))


def _runs(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of items of so much together, about; upto: running sums of their sizes."""
    edge = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(upto)]
    return ((a, b) for a, b in zip(edge[:-1], edge[1:]) if a < b)


def _bounds() -> np.ndarray:
    out = [0]
    while out[-1] < 1 << 40:
        out.append(out[-1] + max(STEP, out[-1] // PART))
    return np.array(out[1:], np.int64)


#: The second layer's weights where nothing has been fitted.
FIRST = np.array([1, 0.1, 0.2], np.float32)
#: Bytes after which the weights learn.
BOUNDS = _bounds()


class Mixer:
    """The second layer: weights by gate over (first layer, word before, document), which each document refines.

    Pairs that share the table of the others have gates of their own, whose weights tell how far such counts can be relied on.
    """

    inputs = len(FIRST)

    def __init__(self, words: Words, pairs: np.ndarray, weights: np.ndarray | None = None, shared: bool = False):
        """pairs: states of the pairs expected often; if shared, those of the others lie behind them, as many."""
        self.words, self.pairs, self.shared = words, pairs, shared
        self.bits, self.gates = len(pairs).bit_length() - 1 - shared, GATES * (1 + shared)
        self.floor = words.tree.pair_floor(1 << self.bits)
        if weights is None:
            weights = np.tile(FIRST, (self.gates, 1))
        self.weights = weights

    def predictors(self, texts: list[np.ndarray], own_out: bool = False):
        """(logits of the inputs, gate, bit, text) of each decision of texts (numbers of words), by segment, text and place; where segments begin."""
        w = self.words
        count = np.fromiter(map(len, texts), np.int64, len(texts))
        number, text, first = np.concatenate(texts), np.repeat(np.arange(len(texts)), count), np.cumsum(count) - count
        key, seen = w.befores(number, first)
        length = w.length.take(number)
        begin = np.cumsum(length) - length
        segment = np.searchsorted(BOUNDS, begin - np.repeat(begin[first], count), side="right")
        order = np.lexsort((text, segment))
        number, text, segment, key, seen = number[order], text[order], segment[order], key[order], seen[order]
        size, start = w.size.take(number), w.start.take(number)
        upto = np.cumsum(size)
        flat = np.arange(upto[-1]) + np.repeat(start - (upto - size), size)
        d = w.decisions.take(flat)
        word, bit, level = (np.ascontiguousarray(d[k]) for k in ("hash", "bit", "logit"))
        rare = d["seen"] + np.repeat(seen, size) < self.floor
        at = pair_slots(np.repeat(key, size), word, self.bits)
        if self.shared:
            at += rare.astype(np.intp) << self.bits
        pair = self.pairs.take(at)
        if not self.shared:
            pair[rare] = 0
        if own_out:
            pair = without(pair, bit)
        pair = pair.astype(np.intp)
        lane = np.repeat(text, size)
        here = self._in_document(lane, word, bit)
        gate = GATE.take(pair) + SEEN.take(here)
        if self.shared:
            gate += rare.view(np.uint8) * np.uint8(GATES)
        gate = gate.astype(np.intp)
        cut = np.concatenate([[0], upto])[np.searchsorted(segment, np.arange(segment[-1] + 2))]
        return [level, LOGIT.take(pair), LOGIT.take(here)], gate, bit, lane, cut.tolist()

    @staticmethod
    def _in_document(lane: np.ndarray, word: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """States of how the same decision went before in the same text: places sorted by text and word so far."""
        n = len(bit)
        wide = n.bit_length()
        key = lane.astype(np.uint64)
        key <<= np.uint64(32)
        key |= word
        key <<= np.uint64(wide)
        key |= np.arange(n, dtype=np.uint64)
        key.sort()
        place = (key & np.uint64((1 << wide) - 1)).view(np.int64)
        key >>= np.uint64(wide)
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        b = bit.take(place)
        first = np.flatnonzero(new).astype(np.int32)
        size = np.diff(first, append=np.int32(n))
        n1 = np.cumsum(b, dtype=np.int32)
        n1 -= b
        n1 -= np.repeat(n1[first], size)
        n0 = np.arange(n, dtype=np.int32)
        n0 -= np.repeat(first, size)
        n0 -= n1
        state = np.minimum(n0, 127, out=n0)
        state <<= 8
        state |= np.minimum(n1, 127, out=n1)
        out = np.empty(n, np.uint16)
        out[place] = state
        return out.astype(np.intp)

    def run(self, texts: list[np.ndarray], learnt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each text, what its weights have learnt). Texts side by side, segment after segment; none learns from another."""
        # those of most segments first, so that the cells still read lie side by side
        spans = np.fromiter((self.words.length.take(t).sum() for t in texts), np.int64, len(texts))
        order = np.argsort(-spans, kind="stable")
        inputs, gate, bit, lane, cut = self.predictors([texts[k] for k in order.tolist()])
        cell = lane * self.gates + gate
        weights = np.tile(self.weights.T, len(texts))
        if learnt is not None:
            weights += learnt.reshape(self.inputs, len(texts), -1)[:, order].reshape(weights.shape)
        sign = bit.astype(np.float32)
        sign *= 2
        sign -= 1
        for s in inputs:
            s *= sign
        e = np.empty(len(bit), np.float32)
        for a, b in zip(cut[:-1], cut[1:]):
            if a == b:
                continue
            at, here = cell[a:b], [s[a:b] for s in inputs]
            dot = weights[0].take(at)
            dot *= here[0]
            for w, s in zip(weights[1:], here[1:]):
                dot += w.take(at) * s
            np.negative(dot, out=dot)
            np.minimum(np.maximum(dot, LEAST, out=dot), MOST, out=dot)
            step = np.exp(dot, out=e[a:b])
            step = step / (step + ONE)
            cells = (int(lane[b - 1]) + 1) * self.gates  # a segment's lanes go up
            for w, s in zip(weights, here):
                more = np.bincount(at, weights=step * s, minlength=cells)
                more *= RATE
                w[:cells] += more.astype(np.float32)
        cost = np.empty(len(texts))
        cost[order] = np.bincount(lane, weights=np.log1p(e), minlength=len(texts))
        own = np.empty((self.inputs, len(texts), self.gates), np.float32)
        own[:, order] = weights.reshape(own.shape) - self.weights.T[:, None]
        return cost / -math.log(10), own.reshape(self.inputs, -1)

    def windows(self, texts: list[np.ndarray], side: int | None = None) -> Iterator[list[np.ndarray]]:
        """Texts in runs of bounded size (side: SIDE, if none is given); a text of more than a window alone, part by part."""
        side = min(side or SIDE, WINDOW)
        size = [int(self.words.size.take(t).sum()) for t in texts]
        at = 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and upto - at < LANES and (upto == at or held + size[upto] <= side):
                held += size[upto]
                upto += 1
            if held <= WINDOW:
                yield texts[at:upto]
            else:
                part = np.cumsum(self.words.size.take(texts[at])) // WINDOW
                yield from ([one] for one in np.split(texts[at], np.flatnonzero(np.diff(part)) + 1))
            at = upto

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text. In a text of several windows the weights go on with what they have learnt; what was read is known within a window."""
        out, at, done, learnt = np.zeros(len(texts)), 0, 0, None
        for one in self.windows(texts):
            cost, own = self.run(one, learnt)
            out[at : at + len(one)] += cost
            done += len(one[0])
            if len(one) == 1 and done < len(texts[at]):
                learnt = own
            else:
                at, done, learnt = at + len(one), 0, None
        return out


# ---- over the corpus

def _held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of texts and their counts. A model that the worker still holds goes first, else it lies beside the tables until this run's takes its place."""
    let_go()
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    for batch in batches:
        for t in batch["text"]:
            tokens = tokens_of(t.as_py())
            keys = keys_of(tokens)
            seen.update(keys)
            if keys[:-1] != tokens:
                seen.update(k for k in pieces_of(tokens) if k.startswith(_KEEP))
            if len(seen) > HELD_TOKENS:
                yield out()
                seen.clear()
    yield out()


def _token_counts(train: DataFrame) -> DataFrame:
    """(key, n) over train(text): tokens as they are counted, and, behind a blank, pieces of long ones."""
    return train.select("text").mapInArrow(_counted, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _squeeze(values: np.ndarray) -> bytes:
    """Counts as byte planes, whose high ones are all but empty, compressed behind their number."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _widen(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], 4 * int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _slices(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What is counted in tables, slice by slice, as (slice, places, counts)."""
    for k, whole in enumerate(tables):
        for s, part in enumerate(whole.reshape(SLICES, -1)):
            at = np.flatnonzero(part)
            if len(at):
                columns = [pa.array([k * SLICES + s], pa.int32()), pa.array([_squeeze(np.diff(at, prepend=0))], pa.binary()), pa.array([_squeeze(np.minimum(part[at], 0xFFFFFFFF))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "at", "n"])


_SLICE = "slice int, at binary, n binary"


def _states(parts: DataFrame, bits: list[int]) -> list[np.ndarray]:
    """Tables of states of 2^bits slots from the slices that tasks counted, which are summed apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                into = sums.setdefault(r["slice"], np.zeros((2 << bits[r["slice"] // SLICES]) // SLICES, np.uint64))
                into[np.cumsum(_widen(r["at"]), dtype=np.int64)] += _widen(r["n"])
        for s, into in sums.items():
            q = quantised(into.reshape(-1, 2)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([(q[:, 0] << 8 | q[:, 1]).astype("<u2").tobytes()], pa.binary())], names=["slice", "state"])

    out = [np.zeros(1 << b, np.uint16) for b in bits]
    for r in parts.repartitionById(len(bits) * SLICES, "slice").mapInArrow(add, "slice int, state binary").toLocalIterator():
        k, s = divmod(r["slice"], SLICES)
        out[k].reshape(SLICES, -1)[s] = np.frombuffer(r["state"], "<u2")
    return out


def _sum_cells(rows: DataFrame) -> np.ndarray:
    """rows(cell, value) summed by cell, for GATES x inputs sums at most."""
    got = rows.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r["cell"] for r in got), default=-1) + 1)
    for r in got:
        out[r["cell"]] = r["value"]
    return out


def _cells(sums: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if sums is not None:
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums.ravel()[some])], names=["cell", "value"])


_CELL = "cell int, value double"


def _spelling(counts: DataFrame, vocabulary: Vocabulary, distinct: int) -> Spelling:
    """The first layer from counts(key, n) of what can be spelt: of words in the tree one occurrence counts, of others all."""
    spark = counts.sparkSession
    listed = spark.sparkContext.broadcast(frozenset(vocabulary.words))
    words = counts.where(F.col("key") != F.lit(bytearray(END)))

    def spelt(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        names = batch["key"].to_pylist()
        beyond = np.fromiter((n not in listed.value for n in names), bool, len(names))
        return names, np.where(beyond, batch["n"].to_numpy(), 1), beyond

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16)
        for batch in batches:
            if batch.num_rows:
                total += pair_counts(*spelt(batch)[:2])
        yield from _cells(total)

    digrams = _sum_cells(words.mapInArrow(pairs, _CELL))
    trees = Trees(np.pad(digrams, (0, (1 << 16) - len(digrams))).reshape(256, 256))
    bits = [max(LEAST_BITS, min(most, math.ceil(math.log2(8 * distinct + 1)))) for most in WORD_BITS]
    given = spark.sparkContext.broadcast(trees)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << b, np.uint64) for b in bits]
        for batch in (whole.slice(k, 5000) for whole in batches for k in range(0, whole.num_rows, 5000)):
            names, n, _ = spelt(batch)
            d = Decisions(given.value, [coded(k) for k in names])
            times = np.repeat(n.astype(np.uint64), d.size)
            for into, h, b in zip(tables, d.hashes, bits):
                np.add.at(into, slots(h, b) << 1 | d.bit, times)
        yield from _slices(tables)

    spelling = Spelling(trees, _states(words.mapInArrow(count, _SLICE), bits))
    fitted = checkpoint(words.where(F.pmod(F.xxhash64("key"), F.lit(FIT_SHARE)) == 0))
    for some in [fitted] * FIT_STEPS + [words]:
        shared = spark.sparkContext.broadcast(spelling)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total = shared.value, None
            for batch in (whole.slice(k, 5000) for whole in batches for k in range(0, whole.num_rows, 5000)):
                names, n, beyond = spelt(batch)
                names, n = [k for k, b in zip(names, beyond) if b], n[beyond]
                if names:
                    d = Decisions(model.trees, [coded(k) for k in names])
                    inputs, gate = model.predictors(d, own_out=True)
                    got = newton_sums(inputs, gate, d.bit, model.weights, np.repeat(n.astype(np.float64), d.size)).ravel()
                    total = got if total is None else total + got
            yield from _cells(total)

        spelling.weights = _stepped(spelling.weights, _sum_cells(some.mapInArrow(sums, _CELL)))
        shared.unpersist()
    return spelling


def _stepped(weights: np.ndarray, cells: np.ndarray) -> np.ndarray:
    gates, k = weights.shape
    return newton_step(weights, np.pad(cells, (0, gates * (k + k * k) - len(cells))).reshape(gates, -1))


def _words(key: str, shared: Broadcast) -> Words:
    """Words of a broadcast vocabulary and spelling, held by the worker; the ones before go first, then these are read."""
    return held(f"words {key}", lambda: Words(*shared.value[:2]))


def _pair_states(train: DataFrame, vocabulary: Vocabulary, trees: Trees, total: int) -> np.ndarray:
    """States of (word before, word so far) over all of train(text): of pairs expected often, then of all others."""
    bits = max(LEAST_BITS, min(PAIR_BITS, math.ceil(math.log2(4 * total + 1))))
    shared, key = train.sparkSession.sparkContext.broadcast((vocabulary, Spelling(trees))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = None
        for _, tokens in _groups(batches):
            pairs = pairs or Pairs(_words(key, shared), bits)
            number, count, _ = tokens.numbers(pairs.words)
            pairs.count(number, np.cumsum(count) - count)
        if pairs:
            yield from _slices([pairs.counts, pairs.others])

    states = np.concatenate(_states(train.select("text").mapInArrow(run, _SLICE), [bits] * 2))
    shared.unpersist()
    return states


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Rows and their tokens, so many that their texts have LOOKED_UP bytes, about."""
    for batch in batches:
        size = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"]]) // LOOKED_UP
        edge = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                yield part, Tokens(part["text"])


def _numbered(words: Words, tokens: list[list[bytes]]) -> list[np.ndarray]:
    names = [pieces_of(t) for t in tokens]
    return _by_text(words.numbers(list(chain.from_iterable(names))), np.fromiter(map(len, names), np.int64, len(names)))


def _by_text(number: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    edge = np.concatenate([[0], np.cumsum(count)]).tolist()
    return [number[a:b] for a, b in zip(edge[:-1], edge[1:])]


def _fit_pairs(sample: DataFrame, train: DataFrame, vocabulary: Vocabulary, spelling: Spelling, pairs: np.ndarray) -> np.ndarray:
    """The second layer's first weights, each decision of train(text) against counts without its own; steps over sample(text) come before, as a start."""
    weights = np.tile(FIRST, (2 * GATES, 1))
    shared, key = sample.sparkSession.sparkContext.broadcast((vocabulary, spelling, Table(pairs))), uuid.uuid4().hex
    for some in [sample] * FIT_STEPS + [train]:

        def sums(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            mixer, total = None, None
            for _, tokens in _groups(batches):
                mixer = mixer or Mixer(_words(key, shared), shared.value[2].values, weights, shared=True)
                for one in mixer.windows(_by_text(*tokens.numbers(mixer.words)[:2]), FIT_SIDE):
                    inputs, gate, bit, _, _ = mixer.predictors(one, own_out=True)
                    got = newton_sums(inputs, gate, bit, weights).ravel()
                    total = got if total is None else total + got
            yield from _cells(total)

        weights = _stepped(weights, _sum_cells(some.mapInArrow(sums, _CELL)))
    shared.unpersist()
    return weights


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ROWS rows at most for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS if int(before) <= 0 else min(ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row.

    Learns from the rows that aren't held out. Null and empty texts hold the end alone. A null id is in no fold and is
    learned from. Without any training text every token is unknown and the model is the untrained one; an empty table
    gives no rows. Repeated rows are each learned from and returned. Very long texts go window by window, very long
    words piece by piece. Other columns, whatever their names, are ignored.
    """
    with _small_batches(docs.sparkSession):
        return _lm_scores(docs, id_col, text_col)


def _lm_scores(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = checkpoint(_token_counts(train))
    head = F.substring("key", 1, 1)
    piece, digest = head == F.lit(bytearray(_KEEP)), (head == F.lit(bytearray(END))) & (F.octet_length("key") > 1)
    known = counts.where(~piece)
    total, distinct, coded_ = counts.agg(
        F.coalesce(F.sum(F.when(~piece, F.col("n"))), F.lit(0)), F.count_if(~piece), F.coalesce(F.sum(F.when(~digest, F.col("n"))), F.lit(0))
    ).first()
    # the end always has a place in the tree
    top = known.where(~digest & (F.col("n") > 1) & (F.col("key") != F.lit(bytearray(END)))).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toArrow()
    ends = counts.where(F.col("key") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names, often = [*top["key"].to_pylist(), END], np.append(top["n"].to_numpy(), max(1, ends))
    vocabulary = Vocabulary(names, often, coded_ - int(often.sum()))
    spelling = _spelling(counts.where(~digest), vocabulary, distinct)
    pairs = _pair_states(train, vocabulary, spelling.trees, total)
    sample = checkpoint(train.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIT_SHARE)) == 0).select("text"))
    shared = spark.sparkContext.broadcast((vocabulary, spelling, Table(pairs), _fit_pairs(sample, train.select("text"), vocabulary, spelling, pairs)))
    trained, model_key = total > 0, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = None
        for batch, tokens in _groups(batches):
            if mixer is None:
                mixer = Mixer(_words(model_key, shared), shared.value[2].values, shared.value[3], shared=True)
            w = mixer.words
            number, pieces, at = tokens.numbers(w)
            keys = keys_of(tokens.names[:-1])  # long words are counted by their digests
            new = (at < 0) | np.isnan(w.count.take(at)) | (not trained)
            logs = np.log10(np.where(new, 0, w.count.take(at)) + 1)
            hashed = np.zeros(len(keys), np.uint64)
            hashed[new] = Words._keys([keys[k] for k in np.flatnonzero(new).tolist()])
            size = np.fromiter(map(len, tokens.names), np.int64, len(keys)) + 1
            size[-1] = 1
            unknown = new.take(tokens.code)
            rest = np.add.reduceat(unknown, tokens.first, dtype=np.int64)
            n, met, base, size = tokens.count, tokens.count - rest, np.add.reduceat(logs.take(tokens.code), tokens.first), np.add.reduceat(size.take(tokens.code), tokens.first)
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32()), pa.array(hashed.take(tokens.code[unknown]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(n, pa.int64()), pa.array(met, pa.int64()), pa.array(base, pa.float64()), pa.array(mixer.scores(_by_text(number, pieces)), pa.float64()), pa.array(size, pa.int64()), tails],
                names=["doc_id", "held_out", "n_tokens", "met", "base", "score", "size", "tail"],
            )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, met bigint, base double, score double, size bigint, tail array<bigint>"
    scored = checkpoint(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("tail").alias("token"))
    listed = known.select(F.xxhash64("key").alias("of"), "n")
    more = rare.join(listed, F.col("token") == F.col("of")).groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("also")).withColumnRenamed("row", "of_row")
    everything = F.lit(math.log10(total + distinct + 1))
    return scored.drop("tail").join(more, F.col("row") == F.col("of_row"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("met") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * everything).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("size")).alias("bits_per_byte"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of documents: see lm_scores."""
    return lm_scores(table(spark, sf_dir, "documents"))
