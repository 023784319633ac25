"""LM scoring by online logistic context mixing.

A text is its words in lower case, and an end.  The ``SYMBOLS`` commonest words
are symbols of a Huffman code; any other word is an escape and its bytes, in a
Huffman code of bytes, with a space.  Each bit is predicted by four contexts.
For a symbol: none (the counts of the code's nodes); the word before, if it is
common, hashed with the node; and what most often followed the last two words,
and the last word, of which one slot of a hashed table holds the symbol, a
check and how often it came.  For a byte: none, the last two, the last three
and all bytes of the word so far, each hashed with the node.  A context gives a
stretched probability; a gate (place in the code, how well the contexts are
known) picks the weights that sum them.  First weights are fitted on one
training text in ``FOLD``, whole, against the counts of all others, and are
then refined within each text: a block is predicted by what came before it
only.  The sum of the bits' costs is the text's cost.  Beside it: an add-one
unigram base over all training words.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import materialise, prepare

#: Common words that are symbols; counts of all other words are joined, not broadcast.
SYMBOLS = 1 << 17
#: Symbols that are a context of their own.
HEADS = 1 << 12
#: Slots as powers of two: of the word before, the bytes' four contexts (largest), and what followed (least and largest).
AFTER_BITS, BYTE_BITS, RUN_BITS = 22, (12, 18, 20, 22), (22, 24)
#: One training text in so many is kept out of the first counts and fits the weights.
FOLD = 16
FIT_ROUNDS, RIDGE = 4, 20.0
#: Tokens of a text after which its weights are refined: the first block and the largest; each is twice the one before.
FIRST_BLOCK, LAST_BLOCK = 32, 2048
#: A gate's weights move by its gradient over its bits and so many more.
INERTIA = 300.0
KINDS = 4
_ROW = np.dtype(np.complex128)  # as wide as the weights of a gate, which are read at once
_SYMBOL_GATES, _BYTE_GATES = 8 * 4 * 4 * 2, 8 * 4 * 4
GATES = _SYMBOL_GATES + _BYTE_GATES
#: Weights before any are fitted, and those that the fit is drawn to.
_START = np.array([[0.5, 0.3, 0.6, 0.5]] * _SYMBOL_GATES + [[0.2, 0.2, 0.3, 0.5]] * _BYTE_GATES, np.float32)
_END, _ESCAPE = 0, 1  # symbols
_BEFORE = np.uint64(0x51)  # stands for the words before a text
_BEFORE_WORD = np.array([0xFFFFFF, 0xFFFF00, 0xFF0000, 0], np.uint32)  # and for the bytes before a word
_LIKELY_BITS = 20
_CHUNK, _SCORED, _TOKENS_AT_ONCE = 1 << 19, 1 << 19, 1 << 14
_PACK = 14  # slots that travel as one block, as a power of two
#: Bytes of text that a task counts before it sends its tables, and followers that it holds before it sends them.
_FLUSH, _FOLLOWERS = 1 << 27, 1 << 21
#: Pairs of a word and the one before that a task holds before it counts them.
_PAIRS = 1 << 19
_U, _W = np.uint64, np.uint32
#: Bounds of a bit's stretched probability.
_LEAST, _MOST = np.float32(-14), np.float32(14)
#: Bits whose costs take one logarithm: their product stays below 1.3e6 ** _LOGS, inside float32.
_LOGS = 6
#: What a follower that came so often speaks with, and how well it is known.
_STRENGTH = np.where(np.arange(64) > 0, np.log(2.0 * np.arange(64) + 1) + 1, 0).astype(np.float32)
_KNOWN = (np.arange(64)[:, None] > [0, 1, 3]).sum(axis=1)


def huffman_lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths for positive counts."""
    n = len(counts)
    up, heap = np.zeros(2 * n, np.int64), [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[1]] = up[b[1]] = made
        heapq.heappush(heap, (a[0] + b[0], made))
        made += 1
    depth = np.zeros(made, np.int64)
    for node in range(made - 2, -1, -1):
        depth[node] = depth[up[node]] + 1
    return np.maximum(depth[:n], 1)


class Code:
    """A canonical prefix code: each symbol's bits and length."""

    def __init__(self, counts: np.ndarray):
        length = huffman_lengths(counts)
        order = np.lexsort((np.arange(len(counts)), length))
        step = np.left_shift(np.int64(1), np.int64(length.max()) - length[order])
        start = np.concatenate([[0], np.cumsum(step)[:-1]])
        self.order, self.start, self.deepest = order, start, int(length.max())
        kind = np.int32 if self.deepest <= 30 else np.int64
        self.code, self.length = np.zeros(len(counts), kind), length.astype(kind)
        self.code[order] = start >> (length.max() - length[order])
        self.left = self.code << (self.deepest - self.length)  # a symbol's bits, from the deepest place on

    def by_length(self, symbol: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """An order of some symbols, longest codes first, and for each place how many have a bit there."""
        length = self.length[symbol]
        have = np.cumsum(np.bincount(length, minlength=self.deepest + 1)[::-1])[::-1]
        return np.argsort((self.deepest - length).astype(np.uint8), kind="stable"), have[1:][have[1:] > 0].tolist()

    def nodes_at(self, left: np.ndarray, place: int) -> np.ndarray:
        """The nodes from which the bits at one place go."""
        return left >> (self.deepest - place) | self.code.dtype.type(1 << place)

    def bits_at(self, left: np.ndarray, place: int) -> np.ndarray:
        return left >> (self.deepest - place - 1) & 1

    def signs_at(self, left: np.ndarray, place: int) -> np.ndarray:
        """1 / 2048 for each bit set at one place, else -1 / 2048."""
        sign = self.bits_at(left, place).astype(np.float32)
        sign *= np.float32(1 / 1024)
        sign -= np.float32(1 / 2048)
        return sign

    def node_values(self, counts: np.ndarray) -> np.ndarray:
        """(symbols, places): the stretched probability of each node on each symbol's path, that the bit is the symbol's."""
        total = np.concatenate([[0.0], np.cumsum(counts[self.order].astype(float))])
        out = np.zeros((len(counts), self.deepest), np.int16)
        left = self.code.astype(np.int64) << (self.deepest - self.length.astype(np.int64))
        for k in range(self.deepest):
            shift = self.deepest - k
            low = left >> shift << shift
            bounds = [total[np.searchsorted(self.start, low + x)] for x in (0, 1 << (shift - 1), 1 << shift)]
            n0, n1 = bounds[1] - bounds[0], bounds[2] - bounds[1]
            sign = np.where(left >> (shift - 1) & 1, 1, -1)
            out[:, k] = np.clip(np.log((n1 + 0.02) / (n0 + 0.02)), -12, 12) * sign * 2048
        return out


def _slots(context: np.ndarray, bits: int, node: np.ndarray) -> np.ndarray:
    """The slots of nodes in a context, which is a mixed hash: one of its own for each node, as it is turned by it."""
    mixed = node.astype(_W)
    mixed *= _W(0x9E3779B1)
    mixed += context
    mixed >>= _W(32 - bits)
    return mixed.astype(np.int64)


def _values(counts: np.ndarray) -> np.ndarray:
    """Stretched probabilities as int16 in units of 1 / 2048, of counts (slots, 2).

    The two low bits tell how well the slot is known: 0 never seen, 1 once or
    twice, 2 up to 23 times, 3 more often.
    """
    n0, n1 = counts[:, 0].astype(float), counts[:, 1].astype(float)
    n = n0 + n1
    value = (np.clip(np.log((n1 + 0.1) / (n0 + 0.1)), -12, 12) * 2048).astype(np.int16)
    return (value & ~np.int16(3)) | ((n > 0).astype(np.int16) + (n >= 3) + (n >= 24))


class Words:
    """The symbols behind the end and the escape: words by their hashes, ascending, and a table by the first bits of a hash of one word that it may be."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.likely = hashes, np.zeros(1 << _LIKELY_BITS, np.int32)
        self.likely[(hashes >> _U(64 - _LIKELY_BITS)).astype(np.int64)] = np.arange(len(hashes))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), _ESCAPE)
        found = np.take(self.likely, (hashes >> _U(64 - _LIKELY_BITS)).astype(np.int64)).astype(np.int64)
        other = np.flatnonzero(np.take(self.hashes, found) != hashes)
        place = np.minimum(np.searchsorted(self.hashes, hashes[other]), len(self.hashes) - 1)
        found += 2
        found[other] = np.where(self.hashes[place] == hashes[other], place + 2, _ESCAPE)
        return found


class Tokens:
    """The tokens of some texts: symbols, contexts, and where the words are."""

    def __init__(self, words: Words, kind: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        """kind: 0 rare, 1 common, 2 a context of its own."""
        self.data = tk.LOWER[data]
        self.sums = tk.prefix_sums(self.data)
        starts, ends, first = tk.spans(tk.NOT_SPACE[data], offsets)
        hashes = tk.substring_hash(self.sums, starts, ends)
        n, texts = len(hashes), len(offsets) - 1
        self.first = first + np.arange(texts + 1)
        self.text = tk.rows_of(self.first)
        self.words, self.word_text = hashes, tk.rows_of(first)
        self.word_at = at = np.arange(n) + self.word_text  # the words' places among the tokens
        self.symbol = np.zeros(n + texts, np.int64)
        self.symbol[at] = words.symbols(hashes)
        self.place = np.arange(n + texts) - self.first[:-1][self.text]
        own = np.zeros(n + texts, np.uint64)
        own[at] = hashes
        last, before = np.full(n + texts, _BEFORE), np.full(n + texts, _BEFORE)
        last[1:], before[2:] = own[:-1], own[:-2]
        last[self.place < 1] = _BEFORE
        before[self.place < 2] = _BEFORE
        previous = np.zeros(n + texts, np.int64)
        previous[1:] = self.symbol[:-1]
        # a common word is a context of its own, all others are one
        head = np.where(self.place < 1, 2, np.where(kind[previous] == 2, previous + 3, 1))
        self.after = (tk.mix(head.astype(np.uint64)) >> _U(32)).astype(_W)
        self.runs = [tk.mix(last * _U(0xA0761D6478BD642F) + before), tk.mix(last + _U(0x2545F4914F6CDD1D))]
        self.starts, self.ends = np.zeros(n + texts, np.int64), np.zeros(n + texts, np.int64)
        self.starts[at], self.ends[at] = starts, ends
        self.rare = kind[self.symbol] == 0
        # for each byte, and the place behind the last, the three before it, the nearest one lowest
        wide = np.concatenate([np.zeros(3, np.uint8), self.data]).astype(_W)
        self.past = wide[2:] | wide[1:-1] << _W(8) | wide[:-2] << _W(16)

    def spelt(self, tokens: np.ndarray):
        """(token's index in tokens, byte, four contexts) of the bytes of some words and the space behind each."""
        start, size = self.starts[tokens], self.ends[tokens] - self.starts[tokens] + 1
        who = np.repeat(np.arange(len(tokens)), size)
        last = np.cumsum(size)
        place = np.arange(len(who)) - (last - size)[who]
        at = start[who] + place
        byte = np.take(self.data, at, mode="clip") if len(self.data) else np.zeros(0, np.uint8)
        byte[last - 1] = 0x20
        past = self.past[at] | _BEFORE_WORD[np.minimum(place, 3)]
        so_far = tk.substring_hash(self.sums, start[who], at)
        contexts = [(past & _W(0xFFFF)).astype(np.uint64), past.astype(np.uint64) + (_U(1) << _U(40)), so_far]
        return who, byte, [np.zeros(len(who), _W), *((tk.mix(x) >> _U(32)).astype(_W) for x in contexts)]


def _kinds(counts: np.ndarray) -> np.ndarray:
    """For each symbol: 0 if its bytes are learned, as those of words that aren't symbols, 2 if it is a context of its own, else 1."""
    kind = (counts > 2).astype(np.int8)
    kind[_ESCAPE] = 0
    head = np.argsort(-counts[2:], kind="stable")[:HEADS] + 2
    kind[head[counts[head] > 2]] = 2
    kind[_END] = 1
    return kind


def _paths(code: Code, symbol: np.ndarray):
    """(index, place in the code, node, bit) of all bits of some symbols."""
    length = code.length[symbol]
    at = np.repeat(np.arange(len(symbol), dtype=np.int32), length)
    place = np.arange(len(at), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
    word, left = code.code[symbol][at], length[at] - place
    path = word >> (left - 1)
    return at, place, path >> 1 | np.left_shift(code.code.dtype.type(1), place, dtype=code.code.dtype), path & 1


def _whole_texts(text: np.ndarray, at: np.ndarray):
    """Some tokens, in the order of their texts, in parts of about _TOKENS_AT_ONCE; a text's lie in one part, so that its cost doesn't depend on others."""
    new = np.flatnonzero(np.append(True, text[at][1:] != text[at][:-1])) if len(at) else np.zeros(0, np.int64)
    cuts = np.unique(new[np.searchsorted(new, np.arange(0, len(at), _TOKENS_AT_ONCE), "right") - 1])
    yield from np.split(at, cuts[1:])


class Model:
    """All that a text is scored with."""

    def __init__(self, words, kind, code: Code, byte_code: Code, nodes: np.ndarray, run_bits: int, tables: list[np.ndarray], runs: np.ndarray, weights: np.ndarray = _START):
        """words: their hashes, ascending; nodes: the values of the code's nodes, (places, symbols)."""
        self.words, self.kind, self.code, self.byte_code, self.nodes = Words(words), kind, code, byte_code, nodes
        self.run_bits, self.tables, self.runs, self.weights = run_bits, tables, runs, weights
        # the bytes' values without a context, by place as well
        self.bytes = [np.take(tables[1], _slots(_W(0), BYTE_BITS[0], byte_code.nodes_at(byte_code.left, k))) for k in range(byte_code.deepest)] if tables else []

    def _follower(self, hashes: np.ndarray, symbol: np.ndarray):
        """(places in the code that the symbol shares with the one that most often came after a context, strength, how well it is known)."""
        found = self.runs.take((hashes >> _U(64 - self.run_bits)).astype(np.int64), mode="wrap")
        times = np.where((found >> _W(18) & _W(0xFF)) == (hashes & _U(0xFF)).astype(_W), found >> _W(26), _W(0))
        guess = (found & _W(0x3FFFF)).astype(np.int64)
        differ = np.frexp((self.code.left[guess] ^ self.code.left[symbol]).astype(float))[1]  # bits from the first difference on
        shared = np.where(guess == symbol, self.code.deepest, self.code.deepest - differ)
        return shared.astype(np.int32), _STRENGTH[times], _KNOWN[times]

    def _symbol_bits(self, t: Tokens, at: np.ndarray):
        """The order of some tokens by length of code, how many have a bit at each place, and place by place the (gate, four stretched values) of the first of them, that have a bit there.

        A value above 0 speaks for the bit.  Places come one after the other,
        so that all that belongs to a token is read in order.
        """
        unit, code = np.float32(1 / 2048), self.code
        order, have = code.by_length(t.symbol[at])
        at = at[order]
        symbol, after = t.symbol[at], t.after[at]
        left = code.left[symbol]
        gates, values, ends = np.zeros(len(at), np.int64), [], []
        for hashes, step in zip(t.runs, (8, 2)):
            shared, strength, known = self._follower(hashes[at], symbol)
            values.append(strength)
            known *= step
            gates += known
            # a token's first difference lies inside its code, so those of a place have a bit there
            cuts = np.cumsum(np.append(0, np.bincount(shared, minlength=code.deepest + 1))).tolist()
            ends.append((np.argsort(shared.astype(np.uint8), kind="stable"), cuts, known))

        def places():
            # all that is taken lies inside its table; "wrap" only spares a second look
            for place, n in enumerate(have):
                own = left[:n]
                sign = code.signs_at(own, place)
                raw = self.tables[0].take(_slots(after[:n], AFTER_BITS, code.nodes_at(own, place)), mode="wrap")
                gate = gates[:n] + 32 * min(place, 7)
                gate += raw >> 1 & 1
                past = []
                for value, (by, cuts, known) in zip(values, ends):
                    differ = by[cuts[place] : cuts[place + 1]]
                    value[differ] *= -1
                    past.append((value, known, differ))
                yield gate, [self.nodes[place].take(symbol[:n], mode="wrap") * unit, raw * sign, values[0][:n], values[1][:n]]
                for value, known, differ in past:  # behind the first difference a follower says nothing
                    value[differ] = 0
                    gates[differ] -= known[differ]

        return order, have, places()

    def _byte_bits(self, t: Tokens, at: np.ndarray):
        """As _symbol_bits, of the bytes of some spelt words; the order names the bytes' words."""
        code = self.byte_code
        who, byte, contexts = t.spelt(at)
        order, have = code.by_length(byte)
        byte, contexts = byte[order], [c[order] for c in contexts[1:]]
        left = code.left[byte]

        def places():
            for place, n in enumerate(have):
                own = left[:n]
                sign = code.signs_at(own, place)
                node = code.nodes_at(own, place)
                raw = [self.bytes[place].take(byte[:n], mode="wrap")]
                raw += [table.take(_slots(c[:n], bits, node), mode="wrap") for table, bits, c in zip(self.tables[2:], BYTE_BITS[1:], contexts)]
                gate = ((raw[2] & 3) * np.int16(4) + (raw[3] & 3)).astype(np.int64)
                gate += _SYMBOL_GATES + 16 * min(place, 7)
                yield gate, [r * sign for r in raw]

        return who[order], have, places()

    def score(self, t: Tokens, fitted: list | None = None) -> np.ndarray:
        """Cost in bits of each text; with ``fitted``, slopes and curvatures of the gates' weights are put there."""
        texts = len(t.first) - 1
        total = np.zeros(texts)
        if fitted is not None:  # nothing is refined, so blocks don't matter
            for at in _whole_texts(t.text, np.arange(len(t.text))):
                self._cost(t, at, self.weights, total, fitted)
            return total
        edges, block = [0], FIRST_BLOCK
        while edges[-1] <= (t.place.max() if len(t.place) else -1):
            edges.append(edges[-1] + block)
            block = min(2 * block, LAST_BLOCK)
        step = (np.searchsorted(edges, t.place, "right") - 1).astype(np.uint16 if len(edges) < 1 << 16 else np.int32)
        order = np.argsort(step, kind="stable")  # by block, then by text
        cuts = np.searchsorted(step[order], np.arange(len(edges)))
        size = np.diff(t.first)  # tokens
        live = np.repeat(self.weights[None], texts, axis=0)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            moves = []
            for at in _whole_texts(t.text, order[a:b]):
                more = size[t.text[at]] > edges[k + 1]  # weights of a text that ends here serve no more
                if not more.all():
                    self._cost(t, at[~more], live, total)
                if more.any():
                    moves.append(self._cost(t, at[more], live, total, refine=True))
            for who, grad in moves:  # a block is predicted before any of it is learned from
                live[who] += grad
        return total

    def _cost(self, t: Tokens, at: np.ndarray, live: np.ndarray, total: np.ndarray, fitted: list | None = None, refine: bool = False):
        """Adds the costs of some tokens, by text, to total; returns the texts and what to add to their weights, if asked to ``refine`` them."""
        own = t.text[at]
        new = np.append(True, own[1:] != own[:-1])
        who, own = own[new], np.cumsum(new) - 1
        w = (live if fitted is not None else live[who]).reshape(-1, KINDS).view(_ROW).reshape(-1)
        parts = [self._symbol_bits(t, at)]
        spelt = np.flatnonzero(t.symbol[at] == _ESCAPE)
        if len(spelt):
            token, have, places = self._byte_bits(t, at[spelt])
            parts.append((spelt[token], have, places))
        cells, grads, one = [], [], np.float32(1)
        if refine:
            bits, done = sum(sum(have) for _, have, _ in parts), 0
            cells, grads = np.empty(bits, np.int64), np.empty((KINDS, bits), np.float32)
        for token, _, places in parts:
            text = own[token]
            first = text * GATES
            spent, product = np.zeros(len(token), np.float32), np.ones(0, np.float32)
            for place, (gate, st) in enumerate(places):
                n = len(gate)
                cell = gate if fitted is not None else np.add(gate, first[:n], out=gate)
                weights = w.take(cell, mode="wrap").view(np.float32).reshape(n, KINDS)
                z = st[0] * weights[:, 0]
                for i in range(1, KINDS):
                    z += st[i] * weights[:, i]
                odds = z.clip(_LEAST, _MOST, out=z)
                np.exp(np.negative(z, out=z), out=odds)
                odds += one  # 1 / probability of the bit
                if refine or fitted is not None:
                    err = one / odds
                    np.subtract(one, err, out=err)
                if refine:
                    cells[done : done + n] = cell
                    for grad, x in zip(grads, st):
                        np.multiply(err, x, out=grad[done : done + n])
                    done += n
                elif fitted is not None:
                    cells.append(cell)
                    grads.append([*(x.copy() for x in st), err, err / odds])
                if place % _LOGS:
                    product[:n] *= odds
                else:
                    spent[: len(product)] += np.log2(product)
                    product = odds
            spent[: len(product)] += np.log2(product)
            total[who] += np.bincount(text, spent, len(who))
        if fitted is not None:
            cell = np.concatenate(cells).astype(np.uint16)
            order, bounds = np.argsort(cell, kind="stable"), np.cumsum(np.append(0, np.bincount(cell, minlength=GATES))).tolist()
            *st, err, spread = (np.concatenate(x)[order] for x in zip(*grads))
            st = np.stack(st)
            sums, (i, j) = np.zeros((GATES, KINDS + KINDS * (KINDS + 1) // 2)), np.triu_indices(KINDS)
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a < b:
                    sums[k, :KINDS] = st[:, a:b] @ err[a:b]
                    sums[k, KINDS:] = ((st[:, a:b] * spread[a:b]) @ st[:, a:b].T)[i, j]
            fitted.append(sums)
        if refine:
            grad, times = np.empty((len(w), KINDS), np.float32), np.bincount(cells, minlength=len(w)) + INERTIA
            for i, x in enumerate(grads):
                np.divide(np.bincount(cells, x, len(w)), times, out=grad[:, i], casting="same_kind")
            return who, grad.reshape(-1, GATES, KINDS)

    def fit(self, apart: DataFrame) -> None:
        """First weights: Newton steps over whole texts (text), summed up on the executors; the driver keeps no tables."""
        names = [f"s{i}" for i in range(KINDS + KINDS * (KINDS + 1) // 2)]
        held = apart.sparkSession.sparkContext.broadcast(self)
        self.tables, self.runs = [], None
        for _ in range(FIT_ROUNDS):

            def run(batches, weights=self.weights.copy()):
                sums = np.zeros((GATES, len(names)))
                held.value.weights = weights
                for batch in batches:
                    for _, _, data, offsets in tk.chunks(batch.column(0), _SCORED):
                        found: list = []
                        held.value.score(Tokens(held.value.words, held.value.kind, data, offsets), found)
                        sums += sum(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES)), *[pa.array(c) for c in sums.T.copy()]], names=["gate", *names])

            rows = apart.mapInArrow(run, "gate long, " + ", ".join(f"{n} double" for n in names)).groupBy("gate").agg(*[F.sum(n).alias(n) for n in names])
            for row in rows.collect():  # one row a gate
                sums = np.array(row[1:])
                slope, curve, at = sums[:KINDS], np.zeros((KINDS, KINDS)), KINDS
                for i in range(KINDS):
                    for j in range(i, KINDS):
                        curve[i, j] = curve[j, i] = sums[at]
                        at += 1
                now = self.weights[row[0]].astype(float)
                move = np.linalg.solve(curve + RIDGE * np.eye(KINDS), slope - RIDGE * (now - _START[row[0]]))
                self.weights[row[0]] = np.clip(now + np.clip(move, -0.5, 0.5), -1, 4)
        held.destroy()


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    values = values.reshape(-1)
    planes = np.empty((values.itemsize, len(values)), np.uint8)
    for k, plane in enumerate(planes):
        plane[:] = values >> values.dtype.type(8 * k) & values.dtype.type(0xFF)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueeze(raw: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


#: Tables of counted bits: of the word before, and of the bytes.
_TABLES = (AFTER_BITS, *BYTE_BITS)
_STARTS = np.cumsum([0, *(1 << max(0, bits - _PACK) for bits in _TABLES)])  # in blocks


def _count_bits(code: Code, symbol: np.ndarray, contexts: list[np.ndarray], tables: list[np.ndarray], bits: tuple[int, ...], times: np.ndarray | None = None) -> None:
    """Counts the bits of some symbols, that came so many times each, in the slots of their contexts."""
    order, have = code.by_length(symbol)
    left, contexts = code.left[symbol[order]], [c[order] for c in contexts]
    if times is not None:
        times = times[order]
    for place, n in enumerate(have):
        node, bit = code.nodes_at(left[:n], place), code.bits_at(left[:n], place)
        for table, width, c in zip(tables, bits, contexts):
            slot = _slots(c[:n], width, node)
            slot <<= 1
            slot += bit
            np.add.at(table, slot, _W(1) if times is None else times[:n])


def _count_pairs(code: Code, pairs: list[np.ndarray], table: np.ndarray) -> None:
    """Counts the bits of symbols behind words, given as context << 18 | symbol; equal pairs are summed first."""
    keys = np.concatenate(pairs)
    keys.sort()
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    times, keys = np.diff(np.append(new, len(keys))).astype(_W), keys[new]
    for low in range(0, len(keys), _TOKENS_AT_ONCE):
        some = keys[low : low + _TOKENS_AT_ONCE]
        _count_bits(code, (some & _U(0x3FFFF)).astype(np.int64), [(some >> _U(18)).astype(_W)], [table], (AFTER_BITS,), times[low : low + _TOKENS_AT_ONCE])


def count_contexts(docs: DataFrame, model: Model) -> DataFrame:
    """(block, every, rest) of docs (text, apart), a written table: counts become values, and followers the slots that hold them.

    rest leaves out what ``apart`` texts count.  A task counts into whole
    tables, sorts what followed, some at a time, and sends one compressed row
    for each block that it touched; rows are added up by block, so the result is the same
    however the texts are dealt out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("raw", pa.binary())])

    def count(batches):
        model = held.value
        seen: dict[int, list[np.ndarray]] = {}
        after: dict[int, list[np.ndarray]] = {0: [], 1: []}
        pairs: dict[int, list[np.ndarray]] = {0: [], 1: []}
        bytes_ = np.zeros((2, 256), np.int64)  # of spelt words, which stand for their first table
        size = 0

        def tables_():
            for part, tables in seen.items():
                if pairs[part]:
                    _count_pairs(model.code, pairs[part], tables[0])
                    pairs[part] = []
                at, _, node, bit = _paths(model.byte_code, np.arange(256))
                np.add.at(tables[1], _slots(np.zeros(len(at), _W), BYTE_BITS[0], node) * 2 + bit, bytes_[part][at].astype(_W))
                bytes_[part] = 0
                for start, bits, table in zip(_STARTS.tolist(), _TABLES, tables):
                    blocks = table.reshape(-1, 2 << min(bits, _PACK))
                    for i in np.flatnonzero(blocks.any(axis=1)).tolist():
                        yield start + i, part, blocks.shape[1], b"", _squeeze(blocks[i])
                    table[:] = 0

        def followers(part):
            if not after[part]:
                return
            keys = np.concatenate(after[part])
            after[part] = []
            keys.sort()
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            key, times = keys[new], np.diff(np.append(new, len(keys))).astype(np.uint32)
            del keys, new
            block = (key >> _U(26 + _PACK)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(key)]
            for a, b in zip(cuts, cuts[1:]):
                packed = np.diff(key[a:b], prepend=_U(block[a]) << _U(26 + _PACK))
                yield int(block[a] + _STARTS[-1]), part, b - a, _squeeze(packed), _squeeze(times[a:b])

        def out(made):
            while found := list(itertools.islice(made, 64)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for part in (0, 1):
                texts = batch.column(0).filter(pa.array(flags == bool(part)))
                for _, _, data, offsets in tk.chunks(texts, _CHUNK):
                    t = Tokens(model.words, model.kind, data, offsets)
                    if part not in seen:
                        seen[part] = [np.zeros(2 << bits, np.uint32) for bits in _TABLES]
                    tables = seen[part]
                    pairs[part].append(t.after.astype(np.uint64) << _U(18) | t.symbol.astype(np.uint64))
                    if sum(len(k) for k in pairs[part]) >= _PAIRS:
                        _count_pairs(model.code, pairs[part], tables[0])
                        pairs[part] = []
                    rare = np.flatnonzero(t.rare)
                    for low in range(0, len(rare), _TOKENS_AT_ONCE):
                        _, byte, contexts = t.spelt(rare[low : low + _TOKENS_AT_ONCE])
                        _count_bits(model.byte_code, byte, contexts[1:], tables[2:], BYTE_BITS[1:])
                        bytes_[part] += np.bincount(byte, minlength=256)
                    for hashes in t.runs:
                        after[part].append((hashes >> _U(64 - model.run_bits) << _U(26)) | ((hashes & _U(0xFF)) << _U(18)) | t.symbol.astype(np.uint64))
                    if sum(len(k) for k in after[part]) >= _FOLLOWERS:
                        yield from out(followers(part))
                    size += len(data)
            if size > _FLUSH:
                yield from out(tables_())
                size = 0
        yield from out(itertools.chain(tables_(), followers(0), followers(1)))

    def add(batches):
        now, sums, fresh = None, {}, {}
        schema = pa.schema([("block", pa.int64()), ("every", pa.binary()), ("rest", pa.binary())])

        def finished():
            if now < _STARTS[-1]:
                done = [_values(x.reshape(-1, 2)).tobytes() for x in (sum(sums.values()), sums.get(0, 0 * sum(sums.values())))]
            else:
                base = _U(now - int(_STARTS[-1])) << _U(26 + _PACK)
                rest = [_merged(sums[0])] if 0 in sums else []
                done = [_best_followers(base, rows).tobytes() for rows in (rest + sums.get(1, []), rest)]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(done[:1], pa.binary()), pa.array(done[1:], pa.binary())], schema=schema)

        for batch in batches:
            for block, part, n, keys, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield finished()
                    now, sums, fresh = block, {}, {}
                if block < _STARTS[-1]:
                    sums[part] = sums.get(part, 0) + _unsqueeze(raw, np.uint32, n).astype(np.int64)
                else:
                    held = sums.setdefault(part, [])
                    base = _U(block - int(_STARTS[-1])) << _U(26 + _PACK)
                    held.append((np.cumsum(_unsqueeze(keys, np.uint64, n)) + base, _unsqueeze(raw, np.uint32, n).astype(np.int64)))
                    fresh[part] = fresh.get(part, 0) + n  # since the last merge
                    if len(held) > 1 and fresh[part] > max(1 << 20, len(held[0][0])):
                        sums[part], fresh[part] = [_merged(held)], 0
        if now is not None:
            yield finished()

    counted = docs.mapInArrow(count, "block long, part int, n long, keys binary, raw binary")
    done = materialise(counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, every binary, rest binary"))
    held.destroy()
    return done


def _merged(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their times; each of rows is ascending."""
    key, *times = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return key[new], *(np.add.reduceat(x[order], new) if len(key) else x for x in times)


def _best_followers(base: np.uint64, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slots of a block: for each the check, symbol and times of the context and follower that came most often."""
    out = np.zeros(1 << _PACK, np.uint32)
    if not rows:
        return out
    key, times = _merged(rows) if len(rows) > 1 else rows[0]
    if not len(key):
        return out
    # keys are in order of their slots; of those that came most often the least one stays
    slot = ((key - base) >> _U(26)).astype(np.int64)
    new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    most = np.maximum.reduceat(times, new)
    often = np.flatnonzero(times == np.repeat(most, np.diff(np.append(new, len(key)))))
    best = often[np.append(True, slot[often][1:] != slot[often][:-1])]
    out[slot[best]] = (key[best] & _U(0x3FFFFFF)).astype(np.uint32) | (np.minimum(times[best], 63).astype(np.uint32) << _W(26))
    return out


def collect_tables(blocks: DataFrame, run_bits: int, names: tuple[str, ...] = ("every", "rest")) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """The tables of all texts and of those that aren't apart, or of one of them, on the driver: at most those of AFTER_BITS, BYTE_BITS and RUN_BITS."""
    done = [([np.zeros(1 << bits, np.int16) for bits in _TABLES], np.zeros(1 << run_bits, np.uint32)) for _ in names]
    for row in blocks.select("block", *names).toLocalIterator():
        for (tables, runs), raw in zip(done, row[1:]):
            if row["block"] >= _STARTS[-1]:
                at = (row["block"] - int(_STARTS[-1])) << _PACK
                runs[at : at + (1 << _PACK)] = np.frombuffer(raw, np.uint32)
            else:
                k = int(np.searchsorted(_STARTS, row["block"], "right")) - 1
                at, values = (row["block"] - int(_STARTS[k])) << _PACK, np.frombuffer(raw, np.int16)
                tables[k][at : at + len(values)] = values
    return done


def count_words(docs: DataFrame) -> DataFrame:
    """(kind, h, c, r) of docs (text, apart): how often each word, by its 64-bit hash (kind 0), byte (kind 1) and end (kind 2) comes in all texts, and in those that aren't apart."""
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("r", pa.int64())])

    def run(batches):
        held: list = []
        bytes_, texts = np.zeros((2, 256), np.int64), np.zeros((2, 1), np.int64)

        def out(kind, h, c, r):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(c), pa.array(r)], schema=schema)

        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            texts += [[len(flags)], [(~flags).sum()]]
            for a, b, data, offsets in tk.chunks(batch.column(0), 1 << 21):
                data = tk.LOWER[data]
                words, _, _, first = tk.word_hashes(data, offsets)
                rest = ~flags[a:b][tk.rows_of(first)]
                for own, counts in ((words[rest], 1), (words[~rest], 0)):
                    own.sort()
                    new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))[: len(own)]
                    times = np.diff(np.append(new, len(own)))
                    held.append((own[new], times, times * counts))
                bytes_[0] += np.bincount(data, minlength=256)
                bytes_[1] += np.bincount(data[~flags[a:b][tk.rows_of(offsets)]], minlength=256)
            if len(held) > 16:
                held = [_merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield out(0, held[0][0].view(np.int64), *held[0][1:])
                    held = []
        if held:
            h, c, r = _merged(held)
            yield out(0, h.view(np.int64), c, r)
        yield out(1, np.arange(256), *bytes_)
        yield out(2, np.zeros(1, np.int64), *texts)

    return docs.mapInArrow(run, "kind int, h long, c long, r long").groupBy("kind", "h").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))


def _in_fewer_tasks(docs: DataFrame) -> DataFrame:
    """docs in a quarter of their partitions, but two for each core at least: each task that counts sends and costs whole tables."""
    have = docs.rdd.getNumPartitions()
    return docs.coalesce(max(have // 4, min(have, 2 * docs.sparkSession.sparkContext.defaultParallelism), 1))


def lm_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row.

    The rows for which ``train`` is true are learned from, all of them and
    whole; all rows are scored.  score is the mixer's log10 probability of the
    text's normal form: lower case over A-Z, words with single spaces, an end;
    n_bytes is that form's size.  Null, empty and wordless texts are the end
    alone.  base_score sums log10((c + 1) / (N + V + 1)) over words and the
    end.  Rows that repeat count and are scored each for itself; a null doc_id
    stays null; other columns are ignored, whatever their names; an empty table
    gives no rows, and without training rows N, V and all counts are 0.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    # exact copies go the same way, or a text's copy would tell what it holds
    rows = rows.withColumn("apart", F.col("train") & (F.pmod(F.xxhash64("text"), F.lit(FOLD)) == 0))
    learned = rows.filter("train").select("text", "apart")
    learned = _in_fewer_tasks(learned)
    apart = materialise(learned.filter("apart").select("text"))
    # few tasks count the texts that are apart, as each sends tables of its own for them
    few = apart.coalesce(max(1, apart.rdd.getNumPartitions() // 6)).select("text", F.lit(True).alias("apart"))
    dealt = learned.filter("not apart").select("text", "apart").unionByName(few)
    counts = materialise(count_words(learned))
    vocabulary = counts.filter("kind = 0")
    total, distinct, rest, once = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum("r"), F.lit(0)), F.count_if(F.col("r") == 1)).first()
    ends, ends_rest = counts.filter("kind = 2").agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    n_train, n_distinct = total + ends, distinct + (1 if ends else 0)
    hot = vocabulary.filter("r > 0").orderBy(F.desc("r"), "h").limit(SYMBOLS).toPandas()
    hot = hot.assign(u=hot["h"].to_numpy(np.int64).view(np.uint64)).sort_values("u")
    words = hot["u"].to_numpy(np.uint64)
    # words that were seen once tell how likely a new one is
    first = np.array([max(1, ends_rest), max(1, rest - int(hot["r"].sum()) + once), *hot["r"]], np.int64)
    every = np.array([max(1, ends), max(1, total - int(hot["c"].sum()) + once), *hot["c"]], np.int64)
    spelt = counts.filter("kind = 1").select("h", "r").toPandas().set_index("h")["r"].reindex(range(256), fill_value=0).to_numpy(np.int64)
    code, byte_code = Code(first), Code(spelt + 1)
    run_bits = int(np.clip(np.round(np.log2(max(1, n_train) / 2)), *RUN_BITS))
    kind = _kinds(first)
    empty = Model(words, kind, code, byte_code, np.zeros((0, 0), np.int16), run_bits, [], np.zeros(0, np.uint32))
    blocks = count_contexts(dealt, empty)

    def built(own: str, counts: np.ndarray, weights: np.ndarray) -> Model:
        # the driver holds one of the two models at a time
        ((tables, runs),) = collect_tables(blocks, run_bits, (own,))
        return Model(words, kind, code, byte_code, np.ascontiguousarray(code.node_values(counts).T), run_bits, tables, runs, weights)

    fitted = built("rest", first, _START.copy())
    fitted.fit(apart)
    held = spark.sparkContext.broadcast((built("every", every, fitted.weights), np.log10(every[2:] + 1.0)))
    schema = pa.schema(
        [("id", pa.int64()), ("train", pa.bool_()), ("rid", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("bits", pa.float64())]
        + [("known", pa.int64()), ("logs", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    )

    def run(batches):
        model, hot_logs = held.value
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(1), _SCORED):
                t = Tokens(model.words, model.kind, data, offsets)
                symbol = t.symbol[t.word_at]
                is_hot = symbol != _ESCAPE
                logs = np.where(is_hot, hot_logs[symbol - 2], 0.0) if len(hot_logs) else np.zeros(len(symbol))
                first = t.first - np.arange(len(t.first))
                n_words = np.diff(first)
                size = tk.segment_sum((t.ends - t.starts)[t.word_at], first) + np.maximum(n_words, 1)
                h, own = t.words[~is_hot].view(np.int64), t.word_text[~is_hot]
                sort = np.lexsort((h, own))
                h, own = h[sort], own[sort]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))) if len(h) else np.zeros(0, np.int64)
                cuts = pa.array(np.searchsorted(own[new], np.arange(len(first))).astype(np.int32))
                rare, times = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h[new], np.diff(np.append(new, len(h))).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b], batch.column(3)[a:b], pa.array(size), pa.array(n_words), pa.array(model.score(t))]
                    + [pa.array(tk.segment_sum(is_hot.astype(np.int64), first)), pa.array(tk.segment_sum(logs, first)), rare, times],
                    schema=schema,
                )

    columns = "id long, train boolean, rid long, n_bytes long, n_words long, bits double, known long, logs double, rare array<long>, times array<int>"
    scored = materialise(rows.select("id", "text", "train", F.monotonically_increasing_id().alias("rid")).mapInArrow(run, columns))
    held.destroy()
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("rid", F.col("w.rare").alias("h"), F.col("w.times").alias("n"))
    found = rare.join(vocabulary, "h").groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    end = float(np.log10(ends + 1.0))
    denominator = float(np.log10(n_train + n_distinct + 1.0))
    out = scored.drop("rare", "times").join(found, "rid", "left").withColumn("n_tokens", F.col("n_words") + 1)
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(denominator)
    return out.select(
        F.col("id").alias(doc_id),
        "train",
        "n_bytes",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2.0)))).alias("score"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
