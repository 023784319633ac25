"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A CGK walk reads a window's words and, after each step, stays or moves on by a
random bit of the word and the step: windows at a small edit distance give
walks at a small Hamming distance.  Windows as long as an item start at every
word; each repetition samples some steps of the walk, and a window whose
sampled words equal an item's is a candidate, for which the exact edit distance
decides.  Windows are walked only where they can be near: an item of n words
with at most k edits leaves n - q + 1 - k * q of its word q-grams, and a place
with fewer q-grams of that item can't match.  That test drops no match.
Windows run over a text's ends, filled up, so that a copy cut off there is
found.  Walks drift apart with length: items are cut into pieces of at most
``PIECE`` words, one of which has no more than its own part of the edits, and
a piece's window leads to the whole item's distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import materialise, prepare

#: Edits by words, as a part of the item's words; items of fewer words are looked for without edits.
MAX_EDITS, MIN_WORDS = 0.2, 8
#: Words of the pieces that items are cut into, at most.
PIECE = 64
#: Sampled steps of a repetition, and the chance of a candidate that the repetitions reach at MAX_EDITS.
SAMPLES, RECALL = 3, 0.98
#: Bytes of the items that are broadcast at once; larger benchmarks go in as many passes as they need.
BROADCAST_BYTES = 16_000_000
GRAM = 3
FILTER_BITS = 22
_U = np.uint64
_PAD = _U(0x1234567)


def _words(column: pa.Array):
    """Chunks of texts: word hashes and each text's first word; letters and digits, in lower case."""
    for a, b, data, offsets in tk.chunks(pc.utf8_lower(column.fill_null(""))):
        words, _, _, first = tk.word_hashes(data, offsets, tk.ALNUM)
        yield a, b, words, first


def _grams(words: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(words) - GRAM + 1, 0), np.uint64)
    for k in range(GRAM):
        out += words[k : k + len(out)] * _U(pow(0xA0761D6478BD642F, 2 * k + 1, 1 << 64))
    return tk.mix(out)


def edits_within(a: list[int], b: list[int], most: int) -> tuple[int, int, int] | None:
    """The least edit distance of a to a part of b, if at most ``most``: (distance, start, end in b); the leftmost end.

    Rows of the dynamic programme over b, with the starts of the best parts.
    """
    far = most + 1
    column = list(range(len(a) + 1))
    starts = [0] * (len(a) + 1)
    best = None
    for j, y in enumerate(b, 1):
        above, above_start = 0, j - 1  # of the column before
        column[0], starts[0] = 0, j
        for i, x in enumerate(a, 1):
            here, here_start = above + (x != y), above_start
            above, above_start = column[i], starts[i]
            if above + 1 < here:
                here, here_start = above + 1, above_start
            if column[i - 1] + 1 < here:
                here, here_start = column[i - 1] + 1, starts[i - 1]
            column[i], starts[i] = here, here_start
        if column[-1] < far:
            far = column[-1]
            best = (far, starts[-1], j)
    return best


class Items:
    """The benchmark's items, their pieces' walks and the tables that windows are looked up in.

    Items of fewer words than a q-gram are found only where they are a text's
    only words: ``whole`` has them.
    """

    def __init__(self, ids: list[int], words: list[np.ndarray], seed: int = 3):
        self.ids, self.words = ids, words
        self.most = [int(len(w) * MAX_EDITS) if len(w) >= MIN_WORDS else 0 for w in words]
        self.whole: dict[tuple[int, ...], list[int]] = {}
        pieces = []
        for k, w in enumerate(words):
            if len(w) >= GRAM:
                cut = -(-len(w) // PIECE)
                bounds = [i * len(w) // cut for i in range(cut + 1)]
                pieces += [(k, low, high) for low, high in zip(bounds, bounds[1:])]
            elif len(w):
                self.whole.setdefault(tuple(w.tolist()), []).append(k)
        self.item = np.array([k for k, _, _ in pieces], np.int64)
        self.offset = np.array([low for _, low, _ in pieces], np.int64)
        self.pieces = [words[k][low:high] for k, low, high in pieces]
        self.lengths = sorted({len(w) for w in self.pieces})
        grams = [np.unique(_grams(w)) for w in self.pieces]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.gram_items = flat[order], item[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[flat >> _U(64 - FILTER_BITS)] = True
        # the q-grams that a near part has at least, and the words that it has at most
        size = np.array([len(w) for w in self.pieces], np.int64)
        edits = np.array([int(n * MAX_EDITS) if self.most[k] else 0 for n, k in zip(size.tolist(), self.item.tolist())], np.int64)
        self.size, self.edits = size, edits
        self.needed = np.maximum(1, size - GRAM + 1 - edits * GRAM)
        # a step's words agree with about this chance at MAX_EDITS: an edit costs some steps until the walks meet again
        agree = max(0.05, 1 - 3 * MAX_EDITS)
        self.repeats = int(np.ceil(np.log(1 - RECALL) / np.log(1 - agree**SAMPLES)))
        self.seed = seed
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.lengths:
            own = np.flatnonzero(size == n)
            keys = self.signatures(np.stack([self.pieces[k] for k in own.tolist()]), n)
            flat, item = keys.ravel(), np.repeat(own, keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.tables[n] = flat[order], item[order]

    def signatures(self, windows: np.ndarray, n: int) -> np.ndarray:
        """(windows, repetitions): hashes of the sampled steps of each repetition's walk over 2 * n steps."""
        rng = np.random.default_rng(self.seed * 1009 + n)
        sampled = np.argsort(rng.random((self.repeats, 2 * n)), axis=1)[:, :SAMPLES]
        salts = rng.integers(1, 1 << 63, (2 * n, self.repeats), dtype=np.uint64)
        padded = np.concatenate([windows, np.full((len(windows), 1), _PAD)], axis=1)
        at = np.zeros((len(windows), self.repeats), np.int64)
        keys = np.broadcast_to(np.arange(self.repeats, dtype=np.uint64), at.shape).copy()
        rows = np.arange(len(windows))[:, None]
        for step in range(2 * n):
            word = padded[rows, at]
            own = np.flatnonzero((sampled == step).any(axis=1))
            keys[:, own] = tk.mix(keys[:, own] * _U(0xE7037ED1A0B428DB) + word[:, own])
            at = np.minimum(at + (tk.mix(word ^ salts[step]) & _U(1)).astype(np.int64), n)
        return keys

    def places(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, text, window start) of all windows that hold enough of the piece's q-grams."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = _grams(words)
        ok = self.filter[grams >> _U(64 - FILTER_BITS)]
        for k in range(1, GRAM):  # a gram over the end of a text isn't one
            at = first[1:] - k
            ok[at[(at >= 0) & (at < len(ok))]] = False
        at = np.flatnonzero(ok)
        low, high = np.searchsorted(self.grams, grams[at]), np.searchsorted(self.grams, grams[at], "right")
        times = high - low
        if not times.sum():
            return none
        place = np.repeat(at, times)
        item = self.gram_items[np.repeat(low, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        # enough grams of one piece within a part's largest size, in one text
        last = np.arange(len(item)) + self.needed[item] - 1
        fits = last < len(item)
        last = np.minimum(last, len(item) - 1)
        text = np.searchsorted(first, place, "right") - 1
        fits &= (item[last] == item) & (text[last] == text) & (place[last] - place <= self.size[item] + self.edits[item] - GRAM)
        low, high, item, text = place[last[fits]], place[fits], item[fits], text[fits]
        begin = np.maximum(low - self.size[item] - self.edits[item], first[text] - self.edits[item])
        end = np.minimum(high + self.edits[item], first[text + 1] - 1)
        length = np.maximum(end - begin + 1, 0)
        start = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        # a window may begin before its text, so starts go with the text that they are of
        found = np.unique(np.stack([np.repeat(item, length), np.repeat(text, length), start]), axis=1)
        return found[0], found[1], found[2]

    def matches(self, words: np.ndarray, first: np.ndarray):
        """(text, item, distance, start, end in words of the text) of the items found in the texts."""
        if not self.ids or not len(words):
            return
        found: dict[tuple[int, int], list[int]] = {}
        if self.whole:
            count = np.diff(first)
            for text in np.flatnonzero((count > 0) & (count < GRAM)).tolist():
                for k in self.whole.get(tuple(words[first[text] : first[text + 1]].tolist()), []):
                    found[text, k] = [int(first[text])]
        want, of, place = self.places(words, first)
        for n in np.unique(self.size[want]).tolist():
            here = self.size[want] == n
            live = np.unique(np.stack([of[here], place[here]]), axis=1)
            keys, piece = self.tables[n]
            for a in range(0, live.shape[1], 512):
                own, part = live[:, a : a + 512]
                at = part[:, None] + np.arange(n)
                inside = (at >= first[own][:, None]) & (at < first[own + 1][:, None])
                windows = np.where(inside, words[np.clip(at, 0, len(words) - 1)], _PAD)
                made = self.signatures(windows, n)
                low, high = np.searchsorted(keys, made.ravel()), np.searchsorted(keys, made.ravel(), "right")
                for hit in np.flatnonzero(high > low).tolist():
                    where, text = int(part[hit // self.repeats]), int(own[hit // self.repeats])
                    for p in set(piece[low[hit] : high[hit]].tolist()):
                        found.setdefault((text, int(self.item[p])), []).append(where - int(self.offset[p]))
        for (text, k), starts in sorted(found.items()):
            item, most = self.words[k], self.most[k]
            begin, stop = int(first[text]), int(first[text + 1])
            best, checked = None, -1
            for at in sorted(set(starts)):
                if at + len(item) + most <= checked:
                    continue  # within the part that has been checked
                low, checked = max(begin, at - most), min(stop, at + 2 * len(item) + most)
                got = edits_within(item.tolist(), words[low:checked].tolist(), most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1] - begin, low + got[2] - begin)
            if best:
                yield text, k, *best


def read_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """All items, of about BROADCAST_BYTES each time."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // BROADCAST_BYTES))
    for k in range(passes):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).orderBy("id", "text").toPandas()
        words: list[np.ndarray] = []
        for _, _, hashes, first in _words(pa.array(part["text"], pa.string())):
            words += [hashes[p:q] for p, q in zip(first[:-1].tolist(), first[1:].tolist())]
        yield Items(part["id"].tolist(), words)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): the items that each document holds a near copy of.

    Words are runs of letters and digits in lower case; a document holds an
    item when some part of it is at most MAX_EDITS of the item's words away, by
    words.  start and end, in words from 0, are the nearest part found.  Items
    below MIN_WORDS words are found without edits, those of one or two words
    only as a text's only words, those without words never.  Documents without a leak, with a
    null or empty text or a null doc_id give no row; rows that repeat a doc_id
    give one row for each item, the nearest; other columns are ignored.  An
    empty table on either side gives no rows.
    """
    spark = prepare(docs.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "start", "end")])

    def run(held, batches):
        items = held.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, words, first in _words(batch.column(1)):
                rows = [(ids[a + t], items.ids[k], *rest) for t, k, *rest in items.matches(words, first)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    kind = "doc_id long, item_id long, distance long, start long, end long"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    passes = [rows.mapInArrow(partial(run, spark.sparkContext.broadcast(items)), kind) for items in read_items(benchmark)]
    # one pass is left to the caller's job; with more, no worker holds two
    found = passes[0] if len(passes) == 1 else reduce(DataFrame.unionByName, [materialise(x) for x in passes])
    found = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("m"))
    return found.select(F.col("doc_id").alias(doc_id), "item_id", "m.distance", "m.start", "m.end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a near copy of a benchmark item (see ``leaks``).

    Each row is judged by its own text, whatever its doc_id: null or repeated.
    Rows with a null or empty text stay.  All columns are returned, whatever
    their names, and nothing is shuffled.
    """
    spark = prepare(docs.sparkSession)
    names = docs.schema.names

    def run(held, batches):
        items = held.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, words, first in _words(batch.column(batch.num_columns - 1)):
                keep[[a + t for t, *_ in items.matches(words, first)]] = False
            yield batch.filter(pa.array(keep))

    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    rows = rows.withColumn("__text", F.col(f"c{names.index(text)}"))
    kind = rows.schema
    for k, items in enumerate(read_items(benchmark)):
        rows = (materialise(rows) if k else rows).mapInArrow(partial(run, spark.sparkContext.broadcast(items)), kind)
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
