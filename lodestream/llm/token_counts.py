"""Token counts by byte-pair merging over a heap and a linked list.

The symbols of a word form a doubly linked list; a heap holds the ranked
adjacent pairs.  The lowest rank, leftmost first, is popped and merged until no
ranked pair is left.  The count is the number of initial symbols less the
merges: identifiers are never made.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import prepare

# The characters with the property White_Space, and what may follow an apostrophe as a word of its own.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
# The letters and numbers that Unicode 16.0, the library's version, has beyond 15.1, first and last of each run.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    kinds = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(x))[0], OTHER) for x in range(0x110000)], np.uint8)
    for kind, runs in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for low, high in runs:
            kinds[low : high + 1] = kind
    kinds[WHITE_SPACE] = SPACE
    return kinds


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte-level pre-tokenizer's words of some texts: bounds in bytes, and each text's first word.

    A word is a run of letters, of numbers or of other characters, with one
    space before it if there is one; the rest of white space is a word, but
    for a last character before a word, which is that word's space or a word.
    An apostrophe that begins a word takes a contraction's letters from the
    letters behind it, which go on as a word of their own.
    """
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # the characters' first bytes
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _kinds()[point]
    n = len(kind)
    first = np.searchsorted(at, offsets)  # in characters
    starts_text, ends_text = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    starts_text[first[:-1]] = True
    ends_text[first[1:]] = True  # at the character after a text's last
    change = np.empty(n + 1, bool)
    change[0], change[-1] = True, True
    change[1:-1] = kind[1:] != kind[:-1]
    change |= starts_text | ends_text
    runs = np.flatnonzero(change)
    begin, end = runs[:-1], runs[1:]
    cut = change[:n].copy()
    # white space before something else in the same text: its last character stands apart,
    white = (kind[begin] == SPACE) & (end < n) & ~ends_text[end]
    last = end[white] - 1
    cut[last] = True
    # and if it is a space, what follows goes on from it
    cut[last[point[last] == 0x20] + 1] = False
    # contractions
    marks = np.flatnonzero(cut[:-1] & (point[:-1] == 0x27) & (kind[1:] == LETTER) & ~ends_text[1:n])
    for i in marks.tolist():
        for letters in CONTRACTIONS:
            stop = i + 1 + len(letters)
            if point[i + 1 : stop].tolist() == [ord(c) for c in letters] and not ends_text[i + 2 : stop].any():
                cut[i + 1] = False
                if stop < n and kind[stop] == LETTER:
                    cut[stop] = True
                break
    words = np.flatnonzero(cut)
    return np.append(at[words], len(data)), np.searchsorted(words, first)


#: Words whose counts a worker keeps, in two generations: a full one becomes the old one, whose words come back
#: when they are met again.  Longer words are counted anew each time.
KEPT_WORDS, KEPT_LENGTH = 300_000, 48


def _byte_symbols() -> list[str]:
    """The vocabulary's printable character for each byte value: itself where printable, else the next from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(spare)) for b in range(256)]


def load_merges(tokenizer_json: bytes) -> tuple[list[dict[int, int]], list[int], list[int], list[str]]:
    """Ranks of pairs [left][right], the symbol that each rank makes, the 256 byte symbols, the added strings."""
    spec = json.loads(tokenizer_json)
    vocab = spec["model"]["vocab"]
    ranks, made = [{} for _ in range(max(vocab.values()) + 1)], []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[left]].setdefault(vocab[right], rank)
        made.append(vocab[left + right])
    return ranks, made, [vocab[c] for c in _byte_symbols()], [t["content"] for t in spec.get("added_tokens", [])]


def count_symbols(symbols: list[int], ranks: list[dict[int, int]], made: list[int]) -> int:
    """Symbols that are left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    # the rank of the pair that begins at each symbol, None for none; -1 where the symbol is gone
    pairs = [ranks[a].get(b) for a, b in zip(symbols, symbols[1:])]
    heap = [r * n + i for i, r in enumerate(pairs) if r is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    pairs.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pop, push, left = heapq.heappop, heapq.heappush, n
    while heap:
        rank, i = divmod(pop(heap), n)
        if pairs[i] != rank:
            continue  # one of the two has been merged since
        left -= 1
        j = after[i]
        symbols[i] = symbol = made[rank]
        pairs[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pairs[i] = r = ranks[symbol].get(symbols[k])
            if r is not None:
                push(heap, r * n + i)
        else:
            pairs[i] = None
        k = before[i]
        if k >= 0:
            pairs[k] = r = ranks[symbols[k]].get(symbol)
            if r is not None:
                push(heap, r * n + k)
    return left


class TokenCounter:
    """Counts the tokens of texts; keeps the counts of recent short words."""

    def __init__(self, tokenizer_json: bytes):
        self.ranks, self.made, self.bytes, self.added = load_merges(tokenizer_json)
        self.kept: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        count = self.old.get(word)
        if count is None:
            symbol = self.bytes
            count = count_symbols([symbol[b] for b in word], self.ranks, self.made)
        if len(word) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_WORDS:
                self.kept, self.old = {}, self.kept
            self.kept[word] = count
        return count

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Counts of texts without added strings."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        bounds, first = word_bounds(data, offsets)
        raw, bounds = data.tobytes(), bounds.tolist()
        words = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        counts = list(map(self.kept.get, words))
        for i, n in enumerate(counts):
            if n is None:
                word = words[i]
                counts[i] = self.kept.get(word) or self.word(word)
        return tk.segment_sum(np.array(counts, np.int64), first)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Counts of whole texts; each added string inside a text is one token and parts its words."""
        out = np.zeros(len(texts), np.int64)
        special = np.zeros(len(texts), bool)
        for added in self.added:
            special |= pc.fill_null(pc.match_substring(texts, added), False).to_numpy(zero_copy_only=False)
        if special.any():
            split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).split
            for i in np.flatnonzero(special).tolist():
                parts = split(texts[i].as_py())
                out[i] = len(parts) - 1 + self.count_plain(pa.array(parts)).sum()
            texts = pc.if_else(pa.array(special), "", texts)
        return out + self.count_plain(texts)

    def count_plain(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([self.plain(data, offsets) for _, _, data, offsets in tk.chunks(texts)] or [np.zeros(0, np.int64)])


_counters: dict[int, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    Whole texts, no special tokens added; the vocabulary's own special strings
    inside a text count as one token each.  Null and empty texts: 0 bytes, 0
    tokens.  Repeated rows are reported as often as they come, a null doc_id
    stays null, other columns are ignored, an empty table gives no rows.  The
    vocabulary file (a fixed size, whatever the input) is read by the driver
    and broadcast.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, "rb") as file:
        spec = spark.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        key = hash(spec.value)
        if key not in _counters:
            _counters.clear()
            _counters[key] = TokenCounter(spec.value)
        count = _counters[key].count
        for batch in batches:
            sizes = np.diff(tk.string_buffers(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(count(batch.column(1)))], schema=schema)

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
