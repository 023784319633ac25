"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from the
words that it holds, and how these begin and end; the document's is their
noisy-or, 1 - prod(1 - p).  Only documents are labelled: the gradient of the
document's loss tells how much each sentence has to move, which finds the
offending ones.  Words, beginnings and endings are known by 64 bits, so a rare
word never takes another's weight; those that documents of both labels hold
alike are left out before the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import prepare

#: Bytes of a word's beginnings and endings, for stems that take many forms.
ENDS = range(3, 8)
#: Slots that documents are counted in before the fit, as a power of two; of the filter of a model's marks.
SLOT_BITS, FILTER_BITS = 23, 20
#: Documents of a mark, in the sample, and standard errors between the labels' shares of it, to have a weight; and sentences of all marks that the fit holds at most.
MIN_DOCUMENTS, APART, MAX_PAIRS = 4, 4.0, 4_000_000
EPOCHS, RATE, L1 = 150, 0.08, 3e-4

# Letters only, so that punctuation stuck to a word doesn't hide it.
_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?\n"]] = True
_BEGINS, _CLOSES = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def sentences(data: np.ndarray, offsets: np.ndarray):
    """The first sentence of each text, starts and ends in bytes.

    A sentence ends after . ! ? or a line feed, or with its text; an empty text is one empty sentence.
    """
    ends = np.flatnonzero(_STOP[data]) + 1
    inner = ends[~np.isin(ends, offsets)]
    bounds = np.sort(np.concatenate([inner, offsets[:-1]]))  # an empty text adds a bound of its own
    first_sentence = np.searchsorted(inner, offsets[:-1]) + np.arange(len(offsets) - 1)
    return np.append(first_sentence, len(bounds)), bounds, np.append(bounds[1:], offsets[-1])


def marks(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray):
    """(hash, sentence) of the words of sentences that begin there, a part at a time: whole words, then beginnings and endings by size."""
    lower = tk.LOWER[data]
    starts, ends, _ = tk.spans(_WORD[lower], offsets)
    sentence = np.searchsorted(begins, starts, "right") - 1  # of equal bounds the last one: the others are empty
    sums = tk.prefix_sums(lower)
    yield tk.substring_hash(sums, starts, ends), sentence
    for size in ENDS:
        long = ends - starts >= size
        starts, ends, sentence = starts[long], ends[long], sentence[long]
        yield tk.substring_hash(sums, starts, starts + size) ^ _BEGINS, sentence
        yield tk.substring_hash(sums, ends - size, ends) ^ _CLOSES, sentence


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class NoisyOr:
    """Weights of marks, by their hashes in ascending order, and the bias of a sentence."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[names >> np.uint64(64 - FILTER_BITS)] = True

    def found(self, hashes: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, place among the names) of the marks that have a weight."""
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        hashes, sentence = hashes[some], sentence[some]
        at = np.searchsorted(self.names, hashes)
        same = np.flatnonzero(self.names[np.minimum(at, len(self.names) - 1)] == hashes) if len(self.names) else at
        return sentence[same], at[same]

    def sentence_scores(self, data: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        sentence, at = once(*(np.concatenate(x) for x in zip(*(self.found(*part) for part in marks(data, offsets, begins)))))
        return _sigmoid(np.bincount(sentence, self.weights[at], len(begins)) + self.bias)

    @staticmethod
    def combine(p: np.ndarray, first_sentence: np.ndarray) -> np.ndarray:
        return 1 - np.exp(tk.segment_sum(np.log1p(-np.minimum(p, 1 - 1e-12)), first_sentence))


def once(sentence: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mark counts once a sentence."""
    pair = np.unique(sentence.astype(np.int64) << 32 | at)
    return pair >> 32, pair & 0xFFFFFFFF


def _apart(n: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Standard errors between the shares of toxic and of other documents that hold a mark; 0 for rare marks."""
    share = n / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / y.sum() + 1 / (len(y) - y.sum())))
    return np.where(n >= MIN_DOCUMENTS, np.abs(toxic / y.sum() - (n - toxic) / (len(y) - y.sum())) / error, 0)


def _telling(column: pa.Array, y: np.ndarray) -> np.ndarray:
    """The slots of hashes that tell the labels apart, as a mask: best first, as many as MAX_PAIRS allows."""
    size = 1 << SLOT_BITS
    n, toxic, times = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    for a, _, data, offsets in tk.chunks(column):
        first_sentence, begins, _ = sentences(data, offsets)
        doc_of = tk.rows_of(first_sentence)
        for hashes, sentence in marks(data, offsets, begins):
            slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            np.add.at(times, slot, 1)
            own = np.unique(doc_of[sentence] << SLOT_BITS | slot)
            np.add.at(n, own & (size - 1), 1)
            np.add.at(toxic, own[y[a + (own >> SLOT_BITS)] > 0] & (size - 1), 1)
    some = np.flatnonzero(n >= MIN_DOCUMENTS)
    z = _apart(n[some], toxic[some], y)
    best = some[np.argsort(-z, kind="stable")][: int((z >= APART).sum())]
    out = np.zeros(size, bool)
    out[best[np.cumsum(times[best], dtype=np.int64) <= MAX_PAIRS]] = True
    return out


def fit(texts: list[str], y: np.ndarray) -> NoisyOr:
    """Full-batch Adam on the documents' cross-entropy, with soft-thresholded weights of marks."""
    if not len(texts) or y.min() == y.max():
        return NoisyOr(np.zeros(0, np.uint64), np.zeros(0), 2.0 if len(y) and y.min() == 1 else -6.0)
    column = pa.array(texts, pa.large_string())
    telling = _telling(column, y)
    hashes, sentence, sentences_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0]
    for _, _, data, offsets in tk.chunks(column):
        first, begins, _ = sentences(data, offsets)
        for h, own in marks(data, offsets, begins):
            keep = telling[h >> np.uint64(64 - SLOT_BITS)]
            hashes.append(h[keep])
            sentence.append(own[keep] + sentences_at[-1])
        sentences_at += (first[1:] + sentences_at[-1]).tolist()
    first_sentence = np.array(sentences_at)
    doc_of, count, n = tk.rows_of(first_sentence), int(first_sentence[-1]), len(y)
    names, column = np.unique(np.concatenate(hashes), return_inverse=True)
    sentence, column = once(np.concatenate(sentence), column)
    # by the marks' own hashes: a slot may hold several
    doc, own = once(doc_of[sentence], column)
    z = _apart(np.bincount(own, minlength=len(names)), np.bincount(own, y[doc], len(names)), y)
    keep = (z >= APART)[column]
    sentence, (kept, column) = sentence[keep], np.unique(column[keep], return_inverse=True)
    names = names[kept]
    w, base = np.zeros(len(names)), max(y.mean(), 1e-3)
    b = float(np.log(base / max(1.0, count / n)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        p = _sigmoid(np.bincount(sentence, w[column], count) + b)
        doc = NoisyOr.combine(p, first_sentence)
        pull = np.where(y > 0, -(1 - doc) / np.maximum(doc, 1e-9), 1.0)
        g_sentence = pull[doc_of] * p / n
        g = np.bincount(column, g_sentence[sentence], len(names))
        gb = g_sentence.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-5
        w -= RATE * (m / (1 - 0.9**step)) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1 / scale, 0)
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return NoisyOr(names[w != 0], w[w != 0], b)


def score(docs: DataFrame, model: NoisyOr, doc_id: str = "doc_id", text: str = "text", offending: float | None = 0.3) -> DataFrame:
    """(doc_id, score, sentences): score is the noisy-or over all sentences of the whole text.

    sentences holds (start, end, score), in bytes of the UTF-8 text, of those
    with at least the probability ``offending``; None leaves the column out.
    Null and empty texts are one empty sentence.  Rows are scored as they come,
    repeated or not, a null doc_id stays null, other columns are ignored, an
    empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast((model.names, model.weights, model.bias))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())] + ([("sentences", pa.list_(span))] if offending is not None else []))

    def run(batches):
        model = NoisyOr(*held.value)
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(1)):
                first_sentence, begins, stops = sentences(data, offsets)
                p = model.sentence_scores(data, offsets, begins)
                columns = [batch.column(0)[a:b], pa.array(model.combine(p, first_sentence))]
                if offending is not None:
                    bad = np.flatnonzero(p >= offending)
                    shift = offsets[tk.rows_of(first_sentence)[bad]]
                    items = pa.StructArray.from_arrays([pa.array(begins[bad] - shift), pa.array(stops[bad] - shift), pa.array(p[bad])], fields=list(span))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, first_sentence), pa.int32()), items))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kind = "doc_id long, score double" + (", sentences array<struct<start: long, end: long, score: double>>" if offending is not None else "")
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kind)
    return out.withColumnRenamed("doc_id", doc_id)
