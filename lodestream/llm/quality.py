"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; filters of ``WIDTH`` bytes run over the text every
``STRIDE`` bytes.  Their outputs are max-pooled over overlapping chunks that
cover the whole text; the largest and the mean of the chunks' maxima feed one
logistic unit.  All of it is trained by backpropagation through the maxima.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import prepare

EMBED, STRIDE, WIDTH, FILTERS = 8, 4, 8, 32
CHUNK, STEP = 128, 96  # windows in a chunk, and from one chunk's start to the next's
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Bounds of the sample for fitting.
MAX_ROWS, MAX_BYTES = 4000, 12_000_000


def _blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text padded with zero bytes to whole strides and a window's rest; offsets of texts in strides.

    A text has at least one window: two blocks.
    """
    size = np.diff(offsets)
    blocks = np.maximum(-(-size // STRIDE), 1) + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * STRIDE, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * STRIDE - offsets[:-1], size)] = data
    return out, first


def _chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at which chunks start and end, and each text's first chunk."""
    windows = np.diff(first) - 1
    count = np.maximum(-(-(windows - CHUNK) // STEP), 0) + 1
    first_chunk = np.concatenate([[0], np.cumsum(count)])
    text = tk.rows_of(first_chunk)
    start = first[text] + (np.arange(first_chunk[-1]) - first_chunk[text]) * STEP
    return start, np.minimum(start + CHUNK, first[text] + windows[text]), first_chunk


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.filters = (rng.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Outputs of all filters at each stride; the last window of each text is left out by the chunks' bounds."""
        rows = self.embed[data].reshape(-1, STRIDE * EMBED)
        half = STRIDE * EMBED
        z = rows @ self.filters[:half]
        z[:-1] += rows[1:] @ self.filters[half:]
        return z

    def head(self, most: np.ndarray, first_chunk: np.ndarray):
        act = np.maximum(most + self.bias, 0)
        top = np.maximum.reduceat(act, first_chunk[:-1])
        mean = np.add.reduceat(act, first_chunk[:-1]) / np.diff(first_chunk)[:, None]
        features = np.concatenate([top, mean], axis=1)
        return act, top, features, 1 / (1 + np.exp(-np.clip(features @ self.out + self.out_bias[0], -40, 40)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        padded, first = _blocks(data, offsets)
        start, end, first_chunk = _chunk_bounds(first)
        z = self.windows(padded)
        pairs = np.empty(2 * len(start), np.int64)
        pairs[::2], pairs[1::2] = start, end
        return self.head(np.maximum.reduceat(z, pairs)[::2], first_chunk)[-1].astype(np.float64)

    def gradients(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        padded, first = _blocks(data, offsets)
        start, end, first_chunk = _chunk_bounds(first)
        z = self.windows(padded)
        at = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        column = np.arange(FILTERS)
        act, top, features, p = self.head(z[at, column], first_chunk)
        text = tk.rows_of(first_chunk)
        err = ((p - y) / len(y)).astype(np.float32)
        g_top, g_mean = err[:, None] * self.out[:FILTERS], err[:, None] * self.out[FILTERS:] / np.diff(first_chunk)[:, None]
        is_top = act == top[text]
        ties = np.add.reduceat(is_top.astype(np.float32), first_chunk[:-1])
        g_act = (g_mean[text] + is_top * (g_top / ties)[text]) * (act > 0)
        bytes_ = padded[(at * STRIDE)[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        seen = self.embed[bytes_].reshape(len(start), FILTERS, WIDTH * EMBED)
        g_filters = np.einsum("cf,cfk->kf", g_act, seen, optimize=True)
        g_seen = g_act[:, :, None] * self.filters.T[None]
        g_embed = np.zeros_like(self.embed)
        flat, values = bytes_.reshape(-1), g_seen.reshape(-1, EMBED)
        for k in range(EMBED):
            g_embed[:, k] = np.bincount(flat, values[:, k], 256)
        return [g_embed, g_filters, g_act.sum(axis=0), features.T @ err, np.array([err.sum()], np.float32)]


def fit(texts: list[str], y: np.ndarray, seed: int = 5) -> Network:
    """Adam over shuffled batches of texts; with labels of one kind only, the network just gives that kind's prior."""
    net = Network(seed)
    if not len(texts) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias[:] = 0 if not len(y) else (3 if y.min() == 1 else -3)
        return net
    net.out_bias[:] = np.log(y.mean() / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    total = EPOCHS * -(-len(raw) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(raw))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in part])])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, m, v in zip(net.parameters(), net.gradients(np.concatenate([raw[i] for i in part]), offsets, y[part]), first, second, strict=True):
                g = g + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row's whole text; null and empty texts are one window of zero bytes.

    Rows are scored as they come, repeated or not, a null doc_id stays null,
    other columns are ignored, an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(1), 1 << 18):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(held.value.predict(data, offsets))], schema=schema)

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.withColumnRenamed("doc_id", doc_id)
