"""Language identification by n-gram filters of language bitmasks.

One Bloom filter holds the n-grams of all languages: each of its positions is a
bitmask with a bit for each language (bit slices of 64 languages).  The AND of
an n-gram's positions gives all languages that contain it.  A text's hits in a
language are a popcount over its n-grams, from which the hits that the filter's
fill would give by chance are taken off; the largest share decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import materialise, prepare

GRAM = 4  # bytes
HASHES = 3
BITS = 1 << 18
#: An n-gram belongs to a language if this share of the language's n-grams are it,
MIN_SHARE = 2e-5
#: and it is no rarer there than this part of its share in the language where it is most common.
MIN_RATIO = 0.125
UNKNOWN = "und"

_U = np.uint64
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of each text in lower case, everything but letters as spaces; texts' offsets into them.

    Each text is framed by spaces; grams of two spaces or more in a row are left out.
    """
    n = len(offsets) - 1
    framed = np.full(len(data) + 2 * n, 0x20, np.uint8)
    at = np.arange(len(data)) + 2 * tk.rows_of(offsets) + 1
    framed[at] = _LETTERS[data]
    bounds = offsets + 2 * np.arange(n + 1)
    wide = framed.astype(np.uint32)
    if len(wide) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    grams = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    space = framed == 0x20
    double = space[:-1] & space[1:]
    keep = ~(double[:-2] | double[1:-1] | double[2:])  # texts meet at two spaces, so none crosses
    return grams[keep], np.concatenate([[0], np.cumsum(keep)])[np.minimum(bounds, len(keep))]


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def _hash(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    h = tk.mix(grams.astype(np.uint64) + _U(0x632BE59BD9B4E019))
    a, b = h & _U(0xFFFFFFFF), h >> _U(32) | _U(1)
    return [((a + _U(k) * b) & _U(bits - 1)).astype(np.int32) for k in range(HASHES)]


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows with a text and a language."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def batch_of(lang_, counted):
        keys, values = counted
        return pa.RecordBatch.from_arrays([pa.array([lang_] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(values)], schema=schema)

    def merged(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([v for _, v in parts]), len(keys)).astype(np.int64)

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for name in dict.fromkeys(langs):
                for _, _, data, offsets in tk.chunks(_lower(batch.column(0).filter(pa.array(langs == name)))):
                    grams, _ = _grams(data, offsets)
                    parts = held.setdefault(name, [])
                    keys, values = np.unique(grams, return_counts=True)
                    parts.append((keys, values.astype(np.int64)))
                    if len(parts) >= 16:
                        held[name] = [merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 4_000_000:
                for name, parts in held.items():
                    yield batch_of(name, merged(parts))
                held = {}
        for name, parts in held.items():
            yield batch_of(name, merged(parts))

    rows = docs.select(F.col(text), F.col(lang).cast("string")).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilters:
    """The filter of all languages, and what it takes to read it."""

    def __init__(self, names: list[str], rows: list[tuple[int, int]]):
        """rows: (gram, language's index) of all members."""
        self.names = names
        self.slices = max(1, math.ceil(len(names) / 64))
        want = 10 * max(1, max(np.bincount([k for _, k in rows], minlength=1))) if rows else 1
        self.bits = max(BITS, 1 << math.ceil(math.log2(want)))
        self.table = np.zeros((self.slices, self.bits), np.uint64)
        grams = np.array([g for g, _ in rows], np.int64).astype(np.uint32)
        index = np.array([k for _, k in rows], np.int64)
        for position in _hash(grams, self.bits):
            for s in range(self.slices):
                own = index // 64 == s
                np.bitwise_or.at(self.table[s], position[own], _U(1) << (index[own] % 64).astype(np.uint64))
        fill = np.array([(self.table[k // 64] >> _U(k % 64) & _U(1)).mean() for k in range(len(names))])
        self.chance = fill**HASHES

    def languages(self, grams: np.ndarray, slice_: int = 0) -> np.ndarray:
        """Bitmasks of the languages that contain each n-gram."""
        out = None
        for position in _hash(grams, self.bits):
            mask = self.table[slice_][position]
            out = mask if out is None else out & mask
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams in each language, chance hits taken off."""
        grams, first = _grams(data, offsets)
        hits = np.zeros((len(offsets) - 1, len(self.names)))
        masks = [self.languages(grams, s) for s in range(self.slices)]
        for k in range(len(self.names)):
            hits[:, k] = tk.segment_sum((masks[k // 64] >> _U(k % 64) & _U(1)).astype(np.int64), first)
        total = np.maximum(np.diff(first), 1)[:, None]
        return np.clip((hits / total - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageFilters:
    """Learn from all rows of docs with a text and a language.

    Counts stay on the executors; only the members come to the driver, at most
    1 / MIN_SHARE n-grams for each language.
    """
    prepare(docs.sparkSession)
    counts = materialise(count_grams(docs, text, lang))
    # a written table has a size, by which Spark broadcasts it or not
    totals = materialise(counts.groupBy("lang").agg(F.sum("n").alias("all")))
    share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("all"))
    share = share.filter(F.col("share") >= MIN_SHARE)
    best = share.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("own"), F.max("share").alias("most"))
    kept = best.select("gram", F.expr(f"transform(filter(own, x -> x.share >= {MIN_RATIO} * most), x -> x.lang)").alias("langs"))
    rows = kept.toPandas()
    names = sorted({x for langs in rows["langs"] for x in langs})
    at = {x: k for k, x in enumerate(names)}
    return LanguageFilters(names, [(g, at[x]) for g, langs in zip(rows["gram"], rows["langs"], strict=True) for x in langs])


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in keep), lang_pred and score.

    score is the share of the text's n-grams that the predicted language
    contains.  Ties go to the first language by name.  A null text, one
    without a letter, or any text when nothing was learned: `und`, score 0.
    Rows are kept as they are, repeated or not; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    source = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(text).alias("__text"))
    kinds = {f.name: f.dataType for f in source.schema}
    schema = ", ".join(f"c{k} {kinds[f'c{k}'].simpleString()}" for k in range(len(keep))) + ", lang_pred string, score double"

    def run(batches):
        model = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            names, scores = [], []
            for a, b, data, offsets in tk.chunks(_lower(texts)):
                if not model.names:
                    names += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                share = model.score(data, offsets)
                best = share.argmax(axis=1)
                known = lettered[a:b]
                names += [model.names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
                scores += np.where(known, share[np.arange(b - a), best], 0.0).tolist()
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score")


def drop_unidentified(docs: DataFrame, model: LanguageFilters, least: float, text: str = "text") -> DataFrame:
    """docs without the rows of no known language, or with a score below ``least``.

    Null and letterless texts go.  All columns are returned, whatever their names.
    """
    names = docs.schema.names
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    out = predict(rows, model, f"c{names.index(text)}").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
