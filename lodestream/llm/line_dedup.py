"""Line dedup: exact copies by hash, near copies by a segment-partition edit join.

Lines are near copies when they are at most one word edit for each
``WORDS_AN_EDIT`` words of the shorter one apart (one in any line of
``LEAST_WORDS``), or ``DISTANCE`` byte edits.  A line that may have k edits
holds k + 1 segments, and another one that is so near has one of them
unchanged, within the few places that the edits before it allow; of the word
segments one half is counted from the start and one from the end.  Up to 2 * DISTANCE word edits the
bytes are cut, too; beyond, the word edits allow for the byte edits.  An index
holds each line's segments by place and hash, and all lines probe it.  Lines
that meet are candidates, and a banded bit-parallel edit distance decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .clusters import bucket_key, families, resolve
from .shared import materialise, only_ids, prepare, scratch

#: Edits (insert, delete or replace a byte) between near copies of any length; lines below MIN_BYTES have none.
DISTANCE, MIN_BYTES = 2, 24
#: Words of the shorter line for each word edit between near copies, and the words from which one edit is allowed at least.
#: A character of three bytes or more is a word.
WORDS_AN_EDIT, LEAST_WORDS = 16, 8
#: Classes of lines by words: the least, and the words of a segment; each leaves room for one more segment than edits.
CLASSES = ((8, 4), (12, 6), (16, 8), (24, 12), (32, 10), (48, 12), (112, 14), (512, 15))
#: Words from which segments may lie anywhere, since the places that edits allow outnumber the words.
ANYWHERE = 512
FILTER_BITS = 23
#: Lines of a block of a large family: they are short, and only those that share a bucket are compared.
BLOCK = 2048
_U = np.uint64


def _windows(n: np.ndarray, distance: int):
    """(length, segment, start, end) for all probes of lines of n bytes, one probe of each line at a time.

    The first ``distance + 1`` are the line's own segments, its index entries.
    """
    parts = distance + 1

    def segment(length, i):
        return i * length // parts, (i + 1) * length // parts

    for i in range(parts):
        yield n, i, *segment(n, i), np.ones(len(n), bool)
    for shorter in range(distance + 1):
        length = n - shorter
        for i in range(parts):
            start, end = segment(length, i)
            for move in range(max(-i, shorter - (distance - i)), min(i, shorter + distance - i) + 1):
                if shorter or move:
                    at = start + move
                    yield length, i, at, at + end - start, (at >= 0) & (at + end - start <= n)


def line_words(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' words, from the prefix sums of data, and each line's first word; lines in order, ending at line feeds or before the next start.

    Words are runs of bytes other than white space, and in them each character
    of three bytes or more is a word of its own.
    """
    n = len(data)
    lead = (data & 0xC0) != 0x80
    wide = data >= 0xE0
    if wide.any():
        for _ in range(3):  # the bytes behind a first one
            wide[1:] |= wide[:-1] & ~lead[1:]
    word = tk.NOT_SPACE[data]
    begins = word & lead
    begins[1:] &= ~word[:-1] | wide[1:] | wide[:-1]
    inner = starts[starts < n]
    begins[inner] = word[inner]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | begins[1:]
    last = ends[ends > starts] - 1
    stops[last] = word[last]
    at = np.flatnonzero(begins)
    return tk.substring_hash(sums, at, np.flatnonzero(stops) + 1), np.append(np.searchsorted(at, starts), len(at))


def word_edits(n: np.ndarray) -> np.ndarray:
    """Word edits between near copies, of which the shorter one has n words."""
    return np.where(n < LEAST_WORDS, 0, np.maximum(1, n // WORDS_AN_EDIT))


def _word_windows(n: np.ndarray, probe: bool):
    """(lines, salt, start, end in words) of the index entries, or the probes, of lines of n words.

    An entry belongs to the class of its line; a line probes its own class and
    those that a shorter near copy may be in.  Where a line's probe would be
    its own entry, it is left out.
    """
    for c, (least, size) in enumerate(CLASSES):
        most = CLASSES[c + 1][0] - 1 if c + 1 < len(CLASSES) else None
        above = most + int(word_edits(np.array(most))) if probe and most else most
        own = np.flatnonzero((n >= least) & ((n <= above) if most else True))
        if not len(own):
            continue
        edits = word_edits(np.minimum(n[own], most) if most else n[own])
        if least >= ANYWHERE:
            times = n[own] - size + 1 if probe else edits + 1
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start = place if probe else place * size
            yield np.repeat(own, times), c << 20, start, start + size
            continue
        for side, parts in ((0, (edits + 2) // 2), (1, (edits + 1) // 2)):
            # a line's i-th segment has 2 * i + 1 places, so its places come from i * i on
            times = parts * parts if probe else parts
            who = np.repeat(own, times)
            place = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            i = np.sqrt(place).astype(np.int64) if probe else place
            at = (n[who] - (i + 1) * size if side else i * size) + (place - i * i - i if probe else 0)
            ok = (at >= 0) & (at + size <= n[who])
            if probe:
                ok &= (place != i * i + i) | ((n[who] > most) if most else False)
            yield who[ok], (c << 20 | side << 19) + i[ok] + 1, at[ok], at[ok] + size


def _word_keys(words: np.ndarray, first: np.ndarray, n: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the word segments of lines that have n words from the first on."""
    sums = tk.sequence_sums(words)
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for who, salt, start, end in _word_windows(n, probe):
        part = tk.substring_hash(sums, first[who] + start, first[who] + end)
        lines.append(who)
        keys.append(tk.mix(part + (np.asarray(salt) + np.full(len(who), 1 << 32)).astype(np.uint64) * _U(0x9FB21C651E98DF25)))
    return np.concatenate(lines), np.concatenate(keys)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines, and each text's first line; an empty text is one empty line."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    first = np.searchsorted(feeds, offsets[:-1]) + np.arange(len(offsets) - 1)
    return starts, ends, np.append(first, len(starts))


def _lines(short: bool):
    """(id, doc, line, h, g) of the lines that count: all non-blank ones with ``short``; a line is known by 128 bits."""
    schema = pa.schema([("id", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(2)):
                starts, ends, first = line_spans(data, offsets)
                own = tk.rows_of(first)
                if short:
                    # a line is blank if no run that isn't space begins in it
                    word = np.append(tk.NOT_SPACE[data], False)
                    begins = word[:-1].copy()
                    begins[1:] &= ~word[:-2]
                    begins[starts[starts < len(data)]] = word[starts[starts < len(data)]]
                    at = np.flatnonzero(begins)
                    keep = np.flatnonzero(np.searchsorted(at, ends) > np.searchsorted(at, starts))
                else:
                    keep = np.flatnonzero(ends - starts >= MIN_BYTES)
                h, g = (tk.substring_hash(tk.prefix_sums(data, half), starts[keep], ends[keep], half).view(np.int64) for half in (0, 1))
                doc = pa.array(own[keep] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(doc), batch.column(1).take(doc), pa.array((keep - first[own[keep]]).astype(np.int32)), pa.array(h), pa.array(g)], schema=schema
                )

    return run


def _few_words(distance: int) -> int:
    """Lines of so many words have near copies by bytes only where word edits allow for them: a byte edit is two word edits at most."""
    return 2 * distance * (WORDS_AN_EDIT + 1)


def _made(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray, n_words: np.ndarray, distance: int):
    """(key, line) of all index entries, side 0 of their bucket, and probes, side 1, of some lines."""
    keys, lines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def put(key, side, line):
        keys.append(bucket_key(key, side))
        lines.append(line)

    for side in (0, 1):
        line, key = _word_keys(words, first, n_words, side == 1)
        put(key, side, line)
    few = np.flatnonzero(n_words < _few_words(distance))
    at_, n = starts[few], (ends - starts)[few]
    for k, (length, i, at, end, ok) in enumerate(_windows(n, distance)):
        part = tk.substring_hash(sums, (at_ + at)[ok], (at_ + end)[ok])
        put(tk.mix(part + (length[ok] * (distance + 1) + i).astype(np.uint64) * _U(0x9FB21C651E98DF25)), int(k > distance), few[ok])
    return np.concatenate(keys), np.concatenate(lines)


def _keys(distance: int):
    """(key, id) of all lines' buckets; id is the line's hash."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column(0)):
                starts, ends, _ = line_spans(data, offsets)
                sums = tk.prefix_sums(data)
                words, first = line_words(data, sums, starts, ends)
                n_words = np.diff(first)
                h = tk.substring_hash(sums, starts, ends)
                long = np.flatnonzero(ends - starts >= MIN_BYTES)
                h, once = np.unique(h[long], return_index=True)
                once = long[once]
                key, line = _made(sums, starts[once], ends[once], words, first[once], n_words[once], distance)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h[line].view(np.int64))], names=["key", "id"])

    return run


def edit_distance_within(a: bytes | np.ndarray, b: bytes | np.ndarray, most: int) -> bool:
    """Whether a and b, bytes or arrays of words, are at most ``most`` edits apart: bit-parallel over a band of 2 * most + 1 diagonals.

    Bit i of a vector stands for the row that lies i - most below the column's
    diagonal; rows above the table count on from 0 upwards.
    """
    if len(a) < len(b):
        a, b = b, a
    apart = len(a) - len(b)
    if apart > most:
        return False
    x, y = (np.frombuffer(v, np.uint8) if isinstance(v, bytes) else v for v in (a, b))
    n = len(b)
    differ = np.flatnonzero(x[:n] != y)
    if not len(differ):
        return True
    head = int(differ[0])
    differ = np.flatnonzero(x[apart:] != y)
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    tail = min(tail, n - head)
    a, b = x[head : len(a) - tail].tolist(), y[head : n - tail].tolist()
    if not b:
        return len(a) <= most
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    plus = full & ~((1 << (most + 1)) - 1)  # rows that are one more than the row above
    minus = full & ~plus
    watch, score = 1 << (most + apart), apart
    # each value's rows within the band, and the column that they were last counted from
    where: dict[int, tuple[int, int]] = {}
    none = 0, 0
    for i, c in enumerate(a[:most]):
        where[c] = where.get(c, none)[0] | 1 << (i + most), 0
    for j, c in enumerate(b):
        plus, minus = plus >> 1 | top, minus >> 1
        if j + most < len(a):
            new = a[j + most]
            rows, since = where.get(new, none)
            where[new] = rows >> (j - since) | top, j
        rows, since = where.get(c, none)
        same = rows >> (j - since)
        hit = same | minus
        diagonal = (((plus + (hit & plus)) ^ plus) | hit) & full
        right_plus = (minus | ~(diagonal | plus)) & full
        right_minus = diagonal & plus
        right_plus, right_minus = (right_plus << 1 | 1) & full, right_minus << 1 & full
        plus = (right_minus | ~(diagonal | right_plus)) & full
        minus = diagonal & right_plus
        if not diagonal & watch:
            score += 1
            if score > most:
                return False
    return True


def _of_texts(texts: list[bytes], distance: int, keyed: bool = True) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each line's words, and (key, line) of all lines' buckets if they are ``keyed``."""
    own, keys, lines = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    chunk = np.cumsum([len(t) for t in texts]) // tk.CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        size = np.array([len(t) for t in texts[low:high]], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(texts[low:high]), np.uint8)
        sums = tk.prefix_sums(data)
        words, first = line_words(data, sums, ends - size, ends)
        own += [words[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        if keyed:
            key, line = _made(sums, ends - size, ends, words, first[:-1], np.diff(first), distance)
            keys.append(key)
            lines.append(line + low)
    return own, np.concatenate(keys), np.concatenate(lines)


def edit_linker(distance: int, whole: bool = False):
    """Links near copies, by words or at most ``distance`` bytes apart; the same segment indexes find them inside a task, or a group is one bucket (``whole``)."""

    def link(texts, group, forest, side):
        own, key, line = _of_texts(texts, distance, not whole)
        n_words = np.array([len(w) for w in own], np.int64)
        bags = [set(w.tolist()) for w in own]
        edits = [word_edits(n_words).tolist(), n_words.tolist(), [len(b) for b in bags]]
        few = _few_words(distance)

        def near(i, j):
            most = min(edits[0][i], edits[0][j])
            # an edit changes one word, a byte edit two at most: all other words are in both lines
            if abs(edits[1][i] - edits[1][j]) > max(most, 2 * distance) or min(edits[2][i], edits[2][j]) - len(bags[i] & bags[j]) > max(most, 2 * distance):
                return False
            if most and edit_distance_within(own[i], own[j], most):
                return True
            return min(edits[1][i], edits[1][j]) < few and edit_distance_within(texts[i], texts[j], distance)

        if whole:
            for a, b in zip(group[:-1].tolist(), group[1:].tolist()):
                for i in range(a, b):
                    if side is None or side[i]:
                        for j in range(a, b):
                            # of two that meet everyone, one looks at the other
                            if (j > i or side is not None and not side[j]) and forest.root(i) != forest.root(j) and near(i, j):
                                forest.join(i, j)
            return

        # buckets of one group only
        number = np.repeat(np.arange(len(group) - 1), np.diff(group))[line]
        order = np.lexsort((key, number))
        key, line, number = key[order], line[order], number[order]
        new = np.append(True, (key[1:] >> 1 != key[:-1] >> 1) | (number[1:] != number[:-1])) if len(key) else np.zeros(0, bool)
        bounds = np.append(np.flatnonzero(new), len(key))
        wide = np.flatnonzero((np.diff(bounds) > 1) & (key[bounds[:-1]] & 1 == 0)) if len(key) else []
        done: set[tuple[int, int]] = set()
        for a, b in zip(bounds[:-1][wide].tolist(), bounds[1:][wide].tolist()):
            every = list(dict.fromkeys(line[a:b].tolist()))
            if len({forest.root(i) for i in every}) < 2:
                continue
            for i in dict.fromkeys(line[a:b][key[a:b] & 1 == 0].tolist()):
                for j in every:
                    if (side is None or side[i] or side[j]) and forest.root(i) != forest.root(j):
                        pair = (i, j) if i < j else (j, i)
                        if pair not in done:
                            done.add(pair)
                            if near(i, j):
                                forest.join(i, j)

    return link


def _texts_of(docs: DataFrame, member: DataFrame) -> DataFrame:
    """(id, payload): the bytes of the lines in member, found again by a bitmap of a fixed size and a join."""
    slot = F.col("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = member.select(F.shiftright(slot, 5).alias("w"), F.expr("shiftleft(1L, cast(id & 31 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("id", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        bits = held.value
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch.column(0)):
                starts, ends, _ = line_spans(data, offsets)
                keep = ends - starts >= MIN_BYTES
                starts, ends = starts[keep], ends[keep]
                h, once = np.unique(tk.substring_hash(tk.prefix_sums(data), starts, ends), return_index=True)
                low = h & _U((1 << FILTER_BITS) - 1)
                wanted = (bits[(low >> _U(5)).astype(np.int64)] >> (h & _U(31)).astype(np.int64)) & 1 == 1
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[wanted].view(np.int64)), pa.array([raw[a:b] for a, b in zip(starts[once[wanted]].tolist(), ends[once[wanted]].tolist())], pa.binary())], schema=schema
                )

    found = docs.select("text").mapInArrow(run, "id long, payload binary")
    return found.join(member.select("id"), "id", "left_semi").groupBy("id").agg(F.first("payload").alias("payload"))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, doc, text): doc tells rows apart by id and text."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("doc"), F.col(text).alias("text"))


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, short: bool = False) -> DataFrame:
    """(id, doc, lines): the numbers of the lines of each document that repeat an earlier line, ascending; a written table.

    Lines are split at line feeds and counted from 0; those of at least
    MIN_BYTES bytes count, with ``short`` all that aren't blank, though below
    MIN_BYTES by exact copies only.  Lines at most one word edit for each WORDS_AN_EDIT
    words of the shorter one (one from LEAST_WORDS words), or ``distance`` byte edits, apart are linked, a
    class is what links reach, and its first occurrence is the smallest
    (doc_id, line), null ids last.  Rows with the same id and other texts are
    documents of their own; rows that repeat both are one, so they lose the same lines.
    """
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        docs = _named(docs, doc_id, text).filter("text is not null")
        lines = materialise(docs.mapInArrow(_lines(short), "id long, doc long, line int, h long, g long"))
        place = F.struct(F.col("id").isNull().alias("missing"), "id", "doc", "line")
        firsts = materialise(lines.groupBy("h", "g").agg(F.min(place).alias("at"), F.count("*").alias("n")))
        bare = docs.select("text")
        member = materialise(families(bare, _keys(distance)))
        texts = materialise(_texts_of(bare, member))
        found = materialise(resolve(member, texts, edit_linker(distance), BLOCK, lambda texts: _of_texts(texts, distance)[1:], edit_linker(distance, True)))
        near = materialise(firsts.join(found, firsts.h == found.id).select("h", "g", "at", F.col("component").alias("class")))
        least = materialise(near.groupBy("class").agg(F.min("at").alias("first")))
        moved = near.join(least, "class").filter("first <> at").select(F.col("h").alias("nh"), F.col("g").alias("ng"), "first")
        # only lines that come more than once, or have a near copy before them, can go
        again = firsts.join(materialise(moved), (F.col("h") == F.col("nh")) & (F.col("g") == F.col("ng")), "left").filter("n > 1 or first is not null")
        again = materialise(again.select(F.col("h").alias("ch"), F.col("g").alias("cg"), F.coalesce("first", "at").alias("first")))
        rest = only_ids(lines, again.select(F.col("ch").alias("id")), "h").join(again, (F.col("h") == F.col("ch")) & (F.col("g") == F.col("cg")))
        rest = rest.filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("doc") == F.col("first.doc")) & (F.col("line") == F.col("first.line"))))
        return materialise(rest.groupBy("id", "doc").agg(F.sort_array(F.collect_set("line")).alias("lines")), keep=True)


def _with_removed(docs: DataFrame, doc_id: str, text: str, gone: DataFrame) -> DataFrame:
    """Columns c0, c1, ... of docs and the numbers of the removed lines, null where there are none."""
    names = docs.schema.names
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at, of = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    gone = gone.select(F.col("id").alias("__id"), F.col("doc").alias("__doc"), F.col("lines").alias("__lines"))
    return rows.join(gone, F.col(at).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(at, of) == F.col("__doc")), "left")


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, short: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for each row of docs.

    removed has the numbers, from 0, of the lines that are exact or near copies
    of an earlier one in the order of (doc_id, line).  Null text: no lines;
    empty text: one line, kept.  Rows that share a doc_id are documents of
    their own unless the texts are the same, too; null doc_ids come last.
    Lines below MIN_BYTES are looked at with ``short`` only, blank ones never.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    docs = docs.select(doc_id, text)
    out = _with_removed(docs, doc_id, text, removed_lines(docs, doc_id, text, distance, short))
    n_lines = F.greatest(F.coalesce(F.size(F.split("c1", "\n", -1)), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    lines = F.coalesce("__lines", F.array().cast("array<int>"))
    return out.select(F.col("c0").cast("long").alias(doc_id), n_lines.alias("n_lines"), F.size(lines).cast("long").alias("n_removed"), lines.alias("removed"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, short: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of the texts; documents of which only white space is left go.

    Documents that lose no line stay as they are, whatever their text.  Nulls,
    repeated rows, clashing names and empty tables: see line_report.
    """
    out = _with_removed(docs, doc_id, text, removed_lines(docs, doc_id, text, distance, short))
    at = f"c{docs.schema.names.index(text)}"
    left = F.filter(F.split(at, "\n", -1), lambda _, i: ~F.array_contains(F.col("__lines"), i))
    fixed = F.when(F.col("__lines").isNull(), F.col(at)).otherwise(F.array_join(left, "\n"))
    out = out.withColumn("__text", fixed).filter(F.col("__lines").isNull() | F.col("__text").rlike(r"\S"))
    return out.select(*[F.col("__text" if c == text else f"c{k}").alias(c) for k, c in enumerate(docs.schema.names)])
