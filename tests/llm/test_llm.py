import os
import random
import re
import shutil
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lodestream.llm import clusters, decontamination, labelled, language_id, line_dedup, lm_scoring, mixing, near_duplicates, quality, queries, shared, toxicity
from lodestream.llm import textkit as tk
from lodestream.llm.clusters import components
from lodestream.llm.embedding_duplicates import embedding_duplicates
from lodestream.llm.lm_scoring import lm_scores
from lodestream.llm.shared import remainder
from lodestream.llm.token_counts import TokenCounter, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
ODD = [(1, None, None, None, None, 0.5), (2, "", "en", "a", 0, 0.5), (3, " \t\n ", "en", "a", 4, 0.5), (None, "the null id text here", "en", "b", 3, 0.5), (4, "same words in this one text", "en", "b", 9, 0.5), (4, "same words in this one text", "en", "b", 9, 0.5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def words(rng, n, v=400):
    return [f"w{rng.randrange(v)}" for _ in range(n)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_near_duplicates_against_brute_force(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = words(rng, rng.randint(1, 150))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(copy))
    texts += [None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = near_duplicates.near_duplicates(docs, width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def test_super_minhash_estimates_the_overlap():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 62, 300, dtype=np.uint64), rng.integers(1, 1 << 62, 100, dtype=np.uint64)
    both = [np.sort(a), np.sort(np.concatenate([a[:200], b]))]
    s = near_duplicates.signatures(np.concatenate(both), np.array([0, 300, 600]))
    assert abs((s[0] == s[1]).mean() - 200 / 400) < 0.15


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [b + 0.08 * rng.standard_normal(16) for b in base for _ in range(4)] + [base[0], base[0]]
    data = [(k, [float(x) for x in v]) for k, v in enumerate(rows)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [])]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embedding_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert [got[k].n_links for k in range(len(rows))] == near.sum(axis=1).tolist()
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(900, 905))


def test_edit_distance_and_lines(spark):
    a = "an ordinary line of text that repeats, number one"
    docs = spark.createDataFrame([(1, f"{a}\nshort\nsome other line that is long enough"), (2, a.replace("one", "onE")), (3, a + " and more besides"), (4, None), (5, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.line_report(docs).collect()}
    assert got == {1: (3, []), 2: (1, [0]), 3: (1, []), 4: (0, []), 5: (1, [])}
    assert sorted(r.doc_id for r in line_dedup.drop_lines(docs).collect()) == [1, 3, 4, 5]
    assert line_dedup.edit_distance_within(b"kitten", b"sitting", 3) and not line_dedup.edit_distance_within(b"kitten", b"sitting", 2)


def test_exact_copies_of_short_lines(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\n\n \none"), (2, "one\n\n \nAll rights reserved,"), (3, "\u5168\nOne"), (4, "\u5168\n}")], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.line_report(docs, short=True).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0]}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(docs, short=True).collect()}[4] == "}"


def test_words_and_blank_lines_against_a_plain_split(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "\t", "\u00e9", "\u5168", "\U0001f600", "zz z"], k=rng.randint(0, 60))) for _ in range(300)]
    data, offsets = tk.string_buffers(pa.array(texts))
    whole = tk.prefix_sums(data)
    monkeypatch.setattr(tk, "_SUMMED", 100)
    assert (tk.prefix_sums(data) == whole).all()
    starts, ends, _ = line_dedup.line_spans(data, offsets)
    got = np.diff(line_dedup.line_words(data, whole, starts, ends)[1])
    lines = [x for t in texts for x in t.split("\n")]
    assert got.tolist() == [len(re.findall(r"[\u0800-\U0010ffff]|[^\s\u0800-\U0010ffff]+", x)) for x in lines]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(range(300)), pa.array(texts)], names=["id", "doc", "text"])
    assert sum(b.num_rows for b in line_dedup._lines(True)([batch])) == sum(bool(x.strip()) for x in lines)


def test_lines_with_edited_words_against_brute_force(spark):
    def split(line):
        out = []
        for w in line.split():
            run = ""
            for c in w:
                if len(c.encode()) > 2:
                    out += [run, c] if run else [c]
                    run = ""
                else:
                    run += c
            out += [run] if run else []
        return out

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng, lines = random.Random(11), []
    for n in [*range(6, 70, 3), 90, 111, 120, 511, 520]:
        line = words(rng, n, 30000)
        lines.append(" ".join(line))
        for times in (1, 1, 2, 2, n // 16, n // 16 + 1):
            copy = list(line)
            for _ in range(times):
                at, kind = rng.randrange(len(copy)), rng.randrange(3)
                copy[at : at + (kind > 0)] = ["another"] * (kind < 2)
            lines.append(" ".join(copy))
    cjk = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(24))
    lines = sorted({*lines, cjk, cjk[:9] + "\u4e00" + cjk[10:], cjk[:20]}, key=lambda x: (len(x), x))
    lines = [x for x in lines if len(x.encode()) >= line_dedup.MIN_BYTES]
    tokens, up = [split(x) for x in lines], list(range(len(lines)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(lines)):
        for j in range(i):
            least = min(len(tokens[i]), len(tokens[j]))
            most = max(1, least // 16) if least >= 8 else -1
            if len({*tokens[i]} & {*tokens[j]}) > 3 and apart(tokens[i], tokens[j]) <= most or line_dedup.edit_distance_within(lines[i].encode(), lines[j].encode(), 2):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {i for i in range(len(lines)) if root(i) != i}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in line_dedup.line_report(docs).collect() if r.removed} == want and len(want) > len(lines) // 2


def test_a_family_that_hangs_together_by_chance_costs_its_buckets(spark, monkeypatch):
    """Each line begins as one ends or begins and isn't near it; the tasks' rows don't grow with the family's square."""
    rng = random.Random(5)
    half = [words(rng, 4, 30000) for _ in range(121)]
    ends = [words(rng, 8, 30000) for _ in range(120)]
    lines = [" ".join([*half[i], *ends[i][:4]]) for i in range(120)] + [" ".join([*half[i + 1], *ends[i][:4]]) for i in range(120)]
    near = [" ".join([*x.split()[:5], "replaced", *x.split()[6:]]) for x in lines[::12]]
    lines += near
    seen, linked = [], clusters._linked

    def counted(tasks, *rest):
        seen.append(tasks.count())
        return linked(tasks, *rest)

    monkeypatch.setattr(clusters, "_linked", counted)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in line_dedup.line_report(docs).collect() if r.removed}
    assert got == set(range(240, 240 + len(near)))
    assert max(seen) < 4 * len(lines)
    # one bucket of more than a block
    seen.clear()
    docs = spark.createDataFrame([(i, " ".join([*half[0], *ends[i][:4]])) for i in range(40)] + [(40 + i, " ".join([*half[0], *ends[i][:3], "replaced"])) for i in range(40)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.line_report(docs).collect() if r.removed} == set(range(40, 80)) and len(seen) == 3


def test_line_dedup_leaves_one_table_and_materialise_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = set(re.findall(r"shuffle_\d+", blocks.getAllBlocks().mkString(" ")))
    shared.materialise(spark.range(1000).repartition(3, "id").groupBy("id").count(), keep=True)
    assert set(re.findall(r"shuffle_\d+", blocks.getAllBlocks().mkString(" "))) <= before
    shutil.rmtree(tmp_path / "lodestream")
    docs = spark.createDataFrame([(i, f"a line that is long enough, the {i % 7}th\nanother one that repeats") for i in range(40)], "doc_id long, text string")
    gone = line_dedup.removed_lines(docs)
    assert sum(len(r.lines) for r in gone.collect()) == 78
    assert len(os.listdir(tmp_path / "lodestream")) == 1


def test_buckets_travel_in_14_bytes_a_row_and_tie_as_rows_do(spark, monkeypatch):
    rng = np.random.default_rng(5)
    key = clusters.bucket_key(clusters.mix(rng.integers(0, 20_000, 60_000).astype(np.uint64)), rng.integers(0, 2, 60_000))
    id_ = rng.integers(0, 30_000, 60_000)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(id_)], names=["key", "id"])
    packed = list(clusters._packed([batch]))
    held = sum(c.get_total_buffer_size() for b in packed for c in b.columns)
    assert held - 4 * 4 * 4097 <= 14 * 60_000  # but for the ranges' numbers and offsets
    monkeypatch.setattr(clusters, "_TIED", 1000)
    want, first = set(), {}
    for b, s, i in sorted(zip((key >> 1).tolist(), (key & 1).tolist(), id_.tolist())):
        first.setdefault(b, (s, i))
        if first[b][0] == 0 and first[b][1] != i:
            want.add((i, first[b][1]))
    got = [e for b in clusters._tie_rows(list(clusters._packed([batch]))[0].slice(a, 500) for a in range(0, packed[0].num_rows, 500)) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    a, b = (np.array(x) for x in zip(*got))
    c, d = (np.array(x) for x in zip(*want))
    assert dict(zip(*(x.tolist() for x in clusters.to_roots(a, b)))) == dict(zip(*(x.tolist() for x in clusters.to_roots(c, d))))


def test_no_stage_of_the_pipeline_takes_two_python_workers_a_task(spark, monkeypatch):
    found = []

    def stacked(node):
        """The most Python functions in the stage of a plan's node, from the node on."""
        if node.nodeName() == "AdaptiveSparkPlan":
            return stacked(node.initialPlan())
        below = max([stacked(node.children().apply(i)) for i in range(node.children().size())], default=0)
        return 0 if "Exchange" in node.nodeName() else below + bool(re.search("InArrow|InPandas", node.nodeName()))

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        found.append(stacked(node))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (walk(self._df._jdf.queryExecution().executedPlan()), write(self, *a, **b))[1])
    rng = random.Random(21)
    docs = [(k, "\n".join(" ".join(words(rng, 12)) for _ in range(6))) for k in range(20)]
    docs = spark.createDataFrame(docs + [(100 + k, f"{text} more") for k, text in docs], "doc_id long, text string")
    assert line_dedup.drop_lines(docs, short=True).count() and near_duplicates.drop_near_duplicates(docs).count() == 20
    assert max(found) == 1


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(5)
    items = [" ".join(words(rng, rng.randint(12, 40), 5000)) for _ in range(10)]
    docs = []
    for k, item in enumerate(items):
        w = item.split()
        for _ in range(len(w) // 10):
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, " ".join(words(rng, 50, 5000) + w + words(rng, 30, 5000)).upper()))
    docs += [(50, " ".join(words(rng, 300, 5000))), (51, None), (None, items[0])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(10)}
    assert decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).count() == 0


def test_decontamination_of_cut_long_and_short_items(spark, monkeypatch):
    rng = random.Random(8)
    items = [words(rng, n, 9000) for n in [9, 25, 40, 59, 130] * 3 + [400]]
    docs, want = [], set()
    for k, item in enumerate(items):
        n, most = len(item), int(len(item) * decontamination.MAX_EDITS)
        head, gone = words(rng, 70, 9000), set(rng.sample(range(n), most))
        less = [w for i, w in enumerate(item) if i not in gone]
        for j, text in enumerate((less, head + less, item[most:], item[: n - most], head + item[: n - most], item[most:] + head)):
            docs.append((10 * k + j, " ".join(text)))
            want.add((10 * k + j, k))
        docs.append((10 * k + 9, " ".join(item[: n - most - 1])))  # one more than the edits allow
    short = [["ab", "cd", "ab", "cd", "ef"], ["yes", "sir"], ["...", "!"]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items + short)], "item_id long, text string")
    at = len(items)
    docs += [(5000, "it is ab cd ab cd ef, said he"), (5001, "it is ab cd ab cd, ef? xy"), (5002, "it is ab cd ab xy cd ef"), (5003, "Yes, sir!"), (5004, "yes sir no"), (5005, "! ...")]
    want |= {(5000, at), (5001, at), (5003, at + 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(frame, bench).collect()}
    assert not set(got) - want and len(set(got) & want) >= 0.98 * len(want)
    assert {x for x in got if x[0] >= 5000} == {x for x in want if x[0] >= 5000}
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 4000)
    assert {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(frame, bench).collect()} == got
    assert {r.doc_id for r in decontamination.drop_leaks(frame, bench).collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_token_counts_against_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["", "don't we'll 's !'s ''s", "a  b\n\n c \t", "日本語 ½² １２", "x<|endoftext|>y", "ab" * 3000, "q" * 700, " ", "'", "end  ", *(f"x'll{chr(c)} 1{chr(c)}a" for c in (0x1C89, 0xA7CB, 0x105C0, 0x13460, 0x10D40, 0x1CCF0, 0x1E5F1))]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    with open(path, "rb") as file:
        assert TokenCounter(file.read()).count(pa.array(texts)).tolist() == want
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()} == {**dict(enumerate(want)), 99: 0}


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(3000)], "doc_id long, text string, source string")
    first, again = mixing.mix(docs).toPandas(), mixing.mix(docs.repartition(7)).toPandas()
    assert first.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())
    assert len(first) == 3000 and (first.taken <= 3 * first["size"]).all()
    assert abs(first.groupby("source", dropna=False).target.max().sum() - first["size"].sum()) < 1e-6
    for _, own in first.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 3


def test_lm_base_and_probabilities(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(words(rng, 40, 30))) for k in range(60)] + [(100, None), (101, "A b  a")], "doc_id long, text string")
    rows = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    train = [i for i in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r for r in lm_scores(docs, remainder("doc_id", 7) != 2).collect()}
    tokens = [w for i in train for w in [*rows[i], None]]
    for i, own in rows.items():
        want = sum(np.log10((tokens.count(w) + 1) / (len(tokens) + len(set(tokens)) + 1)) for w in [*own, None])
        assert abs(got[i].base_score - want) < 1e-6 and got[i].n_tokens == len(own) + 1 and got[i].score <= 0


def test_lm_counts_are_the_same_however_dealt(spark):
    counts = np.random.default_rng(4).integers(0, 1 << 20, 8192).astype(np.uint32)
    assert (lm_scoring._unsqueeze(lm_scoring._squeeze(counts), np.uint32, 8192) == counts).all()
    rng = random.Random(12)
    docs = spark.createDataFrame([(" ".join(words(rng, 20, 50)), k < 8) for k in range(40)], "text string, apart boolean")
    vocabulary = np.unique(tk.word_hashes(*tk.string_buffers(pa.array([f"w{k}" for k in range(0, 50, 2)])))[0])
    first = np.arange(len(vocabulary) + 2) + 1
    model = lm_scoring.Model(vocabulary, lm_scoring._kinds(first), lm_scoring.Code(first), lm_scoring.Code(np.ones(256)), None, 14, [], None)

    def values(rows):
        return [np.concatenate([*tables, runs.view(np.int32)]) for tables, runs in lm_scoring.collect_tables(lm_scoring.count_contexts(rows, model), 14)]

    every, rest = values(docs.repartition(5))
    again, same = values(docs.coalesce(1).withColumn("apart", F.lit(False)))
    _, without = values(docs.filter("not apart"))
    assert (every == again).all() and (again == same).all() and (rest == without).all() and (every != rest).any()


@pytest.mark.parametrize("often", [4, 6])
def test_lm_followers_are_sent_in_parts_and_counted_whole(spark, monkeypatch, often):
    vocabulary = np.unique(tk.word_hashes(*tk.string_buffers(pa.array([f"w{k}" for k in range(0, 20, 2)])))[0])
    first = np.arange(len(vocabulary) + 2) + 1
    model = lm_scoring.Model(vocabulary, lm_scoring._kinds(first), lm_scoring.Code(first), lm_scoring.Code(np.ones(256)), None, 14, [], None)
    # w2 is followed more than 2^16 times by either word, a little more by one
    docs = spark.createDataFrame([(f"w2 w{k} " * (6700 if k == often else 6600), False) for k in (4, 6) for _ in range(10)], "text string, apart boolean")

    def followers(rows):
        return lm_scoring.collect_tables(lm_scoring.count_contexts(rows, model), 14)[0][1]

    whole = followers(docs.coalesce(1))
    assert (whole == followers(docs.repartition(20))).all()
    monkeypatch.setattr(lm_scoring, "_FOLLOWERS", 30_000)
    assert (whole == followers(docs.coalesce(1))).all()


def test_lm_codes_and_probabilities(spark):
    counts = np.random.default_rng(5).integers(1, 1000, 300)
    code = lm_scoring.Code(counts)
    assert abs((0.5 ** code.length).sum() - 1) < 1e-12
    at, place, node, bit = lm_scoring._paths(code, np.arange(300))
    again = np.zeros(300, np.int64)
    np.add.at(again, at, bit.astype(np.int64) << (code.length[at] - 1 - place))
    assert (again == code.code).all() and (np.bincount(at) == code.length).all()
    spent = np.bincount(at, np.log2(1 + np.exp(-code.node_values(counts)[at, place] / 2048)))
    assert np.abs(spent + np.log2(counts / counts.sum())).max() < 0.05
    # all texts of "w0 w1 " and one word more: their probabilities add up to less than the start's
    rng = random.Random(13)
    docs = [(k, " ".join(words(rng, 30, 40))) for k in range(80)] + [(1000 + k, f"w0 w1 w{k}") for k in range(40)] + [(2000, "w0 w1")]
    rows = lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 80).collect()
    assert sum(10**r.score for r in rows if r.doc_id >= 1000) < 1
    assert all(r.score < 0 for r in rows)


def test_lm_the_driver_holds_one_model_at_a_time(spark):
    rng = random.Random(22)
    docs = spark.createDataFrame([(k, " ".join(words(rng, 200, 60))) for k in range(40)], "doc_id long, text string")
    one = sum(2 << bits for bits in lm_scoring._TABLES) + (4 << lm_scoring.RUN_BITS[0])
    tracemalloc.start()
    try:
        assert lm_scores(docs, F.col("doc_id") > 3).count() == 40
        assert tracemalloc.get_traced_memory()[1] < 1.5 * one
    finally:
        tracemalloc.stop()


def test_lm_equal_pairs_are_counted_once_for_all():
    rng = np.random.default_rng(5)
    code = lm_scoring.Code(rng.integers(1, 1000, 300))
    symbol, after = rng.integers(0, 300, 40_000), rng.integers(0, 9, 40_000).astype(np.uint32) << np.uint32(28)
    one, other = (np.zeros(2 << lm_scoring.AFTER_BITS, np.uint32) for _ in range(2))
    lm_scoring._count_bits(code, symbol, [after], [one], (lm_scoring.AFTER_BITS,))
    pairs = after.astype(np.uint64) << np.uint64(18) | symbol.astype(np.uint64)
    lm_scoring._count_pairs(code, [pairs[:7], pairs[7:]], other)
    assert one.sum() == code.length[symbol].sum() and (one == other).all()


def test_lm_costs_of_unlikely_bits_stay_finite():
    least = np.float32(1) + np.exp(-lm_scoring._LEAST)
    product = np.ones(1, np.float32)
    for _ in range(lm_scoring._LOGS):
        product *= least
    assert np.isfinite(product).all() and abs(np.log2(product)[0] / (lm_scoring._LOGS * np.log2(float(least))) - 1) < 1e-6


def test_lm_a_text_costs_the_same_whatever_it_is_scored_with(spark):
    rng = random.Random(14)
    docs = spark.createDataFrame([(k, " ".join(words(rng, 2500 if k % 3 else 1000 + 7 * k, 60 + 20 * k))) for k in range(30)], "doc_id long, text string")
    together, alone = ({r.doc_id: r.score for r in lm_scores(d, F.col("doc_id") > 0).collect()} for d in (docs.coalesce(1), docs.repartition(30)))
    assert all(abs(together[k] / alone[k] - 1) < 1e-6 for k in range(30))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_lm_is_better_than_its_base(spark, sf):
    rows = lm_scores(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), remainder("doc_id", 7) != 2).filter("not train")
    row = rows.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert row[0] > row[1] and row[2] > 50_000


def test_classifiers_learn(spark):
    rng = random.Random(9)
    texts = [" ".join(words(rng, 60)) + "." + (" you idiot." if k % 3 == 0 else " fine.") for k in range(400)]
    y = np.array([float(k % 3 == 0) for k in range(400)])
    model = toxicity.fit(texts[:300], y[:300])
    docs = spark.createDataFrame(list(enumerate(texts[300:])), "doc_id long, text string")
    rows = sorted(toxicity.score(docs, model).collect())
    assert np.mean([(r.score >= 0.3) == (y[300 + r.doc_id] > 0) for r in rows]) > 0.95
    bad = next(r for r in rows if y[300 + r.doc_id] > 0)
    assert "idiot" in texts[300 + bad.doc_id][bad.sentences[-1].start : bad.sentences[-1].end]
    junk = ["".join(rng.choice("#$%&") + w for w in words(rng, 60)) if k % 2 else " ".join(words(rng, 60)) for k in range(400)]
    net = quality.fit(junk[:300], np.array([float(k % 2 == 0) for k in range(300)]))
    out = quality.score(spark.createDataFrame(list(enumerate(junk[300:])), "doc_id long, text string"), net).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in out]) > 0.95


def test_toxicity_of_stems_in_new_forms_among_rare_words(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = lambda n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))
    form = lambda: "Lowei" + "".join(rng.choices(letters, k=5))
    y = np.array([float(k % 5 == 0) for k in range(600)])
    texts = [f"{rare(400)}. {rare(5)} {form() if toxic else rare(1)} {rare(5)}. {rare(400)}" for toxic in y]
    model = toxicity.fit(texts[:400], y[:400])
    rows = sorted(toxicity.score(spark.createDataFrame(list(enumerate(texts[400:])), "doc_id long, text string"), model).collect())
    got = np.array([r.score >= 0.3 for r in rows])
    assert got[y[400:] > 0].mean() > 0.95 and (~got[y[400:] == 0]).mean() > 0.95
    spans = [texts[400 + r.doc_id][s.start : s.end] for r in rows if y[400 + r.doc_id] for s in r.sentences]
    assert sum("Lowei" in s for s in spans) >= 0.95 * len(spans) > 0


def test_languages(spark):
    rng = random.Random(10)
    pool = {"aa": ["tion", "ing", "the"], "bb": ["keit", "ung", "der"]}
    rows = [(k, " ".join("".join(rng.choices(pool[x], k=2)) for _ in range(60)), x) for k, x in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter("doc_id < 60"))
    got = language_id.predict(docs.union(spark.createDataFrame([(99, None, None), (98, "12 !", "aa")], docs.schema)), model).collect()
    assert all(r.lang_pred == (r.lang if r.doc_id < 90 else "und") for r in got)


def test_odd_rows_and_empty_tables(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    model, net = toxicity.fit([], np.zeros(0)), quality.fit([], np.zeros(0))
    runs = {
        "near": lambda d: near_duplicates.near_duplicates(d),
        "lines": lambda d: line_dedup.line_report(d),
        "mix": lambda d: mixing.mix(d),
        "tokens": lambda d: token_counts(d, P.path("byte_bpe_50k.json")),
        "lm": lambda d: lm_scores(d, remainder("doc_id", 7) != 2),
        "toxicity": lambda d: toxicity.score(d, model),
        "quality": lambda d: quality.score(d, net),
        "language": lambda d: language_id.predict(d, language_id.fit(d), keep=["doc_id"]),
    }
    for name, run in runs.items():
        assert run(odd).count() == len(ODD), name
        assert run(odd.limit(0)).count() == 0, name
    assert decontamination.leaks(odd, bench).count() == 0


def test_hashes_depend_on_bytes_only():
    data, offsets = tk.string_buffers(pa.array(["a bc", None, "bc  a"]))
    h, _, _, first = tk.word_hashes(data, offsets)
    assert first.tolist() == [0, 2, 2, 4] and h[0] == h[3] and h[1] == h[2]


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= docs.count()
    assert cp.mix_sources(spark, docs, sf).count() > 0


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(21)
    x, y, z = (" ".join(words(rng, 60, 5000)) for _ in range(3))
    near = lambda t: t + " end"
    rows = [(5, x), (5, y), (9, near(x)), (10, near(y)), (7, z), (7, z), (None, z), (None, near(z)), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __id int")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (10, 5, False), (7, 7, True), (7, 7, True), (0, 7, False), (0, 7, False), (8, 8, True), (8, 8, True)])
    left = near_duplicates.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted([(5, x), (5, y), (7, z), (8, ""), (8, "")])


def test_lines_of_rows_that_share_an_id(spark):
    a, b, c = "the first line that both rows have in common", "a second line that only one of the rows has", "and here is a line which nobody else holds"
    docs = spark.createDataFrame([(7, f"{a}\n{b}"), (7, f"{a}\n{c}"), (None, f"{c}\n{a}"), (3, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.drop_lines(docs).collect())
    assert len(got) == 3 and got[0] == (3, a) and sorted(t for _, t in got[1:]) == sorted([b, c])


def test_stages_judge_rows_whatever_their_ids_and_columns(spark):
    rng = random.Random(22)
    item = " ".join(words(rng, 20, 5000))
    docs = spark.createDataFrame([(None, item), (4, item), (4, "some other text of its own")], "doc_id long, text string").selectExpr("*", "1 as score", "'q' as lang_pred", "'en' as lang")
    clean = decontamination.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [tuple(r) for r in clean.collect()] == [(4, "some other text of its own", 1, "q", "en")]
    kept = language_id.drop_unidentified(docs, language_id.fit(docs), 0.0)
    assert kept.columns == docs.columns and kept.count() == 3


def test_labelled_sample_skips_a_text_that_does_not_fit(spark):
    docs = spark.createDataFrame([(k, "x" * (5000 if k % 5 == 0 else 10)) for k in range(50)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1, 0), (99, 1), (None, 1)], "doc_id long, toxic int")
    texts, y = labelled.sample(docs, labels, "toxic", F.col("doc_id") != 3, max_bytes=1000)
    assert len(texts) == len(y) == 38 and {len(t) for t in texts} == {10}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()[want.columns.tolist()]
    key = want.columns[0]
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str))
