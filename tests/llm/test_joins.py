"""N-gram join, suffix-array dedup, sentence spans and decontamination against brute force."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from fixtures_llm import docs, nothing, texts  # noqa: F401

from tablescope.llm import common, decontam, ngram_join, sentence_spans, suffix_dedup
from tablescope.llm.arrays import Words, byte_grams, sliding, text_bytes


def linked(texts, n, percent):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("n, percent, block", [(3, 90, 256), (5, 80, 2)])
def test_jaccard_components(spark, docs, texts, n, percent, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs, n, percent, block).collect()}
    assert got == linked(texts, n, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_as_many_keys_as_each_needs(percent):
    ranges, rng = ngram_join.Ranges(percent), np.random.default_rng(percent)
    for _ in range(400):
        size = int(rng.integers(1, 400))
        pool = rng.integers(0, 2**63, 3 * size, dtype=np.uint64) * np.uint64(2)
        gone, new = rng.integers(0, max(size // 4, 1) + 1, 2)
        a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[gone:size], pool[size: size + new]]))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < percent * (len(a) + len(b) - both):
            continue
        low = min(ranges.of(len(a)), ranges.of(len(b)))
        (x, need_a), (y, need_b) = ngram_join.range_keys(a, ranges), ngram_join.range_keys(b, ranges)
        shared = np.intersect1d(x, y)
        assert np.count_nonzero((shared & 1) == (low & 1)) >= max(need_a[low & 1], need_b[low & 1]) >= 1


def test_jaccard_large_family_in_blocks(spark):
    base = [f"w{i}" for i in range(150)]
    rows = {}
    for k in range(60):
        words = list(base)
        for j in range(k % 12):
            words[(k * 17 + j * 29) % 150] = f"x{k}y{j}"
        rows[k] = " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, 3, 80, block=2).collect()}
    assert got == linked(rows, 3, 80)


def test_jaccard_keys_are_shuffled_in_parts(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(ngram_join, "PART_KEYS", 100, raising=False)
    by_key, keyed = ngram_join._by_key, []

    def counted(rows, shared):
        keyed.append(rows.count())
        return by_key(rows, shared)

    monkeypatch.setattr(ngram_join, "_by_key", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs, 3, 90).collect()}
    assert got == linked(texts, 3, 90)
    *parts, left = keyed  # eight parts of all keys, then the shared ones
    assert len(parts) == 8 and left < sum(parts) and max(parts) < sum(parts) / 4


def test_jaccard_copies_are_shuffled_in_passes(spark, monkeypatch):
    sets = {k: np.unique(np.arange(k % 6, 100 + k % 6, dtype=np.uint64) * np.uint64(2**40 + k // 6 * 977)) for k in range(24)}
    held = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "rep long, set binary")
    sizes = spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "rep long, size long")
    placed = spark.createDataFrame([(b, k, k) for b in range(12) for k in sets if b % 4 == k // 6 or k % 2], "block long, rep long, known long")
    monkeypatch.setattr(ngram_join, "PASS_GRAMS", 1)
    blocks, copies = ngram_join._blocks, []

    def counted(rows, percent):
        copies.append(rows.count())
        return blocks(rows, percent)

    monkeypatch.setattr(ngram_join, "_blocks", counted)
    edges = ngram_join._blocks_in_passes(placed, held, sizes, 80).distinct().collect()
    # a block of all sets of a group links them to the first, one of the odd ones to the second
    assert {(r.a, r.b) for r in edges} == {(k, k // 6 * 6) for k in sets if k % 6} | {(k, k // 6 * 6 + 1) for k in sets if k % 6 in (3, 5)}
    assert len(copies) > 2 and sum(copies) == placed.count() and max(copies) < placed.count() / 2


def test_components_by_rounds_equal_one_task(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (7, 20), (30, 31)], "a long, b long")
    small = sorted(map(tuple, common.components(edges).distinct().collect()))
    monkeypatch.setattr(common, "TASK_EDGES", 0)
    assert sorted(map(tuple, common.components(edges).distinct().collect())) == small
    assert small[:4] == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_empty_tables(spark, nothing):
    assert ngram_join.jaccard_classes(nothing).collect() == []
    assert suffix_dedup.removed_report(nothing).collect() == []
    assert sentence_spans.dedup_sentences(nothing).collect() == []
    items = nothing.selectExpr("doc_id as item_id", "text")
    assert decontam.contamination(nothing, items).collect() == []


def covered(texts, length=50):
    first, out = {}, {}
    for d in sorted(texts):
        b = texts[d].encode()
        mask = bytearray(len(b))
        starts = [b[i:i + length] for i in range(len(b) - length + 1)]
        for i, s in enumerate(starts):
            if first.get(s, d) < d:
                mask[i:i + length] = b"\1" * length
        for s in starts:
            first.setdefault(s, d)
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out[d] = (len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark, docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_report(docs).collect()}
    assert got == covered(texts)


def test_repeats_at_frequent_anchors_by_single_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    monkeypatch.setattr(suffix_dedup, "SORTED", 1)
    rng = np.random.default_rng(5)
    letters = lambda n, k=26: "".join(chr(97 + c) for c in rng.integers(0, k, n))
    passage, other = letters(180), letters(90)
    rows = {}
    for k in range(120):
        a, b = sorted(rng.integers(0, 181, 2))
        rows[k] = letters(int(rng.integers(0, 40)), 3) + passage[a:b] + letters(int(rng.integers(0, 30)), 2) + (other if k % 3 else "") + "ab" * int(rng.integers(0, 50))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_report(df).collect()} == covered(rows)


def test_cut_texts_keep_characters_and_columns(spark, docs, texts):
    unique = docs.dropDuplicates(["doc_id"])
    out = suffix_dedup.without_repeats(unique)
    assert out.columns == unique.columns
    found = {r.doc_id: r.text for r in out.collect()}
    assert found[2] == "" and found[1] == texts[1] and found[11] is None
    assert len(found[10]) < 0.8 * len(texts[10])


def test_intervals_hold_all_occurrences():
    rows = np.frombuffer(b"abcdeXabcdeYabcdeabc", np.uint8).reshape(1, -1)
    found = list(suffix_dedup.suffix_intervals(rows, np.array([20]), np.zeros(1, int), 5))
    groups = {(tuple(sorted(at.tolist())), n) for at, n, _ in found}
    assert ((0, 6, 12), 5) in groups
    assert all(diverse for at, n, diverse in found if sorted(at.tolist()) == [0, 6, 12])


def test_sentence_spans(spark, docs, texts):
    found = {r.doc_id: r for r in sentence_spans.dedup_sentences(docs.dropDuplicates(["doc_id"])).collect()}
    assert found[1].n_removed == 0 and found[2].n_removed == found[2].n_sentences and found[2].kept_text == ""
    assert found[11].n_sentences == 0 and found[9].n_removed == 0 and found[10].n_removed >= 4


def hits(texts, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").encode().lower())
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(str(i))
    out = {}
    for d, t in texts.items():
        w, seen = word.findall(t.encode().lower()), set()
        mask = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    seen |= found
                    mask[k:k + n] = [1] * n
        out[d] = (len(w), sum(mask), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), 0 < sum(mask) and 20 * sum(mask) >= len(w))
    return out


def test_contamination(spark, docs, texts):
    w = texts[18].split(" ")
    items = [(7, " ".join(w[500:540])), (30, " ".join(texts[9].split(" ")[85:100])), (4, "One-two!"), (5, None), (6, "..."), (8, " ".join(w[500:540])), (9, "never seen words")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination(docs, table).collect()}
    assert got == hits(texts, items)
    near = decontam.proximity_matches(docs, decontam.test_windows(spark.createDataFrame([(1, " ".join([*w[700:706], *w[707:714]]))], "item_id long, text string")), 3)
    assert {r.doc_id for r in near.collect()} == {18}


def test_words_of_arrays():
    column = pa.array(["Ab cd\tEf", None, "", "x", " ab  CD ef"])
    words = Words(*text_bytes(column))
    assert words.text.tolist() == [0, 0, 0, 3, 4, 4, 4] and (words.hash[:3] == words.hash[4:]).all()
    data = np.frombuffer(b"banana bandana", np.uint8)
    for n in (1, 3, 6):
        g = byte_grams(data, n)
        for i in range(len(g)):
            assert ((g == g[i]) == [data[k:k + n].tobytes() == data[i:i + n].tobytes() for k in range(len(g))]).all()
    assert sliding(data, 5).tolist() == [min(data[i:i + 5]) for i in range(10)]


def test_runs_hand_out_long_keys_in_parts():
    batches = [pa.RecordBatch.from_pydict({"k": [1, 1, 2]}), pa.RecordBatch.from_pydict({"k": [2] * 5}), pa.RecordBatch.from_pydict({"k": [2, 3]})]
    got = [(t.column("k").to_pylist(), is_open) for t, is_open in common.runs(iter(batches), "k", 4)]
    assert got == [([1, 1], False), ([2] * 6, True), ([2], True), ([3], False)]
