"""Operators that must use all of their input, against brute force."""

import collections
import functools
import math
import re

import numpy as np
import pytest
from fixtures_llm import text

from tablescope.llm import context_tree, sentence_spans


def _bytes(t: str) -> list[tuple[bytes, int]]:
    """(six preceding bytes, nearest first, byte) of a text."""
    data = b"\n" * 6 + b"".join(w + b" " for w in t.encode().lower().split()) + b"\n"
    return [(data[i - 6: i][::-1], data[i]) for i in range(6, len(data))]


def test_context_tree_keeps_every_context(spark):
    rng = np.random.default_rng(1)
    letters = "".join(chr(97 + x) for x in rng.integers(0, 26, 150_000))
    docs = spark.createDataFrame([(i, letters[i * 1000: i * 1000 + 1000]) for i in range(150)], "doc_id long, text string")
    model = context_tree.fit(context_tree.gather(docs))
    want = {c for i in range(150) for c, _ in _bytes(letters[i * 1000: i * 1000 + 1000])}
    assert len(want) > 100_000
    for d in range(7):
        assert int((model["contexts"] >> 56 == d).sum()) == len({c[:d] for c in want})


@pytest.mark.parametrize("held", [0, 40, 1 << 20])
def test_context_tree_scores_equal_weighting(spark, monkeypatch, held):
    """Training texts consist of seen bytes alone, so their scores are the exact mixture; nothing depends on what tasks hold."""
    texts = {i: text(i, 30) for i in range(6)} | {6: text(1, 30), 7: ""}
    seen = [x for i, t in texts.items() if i < 5 for x in _bytes(t)]
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    for context, byte in seen:
        for d in range(7):
            for k in range(8):
                counts[context[:d], (1 << k) | (byte >> (8 - k))][(byte >> (7 - k)) & 1] += 1
            if d < 6:
                children[context[:d]].add(context[: d + 1])

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)

    @functools.cache
    def total(context, node):
        own = kt(counts[context, node])
        if len(context) == 6:
            return own
        return np.logaddexp(own, sum(total(c, node) for c in children[context] if (c, node) in counts)) - math.log(2)

    def one(context, node, d=0):
        n = counts[context[:d], node]
        own = (n[1] + 0.5) / (sum(n) + 1)
        if d == 6:
            return own
        w = math.exp(kt(n) - math.log(2) - total(context[:d], node))
        return w * own + (1 - w) * one(context, node, d + 1)

    def log(context, byte):
        p = 1.0
        for k in range(8):
            q = one(context, (1 << k) | (byte >> (8 - k)))
            p *= q if (byte >> (7 - k)) & 1 else 1 - q
        return math.log10(p)

    monkeypatch.setattr(context_tree, "HELD_KEYS", held)
    monkeypatch.setattr(context_tree, "STEP", 100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_tree.score(docs, "doc_id < 5").collect()}
    for i in (0, 1, 2, 3, 4, 6):
        assert got[i] == pytest.approx(sum(log(*x) for x in _bytes(texts[i])), abs=1e-6)
    assert got.keys() == texts.keys()
    model = context_tree.fit(context_tree.gather(docs.where("doc_id < 5")))
    for i in (5, 7):
        keys = np.array([int.from_bytes(c + bytes([b]), "big") for c, b in _bytes(texts[i])], np.int64)
        assert got[i] == pytest.approx(context_tree.log_probabilities(keys, model).sum(), abs=1e-6)


def test_sentence_runs_grow_to_the_least_words(spark):
    marked = " ".join(f"W{i % 13}X{i}!!" for i in range(60))
    lines = "\n".join(f"item {i}" for i in range(40))
    texts = {1: marked, 2: marked, 3: "Before. " + marked + " After.", 4: lines, 5: "New start here.\n" + lines + "\nNew end",
             6: "Yes. No.", 7: "Yes. No.", 8: "One two three four. Five six seven eight. Alone here.", 9: "One two three four. Five six seven eight. Other end.", 10: None,
             11: "A b c d e f. G h. I j. K l.", 12: "Q. A b c d e f. G h. I j. K l. Z."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def split(t):
        return re.findall("[^.!?\n]+[.!?\n]*\\s*|[.!?\n]+\\s*", t or "")

    first, runs = {}, []
    for d, t in sorted(texts.items()):
        s = [" ".join(x.lower().split()) for x in split(t)]
        n = len(s)
        whole = lambda i, j: j - i >= 2 and len(" ".join(s[i:j]).split(" ")) >= 8  # noqa: B023, E731
        # every run that is whole, and neither of its two shorter ones or only one of them is
        for i in range(n):
            for j in range(i + 2, n + 1):
                if whole(i, j) and not (whole(i, j - 1) and whole(i + 1, j)):
                    runs.append((d, i, j, " ".join(s[i:j])))
    for d, i, j, t in runs:
        first[t] = min(first.get(t, (d, i)), (d, i))
    want = {d: set() for d in texts}
    for d, i, j, t in runs:
        if first[t] < (d, i):
            want[d] |= set(range(i + 1, j + 1))
    got = {r.doc_id: r for r in sentence_spans.dedup_sentences(docs).collect()}
    assert {d: set(r.gone) for d, r in got.items()} == want
    assert got[2].kept_text == "" and got[3].kept_text == "Before. After." and got[5].kept_text == "New start here.\nNew end"
    assert got[7].n_removed == 0 and got[9].kept_text == "Other end." and got[12].kept_text == "Q. Z."
