"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tablescope.llm import periodic_runs
from tablescope.llm.periodic_runs import Blocks, WaveletTree, runs_of

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words):
    """(start, length, period) of all maximal stretches, smallest period each."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, words):
    runs = brute_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def found_runs(texts):
    """Runs of each of several word lists, searched as one batch."""
    flat = [w for t in texts for w in t]
    codes = np.unique(flat, return_inverse=True)[1] if flat else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    begins = np.r_[0, np.cumsum([len(t) for t in texts])]
    out = [[] for _ in texts]
    for s, n, q in zip(*(x.tolist() for x in runs_of(codes, text))):
        out[text[s]].append((s - int(begins[text[s]]), n, q))
    return out


def made_texts(seed):
    """Texts with nested, overlapping, adjoining and broken repeats."""
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        words = []
        while len(words) < r.choice([0, 5, 30, 200, 400]):
            kind = r.random()
            base = [r.choice("abc") for _ in range(r.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 24, 31, 33, 40]))]
            if kind < 0.3:
                base = base * r.randint(2, 4) + base[: len(base) // 2]
            if kind < 0.8:
                base = base * r.randint(1, 6) + base[: r.randint(0, len(base))]
            if kind > 0.9 and base:
                base[r.randrange(len(base))] = "x"
            words += base
        texts.append(words)
    return texts


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    texts = made_texts(seed)
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_simple_and_long_runs():
    texts = [["a"] * 23, ["a"] * 24, list("ab") * 12, ["a"] * 3000, list("aab" * 500), [], ["a"] * 24,
             [str(i % 1000) for i in range(3500)], [str(i % 1000) for i in range(2999)], [str(i % 8) for i in range(24)], [str(i % 9) for i in range(27)]]
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_wavelet_tree():
    r = np.random.default_rng(3)
    values = r.permutation(1000)
    tree = WaveletTree(values)
    lo = r.integers(0, 1000, 300)
    hi = np.minimum(lo + r.integers(0, 200, 300), 1000)
    x = r.integers(0, 1100, 300)
    got = tree.successors(lo, hi, x, 3)
    for i in range(300):
        want = sorted(v for v in values[lo[i]:hi[i]] if v >= x[i])[:3]
        assert [v for v in got[:, i] if v >= 0] == want


def test_blocks_extend_within_a_text():
    codes, text = np.array([1, 2, 1, 2, 1, 2, 1]), np.array([0, 0, 0, 0, 1, 1, 1])
    blocks = Blocks(codes, text)
    assert blocks.forward(np.array([0, 4]), np.array([2, 6])).tolist() == [2, 1]
    assert blocks.backward(np.array([2, 5]), np.array([4, 6])).tolist() == [2, 0]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    from tablescope.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()]
    assert sorted(found) == sorted(brute_row(d, planted(d, WORD.findall(t or ""))) for d, t in docs)


def test_odd_rows(spark):
    rows = [(1, None), (1, "same id"), (2, ""), (2, " \t\n "), (3, "é " * 30 + " "), (3, "é " * 30 + " "), (None, "x\x0by\x0c" * 20), (4, "a " * 40_000 + "b"),
            (5, "A a " * 30), (6, "no run\x00 here")]
    frame = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, runs string, n_words int")
    found = [tuple(r) for r in periodic_runs.digests(periodic_runs.periodic_runs(frame)).collect()]
    key = lambda r: (r[0] or 0, *map(str, r))
    assert sorted(found, key=key) == sorted([brute_row(d, WORD.findall(t or "")) for d, t in rows if d != 4] +
                                            [(4, 1, 0, 40_000, 1, 40_000_000, hashlib.sha256(b"0,40000,1\n").hexdigest(), hashlib.sha256(b"a b").hexdigest())], key=key)
    assert periodic_runs.periodic_runs(frame.limit(0)).count() == 0
