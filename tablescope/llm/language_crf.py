"""Language identification of words in code-switched text by a linear-chain conditional random field.

Emissions are summed weights of a word's features for each language: byte n-grams with the
word's borders (so prefixes and suffixes are features of their own) and the whole word as a
lexicon entry, hashed to a fixed table. Transitions between languages are learned with them, by
gradient steps on the exact likelihood (forward-backward) of labelled sentences. Every word
of a text is labelled by forward-backward over its sentence; a text's language is the one with
the largest summed posterior, its score that language's share.

Fitting uses at most ``FIT_SENTENCES`` sentences per language, drawn by hash from all training
texts. A sentence ends at ``.``, ``!``, ``?`` or a line end, or after ``LONGEST`` words.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
training row every text is ``und``; ties go to the language that sorts first; texts are read
whole; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import VALUES, Words, byte_grams, mix, pieces, text_bytes
from tablescope.llm.common import clean_documents, saved, ship
from tablescope.llm.context_tree import stream

FIT_SENTENCES = 3000
LONGEST = 64
BITS = 17
SIZES = (2, 3, 4)
SEED = 20240229


class Sentences:
    """Words of texts with their features, and the sentence of each word."""

    def __init__(self, column: pa.Array):
        buf, at = text_bytes(column)
        words = Words(buf, at, "alnum")
        self.text, self.texts, self.words = words.text, len(at) - 1, len(words.hash)
        data, begins = stream(buf, words, self.texts)
        self.data = np.concatenate([[0x20], data, [0x20]]).astype(np.uint8)
        sizes = words.end - words.start
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[:-1] + np.arange(self.words) + words.text + 1
        self.end = self.begin + sizes
        self.lexicon = (mix(words.hash + np.uint64(5)) >> np.uint64(64 - BITS)).astype(np.int64)
        stops = np.concatenate([[0], np.cumsum(np.isin(buf, np.frombuffer(b".!?\n", np.uint8)))])[words.start] if self.words else np.zeros(0)
        new = np.ones(self.words, bool)
        new[1:] = (stops[1:] != stops[:-1]) | (words.text[1:] != words.text[:-1])
        first = np.flatnonzero(new)
        place = np.arange(self.words) - np.repeat(first, np.diff(np.concatenate([first, [self.words]])))
        new |= place % LONGEST == 0
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.concatenate([self.first, [self.words]]))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(feature at each place, first place of each word, place after its last) for each n-gram size."""
        for n in SIZES:
            feature = (byte_grams(self.data, n) >> np.uint64(64 - BITS)).astype(np.int64)
            lo = self.begin - 1
            yield feature, lo, np.maximum(self.end + 2 - n, lo)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = weights[self.lexicon].astype(float)
        for feature, lo, hi in self.grams():
            total = np.zeros((len(feature) + 1, weights.shape[1]))
            np.cumsum(weights[feature], axis=0, out=total[1:])
            top = len(feature)
            out += total[np.minimum(hi, top)] - total[np.minimum(lo, top)]
        return out


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, expected transitions and log-likelihood normaliser of padded sentences (sentence, word, label)."""
    rows, steps, labels = emit.shape
    a = np.exp(trans)
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    alpha, scale = np.zeros_like(e), np.ones((rows, steps))
    for t in range(steps):
        now = e[:, t] if t == 0 else (alpha[:, t - 1] @ a) * e[:, t]
        s = now.sum(axis=1)
        alpha[:, t], scale[:, t] = now / s[:, None], s
        if t:
            off = ~mask[:, t]
            alpha[off, t], scale[off, t] = alpha[off, t - 1], 1
    beta = np.ones_like(e)
    pair = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        nxt = e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        on = mask[:, t + 1]
        beta[on, t] = (nxt @ a.T)[on]
        beta[~on, t] = beta[~on, t + 1]
        pair += a * (alpha[on, t].T @ nxt[on])
    return alpha * beta, pair, (np.log(scale) * mask).sum() + (top[:, :, 0] * mask).sum()


def _padded(emit: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = int(length.max())
    at = first[:, None] + np.arange(steps)
    mask = np.arange(steps) < length[:, None]
    return np.where(mask[:, :, None], emit[np.minimum(at, len(emit) - 1)], 0.0), mask, at


def posteriors(s: Sentences, weights: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; sentences of like length are handled together."""
    emit = s.emissions(weights)
    out = np.zeros_like(emit)
    low = 0
    for high in (4, 8, 12, 16, 24, 32, 48, LONGEST):
        pick = np.flatnonzero((s.length > low) & (s.length <= high))
        low = high
        if len(pick):
            padded, mask, at = _padded(emit, s.first[pick], s.length[pick])
            post, _, _ = forward_backward(padded, mask, trans)
            out[at[mask]] = post[mask]
    return out


def train_crf(texts: list[str], labels: np.ndarray, n_labels: int, epochs: int = 3, batch: int = 256, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by adaptive gradient steps; each text is one labelled sentence or several."""
    rng = np.random.default_rng(SEED)
    weights, seen = np.zeros((1 << BITS, n_labels)), np.full((1 << BITS, n_labels), 1e-2)
    trans, trans_seen = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-2)
    order = np.arange(len(texts))
    for _ in range(epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), batch):
            pick = order[lo: lo + batch]
            s = Sentences(pa.array([texts[i] for i in pick]))
            if not s.words:
                continue
            gold = labels[pick][s.text]
            padded, mask, at = _padded(s.emissions(weights), s.first, s.length)
            post, pair, _ = forward_backward(padded, mask, trans)
            grad = np.zeros((s.words, n_labels))
            grad[at[mask]] = -post[mask]
            grad[np.arange(s.words), gold] += 1
            feature, owner = [s.lexicon], [np.arange(s.words)]
            for f, a, b in s.grams():
                n = np.minimum(b, len(f)) - np.minimum(a, len(f))
                o = np.repeat(np.arange(s.words), n)
                feature.append(f[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[o]])
                owner.append(o)
            feature, owner = np.concatenate(feature), np.concatenate(owner)
            g = np.stack([np.bincount(feature, grad[owner, k], 1 << BITS) for k in range(n_labels)], axis=1) / len(s.first)
            seen += g * g
            weights += rate * g / np.sqrt(seen)
            true = np.zeros((n_labels, n_labels))
            same = np.ones(s.words, bool)
            same[s.first] = False
            np.add.at(true, (gold[same], gold[same]), 1)
            g = (true - pair) / len(s.first)
            trans_seen += g * g
            trans += rate * g / np.sqrt(trans_seen)
    return weights.astype(np.float32), trans


def _sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "(?<=[.!?])\\s+|\n")).alias("i", "sentence")).where("length(sentence) >= 10 and length(sentence) <= 2000")


def languages(docs: DataFrame, train: str = "true", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score for every row; learns from rows with a language where ``train`` (SQL over doc_id) holds."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(lang).alias("lang")).where("lang is not null and text is not null").where(train)
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect()}
    names = sorted(sizes)
    if names:
        # about FIT_SENTENCES sentences of 60 bytes or more per language
        share = F.coalesce(*[F.when(F.col("lang") == n, F.lit(min(1.0, 60.0 * FIT_SENTENCES / max(sizes[n], 1)))) for n in names])
        draw = F.pmod(F.xxhash64("doc_id", "i", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
        got = _sentence_rows(known).where(draw < share).select("lang", "sentence", draw.alias("d")).orderBy("d").limit(4 * FIT_SENTENCES * len(names)).toPandas()
        at = {n: k for k, n in enumerate(names)}
        weights, trans = train_crf(got["sentence"].tolist(), got["lang"].map(at).to_numpy(int), len(names))
    else:
        weights, trans = np.zeros((1 << BITS, 1), np.float32), np.zeros((1, 1))
    model = spark.sparkContext.broadcast((weights, trans))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, trans = model.value
        for batch in batches:
            for part in pieces(batch):
                s = Sentences(part.column("text"))
                mass = np.zeros((s.texts, weights.shape[1]))
                if s.words:
                    post = posteriors(s, weights, trans)
                    for k in range(mass.shape[1]):
                        mass[:, k] = np.bincount(s.text, post[:, k], s.texts)
                total = mass.sum(axis=1)
                ok = np.array(part.column("letters").to_pylist(), bool) & (total > 0) & bool(names)
                best = mass.argmax(axis=1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "lang_pred": pa.array([names[b] if o else "und" for b, o in zip(best, ok, strict=True)], pa.string()),
                    "score": np.where(ok, mass.max(axis=1) / np.maximum(total, 1e-300), 0.0)})

    texts = clean_documents(docs).withColumn("letters", F.col("text").rlike("\\p{L}"))
    return texts.mapInArrow(label, "doc_id long, lang_pred string, score double")
