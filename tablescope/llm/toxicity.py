"""Toxicity by a weighted finite-state grammar of clauses.

Transducers, composed in order over the words of a text:

* insult: a prefix tree over word beginnings (4 to 6 bytes, or the whole word); its arcs and
  weights are learned, so inflected and compound forms end in the arc of their stem.
  The weight is the log-odds of the arc among toxic training texts;
* negation: opens a scope of three words in its clause; an insult in it takes the negated arc;
* reported speech: a reporting word turns all of its clause into reported arcs;
* target: an address or a person in the clause turns insults into targeted arcs;
* threat: a verb of harm counts only if its clause also has a target.

Clauses end at punctuation and line ends. What is scored is matched clauses: the summed weight
of plain, negated, reported and targeted insults, the number of matching clauses and of
threats. A logistic layer over these sums is learned from labelled rows, so the grammar's
factors (how much a negation takes back) come from the labels as well.

Learning counts arcs over all labelled rows. Near copies of one text would make its rare words
look like evidence, so of training texts with the same smallest word triple (two independent
orders) one is counted. The logistic layer is fitted on at most ``FIT_ROWS`` rows per label.
The arc table is bounded: an arc must occur in ``MIN_SHARE`` of the toxic texts.

Defined results: null and empty texts get the score of a text without a match; without any
labelled row of either kind every score is 0; texts are read whole; repeated rows give equal
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import LOWER, VALUES, Words, grams, mix, pieces, powers, text_bytes
from tablescope.llm.common import BROADCAST_IDS, by_ids, clean_documents, saved, ship

FIT_ROWS = 20_000
MIN_SHARE = 0.01
MIN_LOG_ODDS = 3.0
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
SCOPE = 3

#: Closed word classes of the grammar, in the languages it knows.
NEGATION = "not no never none without nicht kein keine nie pas jamais sans nunca sin jamás".split()
REPORTING = "said says say wrote writes told claims claimed quoted quote sagte sagt schrieb zitiert dit disait écrit dijo dice escribió".split()
TARGET = ("you your yours he she him her they them people du dich dir ihr euch sie ihn tu te toi vous il elle ils usted "
          "ustedes tú ella ellos ellas").split()
THREAT = ("kill killing hurt destroy burn stab shoot murder beat töten verbrennen schlagen erschießen tuer frapper brûler "
          "matar golpear quemar").split()
FEATURES = ("plain", "negated", "reported", "targeted", "clauses", "threats")


def _hash_words(words: list[str]) -> np.ndarray:
    buf, at = text_bytes(pa.array(words))
    return np.sort(Words(buf, at, "alnum").hash)


def arcs_of(buf: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, arc hash) for the prefix arcs of all words, then for whole words."""
    size = words.end - words.start
    for n in PREFIXES:
        at = np.flatnonzero(size >= n)
        h = np.zeros(len(at), np.uint64)
        for k, p in enumerate(powers(n)):
            h += VALUES[LOWER[buf[words.start[at] + k]]] * p
        yield at, mix(h + np.uint64(1000 + n))
    yield np.arange(len(size)), mix(words.hash + np.uint64(77))


def _find(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Grammar:
    """The composed transducers over one piece of texts."""

    def __init__(self, arcs: np.ndarray, weights: np.ndarray):
        order = np.argsort(arcs)
        self.arcs, self.weights = arcs[order], weights[order]
        self.negation, self.reporting, self.target, self.threat = map(_hash_words, (NEGATION, REPORTING, TARGET, THREAT))

    def features(self, column: pa.Array) -> np.ndarray:
        buf, at = text_bytes(column)
        words = Words(buf, at, "alnum")
        out = np.zeros((len(at) - 1, len(FEATURES)))
        if not len(words.hash):
            return out
        insult = np.zeros(len(words.hash))
        for number, arc in arcs_of(buf, words):
            k = _find(arc, self.arcs)
            hit = k >= 0
            insult[number[hit]] = np.maximum(insult[number[hit]], self.weights[k[hit]])
        stops = np.concatenate([[0], np.cumsum(np.isin(buf, np.frombuffer(b".!?;:,\n", np.uint8)))])
        mark = stops[words.start]
        clause = np.concatenate([[0], np.cumsum((mark[1:] != mark[:-1]) | (words.text[1:] != words.text[:-1]))])
        n = clause[-1] + 1
        has = lambda table: _find(words.hash, table) >= 0
        negation, reported = has(self.negation), np.bincount(clause, has(self.reporting), n) > 0
        targeted = np.bincount(clause, has(self.target), n) > 0
        negated = np.zeros(len(insult), bool)
        for back in range(1, SCOPE + 1):
            negated[back:] |= negation[:-back] & (clause[back:] == clause[:-back])
        threat = has(self.threat) & targeted[clause]
        plain = ~negated & ~reported[clause]
        matched = np.bincount(clause, insult, n) > 0
        first = np.concatenate([[0], np.flatnonzero(clause[1:] != clause[:-1]) + 1])
        texts = len(out)
        for k, x in enumerate((insult * plain, insult * negated, insult * reported[clause], insult * targeted[clause])):
            out[:, k] = np.bincount(words.text, x, texts)
        out[:, 4] = np.bincount(words.text[first], matched, texts)
        out[:, 5] = np.bincount(words.text, threat, texts)
        return np.log1p(out)


def learn_arcs(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Insult arcs and weights from (doc_id, text, toxic) rows."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(*text_bytes(part.column("text")), "alnum")
                a, b = [], []
                for row in range(part.num_rows):
                    h = words.hash[words.first[row]: words.first[row + 1]]
                    g = grams(h, min(3, len(h))) if len(h) else np.zeros(1, np.uint64)
                    a.append(int(g.min().view(np.int64)))
                    b.append(int(mix(g + np.uint64(1)).min().view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"),
                                                  "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    signed = saved(train.mapInArrow(signs, "doc_id long, toxic int, a long, b long"))
    low_a = signed.groupBy("a", "toxic").agg(F.min("doc_id").alias("low_a"))
    low_b = signed.groupBy("b", "toxic").agg(F.min("doc_id").alias("low_b"))
    once = saved(signed.join(low_a, ["a", "toxic"]).join(low_b, ["b", "toxic"]).where("doc_id = low_a and doc_id = low_b").select("doc_id", "toxic").distinct())
    sizes = {r[0]: r[1] for r in once.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return np.zeros(0, np.uint64), np.zeros(0)
    train = by_ids(train, once, "left_semi")

    def count(among: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    buf, at = text_bytes(part.column("text"))
                    words = Words(buf, at, "alnum")
                    arc, text = [], []
                    for number, a in arcs_of(buf, words):
                        keep = slice(None) if among is None else _find(a, among) >= 0
                        arc.append(a[keep])
                        text.append(words.text[number][keep])
                    arc, text = np.concatenate(arc), np.concatenate(text)
                    order = np.lexsort((text, arc))
                    arc, text = arc[order], text[order]
                    new = np.ones(len(arc), bool)
                    new[1:] = (arc[1:] != arc[:-1]) | (text[1:] != text[:-1])
                    arc, n = np.unique(arc[new], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"arc": arc.view(np.int64), "n": n.astype(np.int64)})
        return run

    least = max(3, int(np.ceil(MIN_SHARE * sizes[1])))
    toxic = saved(train.where("toxic = 1").select("text").mapInArrow(count(None), "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    found = {r[0]: r[1] for r in toxic.collect()}  # bounded: texts have finite length and an arc is in MIN_SHARE of them
    among = np.sort(np.array(list(found), np.int64).view(np.uint64))
    clean = {r[0]: r[1] for r in train.where("toxic = 0").select("text").mapInArrow(count(among), "arc long, n long").groupBy("arc").agg(F.sum("n")).collect()}
    arcs = np.array(list(found), np.int64)
    odds = np.array([np.log((found[a] + 0.5) / (sizes[1] + 1)) - np.log((clean.get(a, 0) + 0.5) / (sizes[0] + 1)) for a in arcs.tolist()])
    keep = odds >= MIN_LOG_ODDS if len(odds) else np.zeros(0, bool)
    return arcs[keep].view(np.uint64), odds[keep] if len(odds) else odds


def learn_layer(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (bias first) by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, train: str = "true") -> DataFrame:
    """doc_id, score, predicted for every row; learns from labelled rows where ``train`` (SQL over doc_id) holds."""
    spark = docs.sparkSession
    ship(spark)
    docs = clean_documents(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = saved(known.where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = by_ids(docs, known, "left_semi")
    train_rows = rows.join(F.broadcast(known) if known.count() <= BROADCAST_IDS else known, "doc_id")
    arcs, weights = learn_arcs(train_rows)
    grammar = Grammar(arcs, weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = grammar.features(part.column("text"))
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), **{f: x[:, k] for k, f in enumerate(FEATURES)}})

    if len(arcs):
        picks = known.groupBy("toxic").count().collect()
        share = {r[0]: min(1.0, FIT_ROWS / r[1]) for r in picks}
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
        sample = train_rows.where(((F.col("toxic") == 1) & (draw < share.get(1, 0))) | ((F.col("toxic") == 0) & (draw < share.get(0, 0))))
        got = sample.select("text", "toxic").mapInArrow(measure, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
        layer = learn_layer(got[list(FEATURES)].to_numpy(), got["toxic"].to_numpy(float))
    else:
        layer = None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = grammar.features(part.column("text"))
                s = np.zeros(len(x)) if layer is None else 1 / (1 + np.exp(-np.clip(layer[0] + x @ layer[1:], -30, 30)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    return docs.mapInArrow(score, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, train: str = "true") -> DataFrame:
    """The documents that are not rejected; every column is kept."""
    gone = saved(toxicity(docs, labels, train).where("predicted = 1").select("doc_id").distinct())
    return by_ids(docs, gone, "left_anti").select(*docs.columns)
