"""Language-model scoring by context-tree weighting over bytes.

A text is read as its lower-cased words, each followed by a space, and a line feed at the end.
A byte is eight binary decisions; each decision has a tree over the preceding bytes (nearest
byte first, up to ``DEPTH``). A node holds the Krichevsky-Trofimov estimate of its counts, and
its weighted probability is half of that estimate plus half of the product of its children.
The weights that follow mix the estimates of all depths for every decision, and the product of
eight decisions is the probability of a byte; its negative logarithm is the code length.

Counts are gathered over all texts, combined in the tasks and then by key; no context is left
out. The contexts that share their nearest ``TOP`` bytes form subtrees, which tasks solve many
at a time; the levels above them, whose size the alphabet bounds and not the input, are solved
on the driver and handed to the tasks. There the probabilities become pairs of seen (context,
byte) with an escape factor per context: bytes unseen in a context get the mass that the mixture
leaves there, shared like in the next shorter context. Each subtree scores the context keys of
all texts that belong to it, so the scores of keys are a Spark table.

Texts find their scores there: the ``HELD_KEYS`` most frequent keys are held by tasks, all others
are joined by key. What is held changes the work, never the result.

The base score needs the count of every word. Counts of the ``COMMON`` most frequent words are
held by tasks, those of all other words are joined by key, so no word is a hot key.

Defined results: null texts are empty and consist of the end alone; without training texts every
byte has probability 1/256; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import LOWER, Words, pieces, text_bytes
from tablescope.llm.common import clean_documents, runs, saved, ship

DEPTH = 6
#: Depth at which the trees are cut into subtrees for the tasks.
TOP = 3
#: Nearest bytes by which counted keys are dealt to tasks.
TOGETHER = 4
#: Context keys (16 bytes each) that scoring tasks hold; the others are joined.
HELD_KEYS = 1 << 20
#: Context keys of a step of a solving task.
STEP = 100_000
COMMON = 1 << 17
SPACE, END = 0x20, 0x0A
#: Entries that a counting task holds before it hands them on.
HELD = 2_000_000
_END_TOKEN = np.array([0x1F2E3D4C5B6A7988], np.uint64).view(np.int64)[0]


def stream(buf: np.ndarray, words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in normal form, and where each text begins."""
    sizes = words.end - words.start
    before = np.concatenate([[0], np.cumsum(sizes)])
    begins = before[words.first] + words.first + np.arange(texts + 1)
    out = np.full(int(begins[-1]), SPACE, np.uint8)
    out[begins[1:] - 1] = END
    number = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(before[-1]) - before[:-1][number] + words.start[number] if len(sizes) else np.zeros(0, np.int64)
    out[np.arange(before[-1]) + number + words.text[number]] = LOWER[buf[inside]]
    return out, begins


def context_keys(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One key per byte: preceding bytes, nearest first, then the byte itself. Texts begin after line feeds."""
    place = np.arange(len(data)) - np.repeat(begins[:-1], np.diff(begins))
    key = np.zeros(len(data), np.int64)
    for back in range(1, DEPTH + 1):
        earlier = np.full(len(data), END, np.int64)
        earlier[back:] = data[:-back] if back < len(data) + 1 and len(data) >= back else earlier[back:]
        key = (key << 8) | np.where(place >= back, earlier, END)
    return (key << 8) | data


class Counter:
    """Counts of integer keys, handed on when too many are held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
        return keys[at], np.add.reduceat(n, at) if len(at) else n

    def full(self) -> tuple[np.ndarray, np.ndarray] | None:
        """What to hand on, if merging alone doesn't make room."""
        if self.size <= HELD:
            return None
        keys, n = self.merged()
        self.parts, self.size = [(keys, n)], len(keys)
        if self.size * 2 <= HELD:
            return None
        self.parts, self.size = [], 0
        return keys, n


def _table(keys: np.ndarray, n: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 100_000):
        part = keys[lo: lo + 100_000]
        yield pa.RecordBatch.from_pydict({"kind": np.full(len(part), kind, np.int32), "key": part, "n": n[lo: lo + 100_000].astype(np.int64)})


def gather(docs: DataFrame, train: str = "true") -> DataFrame:
    """(kind, key, n): kind 0 counts tokens and kind 1 bytes in their full context, both of training rows; kind 2 those bytes of the other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counter(), Counter(), Counter()
        for batch in batches:
            for part in pieces(batch):
                buf, at = text_bytes(part.column("text"))
                words = Words(buf, at)
                learns = part.column("learns").to_numpy(zero_copy_only=False)
                counters[0].add(words.hash.view(np.int64)[learns[words.text]])
                counters[0].parts.append((np.array([_END_TOKEN])[: learns.sum()], np.array([learns.sum()])[: learns.sum()]))
                data, begins = stream(buf, words, part.num_rows)
                keys, inside = context_keys(data, begins), np.repeat(learns, np.diff(begins))
                counters[1].add(keys[inside])
                counters[2].add(keys[~inside])
                for kind, c in enumerate(counters):
                    if (out := c.full()) is not None:
                        yield from _table(*out, kind)
        for kind, c in enumerate(counters):
            yield from _table(*c.merged(), kind)

    rows = docs.select("text", F.coalesce(F.expr(train).cast("boolean"), F.lit(False)).alias("learns"))
    # tasks have combined their counts; combining them again before the exchange would find nothing. Tasks hand keys on in order,
    # and those that share their nearest bytes stay together, so that neighbours differ in few bytes and rows are written small.
    found = rows.mapInArrow(run, "kind int, key long, n long").withColumn("near", F.shiftright("key", 8 * (DEPTH - TOGETHER + 1)))
    return found.repartition("near").groupBy("near", "kind", "key").agg(F.sum("n").alias("n")).drop("near")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2: Stirling's series ten steps further up."""
    y = x + 10
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = x.copy()
    for k in range(1, 10):
        product *= x + k
    return series - np.log(product)


_FEW = np.arange(4096)
_HALVES, _WHOLES = _log_gamma(_FEW + 0.5), _log_gamma(_FEW + 1.0)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    def g(x: np.ndarray, few: np.ndarray, more: float) -> np.ndarray:
        out = few[np.minimum(x, len(few) - 1).astype(np.int64)]
        large = x >= len(few)
        out[large] = _log_gamma(x[large] + more)
        return out

    return g(a, _HALVES, 0.5) + g(b, _HALVES, 0.5) - g(a + b, _WHOLES, 1.0) - np.log(np.pi)


class Level:
    """All decisions of the contexts of one depth: keys context * 256 + decision, zeros and ones."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray):
        order = np.lexsort((symbols, contexts))
        self.contexts, self.symbols, self.n = contexts[order], symbols[order], n[order]
        node = np.concatenate([(self.contexts << 8) | (1 << k) | (self.symbols >> (8 - k)) for k in range(8)])
        bit = np.concatenate([(self.symbols >> (7 - k)) & 1 for k in range(8)])
        self.nodes, at = np.unique(node, return_inverse=True)
        self.node_of = at.reshape(8, -1)
        self.bit_of = bit.reshape(8, -1)
        m = np.tile(self.n, 8).astype(float)
        self.ones = np.bincount(at, m * bit, len(self.nodes))
        self.zeros = np.bincount(at, m * (1 - bit), len(self.nodes))

    def solve(self, below: Level | None) -> None:
        """Weighted probability of every decision, bottom-up."""
        self.own = _log_kt(self.zeros, self.ones)
        self.rest0, self.rest1 = self.zeros.copy(), self.ones.copy()
        below_log = np.zeros(len(self.nodes))
        has = np.zeros(len(self.nodes), bool)
        if below is not None and len(below.nodes):
            up = ((below.nodes >> 16) << 8) | (below.nodes & 255)
            at = np.searchsorted(self.nodes, up)
            below.parent = at
            below_log += np.bincount(at, below.total, len(self.nodes))
            self.rest0 -= np.bincount(at, below.zeros, len(self.nodes))
            self.rest1 -= np.bincount(at, below.ones, len(self.nodes))
            has[at] = True
        below_log += np.where(has, _log_kt(np.maximum(self.rest0, 0), np.maximum(self.rest1, 0)), 0)
        self.total = np.where(has, np.logaddexp(self.own, below_log) - np.log(2), self.own)
        self.weight = np.where(has, np.exp(self.own - np.log(2) - self.total), 1.0)

    def predict(self, mixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every (context, symbol); ``mixed`` and ``left`` come from the shorter contexts.

        Returns what to hand to the next depth, per decision.
        """
        kt = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        rest = (self.rest1 + 0.5) / (self.rest0 + self.rest1 + 1)
        one = mixed + left * (self.weight * kt + (1 - self.weight) * rest)
        one = np.clip(one, 1e-12, 1 - 1e-12)
        self.p = np.where(self.bit_of == 1, one[self.node_of], 1 - one[self.node_of]).prod(axis=0)
        return mixed + left * self.weight * kt, left * (1 - self.weight)

    def escapes(self, shorter: Level | None) -> tuple[np.ndarray, np.ndarray]:
        """(context, log10 factor) for symbols that the context hasn't seen."""
        contexts, begins = np.unique(self.contexts, return_index=True)
        if not len(contexts):
            return contexts, np.zeros(0)
        free = 1 - np.add.reduceat(self.p, begins)
        if shorter is None:
            seen = np.diff(np.concatenate([begins, [len(self.contexts)]]))
            base = np.maximum(256 - seen, 1).astype(float)
            return contexts, np.log10(np.maximum(free, 1e-12) / base)
        up = (self.contexts >> 8 << 8) | self.symbols
        at = np.searchsorted((shorter.contexts << 8) | shorter.symbols, up)
        open_ = 1 - np.add.reduceat(shorter.p[at], begins)
        return contexts, np.log10(np.maximum(free, 1e-12)) - np.log10(np.maximum(open_, 1e-12))


def _shorter(level: Level) -> Level:
    """The level above, from the counts of a whole one."""
    pair, at = np.unique((level.contexts >> 8 << 8) | level.symbols, return_inverse=True)
    return Level(pair >> 8, pair & 255, np.bincount(at, level.n, len(pair)).astype(np.int64))


def _subtrees(keys: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """Solved levels TOP to DEPTH of whole subtrees."""
    levels = {DEPTH: Level(keys >> 8, keys & 255, n)}
    for d in range(DEPTH, TOP - 1, -1):
        levels[d].solve(levels.get(d + 1))
        if d > TOP:
            levels[d - 1] = _shorter(levels[d])
    return levels


def _handed_up(top: Level) -> Iterator[pa.RecordBatch]:
    """Counts (kind 0) and log probabilities of decisions (kind 1) of subtrees, by the context above."""
    for kind, key, value in ((0, (top.contexts >> 8 << 8) | top.symbols, top.n), (1, ((top.nodes >> 16) << 8) | (top.nodes & 255), top.total)):
        key, at = np.unique(key, return_inverse=True)
        yield pa.RecordBatch.from_pydict({"kind": np.full(len(key), kind, np.int32), "key": key, "value": np.bincount(at, value, len(key)).astype(float)})


def _predicted(levels: dict[int, Level], shorter: Level | None, mixed: np.ndarray, left: np.ndarray) -> dict[str, np.ndarray]:
    """Scoring tables of solved levels, sorted by key; ``mixed`` and ``left`` belong to the first level's decisions."""
    out: dict[str, list] = {"keys": [], "logs": [], "contexts": [], "escapes": []}
    first = min(levels)
    for d in sorted(levels):
        level, mark = levels[d], d << 56
        if d > first:
            mixed, left = mixed[level.parent], left[level.parent]
        mixed, left = level.predict(mixed, left)
        level.handed = mixed, left
        contexts, escapes = level.escapes(shorter)
        for name, part in zip(out, (mark | (level.contexts << 8) | level.symbols, np.log10(level.p), mark | contexts, escapes), strict=True):
            out[name].append(part)
        shorter = level
    return {name: np.concatenate(parts) for name, parts in out.items()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, their counts in training rows and in all rows, of whole subtrees."""
    def ready(tables: list[pa.Table]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind, key, n = (pa.concat_tables(tables).column(c).to_numpy() for c in ("kind", "key", "n"))
        keys, at = np.unique(key, return_inverse=True)
        return keys, np.bincount(at, np.where(kind == 1, n, 0), len(keys)).astype(np.int64), np.bincount(at, n, len(keys)).astype(np.int64)

    held, size = [], 0
    for table, _ in runs(batches, "near"):
        held.append(table)
        size += table.num_rows
        if size >= STEP:
            yield ready(held)
            held, size = [], 0
    if held:
        yield ready(held)


def _by_subtree(counts: DataFrame) -> DataFrame:
    near = F.shiftright("key", 8 * (DEPTH - TOP + 1)).alias("near")
    return counts.where("kind > 0").select(near, "kind", "key", "n").repartition("near").sortWithinPartitions("near")


def _shallow(counts: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Scoring tables of the levels above TOP, and what the subtrees need of them. The alphabet bounds their size."""

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, _ in _chunks(batches):
            if n.any():
                yield from _handed_up(_subtrees(keys[n > 0], n[n > 0])[TOP])

    found = _by_subtree(counts.where("kind = 1")).mapInArrow(first_pass, "kind int, key long, value double").groupBy("kind", "key").agg(F.sum("value").alias("value")).toArrow()
    kind, key, value = (found.column(c).to_numpy() for c in ("kind", "key", "value"))
    if not len(key):
        none, zero = np.zeros(0, np.int64), np.zeros(0)
        return {"keys": none, "logs": zero, "contexts": none, "escapes": zero}, {}
    pairs = np.flatnonzero(kind == 0)
    nodes = np.flatnonzero(kind == 1)
    last = Level(key[pairs] >> 8, key[pairs] & 255, value[pairs].astype(np.int64))
    below = Level.__new__(Level)
    order = nodes[np.argsort(key[nodes])]
    below.nodes, below.total = ((key[order] >> 8) << 16) | (key[order] & 255), value[order]
    below.zeros, below.ones = last.zeros, last.ones
    levels, level = {}, last
    for d in range(TOP - 1, -1, -1):
        level.solve(below)
        levels[d] = below = level
        level = _shorter(level)
    tables = _predicted(levels, None, np.zeros(len(levels[0].nodes)), np.ones(len(levels[0].nodes)))
    mixed, left = last.handed
    return tables, {"nodes": last.nodes, "mixed": mixed, "left": left, "contexts": last.contexts, "symbols": last.symbols, "p": last.p}


def _deep(keys: np.ndarray, n: np.ndarray, above: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Scoring tables of whole subtrees."""
    levels = _subtrees(keys, n)
    shorter = Level.__new__(Level)
    shorter.contexts, shorter.symbols, shorter.p = above["contexts"], above["symbols"], above["p"]
    nodes = levels[TOP].nodes
    at = np.searchsorted(above["nodes"], ((nodes >> 16) << 8) | (nodes & 255))
    return _predicted(levels, shorter, above["mixed"][at], above["left"][at])


def scored_keys(counts: DataFrame) -> DataFrame:
    """(key, times, log): every context key of all rows, how often it occurs, and the log10 probability of its last byte."""
    shared = counts.sparkSession.sparkContext.broadcast(_shallow(counts))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shallow, above = shared.value
        for keys, n, times in _chunks(batches):
            model = shallow
            if n.any():
                deep = _deep(keys[n > 0], n[n > 0], above)
                model = {name: np.concatenate([shallow[name], deep[name]]) for name in shallow}
            yield pa.RecordBatch.from_pydict({"key": keys, "times": times, "log": log_probabilities(keys, model)})

    return _by_subtree(counts).mapInArrow(second_pass, "key long, times long, log double")


def fit(counts: DataFrame) -> dict[str, np.ndarray]:
    """Scoring tables of a small input in memory: pair keys with log10 probabilities, context keys with log10 escape factors (sorted by key)."""
    shallow, above = _shallow(counts)
    found = counts.where("kind = 1").select("key", "n").toArrow().sort_by("key")
    if not found.num_rows:
        return shallow
    deep = _deep(found.column("key").to_numpy(), found.column("n").to_numpy(), above)
    return {name: np.concatenate([shallow[name], deep[name]]) for name in shallow}


def log_probabilities(keys: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each context key's last byte."""
    if not len(model["keys"]):
        return np.full(len(keys), -np.log10(256))
    out = np.zeros(len(keys))
    active = np.arange(len(keys))
    for d in range(DEPTH, -1, -1):
        k = keys[active]
        context = (k >> 8) >> (8 * (DEPTH - d)) if d else np.zeros(len(k), np.int64)
        pair = (d << 56) | (context << 8) | (k & 255)
        at = np.minimum(np.searchsorted(model["keys"], pair), len(model["keys"]) - 1)
        hit = model["keys"][at] == pair
        out[active[hit]] += model["logs"][at[hit]]
        active, context = active[~hit], context[~hit]
        if not len(active):
            break
        name = (d << 56) | context
        at = np.minimum(np.searchsorted(model["contexts"], name), len(model["contexts"]) - 1)
        seen = model["contexts"][at] == name
        out[active[seen]] += model["escapes"][at[seen]]
    return out


def score(docs: DataFrame, train: str = "true") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; learns from rows where ``train`` (SQL over doc_id) holds."""
    spark = docs.sparkSession
    ship(spark)
    docs = clean_documents(docs)
    counts = saved(gather(docs, train))
    tokens = counts.where("kind = 0")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = tokens.orderBy(F.col("n").desc(), "key").limit(COMMON).select("key", "n").toArrow().sort_by("key")
    found = saved(scored_keys(counts))
    # the smallest count at which at most HELD_KEYS keys are held
    step = F.floor(F.log2("times") * 8)
    least = total = 0
    for b, k in found.groupBy(step.alias("b")).count().orderBy(F.col("b").desc()).collect():
        total += k
        if total > HELD_KEYS:
            least = b + 1
            break
    held = found.where(step >= least).select("key", "log").toArrow().sort_by("key")
    model = spark.sparkContext.broadcast({"keys": held.column("key").to_numpy(), "logs": held.column("log").to_numpy(),
                                          "words": common.column("key").to_numpy(), "counts": common.column("n").to_numpy()})
    del held

    def looked_up(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(names):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        return at, names[at] == wanted

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value

        def listed(text: np.ndarray, number: np.ndarray, keys: np.ndarray, texts: int) -> pa.Array:
            """Each text's distinct keys with their counts; ``number`` is a place in ``keys``."""
            pair, times = np.unique(text * np.int64(max(len(keys), 1)) + number, return_counts=True)
            text, number = np.divmod(pair, max(len(keys), 1))
            pairs = pa.StructArray.from_arrays([pa.array(keys[number]), pa.array(times.astype(np.int32))], ["key", "times"])
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(texts + 1)).astype(np.int32)), pairs)

        for batch in batches:
            for part in pieces(batch):
                buf, at = text_bytes(part.column("text"))
                words = Words(buf, at)
                texts = part.num_rows
                ids = part.column("doc_id").to_numpy()
                token = np.concatenate([words.hash.view(np.int64), np.full(texts, _END_TOKEN)])
                text = np.concatenate([words.text, np.arange(texts)])
                sign = np.bincount(words.text, (words.hash >> np.uint64(34)).astype(float), texts).astype(np.int64)
                data, begins = stream(buf, words, texts)
                keys, where = np.unique(context_keys(data, begins), return_inverse=True)
                k, hit = looked_up(m["words"], token)
                c = np.where(hit, m["counts"][k] if len(m["counts"]) else 0, 0)
                q, has = looked_up(m["keys"], keys)
                logs = np.where(has, m["logs"][q] if len(m["logs"]) else 0.0, 0.0)[where]
                missing = ~has[where]
                rare, word_number = np.unique(token[~hit], return_inverse=True)
                of = np.repeat(np.arange(texts), np.diff(begins))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids, "sign": sign, "n_tokens": np.bincount(text, minlength=texts).astype(np.int64),
                    "known": np.bincount(text, hit, texts).astype(np.int64), "logs": np.bincount(text, np.log10(c + 1.0), texts),
                    "score": np.add.reduceat(logs, begins[:-1]),
                    "words": listed(text[~hit], word_number, rare, texts), "contexts": listed(of[missing], where[missing], keys, texts)})

    pairs = "array<struct<key:long,times:int>>"
    measured = saved(docs.mapInArrow(measure, f"doc_id long, sign long, n_tokens long, known long, logs double, score double, words {pairs}, contexts {pairs}"))
    scored = measured.drop("words", "contexts")

    def joined(column: str, values: DataFrame, found: str, logs: str) -> DataFrame:
        """Sums of a text over the keys that tasks don't hold."""
        total = F.sum(F.col("times") * F.col("value"))
        return (measured.select("doc_id", "sign", F.inline(column)).join(values, "key").groupBy("doc_id", "sign")
                .agg(F.expr(found).alias("more"), (total if logs == "more_logs" else F.lit(0.0)).alias("more_logs"),
                     (total if logs == "more_score" else F.lit(0.0)).alias("more_score")))

    seen = (joined("words", tokens.select("key", F.log10(F.col("n") + 1.0).alias("value")), "sum(times)", "more_logs")
            .union(joined("contexts", found.where(step < least).select("key", F.col("log").alias("value")), "0L", "more_score"))
            .groupBy("doc_id", "sign").agg(*[F.sum(c).alias(c) for c in ("more", "more_logs", "more_score")]))
    equal = scored.groupBy("doc_id", "sign").agg(F.count("*").alias("rows"))
    more = seen.join(equal, ["doc_id", "sign"]).select("doc_id", "sign", (F.col("more") / F.col("rows")).cast("long").alias("more"),
                                                       (F.col("more_logs") / F.col("rows")).alias("more_logs"), (F.col("more_score") / F.col("rows")).alias("more_score"))
    out = scored.join(more, ["doc_id", "sign"], "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
                      (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
