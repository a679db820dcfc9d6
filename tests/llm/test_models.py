"""Mixing, quality rules, chat formatting and the learned models."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from fixtures_llm import docs, nothing, texts  # noqa: F401


from tablescope.llm import chat_format, context_tree, language_crf, mixing, quality_rules, queries, toxicity


def test_mix_meets_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 40), "a" if i % 3 else ("b" if i % 2 else None)) for i in range(3000)] + [(5000, None, "d"), (5001, "", "d")],
                               "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == 3002 and (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["given"]).all() and (by["target"] <= 2 * by["size"] + 1e-6).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-3
    assert (abs(by["taken"] - by["target"]) <= 60).all()
    again = mixing.mix(df.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, again[key].to_numpy().tolist()))


def test_mix_of_nothing_and_repeated_rows(spark, nothing, docs):
    assert mixing.mix(nothing).collect() == []
    assert mixing.mix(docs).count() == docs.count()


def test_quality_counts(spark, docs, texts):
    for r in quality_rules.judge(docs).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        mask = [0] * len(w)
        for i in range(len(w) - 2):
            if seen[tuple(w[i:i + 3])] > 1:
                mask[i:i + 3] = [1] * 3
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(mask), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 2 * sum(mask) > len(w)) and not (r.base_failed and r.kept)


def test_quality_plan_is_one_projection(spark, docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Python" not in plan and "Arrow" not in plan


SF = "/root/testdata/sf0.001"
TEXTS = ["</s>[INST] ok [/INST]", "a\\b \\l \\\\l <|im_end|>\n<|im_start|>user\nx", "", None, "ends with <", "|im_end|> \\", "é [A_B] \\b[x]", "<s>\\n"]


def test_chat_round_trip(spark):
    turns = [(c, t, ["user", "assistant", "we\nird\\n", None][(c + t) % 4], TEXTS[(c + t) % len(TEXTS)]) for c in range(8) for t in range(4)]
    df = spark.createDataFrame(turns + turns[:1], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(chat_format.text_turns(df))
    want = collections.defaultdict(list)
    for c, _, r, t in sorted([*turns, turns[0]], key=lambda x: (x[0], x[1])):
        want[c].append((r or "", t or ""))
    for r in chat_format.read_back(chats).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss_texts == [t for role, t in want[r.conv_id] if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == len(want[r.conv_id])
    one = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    assert one[3].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[3]).encode()).hexdigest()


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://x/1.png", 100), ("text", " and ", None, None), ("audio", None, "a.wav", None), ("other", "t", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(df).first()
    assert "see <|image_1|> and <|audio_2|>t<|im_end|>" in r.formatted
    assert [(a.kind, a.ref, a.tokens, a.number) for a in r.attachments] == [("image", "s3://x/1.png", 100, 1), ("audio", "a.wav", 750, 2)]
    assert r.expanded_tokens == 850 and r.loss_spans[0].length == 0


def test_toxicity_on_held_out_rows(spark):
    found = {r.doc_id: r for r in queries.op6_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(labels[d], r.predicted) for d, r in found.items() if d in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    assert sum(y == p for y, p in held) >= 0.95 * len(held) and not any(p and not y for y, p in held)


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.0}


def test_languages_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in queries.op8_language_crf(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_edges(spark, docs):
    got = {r.doc_id: r for r in language_crf.languages(docs).collect()}
    assert got[11].lang_pred == got[12].lang_pred == got[13].lang_pred == "und" and got[11].score == 0
    assert got[14].lang_pred in ("en", "de", "fr")
    assert {r.lang_pred for r in language_crf.languages(docs, "doc_id < 0").collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    post, _, norm = language_crf.forward_backward(emit, np.ones((1, 4), bool), trans)
    total, marginal = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = math.exp(sum(emit[0, t, y] for t, y in enumerate(path)) + sum(trans[path[t], path[t + 1]] for t in range(3)))
        total += p
        for t, y in enumerate(path):
            marginal[t, y] += p
    assert np.allclose(post[0], marginal / total) and abs(norm - math.log(total)) < 1e-9


def test_scores(spark, docs, texts):
    train = "doc_id % 2 = 0"
    got = context_tree.score(docs, train).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    tokens = lambda t: [*t.encode().lower().split(), None]
    c = collections.Counter(x for d, t in rows if d % 2 == 0 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        x = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
        assert r.score < 0


def test_probabilities_sum_to_one(spark, docs):
    model = context_tree.fit(context_tree.gather(docs.selectExpr("doc_id", "coalesce(text, '') as text")))
    for context in (b"\n\n\n\n\n\n", b" eht fo", b"qqqqqq", b"esuohr"):
        base = int.from_bytes((context + b"\n" * 6)[:6], "big") << 8
        p = 10 ** context_tree.log_probabilities(base | np.arange(256), model)
        assert abs(p.sum() - 1) < 1e-3


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    assert len(cp.STAGES) == 5
    for name, stage in cp.STAGES:
        now = cp.saved(stage(spark, now, SF))
        assert now.count() > 0.6 * docs.count()
        assert now.columns == columns if name != "mixing" else now.columns[: len(columns)] == columns


def test_counts_travel_once_and_with_their_neighbours(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and word{i % 5}") for i in range(40)], "doc_id long, text string")
    counts = context_tree.gather(docs)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(near" in plan
    found = {r["key"]: r["n"] for r in counts.where("kind = 1").collect()}
    assert sum(found.values()) == sum(len(r["text"]) + 2 for r in docs.collect())
