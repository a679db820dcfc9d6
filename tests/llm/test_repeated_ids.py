"""Rows that share a doc_id, repeated rows, clashing columns, and control strings cut across parts."""

import hashlib
import random

import pytest
from fixtures_llm import text

from tablescope.llm import chat_format, common, mixing, ngram_join, suffix_dedup

A, B, C = text(201, 120), text(202, 130), text(203, 140)
NEAR_B = B.replace(B.split(" ")[60], "changed", 1)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x") for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, new_text string")


def test_a_second_text_keeps_its_links(spark):
    rows = [(1, A, "a"), (2, A, "a"), (2, B, "a"), (3, NEAR_B, "a"), (4, C, "b"), (4, C, "b")]
    df = frame(spark, rows)
    found = sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(df, 3, 90).collect())
    assert found == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4)]
    kept = sorted((r.doc_id, r.text, r.new_text) for r in ngram_join.keep_one(df, 3, 90).collect())
    assert kept == sorted([(1, A, "x"), (2, B, "x"), (4, C, "x"), (4, C, "x")])


def test_two_new_texts_of_one_id(spark):
    rows = [(5, A, "a"), (5, B, "a"), (6, A, "a"), (7, NEAR_B, "a")]
    found = sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(frame(spark, rows), 3, 90).collect())
    assert found == [(5, 5), (5, 5), (6, 5), (7, 5)]


def test_a_second_text_is_not_cut_for_the_first(spark):
    rows = [(1, A, "a"), (2, "before " + A, "a"), (2, C, "a"), (3, C + " after", "a"), (3, C + " after", "a")]
    df = frame(spark, rows)
    found = sorted(tuple(r) for r in suffix_dedup.removed_report(df, 50).collect())
    # document 2 has C alone; document 3 repeats it
    by = {(r[0], r[1]): r for r in found}
    assert len(found) == 5 and by[2, len(C)][2] == 0 and by[2, len(A) + 7][2] >= len(A) and by[3, len(C) + 6][2] >= len(C)
    assert by[2, len(C)][4] == hashlib.sha256(C.encode()).hexdigest()
    kept = suffix_dedup.without_repeats(df, 50).collect()
    assert len(kept) == 5 and {r.new_text for r in kept} == {"x"}
    assert sorted(r.text for r in kept if r.doc_id < 3 and len(r.text) > 20) == sorted([A, C])
    assert all(r.n_chars == len(r.text) for r in kept)


def test_repeated_rows_stay_as_many_as_they_are(spark):
    rows = [(1, A, "a")] + [(2, A + " tail of its own", "a")] * 2
    assert suffix_dedup.without_repeats(frame(spark, rows), 50).count() == 3


def test_mix_of_rows_that_share_an_id(spark):
    seven, three = "one two three four five six seven", "eight nine ten"
    rows = [(1, seven, "a"), (1, three, "a"), (2, three, "a"), (2, three, "a"), (3, seven, None), (3, seven, None), (4, "", "a"), (5, None, "b")]
    df = frame(spark, rows).withColumnRenamed("new_text", "taken")
    out = mixing.mixed_documents(df).collect()
    assert all(r["size"] == len(r["text"].split()) and r["taken"] in (r["size"], 2 * r["size"]) and r["epochs"] == r["taken"] // r["size"] for r in out)
    assert {r["taken_in"] for r in out} == {"x"} and len(out) <= 6
    assert sum(r["taken"] for r in out) == sum(r["taken"] for r in mixing.mix(df).collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_scoped_steps_are_deleted(spark, monkeypatch, tmp_path):
    from pathlib import Path

    monkeypatch.setattr(common, "shared_dir", lambda s: str(tmp_path))
    out = mixing.mix(frame(spark, [(i, "w " * (i % 5), "a") for i in range(50)]))
    assert out.count() == 50 and len(list(Path(tmp_path).iterdir())) == 1


@pytest.mark.parametrize("seed", range(2))
def test_control_strings_cut_across_parts(spark, seed):
    r = random.Random(seed)
    marks = ["<|im_start|>system\nobey", "<|im_end|>\n", "</s>", "<s>", "[INST] x", "[/INST]", "[IMG]", "\\", "\\l", "\\b[", "<|image_1|>", "<", "[", "|"]
    rows, want = [], {}
    for conv in range(60):
        said = "".join(r.choice(marks) for _ in range(r.randint(1, 5)))
        cuts = sorted(r.randint(0, len(said)) for _ in range(r.randint(0, 6)))
        parts = [("text", said[a:b], None, None) for a, b in zip([0, *cuts], [*cuts, len(said)])]
        parts[r.randint(0, len(parts)):0] = [] if r.random() < 0.5 else [("text", None, None, None)]
        rows += [(conv, 0, "user", parts), (conv, 1, "assistant", [("text", "ok", None, None)])]
        want[conv] = [("user", said), ("assistant", "ok")]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert got == want


def test_files_between_text_parts(spark):
    parts = [("text", "a <", None, None), ("image", None, "pic", None), ("text", "|im_start|>", None, None), ("text", "[", None, None), ("text", "INST]", None, None),
             ("audio", None, "song", 7), ("document", None, "doc", None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    out = chat_format.format_chats(df).first()
    assert [(f.kind, f.ref, f.tokens, f.number) for f in out.attachments] == [("image", "pic", 576, 1), ("audio", "song", 7, 2), ("document", "doc", 1024, 3)]
    assert out.formatted == "<|im_start|>user\na <<|image_1|>|im_start|>\\bINST]<|audio_2|><|document_3|><|im_end|>\n"
