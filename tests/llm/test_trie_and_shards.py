"""Prefix trie and sharding against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from tablescope.llm import histogram_sort, prefix_trie

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_conversations(rows):
    """conv_id -> rebuilt turns, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        out.add((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]), leaves[node], saved[node],
                 hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_nodes(frame):
    rows = [tuple(r) for r in frame.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows():
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of  {i % 7 if t < 3 else i % 11}") for i in range(130) for t in range(i % 6)]
    rows += [(i, t, "user", "copy of all") for i in range(200, 260) for t in range(3)]       # one hot conversation
    rows += [(i, t, "user", f"comb {t}") for i in range(300, 307) for t in range(i - 299)]         # each a beginning of the next
    rows += [(500, None, "user", "first"), (500, 0, None, None), (500, 0, None, ""), (500, 3, "a", "b"), (500, 3, "a", "b"), (None, 1, "x", "y"),
             (501, 1, "ab", "c"), (502, 1, "a", "bc"), (-3, 0, "user", "negative id"), (503, 0, "user", "w " * 5000)]
    return rows


@pytest.mark.parametrize("group_turns, id_range", [(5_000, 50_000), (1, 7)])
def test_trie_equals_brute_force(spark, group_turns, id_range):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, parent int")
    turns = prefix_trie.ordered_turns(frame)
    ids, rebuilt = prefix_trie.share_heads(turns, 20, 4)
    found = prefix_trie.prefix_trie(prefix_trie.conversation_paths(rebuilt, ids), group_turns, id_range)
    # SQL's remainder keeps the sign, which matters for the one negative id only
    want = brute_nodes({**brute_conversations([r for r in rows if r[0] is None or r[0] >= 0]),
                        -3: [("user", "negative id")][zlib.crc32(b"-3") % 4:]})
    assert found_nodes(found) == want


def test_trie_of_the_table(spark):
    from tablescope.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_nodes(QUERIES["op11_prefix_trie"](spark, SF)) == brute_nodes(brute_conversations(rows))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.ordered_turns(none)
    assert prefix_trie.prefix_trie(prefix_trie.conversation_paths(turns)).count() == 0


def check_shards(rows, docs, parts, spare):
    """Rows as a multiset, gapless slots, bytes within ``spare`` of even, shards contiguous over text hashes."""
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(parts))
    even = sum(r.size for r in rows) / parts
    assert all(abs(sum(x.size for x in by[i]) - even) <= spare + 0.02 * even for i in range(parts))
    return by


def test_shards_of_the_table(spark):
    from tablescope.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    frame = QUERIES["op13_histogram_sort"](spark, SF)
    rows = frame.collect()
    check_shards(rows, docs, 24, max(r.size for r in rows))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    again = QUERIES["op13_histogram_sort"](spark, SF).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_splitters_are_the_nearest_boundaries(spark):
    """Against the exact running sum of bytes over the sorted keys."""
    docs = [(i, f"text {i * i % 977} " * (1 + i % 13)) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    keys = histogram_sort.counted_keys(frame).cache()
    cuts = histogram_sort.find_splitters(keys, 9, tolerance=0, group_tolerance=0)
    rows = sorted((r.text_hash, r.id_hash, r.size) for r in keys.collect())
    total, below, places = sum(r[2] for r in rows), 0, []
    for t, i, size in rows:
        places.append(((t, i), below))
        below += size
    for n, cut in enumerate(cuts, 1):
        share = total * n / 9
        best = min(abs(b - share) for _, b in places)
        key = (cut.text_hash, cut.id_hash)
        at = next((b for k, b in places if k > key or k == key and not cut.copy), total)
        assert abs(at - share) == best


def test_hot_text_and_repeated_row(spark):
    docs = [(i, "the same text over and over") for i in range(2000)] + [(7, "one row, many times")] * 2000 + [(i, f"other {i} " * (i % 9)) for i in range(3000)]
    docs += [(None, None), (None, ""), (None, None), (9, "x" * 3000)]
    frame = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in docs], "doc_id long, text string, copies int, shard string, size int")
    rows = histogram_sort.shards(frame, 6, slice_rows=200).collect()
    by = check_shards(rows, docs, 6, 100)
    assert len({s for s, x in by.items() if any(r.doc_id == 7 and r.size == 27 for r in x)}) >= 2
    kept = histogram_sort.shard_documents(frame, 6).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.shard_in) for r in kept) == sorted((d or -1, t or "", "s") for d, t in docs)
    assert sorted(r.shard for r in kept) == sorted(r.shard for r in rows)
    small = [r for r in rows if r.size == len("other 5 " * 5) + 8]
    assert small


def test_equal_texts_stay_together(spark):
    docs = [(i, f"text {i // 5}, " * 7) for i in range(4000)]
    rows = histogram_sort.shards(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    at = defaultdict(set)
    for r in rows:
        at[docs[r.doc_id][1]].add(r.shard)
    assert max(map(len, at.values())) == 1


def test_written_shards(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    histogram_sort.write_shards(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert histogram_sort.shards(frame.limit(0)).count() == 0 and histogram_sort.shard_documents(frame.limit(0)).count() == 0
    assert sorted(r.slot for r in histogram_sort.shards(frame.limit(2), 24).collect()) == [0, 0]
