"""The near-duplicate join, components, order MinHash and tool calls against brute force."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenweft.llm import near_join, order_minhash, tool_calls
from tokenweft.llm.components import components


def shingles(text):
    w = (text or "").encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def classes_by_hand(rows):
    sets = [shingles(t) for _, t, _ in rows]
    unique = list(dict.fromkeys(sets))
    links, parent = dict.fromkeys(unique, 0), list(range(len(unique)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(unique)):
        for b in range(a):
            union = len(unique[a] | unique[b])
            if union and len(unique[a] & unique[b]) / union >= 0.8:
                links[unique[a]] += 1
                links[unique[b]] += 1
                parent[find(a)] = find(b)
    at, members = {s: i for i, s in enumerate(unique)}, {}
    for (i, _, _), s in zip(rows, sets, strict=True):
        members.setdefault(find(at[s]), []).append(i)
    out = []
    for (i, _, _), s in zip(rows, sets, strict=True):
        m = members[find(at[s])]
        ids = [x for x in m if x is not None]
        out.append((i, min(ids) if ids else None, links[s], sum(x == s for x in sets), len(m)))
    return out


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r))


def join_rows(df):
    return ordered((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"], r["class_size"]) for r in near_join.near_join(df).collect())


def test_join_on_edge_cases(docs, rows, nothing):
    assert join_rows(docs) == ordered(classes_by_hand(rows))
    assert near_join.near_join(nothing).count() == 0


def test_join_of_large_groups(spark, monkeypatch):
    """Buckets and components far over their limits: a group of near copies, and a passage that many unlike texts share."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base, passage = rng.sample(words, 60), rng.sample(words, 12)
    rows = []
    for i in range(70):
        w = list(base)
        w[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(w), None))
    rows += [(100 + i, " ".join([*rng.choices(words, k=rng.randint(5, 80)), *passage]), None) for i in range(50)]
    monkeypatch.setattr(near_join, "LIMIT", 15)
    monkeypatch.setattr(near_join, "BLOCK", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert join_rows(df) == ordered(classes_by_hand(rows))


def test_long_near_copies_are_compared_in_ranges(spark, monkeypatch):
    """No task holds all shingles of a unit of long sets, in one block and in several, and every link is still counted."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    base, rows = rng.choices(words, k=1500), []
    for i in range(30):
        w = list(base)
        for _ in range(rng.randrange(1, 40)):
            w[rng.randrange(1500)] = rng.choice(words)
        rows.append((i, " ".join(w), None))
    rows += [(100, rows[3][1], None), (3, rows[3][1], None), (101, "short", None), (102, "short", None)]
    df, dealt, mapped = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), [], near_join.mapped

    def seen(rows, f, schema):
        dealt.extend([rows] if {"unit", "found"} <= {*rows.columns} else [])
        return mapped(rows, f, schema)

    monkeypatch.setattr(near_join, "SPAN", 2000, raising=False)
    monkeypatch.setattr(near_join, "mapped", seen)
    for block in (800, 12):
        monkeypatch.setattr(near_join, "BLOCK", block)
        assert join_rows(df) == ordered(classes_by_hand(rows))
        parts = dealt.pop()
        held = parts.groupBy([c for c in parts.columns if c in ("unit", "part")]).agg(F.sum(F.length("found")).alias("bytes"))
        assert held.agg(F.max("bytes")).first()[0] < 2 * 8 * 2000


def fringe_rows(group, pairs):
    """A group of near copies; texts a little like it, each with a near copy that is not like the group."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base, rows = rng.sample(words, 100), []
    for i in range(group):
        w = list(base)
        w[rng.randrange(100)] = rng.choice(words)
        rows.append((i, " ".join(w), None))
    for i in range(pairs):
        w = [*base[:80], *(f"t{i}x{k}" for k in range(18))]
        rows.append((10_000 + i, " ".join(w), None))
        rows.append((20_000 + i, " ".join([*(f"h{i}x{k}" for k in range(10)), *w[10:]]), None))
    return rows


def test_join_at_the_fringe_of_a_large_group(spark, monkeypatch):
    """Both texts of a pair must be compared, though a bucket over the limit joins only one of them to its group."""
    rows = fringe_rows(150, 60)
    monkeypatch.setattr(near_join, "LIMIT", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert join_rows(df) == ordered(classes_by_hand(rows))


def test_runs_follow_the_recall():
    assert near_join.n_runs(0.8, 0.99999) == 8 and near_join.n_runs(0.5, 0.9) == 4
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.concatenate([a[:350], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_join.embed(a) == near_join.embed(b)).mean() - want) < 0.15


def test_recall_includes_the_cut_and_all_splits():
    need, runs = near_join.cut(0.8, 0.99999), near_join.n_runs(0.8, 0.99999)
    short = sum(math.comb(128, k) * 0.8**k * 0.2 ** (128 - k) for k in range(need))
    lost = (0.2 + 0.8 * (1 - (1 - 0.2**near_join.CHILDREN) ** near_join.n_levels(runs))) ** runs
    assert 0 < short and short + lost <= 1e-5


def test_splits_of_runs_use_their_own_coordinates():
    runs = near_join.n_runs()
    sig = np.tile(np.arange(128, dtype="<u2"), (2, 1))
    used = []
    for at in range(128):
        sig[1] = sig[0]
        sig[1, at] = 999
        parts = 0
        for r in range(runs):
            for depth in range(near_join.n_levels(runs)):
                batch = pa.record_batch({"path": pa.array([1280 + r] * 2, pa.int64()), "rep": pa.array([1, 2]), "sig": pa.array([s.tobytes() for s in sig])})
                out = next(near_join._children(depth, runs)(iter([batch]))).to_pydict()
                parts += len(set(out["path"])) - near_join.CHILDREN
        used.append(parts)
    assert used == [0] * runs + [1] * (128 - runs)


def test_keep_one(spark, docs, rows, nothing):
    kept = near_join.keep_one(docs, near_join.classes(docs))
    assert kept.columns == docs.columns
    groups = {}
    for (i, text, _), (_, c, _, _, size) in zip(rows, classes_by_hand(rows), strict=True):
        groups.setdefault((c, size), []).append((i, text))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(groups) == len(near_join.classes(docs).select("root").distinct().collect())
    assert sorted(i for i, _ in got if i is not None) == sorted(c for c, _ in groups if c is not None)
    assert near_join.keep_one(nothing, near_join.classes(nothing)).count() == 0


def test_keep_one_where_an_id_is_in_two_classes(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a, 1), (7, a, 2), (3, b, 3), (5, b, 4), (None, "alone without an id here", 5), (None, a, 6), (9, "twice the same row", 7), (9, "twice the same row", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(3)
    got = near_join.keep_one(df, near_join.classes(df)).collect()
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"]) for r in got) == [(-1, rows[4][1]), (3, b), (5, a), (9, rows[6][1])]


def test_only_texts_that_may_go_are_shuffled(spark, docs, rows, monkeypatch):
    text = "one row of two has this very text and stays or goes with it"
    df = spark.createDataFrame([(i, text if i in (1, 2) else f"{i} " * 9) for i in range(50)], "doc_id long, text string")
    some, others = near_join.parted(df, near_join.text_hash("text"), df.where("doc_id = 1").select(near_join.text_hash("text")))
    assert sorted(r["doc_id"] for r in some.collect()) == [1, 2] and others.count() == 48
    found = near_join.classes(docs)
    both = []
    for most in (4_000_000, 0):  # the keys travel; there are too many
        monkeypatch.setattr("tokenweft.llm._common.SHIPPED", most)
        both.append(sorted(map(repr, near_join.keep_one(docs, found).select("doc_id", "text").collect())))
        assert near_join.parted(df, near_join.text_hash("text"), df.select(near_join.text_hash("text")))[1] is None or most
        assert sorted(map(repr, near_join.classes(docs).drop("root").collect())) == sorted(map(repr, found.drop("root").collect()))
    assert both[0] == both[1]


def test_components_with_hubs(spark, monkeypatch):
    """A hub goes another way than other nodes; the roots are the same."""
    import importlib

    monkeypatch.setattr(importlib.import_module("tokenweft.llm.components"), "HUBS", 3)
    edges = [(0 if i % 2 else 5000, i + 10) for i in range(4000)] + [(17, 18), (9001, 9002)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: (9001 if x > 9000 else 0) for e in edges for x in e}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_order_minhash(spark, docs, rows, nothing):
    got = order_minhash.fingerprints(docs).collect()
    order = sorted(((i, t or "") for i, t, _ in rows if i is not None and i != 10), reverse=True)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] != 10}
    for (i, t), (j, n) in zip(order, order[1:], strict=False):
        if j in (9,) or i == 0:  # the neighbours of the repeated id and of the rows without one
            continue
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        r = by_id[i]
        if i != 11:
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    texts = dict(order)
    prints = {}
    for i, r in by_id.items():
        prints.setdefault(texts[i], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert by_id[80]["fingerprint"] == by_id[81]["fingerprint"] == by_id[82]["fingerprint"] == "-" * 8 * order_minhash.M
    assert len(got) == len(rows) and order_minhash.fingerprints(nothing).count() == 0


def test_fingerprint_is_its_own_edit(spark):
    """The edited text's fingerprint, made from shared rows, is that of the edited text as a document."""
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "gh"]  # few words: many repeats, so occurrence numbers matter
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) + rng.choice(["", " ", "\n"]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in order_minhash.fingerprints(df).collect()}
    edits = []
    for i, t in enumerate(texts):
        cut, following = len(t) // 3, texts[i - 1]
        edits.append((i, t[: len(t) - cut] + following[:cut]))
    again = {r["doc_id"]: r for r in order_minhash.fingerprints(spark.createDataFrame(edits, "doc_id long, text string")).collect()}
    assert all(got[i]["edited_fingerprint"] == again[i]["fingerprint"] for i in got)
    assert np.mean([got[i]["near_edited"] > got[i]["near_next"] for i in got]) > 0.5


def hash64(values, seed=42):
    """The engine's hash of several values, by the public algorithm: each value's bytes, seeded by the hash so far."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True) if abs(v) < 1 << 20 else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def fingerprint_by_hand(text):
    """Every selection looks at all k-mers."""
    dense = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
    tokens = []
    for run in re.findall(f"[{dense}]|[^ \t\n\x0b\f\r{dense}]+", text):  # of a run over 24 its last 24 characters are one token
        tokens += [run] if len(run) <= 24 else [*run[:-24], run[-24:]]
    kmers = [hash64(tokens[i : i + 2]) for i in range(max(len(tokens) - 1, min(len(tokens), 1)))]
    if not kmers:
        return "-" * 256
    low, points, seen = (1 << len(kmers).bit_length()) - 1, [], {}
    for i, h in enumerate(kmers):
        points.append(hash64([h, seen.get(h, 0)]) & ~low | i)
        seen[h] = seen.get(h, 0) + 1
    out = []
    for turn in order_minhash.POINTS:
        chosen = sorted(sorted(range(len(kmers)), key=lambda i: (points[i] - turn) % (1 << 64))[:2])
        out.append(f"{hash64([len(chosen), *(kmers[i] for i in chosen)]) & 0xFFFFFFFF:08x}")
    return "".join(out)


def test_order_minhash_by_brute_force(spark):
    rng = random.Random(6)
    texts = ["", " \n ", "one", "one two", "a b a b a b a b a b c", "x" * 24, "x" * 25, "x" * 80 + " y", "中文字文字 mixed 中文", "ภาษาไทย ok", " lead and\ttrail \r\n"]
    texts += [" ".join(rng.choices(["ab", "cd", "ef", "ghé"], k=rng.randint(1, 90))) for _ in range(25)]
    texts += ["".join(rng.choice("的一是不了人我在有他") for _ in range(rng.randint(1, 60))) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in order_minhash.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        following = texts[i - 1]
        cut = len(t) // 3
        want, edit, behind = fingerprint_by_hand(t), fingerprint_by_hand(t[: len(t) - cut] + following[:cut]), fingerprint_by_hand(following)
        assert got[i]["fingerprint"] == want and got[i]["edited_fingerprint"] == edit, t
        for name, other in (("near_edited", edit), ("near_next", behind)):
            parts = [(want[j : j + 8], other[j : j + 8]) for j in range(0, 256, 8)]
            some = [p for p in parts if set(p) != {"--------"}]
            assert got[i][name] == pytest.approx(sum(a == b for a, b in some) / len(some) if some else 1.0), t


def test_texts_without_blanks_follow_their_edits(spark):
    rng = random.Random(2)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600))
    run = "".join(rng.choice("abcdefgh") for _ in range(600))
    for text in (han, run):
        near = []
        for edits in (1, 20, 200):
            other = list(text)
            for i in rng.sample(range(600), edits):
                other[i] = "異" if text is han else "z"
            other.insert(5, "字" if text is han else "y")
            df = spark.createDataFrame([(1, "".join(other)), (2, text)], "doc_id long, text string")
            near.append(order_minhash.fingerprints(df).where("doc_id = 2").first()["near_next"])
        assert near[0] > 0.85 and near[0] > near[1] > near[2] and near[2] < 0.5


def test_hot_ids_are_dealt_by_hash_in_order(spark, monkeypatch):
    """Rows without an id and rows of one id go to many buckets, and the next document is the same."""
    rows = [(None if i % 3 else (7 if i % 2 else i), f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = order_minhash.with_next(order_minhash.bucket_and_place(df, rows_per_bucket=20), ["text"]).collect()
    order = sorted(placed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), hash64([r["text"]])))
    assert [r["next_text"] for r in order] == [r["text"] for r in [*order[1:], order[0]]]
    sizes = {}
    for r in placed:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
    assert max(sizes.values()) < 60


def test_order_matters(spark):
    words = [f"word{i}" for i in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[200:] + words[:200]))], "doc_id long, text string")
    moved = order_minhash.fingerprints(df).where("doc_id = 2").first()["near_next"]
    assert 0.2 < moved < 0.85  # nearly all k-mers are shared, but their order is not


CALLS = "conv_id long, turn long, call_id string, parent_id string, tool string, arguments string, level int"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"


def test_tool_calls(spark):
    good = '{"q": "x",  "n": 3}'
    calls = [
        (1, 5, "c", "b", "find", '{"n":1,"q":"a"}', 0), (1, 1, "a", None, "find", good, 0), (1, 3, "b", "a", "find", '{"q": 5, "z": 1}', 0),
        (1, 9, "a", None, "find", good, 0), (1, 2, None, None, "find", good, 0), (2, 1, "x", "y", "find", good, 0), (2, 2, "y", "x", "find", good, 0),
        (2, 3, "z", "x", "find", good, 0), (3, 1, "a", "gone", "other", "[1]", 0), (3, 2, "b", None, "other", "{}", 0), (4, 1, "m", None, "find", None, 0), (4, 2, "k", None, "find", '{"q": "far too long a text"}', 0),
    ]
    results = [(1, 2, "a", "first", "s"), (1, 4, "a", "second", "s"), (1, 4, "b", None, "s"), (7, 1, "a", "nobody asked", "s"), (1, 8, None, "no id", "s")]
    schemas = [("find", ["q"], {"q": "string", "n": "integer"}, {"q": 10}, False)]
    got = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(schemas, tool_calls.SCHEMA)).collect()
    by = {(r["conv_id"], r["call_id"], r["call_turn"]): r for r in got}
    assert len(got) == len(calls) + 2
    assert [by[1, c, t]["level"] for c, t in (("a", 1), ("b", 3), ("c", 5))] == [0, 1, 2]
    assert by[1, "a", 1]["status"] == "linked" and by[1, "a", 1]["n_results"] == 2 and by[1, "a", 1]["result_turn"] == 2
    assert by[1, "a", 9]["status"] == "duplicate_id" and by[1, "c", 5]["status"] == "unanswered" and by[1, None, 2]["status"] == "unanswered"
    assert by[1, "b", 3]["reasons"] == "type:q,unexpected:z" and not by[1, "b", 3]["valid"] and by[1, "a", 1]["valid"]
    assert {by[2, c, t]["status"] for c, t in (("x", 1), ("y", 2), ("z", 3))} == {"cycle"} and by[2, "x", 1]["level"] is None
    assert by[3, "a", 1]["reasons"] == "not_an_object" and by[3, "a", 1]["level"] == 0 and by[3, "b", 2]["reasons"] == "unknown_tool"
    assert by[4, "m", 1]["reasons"] == "not_an_object" and by[4, "k", 2]["reasons"] == "too_long:q"
    assert by[7, "a", None]["status"] == "orphan_result" and by[7, "a", None]["valid"] is None
    c = by[1, "a", 1]["canonical"]
    assert c == json.dumps({"arguments": {"n": 3, "q": "x"}, "id": "a", "name": "find", "parent": None, "result": "first"}, separators=(",", ":"), sort_keys=True)
    for conv in {r["conv_id"] for r in got}:
        assert sorted(r["position"] for r in got if r["conv_id"] == conv) == list(range(1, 1 + sum(r["conv_id"] == conv for r in got)))


def test_long_chain_and_empty_tables(spark):
    n = 70
    calls = spark.createDataFrame([(1, i, f"c{i}", f"c{i - 1}" if i else None, "find", "{}", 0) for i in range(n)], CALLS)
    nothing = spark.createDataFrame([], RESULTS)
    schemas = spark.createDataFrame([], tool_calls.SCHEMA)
    got = tool_calls.link(calls, nothing, schemas).collect()
    assert {r["call_id"]: r["level"] for r in got} == {f"c{i}": i for i in range(n)}
    assert tool_calls.link(calls.limit(0), nothing, schemas).count() == 0


@pytest.mark.parametrize("rows_", [[], [(1, 0, "user", None), (1, 1, "assistant", "x"), (None, None, None, None)]])
def test_conversations(spark, rows_):
    turns = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    got = tool_calls.link(*tool_calls.from_conversations(turns), tool_calls.conversation_schemas(spark)).collect()
    assert [r["status"] for r in got] == ["linked"] * (len(rows_) > 0)


def test_conversations_keep_every_role(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "tool", "x"), (1, 3, "User", "y"), (1, 4, None, "z"), (1, 5, "assistant", "b"), (None, None, None, "w")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.link(*tool_calls.from_conversations(turns), tool_calls.conversation_schemas(spark)).collect()
    by = {(r["conv_id"], r["call_turn"]): (r["tool"], r["status"], r["reasons"]) for r in got}
    assert len(got) == len(by) == 5 and by[1, 0] == ("reply", "linked", "")
    assert by[1, 2] == ("role:tool", "unanswered", "unknown_tool") and by[1, 3] == ("role:User", "unanswered", "unknown_tool")
    assert by[1, 4] == (None, "linked", "unknown_tool") and by[None, None] == (None, "unanswered", "unknown_tool")
