from __future__ import annotations

import collections
import hashlib
import random

import pytest
from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from cashloom.llm import near_dedup, substrings
from cashloom.llm.exact_dedup import block_names, exact_duplicates


def check_exact(rows, texts):
    groups = collections.defaultdict(list)
    for k, t in texts.items():
        groups[t or ""].append(k)
    got = {r.doc_id: r for r in rows}
    for k, t in texts.items():
        own = groups[t or ""]
        r = got[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), k == max(own), hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize(("block", "bits"), [(1024, 64), (3, 64), (3, 5), (16, 2)])
def test_exact(spark, block, bits):
    """Few bits make names collide at every level; identities must still be those of the texts."""
    rng = random.Random(block)
    texts = ODD | {100 + i: "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 7, 30]))) for i in range(120)}
    check_exact(exact_duplicates(docs(spark, texts), block, bits).collect(), texts)


def test_exact_edges(spark):
    assert exact_duplicates(docs(spark, ODD).limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string")
    got = sorted(map(tuple, exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, False)], key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_block_names_are_places_in_the_sorted_blocks(spark, bits):
    """Equal blocks have one name, different ones different names, and names follow the order of (code, bytes)."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = {i: "".join(rng.choice("abc") for _ in range(rng.choice([0, 2, 5, 11]))) for i in range(60)}
    rows, names = block_names(docs(spark, texts, clash=False), 2, bits)
    own = {r["_row"]: r["doc_id"] for r in rows.collect()}
    got = {(own[r["_row"]], r.pos): r.name for r in names.collect()}
    want = {(k, i): t[2 * i : 2 * i + 2].encode() for k, t in texts.items() for i in range(max(1, -(-len(t) // 2)))}
    assert got.keys() == want.keys()
    code = {r.b: r.c % (1 << bits) if bits < 64 else r.c for r in spark.createDataFrame([(bytearray(b),) for b in set(want.values())], "b binary").select("b", F.xxhash64("b").alias("c")).collect()}
    code = {bytes(b): c for b, c in code.items()}
    of = {b: {got[k] for k in got if want[k] == b} for b in code}
    assert all(len(v) == 1 for v in of.values())
    ranked = sorted(code, key=lambda b: (code[b], b))
    values = [min(of[b]) for b in ranked]
    assert values == sorted(values) and len(set(values)) == len(values)


def test_exact_long_and_repeated(spark):
    """Texts of a megabyte that differ in the last byte, and rows that repeat a doc_id with other texts."""
    long = "word " * 250_000
    check_exact(exact_duplicates(docs(spark, {1: long, 2: long + "x", 3: long, 4: long + "y"}, clash=False)).collect(), {1: long, 2: long + "x", 3: long, 4: long + "y"})
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id bigint, text string")
    got = sorted(map(tuple, exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == [(1, 1, 1, True), (1, 2, 2, False), (2, 2, 2, True)]


def test_exact_hot_group(spark):
    texts = {i: "hot" if i % 3 else f"cold {i}" for i in range(900)}
    check_exact(exact_duplicates(docs(spark, texts, clash=False)).collect(), texts)


def brute_near(texts, words, percent):
    sets = {}
    for k, t in texts.items():
        w = near_dedup.normalised((t or "").encode()).split()
        sets[k] = {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in texts}


def near_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 250]))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 15])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[k] = " ".join(own)
            k += 1
    for _ in range(40):
        texts[k] = " ".join(rng.choice(vocabulary) for _ in range(80))
        k += 1
    return texts


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near(spark, words, percent):
    texts = near_texts() | {1000 + k: v for k, v in ODD.items()}
    want = brute_near(texts, words, percent)
    for r in near_dedup.near_duplicates(docs(spark, texts), words, percent).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_near_pairs_of_a_hot_shingle(spark, monkeypatch, percent):
    """One shingle in all nodes, dealt into small blocks: the same pairs as by hand, and no key beyond a block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(percent)
    rows = [(s, k, n, rng.randrange(n), k % 7) for k in range(60) for n in [2 ** rng.randrange(1, 9) + rng.randrange(3)] for s in (1, 2 + k % 3)]
    heads = [r for r in rows if r[1] % 4 == 0]

    def overlap(n, m):
        return -(-(n + m) * percent // (100 + percent))

    for others in (rows, heads):
        want = {
            (max(a, b), min(a, b))
            for s, a, n, p, c in rows
            for z, b, m, q, d in others
            if s == z and c != d and min(n, m) * 100 >= max(n, m) * percent and p <= n - overlap(n, m) and q <= m - overlap(n, m)
        }
        one, other = (spark.createDataFrame(x, "shingle bigint, node bigint, n bigint, place int, component bigint") for x in (rows, others))
        got = [tuple(r) for r in near_dedup._sharing(one, other, percent).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_in_small_blocks(spark, monkeypatch):
    """Nodes with many pairs and shingles with many nodes are dealt over several keys; nothing changes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "NODE_PAIRS", 2)
    rng = random.Random(5)
    passages = [" ".join(f"p{j}x{i}" for i in range(40)) for j in range(9)]
    texts = near_texts(3) | {2000 + k: " ".join(rng.sample(passages, 5)) for k in range(40)}
    want = brute_near(texts, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts), 5, 80).collect()} == want


def test_near_edges(spark):
    assert near_dedup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "A b  c D"), (7, "a b c d"), (8, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(df, 3, 85).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (7, 5, False), (8, 8, True)], key=str)


@settings(max_examples=100, deadline=None)
@given(st.text("aAbé \t\n\x0b\x0c\r\x1c ", max_size=40), st.integers(1, 4))
def test_shingle_sets(text, words):
    w = text.encode()
    import re

    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), w))
    want = {tuple(found)} if 0 < len(found) < words else {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}
    assert len(near_dedup.shingles(near_dedup.normalised(w), words)) == len(want)


def brute_removed(texts, length):
    starts = collections.Counter()
    data = {k: (t or "").encode() for k, t in texts.items()}
    for d in data.values():
        starts.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out[k] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed=5):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    common, texts = noise(70), {}
    for k in range(60):
        t = noise(rng.choice([0, 5, 30, 60]))
        if k % 2:
            t += common[rng.randrange(12) : 70 - rng.randrange(12)] + noise(rng.choice([0, 1, 40]))
        if k % 7 == 0:
            t += t[-45:]
        texts[k] = t
    texts |= {100: "a" * 200, 101: "ab" * 90, 102: texts[3], 103: texts[3], 104: "é" * 60, 105: "é" * 30}
    return texts


@pytest.mark.parametrize(("length", "gram", "group"), [(40, 12, 4096), (40, 40, 4096), (24, 8, 2), (40, 12, 5)])
def test_repeats(spark, length, gram, group):
    texts = passages() | {1000 + k: v for k, v in ODD.items()}
    want = brute_removed(texts, length)
    df = docs(spark, texts)
    kept = {r.doc_id: bytes(r.kept) for r in substrings.without_repeats(df, length, gram, group).collect()}
    rows = substrings.repeated_substrings(df, length, gram, group).collect()
    assert len(rows) == len(kept) == len(texts)
    for r in rows:
        data, sha = (texts[r.doc_id] or "").encode(), hashlib.sha256(kept[r.doc_id]).hexdigest()
        assert (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), sha) == want[r.doc_id], r.doc_id
        assert (r.kept_sha256, r.text_sha256) == (sha, hashlib.sha256(data).hexdigest())
        gone = {i for x in r.spans for i in range(x.start, x.end)}
        assert bytes(c for i, c in enumerate(data) if i not in gone) == kept[r.doc_id]


def brute_maximal(texts, length):
    """Each maximal repeat of the different texts with all places (text, start) where it stands."""
    data = sorted({(t or "").encode() for t in texts})
    at = collections.defaultdict(list)
    for k, d in enumerate(data):
        for i in range(len(d) - length + 1):
            at[d[i : i + length]].append((k, i))
    strings = set()
    for places in at.values():
        for n, (k, i) in enumerate(places):
            for m, j in places[:n]:
                a, b = data[k], data[m]
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                strings.add(a[i : i + substrings.common_prefix(a[i:], b[j:])])
    out = {}
    for x in strings:
        out[x] = {(data[k], i) for k, i in at[x[:length]] if data[k][i : i + len(x)] == x}
    return out


@pytest.mark.parametrize(("length", "gram", "group", "around"), [(40, 12, 4096, 300), (24, 8, 4096, 300), (40, 12, 4096, 8), (40, 12, 5, 300)])
def test_maximal_repeats(spark, length, gram, group, around):
    """All maximal repeats with all of their occurrences; what is longer than the contexts comes in pieces."""
    texts = passages() | {1000 + k: v for k, v in ODD.items() if k not in (7, 8, 9)}
    want = brute_maximal(texts.values(), length)
    got, whole, copies = collections.defaultdict(set), set(), collections.Counter(t or "" for t in texts.values())
    names = {}
    for r in substrings.maximal_repeats(docs(spark, texts), length, gram, group, around).collect():
        text = texts[r.doc_id] or ""
        assert r.copies == copies[text] and r.doc_id == min(k for k, t in texts.items() if (t or "") == text)
        x = text.encode()[r.start : r.start + r.n_bytes]
        assert len(x) == r.n_bytes >= length and names.setdefault(r.repeat, x) == x
        place = (text.encode(), r.start)
        assert place not in got[x]
        got[x].add(place)
        if r.whole:
            whole.add(x)
    assert whole <= set(want) and len(set(names.values())) == len(names)
    for x, places in got.items():
        assert places == {(d, i) for d in {t.encode() for t in copies} for i in range(len(d)) if d.startswith(x, i)}
    if group == 4096:
        assert {x for x in want if len(x) <= length + around} == {x for x in whole if len(x) <= length + around}
    covered = lambda found: {(d, i + k) for x, places in found.items() for d, i in places for k in range(len(x))}
    assert covered(got) == covered(want)


def test_repeats_edges(spark):
    for operator in (substrings.repeated_substrings, substrings.without_repeats, substrings.maximal_repeats):
        assert operator(docs(spark, ODD).limit(0)).count() == 0
    df = spark.createDataFrame([(1, "x" * 50), (1, "x" * 50), (None, "y" * 30 + "z"), (None, "q")], "doc_id bigint, text string")
    got = [(r.doc_id, sum(x.end - x.start for x in r.spans)) for r in substrings.repeated_substrings(df, 40, 12).collect()]
    assert sorted(got, key=str) == sorted([(1, 50), (1, 50), (None, 0), (None, 0)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=8), st.text("ab", max_size=8)), min_size=2, max_size=8))
def test_interval_tree_gives_all_occurrences(pairs):
    """The groups are the strings around X that differ on both sides, each with all contexts that hold it."""
    contexts = sorted({((a + "X" + b).encode(), len(a)) for a, b in pairs})
    want = {}
    for i, (c, p) in enumerate(contexts):
        for d, q in contexts[:i]:
            left, right = substrings.common_prefix(c[:p][::-1], d[:q][::-1]), substrings.common_prefix(c[p:], d[q:])
            want[left, c[p - left : p + right]] = {m for m, (e, r) in enumerate(contexts) if r >= left and e[r - left :].startswith(c[p - left : p + right])}
    got = {}
    for left, depth, members in substrings.repeat_groups(contexts, 1, 1):
        c, p = contexts[members[0]]
        assert (left, c[p - left : p + depth]) not in got
        got[left, c[p - left : p + depth]] = set(members)
    assert got == want


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(0)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = substrings.anchors(data, 100, 30)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    parts = substrings.anchors(data, 100, 30)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
