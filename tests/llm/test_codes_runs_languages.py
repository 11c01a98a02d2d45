"""Operators 11, 12 and 13 against brute force, over made rows and the driver's tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import ODD, docs

from cashloom.llm import language, periodic, vector_codes
from cashloom.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int"


# -- vector codes


def by_hand(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[dict, list]:
    kept = {i: [math.floor(4096 * x) for x in v] for i, v in rows}
    m = len(next(iter(kept.values()))) // parts
    books = [[kept[i][p * m : (p + 1) * m] for i in sorted(kept)[:entries]] for p in range(parts)]

    def near(v, p):
        own = v[p * m : (p + 1) * m]
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for v in kept.values():
            for p in range(parts):
                groups[p, near(v, p)[1]].append(v[p * m : (p + 1) * m])
        for (p, j), g in groups.items():
            books[p][j] = [math.floor(sum(c) / len(g)) if abs(sum(c)) < 2**50 else sum(c) // len(g) for c in zip(*g)]
    out = {}
    for i, v in kept.items():
        d = [near(v, p) for p in range(parts)]
        out[i] = ("".join(f"{j:02x}" for _, j in d), sum(x for x, _ in d))
    return out, books


@pytest.mark.parametrize("scale", [1.0, 15_000.0])
def test_codes_agree_with_integers_of_any_size(spark, scale):
    rng = random.Random(3)
    rows = [(i * 7 % 101, [rng.choice([rng.gauss(0, 1) * scale, float(rng.randint(-2, 2))]) for _ in range(16)]) for i in range(101)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    odd = [(200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [math.nan] + [0.0] * 15, 2), (203, [math.inf] * 16, None)]
    df = spark.createDataFrame([(i, v, None if i % 5 == 0 else i % 3) for i, v in rows] + odd, VECTORS).repartition(5)
    codes, books = vector_codes.compressed(df)
    want, want_books = by_hand(rows, 8, 16, 6)
    got = {r.vec_id: r for r in codes.collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == want and books.tolist() == want_books
    total = Counter()
    for i, r in got.items():
        total[r.label] += r.error
    assert all(r.label_error == total[r.label] for r in got.values())


def test_ties_go_to_the_lower_entry_and_intervals_hold():
    rng = np.random.default_rng(5)
    for top in (3, 5000, 100_000_000):
        values, books = rng.integers(-top, top + 1, (400, 8, 4)), rng.integers(-top, top + 1, (8, 16, 4))
        books[:, 9] = books[:, 2]
        values[:50] = books[:, 9] + rng.integers(-1, 2, (50, 8, 4))
        exact = ((values[:, :, None] - books[None]) ** 2).sum(axis=3)
        assert (vector_codes.nearest(values, books) == exact.argmin(axis=2)).all()


def test_codes_of_few_no_and_repeated_rows(spark):
    empty, books = vector_codes.compressed(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and books.size == 0
    rows = [(4, [0.5] * 8, None), (4, [0.5] * 8, None), (1, [0.25] * 8, 3), (None, [0.5] * 8, 3)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit("x").alias(c) for c in ("code", "error", "values", "_key", "_rows", "n", "part")])
    got = vector_codes.compressed(df)[0].collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got) == [(0, "01" * 8, 0), (1, "00" * 8, 0), (4, "01" * 8, 0), (4, "01" * 8, 0)]
    for bad in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compressed(spark.createDataFrame(bad, VECTORS))


def test_a_label_with_most_rows(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), j -> CAST((id * j) % 17 / 16 AS float)) AS embedding", "CAST(IF(id % 50 = 0, id, NULL) AS int) AS label")
    got = vector_codes.compressed(df)[0].toPandas()
    total = got.groupby("label", dropna=False)["error"].transform("sum")
    assert len(got) == 3000 and (got["label_error"] == total).all()


# -- periodic runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def runs_by_hand(words: list) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed_by_hand(words: list, runs: list) -> bytes:
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def loop_by_hand(doc_id: int, text: str) -> list[bytes]:
    words = WORD.findall(text.encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_scan_finds_all_runs_of_random_words():
    rng = random.Random(11)
    for trial in range(400):
        words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 20)
            words[at:at] = ([rng.randrange(40) for _ in range(p)] * 6)[: rng.randrange(6 * p)]
        ids = periodic.word_ids([b"%d" % w for w in words])
        want = runs_by_hand(words)
        assert sorted(map(tuple, periodic.scan(ids, 1, len(ids) // 2).tolist())) == want
        cut = [periodic.scan(ids, a, b) for a, b in ((1, len(ids) // 5), (len(ids) // 5 + 1, len(ids) // 2))]
        assert sorted(map(tuple, periodic.distinct(np.concatenate(cut)).tolist())) == want


def test_lag_ranges_cover_every_lag_once(monkeypatch):
    monkeypatch.setattr(periodic, "RANGE_WORK", 50)
    for n in (0, 1, 2, 3, 12, 57, 400, 5000):
        lags = [q for a, b in periodic.lag_ranges(n) for q in range(a, b + 1)]
        assert lags == list(range(1, n // 2 + 1))
    assert len(periodic.lag_ranges(5000)) > 50


def test_long_texts_in_ranges_agree_with_short_ones(spark, monkeypatch):
    rng = random.Random(2)
    texts = dict(ODD)
    for k in range(30, 50):
        phrase = " ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40)))
        texts[k] = "\n".join([phrase] * rng.randrange(1, 9)) + " end"
    texts[60] = "x " * 9000 + " y z" * 2000
    table = docs(spark, texts)
    got = []
    for long_bytes in (periodic.LONG_BYTES, 0):
        rows = periodic.periodic_runs(table, long_bytes).collect()
        got.append({r.doc_id: ([tuple(x) for x in r.runs], r.n_words, r.collapsed) for r in rows})
        assert len(rows) == len(texts)
    assert got[0] == got[1]
    for k, text in texts.items():
        words = WORD.findall((text or "").encode())
        if len(words) < 3000:
            runs = runs_by_hand(words)
            assert got[0][k] == (runs, len(words), collapsed_by_hand(words, runs).decode())
    assert got[0][60][0] == [(0, 9000, 1), (9000, 4000, 2)]


def test_runs_of_repeated_null_and_no_rows(spark):
    from helpers import DOC

    df = spark.createDataFrame([(None, "a " * 20, "en", "s", 1), (3, "b", None, None, None), (3, "b", None, None, None), (3, None, None, None, None)], DOC)
    got = sorted((r.doc_id or 0, r.n_words, r.collapsed, len(r.runs)) for r in periodic.periodic_runs(df).collect())
    assert got == [(0, 20, "a", 1), (3, 0, "", 0), (3, 1, "b", 0), (3, 1, "b", 0)]
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_op12_agrees_with_brute_force_over_the_table(spark, data):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, data).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = loop_by_hand(doc_id, text or "")
        runs = runs_by_hand(words)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.n_runs == len(runs)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        lines = "".join("%d,%d,%d\n" % x for x in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(words, runs)).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) >= len(rows) / 20


# -- languages


class Tree:
    """Prediction by partial matching in dictionaries, one context after the other."""

    def __init__(self, texts: list[bytes], order: int):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            t = bytes(order) + t
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.next[t[i - k : i]][t[i]] += 1

    def length(self, text: bytes) -> int:
        text, total = bytes(self.order) + text, 0
        for i in range(self.order, len(text)):
            for k in range(self.order, -1, -1):
                seen = self.next.get(text[i - k : i])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if text[i] in seen:
                    total += round(-math.log2(seen[text[i]] / whole) * 65536)
                    break
                total += round(-math.log2(len(seen) / whole) * 65536)
            else:
                total += 8 * 65536
        return total


def test_code_lengths_agree_with_a_tree_of_dictionaries(monkeypatch):
    samples = {"en": [b"the cat and the hat", b"that is the thing", b""], "de": ["der hut und die katze über".encode()], "xx": [b"\0\0ab\0"]}
    texts = [b"", b"the", b"die katze that", b"\0\0\0", "漢字".encode(), b"zzz" * 50, bytes(range(256))]
    for order in (0, 1, 4):
        names, levels = language.trees(samples, order)
        assert names == ["de", "en", "xx"]
        want = [[Tree(samples[n], order).length(t) for n in names] for t in texts]
        for step in (7, 1 << 18):
            monkeypatch.setattr(language, "STEP_BYTES", step)
            assert language.Scorer(levels, 3).lengths(texts).tolist() == want


def test_index_finds_each_key_and_no_other():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    index = language.Index(keys)
    assert (index(keys) == np.arange(len(keys))).all() and (index(keys + np.uint64(1 << 41)) == -1).all()
    assert language.Index(keys[:0])(keys[:3]).tolist() == [-1, -1, -1] and len(index(keys[:0])) == 0


def test_languages_of_odd_texts_and_tables(spark):
    from pyspark.sql import functions as F

    train = spark.createDataFrame([(1, "the cat and the hat", "en"), (1, "the cat and the hat", "en"), (2, "der hut und die katze", "de"), (3, None, "en"), (4, "x", None), (None, "q", "qq")], "doc_id bigint, text string, lang string")
    sample = language.language_sample(train, F.col("doc_id").isNotNull())
    assert sample == {"de": [b"der hut und die katze"], "en": [b"the cat and the hat"]}
    assert language.language_sample(train, F.col("doc_id").isNotNull(), languages=1).keys() == {"en"}
    model = language.trees(sample)
    table = docs(spark, ODD | {20: "the hat", 21: "die katze", 22: "die katze " * 300_000, 23: "12 34 !?"})
    got = {r.doc_id: r for r in language.predict_languages(table, *model).collect()}
    assert len(got) == len(ODD) + 4 and got[20].lang_pred == "en" and got[21].lang_pred == got[22].lang_pred == "de"
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 15, 23}
    assert all(r.score == 0 if r.lang_pred == "und" else 0.5 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.predict_languages(table, *language.trees({})).collect()} == {"und"}
    assert language.predict_languages(table.limit(0), *model).count() == 0


def test_op13_tells_held_out_rows(spark, data):
    got = QUERIES["op13_language_id"](spark, data).toPandas()
    rows = duckdb.sql(f"SELECT doc_id, lang FROM '{data}/documents.parquet'").df().merge(got, on="doc_id")
    assert len(rows) == len(got) and (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = rows[rows["held_out"] & (rows["lang_pred"] != "und")]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9


def test_new_operators_with_sql(spark, data):
    from oracle import compare

    compare(spark, data, QUERIES["op11_vector_codes"], ORACLES["op11_vector_codes"])
