from __future__ import annotations

import hashlib
import random
import wave
import zlib
from io import BytesIO

import numpy as np
from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cashloom.llm import media, quality, toxicity
from cashloom.llm.labelled import fitting_sample, remainder


def test_remainder(spark):
    for r in spark.range(50).select("id", remainder(F.col("id"), 3).alias("m")).collect():
        assert r.m == zlib.crc32(str(r.id).encode()) % 3


def test_sample_is_bounded_and_leaves_the_fold_out(spark, data):
    table, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    texts, y = fitting_sample(table, labels, "quality", remainder(F.col("doc_id"), 3) != 1, 20)
    assert len(texts) == len(y) == 20
    held = {(t.text or "").encode() for t in table.where(remainder(F.col("doc_id"), 3) == 1).collect()}
    free = {(t.text or "").encode() for t in table.where(remainder(F.col("doc_id"), 3) != 1).collect()}
    assert all(t in free or t not in held for t in texts)


def test_sample_is_bounded_by_bytes_and_stands_repeats(spark):
    texts = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(3, "a"), (3, "a"), (4, None), (None, "n")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    every = fitting_sample(texts, labels, "toxic", F.lit(True), 1000)
    assert len(every[0]) == 50 and sorted(map(len, every[0])) == [0, 1] + [100] * 48 and sum(every[1]) == 24
    some = fitting_sample(texts, labels, "toxic", F.lit(True), 1000, 1_050)
    assert 10 <= len(some[0]) <= 12 and sum(map(len, some[0])) <= 1_050 and set(zip(*some)) <= set(zip(*every))
    assert fitting_sample(texts, labels.limit(0), "toxic", F.lit(True), 10) == ([], [])
    assert fitting_sample(texts.limit(0), labels, "toxic", F.lit(True), 10) == ([], [])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_quality_learns_held_out():
    rng = random.Random(1)
    made = [(words(rng, 60), 1) for _ in range(150)] + [(words(rng, 60).replace(" ", "### "), 0) for _ in range(75)] + [((words(rng, 1) + " ") * 60, 0) for _ in range(75)]
    rng.shuffle(made)
    net = quality.fit([t.encode() for t, _ in made[:200]], [y for _, y in made[:200]])
    score = net.score([t.encode() for t, _ in made[200:]])
    assert ((score >= 0.5) == np.array([y == 1 for _, y in made[200:]])).mean() > 0.9


def test_quality_sees_whole_texts(monkeypatch):
    rng = random.Random(2)
    net = quality.ByteNetwork.start(np.random.default_rng(0))
    texts = [words(rng, n).encode() for n in (0, 1, 5, 100, 3000)]
    whole = net.pool(texts)
    assert np.allclose(whole, np.concatenate([net.pool([t]) for t in texts]), atol=1e-4)
    monkeypatch.setattr(quality, "STEP_BYTES", 1024)
    assert np.allclose(whole, net.pool(texts), atol=1e-4)


def test_quality_gradients():
    rng = np.random.default_rng(3)
    net = quality.ByteNetwork.start(rng)
    texts, y = [b"some text that is long enough", b"another one ####### here"], np.array([1, 0], np.float32)

    def loss():
        p = net.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads, step = quality._gradients(net, texts, y), 1e-2
    for w, g in ((net.near, grads[1]), (net.far, grads[2]), (net.out, grads[4]), (net.embedding, grads[0])):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.15 * abs(g[at]) + 1e-3


def test_toxicity_learns_held_out():
    rng = random.Random(4)
    made = []
    for _ in range(500):
        text, bad = words(rng, 40), rng.random() < 0.3
        if bad:
            parts = text.split()
            parts[rng.randrange(len(parts))] = rng.choice(["moron", "trash"]) if rng.random() < 0.6 else "vequ" + words(rng, 1)
            text = " ".join(parts)
        made.append((text, int(bad)))
    net = toxicity.fit([t.encode() for t, _ in made[:350]], [y for _, y in made[:350]])
    score, language = net.score([t.encode() for t, _ in made[350:]])
    assert ((score >= 0.5) == np.array([y == 1 for _, y in made[350:]])).mean() > 0.9
    assert set(language) <= set(toxicity.LANGUAGES)


def test_toxicity_sees_whole_texts(monkeypatch):
    rng = random.Random(5)
    net = toxicity.fit([words(rng, 20).encode() for _ in range(40)], [i % 2 for i in range(40)])
    texts = [b"", b"  ", b"the der", *(words(rng, n).encode() for n in (1, 30, 2000)), b"x" * 3000]
    whole = net.judge(texts)
    assert np.allclose(whole[0], np.concatenate([net.judge([t])[0] for t in texts]), atol=1e-4)
    monkeypatch.setattr(toxicity, "STEP_BYTES", 512)
    assert np.allclose(whole[0], net.judge(texts)[0], atol=1e-4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=5))
def test_words_are_hashed_alike_everywhere(texts):
    hashes, first = toxicity.word_hashes(texts)
    assert len(first) == len(texts) + 1
    for i, t in enumerate(texts):
        assert toxicity.word_hashes([t])[0].tolist() == hashes[:, first[i] : first[i + 1]].tolist()
    assert toxicity.word_hashes([b"ABC Def"])[0].tolist() == toxicity.word_hashes([b"abc, def!"])[0].tolist()


def test_scored_documents(spark):
    net = quality.fit([b"good text here", b"### bad ###"] * 5, [1, 0] * 5)
    for df in (quality.score_documents(docs(spark, ODD), net), toxicity.score_documents(docs(spark, ODD), toxicity.fit([b"a b", b"idiot c"] * 5, [0, 1] * 5))):
        rows = df.collect()
        assert {r.doc_id for r in rows} == set(ODD) and all(0 <= r.score <= 1 for r in rows)
        by_id = {r.doc_id: r.score for r in rows}
        assert by_id[1] == by_id[2] and by_id[8] == by_id[9]
    assert quality.score_documents(docs(spark, ODD).limit(0), net).count() == 0
    kept = quality.keep_quality(docs(spark, ODD), net)
    assert kept.columns == docs(spark, ODD).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_documents(docs(spark, ODD), net).where("score >= 0.5").collect()}
    assert quality.fit([], []).score([b"x"]).tolist() == [0.5] and quality.fit([b"x"], [1]).score([b"y"])[0] > 0.5


def test_media(spark):
    stored = media.store_documents(docs(spark, ODD)).collect()
    for r in stored:
        data = (ODD[r.doc_id] or "").encode()
        want = data + b" " * (-len(data) % 192 if data else 192)
        with wave.open(BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, want)
        assert r.n_bytes == len(data)
    got = {r.doc_id: r for r in media.media_features(media.store_documents(docs(spark, ODD))).collect()}
    for k, t in ODD.items():
        data = media.padded((t or "").encode())
        assert (got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert len(got[k].codes) == len(got[k].times) and got[k].times == sorted(got[k].times)
    assert got[8].codes == got[9].codes and got[1].media_sha256 == got[2].media_sha256
    assert media.media_features(media.store_documents(docs(spark, ODD).limit(0))).count() == 0


def test_fingerprints_do_not_depend_on_company(monkeypatch):
    rng = np.random.default_rng(6)
    clips = [rng.integers(0, 256, n * 192, np.uint8) for n in (1, 4, 40)]
    alone = [media.band_peaks(c) for c in clips]
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    for c, (s, b) in zip(clips, alone, strict=True):
        s2, b2 = media.band_peaks(c)
        assert (s == s2).all() and (b == b2).all()
    owner = np.repeat([0, 1, 2], [1, 4, 40])
    who, code, _ = media.pair_codes(np.concatenate([s for s, _ in alone]), np.concatenate([b for _, b in alone]), owner)
    for i, (s, b) in enumerate(alone):
        assert media.pair_codes(s, b, np.zeros(len(s), int))[1].tolist() == code[who == i].tolist()


def _by_hand(net, text: bytes) -> float:
    """The score of one text, word by word: the definition itself, without arrays of words or batches."""
    import re

    found = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text))
    mask = (1 << 64) - 1

    def row(word: bytes, k: int) -> int:
        total = sum((b + 1) * pow(0x9E3779B97F4A7C15, i % 64 + 1, 1 << 64) for i, b in enumerate(word) if toxicity.PARTS[k] >= 64 or i < toxicity.PARTS[k])
        total = (total + k) * 0xD6E8FEB86659FD93 & mask
        total ^= total >> 32
        return int(net.number[k][(total * 0xD6E8FEB86659FD93 & mask) >> (64 - toxicity.HASH_BITS)])

    vectors = [sum(net.embedding[row(w, k)].astype(float) for k in range(len(toxicity.PARTS))) for w in found]
    most = max(toxicity.WIDTHS)
    vectors += [np.zeros(toxicity.WIDTH)] * most
    pooled = []
    for w, kernel in zip(toxicity.WIDTHS, net.filters, strict=True):
        pooled += list(np.max([sum(vectors[i + j] @ kernel[j] for j in range(w)) for i in range(len(found) + 1)], axis=0))
    logit = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias[0]
    spoken = {w: {k for k, v in toxicity.FUNCTION_WORDS.items() if w in v.split()} for w in set("".join(f"{v} " for v in toxicity.FUNCTION_WORDS.values()).split())}
    hits = dict.fromkeys(toxicity.LANGUAGES, 0)
    for w in found:
        own = spoken.get(w.decode("utf-8", "replace"), set())
        if len(own) == 1:
            hits[next(iter(own))] += 1
    language = max(toxicity.LANGUAGES, key=lambda k: hits[k]) if any(hits.values()) else "other"
    return 1 / (1 + np.exp(-(logit - net.threshold[toxicity.LANGUAGES.index(language)])))


def test_toxicity_query_by_hand(spark, data):
    """The registered query over the driver's table against the definition, text by text."""
    from cashloom.llm.queries import QUERIES

    table, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    net = toxicity.toxicity_network(table, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    rows = QUERIES["op5_toxicity"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        if len(texts[r.doc_id]) < 6000:
            assert abs(r.score - _by_hand(net, texts[r.doc_id])) < 1e-4


def test_toxicity_does_not_depend_on_neighbours(spark, data):
    """A text's score is its own, whatever stands next to it in a batch."""
    table, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    net = toxicity.toxicity_network(table, labels)
    texts = [(r.text or "").encode() for r in table.limit(60).collect()] + [b"", b"idiot", b""]
    together = net.judge(texts)[0]
    assert np.allclose(together, [net.judge([t])[0][0] for t in texts], atol=1e-4)
    assert np.allclose(together[::-1], net.judge(texts[::-1])[0], atol=1e-4)
    assert toxicity.score_documents(docs(spark, ODD).limit(0), net).count() == 0


def test_quality_query_by_hand(spark, data):
    """The registered query over the driver's table against chunk-by-chunk sums."""
    from cashloom.llm.queries import QUERIES

    table, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    net = quality.quality_network(table, labels)
    rows = {r.doc_id: r for r in QUERIES["op4_quality"](spark, data).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    assert rows.keys() == texts.keys()
    for k, text in texts.items():
        r = rows[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)
        if len(text) < 4000:
            blocks, first = quality.blocks_of([text])
            x = net.inputs(blocks, first).astype(float)
            pooled = np.max([x[i] @ net.near + x[i + 1] @ net.far for i in range(len(x) - 1)], axis=0)
            assert abs(r.score - 1 / (1 + np.exp(-(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias[0])))) < 1e-4
