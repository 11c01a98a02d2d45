from __future__ import annotations

import hashlib
import random

import tiktoken
from pyspark.sql import functions as F
from helpers import DOC
from test_dedup import brute_near

import corpus_pipeline
from cashloom.llm import bpe, mixing, quality
from cashloom.operators.shared import saved


def test_stages_against_brute_force(spark, data, tmp_path):
    """Each stage on what its predecessor has written."""
    path, docs = f"file://{tmp_path}", spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, data).write.parquet(f"{path}/{k}")
        out = spark.read.parquet(f"{path}/{k}")
        kept = {r.doc_id for r in out.collect()}
        assert kept <= set(before), name
        if k == 0:
            net = quality.quality_network(docs, spark.read.parquet(f"{data}/labels.parquet"))
            score = net.score([r.text.encode() for r in before.values()])
            assert kept == {i for i, s in zip(before, score, strict=True) if s >= 0.5}
            clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
            assert len(clean & kept) >= 0.97 * len(clean)
        elif k == 1:
            last = {}
            for i, r in before.items():
                last[r.text] = max(i, last.get(r.text, i))
            assert kept == set(last.values())
        elif k == 2:
            want = brute_near({i: r.text for i, r in before.items()}, 5, 80)
            assert kept == {i for i, (_, c) in want.items() if i == c}
        elif k == 3:
            rows = mixing.mixed(docs, corpus_pipeline.MIX_BUDGET)
            assert kept == {r.doc_id for r in rows.where("_kept").collect()}
            assert 0.75 <= out.count() / len(before) <= 1
        else:
            data_, pattern = bpe.vocabulary(corpus_pipeline.VOCABULARY)
            lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(data_), special_tokens={})
            assert kept == set(before)
            for r in out.collect():
                text = before[r.doc_id].text
                assert r.ids == lib.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        docs = out


def test_run_is_the_stages(spark, data):
    from cashloom.llm.common import saved

    out, docs = corpus_pipeline.run(spark, data), spark.read.parquet(f"{data}/documents.parquet")
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, data), "by-hand")
    assert sorted(map(tuple, out.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_stages_stand_empty_tables_and_repeats(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    twice = docs.limit(40).union(docs.limit(40))
    texts = {}
    for r in docs.limit(40).collect():
        texts[r.text] = max(r.doc_id, texts.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in corpus_pipeline.exact_dedup(spark, twice, data).collect()) == sorted(texts.values())
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), data).count() == 0


def _rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOC)


def test_exact_dedup_decides_by_row(spark, data):
    pairs = [(5, "A"), (5, "B"), (9, "A"), (None, "C"), (None, "D"), (None, "D"), (None, "A"), (3, ""), (3, None), (7, "E"), (7, "E")]
    got = sorted(((r.doc_id, r.text or "") for r in corpus_pipeline.exact_dedup(spark, _rows(spark, pairs), data).collect()), key=str)
    assert got == sorted([(9, "A"), (5, "B"), (None, "C"), (None, "D"), (3, ""), (7, "E")], key=str)


def test_near_dedup_decides_by_row(spark, data):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    pairs = [(3, x), (5, x + " more"), (5, y), (8, y + " more"), (None, z), (None, z + " more"), (None, x + " other"), (None, "alone"), (None, "")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, _rows(spark, pairs), data).collect()]
    assert sum(t.startswith("z0 ") for _, t in got) == 1
    assert sorted((p for p in got if not p[1].startswith("z0 ")), key=str) == sorted([(3, x), (5, y), (None, "alone"), (None, "")], key=str)
    own = [(5, x), (5, x + " more"), (6, y)]
    assert len(corpus_pipeline.near_dedup(spark, _rows(spark, own), data).collect()) == 2


CLASHING = ["_key", "_id", "_s", "_sha", "_kept", "_topic", "_tokens", "_source", "_lang", "_probability", "_doc", "_n", "_key_id", "_kept_sha", "kept", "size"]


def test_stages_with_ids_at_both_ends_and_clashing_columns(spark, data):
    """All stages against brute force: ids at the ends of bigint, without and repeated, and columns of all inner names."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    x, y, z, other = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(4))
    top, low = 2**63 - 1, -(2**63)
    pairs = [(top, x), (low, x), (None, x), (None, y), (2**62 + 5, y + " more"), (2**62 + 5, z), (top, z + " more"), (3, other), (3, None), (3, None), (low, "")]
    table = _rows(spark, pairs).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    exact = spark.createDataFrame(corpus_pipeline.exact_dedup(spark, table, data).collect(), table.schema)
    assert exact.columns == table.columns and all(r[c] == f"own {c}" for r in exact.collect() for c in CLASHING)
    want = [(top, x), (None, y), (2**62 + 5, y + " more"), (2**62 + 5, z), (top, z + " more"), (3, other), (3, "")]
    assert sorted(((r.doc_id, r.text or "") for r in exact.collect()), key=str) == sorted(want, key=str)
    near = corpus_pipeline.near_dedup(spark, exact, data)
    assert near.columns == table.columns and all(r[c] == f"own {c}" for r in near.collect() for c in CLASHING)
    # Of y and z the row with the lesser doc_id stays; rows without one come last.
    want = [(top, x), (2**62 + 5, y + " more"), (2**62 + 5, z), (3, other), (3, "")]
    assert sorted(((r.doc_id, r.text or "") for r in near.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, table.where("doc_id = 3 AND text IS NOT NULL"), data).count() == 1
    mixed = corpus_pipeline.mixing(spark, table, data)
    plain = mixing.mixed(_rows(spark, pairs), corpus_pipeline.MIX_BUDGET).where("_kept")
    assert mixed.columns == table.columns and all(r[c] == f"own {c}" for r in mixed.collect() for c in CLASHING)
    assert sorted(map(repr, mixed.select("doc_id", "text").collect())) == sorted(map(repr, plain.select("doc_id", "text").collect()))
    told = mixing.mixed(table)
    assert told.columns == [*table.columns, "__topic", "__tokens", "__probability", "__kept"] and told.count() == len(pairs)
    last = corpus_pipeline.byte_bpe(spark, table, data)
    assert last.count() == len(pairs)


def test_run_rereads_each_stage(spark, data, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage)])
    out = corpus_pipeline.run(spark, data)
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert not set(seen[0]) & set(seen[1]) and not set(seen[1]) & set(out.inputFiles())


def test_saved_collects_the_drivers_garbage_once_an_eighth_of_the_heap_has_filled(spark):
    jvm = spark.sparkContext._jvm
    memory = jvm.java.lang.Runtime.getRuntime()

    def collections() -> int:
        return sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())

    memory.gc()
    saved(spark.range(1), "garbage")
    before = collections()
    saved(spark.range(1), "garbage")
    assert collections() == before
    filled = [jvm.java.nio.ByteBuffer.allocate(memory.maxMemory() // 40) for _ in range(8)]
    saved(spark.range(1), "garbage")
    assert collections() > before
    for buffer in filled:
        spark.sparkContext._gateway.detach(buffer)
