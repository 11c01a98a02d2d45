"""Operator 8: near-duplicate groups by MinHash with tensored banding, confirmed on full sets.

A document's set is hashed into COLLECTIONS small collections of HASHES minhashes. Each pair of
collections is a table, and a document's key in it combines its keys in both: 16 collections, 48
minhashes, give 120 tables of six minhashes each, for which plain banding needs 720. Two documents are
candidates if they share a table's key, that is if at least two of their collections agree. At a
similarity of 0.85 a pair misses all tables with a probability of 6e-6, at 0.8 of 2e-4.

Documents with one sequence of words are taken as one node. Only collections that occur more than once
go on to the tables. In each bucket all nodes are held against its pivot, the node whose collections are
the most common, which is where a group of near-copies is densest. Nodes of buckets that are still in
different components are then held against each other, in two rounds, if they share a shingle among
their rarest: a pair that is similar enough shares one among the first n - overlap + 1 of each set, rarest
first, so no link is lost, no bucket has a cap, and members of one component are never paired again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import components
from .common import documents, lookup, pieces, saved, whole_text

COLLECTIONS = 16
HASHES = 3
#: Pairs of one node that are confirmed in one task.
NODE_PAIRS = 512
#: Nodes of one shingle and size, on each side, that are paired in one task.
BLOCK = 1024
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_lower = bytes(range(256)).lower()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_random = np.random.default_rng(20).integers(1, 1 << 63, 2 * COLLECTIONS * HASHES, np.int64).astype(np.uint64)
_factor, _shift = _random[::2] | np.uint64(1), _random[1::2]
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.full(2 * n, _GOLD))
    return _powers


def normalised(text: bytes) -> bytes:
    """A-Z in lower case; words, as ASCII white space parts them, joined by one space."""
    return b" ".join(text.translate(_lower).split())


def shingles(norm: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, or of all words where they are fewer."""
    if not norm:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(norm, np.uint8)
    gaps = np.flatnonzero(data == 32)
    start = np.concatenate([[0], gaps + 1])
    size = np.diff(np.append(start, len(data) + 1)) - 1
    offset = np.arange(len(data)) - np.repeat(start, np.append(np.diff(start), len(data) - start[-1]))
    value = (data.astype(np.uint64) + np.uint64(1)) * _power_table(int(size.max()) + 2)[offset]
    value[gaps] = 0
    word = _mix(np.add.reduceat(value, start) + size.astype(np.uint64))
    run = min(words, len(word))
    total = np.zeros(len(word) - run + 1, np.uint64)
    for j in range(run):
        total = _mix(total * _GOLD + word[j : len(word) - run + 1 + j])
    return np.unique(total + np.uint64(run))


def collection_keys(values: np.ndarray) -> np.ndarray:
    """One key for each collection, out of its minhashes."""
    least = np.full(len(_factor), np.iinfo(np.uint64).max)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        least = np.minimum(least, (np.multiply.outer(_factor, part) + _shift[:, None]).min(axis=1))
    key = np.zeros(COLLECTIONS, np.uint64)
    for j in range(HASHES):
        key = _mix(key * _GOLD + least[j::HASHES])
    return key


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, copy_a and copy_b (128 bits that stand for the sequence of words), n_shingles, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            norms = [normalised(t) for t in batch.column("data").to_pylist()]
            copy = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:16] for x in norms), np.int64).reshape(-1, 2)
            sets = [shingles(x, words) for x in norms]
            keys = np.concatenate([collection_keys(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COLLECTIONS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(copy[:, 0]), pa.array(copy[:, 1]),
                    pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))),
                ],
                ["doc_id", "copy_a", "copy_b", "n_shingles", "keys"],
            )

    return _texts(docs).mapInArrow(run, "doc_id bigint, copy_a bigint, copy_b bigint, n_shingles bigint, keys array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("data"))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, values binary: each document's whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [shingles(normalised(t), words).tobytes() for t in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary())], ["node", "values"])

    return _texts(docs).mapInArrow(run, "node bigint, values binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows a, b of ``pairs`` with 100 * intersection >= percent * union of their full sets.

    A node that many pairs share has its set sent once for every NODE_PAIRS of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            linked = []
            for x, y in zip(batch.column("values").to_pylist(), batch.column("other").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y)
                common = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    merged = np.concatenate([x, y])
                    merged.sort(kind="stable")
                    common = int((merged[1:] == merged[:-1]).sum())
                linked.append(common > 0 and 100 * common >= percent * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    total = max(1, pairs.count())
    rows = _with_set(pairs, sets, "a", "b", "values", total)
    rows = _with_set(rows, sets, "b", "a", "other", total)
    return rows.select("a", "b", "values", "other").mapInArrow(run, "a bigint, b bigint").distinct()


def _with_set(pairs: DataFrame, sets: DataFrame, node: str, partner: str, name: str, total: int) -> DataFrame:
    """``pairs`` with the set of their ``node`` as ``name``; no task receives all pairs of a node that many have."""
    degrees = pairs.groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    salts = F.ceil(F.col("degree") / NODE_PAIRS).cast("bigint")
    salted = lookup(pairs, degrees, [node], "degree", total, F.xxhash64(partner))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(partner), salts)).drop("degree")
    own = sets.join(degrees.withColumnRenamed(node, "_node"), F.col("node") == F.col("_node"))
    own = own.select(F.col("node").alias(node), F.col("values").alias(name), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_salt"))
    return salted.join(own, [node, "_salt"]).drop("_salt")


def _repeated(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    """``rows`` whose keys occur more than once, with the number of times and the aggregates ``more``."""
    table = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *more).where("size > 1")
    total = rows.count()
    return lookup(rows, saved(table, "repeated", total), keys, "size", max(1, total), F.xxhash64("node"), matched=True)


def _buckets(nodes: DataFrame, total: int) -> DataFrame:
    """node, n, bucket, pivot and weight (of the pivot) for each table key that several of ``nodes`` have."""
    single = saved(nodes.select("node", "n", F.posexplode("keys").alias("c", "key")).withColumn("c", F.col("c").cast("bigint")), "collections", COLLECTIONS * total)
    shared = _repeated(single, ["key", "c"])
    own = shared.groupBy("node", "n").agg(
        F.array_sort(F.collect_set(F.struct("c", "key"))).alias("k"),  # at most COLLECTIONS
        F.sum("size").alias("weight"),
    )
    pairs = F.flatten(
        F.transform(
            "k",
            lambda x, i: F.transform(F.slice(F.col("k"), i + 2, F.lit(COLLECTIONS)), lambda y: F.xxhash64(x["c"], x["key"], y["c"], y["key"])),
        )
    )
    tables = saved(own.select("node", "n", "weight", F.explode(pairs).alias("bucket")), "tables", COLLECTIONS * total)
    found = _repeated(tables, ["bucket"], F.max(F.struct("weight", (-F.col("node")).alias("o"))).alias("top"))
    return saved(found.select("node", "n", "bucket", (-F.col("top.o")).alias("pivot"), F.col("top.weight").alias("weight")), "buckets", tables.count())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of near-duplicates of ``docs`` (doc_id, text; other columns are ignored).

    A document's set has its distinct shingles of ``words`` words. Documents link if 100 * intersection
    >= percent * union. Returns one row per row: doc_id, n_shingles, component_id (least doc_id that can
    be reached), kept (doc_id = component_id). A null text counts as empty; a document without words has
    no set and links with nothing. Rows that share a doc_id are one document that has the links of all. A
    null doc_id is never kept and names no component, but shows that of its copies. An empty table gives
    an empty result.
    """
    all_rows = saved(sketches(docs, words), "sketches")
    total = all_rows.count()
    groups = (
        all_rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("copy_a", "copy_b")
        .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min_by("keys", "doc_id").alias("keys"), F.min("n_shingles").alias("n"))
    )
    groups = saved(groups, "groups", total)
    links = _links(docs, groups, total, words, percent)
    found = components(links)
    named = groups.select("copy_a", "copy_b", "node", "copies").join(found, "node", "left")
    named = named.select("copy_a", "copy_b", "copies", F.coalesce("component", "node").alias("component"))
    shown = lookup(
        all_rows.select("doc_id", "n_shingles", "copy_a", "copy_b"), saved(named, "named", total), ["copy_a", "copy_b"], "copies", max(1, total), F.xxhash64("doc_id")
    )
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return shown.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def _links(docs: DataFrame, groups: DataFrame, total: int, words: int, percent: int) -> DataFrame:
    buckets = _buckets(groups.select("node", "n", "keys"), total)
    most = buckets.count()
    candidates = saved(buckets.select("node").distinct(), "candidates", most)
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        candidates.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"
    )
    sets = saved(full_sets(wanted, words), "sets")
    to_pivot = buckets.where("node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("weight").alias("weight"))
    to_pivot = saved(to_pivot, "to-pivot", most)
    # One pair of each node first: most nodes need no more.
    first = saved(to_pivot.groupBy("a").agg(F.max(F.struct("weight", (-F.col("b")).alias("o"))).alias("m")).select("a", (-F.col("m.o")).alias("b")), "first", most)
    links = saved(confirmed(first, sets, percent), "links", most)
    now = saved(components(links), "components", most)
    rest = saved(_apart(to_pivot.select("a", "b").join(first, ["a", "b"], "left_anti"), now), "rest", most)
    if not rest.isEmpty():
        links = saved(links.union(confirmed(rest, sets, percent)), "links", most)
        now = saved(components(links), "components", most)
    shared = _rare_shingles(buckets, sets, now, percent, most)
    if shared is None:
        return links
    tested = saved(first.union(rest), "tested", most)
    # Each node against the heaviest node of every other component that has one of its rare shingles.
    heads = saved(shared.groupBy("shingle", "component").agg(F.max(F.struct("weight", (-F.col("node")).alias("o"), "n", "place")).alias("h")), "heads", shared.count())
    heads = heads.select("shingle", "component", (-F.col("h.o")).alias("node"), F.col("h.n").alias("n"), F.col("h.place").alias("place"))
    for part in ("heads", "all"):
        others = heads if part == "heads" else shared
        open_pairs = saved(_sharing(shared, others, percent).join(tested, ["a", "b"], "left_anti"), "open", most)
        open_pairs = saved(_apart(open_pairs, now), "open", most)
        if not open_pairs.isEmpty():
            links = saved(links.union(confirmed(open_pairs, sets, percent)), "links", most)
            now = saved(components(links), "components", most)
            tested = saved(tested.union(open_pairs), "tested", most)
            label = now.select("node", F.col("component").alias("_c"))
            shared = saved(shared.join(label, "node", "left").withColumn("component", F.coalesce("_c", "component")).drop("_c"), "shared", shared.count())
    return links


def _rare_shingles(buckets: DataFrame, sets: DataFrame, now: DataFrame, percent: int, most: int) -> DataFrame | None:
    """For nodes of buckets with several components, the rarest shingles of their sets that others have too:
    shingle, node, n, place (from 0, rarest first), component, weight; None if there are no such nodes."""
    inside = buckets.select("bucket", "node", "n").join(now, "node", "left")
    inside = saved(inside.select("bucket", "node", "n", F.coalesce("component", "node").alias("component")), "inside", most)
    mixed = inside.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    nodes = saved(inside.join(mixed.select("bucket"), "bucket", "left_semi").select("node", "n", "component").distinct(), "mixed", most)
    if nodes.isEmpty():
        return None
    weights = buckets.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    rows = saved(_exploded(sets.join(nodes.select("node").distinct(), "node", "left_semi")).distinct(), "shingles", nodes.agg(F.sum("n")).first()[0])
    total = rows.count()
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = lookup(rows, saved(counts, "counts", total), ["shingle"], "df", max(1, total), F.xxhash64("node", "shingle"))
    place = F.row_number().over(W.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "shingle")) - 1
    placed = known.withColumn("place", place).where("df IS NOT NULL").join(nodes.join(weights, "node"), "node")
    # A partner is at least as large as percent of this set, which needs an overlap of as much.
    placed = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    placed = saved(placed.select("shingle", "node", "n", "place", "component", "weight"), "placed", total)
    useful = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    useful = saved(useful.select("shingle", "size"), "useful", total)
    return saved(lookup(placed, useful, ["shingle"], "size", max(1, placed.count()), F.xxhash64("node"), matched=True).drop("size"), "shared", total)


def _exploded(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [np.frombuffer(v, np.int64) for v in batch.column("values").to_pylist()]
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), [len(v) for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]))], ["node", "shingle"])

    return sets.select("node", "values").mapInArrow(run, "node bigint, shingle bigint")


def _sharing(rows: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs a > b of different components with a shingle among those that one of a similar pair must share.

    Only sets of about one size meet: sizes are cut into ranges that a similar pair is at most one apart in.
    Where many nodes have a shingle, both sides are dealt into blocks, and each pair of blocks is its own key.
    """
    range_of = F.floor(F.log("n") / (math.log(100 / percent) * 1.000001 + 1e-6)).cast("int")
    one = rows.select("shingle", "node", "n", "place", "component", range_of.alias("range"))
    other = others.select(
        "shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("component").alias("_cb"),
        F.explode(F.array(range_of - 1, range_of, range_of + 1)).alias("range"),
    )
    keys = ["shingle", "range"]
    table = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("ones")).join(other.groupBy(*keys).agg(F.count(F.lit(1)).alias("others")), keys)
    table = saved(table, "block-counts")
    blocks = {c: F.ceil(F.col(c) / BLOCK).cast("bigint") for c in ("ones", "others")}
    one = lookup(one, table, keys, "ones", max(1, one.count()), F.xxhash64("node"), matched=True)
    one = one.withColumn("_i", F.pmod(F.xxhash64("node"), blocks["ones"])).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks["others"] - 1)))
    other = lookup(other, table, keys, "others", max(1, other.count()), F.xxhash64("b"), matched=True)
    other = other.withColumn("_j", F.pmod(F.xxhash64("b"), blocks["others"])).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks["ones"] - 1)))
    overlap = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    near = (F.col("place") <= F.col("n") - overlap) & (F.col("q") <= F.col("m") - overlap)
    apart = F.col("component") != F.col("_cb")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pairs = one.drop("ones", "others").join(other.drop("ones", "others"), [*keys, "_i", "_j"]).where(apart & near & fits)
    return pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, now: DataFrame) -> DataFrame:
    """``pairs`` whose nodes are in different components."""
    a = now.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    b = now.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)
