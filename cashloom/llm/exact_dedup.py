"""Operator 3: exact dedup by deterministic block naming. DataFrame functions only.

A document's UTF-8 bytes are cut into blocks of a fixed size. All different blocks are sorted, and each
gets an integer name in that order. Then every two adjacent names of a document are a pair, all different
pairs are sorted and named in the same way, and so on, until one name is left: with its level it is the
document's identity. Names stand for one content each, so two documents share an identity if and only if
their bytes are equal.

The order of blocks is that of a 64-bit code, then of the bytes. Hence only different blocks' bytes cross
the network, once, after a map-side aggregation in which copies meet; what is sorted, and what a
document's blocks are looked up by, is the code. Blocks that share a code with other ones are looked up by
their bytes. Pairs of names are integers already and are sorted as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, lookup, saved, whole_text

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, block_bytes: int, code_bits: int) -> DataFrame:
    """_row (a number of its own), doc_id, n_bytes, sha, and blocks array<struct<code, block>>."""
    data = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("_data")
    ).withColumn("n_bytes", F.octet_length("_data").cast("bigint"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_bytes") - 1) / block_bytes).cast("int")))

    def code(block: Column) -> Column:
        return F.xxhash64(block) if code_bits >= 64 else F.xxhash64(block).bitwiseAND(F.lit((1 << code_bits) - 1))

    cut = F.transform(starts, lambda i: F.substring(F.col("_data"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = F.transform(cut, lambda b: F.struct(code(b).alias("code"), b.alias("block")))
    return data.select("_row", "doc_id", "n_bytes", F.sha2(F.col("_data"), 256).alias("sha"), blocks.alias("blocks"))


def _named(table: DataFrame, order: list[str], name: str, rows: int) -> DataFrame:
    """``table`` with integers (name) in the order of its rows, which all differ."""
    return saved(table.orderBy(*order).withColumn("name", F.monotonically_increasing_id()), name, rows)


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, code_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The rows (_row, doc_id, n_bytes, sha), numbered once and written, and _row, pos, name: the names of
    their blocks. ``code_bits`` under 64 makes tests' codes collide."""
    blocks = _blocks(docs, block_bytes, code_bits)
    different = blocks.select(F.inline("blocks")).groupBy("code", "block").agg(F.count(F.lit(1)).alias("uses"))
    codes = saved(different.groupBy("code").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("n")), "codes")
    total = max(1, codes.agg(F.sum("uses")).first()[0] or 0)
    order = codes.select("code", "uses", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
    names = _named(order, ["code", "nth"], "names", total)
    shared = codes.where("n > 1").select("code", "uses")
    if shared.isEmpty():
        rows = saved(blocks.withColumn("codes", F.transform("blocks", lambda b: b["code"])).drop("blocks"), "rows")
        every = rows.select("_row", F.posexplode("codes").alias("pos", "code"))
        return rows, lookup(every, names.drop("nth"), ["code"], "uses", total, F.xxhash64("_row", "pos"), matched=True).select("_row", "pos", "name")
    # Several blocks have one code: they are told apart by their bytes, in whose order they were named.
    rows = saved(blocks, "rows")
    every = rows.select("_row", F.posexplode("blocks").alias("pos", "_b")).select("_row", "pos", "_b.code", "_b.block")
    plain = lookup(every.select("_row", "pos", "code"), names.join(shared.select("code"), "code", "left_anti").drop("nth"), ["code"], "uses", total, F.xxhash64("_row", "pos"), matched=True)
    alike = every.join(shared.select("code"), "code").groupBy("code", "block").agg(F.count(F.lit(1)).alias("own"))
    ranked = alike.withColumn("nth", F.row_number().over(W.partitionBy("code").orderBy("block")))
    ranked = saved(ranked.join(names.select("code", "nth", "name"), ["code", "nth"]).select("code", "block", "own", "name"), "shared-codes")
    rest = lookup(every, ranked, ["code", "block"], "own", total, F.xxhash64("_row", "pos"), matched=True)
    return rows.drop("blocks"), plain.select("_row", "pos", "name").unionByName(rest.select("_row", "pos", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, code_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, sha, and the identity level int, root bigint."""
    rows, now = block_names(docs, block_bytes, code_bits)
    now = saved(now, "block-names")
    level, roots = 0, None
    while True:
        # A row with one name left is done; the others' neighbours become pairs, the last one's perhaps without a second.
        held = now.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_n"))
        held = saved(held.select("_row", F.transform("_n", lambda x: x["name"]).alias("names")), "held")
        done = held.where(F.size("names") == 1).select("_row", F.lit(level).alias("level"), F.get("names", F.lit(0)).alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        open_rows = held.where(F.size("names") > 1)
        if open_rows.isEmpty():
            break
        half = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")),
        )
        pairs = open_rows.select("_row", F.posexplode(half).alias("pos", "_p")).select("_row", "pos", "_p.a", "_p.b")
        table = saved(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses")), "pairs")
        total = max(1, table.agg(F.sum("uses")).first()[0])
        named = lookup(pairs, _named(table, ["a", "b"], "pair-names", total), ["a", "b"], "uses", total, F.xxhash64("_row", "pos"), matched=True)
        now = saved(named.select("_row", "pos", "name"), "names")
        level += 1
    return rows.join(roots, "_row").select("doc_id", "n_bytes", "sha", "level", "root")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, code_bits: int = 64) -> DataFrame:
    """Exact duplicate groups of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per row: doc_id, keep_id (largest doc_id among equal texts), group_size (rows with
    this text), kept (doc_id = keep_id), text_sha256. A null text counts as empty and is equal to an
    empty one. Rows that repeat a doc_id with one text are all listed and share the flag. A row whose
    doc_id is null never stays, unless its whole group has none: then keep_id is null and kept false.
    A text of any length is named whole. An empty table gives an empty result.
    """
    ids = saved(identities(docs, block_bytes, code_bits), "identities")
    total = ids.count()
    groups = (
        ids.groupBy("level", "root")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    hit = lookup(ids, saved(groups, "groups", total), ["root", "level"], "group_size", total, F.xxhash64("doc_id"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return hit.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
