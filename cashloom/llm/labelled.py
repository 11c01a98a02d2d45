"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

#: Longer texts are left out of fitting (never out of scoring), so that no single one fills the sample.
FIT_TEXT_BYTES = 200_000
#: Bytes of all texts of a sample, at most: it goes to the driver.
FIT_BYTES = 64 << 20


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; a null doc_id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % of


def fitting_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, total: int = FIT_BYTES
) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` labelled texts of at most ``total`` bytes, dealt by a hash of the doc_id, and their
    labels 0 or 1.

    ``usable`` decides by doc_id which rows may be learned from. At most ``rows`` ids are broadcast, and so
    many sizes come to the driver. Of rows that share a doc_id the least text and the least label count; a
    null doc_id or label is not learned from. Without labels the sample is empty.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(*order)
        .limit(rows)
    )
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("data"))
    found = text.where(F.octet_length("data") <= FIT_TEXT_BYTES).join(F.broadcast(chosen), "doc_id")
    found = saved(found.groupBy("doc_id").agg(F.min("data").alias("data"), F.min("label").alias("label")), "fitting", rows)
    held = 0
    for hashed, doc_id, size in sorted(map(tuple, found.select(*order, F.octet_length("data")).collect())):
        held += size
        if held > total:
            found = found.where(F.struct(*order) < F.struct(F.lit(hashed), F.lit(doc_id).cast("bigint")))
            break
    got = sorted((r.doc_id, bytes(r.data), r.label) for r in found.collect())
    return [d for _, d, _ in got], [y for _, _, y in got]
