"""Operator 11: vector codes. Exact integer k-means over parts of vectors (product quantisation).

Distances of all parts to all entries of their codebooks come from one float32 matrix product, each with
an interval that its rounding errors cannot leave: converting two integers, multiplying them and adding m
products errs by at most gamma(m + 2) * |part| * |entry|. Entries whose interval overlaps the best one are
evaluated again in int64; of equal ones the lower index wins. So codes are exact, whatever the order in
which a machine adds. A round's sums are added up in each task before they are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, pieces, saved, small_batches

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_UNIT = 2.0**-24


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and values, floor(scale * x) of each component, of the rows whose vector is whole.

    Rows go whose vector is null or holds a null, NaN or infinite component.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & ~odd)
    values = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return whole.select("vec_id", "label", values.cast("array<bigint>").alias("values"))


def nearest(values: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Index of the nearest entry for each part: values rows x parts x m, books parts x entries x m, int64."""
    m = values.shape[2]
    dot = np.matmul(values.astype(np.float32).transpose(1, 0, 2), books.astype(np.float32).transpose(0, 2, 1)).astype(np.float64)
    gamma = (m + 2) * _UNIT / (1 - (m + 2) * _UNIT)
    square = (books * books).sum(axis=2).astype(np.float64)[:, None, :]
    length = np.sqrt((values.astype(np.float64) ** 2).sum(axis=2)).T[:, :, None]
    rough = square - 2 * dot
    # The last term covers the roundings of these lines themselves, which are in double precision.
    reach = 2 * gamma * (1 + 2.0**-20) * length * np.sqrt(square) + 2.0**-48 * (square + 2 * np.abs(dot))
    open_ = rough - reach <= (rough + reach).min(axis=2, keepdims=True)
    index = open_.argmax(axis=2)
    part, row = np.nonzero(open_.sum(axis=2) > 1)
    if len(part):
        pair, entry = np.nonzero(open_[part, row])
        exact = np.full((len(part), books.shape[1]), np.iinfo(np.int64).max)
        away = values[row[pair], part[pair]] - books[part[pair], entry]
        exact[pair, entry] = (away * away).sum(axis=1)
        index[part, row] = exact.argmin(axis=1)
    return index.T


def distances(values: np.ndarray, books: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the entries that ``index`` names, summed over parts."""
    away = values - books[np.arange(books.shape[0]), index]
    return (away * away).sum(axis=(1, 2))


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = batch.column("values").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, parts, -1)


def _shape(kept: DataFrame, parts: int) -> tuple[int, int]:
    """Rows and components; an error where vectors differ in length, can't be cut or would overflow."""
    n, least, most, low, high = kept.agg(
        F.count(F.lit(1)), F.min(F.size("values")), F.max(F.size("values")), F.min(F.array_min("values")), F.max(F.array_max("values"))
    ).first()
    if not n:
        return 0, 0
    if least != most or not most or most % parts:
        raise ValueError(f"vectors must all have one length that {parts} divides; there are {least} to {most} components")
    bound = math.isqrt(((1 << 63) - 1) // (4 * most))
    if max(-low, high) > bound:
        raise ValueError(f"components beyond {bound} steps have distances that a bigint does not hold")
    return n, most


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Fit codebooks (parts x entries x m, int64) on all rows of ``kept``, as integer_vectors() gives them.

    They start as the vectors of the smallest vec_ids (null last; equal ones by their values), of which
    there may be fewer than ``entries``. A round reads ``kept`` once; a task hands on one row of sums for
    each entry. An empty table has no codebooks.
    """
    _, width = _shape(kept, parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).select("values").collect()
    books = np.array([r["values"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if first else np.zeros((parts, 0, 0), np.int64)
    if not first:
        return books
    m = width // parts
    for _ in range(rounds):
        sums = _sums(kept, books, parts, m)
        for r in sums.collect():
            books[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return books


def _sums(kept: DataFrame, books: np.ndarray, parts: int, m: int) -> DataFrame:
    """part, entry, n and m sums of the parts that each used entry is nearest to."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros((parts, own.shape[1], 1 + m), np.int64)
        for batch in pieces(batches):
            values = _matrix(batch, parts)
            index = nearest(values, own)
            for j in range(parts):
                np.add.at(total[j, :, 1:], index[:, j], values[:, j])
                total[j, :, 0] += np.bincount(index[:, j], minlength=own.shape[1])
        part, entry = np.nonzero(total[:, :, 0])
        used = total[part, entry]
        names = ["part", "entry", "n", *(f"s{j}" for j in range(m))]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), *(pa.array(used[:, j].copy()) for j in range(1 + m))], names)

    fields = ", ".join(["part bigint", "entry bigint", "n bigint", *(f"s{j} bigint" for j in range(m))])
    added = kept.select("values").mapInArrow(run, fields).groupBy("part", "entry")
    return added.agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(m)])


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part's entry, in order) and error of each row of ``kept``."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            values = _matrix(batch, len(own))
            index = nearest(values, own)
            code = [bytes(row).hex() for row in index.astype(np.uint8)]
            error = pa.array(distances(values, own, index))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), error], ["vec_id", "label", "code", "error"])

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``vectors`` (vec_id, embedding, label; other columns are ignored) and the codebooks.

    The table has vec_id, label, code, error and label_error, the error of all rows of a label, one row per
    row whose vector is whole. Repeated rows count as often as they stand there; null labels are one group.
    An empty table gives no rows. Vectors of different lengths are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    kept = saved(integer_vectors(vectors), "vectors")
    books = codebooks(kept, parts, entries, rounds)
    codes = saved(encode(kept, books), "codes")
    name = F.coalesce(F.col("label").cast("string"), F.lit(""))
    keyed = codes.select("*", F.xxhash64(name).alias("_key"), name.alias("_name"), F.col("label").isNull().alias("_none"))
    keys = ["_key", "_name", "_none"]
    groups = keyed.groupBy(keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("error").alias("label_error"))
    found = lookup(keyed, saved(groups, "labels"), keys, "_rows", codes.count(), F.xxhash64("vec_id", "code"))
    return found.select("vec_id", "label", "code", "error", "label_error"), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    nearest_ = """near{k} AS MATERIALIZED (
    SELECT vec_id, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d
    FROM (SELECT v.vec_id, v.part, b.entry, CAST(sum((v.val - b.val) * (v.val - b.val)) AS bigint) AS d
          FROM v JOIN book{k} b ON b.part = v.part AND b.pos = v.pos GROUP BY v.vec_id, v.part, b.entry)
    GROUP BY vec_id, part)"""
    moved = """mean{n} AS MATERIALIZED (
    SELECT near{k}.part, near{k}.entry, v.pos, CAST(sum(v.val) AS bigint) AS s, count(*) AS n
    FROM near{k} JOIN v ON v.vec_id = near{k}.vec_id AND v.part = near{k}.part GROUP BY ALL),
book{n} AS MATERIALIZED (
    SELECT b.part, b.entry, b.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.val) AS val
    FROM book{k} b LEFT JOIN mean{n} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
    steps = [nearest_.format(k=0)]
    for n in range(1, ROUNDS + 1):
        steps += [moved.format(k=n - 1, n=n), nearest_.format(k=n)]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, embedding, len(embedding) AS width FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (
    SELECT vec_id, CAST((spot - 1) // (width // {PARTS}) AS bigint) AS part, CAST((spot - 1) % (width // {PARTS}) AS bigint) AS pos,
           CAST(floor({SCALE} * CAST(embedding[spot] AS double)) AS bigint) AS val
    FROM (SELECT vec_id, embedding, width, unnest(generate_series(1, width)) AS spot FROM kept)),
book0 AS MATERIALIZED (
    SELECT v.part, f.entry, v.pos, v.val
    FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) f JOIN v ON v.vec_id = f.vec_id),
{", ".join(steps)},
coded AS (
    SELECT kept.vec_id, kept.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code, CAST(sum(n.d) AS bigint) AS error
    FROM kept JOIN near{ROUNDS} n ON n.vec_id = kept.vec_id GROUP BY kept.vec_id, kept.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
       (SELECT sha256(string_agg(CAST(val AS varchar), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""


OP11_SQL = _sql()
