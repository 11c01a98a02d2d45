"""Operator 12: periodic runs of words, found by an all-lag vectorised scan.

A text's words become an array of ids, which is compared with itself shifted by each lag q up to n / 2;
stretches of equal places, run-length coded, are the runs of period q. A run must be equal on at least
s = max(12 - q, q) places in a row, so the s-th, 2s-th, ... place of each lag are compared first, for all
lags in a few array operations: no such stretch lies between two of them. Lags where one of these places
and its neighbours are equal are then compared whole. A stretch that two lags share belongs to the lesser:
at a length of two periods the smallest period divides every other one.

Texts beyond LONG_BYTES are dealt out by ranges of lags, so that no task has all lags of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, saved, whole_text

LEAST = 12
#: Longer texts are scanned by ranges of lags. Others have too few words for that to be worth a shuffle.
LONG_BYTES = 64 << 10
#: Comparisons of one range of lags, were every lag compared whole.
RANGE_WORK = 100_000_000
#: Ranges of one text at most, since each has a copy of its ids.
RANGES = 64
#: Places that are compared at once.
PLACES = 1 << 19
#: Equal neighbours that are asked for on one side of an equal place, at most.
SIDE = 8

RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))


def equal_lags(ids: np.ndarray, low: int, high: int, least: int = LEAST) -> np.ndarray:
    """The lags of low..high that may have enough equal places in a row; no other lag has."""
    lags = np.arange(low, high + 1)
    step = np.maximum(least - lags, lags)
    ends = np.cumsum((len(ids) - lags) // step)
    around = np.concatenate([np.full(SIDE, -1, np.int32), ids, np.full(SIDE, -2, np.int32)])
    found, at = [], 0
    while at < len(lags):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
        found.append(_hits(around, len(ids), lags[at:upto], step[at:upto]))
        at = upto
    return np.concatenate(found) if found else lags


def _hits(around: np.ndarray, n: int, lags: np.ndarray, step: np.ndarray) -> np.ndarray:
    count = (n - lags) // step
    lag = np.repeat(lags, count)
    nth = np.arange(1, len(lag) + 1) - np.repeat(np.cumsum(count) - count, count)
    place = nth * np.repeat(step, count) - 1 + SIDE
    same = around[place] == around[place + lag]
    place, lag = place[same], lag[same]
    left, right = np.ones((2, len(lag)), bool)
    for j in range(1, min(SIDE, int(step.min()) // 2) + 1):  # one side has at least (s - 1) / 2 equal neighbours
        left &= around[place - j] == around[place + lag - j]
        right &= around[place + j] == around[np.minimum(place + lag + j, len(around) - 1)]
    return np.unique(lag[left | right])


def scan(ids: np.ndarray, low: int, high: int, least: int = LEAST) -> np.ndarray:
    """Rows of (start, length, period) of all runs with periods low..high, by start, then length.

    Of periods that share a stretch, the least is named.
    """
    found = [np.zeros((0, 3), np.int64)]
    for lag in equal_lags(ids, low, high, least):
        ends = np.concatenate([[-1], np.flatnonzero(ids[:-lag] != ids[lag:]), [len(ids) - lag]])
        equal = np.diff(ends) - 1
        long = equal >= max(least - lag, lag)
        found.append(np.stack([ends[:-1][long] + 1, equal[long] + lag, np.full(long.sum(), lag)], axis=1))
    return distinct(np.concatenate(found))


def distinct(runs: np.ndarray) -> np.ndarray:
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words without those that a run contains after its first period, joined by one space."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words).decode("utf-8")


def _rows(keys: pa.Array, key: str, sizes: list[int], runs: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
    flat = np.concatenate([np.zeros((0, 3), np.int64), *(r[np.lexsort((r[:, 2], r[:, 0]))] for r in runs)])
    ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
    fields = pa.StructArray.from_arrays([pa.array(flat[:, j].copy()) for j in range(3)], fields=list(_RUN))
    columns = [keys, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, fields), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [key, "n_words", "runs", "collapsed"])


def _scan_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = [t.split() for t in batch.column("data").to_pylist()]
        runs = [scan(word_ids(w), 1, len(w) // 2) for w in words]
        yield _rows(batch.column("doc_id"), "doc_id", list(map(len, words)), runs, list(map(collapsed, words, runs)))


def lag_ranges(n: int) -> list[tuple[int, int]]:
    """Ranges that make up the lags 1..n/2, of about the same number of comparisons each."""
    top = n // 2
    parts = min(RANGES, max(1, -(-3 * n * n // 8 // RANGE_WORK)), max(1, top))
    done = np.cumsum(n - np.arange(1, top + 1, dtype=np.int64))
    if not top:
        return []
    cuts = np.searchsorted(done, done[-1] * np.arange(1, parts) // parts) + 1
    edges = [0, *np.unique(cuts).tolist(), top]
    return [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for row, data in zip(batch.column("_row").to_pylist(), batch.column("data").to_pylist(), strict=True):
            ids = word_ids(data.split())
            for low, high in lag_ranges(len(ids)):
                yield pa.RecordBatch.from_pydict({"_row": [row], "low": [low], "high": [high], "ids": [ids.tobytes()]})


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for r in batch.to_pylist():
            runs = scan(np.frombuffer(r["ids"], np.int32), r["low"], r["high"])
            columns = [pa.array(np.full(len(runs), r["_row"], np.int64)), *(pa.array(runs[:, j].copy()) for j in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "start", "length", "period"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = [t.split() for t in batch.column("data").to_pylist()]
        runs = [np.array([(r["start"], r["length"], r["period"]) for r in found or ()], np.int64).reshape(-1, 3) for found in batch.column("runs").to_pylist()]
        yield _rows(batch.column("doc_id"), "doc_id", list(map(len, words)), runs, list(map(collapsed, words, runs)))


def periodic_runs(docs: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Runs of the words of each row's whole text (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the text's words
    without what runs repeat), one row per row. A null or empty text has no words and no runs. Repeated rows
    and a null doc_id are rows like others; an empty table gives no rows. ``long_bytes`` decides which way a
    text takes, never what comes out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("data"))
    out = f"doc_id bigint, n_words bigint, {RUNS}, collapsed string"
    short = rows.where(F.octet_length("data") <= long_bytes).mapInArrow(_scan_texts, out)
    long = saved(rows.where(F.octet_length("data") > long_bytes).withColumn("_row", F.monotonically_increasing_id()), "long")
    dealt = long.select("_row", "data").mapInArrow(_deal, "_row bigint, low bigint, high bigint, ids binary")
    runs = dealt.repartition(F.col("_row"), F.col("low")).mapInArrow(_scan_ranges, "_row bigint, start bigint, length bigint, period bigint")
    runs = runs.groupBy("_row", "start", "length").agg(F.min("period").alias("period"))
    runs = runs.groupBy("_row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.unionAll(long.join(runs, "_row", "left").select("doc_id", "data", "runs").mapInArrow(_collapse, out))


def looped(doc_id: Column, text: Column) -> Column:
    """``text``, or for a tenth of the ids its words with all from one place on in a loop: what op12 scans.

    A row without doc_id keeps its text.
    """
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    loop = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, 1, a), F.slice(loop, 1, n - a)), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), whole_text()).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), lines.alias("lines"), "collapsed")
    text = F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", "n_runs", F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-F.col("best.l") * 1000 / F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode(F.col("collapsed"), "UTF-8"), 256).alias("collapsed_sha256"),
    )
