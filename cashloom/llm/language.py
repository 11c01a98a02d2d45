"""Operator 13: language identification by prediction by partial matching.

Each language has a context tree: how often each byte followed each context of up to ORDER bytes in its
texts. A byte costs -log2 of its share in the longest context known to the tree; where it was never seen
there, the context's escape (method C: d of n + d, for d different bytes in n) is paid and the next shorter
context asked, down to 8 bits for a byte never seen at all. Symbols are not excluded after an escape, and
statistics are frozen: scoring a text changes nothing. The language of the shortest code is predicted.

All trees are merged into one table of contexts and next bytes that holds every language's cost, escapes
of those that lack it included. Most bytes then need one lookup for all languages. Costs are integers, in
units of 2^-16 bits, so sums are exact and do not depend on how texts are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, pieces, whole_text
from .labelled import FIT_TEXT_BYTES, remainder

ORDER = 4
UNIT = 1 << 16
#: Bytes of the texts of all languages together that trees are built from, at most.
FIT_BYTES = 8 << 20
#: Texts of one language that its tree is built from, at most.
FIT_ROWS = 20_000
#: Languages that are learned, at most: those with the most rows.
LANGUAGES = 256
#: Bytes that are scored at once.
STEP_BYTES = 1 << 18
NO_LANGUAGE = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64((1 << 64) - 1)


class Index:
    """Position of each of some keys among ``keys`` (distinct, below 2^64 - 1), or -1, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.last, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.held, self.place = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = np.flatnonzero(self.place[slot] < 0)
            taken, own = np.unique(slot[free], return_index=True)
            own = free[own]
            self.held[taken], self.place[taken] = keys[left[own]], left[own]
            left, slot = np.delete(left, own), (np.delete(slot, own) + 1) & self.last

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        left, slot = slice(None), self._first(keys)
        while True:
            held, wanted = self.held[slot], keys[left]
            out[left] = np.where(held == wanted, self.place[slot], -1)
            go = np.flatnonzero((held != wanted) & (held != _EMPTY))
            if not len(go):
                return out
            left, slot = (go if isinstance(left, slice) else left[go]), (slot[go] + 1) & self.last


@dataclass
class Level:
    """Contexts of one length with what may follow, and every language's cost."""

    grams: np.ndarray  # sorted; a context's bytes and the next one, as an integer
    cost: np.ndarray  # languages x grams
    contexts: np.ndarray  # sorted
    escape: np.ndarray  # languages x contexts; 0 where the language lacks the context


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """The bytes before and at each place from ``order`` on, as one integer."""
    key = np.zeros(len(data) - order, np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | data[j : len(data) - order + j]
    return key


def _bits(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(part / whole) * UNIT).astype(np.int64)


def trees(samples: dict[str, list[bytes]], order: int = ORDER) -> tuple[list[str], list[Level]]:
    """Languages in their order, and the merged levels of their trees, shortest contexts first.

    Before a text stand ``order`` zero bytes, so that its first bytes have contexts of full length.
    """
    names = sorted(samples)
    counted = []
    for name in names:
        keys = np.concatenate([np.zeros(0, np.uint64), *(_keys(np.frombuffer(bytes(order) + t, np.uint8), order) for t in samples[name])])
        counted.append(np.unique(keys, return_counts=True))
    levels: list[Level] = []
    for k in range(order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own = []
        for keys, counts in counted:
            grams, inverse = np.unique(keys & mask, return_inverse=True)
            own.append((grams, np.bincount(inverse, weights=counts, minlength=len(grams))))
        grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in own)]))
        contexts, context_of = np.unique(grams >> np.uint64(8), return_inverse=True)
        cost, escape = np.zeros((len(names), len(grams)), np.int64), np.zeros((len(names), len(contexts)), np.int64)
        shorter = np.searchsorted(levels[-1].grams, grams & (mask >> np.uint64(8))) if k else None
        for i, (seen, counts) in enumerate(own):
            at = np.searchsorted(grams, seen)
            total = np.bincount(context_of[at], weights=counts, minlength=len(contexts))
            different = np.bincount(context_of[at], minlength=len(contexts))
            known = total > 0
            escape[i, known] = _bits(different[known], (total + different)[known])
            cost[i] = escape[i, context_of] + (levels[-1].cost[i, shorter] if k else 8 * UNIT)
            cost[i, at] = _bits(counts, (total + different)[context_of[at]])
        levels.append(Level(grams, cost.astype(np.int32), contexts, escape.astype(np.int32)))
    return names, levels


class Scorer:
    """Code lengths of whole texts under all trees."""

    def __init__(self, levels: list[Level], languages: int):
        self.levels, self.languages, self.order = levels, languages, len(levels) - 1
        self.index = [(Index(x.grams), Index(x.contexts)) for x in levels]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Texts x languages, in units of 2^-16 bits, int64."""
        gap = bytes(self.order)
        data = np.frombuffer(b"".join(x for t in texts for x in (gap, t)), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(text_of)) + (text_of + 1) * self.order
        total = np.zeros((len(texts), self.languages), np.int64)
        for at in range(0, len(place), STEP_BYTES):
            where, own = place[at : at + STEP_BYTES], text_of[at : at + STEP_BYTES]
            low, high = int(where[0]) - self.order, int(where[-1]) + 1
            self._add(_keys(data[low:high], self.order)[where - low - self.order], own, total)
        return total

    def _add(self, keys: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
        first, n = int(own[0]), int(own[-1] - own[0]) + 1
        own = own - first

        def add(which: np.ndarray, costs: np.ndarray, at: np.ndarray) -> None:
            for i in range(self.languages):  # integers below 2^53 are exact in the sums of bincount
                total[first : first + n, i] += np.bincount(which, weights=costs[i][at], minlength=n).astype(np.int64)

        for k in range(self.order, -1, -1):
            keys = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            grams, contexts = self.index[k]
            at = grams(keys)
            hit = at >= 0
            add(own[hit], self.levels[k].cost, at[hit])
            keys, own = keys[~hit], own[~hit]
            if not len(keys):
                return
            at = contexts(keys >> np.uint64(8))
            hit = at >= 0
            add(own[hit], self.levels[k].escape, at[hit])
        total[first : first + n] += np.bincount(own, minlength=n)[:, None] * 8 * UNIT


def language_sample(docs: DataFrame, usable: Column, total: int = FIT_BYTES, rows: int = FIT_ROWS, languages: int = LANGUAGES) -> dict[str, list[bytes]]:
    """Texts to learn each language from: at most ``rows`` of a language and ``total`` bytes of all.

    ``usable`` decides by doc_id which rows of ``docs`` (doc_id, text, lang) may be learned from; null or
    empty texts, null langs and texts beyond FIT_TEXT_BYTES are not. Each language has an equal share of the
    bytes, filled by a hash of (doc_id, text); of repeated rows one counts. At most ``languages`` are taken,
    those with the most rows.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.encode(whole_text(), "UTF-8").alias("data"))
    known = known.where(usable & F.col("lang").isNotNull() & F.octet_length("data").between(1, FIT_TEXT_BYTES))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return {}
    share = total // len(sizes)
    # A little more than the share is drawn before it is cut, so that the order by hash sees few rows.
    drawn = [(r["lang"], 1.2 * min(share / r["bytes"], rows / r["n"]) + 64 / r["n"]) for r in sizes]
    shares = docs.sparkSession.createDataFrame(drawn, "lang string, part double")
    order = F.xxhash64("doc_id", "data")
    chosen = known.join(F.broadcast(shares), "lang").where(F.pmod(order, F.lit(1 << 40)) < F.col("part") * (1 << 40))
    chosen = chosen.select("lang", "doc_id", "data", order.alias("hash")).distinct()
    before = W.partitionBy("lang").orderBy("hash", "doc_id", "data")
    chosen = chosen.select("*", F.sum(F.octet_length("data")).over(before).alias("held"), F.row_number().over(before).alias("nth"))
    out: dict[str, list[bytes]] = {}
    for r in chosen.where((F.col("held") <= share) & (F.col("nth") <= rows)).orderBy("lang", "nth").collect():
        out.setdefault(r["lang"], []).append(bytes(r["data"]))
    return out


_scorers: dict = {}


def predict_languages(docs: DataFrame, names: list[str], levels: list[Level]) -> DataFrame:
    """Language of the whole text of each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, lang_pred, score (the share that 2^-length of the predicted language has of all
    languages' sum) and bits (the length of its code), one row per row; the trees, of a bounded size, are
    broadcast. Of equal lengths the first language in the order of names counts. A text that is null or has
    no letter is NO_LANGUAGE with score 0 and no bits, and so is every text where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, merged = shared.value
        if id(merged) not in _scorers:
            _scorers.clear()
            _scorers[id(merged)] = Scorer(merged, len(own)), merged
        scorer = _scorers[id(merged)][0]
        for batch in pieces(batches):
            length = scorer.lengths(batch.column("data").to_pylist())
            best = length.argmin(axis=1)
            least = length[np.arange(len(best)), best]
            score = 1 / np.exp2((least[:, None] - length) / UNIT).sum(axis=1)
            columns = [batch.column("doc_id"), pa.array([own[i] for i in best], pa.string()), pa.array(score), pa.array(least / UNIT)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("data"))
    letters = F.col("data").rlike(r"\p{L}") if names else F.lit(False)
    told = rows.where(letters).select("doc_id", F.encode("data", "UTF-8").alias("data")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, bits double")
    none = rows.where(~letters).select("doc_id", F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    return told.unionAll(none)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    names, levels = trees(language_sample(docs, remainder(F.col("doc_id"), 5) != 0))
    return predict_languages(docs, names, levels).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
