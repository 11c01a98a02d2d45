"""Operator 10: repeated substrings by an enhanced suffix array and its common-prefix interval tree.

Every string of LENGTH bytes that starts at two places is found, and all bytes that such strings cover are
removed. The suffixes that are sorted are those at anchors. An anchor is a gram whose hash is the least
in some window of LENGTH bytes; equal windows have equal anchors at equal places, so whatever repeats
shares an anchor, and less than one byte in a hundred is one. Only anchors whose gram occurs twice go on,
with the bytes around them that a window through them can reach (their context).

The contexts of one gram are sorted by what follows the anchor; neighbours' common prefixes make the
array an enhanced one. A scan with a stack gives the tree of common-prefix intervals. In an interval of
depth d all members agree on d bytes from the anchor on; sorted by what precedes the anchor, they show
how far each one's left extension has a match, and where the extensions differ the repeat is maximal. The
group is put out with all of its occurrences, each with its reach to both sides.

Equal texts are one text and equal contexts one context, so groups of copies and common passages meet in
map-side aggregation. A gram with more than GROUP different contexts is split by the windows' places:
windows of a range of places share a core, which is the key of a smaller group, so no pair is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lookup, pieces, saved, whole_text

LENGTH = 400
GRAM = 128
#: Contexts of one gram that are sorted in one task.
GROUP = 4_096
#: Bytes that are hashed at once: bounds a worker's memory for texts of any length.
CHUNK = 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_FACTOR = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _tables:
        up = np.multiply.accumulate(np.full(size, _FACTOR, np.uint64))
        down = np.multiply.accumulate(np.full(size, pow(_FACTOR, -1, 1 << 64), np.uint64))
        _tables[size] = (up, down)
    return _tables[size]


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over each run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, fill, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of ``data``."""
    places, hashes = [], []
    for at in range(0, max(1, len(data) - length + 1), CHUNK):
        part = np.frombuffer(data[at : at + CHUNK + length - 1], np.uint8)
        if len(part) < length:
            continue
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        width = length - gram + 1
        least = _sliding(h, width, np.minimum, (1 << 64) - 1)
        around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        around[width - 1 : width - 1 + len(least)] = least
        chosen = np.flatnonzero(h == _sliding(around, width, np.maximum, 0))
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a sorted array, bottom up: depth, first and last member of each interval.

    ``prefixes[i]`` is the common prefix of members i and i + 1.
    """
    stack: list[tuple[int, int]] = []  # depth and first member of the open intervals
    for i, depth in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            open_depth, first = stack.pop()
            yield open_depth, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _right_intervals(contexts: list[tuple[bytes, int]], before: list[bytes], gram: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Depth, members in the order of what precedes them, and the child of each context of the intervals of
    ``contexts`` (different bytes, place of the anchor in them), sorted by what follows the anchor."""
    right = [c[left:] for c, left in contexts]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    prefixes = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    children = [0] * len(contexts)
    for depth, first, last in intervals(prefixes):
        if depth < gram:
            continue
        child = children[order[first]] = 0
        for i in range(first, last):
            child += prefixes[i] == depth
            children[order[i + 1]] = child
        yield depth, sorted(order[first : last + 1], key=before.__getitem__), children


def repeat_groups(contexts: list[tuple[bytes, int]], gram: int = GRAM, length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """The maximal repeats of at least ``length`` bytes through the anchor of ``contexts``: the bytes before
    the anchor and from it on, and all members that have them.

    Members of an interval share all that follows down to its depth. Sorted by what precedes, they have an
    interval tree of their own, whose depths are left extensions at which members differ. Where these
    come from one child of the interval, the child gives the same with more bytes to the right: only
    left intervals that hold members of two children are maximal on both sides.
    """
    before = [c[:left][::-1] for c, left in contexts]
    for depth, members, children in _right_intervals(contexts, before, gram):
        pairs = list(zip(members, members[1:], strict=False))
        # How many neighbours up to each member come from different children.
        changes = list(accumulate((children[a] != children[b] for a, b in pairs), initial=0))
        for left, low, high in intervals([common_prefix(before[a], before[b]) for a, b in pairs]):
            if left + depth >= length and changes[low] != changes[high]:
                yield left, depth, members[low : high + 1]


def reaches(contexts: list[tuple[bytes, int]], repeated: list[bool], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int] | None]:
    """How far repeated strings of ``length`` bytes through each context's anchor reach, before and after
    its start. ``repeated`` marks contexts that themselves occur twice.

    All of these strings hold the anchor's gram, so what they cover is one run of bytes. It takes no groups
    for that, only neighbours: a context reaches farthest left with a neighbour, and where that is of the
    same child, the child has told as much with a longer reach to the right.
    """
    low, high = [-1] * len(contexts), [0] * len(contexts)
    for m, ((c, left), twice) in enumerate(zip(contexts, repeated, strict=True)):
        if twice and len(c) >= length:
            low[m], high[m] = left, len(c) - left
    before = [c[:left][::-1] for c, left in contexts]
    for depth, members, children in _right_intervals(contexts, before, gram) if len(contexts) > 1 else ():
        a = members[0]
        for b in members[1:]:
            if children[a] != children[b]:
                left = common_prefix(before[a], before[b])
                if left + depth >= length:
                    for m in (a, b):
                        low[m], high[m] = max(low[m], left), max(high[m], depth)
            a = b
    return [(a, b) if a >= 0 else None for a, b in zip(low, high, strict=True)]


def named_repeats(
    contexts: list[tuple[bytes, int]], repeated: list[bool], length: int = LENGTH, gram: int = GRAM, around: int | None = None
) -> list[list[tuple[bytes, int, int, bool]]]:
    """For each context its repeats: the string's digest, its bytes, how many come before the anchor, and
    whether it is known to end there. ``around`` is what contexts hold beyond a window, None if they were cut.

    Only strings count in which the gram is an anchor by their own bytes: all occurrences of such a string
    have that anchor, so the group misses none. Each repeat has at least one.
    """
    out: list[list[tuple[bytes, int, int, bool]]] = [[] for _ in contexts]
    alone = [(left, len(c) - left, [m]) for m, ((c, left), twice) in enumerate(zip(contexts, repeated, strict=True)) if twice and len(c) >= length]
    for left, depth, members in [*alone, *(repeat_groups(contexts, gram, length) if len(contexts) > 1 else ())]:
        c, at = contexts[members[0]]
        string = c[at - left : at + depth]
        if left not in anchors(string, length, gram)[0]:
            continue
        most_left, most_right = max(contexts[m][1] for m in members), max(len(contexts[m][0]) - contexts[m][1] for m in members)
        whole = (left < most_left or (around is not None and left < length - gram + around)) and (
            depth < most_right or (around is not None and depth < length + around)
        )
        name = hashlib.blake2b(string, digest_size=16).digest()
        for m in members:
            out[m].append((name, left + depth, left, whole))
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _text_keys(data: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    digests = [hashlib.sha256(x).digest() for x in data]
    return digests, np.frombuffer(b"".join(d[:16] for d in digests), np.int64).reshape(-1, 2)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("data"))


def _gram_lists(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, ka, kb (128 bits that stand for the text), sha, n_bytes, grams and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data = batch.column("data").to_pylist()
            digests, keys = _text_keys(data)
            ends, grams, counts = np.zeros(len(data) + 1, np.int32), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, x in enumerate(data):
                values, n = np.unique(anchors(x, length, gram)[1], return_counts=True)
                grams.append(values)
                counts.append(n)
                ends[i + 1] = ends[i] + len(values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([d.hex() for d in digests], pa.string()),
                    pa.array([len(x) for x in data], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(grams))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts).astype(np.int32))),
                ],
                ["doc_id", "ka", "kb", "sha", "n_bytes", "grams", "counts"],
            )

    schema = "doc_id bigint, ka bigint, kb bigint, sha string, n_bytes bigint, grams array<bigint>, counts array<int>"
    return _rows(docs).mapInArrow(run, schema)


def _contexts(texts: DataFrame, length: int, gram: int, around: int = 0) -> DataFrame:
    """For each text (ka, kb, data, wanted grams) and different context: g, ca, cb (128 bits that stand for
    it), the place of the anchor in it, the context and the anchor's places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for ka, kb, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "data", "wanted")), strict=True):
                place, value = anchors(data, length, gram)
                value = value.view(np.int64)
                chosen = np.isin(value, np.array(wanted, np.int64))
                found: dict[tuple, list[int]] = {}
                for p, g in zip(place[chosen].tolist(), value[chosen].tolist(), strict=True):
                    left = min(p, length - gram + around)
                    found.setdefault((g, left, data[p - left : p + length + around]), []).append(p)
                for (g, left, context), places in found.items():
                    code = np.frombuffer(hashlib.blake2b(context + left.to_bytes(4, "big"), digest_size=16).digest(), np.int64)
                    out.append((g, int(code[0]), int(code[1]), left, context, ka, kb, places))
            for at in range(0, len(out), 4096):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out[at : at + 4096]], schema)

    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    schema = pa.schema(list(zip(["g", "ca", "cb", "anchor", "context", "ka", "kb", "places"], kinds, strict=True)))
    return texts.mapInArrow(
        run, "g bigint, ca bigint, cb bigint, anchor int, context binary, ka bigint, kb bigint, places array<int>"
    )


#: What a scan tells of a context: how far repeats reach, or which ones there are.
REACH = "before int, after int"
NAMED = "repeats array<struct<name: binary, n_bytes: int, before: int, whole: boolean>>"


def _scanned(contexts: DataFrame, length: int, gram: int, names: bool = False, around: int | None = None) -> DataFrame:
    """g, ca, cb and REACH (with ``names`` NAMED) for contexts with a repeat; a gram's contexts meet in one task."""

    def finish(g: int, rows: list[tuple]) -> list[tuple]:
        own, twice = [(c, a) for _, _, a, c, _ in rows], [r[4] for r in rows]
        if names:
            fields = ("name", "n_bytes", "before", "whole")
            got = [[[dict(zip(fields, r, strict=True)) for r in x]] if x else None for x in named_repeats(own, twice, length, gram, around)]
        else:
            got = reaches(own, twice, length, gram)
        return [(g, r[0], r[1], *x) for r, x in zip(rows, got, strict=True) if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if g != now:
                    if rows:
                        out += finish(now, rows)
                    now, rows = g, []
                rows.append(tuple(row))
            yield table(out)
            out = []
        if rows:
            yield table(finish(now, rows))

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    columns = ["g", "ca", "cb", "anchor", "context", "twice"]
    told = [(n, pa.int32()) for n in ("before", "after")]
    if names:
        told = [("repeats", pa.list_(pa.struct([("name", pa.binary()), ("n_bytes", pa.int32()), ("before", pa.int32()), ("whole", pa.bool_())])))]
    schema = pa.schema([(n, pa.int64()) for n in ("g", "ca", "cb")] + told)
    dealt = contexts.select(*columns).repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, f"g bigint, ca bigint, cb bigint, {NAMED if names else REACH}")


def _merged(rows: DataFrame) -> DataFrame:
    """Different contexts of ``rows``: g, ca, cb, anchor, context, least and most owner, uses, twice."""
    out = rows.groupBy("g", "ca", "cb").agg(
        F.first("anchor").alias("anchor"), F.first("context").alias("context"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("uses"),
    )
    return out.withColumn("twice", F.col("least") != F.col("most"))


def _crowded(contexts: DataFrame, group: int) -> DataFrame:
    return saved(contexts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group), "crowded", 1 + contexts.count() // group)


def _all_scanned(contexts: DataFrame, length: int, gram: int, group: int, names: bool = False, around: int = 0) -> DataFrame:
    """What a scan tells of all contexts; grams with more than ``group`` of them are split by places of windows."""
    told = ["repeats"] if names else ["before", "after"]
    crowded = _crowded(contexts, group)
    if crowded.isEmpty():
        return _scanned(contexts, length, gram, names, around)
    flagged = saved(lookup(contexts, crowded, ["g"], "m", max(1, contexts.count()), F.xxhash64("ca")), "flagged")
    out = _scanned(flagged.where("m IS NULL"), length, gram, names, around)
    left = length - gram
    # Each row is an original context (g, ca, cb) in the group of one range of window places [low, high].
    members = flagged.where("m IS NOT NULL").select(
        "g", "ca", "cb", "anchor", "context", "least", "most", F.lit(-left).alias("low"), F.lit(0).alias("high")
    )
    while True:
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.when(F.col("low") < F.col("high"), F.array(F.struct(F.col("low").alias("l"), mid.alias("h")), F.struct((mid + 1).alias("l"), F.col("high").alias("h"))))
        halves = F.coalesce(halves, F.array(F.struct(F.col("low").alias("l"), F.col("high").alias("h"))))
        rows = members.withColumn("_half", F.explode(halves)).withColumn("low", F.col("_half.l")).withColumn("high", F.col("_half.h")).drop("_half")
        core_from, core_to = F.col("anchor") + F.col("high"), F.col("anchor") + F.col("low") + length
        rows = rows.where((core_from >= 0) & (core_to <= F.octet_length("context")))
        begin = F.greatest(F.lit(0), F.col("anchor") + F.col("low"))
        end = F.least(F.octet_length("context"), F.col("anchor") + F.col("high") + length)
        cut = F.substring(F.col("context"), begin + 1, end - begin)
        rows = rows.select(
            "g", "ca", "cb", "anchor", "context", "least", "most", "low", "high",
            F.xxhash64("g", "low", "high", F.substring(F.col("context"), core_from + 1, core_to - core_from)).alias("sub"),
            cut.alias("cut"), (F.col("anchor") - begin).alias("cut_anchor"),
        )
        rows = rows.withColumn("sa", F.xxhash64("cut", "cut_anchor")).withColumn("sb", F.xxhash64("cut_anchor", "cut", F.lit(1)))
        rows = saved(rows, "members")
        smaller = saved(
            _merged(rows.select(F.col("sub").alias("g"), F.col("sa").alias("ca"), F.col("sb").alias("cb"), F.col("cut_anchor").alias("anchor"), F.col("cut").alias("context"), "least", "most")),
            "smaller",
        )
        again = _crowded(smaller, group)
        marked = saved(lookup(smaller, again, ["g"], "m", max(1, smaller.count()), F.xxhash64("ca")), "marked")
        done = saved(_scanned(marked.where("m IS NULL"), length, gram, names), "done")
        uses = smaller.select("g", "ca", "cb", "uses").join(done, ["g", "ca", "cb"])
        uses = uses.select(F.col("g").alias("sub"), F.col("ca").alias("sa"), F.col("cb").alias("sb"), "uses", *told)
        back = lookup(rows.select("g", "ca", "cb", "sub", "sa", "sb"), uses, ["sub", "sa", "sb"], "uses", max(1, rows.count()), F.xxhash64("ca"), matched=True)
        out = out.union(back.select("g", "ca", "cb", *told))
        if again.isEmpty():
            merged = [F.array_distinct(F.flatten(F.collect_set("repeats"))).alias("repeats")] if names else [F.max(c).alias(c) for c in told]
            return out.groupBy("g", "ca", "cb").agg(*merged)
        hot = again.select(F.col("g").alias("sub"), "m")
        members = lookup(rows.drop("cut", "cut_anchor", "sa", "sb"), hot, ["sub"], "m", max(1, rows.count()), F.xxhash64("ca"), matched=True)
        members = members.drop("sub", "m")


#: Runs of bytes, the end not included.
SPANS = "array<struct<start: bigint, end: bigint>>"


def _removed(texts: DataFrame) -> DataFrame:
    """ka, kb, runs (the maximal ones), kept_sha of texts (ka, kb, data, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            joined, kept = [], []
            for data, own in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in own):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                rest, at = hashlib.sha256(), 0
                for a, b in runs:
                    rest.update(data[at:a])
                    at = b
                rest.update(data[at:])
                joined.append([{"start": a, "end": b} for a, b in runs])
                kept.append(rest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("ka"), batch.column("kb"), pa.array(joined, span), pa.array(kept, pa.string())], ["ka", "kb", "runs", "kept_sha"]
            )

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return texts.mapInArrow(run, f"ka bigint, kb bigint, runs {SPANS}, kept_sha string")


def _indexed(docs: DataFrame, length: int, gram: int, around: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Every row, the different texts, those with repeated grams, the contexts of these, and the number of rows."""
    every = saved(_gram_lists(docs, length, gram), "gram-lists")
    total = max(1, every.count())
    texts = saved(
        every.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("one")), "texts", total
    )
    single = every.select("ka", "kb", F.inline(F.arrays_zip("grams", "counts"))).withColumnRenamed("grams", "g")
    # Copies are one text. From here on two texts with one ka would only look for each other's grams too.
    single = saved(single.groupBy("ka", "kb", "g").agg(F.max("counts").alias("n")).select("ka", "g", "n"), "text-grams")
    table = saved(single.groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size")).where("n > 1").select("g", "size"), "repeated-grams", single.count())
    wanted = lookup(single.select("ka", "g"), table, ["g"], "size", max(1, single.count()), F.xxhash64("ka", "g"), matched=True)
    wanted = saved(wanted.groupBy("ka").agg(F.collect_list("g").alias("wanted")), "wanted")
    rows = _rows(docs).withColumn("_one", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_sha", F.sha2("data", 256))
    own = texts.join(wanted, "ka").withColumn("_head", F.concat(_hex_key("ka"), _hex_key("kb")))
    held = rows.join(own, (rows["_one"] == own["one"]) & (F.substring("_sha", 1, 32) == F.col("_head"))).select("ka", "kb", "data", "wanted")
    held = saved(held, "held-texts")
    return every, texts, held, saved(_contexts(held, length, gram, around), "contexts"), total


def _owned(found: DataFrame) -> DataFrame:
    """The different contexts, each told whether it occurs twice."""
    owner = found.withColumn("least", F.struct("ka", "kb", F.array_min("places").alias("p"))).withColumn(
        "most", F.struct("ka", "kb", F.array_max("places").alias("p"))
    )
    return saved(_merged(owner), "merged")


def repeated_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """What repeats in ``docs`` (doc_id, text; other columns are ignored), as bytes of UTF-8.

    Each byte that is covered by a string of ``length`` bytes which also starts anywhere else, in the same
    text or another row's, is to go; strings do not cross rows and are judged on the input. Returns one
    row per row: doc_id, n_bytes, text_sha256, spans (the maximal runs to go, from start up to end) and
    kept_sha256 (of the bytes that stay; :func:`without_repeats` gives these). A null text counts as
    empty; repeated rows are copies of each other, also with one doc_id or none. An empty table gives
    an empty result.
    """
    every, texts, held, found, total = _indexed(docs, length, gram)
    contexts = _owned(found)
    reach = _all_scanned(contexts, length, gram, group)
    reach = saved(contexts.select("g", "ca", "cb", "uses").join(reach, ["g", "ca", "cb"]), "reaches", contexts.count())
    spans = lookup(found.select("g", "ca", "cb", "ka", "kb", "places"), reach, ["g", "ca", "cb"], "uses", max(1, found.count()), F.xxhash64("ka", "ca"), matched=True)
    spans = spans.select("ka", "kb", "before", "after", F.explode("places").alias("p"))
    spans = spans.groupBy("ka", "kb").agg(F.collect_set(F.struct((F.col("p") - F.col("before")).alias("a"), (F.col("p") + F.col("after")).alias("b"))).alias("spans"))
    cut = _removed(held.select("ka", "kb", "data").join(spans, ["ka", "kb"])).dropDuplicates(["ka", "kb"])
    known = saved(texts.select("ka", "kb", "copies").join(cut, ["ka", "kb"], "left").where("copies > 1 OR kept_sha IS NOT NULL"), "known", total)
    out = lookup(every.select("doc_id", "ka", "kb", "sha", "n_bytes"), known, ["ka", "kb"], "copies", total, F.xxhash64("doc_id", "ka"))
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        "doc_id", "n_bytes", F.col("sha").alias("text_sha256"),
        F.when(whole, all_of_it).otherwise(F.coalesce("runs", F.array().cast(SPANS))).cast(SPANS).alias("spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, spans and kept (the bytes that stay: a cut may fall inside a character) for each row of ``docs``.

    Texts are cut in rows of their own; a text that many rows have brings its spans to each of them.
    Nulls, repeats and empty tables are as in :func:`repeated_substrings`.
    """
    found = repeated_substrings(docs, length, gram, group).where(F.size("spans") > 0)
    table = found.groupBy(F.xxhash64("text_sha256").alias("_k"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("_n"), F.first("spans").alias("spans"))
    rows = _rows(docs).withColumn("_sha", F.sha2("data", 256)).withColumn("_k", F.xxhash64("_sha"))
    rows = lookup(rows, saved(table, "spans-of-texts"), ["_k", "_sha"], "_n", max(1, rows.count()), F.xxhash64("doc_id", "_sha"))
    # What stays is what lies between the spans: from each one's end to the next one's start.
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length("data").cast("bigint")))
    between = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("data"), (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.when(F.col("spans").isNull(), F.col("data")).otherwise(F.aggregate(between, F.lit(b""), lambda acc, x: F.concat(acc, x)))
    return rows.select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), kept.alias("kept"))


def maximal_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, around: int = 1024) -> DataFrame:
    """All maximal repeats of at least ``length`` bytes among the different texts of ``docs`` (doc_id, text),
    a row for each occurrence: repeat (32 digits that stand for the string), n_bytes, whole, doc_id, copies,
    start.

    A repeat is maximal if its occurrences do not all have the same byte before or after them. Equal texts
    are one text, under its least doc_id (null where no row has one) with the number of its rows as
    ``copies``. A string is seen as far as ``around`` bytes beyond a window around an anchor: repeats up to
    length + around bytes come whole, longer ones in overlapping pieces, whose ``whole`` is false, as it
    may be for grams with more than ``group`` different contexts, which are cut. Every row has its string
    there, and every string all its occurrences. A null text counts as empty; an empty table gives an
    empty result.
    """
    _, texts, _, found, _ = _indexed(docs, length, gram, around)
    contexts = _owned(found)
    named = _all_scanned(contexts, length, gram, group, True, around)
    named = saved(contexts.select("g", "ca", "cb", "uses").join(named, ["g", "ca", "cb"]), "named", contexts.count())
    rows = lookup(found.select("g", "ca", "cb", "ka", "kb", "places"), named, ["g", "ca", "cb"], "uses", max(1, found.count()), F.xxhash64("ka", "ca"), matched=True)
    rows = rows.select("ka", "kb", F.inline("repeats"), "places").withColumn("p", F.explode("places"))
    rows = rows.groupBy(F.lower(F.hex("name")).alias("repeat"), "n_bytes", "ka", "kb", (F.col("p") - F.col("before")).cast("bigint").alias("start"))
    rows = rows.agg(F.max("whole").alias("whole")).join(texts, ["ka", "kb"])
    doc_id = F.when(F.col("one") != -(1 << 63), F.col("one")).alias("doc_id")
    return rows.select("repeat", F.col("n_bytes").cast("bigint").alias("n_bytes"), "whole", doc_id, "copies", "start")


def _hex_key(column: str):
    """The 16 hexadecimal digits of the 8 bytes, in little-endian order, that ``column`` was read from."""
    h = F.lpad(F.hex(F.col(column)), 16, "0")
    return F.lower(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of what :func:`repeated_substrings` finds in documents."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return repeated_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256"
    )
