"""Operator 9: token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their numbers of tokens, broadcast. Which ones are
frequent the vocabulary tells: a merge earned its entry by its frequency, so the entries that are whole
pre-tokens are the table, and its size is bounded by the vocabulary's whatever the corpus. Tier two is
each worker's cache, which has the library encode what the table lacks. The corpus is read once, and
nothing of it is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, whole_text

# fixed value: how the byte-level pre-tokenizer splits a text
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the broadcast table at most, those with the least ids: the earliest merges.
TABLE_PIECES = 65_536
#: Longer pre-tokens stay out of the table, so that its size has a bound.
TABLE_PIECE_CHARS = 64
CACHE_PIECES = 500_000


def special_strings(tokenizer_json: str) -> list[str]:
    """Strings that the library turns into one token wherever they stand in a text."""
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only a plain byte-level pre-tokenizer is supported")
    added = spec.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return [t["content"] for t in added]


class PieceTable:
    """Pre-tokens in one string with their ends and numbers of tokens: what is broadcast."""

    def __init__(self, counts: dict[str, int]):
        self.pieces = "".join(counts)
        self.ends = list(accumulate(map(len, counts)))
        self.counts = list(counts.values())

    def expand(self) -> dict[str, int]:
        starts = [0, *self.ends]
        return {self.pieces[a:b]: n for a, b, n in zip(starts, self.ends, self.counts, strict=False)}


class PieceCounter(dict):
    """Number of tokens of a pre-token: of the table or the cache, else from the library."""

    def __init__(self, tokenizer_json: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(table)
        self.table = table
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = special_strings(tokenizer_json)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) >= CACHE_PIECES:
            self.clear()
            self.update(self.table)
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))


def frequent_pieces(tokenizer_json: str) -> list[str]:
    """Entries of the vocabulary that are whole pre-tokens, in the order of their ids.

    Which ones these are decides about speed alone, never about results.
    """
    from tokenizers import Tokenizer, decoders

    special, split, text = set(special_strings(tokenizer_json)), regex.compile(PATTERN).findall, decoders.ByteLevel()
    vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=False)
    found = (text.decode([token]) for token in sorted(vocabulary, key=vocabulary.__getitem__))
    whole = [p for p in found if 0 < len(p) <= TABLE_PIECE_CHARS and "\ufffd" not in p and p not in special and split(p) == [p]]
    return list(dict.fromkeys(whole))[:TABLE_PIECES]


_counters: dict = {}


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 512) -> DataFrame:
    """Tokens of the whole text of each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row. A null text counts
    as empty: no bytes, no tokens. Nothing is truncated or padded; added special strings inside a text
    count as the library's default has it, one token each.
    """
    driver = PieceCounter(tokenizer_json, {})
    table = docs.sparkSession.sparkContext.broadcast((tokenizer_json, PieceTable({p: driver[p] for p in frequent_pieces(tokenizer_json)})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, compact = table.value
        key = id(compact)
        if key not in _counters:
            _counters.clear()
            _counters[key] = (PieceCounter(spec, compact.expand()), compact)
        counter = _counters[key][0]
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array([counter.count(t) for t in texts], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = _texts(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return count_tokens(documents(spark, sf_dir), f.read())
