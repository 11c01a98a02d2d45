"""Operator 1: byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can stand last in the encoding of that
prefix. :class:`PrefixBpe` stores it for every prefix: the token ending at byte i is valid if it may
follow the last token of the prefix before it. The whole encoding is read off backwards. Since a
prefix's entry never depends on later bytes, appending continues the table, and after an edit the table
is computed anew only from the edit on, until it agrees with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, whole_text

#: Pieces that a worker remembers; as many of the time before are kept as well.
CACHE_PIECES = 150_000
#: Pairs of tokens of which it remembers whether they may stand side by side.
CACHE_PAIRS = 100_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a rank file (a base64 token and its rank in each line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixBpe:
    """Byte-pair encoding of single pieces over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self._ending = ahocorasick.Automaton()  # finds the tokens that end at each byte
        for token in ranks:
            self._ending.add_word(token.decode("latin-1"), token)
        self._ending.make_automaton()
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._halves: dict[bytes, tuple[bytes, bytes]] = {}
        self._left: dict[bytes, tuple] = {}
        self._right: dict[bytes, tuple] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge is made last when ``token`` is formed."""
        if token not in self._halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(
                    ((self.ranks[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.ranks),
                    default=None,
                )
                if best is None:
                    raise ValueError(f"token {token!r} cannot be formed by merges")
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (parts[0], parts[1])
        return self._halves[token]

    def _edge(self, token: bytes, side: int, known: dict) -> tuple:
        """Tokens that stand at one edge of ``token`` while it is formed, each with the rank of the
        merge that makes it and of the merge that consumes it."""
        if token not in known:
            out, end, x = [], inf, token
            while True:
                born = self.ranks[x] if len(x) > 1 else -1
                out.append((x, born, end))
                if len(x) == 1:
                    break
                end, x = born, self.halves(x)[side]
            known[token] = tuple(out)
        return known[token]

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` is made when ``a + b`` is encoded.

        Of equal merges the leftmost comes first: one inside ``a`` before one across the border, and
        that before one inside ``b``.
        """
        ranks = self.ranks
        for x, born_x, end_x in self._edge(a, 1, self._right):
            for y, born_y, end_y in self._edge(b, 0, self._left):
                rank = ranks.get(x + y)
                if rank is not None and rank < end_x and rank <= end_y and born_x < end_y and born_y < end_x:
                    return False
        return True

    def extend(self, data: bytes, last: list[bytes]) -> list[bytes]:
        """Append to ``last``, the last tokens of the prefixes of ``data`` so far, those of the others."""
        pairs, begin = self._pairs, max(0, len(last) + 1 - self.longest)
        for end, token in self._ending.iter(data.decode("latin-1"), begin):
            if end < len(last):
                continue
            start = end + 1 - len(token)
            if start:
                pair = (last[start - 1], token)
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = self.may_follow(*pair)
                if not ok:
                    continue
            last.append(token)
        assert len(last) == len(data), "every prefix has a last token"
        return last

    def tokens(self, last: list[bytes]) -> list[int]:
        """Ranks of the encoding that the last tokens of the prefixes describe."""
        out, i = [], len(last)
        while i:
            out.append(self.ranks[last[i - 1]])
            i -= len(last[i - 1])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        return self.tokens(self.extend(data, []))

    def edit(self, old: bytes, last: list[bytes], start: int, end: int, new: bytes) -> tuple[bytes, list[bytes], int]:
        """Replace old[start:end] by ``new``: the new bytes, their last tokens, the number computed anew.

        Once ``longest`` entries in a row after the edit are those of the old table, all later ones are.
        """
        data = old[:start] + new + old[end:]
        out, shift, same = last[:start], len(new) - (end - start), 0
        while len(out) < len(data):
            self.extend(data[: len(out) + 1], out)
            i = len(out)
            if i > start + len(new):
                same = same + 1 if out[-1] == last[i - 1 - shift] else 0
                if same >= self.longest:
                    fresh = i - start
                    out.extend(last[i - shift :])
                    return data, out, fresh
        return data, out, len(data) - start


def ascii_pattern(pattern: str) -> str:
    """A pattern for ASCII texts, where letters are A-Za-z and numbers 0-9: other modules can run it faster."""
    out, inside = [], False
    for x in regex.findall(r"\\p\{\w+\}|\\.|.", pattern):
        inside = (inside or x == "[") and x != "]"
        plain = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(x)
        out.append(x if plain is None else plain if inside else f"[{plain}]")
    return "".join(out)


class TextEncoder:
    """Encodes texts: each match of ``pattern`` is a piece of its own. No special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = PrefixBpe(ranks)
        self._split = regex.compile(pattern).findall
        self._split_ascii = re.compile(ascii_pattern(pattern), re.ASCII).findall
        self.bytes_of: list[bytes] = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.digits = list(map(str, range(len(self.bytes_of))))
        outer = self

        class Cache(dict):
            before: dict = {}

            def __missing__(self, piece: str) -> list[int]:
                ids = self.before.get(piece)
                if ids is None:
                    ids = outer.bpe.encode(piece.encode("utf-8"))
                if len(self) >= CACHE_PIECES:
                    self.before = dict(self)
                    self.clear()
                self[piece] = ids
                return ids

        self.cache = Cache()

    def split(self, text: str) -> list[str]:
        return self._split_ascii(text) if text.isascii() else self._split(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split(text))))

    def written(self, ids: list[int]) -> str:
        """The ids in decimal, with one space between."""
        return " ".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict = {}


def _encoder(ranks, pattern: str) -> TextEncoder:
    """One encoder for each worker process and broadcast variable."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(read_ranks(ranks.value), pattern)
    return _encoders[key]


def _encoded(encoder: TextEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        offsets = np.zeros(len(texts) + 1, np.int32)
        parts = []
        for i, text in enumerate(texts):
            ids = np.array(encoder.encode(text), np.int32)
            offsets[i + 1] = offsets[i] + len(ids)
            parts.append(ids)
        values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"]
        )


def _id_lists(batch: pa.RecordBatch) -> Iterator[list[int]]:
    for ids in batch.column("ids"):
        yield ids.values.tolist() if ids.is_valid else []


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Encode the whole text of each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, ids array<int>, one row per row. A null text counts as empty and gives no ids. The
    rank file, of a size fixed by its vocabulary, is broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file)
    return _texts(docs).mapInArrow(lambda x: _encoded(_encoder(ranks, pattern), x), "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Decode the ids of each row: doc_id, ids, decoded binary. Null ids decode to no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in pieces(batches):
            decoded = pa.array([encoder.decode(ids) for ids in _id_lists(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def vocabulary(name: str) -> tuple[bytes, str]:
    """A public rank file's bytes and the pattern that goes with it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, with_ids: bool = True) -> DataFrame:
    """Each row's ids and digests of them and of what they decode to, made in one worker: doc_id, ids,
    n_tokens, ids_sha256, decoded_sha256. Nulls as in :func:`encode_documents`.

    Where ids are not asked for, as in the digest query, ``ids`` is left out.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in pieces(batches):
            lists = [encoder.encode(text) for text in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(map(len, lists), pa.int64()),
                "ids_sha256": pa.array([_sha256(encoder.written(ids).encode()) for ids in lists], pa.string()),
                "decoded_sha256": pa.array([_sha256(encoder.decode(ids)) for ids in lists], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _texts(docs).mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), *vocabulary("byte_bpe_50k.tiktoken"), with_ids=False)
