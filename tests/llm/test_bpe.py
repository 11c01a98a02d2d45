from __future__ import annotations

import hashlib

import pytest
import tiktoken
from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from cashloom.llm import bpe
from cashloom.llm.token_counts import PieceCounter, PieceTable, count_tokens, op9_token_counts, special_strings

RANK_FILE, PATTERN = bpe.vocabulary("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(RANK_FILE)
OURS = bpe.TextEncoder(RANKS, PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(st.one_of(st.sampled_from("abcdeinrst  \n'.,!?é漢🙂0123"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_text_as_the_library(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode("utf-8")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(RANKS)), min_size=1, max_size=4).map(b"".join) | st.binary(min_size=1, max_size=40))
def test_piece_as_the_library(piece):
    assert OURS.bpe.encode(piece) == THEIRS._encode_single_piece(piece)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeinrst", min_size=1, max_size=60).map(str.encode), st.text("abcdeinrst", max_size=20).map(str.encode), st.integers(0, 60), st.integers(0, 10))
def test_append_and_edit(old, new, start, size):
    table = OURS.bpe.extend(old, [])
    assert OURS.bpe.extend(old + new, list(table)) == OURS.bpe.extend(old + new, [])
    start = min(start, len(old))
    end = min(start + size, len(old))
    data, last, fresh = OURS.bpe.edit(old, table, start, end, new)
    assert data == old[:start] + new + old[end:] and last == OURS.bpe.extend(data, [])
    assert fresh <= len(data) - start


def test_edit_stops_early():
    old = b"the quick brown fox " * 60
    table = OURS.bpe.extend(old, [])
    _, last, fresh = OURS.bpe.edit(old, table, 10, 11, b"z")
    assert fresh < 4 * OURS.bpe.longest < len(last)


def test_vocabulary_must_have_all_bytes():
    with pytest.raises(ValueError):
        bpe.PrefixBpe({b"a": 0})


def test_documents(spark):
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, ODD), RANK_FILE, PATTERN).collect()}
    for k, text in ODD.items():
        ids = THEIRS.encode_ordinary(text or "")
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    both = bpe.decode_documents(bpe.encode_documents(docs(spark, ODD), RANK_FILE, PATTERN), RANK_FILE, PATTERN)
    assert all(bytes(r.decoded) == (ODD[r.doc_id] or "").encode() for r in both.collect())
    assert bpe.round_trip(docs(spark, ODD).limit(0), RANK_FILE, PATTERN).count() == 0


def _json() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


JSON = _json()
COUNTER = PieceCounter(JSON, {})


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT | st.just("<|endoftext|>"), max_size=4).map("".join))
def test_count_as_the_library(text):
    assert COUNTER.count(text) == len(COUNTER.tokenizer.encode(text, add_special_tokens=False).ids)


def test_table():
    counts = {" the": 1, "": 0, "漢字": 4}
    assert PieceTable(counts).expand() == counts
    assert special_strings(JSON) == ["<|endoftext|>"]
    with pytest.raises(ValueError):
        special_strings('{"pre_tokenizer": {"type": "Whitespace"}}')


def test_counted_documents(spark, data):
    got = {r.doc_id: r for r in count_tokens(docs(spark, ODD), JSON, 5).collect()}
    for k, text in ODD.items():
        n = len(COUNTER.tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 5)
    assert count_tokens(docs(spark, ODD).limit(0), JSON).count() == 0
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r.n_tokens == len(COUNTER.tokenizer.encode(whole[r.doc_id], add_special_tokens=False).ids) for r in op9_token_counts(spark, data).collect())
