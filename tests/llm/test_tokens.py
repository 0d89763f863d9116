"""Encoding by remembered pieces, Elias-Fano codes, token files and packing."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantaint.llm import packing, registered
from quantaint.llm.elias_fano import EliasFano
from quantaint.llm.token_files import TokenFile, pack_file, token_offsets
from quantaint.llm.tokens import Encoder

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
SCHEMA = "text string, lang string, doc_id long, start string, length string"


def plain(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@lru_cache
def loaded(name):
    return Encoder(public_tokenizers.path(name)), plain(name)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(data=st.data())
def test_encoder_equals_library(name, data):
    part = st.sampled_from(
        [" ", "  ", "\n", "\n ", "\t", "\r\n", "\xa0", " ", "\x1c", "a", "The", "É", "é",
         "́", "ΟΔΟΣ", "'s", "'", "12", "!?", "<|endoftext|>", "日本", "🙂", "ß", "x" * 60]
    ) | st.text(max_size=4)
    text = "".join(data.draw(st.lists(part, max_size=20)))
    encode, reference = loaded(name)
    for _ in range(2):
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano(values):
    values.sort()
    back = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
    assert back.decode().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values


def test_elias_fano_space():
    values = np.sort(np.random.default_rng(0).integers(0, 10_000_000, 50_000))
    coded = EliasFano.encode(values).to_bytes()
    assert len(coded) * 8 / len(values) < 2 + np.log2(200) + 1.5
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([3, 2]))


def test_file_round_trip():
    ids = [np.array(x, "<u4").tobytes() for x in ([5, 1], [1], [], [65535, 2, 1])]
    held = TokenFile(pack_file([None, -3, 7, 7], ids, 2))
    assert held.doc_ids == [None, -3, 7, 7]
    assert [held.ids(i).tolist() for i in range(4)] == [[5, 1], [1], [], [65535, 2, 1]]


def rows():
    text = "the Quick  brown\nfox's <|endoftext|> ça va "
    return [
        (text, "en", 5, "x", "y"),
        (None, None, 3, None, None),
        ("", "en", 4, "x", "y"),
        (text * 900, "en", 9, "x", "y"),
        (text, "en", 5, "x", "y"),
        ("word", "en", None, "x", "y"),
    ]


def test_offsets_of_odd_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = token_offsets(docs, public_tokenizers.path(FILES[0]), end_id=1).collect()
    encode = plain(FILES[0])
    start, expected = 0, []
    for text, _, name, *_ in sorted(rows(), key=lambda r: (r[2] is not None, r[2] or 0, r[0] or "")):
        ids = np.array([*encode(text), 1], "<u4")
        expected.append((name, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    empty = token_offsets(docs.limit(0), public_tokenizers.path(FILES[0]), end_id=1)
    assert empty.collect() == []


def test_op1_against_library(spark, small):
    encode = plain(FILES[0])
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    start, expected = 0, []
    for name, text in sorted(docs):
        ids = np.array([*encode(text), 1], "<u4")
        expected.append((name, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = registered.op1_token_files(spark, small)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece after piece."""
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, free in enumerate(left) if free >= x]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= x
        else:
            left.append(capacity - x)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 40))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    used = defaultdict(list)
    for length, a, b, first, per_bin, base in packing.best_fit_plan(counts, capacity):
        for i in range(b - a):
            used[first + i // per_bin].append((base + i % per_bin * length, length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, used.values())) == len(lengths)
    assert sorted(used) == list(range(len(used)))
    assert sorted(capacity - sum(n for _, n in x) for x in used.values()) == one_by_one(lengths, capacity)


def check_packed(docs, got, encode):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for name, text in docs:
        ids, at = np.array([*encode(text), 0], "<u4"), 0
        parts = sorted(by_doc.pop(name), key=lambda r: r.piece)
        for i, r in enumerate(parts):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 2048 or i == 0
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_op3_against_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = registered.op3_best_fit_packing(spark, small).collect()
    check_packed(docs, got, plain(FILES[1]))
    sizes = [r.length for r in got]
    assert len({r.sequence_id for r in got}) == len(one_by_one(sizes, 2048))


def test_packing_odd_rows_and_small_groups(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    path = public_tokenizers.path(FILES[1])
    pieces = packing.token_pieces(docs, path, 0, with_ids=True).cache()
    packed = packing.pack(pieces, ranked_rows=3)
    assert packed.count() == pieces.count()
    whole = packing.sequence_ids(packed).collect()
    crc = {r.sequence_id: bytes(r.ids) for r in whole}
    for r in packed.collect():
        own = crc[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(own) == r.ids_crc32
    assert packing.pack_documents(docs.limit(0), path, 0).collect() == []
    random.seed(0)
    lengths = [(i, random.choice([7, 7, 7, 900, 2048])) for i in range(500)]
    many = packing.pack(spark.createDataFrame(lengths, "doc_id long, length long"), ranked_rows=50)
    spans = defaultdict(list)
    for r in many.collect():
        spans[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, spans.values())) == 500
    assert len(spans) == len(one_by_one([x for _, x in lengths], 2048))
