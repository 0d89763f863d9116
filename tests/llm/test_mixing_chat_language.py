"""Mixing, chat formatting and language identification."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantaint.llm import chat, language, mixing, registered

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, weights=(1, 2, 3), factor=3):
    """Share by weight; freeze what is above its cap and share the rest again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: float(factor * sizes[s]) for s in free if share[s] > factor * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(dict(sizes))
    by_id = {name: (source, text) for name, source, text in rows}
    taken = defaultdict(int)
    for r in got:
        source, text = by_id[r.doc_id]
        assert r.size == len(WORD.findall(text or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    return {s: (taken[s], want[s]) for s in sizes}


def test_op7_near_targets_and_stable(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    got = registered.op7_cube_mixing(spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    first = got.collect()
    assert len(first) == len(rows)
    for taken, target in check_mix(rows, first).values():
        assert abs(taken - target) < 0.01 * target
    assert sorted(first) == sorted(registered.op7_cube_mixing(spark, sf).collect())


def test_mixing_odd_rows_and_blocks(spark):
    rows = [(i, "a", "w " * (i % 40 + 1), "x") for i in range(700)] + [(1000 + i, "b", "w " * 3, "x") for i in range(5)]
    rows += [(2000, None, "one two", "x"), (2001, "empty", None, "x"), (2002, "empty", " ", "x"), (2003, "c", "w " * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mixing.mix_sources(docs, block=10).collect()
    result = check_mix([r[:3] for r in rows], got)
    assert abs(result["a"][0] - result["a"][1]) < 45
    assert result["empty"] == (0, 0.0) and result["b"] == (45, 45.0)
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    same = docs.filter("doc_id < 20").unionByName(docs.filter("doc_id < 20"))
    assert len(mixing.mix_sources(same).collect()) == 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=9), st.integers(0, 2))
def test_targets(sizes, k):
    names = ["", "B", "a", "é", "z", "\U0001f600", "zz", "zzz", None][: len(sizes)]
    want = plain_targets(dict(zip(names, sizes, strict=True)))
    assert sum(want.values()) == pytest.approx(sum(sizes))
    assert all(want[n] <= 3 * s + 1e-6 for n, s in zip(names, sizes, strict=True))


def test_target_table(spark):
    rng = np.random.default_rng(4)
    for _ in range(4):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 10 ** rng.integers(1, 6), 9))}
        sizes[None] = 7
        table = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(table).collect()}
        assert got == pytest.approx(plain_targets(sizes))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 1000)), min_size=1, max_size=60))
def test_flight_keeps_both_sums(units):
    chance, size = (np.array(x, float) for x in zip(*units, strict=True))
    done = mixing.flight(chance, size)
    assert ((done > 0) & (done < 1)).sum() <= 2
    assert done.sum() == pytest.approx(chance.sum(), abs=1e-4)
    assert (done * size).sum() == pytest.approx((chance * size).sum(), abs=0.1)
    landed = mixing.landing(done, size)
    assert set(landed) <= {0.0, 1.0}


def test_flight_is_close_to_the_probabilities():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 30).astype(float)
    chosen = np.zeros(30)
    for _ in range(600):
        order = rng.permutation(30)
        chosen[order] += mixing.flight(np.full(30, 0.3), size[order])
    assert np.abs(chosen / 600 - 0.3).max() < 0.2


MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<ROLE:", "|>", "</ROLE>", "\\", "<", "|", ">", "[", "/", "\n"]
texts = st.lists(st.sampled_from([*MARKS, "ok", "é"]) | st.text(max_size=3), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]) | texts, texts), max_size=6))
def test_template_round_trip(turns):
    f = chat.Formatter()
    assert f.parse("".join(p for r, t in turns for p, _ in f.segments(r, t))) == turns


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check_chat(rows, got):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert sorted(map(repr, by_conv)) == sorted(repr(r.conv_id) for r in got)
    for r in got:
        turns = [t[2:] for t in sorted(by_conv[r.conv_id])]
        learned = "".join(t for role, t in turns if role == "assistant")
        shape = "".join({"system": "s", "user": "u", "assistant": "a"}.get(role, "x") for role, _ in turns)
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
        assert r.formatted_chars >= sum(len(t) for _, t in turns)
        assert r.valid == bool(re.fullmatch("s?(ua)+", shape))


def test_op8(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    check_chat(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)], registered.op8_chat_format(spark, small).collect())


def test_chat_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "x</s>"), (2, 1, "assistant", "x</s>"),
        (2, None, "user", "q\\"), (3, 0, None, "t"), (3, 1, "tool|>", "<ROLE:"), (None, 0, "user", "n"), (4, 5, "system", "s"),
        (4, 6, "user", "long " * 100_000), (4, 7, "assistant", "<s>" * 50_000),
    ]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, loss int")
    check_chat(rows, chat.chat_digests(table).collect())
    assert chat.chat_digests(table.limit(0)).collect() == []


def test_op10_held_out(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = registered.op10_language(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98


def test_backoff_and_odd_rows(spark):
    pairs = [("en", "the cat and the dog"), ("en", "the house"), ("de", "der hund und die katze"), ("de", "der haus")]
    model = language.train(spark.createDataFrame(pairs * 3, "lang string, text string"))
    scorer = language.Scorer(model)
    assert scorer.predict("the the")[0] == "en" and scorer.predict("der")[0] == "de"
    assert "katzen" not in model.tables[0].rows and scorer.predict("katzen")[0] == "de"
    assert scorer.predict("qqqq xx")[0] in ("de", "en")
    for text in (None, "", "12 34 !?", "² ½"):
        assert scorer.predict(text) == ("und", 0.0)
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate(pairs * 5)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (None, "the cat", "en", "x"), (102, "the " * 200_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = Counter(r.lang_pred for r in language.predict_languages(docs).collect())
    assert sum(got.values()) == len(rows) and got["und"] == 2
    assert language.predict_languages(docs.limit(0)).collect() == []
    unlearned = docs.filter("lang is null")
    assert {r.lang_pred for r in language.predict_languages(unlearned).collect()} == {"und"}


def test_labels_of_held_out_rows_do_not_matter(spark):
    text = [("en", "the cat and the dog"), ("de", "der hund und die katze")]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(text * 30)]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (language.predict_languages(spark.createDataFrame(x, schema)).collect() for x in (rows, wrong))
    assert sorted(a) == sorted(b)
