"""Quality rules and the ordinal classifier."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantaint.llm import ordinal, quality_rules, registered

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = "text string, lang string, doc_id long, source string, own_symbols_per_word string, n_words string"


def plain_counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    inside = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    chars, symbols = sum(map(len, found)), len(re.findall("[#*$%&|<>]", text))
    return len(found), chars, symbols, copies, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "É!", "\n", "#x", "\xa0", "\x0b", "a b c d e f g h", "日本"]), max_size=60))
def test_counts(parts):
    text = " ".join(parts)
    assert quality_rules.text_counts(text.encode())[:5] == plain_counts(text)


def test_op2_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registered.op2_adaptive_quality_rules(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, chars, symbols, lines, repeated = plain_counts(texts[r.doc_id])
        assert tuple(r[1:6]) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert r.kept == (not r.base_failed and not r.failed)


def test_sketches_merge_and_bound_the_error(spark):
    random.seed(1)
    rows = [(random.choice("ab"), i % 7, random.lognormvariate(0, 2) * (i % 9 > 0)) for i in range(4000)]
    table = spark.createDataFrame(rows, "lang string, part int, x double")
    parts = quality_rules.quantile_sketches(table, ["lang", "part"], ["x"])
    merged = quality_rules.merge_sketches(parts, ["lang"])
    whole = quality_rules.quantile_sketches(table, ["lang"], ["x"])
    order = ["lang", "measure", "bucket", "n"]
    assert sorted(merged.select(order).collect()) == sorted(whole.select(order).collect())
    levels = {"q1": 0.25, "q2": 0.5, "q9": 0.9}
    for r in quality_rules.sketch_quantiles(merged, ["lang"], levels).collect():
        values = sorted(x for lang, _, x in rows if lang == r.lang)
        for name, q in levels.items():
            exact = values[int(np.ceil(q * len(values))) - 1]
            assert r[name] == pytest.approx(exact, rel=0.011)


def odd_rows():
    good = " ".join(f"word{i}" for i in range(40))
    return [
        (good, "en", 1, "a", "x", "y"),
        (good, "en", 1, "a", "x", "y"),
        (None, None, 2, None, None, None),
        ("", "en", 3, "a", None, None),
        (good + " ***" * 40, None, 4, None, None, None),
        ("same words here again and on " * 5000, "en", 5, "a", None, None),
        (good, "en", None, "a", None, None),
    ]


def test_rules_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    rows = quality_rules.apply_rules(docs).collect()
    kept = Counter((r.doc_id, r.kept) for r in rows)
    assert kept == {(1, True): 2, (2, False): 1, (3, False): 1, (4, False): 1, (5, False): 1, (None, True): 1}
    assert quality_rules.apply_rules(docs.limit(0)).collect() == []


def made_text(words: int, symbols: int) -> str:
    return " ".join(f"w{i}" + "#" * (i < symbols) for i in range(words))


def test_fences_follow_the_group(spark):
    """A source that always has many symbols keeps its texts, the same text elsewhere goes."""
    rows = [(i, "en", "code", made_text(40 + i % 30, 15 + i % 9)) for i in range(80)]
    rows += [(100 + i, "en", "news", made_text(40 + i % 30, 0)) for i in range(80)]
    rows.append((500, "en", "news", made_text(50, 20)))
    out = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    assert [r.doc_id for r in out.filter(~F.col("kept")).collect()] == [500]


def test_small_groups_lean_on_their_parents(spark):
    """A source of one text takes nearly the fence of its language; no number of documents switches."""
    rows = [(i, "en", "news", made_text(40 + i % 30, 0)) for i in range(200)]
    rows += [(900, "en", "x", made_text(50, 20)), (901, "en", "y", made_text(50, 0)), (902, None, None, made_text(50, 0))]
    out = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    assert [r.doc_id for r in out.filter(~F.col("kept")).collect()] == [900]


def test_copies_of_one_text_leave_the_rest_alone(spark):
    rows = [(i, "en", "news", made_text(50, 0)) for i in range(120)]
    rows += [(200 + i, "en", "news", made_text(30 + i, 0)) for i in range(80)]
    out = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    assert out.filter(~F.col("kept")).count() == 0


def test_all_fences_differ_between_groups_and_move_with_sources(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def fences(table):
        measured = quality_rules._with_measures(quality_rules.measure_texts(table)).filter(~quality_rules.base_failed())
        names = [f.measure for f in quality_rules.FENCES]
        sketches = quality_rules.quantile_sketches(measured, ["lang", "source"], names)
        found = quality_rules.group_fences(sketches, quality_rules.FENCES).collect()
        return {(r.lang, r.source): tuple(r[2:]) for r in found}

    plain = fences(docs)
    for i in range(4):
        assert len({round(f[i], 3) for f in plain.values()}) > 5
    # Sources dealt anew: the fences of a name change with the texts it gets.
    dealt = fences(docs.withColumn("source", F.concat(F.lit("s"), F.pmod(F.xxhash64("doc_id"), F.lit(20)))))
    turned = fences(docs.withColumn("source", F.concat(F.lit("s"), F.pmod(F.xxhash64("text"), F.lit(20)))))
    assert sum(dealt[k] != turned[k] for k in dealt.keys() & turned.keys()) > 20


def test_rules_find_labelled_junk(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = registered.op2_adaptive_quality_rules(spark, sf).join(labels, "doc_id")
    rate = {r.quality: r.rate for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.96 and rate[0] < 0.1


def test_ordinal_gradient_separates_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    features = [np.unique(np.append(rng.integers(100, 400, 20), 10 + g)) for g in grades]
    model = ordinal.fit(features, grades.tolist())
    assert (np.diff(model.thresholds) > 0).all()
    chances = model.probabilities(np.array([model.score(x) for x in features]))
    assert np.allclose(chances.sum(axis=1), 1) and (chances >= 0).all()
    assert (chances.argmax(axis=1) == grades).mean() > 0.95


def test_ordinal_held_out(spark, small):
    """Fit on two thirds of the labelled rows, judge the others."""
    sf = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = ordinal.train(docs, labels.filter(fold != 1), sample=3000)
    rest = docs.join(labels.filter(fold == 1), "doc_id")
    judged = ordinal.grade_documents(rest, model).join(labels, "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rates = {r.good: r.rate for r in judged.groupBy(good.alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[True] > 0.98 and rates[False] < 0.2


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (2, 0, None), (4, None, 1), (5, 0, 1), (77, 1, 1), (None, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = ordinal.classify_documents(docs, labels).collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= r.tail <= 1 and r.kept == (r.tail >= 0.5) for r in rows)
    assert ordinal.classify_documents(docs.limit(0), labels).collect() == []
    assert len(ordinal.classify_documents(docs, labels.limit(0)).collect()) == len(odd_rows())
