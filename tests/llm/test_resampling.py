from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import floor, log
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quantaint.llm import oracle, registered, resampling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def features(text, width):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return len(found), [" ".join(found[i : i + n]) for n in range(1, width + 1) for i in range(len(found) - n + 1)]


def expected(docs, aims, width=1, buckets=10_000, percent=10, least=20):
    cut = [features(text, width) for _, text in docs]
    s = Counter(crc32(x.encode()) % buckets for _, f in cut for x in f)
    t = Counter(crc32(x.encode()) % buckets for text in aims for x in features(text, width)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for (doc, _), (words, f) in zip(docs, cut, strict=True):
        gains = [floor(1000 * log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in (crc32(x.encode()) % buckets for x in f)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None, words])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, row in enumerate(drawn[: percent * len(drawn) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(spark, docs, aims, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"codes": F.lit("x"), "place": F.lit(1), "n_words": F.lit(2)})
    target = spark.createDataFrame([(x,) for x in aims], "text string")
    return sorted(map(tuple, resampling.resample(df.repartition(3), target, **more).collect()), key=repr)


def corpus():
    words = "the of and éa 日本 x1 Zed a-b c_d [q] È".split()
    docs = [(i, " ".join(words[(i * j + j // 3) % len(words)] for j in range(i % 60))) for i in range(300)]
    docs += [(None, "the " * 30), (None, "the " * 30), (7, "of, " * 25), (7, "of, " * 25), (1000, None), (1001, ""), (1002, "\x00\x7f!"), (1003, "long Words " * 400_000)]
    return docs, ["the x1 x1 Zed", None, "", "日本 日本"]


@pytest.mark.parametrize("width", [1, 3])
def test_nulls_ties_repeats_and_long_texts(spark, width):
    docs, aims = corpus()
    assert found(spark, docs, aims, width=width, percent=40) == expected(docs, aims, width, percent=40)


def test_parts_of_a_long_text_give_the_features_of_the_whole(monkeypatch):
    monkeypatch.setattr(resampling, "_PART", 5)
    text = "Aa bb,cc  dd ee-ff gghhiijjkk ll " * 20
    for width in (1, 2, 4):
        words, buckets = resampling.Features(width, 1 << 20).of(text)
        count, runs = features(text, width)
        assert words == count
        assert sorted(buckets.tolist()) == sorted(crc32(x.encode()) % (1 << 20) for x in runs)


def test_wide_buckets_and_empty_tables(spark):
    docs, aims = corpus()
    assert found(spark, docs[:50], aims, buckets=100_000) == expected(docs[:50], aims, buckets=100_000)
    assert found(spark, [], aims) == []
    assert found(spark, docs[:50], []) == expected(docs[:50], [])


def test_query_equals_brute_force_and_statement(spark, small, duck):
    rows = sorted(map(tuple, registered.op13_importance_resampling(spark, small).collect()), key=repr)
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    aims = [r[0] for r in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect()]
    assert rows == expected(docs, aims)
    stated = duck.execute(oracle.statements()["op13_importance_resampling"]).fetchall()
    assert rows == sorted(map(tuple, stated), key=repr)
