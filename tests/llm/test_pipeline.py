"""The pipeline stage by stage on the smallest tables, each judged on its own input."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quantaint.llm import mixing, oracle, registered
from quantaint.llm.batches import least_rows
from quantaint.sources.store import keep

from .test_mixing_chat_language import check_mix, plain_targets
from .test_near_dedup import brute_force
from .test_quality import plain_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.select(*COLUMNS).collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, small), "stage")
        if name != "packing":
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_stage_names_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "quality rules", "near duplicates", "source mixing", "packing",
    ]
    numbers = sorted(int(name[2:].split("_")[0]) for name in registered.queries())
    assert numbers == list(range(1, 14))
    assert set(oracle.statements()) <= set(registered.queries())


def test_filters_keep_rows_as_they_are(stages):
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert set(after) <= set(before) and len(set(after)) == len(after)
    assert len(stages[1]) > 0.5 * len(stages[0]) and len(stages[2]) > 0.9 * len(stages[1])


def test_rules_drop_what_fails_the_base(stages):
    for row in stages[2]:
        n, _, _, _, repeated = plain_counts(row.text)
        assert n >= 20 and 100 * repeated <= 30 * n


def test_one_document_of_each_group_stays(stages):
    groups = brute_force([(r.doc_id, r.text) for r in stages[2]])
    assert sorted(r.doc_id for r in stages[3]) == [name for name, _, _, kept in groups if kept]


def test_mix_repeats_documents(spark, stages):
    before, after = stages[3], Counter(stages[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    rows = [(r.doc_id, r.source, r.text) for r in before]
    count = {r.doc_id: n for r, n in after.items()}
    sizes = {name: plain_counts(text)[0] for name, _, text in rows}
    totals = defaultdict(int)
    for name, source, _ in rows:
        totals[source] += sizes[name]
    got = [
        spark_row(name, sizes[name], totals[source], count.get(name, 0)) for name, source, _ in rows
    ]
    want = plain_targets(dict(totals))
    least = {s: min(sizes[n] for n, source, _ in rows if source == s) for s in totals}
    for row, (_, source, _) in zip(got, rows, strict=True):
        row.target = want[source]
    for source, (taken, target) in check_mix(rows, got).items():
        assert abs(taken - target) <= 0.05 * target + least[source], source


class spark_row:
    def __init__(self, doc_id, size, source_size, times):
        self.doc_id, self.size, self.source_size, self.taken = doc_id, size, source_size, times * size


def test_pieces_of_the_mix(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for row in stages[4]:
        ids = np.array([*tokenizer.encode(row.text, add_special_tokens=False).ids, 0], "<u4")
        cuts = sorted({0, *range(len(ids) % 2048, len(ids) + 1, 2048), len(ids)})
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[row.doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in stages[5]) == want
    spans = defaultdict(list)
    for r in stages[5]:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in stages[5])
    assert len(spans) <= total / 2048 * 1.03 + 2


def test_run_gives_the_same_rows(spark, small, stages):
    got = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5]))


def test_stages_on_odd_tables(spark, small, tmp_path):
    """Nulls in any column, repeated rows and ids, an extra column, and an empty table."""
    text = " ".join(f"word{i % 37} thing{i}" for i in range(60))
    rows = [
        (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " more", None, None, None), (3, None, None, None, None),
        (4, "", "en", "b", 0), (None, text, "en", "a", 1), (None, None, None, None, None), (5, text.upper() + " x y z", "de", "b", 9),
        (5, "entirely different words " + text[::-1], "de", "b", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("row_hash", F.lit(7))
    for table in (docs, docs.limit(0)):
        table = keep(table, "odd")
        for name, stage in corpus_pipeline.STAGES:
            out = keep(stage(spark, table, small), "odd")
            if name != "packing":
                assert out.columns == docs.columns
                assert name == "source mixing" or out.count() <= table.count()
                table = out


def test_mix_by_rows_and_in_rounds(spark, small, monkeypatch):
    """Rows of one id and equal rows are units of their own; several rounds give the same rows."""
    rows = [(i % 7 if i % 9 else None, f"w{i % 5} " * (i % 11), "en", "ab"[i % 2] if i % 13 else None, i) for i in range(400)]
    docs = keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6), "odd")
    once = Counter(map(tuple, corpus_pipeline.mix(spark, docs, small).collect()))
    place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")]
    mixed = mixing.mix_sources(docs.select("doc_id", "source", "text", "n_chars", *place), also=("n_chars",)).collect()
    assert once == Counter({tuple(rows[r.n_chars]): r.times for r in mixed if r.times})
    monkeypatch.setattr(corpus_pipeline, "BLOCK_ROWS", 8)
    monkeypatch.setattr(corpus_pipeline, "ROUND_ROWS", 100)
    assert Counter(map(tuple, corpus_pipeline.mix(spark, docs, small).collect())) == once


def test_stages_judge_rows_not_ids(spark, small):
    """Rows that share an id, or have none, are judged by their own texts; a very long text passes whole."""
    good = [" ".join(f"{w}{i}" for i in range(90)) for w in ("alpha", "beta", "gamma", "delta")]
    bad = "spam " * 200
    long_text = " ".join(f"long{i}" for i in range(120_000))
    rows = [
        (1, good[0]), (1, good[1]), (2, good[0]), (3, good[1]), (3, bad), (None, good[2]), (4, good[2]),
        (None, bad), (None, good[3]), (None, good[3]), (5, long_text), (6, long_text + " end"), (7, ""), (8, None), (8, None),
    ]
    docs = spark.createDataFrame([(n, t, "en", "a", 1, "x") for n, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    docs = keep(docs.repartition(3), "odd")

    def texts(frame):
        assert frame.columns == docs.columns
        return Counter((r.doc_id, r.text) for r in frame.collect())

    passed = texts(corpus_pipeline.filter_quality(spark, docs, small))
    assert passed == Counter(r for r in rows if r[1] and r[1] != bad)
    left = texts(corpus_pipeline.deduplicate(spark, docs, small))
    want = [(1, good[0]), (1, good[1]), (3, bad), (4, good[2]), (None, good[3]), (5, long_text), (7, ""), (8, None), (8, None)]
    assert left == Counter(want)
    graded = texts(corpus_pipeline.classify(spark, docs, small))
    fate = {text: [graded[n, text] == count for (n, t), count in Counter(rows).items() if t == text] for _, text in rows}
    assert all(len(set(x)) == 1 for x in fate.values()) and sum(graded.values()) <= len(rows)


def test_least_rows_are_those_of_least_hash(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    want = [r.id for r in rows.orderBy("h", "id").limit(300).collect()]
    assert [r.id for r in least_rows(rows.repartition(7), F.col("h"), 300, "id").collect()] == want
    # All rows of one hash: ties decide.
    same = rows.withColumn("h", F.lit(2**62))
    assert [r.id for r in least_rows(same, F.col("h"), 5, "id").collect()] == [0, 1, 2, 3, 4]
    assert least_rows(rows.limit(0), F.col("h"), 5).isEmpty()
