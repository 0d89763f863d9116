"""Near duplicates against all pairs of sets."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from quantaint.llm import near_dedup, registered
from quantaint.llm.shingles import shingle_set


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lower)
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def brute_force(rows):
    sets = [shingles(text) for _, text in rows]
    over = list(range(len(rows)))

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 85 * len(sets[i] | sets[j]):
            over[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[top(i)] = min(name, least.get(top(i), name))
    return sorted((n, len(sets[i]), least[top(i)], least[top(i)] == n) for i, (n, _) in enumerate(rows))


def judged(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs.repartition(4), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()))


def test_op9_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = registered.op9_near_duplicates(spark, small)
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


@pytest.mark.parametrize("centres, block", [((1, 8), 512), ((1,), 512), ((1,), 13)])
def test_large_group_of_edits(spark, monkeypatch, centres, block):
    """Edits of edits: chains that no single centre connects."""
    random.seed(block)
    base = [f"w{i}" for i in range(120)]
    texts = [base]
    for _ in range(150):
        text = list(random.choice(texts[-20:]))
        for _ in range(random.choice([0, 1, 1, 2, 4])):
            text[random.randrange(len(text))] = f"n{random.randrange(10**9)}"
        texts.append(text)
    rows = [(1000 - i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(2000 + i, " ".join(random.sample(base, 60))) for i in range(30)]
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = judged(spark, rows, centres=centres)
    assert got == brute_force(rows)
    assert 1 < len({r[2] for r in got if r[0] <= 1000}) < 120


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [
        (5, text), (3, text.upper()), (9, text + "  "), (4, None), (2, ""), (1, " \n"), (7, "one two"),
        (6, "One\ttwo"), (8, "two one"), (11, text), (11, "other text with this same id"), (12, "É a b"), (13, "é a b"),
        (20, "long words " + " ".join(map(str, range(30_000)))), (21, " ".join(map(str, range(30_000)))),
    ]
    want = brute_force(rows)
    assert judged(spark, rows) == want
    assert judged(spark, rows[:0]) == []
    assert judged(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]
    unnamed = spark.createDataFrame(
        [(None, text, 1), (5, text, 2), (6, text, 3)], "doc_id long, text string, component_id int"
    )
    got = {tuple(r) for r in near_dedup.near_duplicates(unnamed).collect()}
    assert got == {(None, 3, None, True), (5, 3, 5, True), (6, 3, 5, False)}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.99, 0.95, 0.85):
        flips = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
            both = int(1000 * 2 * share / (1 + share))
            a, b = pool[:1000], pool[1000 - both : 2000 - both]
            x, y = (near_dedup.odd_sketch(near_dedup.minhash(np.unique(s))) for s in (a, b))
            flips.append(sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y))
        expected = near_dedup.most_flips(both / (2000 - both))
        assert np.mean(flips) == pytest.approx(expected, rel=0.1, abs=1.5)
        assert max(flips) <= near_dedup.most_flips(0.85 - near_dedup.MARGIN)


def test_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = near_dedup._intersections(sets, width=7)
    assert all(got[i][j] == want[i][j] for i in range(40) for j in range(40) if i != j)


def test_shingle_set_sizes():
    for text in ("a b c d e", "a b c d e f", "a", "", "a a a a a a a a", "A b\x0bc d e F"):
        assert len(shingle_set(text.encode())) == len(shingles(text))
