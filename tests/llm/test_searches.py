"""Url rules and the permutation index."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantaint.llm import permutation_index, registered, url_rules
from quantaint.llm.registered import URL_RULES
from quantaint.llm.url_rules import Rule, RuleStack


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:stop]


def best(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def judged(spark, urls, rules, **options):
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = url_rules.judge_urls(table, "page_id", rules, **options)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, got.collect()))


def expected(urls, rules, default="allow"):
    out = []
    for i, url in enumerate(urls):
        host, path = split(url)
        rule = best(host, path, rules)
        out.append((i, host, path, rule.text if rule else None, rule.verdict if rule else default))
    return out


ODD = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://a.org/x?y#z", "x://b.example.org/es/",
    "http://example.org/en/1234", "http://badexample.org/es/", "http://com/fr/", "http://x.com/de/?q", "http://É.com/FR/",
    "http://a..org/", "http://org./", "http://x.org#/es/", "a://b://c.org/", "http://a.org/\n/es", "http://z.net/" + "p" * 5000,
]


def test_odd_urls(spark):
    urls = ODD + ["http://hot.example.org/es/1"] * 60 + ["http://hot.example.org/"] * 60
    assert judged(spark, urls, URL_RULES) == expected(urls, URL_RULES)
    assert judged(spark, urls, [], default="block") == expected(urls, [], "block")
    assert judged(spark, [], URL_RULES) == []


def test_nested_rules_and_equal_keys(spark):
    rules = [Rule(h, p, "allow") for h in ("a", "b.a", "c.b.a", "ba", "b-a.a") for p in ("", "/", "/x", "/x/y")]
    urls = [f"h://{h}{p}" for h in ("a", "b.a", "c.b.a", "d.c.b.a", "ba", "x.ba", "b-a.a", "bb.a", "q") for p in ("", "/", "/x", "/xy", "/x/y/z")]
    assert judged(spark, urls, rules) == expected(urls, rules)


labels = st.lists(st.sampled_from(["a", "b", "ab", "c"]), min_size=1, max_size=4).map(".".join)
paths = st.sampled_from(["", "/", "/a", "/a/", "/ab"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(labels, paths), unique=True, max_size=12), st.lists(st.tuples(labels, paths), max_size=20))
def test_stack_sweep(rules, urls):
    rules = [Rule(h, p, "block") for h, p in rules]
    keyed = {}
    for r in rules:
        keyed.setdefault(url_rules._reversed(r.host), []).append(r)
    events = [(k, 0, None) for k in keyed] + [(url_rules._reversed(h), 1, (h, p)) for h, p in urls]
    stack = RuleStack()
    for key, kind, url in sorted(events, key=lambda e: e[:2]):
        if kind == 0:
            stack.start(key, keyed[key])
        else:
            stack.close_before(key)
            got, want = stack.longest(url[1]), best(*url, rules)
            assert (got and len(got.text)) == (want and len(want.text))


def exact(ids, vectors, query, k=10):
    at = int(np.flatnonzero(ids == query)[0])
    far = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
    far[ids == query] = np.inf
    return [(int(ids[i]), far[i]) for i in np.lexsort((ids, far))[:k] if np.isfinite(far[i])]


def test_op6_recall(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = {}
    for r in registered.op6_permutation_index(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == sorted(i for i in ids if i % 100 == 0)
    hits = 0
    for query, got in found.items():
        want = exact(ids, vectors, query)
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [x[1:] for x in got] == sorted((x[1:] for x in got), key=lambda x: (x[1], x[0]))
        for _, i, score in got:
            assert score == np.sqrt(((vectors[ids == query][0] - vectors[ids == i][0]) ** 2).sum())
        hits += len({i for i, _ in want} & {i for _, i, _ in got})
    assert hits / (10 * len(found)) >= 0.95


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist(), "x", 1) for i in range(1, 30)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0], None, None) for i in range(20)] + [(200, [1.0, 2.0, 3.0, 4.0], "x", 2)]
    rows += [
        (300, None, "x", 1), (400, [0.0] * 4, "x", 1), (500, [float("nan"), 1.0, 1.0, 1.0], "x", 1),
        (600, [1.0, None, 1.0, 1.0], "x", 1), (700, [float("inf")] * 4, "x", 1), (800, [1.0], "x", 1),
        (900, [], "x", 1), (None, [1.0, 1.0, 1.0, 1.0], "x", 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int")
    got = permutation_index.nearest_neighbours(table, table.vec_id % 100 == 0).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {100, 200}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 200] == [(100 + i, 0.0) for i in range(10)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(101 + i, 0.0) for i in range(10)]
    few = table.filter("vec_id in (1, 100)")
    assert len(permutation_index.nearest_neighbours(few, few.vec_id == 100).collect()) == 1
    none = table.limit(0)
    assert permutation_index.nearest_neighbours(none, none.vec_id == 100).collect() == []


def test_several_blocks_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(permutation_index, "BLOCK", 64)
    monkeypatch.setattr(permutation_index, "QUERIES", 7)
    got = permutation_index.nearest_neighbours(table, table.vec_id % 10 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append(r.vec_id)
    ids = np.arange(300)
    assert found == {q: [i for i, _ in exact(ids, vectors, q)] for q in range(0, 300, 10)}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_footrule(seed):
    rng = np.random.default_rng(seed)
    orders = np.array([rng.permutation(12)[:5] for _ in range(9)])
    files = permutation_index.inverted_files(orders, 12)
    gain = permutation_index.footrule_gain(files, orders[0], 9)
    place = np.full((9, 12), 5)
    np.put_along_axis(place, orders, np.arange(5)[None, :].repeat(9, 0), 1)
    footrule = np.abs(place - place[0]).sum(axis=1)
    assert ((footrule + 2 * gain) == footrule[0] + 2 * gain[0]).all()
