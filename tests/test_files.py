from __future__ import annotations

import json

import pytest

from quantaint.functions.labels import norm_scale, norm_seed, ratio_tag, safe_ratio_count
from quantaint.sources import violation_files
from quantaint.sources.delimited import read_database, read_relation, write_relation
from quantaint.sources.tables import read_table, write_table
from quantaint.sources.testdata import clean_database
from quantaint.sources.violation_files import read_keyed
from pyspark.sql import functions as F

SETS = [
    {"dc": "DC2", "tuples": {"orders": [611], "lineitem": [[902, 3]]}},
    {"dc": "DC4", "tuples": {"lineitem": [[7, 2]], "partsupp": [[3, 4]], "part": 3}},
    {"dc": "DC1", "tuples": {"lineitem": [[8, 1]], "part": None}},
]
MEMBERS = {
    ("DC2", "orders#611|lineitem#902,3", "orders", "611"),
    ("DC2", "orders#611|lineitem#902,3", "lineitem", "902,3"),
    ("DC4", "lineitem#7,2|partsupp#3,4|part#3", "lineitem", "7,2"),
    ("DC4", "lineitem#7,2|partsupp#3,4|part#3", "partsupp", "3,4"),
    ("DC4", "lineitem#7,2|partsupp#3,4|part#3", "part", "3"),
    ("DC1", "lineitem#8,1", "lineitem", "8,1"),
}


def folder(tmp_path, content) -> str:
    place = tmp_path / "scale=sf1" / "subset=subsetA" / "ratio=0p1pct" / "seed=seed01"
    place.mkdir(parents=True)
    (place / "sets.json").write_text(json.dumps(content, indent=2))
    return str(tmp_path)


@pytest.mark.parametrize("wrap", [lambda s: s, lambda s: {"mis": s}])
def test_keyed_files_in_both_shapes(spark, tmp_path, wrap):
    rows = read_keyed(spark, folder(tmp_path, wrap(SETS)), whole_file=True).collect()
    assert {(r.dc, r.mis_id, r.relation, r.pk) for r in rows} == MEMBERS
    assert {r.db_id for r in rows} == {"sf1/subsetA/0p1pct/seed01"}


def test_other_structures_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="unexpected structure"):
        read_keyed(spark, folder(tmp_path, {"sets": []}), whole_file=True).collect()


@pytest.mark.parametrize("key", [[], ["x"]])
def test_bad_keys_are_refused(spark, tmp_path, key):
    content = [{"dc": "DC1", "tuples": {"lineitem": [key]}}]
    with pytest.raises(Exception, match="empty key|CAST_INVALID_INPUT"):
        read_keyed(spark, folder(tmp_path, content), whole_file=True).collect()


def test_delimited_database(spark, small, tmp_path):
    db = clean_database(spark, small)
    for relation, table in db.items():
        write_relation(table, str(tmp_path / f"{relation}.tbl"), relation)
    loaded = read_database(spark, str(tmp_path))
    assert loaded["lineitem"].select(*db["lineitem"].columns).exceptAll(db["lineitem"]).isEmpty()
    assert loaded.rows("lineitem") == db.rows("lineitem")


def test_delimited_rows_are_strict(spark, tmp_path):
    good = tmp_path / "region.tbl"
    good.write_text('0|AFRICA|odd "quote|\n1|ASIA||\n')
    rows = read_relation(spark, str(good), "region").collect()
    assert [tuple(r) for r in rows] == [(0, "AFRICA", 'odd "quote'), (1, "ASIA", None)]
    for text in ("x|AFRICA|c|\n", "0|AFRICA\n"):
        bad = tmp_path / f"bad{len(text)}.tbl"
        bad.write_text(text)
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|MALFORMED|malformed"):
            read_relation(spark, str(bad), "region").collect()


def test_one_scenario_reads_one_folder(spark, tmp_path, capsys):
    df = spark.createDataFrame(
        [("a", "s", "r", "1", 1.0), ("b", "s", "r", "1", 2.0)],
        "scale string, subset string, ratio string, seed string, value double",
    )
    path = str(tmp_path / "t")
    write_table(df, path)
    one = read_table(spark, path, df, {"scale": "b"})
    assert [tuple(r) for r in one.collect()] == [("b", "s", "r", "1", 2.0)]
    capsys.readouterr()
    one.explain()
    assert "PartitionFilters: [isnotnull(scale" in capsys.readouterr().out
    csv = str(tmp_path / "c")
    write_table(df, csv, file_format="csv")
    assert read_table(spark, csv, df, file_format="csv").count() == 2


def test_labels(spark):
    rows = spark.createDataFrame(
        [(0.0001, "0p01pct"), (0.0005, "0p05pct"), (0.001, "0p1pct"), (0.2, "20pct"), (1.0, "100pct"), (0.125, "12p5pct")],
        "ratio double, want string",
    )
    for r in rows.select("want", ratio_tag(F.col("ratio")).alias("got")).collect():
        assert r.got == r.want
    sizes = spark.createDataFrame(
        [(100, 0.001, 1), (0, 0.5, 0), (100, 0.0, 0), (1000, 0.0105, 10)],
        "base long, ratio double, want long",
    )
    for r in sizes.select("want", safe_ratio_count(F.col("base"), F.col("ratio")).alias("got")).collect():
        assert r.got == r.want
    one = spark.range(1).select(
        norm_scale(F.lit("sf0.1")).alias("a"),
        norm_scale(F.lit("0.1")).alias("b"),
        norm_seed(F.lit("seed09")).alias("c"),
    ).first()
    assert tuple(one) == ("0.1", "0.1", "09")


def test_sets_are_written_compressed(spark, tmp_path):
    sets = spark.createDataFrame(
        [("a/b/c/d", "DC2", [("orders", "1"), ("lineitem", "1,2")])],
        "db_id string, dc string, tuples array<struct<relation: string, pk: string>>",
    )
    want = [("a/b/c/d", "DC2", "orders#1|lineitem#1,2", "lineitem", "1,2"), ("a/b/c/d", "DC2", "orders#1|lineitem#1,2", "orders", "1")]
    for name, layout, read in (
        ("keyed", violation_files.keyed_layout, read_keyed),
        ("listed", violation_files.listed_layout, violation_files.read_listed),
    ):
        path = tmp_path / name
        violation_files.write_sets(layout(sets), str(path))
        files = [f.name for f in path.rglob("part-*")]
        assert files and all(f.endswith(".json.gz") for f in files)
        assert sorted(map(tuple, read(spark, str(path)).collect())) == want


def test_key_lists_of_any_form(spark, tmp_path):
    """One key is cut from its list, others are parsed; names follow the constraint's order of relations."""
    place = tmp_path / "scale=s" / "subset=t" / "ratio=r" / "seed=d"
    place.mkdir(parents=True)
    values = ["7", "[7]", "[-7]", '"7"', '["7"]', "[[7]]", "[7, 8]", "[]"]
    lines = [f'{{"dc": "DC4", "tuples": {{"part": {v}, "lineitem": [[1, 2], [3,4]], "other": [[5, 6]]}}}}' for v in values]
    lines.append('{"dc": "unknown", "tuples": {"lineitem": [[1, 2]]}}')
    (place / "sets.json").write_text("\n".join(lines))
    found = [tuple(r)[2:] for r in read_keyed(spark, str(tmp_path)).collect()]
    lines_of = "lineitem#1,2|lineitem#3,4"
    want = [(None, "lineitem", "1,2")]
    for parts in (["7"], ["7"], ["-7"], ["7"], ["7"], ["7"], ["7", "8"], []):
        name = "|".join([lines_of, *[f"part#{p}" for p in parts]])
        want += [(name, "part", p) for p in parts]
        want += [(name, "lineitem", "1,2"), (name, "lineitem", "3,4"), (name, "other", "5,6")]
    assert sorted(found, key=repr) == sorted(want, key=repr)
