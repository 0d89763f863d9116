"""Violating sets as JSON, in both layouts, partitioned by scenario.

Keyed layout: {"dc": …, "tuples": {"orders": [1], "lineitem": [[1, 2]]}}.
Listed layout: {"dc": …, "tuples": [{"table": "orders", "pk": {"o_orderkey": 1}}, …]}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaint.functions.keys import normalise_pk_text, tuple_id
from quantaint.operators.constraints import CONSTRAINTS
from quantaint.operators.scenarios import split_db_id
from quantaint.schema import KEYS, SCENARIO_COLUMNS
from quantaint.sources.tables import by_folder

_LABELS = ", ".join(f"{c} string" for c in SCENARIO_COLUMNS)
_RELATIONS = sorted({rel for dc in CONSTRAINTS.values() for rel in dc.relations})


def _numbers(pk: Column) -> Column:
    return F.transform(F.split(pk, ","), lambda part: part.cast("bigint"))


def _keys_of(relation: str) -> Column:
    """The set's keys in one relation, null if it has none."""
    many = len(KEYS[relation]) > 1
    own = F.transform(
        F.filter("tuples", lambda t: t["relation"] == relation),
        lambda t: _numbers(t["pk"]) if many else t["pk"].cast("bigint"),
    )
    return F.when(F.size(own) > 0, own)


def keyed_layout(sets: DataFrame) -> DataFrame:
    """One field per relation; single-column keys are plain numbers."""
    fields = [_keys_of(rel).alias(rel) for rel in _RELATIONS]
    return split_db_id(sets).select(*SCENARIO_COLUMNS, "dc", F.struct(*fields).alias("tuples"))


def listed_layout(sets: DataFrame) -> DataFrame:
    def entry(t: Column) -> Column:
        names = reduce(
            lambda other, rel: F.when(
                t["relation"] == rel, F.array(*[F.lit(k) for k in KEYS[rel]])
            ).otherwise(other),
            _RELATIONS,
            F.lit(None).cast("array<string>"),
        )
        return F.struct(
            t["relation"].alias("table"), F.map_from_arrays(names, _numbers(t["pk"])).alias("pk")
        )

    return split_db_id(sets).select(
        *SCENARIO_COLUMNS, "dc", F.transform("tuples", entry).alias("tuples")
    )


def write_sets(records: DataFrame, path: str) -> None:
    """JSON lines, compressed, under scale=/subset=/ratio=/seed=/constraint= folders."""
    folders = [*SCENARIO_COLUMNS, "constraint"]
    by_folder(records.withColumn("constraint", F.col("dc")), folders).write.option("compression", "gzip").partitionBy(*folders).json(path)


def read_keyed(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Membership rows from the keyed layout.

    Accepts JSON lines, or with ``whole_file`` one array, or one object with the
    array under "mis", per file. Anything else is an error. Relations may hold
    one key, a list of numbers or a list of lists; null relations are skipped.
    """
    schema = (
        "dc string, tuples map<string, string>, "
        "mis array<struct<dc: string, tuples: map<string, string>>>, " + _LABELS
    )
    rows = spark.read.schema(schema).option("multiLine", whole_file).json(path)
    record = F.struct("dc", "tuples")
    sets = rows.select(
        *SCENARIO_COLUMNS,
        F.explode(
            F.when(F.col("mis").isNotNull(), F.col("mis"))
            .when(F.col("tuples").isNotNull(), F.array(record))
            .otherwise(F.raise_error(F.lit("unexpected structure of violation file")))
        ).alias("s"),
    ).select(*SCENARIO_COLUMNS, "s.dc", "s.tuples")
    keys = F.transform(
        F.map_entries(F.map_filter("tuples", lambda _, text: text.isNotNull())),
        lambda entry: F.transform(
            _key_items(entry["value"]),
            lambda key: F.struct(
                entry["key"].alias("relation"), normalise_pk_text(key).alias("pk")
            ),
        ),
    )
    return _membership(sets.withColumn("tuples", F.flatten(keys)))


def _key_items(text: Column) -> Column:
    """The keys in a JSON value; a list of one key of one or two numbers is cut without a parser."""
    shape = F.translate(text, "-0123456789", "")
    one = ((shape == "[]") & (text != "[]")) | (shape == "[[,]]")
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    several = F.from_json(text, "array<string>")
    return F.when(one, F.array(inner)).when(F.ltrim(text).startswith("["), several).otherwise(F.array(text))


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """Membership rows from the listed layout."""
    schema = (
        "dc string, tuples array<struct<`table`: string, pk: map<string, bigint>>>, " + _LABELS
    )
    rows = spark.read.schema(schema).json(path)

    def member(t: Column) -> Column:
        text = reduce(
            lambda other, rel: F.when(
                t["table"] == rel,
                F.concat_ws(",", *[t["pk"][key].cast("string") for key in KEYS[rel]]),
            ).otherwise(other),
            _RELATIONS,
            F.raise_error(F.concat(F.lit("unknown table "), t["table"])),
        )
        return F.struct(t["table"].alias("relation"), text.alias("pk"))

    return _membership(
        rows.select(*SCENARIO_COLUMNS, "dc", F.transform("tuples", member).alias("tuples"))
    )


def _placed_name(t: Column, i: Column) -> Column:
    place = F.array_position(F.col("order"), t["relation"])
    return F.struct(
        place.alias("place"), i.alias("i"), F.when(place > 0, tuple_id(t["relation"], t["pk"])).alias("name")
    )


def _membership(sets: DataFrame) -> DataFrame:
    """Explode to (db_id, dc, mis_id, relation, pk).

    A set's identity lists its tuples in the constraint's relation order.
    """
    order = reduce(
        lambda other, dc: F.when(
            F.col("dc") == dc.name, F.array(*[F.lit(r) for r in dc.relations])
        ).otherwise(other),
        CONSTRAINTS.values(),
        F.lit(None).cast("array<string>"),
    )
    # One pass over the tuples: by place of the relation, then as they come; others have no name.
    named = F.transform("tuples", _placed_name)
    names = F.when(F.col("order").isNotNull(), F.sort_array(named)["name"])
    # An inner inline would test the tuples in a filter of its own, which builds them two more times.
    return (
        sets.withColumn("order", order)
        .withColumn("mis_id", F.array_join(names, "|"))
        .select(
            F.concat_ws("/", *SCENARIO_COLUMNS).alias("db_id"),
            "dc",
            "mis_id",
            F.inline_outer("tuples"),
        )
        .filter("relation IS NOT NULL")
    )
