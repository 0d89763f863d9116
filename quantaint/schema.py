"""Relations, their keys and how they join."""

from __future__ import annotations

# Column order and types of the eight relations as they appear in
# their delimited files (bigint, double, date; everything else is text).
RELATION_COLUMNS: dict[str, str] = {
    "region": "r_regionkey bigint, r_name string, r_comment string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string",
    "supplier": (
        "s_suppkey bigint, s_name string, s_address string, s_nationkey bigint, "
        "s_phone string, s_acctbal double, s_comment string"
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_address string, c_nationkey bigint, "
        "c_phone string, c_acctbal double, c_mktsegment string, c_comment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, "
        "p_size bigint, p_container string, p_retailprice double, p_comment string"
    ),
    "partsupp": (
        "ps_partkey bigint, ps_suppkey bigint, ps_availqty bigint, "
        "ps_supplycost double, ps_comment string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority bigint, "
        "o_comment string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, "
        "l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string"
    ),
}

# The identifying columns of each relation.
KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "supplier": ("s_suppkey",),
    "customer": ("c_custkey",),
    "part": ("p_partkey",),
    "partsupp": ("ps_partkey", "ps_suppkey"),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
}

# Foreign keys, written (child, parent) -> child columns aligned
# with the parent's key.
FOREIGN_KEYS: dict[tuple[str, str], tuple[str, ...]] = {
    ("nation", "region"): ("n_regionkey",),
    ("supplier", "nation"): ("s_nationkey",),
    ("customer", "nation"): ("c_nationkey",),
    ("partsupp", "part"): ("ps_partkey",),
    ("orders", "customer"): ("o_custkey",),
    ("lineitem", "orders"): ("l_orderkey",),
    ("lineitem", "supplier"): ("l_suppkey",),
    ("lineitem", "partsupp"): ("l_partkey", "l_suppkey"),
}

# Columns by which the written tables of a relation are dealt into buckets: lines lie with their order.
DEALT: dict[str, tuple[str, ...]] = {
    "lineitem": ("l_orderkey",),
    "orders": ("o_orderkey",),
    "partsupp": ("ps_partkey", "ps_suppkey"),
}

MEASURES: tuple[str, ...] = ("CBM", "CIM", "PIM", "RIM")
SCENARIO_COLUMNS: tuple[str, ...] = ("scale", "subset", "ratio", "seed")


def columns_of(relation: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a relation in file order."""
    return [tuple(item.split()) for item in RELATION_COLUMNS[relation].split(", ")]


def determines(child: str, target: str, within: tuple[str, ...]) -> bool:
    """True when a row of ``child`` fixes the row of ``target`` it joins to.

    Follows foreign keys child -> parent, passing only through relations that
    take part in the join.
    """
    if child == target:
        return True
    return any(
        determines(parent, target, within)
        for (source, parent) in FOREIGN_KEYS
        if source == child and parent in within
    )
