"""Complete the driver's tables into the eight relations the constraints need.

The raw tables lack partsupp, some lineitem columns and a unique lineitem key;
FIXTURES.md states the rules, all in integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaint.schema import DEALT
from quantaint.sources.database import Database, bucket_count
from quantaint.sources.store import keep

# Nation names by key 0..24.
NATION_NAMES = (
    "ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "FRANCE",
    "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA",
    "MOROCCO", "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA", "SAUDI ARABIA", "VIETNAM",
    "RUSSIA", "UNITED KINGDOM", "UNITED STATES",
)
SHIP_MODES = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
SHIP_INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")

_LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]

_databases: dict[tuple[str, str], Database] = {}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_database(spark: SparkSession, sf_dir: str) -> Database:
    """Orders and lineitem as delivered (they violate constraints and keys)."""
    return Database(
        {
            "orders": raw_table(spark, sf_dir, "orders"),
            "lineitem": raw_table(spark, sf_dir, "lineitem"),
        }
    )


def clean_database(spark: SparkSession, sf_dir: str) -> Database:
    """The completed relations of a directory.

    Those that take more than a projection, or whose dates are filtered on, are
    written once per application, dealt by the keys they are joined by; filters then reach their files.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _databases:
        parts = bucket_count(spark, raw_table(spark, sf_dir, "lineitem").count())
        _databases[key] = Database(derive_tables(spark, sf_dir, parts), parts)
    return _databases[key]


def derive_tables(spark: SparkSession, sf_dir: str, parts: int) -> dict[str, DataFrame]:
    def dealt(df: DataFrame, name: str) -> DataFrame:
        return keep(df, f"relation-{name}", (), DEALT[name], parts)

    lines = raw_table(spark, sf_dir, "lineitem").withColumn("l_orderkey", _big("l_orderkey"))
    orders = dealt(_orders(raw_table(spark, sf_dir, "orders")), "orders")
    # An order's lines are dealt once, to be numbered, dated and written in one task.
    by_order = lines.repartition(parts, *DEALT["lineitem"])
    return {
        "region": raw_table(spark, sf_dir, "region").select(_big("r_regionkey"), "r_name"),
        "nation": _nation(raw_table(spark, sf_dir, "nation")),
        "supplier": raw_table(spark, sf_dir, "supplier").select(
            _big("s_suppkey"), "s_name", _big("s_nationkey"), "s_acctbal"
        ),
        "customer": raw_table(spark, sf_dir, "customer").select(
            _big("c_custkey"), "c_name", _big("c_nationkey"), "c_acctbal", "c_mktsegment"
        ),
        "part": raw_table(spark, sf_dir, "part").select(
            _big("p_partkey"), "p_name", "p_brand", "p_type", _big("p_size"), "p_retailprice"
        ),
        "partsupp": dealt(_partsupp(lines), "partsupp"),
        "orders": orders,
        "lineitem": dealt(_lineitem(by_order, orders), "lineitem"),
    }


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _pick(values: tuple[str, ...], position: str) -> Column:
    """1-based element of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(position).cast("int"))


def _nation(raw: DataFrame) -> DataFrame:
    return raw.select(
        _big("n_nationkey"),
        _pick(NATION_NAMES, "n_nationkey + 1").alias("n_name"),
        _big("n_regionkey"),
    )


def _orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        _big("o_orderkey"),
        _big("o_custkey"),
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        "o_orderpriority",
    )


def _partsupp(raw_lines: DataFrame) -> DataFrame:
    pairs = raw_lines.select(
        F.col("l_partkey").cast("bigint").alias("ps_partkey"),
        F.col("l_suppkey").cast("bigint").alias("ps_suppkey"),
    ).distinct()
    return pairs.select(
        "*",
        F.expr("1 + (ps_partkey * 31 + ps_suppkey * 17) % 9999").alias("ps_availqty"),
        F.expr("cast(1 + (ps_partkey * 13 + ps_suppkey * 7) % 1000 as double)").alias(
            "ps_supplycost"
        ),
    )


def _lineitem(raw: DataFrame, orders: DataFrame) -> DataFrame:
    lines = raw.select(
        _big("l_orderkey"), _big("l_partkey"), _big("l_suppkey"), _big("l_linenumber"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate",
    )
    # An order has few lines.
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    numbered = lines.withColumn("ln", number.cast("bigint"))
    dated = numbered.join(
        orders.select("o_orderkey", "o_orderdate", "o_orderstatus"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).withColumn(
        "ship",
        F.expr("date_add(o_orderdate, cast(1 + (l_orderkey*7 + ln*13 + l_partkey) % 121 as int))"),
    )
    return dated.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("ln").alias("l_linenumber"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        F.when(F.col("o_orderstatus") == "F", F.lit("F"))
        .otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.col("ship").alias("l_shipdate"),
        F.expr(
            "date_add(o_orderdate, cast(30 + (l_orderkey*11 + ln*5 + l_suppkey) % 61 as int))"
        ).alias("l_commitdate"),
        F.expr("date_add(ship, cast(1 + (l_orderkey*3 + ln*17) % 30 as int))").alias(
            "l_receiptdate"
        ),
        _pick(SHIP_INSTRUCTIONS, "1 + (l_orderkey + ln*7 + l_suppkey) % 4").alias(
            "l_shipinstruct"
        ),
        _pick(SHIP_MODES, "1 + (l_orderkey*5 + ln*3 + l_partkey) % 7").alias("l_shipmode"),
    )
