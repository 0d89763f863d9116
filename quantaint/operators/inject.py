"""Reproducible violations for many scenarios in one plan.

A scenario does not copy the database. It owns the after-images of the rows it
changes ("touched" rows); everything else is read from the base tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaint.functions.hashing import BITS, digest_words, with_draws
from quantaint.functions.labels import safe_ratio_count
from quantaint.operators.constraints import INJECTED, join_relations
from quantaint.operators.scenarios import Scenario, db_ids, literal_rows, scenario_frame
from quantaint.schema import DEALT, KEYS
from quantaint.sources.database import Database
from quantaint.sources.store import CODEC, keep


@dataclass(frozen=True)
class Injection:
    relation: str
    column: str
    eligible: str
    new_value: str


# Which rows may be changed for a constraint, and how.
INJECTIONS: dict[str, Injection] = {
    "DC1": Injection(
        "lineitem", "l_receiptdate", "l_receiptdate >= l_shipdate", "date_sub(l_shipdate, 1)"
    ),
    "DC2": Injection(
        "lineitem", "l_commitdate", "l_commitdate >= o_orderdate", "date_sub(o_orderdate, 1)"
    ),
    "DC3": Injection(
        "lineitem", "l_linestatus", "o_orderstatus = 'F' AND l_linestatus = 'F'", "'O'"
    ),
    "DC4": Injection("partsupp", "ps_availqty", "ps_availqty >= 0", "-abs(ps_availqty) - 1"),
}

# Rows that one task ranks at a sample's cut; larger inputs narrow the cut first.
CUT_ROWS = 50_000
# Hash bits resolved per narrowing pass (4096 counters per draw).
PASS_BITS = 12
PAST_ALL = 2**BITS
# Bits of one bitmap row (as Spark's bitmap functions have them), bits per pair, and most rows: 32 MB.
BITMAP_BITS = 32_768
PAIR_BITS = 16
BITMAP_BUCKETS = 8192

_PLACE = ["dc", "draw", "prefix"]
_PAYLOAD = {
    "lineitem": (
        "l_partkey", "l_suppkey", "l_shipdate", "l_commitdate", "l_receiptdate", "l_linestatus",
    ),
    "partsupp": ("ps_availqty",),
}


@dataclass(frozen=True)
class Overlay:
    """What a list of scenarios changes in one database."""

    database: Database
    scenarios: list[Scenario]
    targets: DataFrame
    touched: Mapping[str, DataFrame]


def injection_targets(db: Database, scenarios: list[Scenario]) -> DataFrame:
    """Rows each scenario asks to change per constraint.

    The base is the table the constraint's injection updates.
    """
    names = F.array(*[F.lit(dc) for dc in INJECTIONS])
    base = F.create_map(
        *[
            item
            for dc, inj in INJECTIONS.items()
            if inj.relation in db
            for item in (F.lit(dc), F.lit(db.rows(inj.relation)).cast("bigint"))
        ]
    )
    return (
        scenario_frame(db.spark, scenarios)
        .select("*", F.explode("dcs").alias("dc"))
        .withColumn("base_rows", F.element_at(base, F.col("dc")))
        .withColumn("requested", safe_ratio_count(F.col("base_rows"), F.col("ratio_value")))
        .withColumn("draw", F.col("seed_value") * 1000 + 1 + F.array_position(names, F.col("dc")) - 1)
        .select("db_id", "dc", "draw", "base_rows", "requested")
    )


def base_rows_of(db: Database, relation: str) -> DataFrame:
    """The columns of a relation that injections and constraints use."""
    return db[relation].select(*KEYS[relation], *_PAYLOAD[relation])


def with_order(db: Database, lines: DataFrame, dcs: list[str]) -> DataFrame:
    """Lines with the order columns that the conditions of ``dcs`` read."""
    if not any("o_" in INJECTIONS[dc].eligible for dc in dcs):
        return lines
    return join_relations({**db, "lineitem": lines}, ("lineitem", "orders"), "left").select(
        *lines.columns, "o_orderdate", "o_orderstatus"
    )


def _allowed(dcs: list[str]) -> Column:
    """True where the row may be changed for the constraint it is drawn for."""
    allowed = F.lit(False)
    for dc in dcs:
        allowed = allowed | ((F.col("dc") == dc) & F.expr(INJECTIONS[dc].eligible))
    return allowed


def eligible_lines(db: Database, lines: DataFrame, dcs: list[str]) -> DataFrame:
    """Lines, each drawn for a constraint ``dc``, that its injection may change."""
    return with_order(db, lines, dcs).filter(_allowed(dcs)).drop("o_orderstatus")


def eligible_supplies(db: Database, supplies: DataFrame) -> DataFrame:
    """Part supplies with stock that some line and an existing part refer to.

    The lines' pairs are reduced before the shuffle, so a pair held by very many
    lines leaves each map task once.
    """
    return _supplied(db, supplies.filter(INJECTIONS["DC4"].eligible), db["lineitem"])


def near_eligible_supplies(db: Database, supplies: DataFrame) -> DataFrame:
    """``eligible_supplies`` of a small share of all supplies.

    A bitmap of their pairs is looked up in the scan of the lines, so few lines without such a
    pair reach the distinct pairs and their shuffle; the join then decides exactly. The bitmap
    has at most ``BITMAP_BUCKETS`` rows of 4 KB, whatever the number of supplies; a full one
    only lets more lines pass.
    """
    stocked = keep(supplies.filter(INJECTIONS["DC4"].eligible), "near-supplies")
    buckets = max(1, min(BITMAP_BUCKETS, stocked.count() * PAIR_BITS // BITMAP_BITS))
    bitmap = stocked.groupBy(_bucket(buckets, "ps_partkey", "ps_suppkey").alias("bucket")).agg(
        F.bitmap_construct_agg(_bit("ps_partkey", "ps_suppkey")).alias("bitmap")
    )
    bit = _bit("l_partkey", "l_suppkey")
    byte = F.expr("conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10)")
    lines = (
        db["lineitem"]
        .select(
            "l_partkey",
            "l_suppkey",
            _bucket(buckets, "l_partkey", "l_suppkey").alias("bucket"),
            bit.alias("bit"),
        )
        .join(F.broadcast(bitmap), "bucket")
        .filter(F.getbit(byte.cast("int"), (F.col("bit") % 8).cast("int")) == 1)
    )
    return _supplied(db, stocked, lines)


def _supplied(db: Database, supplies: DataFrame, lines: DataFrame) -> DataFrame:
    pairs = lines.select("l_partkey", "l_suppkey").distinct()
    same_pair = (F.col("l_partkey") == F.col("ps_partkey")) & (
        F.col("l_suppkey") == F.col("ps_suppkey")
    )
    return supplies.join(pairs, same_pair, "left_semi").join(
        db["part"], F.col("ps_partkey") == F.col("p_partkey"), "left_semi"
    )


def _bucket(buckets: int, *keys: str) -> Column:
    """Which bitmap of ``buckets`` a pair of keys belongs to, by bits that ``_bit`` does not use."""
    return F.pmod(F.shiftright(F.xxhash64(*keys), 20), F.lit(buckets))


def _bit(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS).cast("bigint"))


def draw_number(dc: str, seed: int) -> int:
    """A scenario seed gives each constraint its own draw."""
    return seed * 1000 + 1 + list(INJECTIONS).index(dc)


def draw(
    db: Database,
    relation: str,
    scenarios: list[Scenario],
    targets: DataFrame,
    cut_rows: int = CUT_ROWS,
) -> DataFrame:
    """The first ``requested`` eligible rows of each target in hash order.

    Hashes depend on (constraint, seed, key) only, so scenarios that share a seed
    share the draw. If all draws together keep few rows, those far beyond every cut are
    dropped before eligibility is looked up by a join; otherwise the join sees each row
    once and the draws are repeated behind it. The cut is located on hash prefixes: each pass
    counts rows per next prefix inside the prefix that contains the cut, until that
    prefix holds about ``cut_rows`` rows; only those are ranked, all smaller
    hashes are taken as they are. Fewer eligible rows than requested takes all.
    """
    dcs, draws = _draws(relation, scenarios)
    keys = KEYS[relation]

    def hashed(rows: DataFrame) -> DataFrame:
        worded = rows.withColumn("words", digest_words(f"concat_ws(',', {', '.join(keys)})"))
        repeated = worded.select("*", F.inline(literal_rows(draws)))
        return with_draws(repeated, {"h": "words"}, "draw").drop("words")

    # One row per scenario and constraint: bounded by the scenario list.
    cuts = targets.filter(F.col("dc").isin(dcs) & (F.col("requested") > 0)).select(
        "db_id",
        "dc",
        "draw",
        F.lit(0).cast("bigint").alias("prefix"),
        F.col("requested").alias("rest"),
    )
    start = F.lit(0).cast("bigint")
    base = base_rows_of(db, relation)
    several, passes, rows = db.rows(relation) > cut_rows, 0, None
    share = min(1.0, 4 * max(s.ratio for s in scenarios))
    if several and share * len(draws) < 1:
        near = hashed(base).filter(F.col("h") < (ceil(share * 2**PASS_BITS) + 1) << (BITS - PASS_BITS))
        near = eligible_lines(db, near, dcs) if relation == "lineitem" else near_eligible_supplies(db, near)
        near = keep(near, "near-rows")
        found = keep(_narrow(near.withColumn("prefix", start), cuts, 0), "cuts")
        # A share r of the rows lies below hash r, so four times the largest ratio is normally
        # more than enough; if too few of these rows are eligible, all rows are looked at.
        if found.filter(F.col("prefix") == PAST_ALL).isEmpty():
            rows, cuts, passes = near, found, 1
    if rows is None:
        if relation == "lineitem":
            whole = with_order(db, base, dcs)
        else:
            whole = eligible_supplies(db, base)
        if several:
            # A row is dealt by its key before it is repeated, so that its changes meet in one task.
            whole = keep(whole, "eligible-rows", (), DEALT[relation], db.parts)
        rows = hashed(whole).filter(_allowed(dcs)).drop("o_orderstatus")
    while db.rows(relation) >> (PASS_BITS * passes) > cut_rows:
        if passes == 0:
            inside = rows.withColumn("prefix", start)
        else:
            places = F.broadcast(cuts.select(*_PLACE).distinct())
            inside = rows.withColumn("prefix", _prefix(PASS_BITS * passes)).join(places, _PLACE)
        cuts = keep(_narrow(inside, cuts, PASS_BITS * passes), "cuts")
        passes += 1

    # Only rows at a cut are shuffled and ranked, to find the last one taken; the order is total
    # but for equal rows, which become one change.
    head = _prefix(PASS_BITS * passes)
    order = ["h", *keys, *[c for c in rows.columns if c not in ("h", "dc", "draw", *keys)]]
    rank = F.row_number().over(Window.partitionBy("db_id", "dc").orderBy(*order))
    last = (
        rows.join(F.broadcast(cuts), ["dc", "draw"])
        .filter(head == F.col("prefix"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= F.col("rest"))
        .groupBy("db_id", "dc")
        .agg(F.max(F.struct(*order)).alias("last"))
    )
    last = keep(cuts.join(last, ["db_id", "dc"], "left").drop("rest"), "last-rows")
    drawn = rows.join(F.broadcast(last), ["dc", "draw"])
    at_cut = (head == F.col("prefix")) & (F.struct(*order) <= F.col("last"))
    return drawn.filter((head < F.col("prefix")) | at_cut).drop("h", "prefix", "last", "draw")


def _draws(relation: str, scenarios: list[Scenario]) -> tuple[list[str], list[dict]]:
    """Constraints the scenarios inject into a relation, and their distinct draws."""
    wanted = {(dc, s.seed) for s in scenarios for dc in s.constraints}
    pairs = sorted((dc, seed) for dc, seed in wanted if INJECTIONS[dc].relation == relation)
    draws = [{"dc": dc, "draw": draw_number(dc, seed)} for dc, seed in pairs]
    return sorted({dc for dc, _ in pairs}), draws


def _prefix(bits: int) -> Column:
    return F.shiftright("h", BITS - bits)


def _narrow(rows: DataFrame, cuts: DataFrame, known: int) -> DataFrame:
    """Extend every cut's prefix by the bits that contain its last row."""
    place = _PLACE
    counts = rows.groupBy(*place, _prefix(known + PASS_BITS).alias("next")).agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = F.sum("n").over(Window.partitionBy(*place).orderBy("next"))
    spans = counts.select(*place, "next", upto.alias("upto"), (upto - F.col("n")).alias("before"))
    inside = (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("upto"))
    c, s = cuts.alias("c"), spans.alias("s")
    same = [F.col(f"c.{p}") == F.col(f"s.{p}") for p in place]
    return c.join(s, [*same, inside], "left").select(
        "c.db_id",
        "c.dc",
        "c.draw",
        F.coalesce("s.next", F.lit(PAST_ALL)).alias("prefix"),
        F.when(F.col("s.next").isNull(), 0)
        .otherwise(F.col("c.rest") - F.col("s.before"))
        .alias("rest"),
    )


def inject(db: Database, scenarios: list[Scenario], cut_rows: int = CUT_ROWS) -> Overlay:
    """Choose and change rows for every scenario."""
    targets = keep(injection_targets(db, scenarios), "targets")
    touched: dict[str, DataFrame] = {}
    for relation in INJECTED:
        dcs, _ = _draws(relation, scenarios)
        if dcs:
            drawn = draw(db, relation, scenarios, targets, cut_rows)
            images, label = _after_images(drawn, dcs), f"touched-{relation}"
            # Changed lines lie with their orders; supplies meet lines of any number, which adaptive
            # skew splitting can deal to several tasks only behind a shuffle of both.
            dealt = (DEALT[relation], db.parts) if relation == "lineitem" else ((), 0)
            touched[relation] = keep(images, label, (), *dealt, CODEC)
    return Overlay(db, scenarios, targets, touched)


def _after_images(drawn: DataFrame, dcs: list[str]) -> DataFrame:
    """One row per changed tuple and scenario, with all its changes applied.

    Grouping by the full row keeps the aggregate on fixed-width flags.
    """
    row = [c for c in drawn.columns if c != "dc"]
    flagged = drawn.groupBy(*row).agg(
        *[F.bool_or(F.col("dc") == dc).alias(_flag(dc)) for dc in dcs]
    )
    changed = {
        INJECTIONS[dc].column: F.when(F.col(_flag(dc)), F.expr(INJECTIONS[dc].new_value)).otherwise(
            F.col(INJECTIONS[dc].column)
        )
        for dc in dcs
    }
    return flagged.withColumns(changed).drop("o_orderdate")


def _flag(dc: str) -> str:
    return f"hit_{dc.lower()}"


def applied_changes(overlay: Overlay) -> DataFrame:
    """(db_id, dc, key text columns …) of each change, long."""
    frames = []
    for relation, rows in overlay.touched.items():
        dcs = [dc for dc, inj in INJECTIONS.items() if _flag(dc) in rows.columns]
        hits = F.array_compact(F.array(*[F.when(F.col(_flag(dc)), F.lit(dc)) for dc in dcs]))
        frames.append(
            rows.select(
                "db_id",
                F.explode(hits).alias("dc"),
                F.lit(relation).alias("relation"),
                F.concat_ws(",", *KEYS[relation]).alias("pk"),
            )
        )
    first, *others = frames
    for frame in others:
        first = first.unionByName(frame)
    return first


def injection_log(overlay: Overlay) -> DataFrame:
    applied = applied_changes(overlay).groupBy("db_id", "dc").agg(F.count(F.lit(1)).alias("applied"))
    return overlay.targets.join(applied, ["db_id", "dc"], "left").select(
        "db_id", "dc", "requested", F.coalesce("applied", F.lit(0)).cast("bigint").alias("applied")
    )


def changed_values(overlay: Overlay, relation: str) -> DataFrame:
    """The overlay as data: new values only, null where a column is unchanged."""
    rows = overlay.touched[relation]
    new = [
        F.when(F.col(_flag(dc)), F.col(inj.column)).alias("new_" + inj.column.split("_", 1)[1])
        for dc, inj in INJECTIONS.items()
        if inj.relation == relation and _flag(dc) in rows.columns
    ]
    return rows.select("db_id", *KEYS[relation], *new)


def violated_relation(overlay: Overlay, relation: str) -> DataFrame:
    """Full table of every scenario: base rows with its changes applied.

    The changes of a key are gathered in one row, at most one per scenario, so each base row
    is joined once and repeated for the scenarios afterwards.
    """
    base = overlay.database[relation]
    each = F.explode(db_ids(overlay.scenarios)).alias("db_id")
    if relation not in overlay.touched:
        return base.select("*", each)
    new = changed_values(overlay, relation)
    names = [c for c in new.columns if c.startswith("new_")]
    changes = new.groupBy(*KEYS[relation]).agg(
        F.map_from_entries(F.collect_list(F.struct("db_id", F.struct(*names)))).alias("changes")
    )
    columns = {c.name: F.col(c.name) for c in base.schema}
    for inj in INJECTIONS.values():
        name = "new_" + inj.column.split("_", 1)[1]
        if inj.relation == relation and name in names:
            columns[inj.column] = F.coalesce(F.col("change")[name], F.col(inj.column)).alias(inj.column)
    return (
        base.join(changes, list(KEYS[relation]), "left")
        .select("*", each)
        .withColumn("change", F.element_at("changes", F.col("db_id")))
        .select("db_id", *columns.values())
    )


def narrowed(overlay: Overlay, scenarios: list[Scenario]) -> Overlay:
    """The same overlay seen by some of its scenarios only."""
    ids = db_ids(scenarios)

    def only(df: DataFrame) -> DataFrame:
        return df.filter(F.array_contains(ids, F.col("db_id")))

    return Overlay(
        overlay.database,
        scenarios,
        only(overlay.targets),
        {rel: only(rows) for rel, rows in overlay.touched.items()},
    )


def first_scenarios(overlay: Overlay, limit: int) -> Overlay:
    """The first ``limit`` scenarios by database id; 0 means all."""
    if limit <= 0:
        return overlay
    spark = overlay.database.spark
    ids = scenario_frame(spark, overlay.scenarios).select("db_id").collect()
    order = sorted(range(len(ids)), key=lambda i: ids[i].db_id)
    return narrowed(overlay, [overlay.scenarios[i] for i in order[:limit]])
