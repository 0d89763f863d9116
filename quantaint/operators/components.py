"""Hitting sets of arbitrary families: connected parts, then bounds where no tuple is in all sets.

The problem is NP-hard in general. A part without a hub is first reduced exactly: supersets and
dominated tuples go and the tuple of a set of one is taken, until nothing changes; cycles of pairs that
are left have a known size. What is left then gets an upper bound (a cover chosen by rounds of locally greatest degree) and a lower one (sets
chosen by rounds that share no tuple, or shares of sets of which no tuple has more than one). All are joins and aggregates over the rows of the parts, whatever their size. Where
the bounds of a tuple meet, its status is OPTIMAL, else FEASIBLE with the upper bound as gamma.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaint.functions.keys import tuple_id
from quantaint.operators.hitting import tuple_counts
from quantaint.sources.store import keep

# Sets of a centre on average up to which they are counted in one task.
LOCAL_SETS = 10_000


def connected_parts(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group, tid, root): the smallest tuple name of each tuple's part.

    Every set contributes a star around its smallest tuple. Rounds of large-star
    and small-star steps link each tuple to the smallest neighbour seen so far
    until only stars around the roots remain. Steps aggregate a minimum per tuple
    and join it back; neighbourhoods are never collected.
    """
    names = _names(sets, group)
    everyone = names.select(*group, F.explode("names").alias("tid")).distinct()
    return everyone.join(_links(names, group), [*group, "tid"], "left").withColumn(
        "root", F.coalesce("root", "tid")
    )


def _names(sets: DataFrame, group: list[str]) -> DataFrame:
    return sets.select(
        *group,
        F.transform("tuples", lambda t: tuple_id(t["relation"], t["pk"])).alias("names"),
    )


def _links(names: DataFrame, group: list[str]) -> DataFrame:
    """(group, tid, root) of every tuple but the roots."""
    stars = names.select(*group, F.array_min("names").alias("low"), F.explode("names").alias("high"))
    return _contract(stars.filter("high <> low").distinct(), group)


def _contract(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, tid, root) of every tuple on edges (group, high, low), but for the roots themselves."""
    edges = keep(edges, "part-edges")
    while not _only_stars(edges, group):
        edges = keep(_small_star(_large_star(edges, group), group), "part-edges")
    return edges.select(*group, F.col("high").alias("tid"), F.col("low").alias("root"))


def _only_stars(edges: DataFrame, group: list[str]) -> bool:
    """True if every tuple hangs on one other, which hangs on none: no step would change that."""
    one, none = F.lit(1).alias("hangs"), F.lit(0).alias("hangs")
    ends = F.array(F.struct(F.col("high").alias("tid"), one), F.struct(F.col("low").alias("tid"), none))
    return (
        edges.select(*group, F.inline(ends))
        .groupBy(*group, "tid")
        .agg(F.sum("hangs").alias("hangs"), F.bool_or(F.col("hangs") == 0).alias("holds"))
        .filter((F.col("hangs") > 1) | ((F.col("hangs") > 0) & F.col("holds")))
        .isEmpty()
    )


def _both_ways(edges: DataFrame, group: list[str]) -> DataFrame:
    forward = edges.select(*group, F.col("high").alias("u"), F.col("low").alias("v"))
    backward = edges.select(*group, F.col("low").alias("u"), F.col("high").alias("v"))
    return forward.unionByName(backward)


def _large_star(edges: DataFrame, group: list[str]) -> DataFrame:
    """Link every larger neighbour of a tuple to the smallest tuple around it."""
    around = _both_ways(edges, group)
    least = around.groupBy(*group, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        around.filter("v > u")
        .join(least, [*group, "u"])
        .select(*group, F.col("v").alias("high"), F.col("m").alias("low"))
        .distinct()
    )


def _small_star(edges: DataFrame, group: list[str]) -> DataFrame:
    """Link a tuple and its smaller neighbours to the smallest of them."""
    least = edges.groupBy(*group, "high").agg(F.min("low").alias("m"))
    moved = edges.join(least, [*group, "high"]).select(
        *group, F.col("low").alias("high"), F.col("m").alias("low")
    )
    own = least.select(*group, "high", F.col("m").alias("low"))
    return moved.unionByName(own).filter("high <> low").distinct()


def hitting_bounds(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_sets, n_nodes, hitting_low, hitting_high, status): the least hitting set of each whole family."""
    each = _tuple_costs(sets, group)
    low, high = F.col("total_low"), F.col("total_high")
    return _totals(each, group).select(
        *group,
        "n_sets",
        "n_nodes",
        low.alias("hitting_low"),
        high.alias("hitting_high"),
        F.when(low == high, "OPTIMAL").otherwise("FEASIBLE").alias("status"),
    )


def general_gamma(sets: DataFrame, group: list[str]) -> DataFrame:
    """gamma of every tuple, for families with or without hubs, with ``gamma_low`` and ``status``.

    The minimum is additive over connected parts. A part with a hub costs one; other
    parts are bounded from both sides.
    """
    each = _tuple_costs(sets, group)
    low = F.col("total_low") - F.col("cost_low") + F.col("without_low")
    high = F.col("total_high") - F.col("cost_high") + F.col("without_high")
    return each.join(_totals(each, group), group).select(
        *group,
        "relation",
        "pk",
        "cnt",
        high.alias("gamma"),
        (F.col("n_sets") - F.col("cnt")).alias("n_edges"),
        "n_nodes",
        low.alias("gamma_low"),
        F.when(low == high, "OPTIMAL").otherwise("FEASIBLE").alias("status"),
    )


def _totals(each: DataFrame, group: list[str]) -> DataFrame:
    per_part = each.groupBy(*group, "comp").agg(
        *[F.max(c).alias(c) for c in ("cost_low", "cost_high", "part_sets")],
        F.count(F.lit(1)).alias("part_nodes"),
    )
    return per_part.groupBy(*group).agg(
        F.sum("cost_low").alias("total_low"),
        F.sum("cost_high").alias("total_high"),
        F.sum("part_sets").alias("n_sets"),
        F.sum("part_nodes").alias("n_nodes"),
    )


def _tuple_costs(sets: DataFrame, group: list[str]) -> DataFrame:
    """Per tuple: bounds of its part's least hitting set, and of the part's sets without the tuple.

    Each set names one of its tuples as its centre. A tuple that all its sets give the same centre ties
    no parts together, so only centres that share a tuple are linked and contracted; a centre
    without links is a part with a hub.
    """
    part = [*group, "comp"]
    centred, per_part = _centred(sets, group)
    sized = keep(_sized(centred, group, per_part), "part-sizes")
    costs = ["cost_low", "cost_high", "without_low", "without_high"]
    without = (F.col("cnt") < F.col("part_sets")).cast("bigint")
    one = F.lit(1).cast("bigint")
    by_hub = [c.alias(name) for c, name in zip((one, one, without, without), costs, strict=True)]
    columns = [*part, "relation", "pk", "cnt", "part_sets"]
    edges = keep(_shared_tuples(sized, group), "centre-edges")
    if edges.isEmpty():
        return sized.select(*columns, *by_hub)
    links = keep(_contract(edges, group), "centre-links")
    roots = links.select(*group, F.col("root").alias("tid"), "root").distinct().unionByName(links)
    roots = keep(roots.select(*group, F.col("tid").alias("comp"), "root"), "linked-centres")
    alone = sized.join(roots, part, "left_anti").select(*columns, *by_hub)
    placed = keep(
        centred.join(roots, part).select(*group, F.col("root").alias("comp"), "mis_id", "tuples"), "placed-sets"
    )
    counts = keep(tuple_counts(placed, group), "part-counts")
    sizes = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("part_sets"))
    shapes = keep(
        counts.groupBy(*part)
        .agg(F.max("cnt").alias("top"))
        .join(sizes, part)
        .withColumn("has_hub", F.col("top") == F.col("part_sets")),
        "part-shapes",
    )
    each = alone.unionByName(counts.join(shapes.filter("has_hub"), part).select(*columns, *by_hub))
    hubless = shapes.filter(~F.col("has_hub"))
    if not hubless.isEmpty():
        members = keep(
            placed.join(hubless.select(*part), part)
            .select(*part, "mis_id", F.explode("tuples").alias("t"))
            .select(*part, "mis_id", tuple_id(F.col("t.relation"), F.col("t.pk")).alias("tid"))
            .distinct(),
            "hubless-members",
        )
        named = counts.withColumn("tid", tuple_id(F.col("relation"), F.col("pk")))
        bounded = named.join(_bounds(members, part), [*part, "tid"]).join(sizes, part)
        each = each.unionByName(bounded.select(*each.columns))
    return keep(each, "part-costs")


def _centred(sets: DataFrame, group: list[str]) -> tuple[DataFrame, float]:
    """Sets with their centre as ``comp`` and its ``place`` among their tuples, and how many sets a centre has, about.

    The centre is of the relation whose tuples are in most sets on average, where a hub is likely; any
    choice is right, a worse one leaves more links. One row per relation name reaches the driver.
    """
    tuples = F.approx_count_distinct(F.xxhash64(*group, "pk"), 0.01)
    share = (F.count(F.lit(1)) / F.greatest(tuples, F.lit(1))).alias("share")
    found = sets.select(*group, F.inline("tuples")).groupBy("relation").agg(share).collect()
    found.sort(key=lambda r: (-r.share, r.relation))
    names = F.array(F.lit(""), *[F.lit(r.relation) for r in found])
    members = F.transform(
        "tuples",
        lambda t, i: F.struct(
            F.array_position(names, t["relation"]), tuple_id(t["relation"], t["pk"]).alias("tid"), i.alias("place")
        ),
    )
    # Rows without a group are in no part.
    known = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])
    centred = sets.filter(known).withColumn("centre", F.array_min(members))
    centred = centred.withColumns({"comp": F.col("centre.tid"), "place": F.col("centre.place")})
    return centred, found[0].share if found else 0.0


def _sized(centred: DataFrame, group: list[str], per_part: float) -> DataFrame:
    """``tuple_counts`` by centre with the number of the centre's sets in ``part_sets``.

    The sets of a centre are counted in one task; where centres have very many sets, tuples are
    counted before they are shuffled and meet the sizes by a join.
    """
    part = [*group, "comp"]
    if per_part > LOCAL_SETS:
        sizes = centred.groupBy(*part).agg(F.count(F.lit(1)).alias("part_sets"))
        return tuple_counts(centred, group).join(sizes, part)
    # A set is counted at its centre, once.
    members = centred.select(*part, "place", "tuples").repartition(*part).select(*part, "place", F.posexplode("tuples"))
    counts = members.groupBy(*part, "col.relation", "col.pk").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("pos") == F.col("place")).alias("own")
    )
    return counts.withColumn("part_sets", F.max("own").over(Window.partitionBy(*part))).drop("own")


def _shared_tuples(sized: DataFrame, group: list[str]) -> DataFrame:
    """(group, high, low): centres that have a tuple in common, each linked to the least one of it.

    Tuples are first compared by a hash, which may only find too many.
    """
    name = F.xxhash64(*group, "relation", "pk")
    often = sized.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    tid = [*group, "relation", "pk"]
    suspects = keep(
        sized.select(*tid, "comp", name.alias("name")).join(keep(often, "often"), "name").drop("name"), "shared-tuples"
    )
    least = suspects.groupBy(*tid).agg(F.min("comp").alias("low"))
    joined = suspects.join(least, tid).select(*group, F.col("comp").alias("high"), "low")
    return joined.filter("high <> low").distinct()


def _bounds(members: DataFrame, part: list[str]) -> DataFrame:
    """(part, tid) with bounds of the least hitting set of the part, and of its sets without the tuple.

    The sets without a tuple need at most one tuple less than all sets. Without its own sets, a
    tuple is not needed in the cover, nor is one further member whose
    private sets (those that no other member hits) all contain the tuple; and a set that was
    packed is lost at most.
    """
    tid, mis = [*part, "tid"], [*part, "mis_id"]
    taken, left = _reduce(members, part)
    ring, rings = _cycles(left, part), None
    if ring is not None:
        # A cycle of n pairs needs half of n tuples, rounded up, and any of its tuples may be one of them.
        lengths = ring.groupBy(*part, "root").agg(F.count(F.lit(1)).alias("n"))
        rings = lengths.groupBy(*part).agg(F.sum(F.ceil(F.col("n") / 2)).alias("n_ring"))
        left = keep(left.join(ring.select(*tid), tid, "left_anti"), "beside-cycles")
    cover, packed = taken.unionByName(_cover(left, part)), _packing(members, part)
    certain = taken.unionByName(_packing(left, part).select(*part, F.col("mis_id").alias("tid")))
    one = F.lit(1).cast("bigint")
    in_cover = cover if ring is None else cover.unionByName(ring.select(*tid)).distinct()
    in_cover = in_cover.withColumn("in_cover", one)
    in_packing = members.join(packed, mis, "left_semi").groupBy(*tid).agg(one.alias("in_packing"))
    parts = members.select(*part).distinct()
    numbers = {
        "n_cover": cover.groupBy(*part).agg(F.count(F.lit(1)).alias("n_cover")),
        "n_packed": packed.groupBy(*part).agg(F.count(F.lit(1)).alias("n_packed")),
        "n_certain": certain.groupBy(*part).agg(F.count(F.lit(1)).alias("n_certain")),
        "n_taken": taken.groupBy(*part).agg(F.count(F.lit(1)).alias("n_taken")),
        "n_shared": _shares(left, part),
    }
    if rings is not None:
        numbers["n_ring"] = rings
    for frame in numbers.values():
        parts = parts.join(frame, part, "left")
    parts = parts.fillna(0, subset=list(numbers))
    exact = F.col("n_ring") if rings is not None else F.lit(0)
    sizes = parts.select(
        *part,
        "n_packed",
        (F.col("n_cover") + exact).alias("cost_high"),
        F.greatest("n_packed", F.col("n_certain") + exact, F.col("n_taken") + F.col("n_shared") + exact).alias("cost_low"),
    )
    # Sets that one member of the cover hits alone, and the tuples beside it.
    hits = members.join(cover, tid).groupBy(*mis).agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("s"))
    private = hits.filter("n = 1").select(*mis, "s")
    own = private.groupBy(*part, "s").agg(F.count(F.lit(1)).alias("n_private"))
    beside = members.join(private, mis).filter("tid <> s")
    together = beside.groupBy(*tid, "s").agg(F.count(F.lit(1)).alias("n"))
    spared = together.join(own, [*part, "s"]).filter("n = n_private").groupBy(*tid).agg(one.alias("spared"))
    total = members.groupBy(*part).agg(F.countDistinct("mis_id").alias("n_sets"))
    has = members.groupBy(*tid).agg(F.count(F.lit(1)).alias("n_own"))
    joined = has.join(total, part).join(sizes, part)
    for extra in (in_cover, in_packing, spared):
        joined = joined.join(extra, tid, "left")
    some_left = F.when(F.col("n_own") < F.col("n_sets"), 1).otherwise(0)
    saved = F.greatest(F.coalesce("in_cover", F.lit(0)), F.coalesce("spared", F.lit(0)))
    high = F.when(some_left == 0, 0).otherwise(F.greatest(F.col("cost_high") - saved, F.lit(1)))
    low = F.greatest(
        F.col("cost_low") - 1, F.col("n_packed") - F.coalesce("in_packing", F.lit(0)), some_left
    )
    return joined.select(
        *tid,
        "cost_low",
        "cost_high",
        F.when(some_left == 0, 0).otherwise(low).cast("bigint").alias("without_low"),
        high.cast("bigint").alias("without_high"),
    )


def _reduce(members: DataFrame, part: list[str]) -> tuple[DataFrame, DataFrame]:
    """(part, tid) taken and the members left, with the same least size of a hitting set together.

    A set that holds another and a tuple whose sets all hold another tuple are dropped; of equal
    ones the least name stays. The tuple of a set of one is taken with all its sets. Candidates
    come from the rarest tuple of a set and the smallest set of a tuple.
    """
    tid, mis = [*part, "tid"], [*part, "mis_id"]
    left, taken, rows = members, members.filter(F.lit(False)).select(*tid), members.count()
    while True:
        left = keep(_least_sets(left, part), "least-sets")
        single = left.groupBy(*mis).agg(F.min("tid").alias("tid"), F.count(F.lit(1)).alias("n"))
        forced = keep(single.filter("n = 1").select(*tid).distinct(), "forced")
        taken = taken.unionByName(forced)
        hit = left.join(forced, tid, "left_semi").select(*mis).distinct()
        left = keep(left.join(hit, mis, "left_anti"), "open-sets")
        left = keep(_without_dominated(left, part), "open-sets")
        before, rows = rows, left.count()
        if rows in (0, before):
            return taken, left


def _cycles(left: DataFrame, part: list[str]) -> DataFrame | None:
    """(part, tid, root) of the tuples on cycles of pairs that nothing else touches; none: there are no such."""
    tid, mis = [*part, "tid"], [*part, "mis_id"]
    twice = left.groupBy(*tid).agg(F.count(F.lit(1)).alias("d")).filter("d = 2").select(*tid)
    pairs = left.groupBy(*mis).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(*mis)
    inner = left.join(pairs, mis, "left_semi").join(twice, tid, "left_semi")
    edges = (
        inner.groupBy(*mis)
        .agg(F.max("tid").alias("high"), F.min("tid").alias("low"), F.count(F.lit(1)).alias("n"))
        .filter("n = 2")
        .select(*part, "high", "low")
    )
    edges = keep(edges, "cycle-edges")
    if edges.isEmpty():
        return None
    linked = _contract(edges, part)
    ends = _both_ways(edges, part).groupBy(*part, F.col("u").alias("tid")).agg(F.count(F.lit(1)).alias("ends"))
    rooted = ends.join(linked, tid, "left").withColumn("root", F.coalesce("root", "tid"))
    closed = rooted.groupBy(*part, "root").agg(F.min("ends").alias("ends")).filter("ends = 2").select(*part, "root")
    return keep(rooted.join(closed, [*part, "root"], "left_semi").select(*tid, "root"), "cycles")


def _shares(members: DataFrame, part: list[str]) -> DataFrame:
    """(part, n_shared): a lower bound from shares of sets, each one over the most sets a tuple of it is in."""
    degrees = members.groupBy(*part, "tid").agg(F.count(F.lit(1)).alias("d"))
    share = members.join(degrees, [*part, "tid"]).groupBy(*part, "mis_id").agg((1 / F.max("d")).alias("share"))
    return share.groupBy(*part).agg(F.ceil(F.sum("share") - 1e-6).alias("n_shared"))


def _least_sets(members: DataFrame, part: list[str]) -> DataFrame:
    """Rows without the sets that hold another set; of equal sets the least name stays.

    Equal sets are found by what they hold, without a join. A smaller set lies in a larger one only
    if its two rarest tuples do: it is posted under that pair (a set of one under its tuple) and the
    larger set looks up all its pairs, so sets that share one frequent tuple never meet. Sets are
    as short as a constraint or query has relations.
    """
    mis = [*part, "mis_id"]
    degrees = members.groupBy(*part, "tid").agg(F.count(F.lit(1)).alias("d"))
    shapes = members.join(degrees, [*part, "tid"]).groupBy(*mis).agg(
        F.sort_array(F.collect_list(F.struct("d", "tid"))).alias("ranked")
    )
    names = F.transform("ranked", lambda r: r["tid"])
    unique = keep(
        shapes.select(*mis, F.array_sort(names).alias("held"), F.slice(names, 1, 2).alias("rare"))
        .groupBy(*part, "held")
        .agg(F.min("mis_id").alias("mis_id"), F.first("rare").alias("rare"))
        .withColumn("n", F.size("held")),
        "unique-sets",
    )
    small = unique.select(
        *part, F.array_sort("rare").alias("key"), F.col("held").alias("inner"), F.col("n").alias("n_small")
    )
    ones = F.transform("held", lambda t: F.array(t))
    pairs = F.flatten(
        F.transform(
            "held", lambda t, i: F.transform(F.slice("held", i + 2, F.col("n")), lambda u: F.array(t, u))
        )
    )
    large = unique.filter("n > 1").select(
        *mis, "held", "n", F.explode(F.when(F.col("n") > 2, F.concat(ones, pairs)).otherwise(ones)).alias("key")
    )
    holds = (F.col("n_small") < F.col("n")) & (F.size(F.array_except("inner", "held")) == 0)
    dropped = large.join(small, [*part, "key"]).filter(holds).select(*mis).distinct()
    kept = unique.select(*mis).join(dropped, mis, "left_anti")
    return members.join(kept, mis, "left_semi")


def _without_dominated(members: DataFrame, part: list[str]) -> DataFrame:
    """Rows without each tuple whose sets all hold another tuple; of equal ones the least name stays.

    A tuple is compared with the few that share the smallest of its sets.
    """
    tid, mis = [*part, "tid"], [*part, "mis_id"]
    degrees = members.groupBy(*tid).agg(F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy(*mis).agg(F.count(F.lit(1)).alias("d"))
    smallest = members.join(sizes, mis).groupBy(*tid).agg(F.min(F.struct("d", "mis_id"))["mis_id"].alias("mis_id"))
    inner = smallest.join(degrees, tid).withColumnRenamed("tid", "small").withColumnRenamed("n", "n_small")
    outer = members.join(degrees, tid).withColumnRenamed("tid", "large").withColumnRenamed("n", "n_large")
    pairs = inner.join(outer, mis).filter(
        (F.col("n_small") < F.col("n_large"))
        | ((F.col("n_small") == F.col("n_large")) & (F.col("large") < F.col("small")))
    )
    dropped = (
        pairs.select(*part, "small", "large", "n_small")
        .join(members.withColumnRenamed("tid", "small"), [*part, "small"])
        .join(members.withColumnRenamed("tid", "large"), [*part, "large", "mis_id"])
        .groupBy(*part, "small", "large", "n_small")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = n_small")
        .select(*part, F.col("small").alias("tid"))
        .distinct()
    )
    return members.join(dropped, tid, "left_anti")


def _cover(members: DataFrame, part: list[str]) -> DataFrame:
    """(part, tid) of a hitting set: each round takes the tuples that are first, by number of open
    sets and hash, in all their open sets."""
    tid, mis = [*part, "tid"], [*part, "mis_id"]
    left, chosen = members, None
    while True:
        degrees = left.groupBy(*tid).agg(F.count(F.lit(1)).alias("n"))
        best = left.join(degrees, tid).groupBy(*mis).agg(F.max(F.struct("n", F.xxhash64("tid"), "tid")).alias("best"))
        picks = keep(
            left.join(best, mis)
            .groupBy(*tid)
            .agg(F.bool_and(F.col("best.tid") == F.col("tid")).alias("first"))
            .filter("first")
            .select(*tid),
            "cover",
        )
        chosen = picks if chosen is None else chosen.unionByName(picks)
        hit = left.join(picks, tid, "left_semi").select(*mis).distinct()
        left = keep(left.join(hit, mis, "left_anti"), "open-sets")
        if left.isEmpty():
            return chosen


def _packing(members: DataFrame, part: list[str]) -> DataFrame:
    """(part, mis_id) of sets without a common tuple: each round takes the sets that are first, by
    size and hash, for all their tuples, and drops their neighbours."""
    tid, mis = [*part, "tid"], [*part, "mis_id"]
    sizes = members.groupBy(*mis).agg(F.count(F.lit(1)).alias("size"))
    place = F.struct("size", F.xxhash64("mis_id"), "mis_id").alias("place")
    left, chosen = keep(members.join(sizes, mis).select(*mis, "tid", place), "open-sets"), None
    while True:
        least = left.groupBy(*tid).agg(F.min("place").alias("least"))
        picks = keep(
            left.join(least, tid)
            .groupBy(*mis)
            .agg(F.bool_and(F.col("least") == F.col("place")).alias("first"))
            .filter("first")
            .select(*mis),
            "packing",
        )
        chosen = picks if chosen is None else chosen.unionByName(picks)
        used = left.join(picks, mis, "left_semi").select(*tid).distinct()
        near = left.join(used, tid, "left_semi").select(*mis).distinct()
        left = keep(left.join(near, mis, "left_anti"), "open-sets")
        if left.isEmpty():
            return chosen
