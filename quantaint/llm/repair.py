"""Repair of damaged conversations as shortest paths, found by auction.

A conversation becomes a lattice: columns lie between its rows, states say what role may come
next. Arcs are edits with integer costs: keep, rerole or delete a row, insert an empty turn. The
auction algorithm keeps a price per node, extends a path while its last arc is tight and else
raises the price of its end and takes that node back. When the path arrives, the prices are an
optimal dual solution, every cheapest path consists of tight arcs alone, and the first of them in
the order of the edits' letters is traced.

A long conversation is cut into segments of bounded length. A segment is a matrix of distances
between the states at its ends; these are chained backwards to what each end still costs, then
every segment is traced on its own for each state it may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaint.sources.store import keep

# Rows of a segment, a power of two.
SEGMENT = 32
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Nothing said yet, after the system, after the user, after the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
# State -> initial of a role -> next state; only a user or an assistant may be put in.
STEP = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
PUT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
# Insertions after the last row, by state.
CLOSING = (0, 2, 1, 0)
_FAR = 1 << 60

Arc = tuple[str, int, int]


class Lattice:
    """Arcs of one segment. Node 4 * column + state; node ``end`` lies behind the last column.

    ``initials`` holds s, u, a or x per row, ``faults`` b, d, t or a point. ``exits`` is the cost
    from each state of the last column to the end, ``_FAR`` where that way is shut.
    """

    def __init__(self, initials: str, faults: str, exits: tuple[int, ...]) -> None:
        n = len(initials)
        self.end = 4 * n + 4
        self.arcs: list[list[Arc]] = []
        for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
            more = TRUNCATED if fault == "t" else 0
            for state in range(4):
                out: list[Arc] = [("D", DELETE, 4 * i + 4 + state), ("I", INSERT, 4 * i + PUT[state][1])]
                if fault in ".t":
                    if initial in STEP[state]:
                        out.append(("K", more, 4 * i + 4 + STEP[state][initial]))
                    out.append(("R", REROLE + more, 4 * i + 4 + PUT[state][1]))
                self.arcs.append(out)
        self.arcs += [[("", cost, self.end)] if cost < _FAR else [] for cost in exits]
        self.prices = self._first_prices(initials, faults, exits)

    def _first_prices(self, initials: str, faults: str, exits: tuple[int, ...]) -> list[int]:
        """A price for each node that no arc exceeds: what the rows to come cost at least.

        A node with no way to the end is priced out.
        """
        prices = [0] * (self.end + 1)
        rest = min(exits)
        for column in range(len(initials), -1, -1):
            if column < len(initials):
                fault, initial = faults[column], initials[column]
                most = DELETE if fault in "bd" else REROLE if initial == "x" else 0
                rest += min(DELETE, most + (fault == "t"))
            for state in range(4):
                prices[4 * column + state] = rest
        shut = [True] * (self.end + 1)
        shut[self.end] = False
        for column in range(len(initials), -1, -1):
            # Insertions lead from a state to later ones of its column, so states open in turn.
            for _ in range(2):
                for state in range(4):
                    node = 4 * column + state
                    shut[node] = all(shut[j] for _, _, j in self.arcs[node])
        return [_FAR if closed else price for price, closed in zip(prices, shut, strict=True)]

    def auction(self, start: int) -> int:
        """Distance from ``start`` to the end; prices stay feasible, so that later starts go on with them."""
        prices, arcs, end = self.prices, self.arcs, self.end
        if prices[start] >= _FAR:
            return _FAR
        path, node = [start], start
        while node != end:
            best, after = _FAR, -1
            for _, cost, j in arcs[node]:
                if cost + prices[j] < best:
                    best, after = cost + prices[j], j
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
                    node = path[-1]
            else:
                node = after
                path.append(node)
        return prices[start] - prices[end]

    def trace(self, start: int) -> tuple[str, int]:
        """(edits, last state): the least string of edits among the tight arcs from ``start`` to the end."""
        self.auction(start)
        prices, arcs, end = self.prices, self.arcs, self.end
        path: list[tuple[int, int]] = [(start, -1)]
        letters: list[str] = []
        dead: set[int] = set()
        while path[-1][0] != end:
            node, tried = path.pop()
            for k in range(tried + 1, len(arcs[node])):
                letter, cost, j = arcs[node][k]
                if prices[node] == cost + prices[j] and j not in dead:
                    path += [(node, k), (j, -1)]
                    letters.append(letter)
                    break
            else:
                dead.add(node)
                letters.pop()
        return "".join(letters), path[-2][0] % 4


@lru_cache(1 << 14)
def distances(initials: str, faults: str) -> tuple[int, ...]:
    """Cheapest edits of a segment from each state (rows) to each state (columns), 16 numbers."""
    found = [[0] * 4 for _ in range(4)]
    for last in range(4):
        lattice = Lattice(initials, faults, tuple(0 if s == last else _FAR for s in range(4)))
        for first in range(4):
            found[first][last] = lattice.auction(first)
    return tuple(x for row in found for x in row)


def before(matrix: tuple[int, ...], exits: tuple[int, ...]) -> tuple[int, ...]:
    """What each entry state of a segment still costs, given what its exit states cost."""
    return tuple(min(matrix[4 * s + t] + exits[t] for t in range(4)) for s in range(4))


CLOSING_COSTS = tuple(INSERT * k for k in CLOSING)


@lru_cache(1 << 16)
def traced(initials: str, faults: str, exits: tuple[int, ...], first: bool) -> tuple[tuple[str, int], ...]:
    """(edits, last state) for each state a segment may be entered in: one for the first, else four."""
    least = min(exits)
    lattice = Lattice(initials, faults, tuple(x - least for x in exits))
    return tuple(lattice.trace(state) for state in range(1 if first else 4))


def cheapest_edits(initials: str, faults: str, segment: int = SEGMENT) -> str:
    """The edits of a whole conversation, by segments as the Spark plan does it."""
    cuts = [(initials[i : i + segment], faults[i : i + segment]) for i in range(0, len(initials), segment)]
    exits = [CLOSING_COSTS]
    for piece in reversed(cuts[1:]):
        exits.append(before(distances(*piece), exits[-1]))
    state, edits = START, ""
    for at, (piece, cost) in enumerate(zip(cuts, reversed(exits), strict=False)):
        more, state = traced(*piece, cost, at == 0)[state]
        edits += more
    return edits + "I" * CLOSING[state]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by CRC-32 of ``conv_id:turn``; nulls count as one space."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (
        conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text"))
        .filter("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, place, initial, fault) of sorted rows, without their texts."""
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = keep(
        rows.select(
            "conv_id",
            "place",
            _initial(F.col("role")).alias("initial"),
            F.when(shown == "", "b")
            .when(F.substring(shown, -1, 1).isin(".", "!", "?"), ".")
            .otherwise("t")
            .alias("fault"),
            F.md5(F.concat(F.md5("role"), "text")).alias("said"),
        ),
        "turn-faults",
    )
    # First places of what is said more than once; few against all rows.
    repeated = (
        narrow.filter("fault <> 'b'")
        .groupBy("conv_id", "said")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1")
        .select(F.col("conv_id").alias("_c"), F.col("said").alias("_s"), "first")
    )
    again = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_s")) & (F.col("place") > F.col("first"))
    fault = F.when((F.col("fault") != "b") & F.col("first").isNotNull(), "d").otherwise(F.col("fault"))
    return narrow.join(repeated, again, "left").select("conv_id", "place", "initial", fault.alias("fault"))


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, initials, faults): at most ``SEGMENT`` rows of one conversation each."""
    turn = F.struct("place", "initial", "fault")
    gathered = rows.groupBy("conv_id", F.floor(F.col("place") / SEGMENT).alias("segment")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    return gathered.select(
        "conv_id",
        "segment",
        *[F.array_join(F.col(f"turns.{c}"), "").alias(f"{c}s") for c in ("initial", "fault")],
    )


def _with_matrices(segments: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist(), strict=True)
            found = pa.array([distances(a, b) for a, b in pairs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "matrix"])

    schema = f"conv_id {id_type}, segment long, initials string, faults string, matrix array<long>"
    return segments.mapInArrow(run, schema)


_PLAN = "segment long, initials string, faults string, exits array<long>, first boolean"


def _with_exits(segments: DataFrame, id_type: str) -> DataFrame:
    """Chain the matrices of each conversation backwards; a stream that holds four numbers a conversation."""
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exits, held, schema = CLOSING_COSTS, None, None

        def plan(row: dict, first: bool) -> dict:
            return {k: row[k] for k in ("conv_id", "segment", "initials", "faults")} | {"exits": exits, "first": first}

        for batch in batches:
            schema = pa.schema(
                [*list(batch.schema)[:4], ("exits", pa.list_(pa.int64())), ("first", pa.bool_())]
            )
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    first = held["conv_id"] != row["conv_id"]
                    out.append(plan(held, first))
                    exits = CLOSING_COSTS if first else before(tuple(held["matrix"]), exits)
                held = row
            yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([plan(held, True)], schema)

    return ordered.mapInArrow(run, f"conv_id {id_type}, {_PLAN}")


def _with_edits(segments: DataFrame, id_type: str) -> DataFrame:
    """The edits of each segment, one string for each state it may be entered in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("initials", "faults", "exits", "first")], strict=True)
            found = [[edits for edits, _ in traced(a, b, tuple(exits), first)] for a, b, exits, first in rows]
            columns = [batch.column(c) for c in ("conv_id", "segment", "initials", "faults")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.list_(pa.string()))],
                names=["conv_id", "segment", "initials", "faults", "edits"],
            )

    schema = f"conv_id {id_type}, segment long, initials string, faults string, edits array<string>"
    return segments.mapInArrow(run, schema)


class Repaired:
    """One conversation as its segments and rows stream by, in order; keeps counts, edits and a running digest."""

    def __init__(self) -> None:
        self.digest = hashlib.sha256()
        self.state, self.turns = START, 0
        self.counts = {"b": 0, "d": 0, "t": 0, ".": 0}
        self.illegal = self.cost = self.distinct = 0
        self.least = self.most = None
        self.audit: list[str] = []
        # Edits and faults of the present segment that are still to come, and the last initial.
        self.edits: Iterator[str] = iter("")
        self.faults: Iterator[str] = iter("")
        self.last = ""

    def segment(self, initials: str, faults: str, edits: list[str]) -> None:
        self.audit.append(edits[self.state])
        self.edits, self.faults = iter(edits[self.state]), iter(faults)
        joined = self.last + initials
        self.illegal += sum(joined[i : i + 2] not in ("su", "ua", "au") for i in range(len(joined) - 1))
        self.last = initials[-1]
        for fault in faults:
            self.counts[fault] += 1

    def _say(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.turns else "").encode() + role.encode() + b":" + text.encode())
        self.turns += 1

    def _put(self) -> str:
        role, self.state = PUT[self.state]
        return role

    def _insert(self) -> None:
        self.cost += INSERT
        self._say(self._put(), "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        fault = next(self.faults)
        # A segment has as many edits of rows as rows, with insertions before some of them.
        while (edit := next(self.edits)) == "I":
            self._insert()
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED if fault == "t" else 0
        if edit == "K":
            self.state = STEP[self.state][role[0]]
        else:
            self.cost += REROLE
            role = self._put()
        self._say(role, text)

    def result(self) -> tuple:
        closing = CLOSING[self.state]
        for _ in range(closing):
            self._insert()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (
            gaps,
            self.counts["b"],
            self.counts["d"],
            self.counts["t"],
            self.illegal,
            self.cost,
            "".join(self.audit) + "I" * closing,
            self.digest.hexdigest(),
        )


_RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _repair(stream: DataFrame, id_type: str) -> DataFrame:
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")
    names = ["conv_id", *[x.split()[0] for x in _RESULT.split(", ")]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def emit(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in names]
            wanted = [types, *[pa.string() if x.endswith("string") else pa.int64() for x in _RESULT.split(", ")]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, wanted, strict=True)], names=names
            )

        at, now = None, None
        for batch in batches:
            types = batch.schema.field("conv_id").type
            done = []
            columns = [batch.column(c).to_pylist() for c in _STREAM]
            for conv, _, kind, turn, role, text, initials, faults, edits in zip(*columns, strict=True):
                if now is None or conv != at:
                    if now is not None:
                        done.append((at, *now.result()))
                    at, now = conv, Repaired()
                if kind == 1:
                    now.segment(initials, faults, edits)
                elif kind == 2:
                    now.row(turn, role, text)
            yield emit(done)
        if now is not None:
            yield emit([(at, *now.result())])

    return ordered.mapInArrow(run, f"conv_id {id_type}, {_RESULT}")


_STREAM = ("conv_id", "place", "kind", "turn", "role", "text", "initials", "faults", "edits")


def repair_conversations(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Rows stand in order of turn, nulls first; equal turns by role, then text. A null role, text,
    id or turn reads as one space where text is needed; null ids are one conversation. Repeated
    rows are duplicates. A conversation that has lost all rows has zeros, no edits and the digest
    of an empty string; an empty table gives no rows. Texts are never cut, and other columns are
    not read. ``damage=False`` takes the rows as they are.

    Rows are dealt in ranges, so a long conversation is judged, priced and traced by many tasks.
    Its digest is one over all its turns: for that alone its rows stream through one task, which
    keeps a few numbers and the edits.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    if damage:
        said = damaged(conversations)
    else:
        said = conversations.select(
            "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
        )
    order = ["conv_id", "turn", "role", "text"]
    # Places grow with the order, over all tasks; their gaps lie between tasks.
    rows = keep(
        said.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "damaged-turns",
    )
    segments = keep(_segments(_faults(rows)), "turn-segments")
    ends = segments.groupBy("conv_id").agg(F.min("segment").alias("a"), F.max("segment").alias("b"))
    long_ones = ends.filter("a < b").select(F.col("conv_id").alias("_c"))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    alone = segments.join(long_ones, same, "left_anti").select(
        "*", F.array(*[F.lit(x).cast("long") for x in CLOSING_COSTS]).alias("exits"), F.lit(True).alias("first")
    )
    chained = segments.join(long_ones, same, "left_semi")
    priced = keep(_with_matrices(chained, id_type), "segment-distances")
    exits = _with_exits(priced, id_type)
    edits = keep(
        _with_edits(alone.unionByName(exits).repartition("conv_id", "segment"), id_type), "segment-edits"
    )
    empty = [F.lit(None).cast("string").alias(c) for c in ("role", "text", "initials", "faults")]
    no_edits = F.lit(None).cast("array<string>").alias("edits")
    turn = rows.schema["turn"].dataType
    named = conversations.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast(turn).alias("turn"), *empty, no_edits
    )
    cut = edits.select(
        "conv_id",
        (F.col("segment") * SEGMENT).alias("place"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(turn).alias("turn"),
        *empty[:2],
        "initials",
        "faults",
        "edits",
    )
    texts = rows.select("conv_id", "place", F.lit(2).alias("kind"), "turn", "role", "text", *empty[2:], no_edits)
    return keep(_repair(named.unionByName(cut).unionByName(texts), id_type), "repaired-conversations")
