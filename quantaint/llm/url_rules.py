"""Allow and block rules for urls by a sort-merge range join over reversed hosts.

A host is keyed by its labels in reverse order, each followed by a dot, so a rule's
host and all its subdomains are one interval of keys. Keys and rules are cut by the
same sampled borders: a url goes to one range (one of several, if a hot host fills
them), a rule to every range that its interval touches. Each range is sorted and swept
once, with a stack of the rules whose host intervals are open; nested intervals nest
on the stack.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantaint.llm.batches import least_rows

ALLOW, BLOCK = "allow", "block"
_LAST = "\U0010ffff"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    path = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def reversed_host(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))
    )


def _reversed(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class RuleStack:
    """Open host intervals, the innermost last, each with its rules by path."""

    def __init__(self) -> None:
        self._open: list[tuple[str, dict[str, Rule], list[int]]] = []

    def start(self, key: str, rules: list[Rule]) -> None:
        self.close_before(key)
        paths = {r.path: r for r in rules}
        self._open.append((key, paths, sorted({len(p) for p in paths}, reverse=True)))

    def close_before(self, key: str) -> None:
        while self._open and not key.startswith(self._open[-1][0]):
            self._open.pop()

    def longest(self, path: str) -> Rule | None:
        """The longest rule on the stack whose path starts ``path``; the inner host wins ties."""
        best: Rule | None = None
        for _, paths, sizes in reversed(self._open):
            for size in sizes:
                if size <= len(path) and (rule := paths.get(path[:size])) is not None:
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
        return best


def judge_urls(
    urls: DataFrame,
    id_column: str,
    rules: list[Rule],
    default: str = ALLOW,
    sample: int = 20_000,
) -> DataFrame:
    """(id, host, path, rule, verdict) of each row of ``urls`` (columns id and ``url``).

    A rule fits its host and all subdomains if the url's path starts with the rule's;
    the longest rule wins, two rules of equal host and path: the later one. Without a
    rule the verdict is ``default``. A null url, or one without ``://``, has an empty
    host and path. Repeated rows are judged one by one, other columns are left out.
    ``sample`` bounds the keys that set the borders of the ranges, not what is judged.
    """
    spark = urls.sparkSession
    rows = urls.select(
        F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumns({"_key": reversed_host(F.col("host")), "_draw": F.xxhash64(id_column, "host", "path")})
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(rows, ranges, sample)
    keyed = _deal(rows, borders)
    by_key: dict[str, list[Rule]] = {}
    for rule in rules:
        by_key.setdefault(_reversed(rule.host), []).append(rule)
    groups = sorted(by_key.items())
    starts = [
        (number, key, part)
        for number, (key, _) in enumerate(groups)
        for part in range(bisect_left(borders, key), bisect_right(borders, key + _LAST) + 1)
    ]
    marks = spark.createDataFrame(starts, "_rule int, _key string, _range int").select(
        F.lit(None).cast(rows.schema[id_column].dataType).alias(id_column),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
        "_key",
        "_range",
        "_rule",
    )
    both = keyed.unionByName(marks).repartition("_range")
    swept = both.sortWithinPartitions("_range", "_key", F.col("_rule").asc_nulls_last())
    own = rows.select(id_column, "host", "path").schema
    out = T.StructType([*own, *(T.StructField(c, T.StringType()) for c in ("rule", "verdict"))])

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = RuleStack(), None
        for batch in batches:
            taken, names, verdicts = [], [], []
            columns = [batch.column(x).to_pylist() for x in ("_range", "_key", "_rule", "path")]
            for i, (part, key, number, path) in enumerate(zip(*columns, strict=True)):
                if part != at:
                    stack, at = RuleStack(), part
                if number is not None:
                    stack.start(*groups[number])
                    continue
                stack.close_before(key)
                rule = stack.longest(path)
                taken.append(i)
                names.append(rule.text if rule else None)
                verdicts.append(rule.verdict if rule else default)
            kept = batch.select([id_column, "host", "path"]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=out.fieldNames(),
            )

    return swept.mapInArrow(sweep, out)


def _borders(rows: DataFrame, ranges: int, sample: int) -> list[str]:
    """Sorted keys that cut a bounded sample evenly; a hot key may occur several times.

    The sample is the rows of least hash, so a rerun cuts alike.
    """
    drawn = least_rows(rows.select("_key", "_draw"), F.col("_draw"), sample)
    keys = sorted(r[0] for r in drawn.select("_key").collect())
    if not keys:
        return []
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)]


def _deal(rows: DataFrame, borders: list[str]) -> DataFrame:
    """Add each row's ``_range``, by bisection; a key that equals borders is spread over their ranges."""
    out = T.StructType(
        [*rows.schema, T.StructField("_range", T.IntegerType()), T.StructField("_rule", T.IntegerType())]
    )

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = []
            for key, draw in zip(batch.column("_key").to_pylist(), batch.column("_draw").to_pylist(), strict=True):
                low = bisect_left(borders, key)
                ranges.append(low + draw % (bisect_right(borders, key) - low + 1))
            columns = [*batch.columns, pa.array(ranges, pa.int32()), pa.nulls(len(ranges), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return rows.mapInArrow(deal, out).drop("_draw")
