"""Language identification: known words first, then shorter and shorter character n-grams.

Training counts the words of all training texts by language. Words seen twice or more in
a language are the known words; the distinct words give the n-gram counts for the rest. A
known word scores by its log frequency in each language. An unseen word takes its longest
n-grams if one of them is known, else the next shorter ones, down to single letters.

No word, n-gram or language is left out for room: every distinct word is scored once by
joins, workers hold the scores of the most frequent words, and what a text has besides
them is joined with the table of scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantaint.llm.batches import keep_texts
from quantaint.sources.store import keep

UNKNOWN = "und"
LONGEST_GRAM = 4
# Words whose scores every worker holds; all others are joined.
HELD_WORDS = 300_000
# Tables of n-grams up to this many rows are broadcast to the words without a count of their own.
BROADCAST_GRAMS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000
_REMEMBERED = 500_000
_PER_DOUBLING = 8


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text has remainder 1 by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of all words of a table (lang, text), lower-cased; all texts are counted."""
    schema = "lang string, gram string, n long"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "gram", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held.setdefault(lang, Counter()).update(_WORD.findall((text.as_py() or "").lower()))
                if sum(map(len, held.values())) > _FLUSH:
                    yield flush()
        if held:
            yield flush()

    counted = texts.select("lang", "text").mapInArrow(count, schema)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame, size: int, *keys: Column) -> DataFrame:
    """(keys, cut) for each n-gram of ``rows.gram``, with word borders; null for words that are too short."""
    padded = F.concat(F.lit("^"), F.col("gram"), F.lit("$")) if size > 1 else F.col("gram")
    last = F.length(padded) - size + 1
    # Starts are exploded and cut afterwards: both are compiled, a lambda over the array is not.
    starts = F.when(last >= 1, F.sequence(F.lit(1), last))
    placed = rows.select(*keys, padded.alias("_padded"), F.explode_outer(starts).alias("_start"))
    cut = F.substring("_padded", F.col("_start"), F.lit(size))
    return placed.withColumn("cut", cut).drop("_padded", "_start")


def gram_counts(counts: DataFrame) -> DataFrame:
    """(lang, size, gram, n): n-grams of the distinct words of each language, with word borders."""
    every = None
    for size in range(1, LONGEST_GRAM + 1):
        cut = _cut(counts, size, F.col("lang")).filter("cut IS NOT NULL")
        part = cut.select("lang", F.lit(size).alias("size"), F.col("cut").alias("gram"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("lang", "size", "gram").agg(F.count(F.lit(1)).alias("n"))


class Table(NamedTuple):
    """Name -> row of ``values``, which has one column per language."""

    rows: dict[str, int]
    values: np.ndarray


class Model(NamedTuple):
    """``tables[0]`` scores known words, ``tables[n]`` the n-grams."""

    languages: list[str]
    tables: list[Table]
    prior: np.ndarray


def _base(names: int, languages: list[str], totals: dict[str, int]) -> np.ndarray:
    """Scores of a name that a language does not have."""
    return np.array([log(0.5 / (totals.get(x, 0) + 0.5 * names + 1)) for x in languages])


def _table(counted: list, languages: list[str], totals: dict[str, int]) -> Table:
    at = {lang: i for i, lang in enumerate(languages)}
    rows = {name: i for i, name in enumerate(dict.fromkeys(r.gram for r in counted))}
    values = np.tile(_base(len(rows), languages, totals), (len(rows), 1))
    for r in counted:
        values[rows[r.gram], at[r.lang]] += log((r.n + 0.5) / 0.5)
    return Table(rows, values)


def train(texts: DataFrame) -> Model:
    """Learn from a table (lang, text) without null languages, into the memory of one process.

    Counts cover all texts; the model holds the words seen twice or more in a language and all
    n-grams, each with its counts in all languages. ``word_scores`` is the same by joins.
    """
    words = keep_texts(word_counts(texts), "word-counts")
    known = words.filter("n > 1").select("gram").distinct()
    sized = keep(
        words.select("lang", F.lit(0).alias("size"), "gram", "n").unionByName(gram_counts(words)),
        "gram-counts",
    )
    totals = sized.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in totals})
    tables = []
    for size in range(LONGEST_GRAM + 1):
        rows = sized.filter(F.col("size") == size)
        if size == 0:
            rows = rows.join(known, "gram", "left_semi")
        tables.append(_table(rows.collect(), languages, {r.lang: r.n for r in totals if r.size == size}))
    return Model(languages, tables, _prior({r.lang: r.n for r in totals if r.size == 0}, languages))


def _prior(mass: dict[str, int], languages: list[str]) -> np.ndarray:
    whole = sum(mass.values()) or 1
    return np.array([log(mass.get(x, 0) / whole + 1e-6) for x in languages])


class Scorer:
    """Scores texts; remembers the values of words it has seen."""

    def __init__(self, model: Model):
        self._model = model
        # All tables below one another, with a row of zeros for words without any known n-gram.
        width = len(model.languages)
        tables = [t.values for t in model.tables if t.rows]
        self._all = np.concatenate([*tables, np.zeros((1, width))])
        self._offsets = np.cumsum([0, *(len(t.rows) for t in model.tables)]).tolist()
        self._values = np.zeros((1024, width))
        self._known: dict[str, int] = {}

    def _rows_of(self, word: str) -> list[int]:
        """Rows whose mean is the word's score: its own, or those of its longest known n-grams."""
        if (row := self._model.tables[0].rows.get(word)) is not None:
            return [row]
        for n in range(LONGEST_GRAM, 0, -1):
            table, offset = self._model.tables[n].rows, self._offsets[n]
            if rows := [table[g] + offset for g in grams(word, n) if g in table]:
                return rows
        return [self._offsets[-1]]

    def _learn(self, words: list[str]) -> None:
        """Score words not seen before, all in one step."""
        rows = [self._rows_of(word) for word in words]
        sizes = np.array([len(x) for x in rows])
        flat = np.array([r for x in rows for r in x])
        sums = np.add.reduceat(self._all[flat], np.cumsum(sizes) - sizes)
        first = len(self._known)
        while first + len(words) > len(self._values):
            self._values = np.concatenate([self._values, np.zeros_like(self._values)])
        self._values[first : first + len(words)] = sums / sizes[:, None]
        self._known.update(zip(words, range(first, first + len(words)), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior probability); equal scores go to the first language by code point."""
        if not text or not self._model.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self._known) > _REMEMBERED:
            self._known.clear()
        found = _WORD.findall(text.lower())
        if new := [word for word in set(found) if word not in self._known]:
            self._learn(new)
        seen = Counter(map(self._known.__getitem__, found))
        total = self._model.prior.copy()
        if seen:
            weights = np.fromiter(seen.values(), np.float64, len(seen))
            total += weights @ self._values[list(seen)]
        best = int(np.argmax(total))
        return self._model.languages[best], float(1 / np.exp(total - total[best]).sum())


def _by_language(rows: DataFrame, languages: list[str], keys: list[str], *more: Column) -> DataFrame:
    """(keys, c0, c1, ..., more): one row per key with its count in each language."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("lang") == F.lit(x), F.col("n"))), F.lit(0)).alias(f"c{i}")
        for i, x in enumerate(languages)
    ]
    return rows.groupBy(*keys).agg(*sums, *more)


def word_scores(counts: DataFrame) -> tuple[list[str], np.ndarray, DataFrame]:
    """Languages, prior and (gram, seen, v0, v1, ...): the scores of every distinct word.

    ``counts`` are the ``word_counts`` of all texts, with a null language for those not learned.
    Four tables are stored on the way: words, n-grams, and the words without a count of their own
    by their longest and by shorter n-grams.
    """
    learned = counts.filter(F.col("lang").isNotNull())
    mass = {r.lang: r.n for r in learned.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(mass)
    if not languages:
        return [], np.zeros(0), counts.select("gram", F.col("n").alias("seen"))
    names = [f"v{i}" for i in range(len(languages))]
    # What counts add to the base value of each language; a count of 0 adds nothing.
    gains = [F.log((F.col(f"c{i}") + 0.5) / 0.5).alias(v) for i, v in enumerate(names)]

    def scored(rows: DataFrame, base: np.ndarray) -> DataFrame:
        return rows.select("gram", "seen", *[(F.col(v) + float(b)).alias(v) for v, b in zip(names, base, strict=True)])

    most = F.max(F.when(F.col("lang").isNotNull(), F.col("n"))).alias("most")
    words = keep(_by_language(counts, languages, ["gram"], most, F.sum("n").alias("seen")), "distinct-words")
    known = words.filter("most > 1")
    grams_of = keep(_by_language(gram_counts(learned), languages, ["size", "gram"]), "gram-counts")
    sums = [F.sum(f"c{i}").alias(x) for i, x in enumerate(names)]
    totals = {r["size"]: r for r in grams_of.groupBy("size").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}

    def means(rows: DataFrame, size: int) -> DataFrame:
        """(gram, seen, v0, v1, ...): the mean over a word's known n-grams, null without one."""
        table = grams_of.filter(F.col("size") == size).select(F.col("gram").alias("cut"), *gains)
        n = totals[size]["n"] if size in totals else 0
        cut = _cut(rows, size, F.col("gram"), F.col("seen"))
        found = cut.join(F.broadcast(table) if n <= BROADCAST_GRAMS else table, "cut", "left")
        mass_of = {x: totals[size][v] for x, v in zip(languages, names, strict=True)} if n else {}
        averages = found.groupBy("gram", "seen").agg(*[F.avg(v).alias(v) for v in names])
        return scored(averages, _base(n, languages, mass_of))

    rest = words.filter("most IS NULL OR most <= 1").select("gram", "seen")
    longest = keep(means(rest, LONGEST_GRAM), "word-grams")
    rest = longest.filter("v0 IS NULL")
    shorter = None
    for size in range(LONGEST_GRAM - 1, 0, -1):
        part = means(rest, size).withColumn("size", F.lit(size))
        shorter = part if shorter is None else shorter.unionByName(part)
    # Words without any known n-gram tell nothing.
    best = F.max(F.when(F.col("v0").isNotNull(), F.struct("size", *names))).alias("best")
    shorter = shorter.groupBy("gram", "seen").agg(best)
    told = [F.coalesce(F.col(f"best.{v}"), F.lit(0.0)).alias(v) for v in names]
    shorter = keep(shorter.select("gram", "seen", *told), "short-grams")
    own = scored(known.select("gram", "seen", *gains), _base(known.count(), languages, mass))
    every = own.unionByName(longest.filter("v0 IS NOT NULL")).unionByName(shorter)
    return languages, _prior(mass, languages), every


def _frequent(scores: DataFrame, at_most: int) -> DataFrame:
    """The words of the highest counts, as many whole eighths of a doubling as ``at_most`` admits."""
    level = F.floor(F.log2("seen") * _PER_DOUBLING)
    sizes = scores.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = None, at_most
    for r in sorted(sizes, reverse=True):
        room -= r.n
        if room < 0:
            break
        least = r.level
    return scores.filter(F.lit(False) if least is None else level >= least)


def _summed(documents: DataFrame, held: tuple[dict[str, int], np.ndarray]) -> DataFrame:
    """Per row the summed scores of the held words, and the other words with their counts."""
    shared = documents.sparkSession.sparkContext.broadcast(held)
    rows = documents.select("doc_id", "text")
    kinds = pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        for batch in batches:
            letters, sums, rare = [], [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                letters.append(any(map(str.isalpha, text)))
                found = _WORD.findall(text.lower())
                seen = Counter(map(at.get, found))
                others = Counter(w for w in found if w not in at) if seen.pop(None, 0) else {}
                weights = np.fromiter(seen.values(), np.float64, len(seen))
                sums.append(weights @ values[list(seen)] if seen else np.zeros(values.shape[1]))
                rare.append([{"gram": w, "n": n} for w, n in others.items()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(letters, pa.bool_()),
                    pa.array(sums, pa.list_(pa.float64())),
                    pa.array(rare, kinds),
                ],
                names=["doc_id", "has_letter", "sums", "rare"],
            )

    rare_type = T.ArrayType(T.StructType().add("gram", "string").add("n", "long"))
    schema = rows.drop("text").schema.add("has_letter", "boolean")
    schema = schema.add("sums", T.ArrayType(T.DoubleType())).add("rare", rare_type)
    return rows.mapInArrow(run, schema)


def predict_languages(documents: DataFrame, held_words: int = HELD_WORDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn outside the held-out third, predict all rows.

    ``score`` is the posterior probability; equal scores go to the first language by code point.
    ``und`` with score 0 stands for a null text or one without a letter.
    """
    out = held_out(F.col("doc_id"))
    labelled = documents.select(F.when(~out, F.col("lang")).alias("lang"), "text")
    counts = keep_texts(word_counts(labelled), "word-counts")
    languages, prior, scores = word_scores(counts)
    if not languages:
        return documents.select(
            "doc_id", out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    names = [f"v{i}" for i in range(len(languages))]
    frequent = _frequent(scores, held_words).select("gram", *names).toArrow()
    at = {word: i for i, word in enumerate(frequent.column("gram").to_pylist())}
    held = at, np.column_stack([frequent.column(v).to_numpy() for v in names])
    flags = documents.select(F.struct("doc_id", out.alias("held_out")).alias("doc_id"), "text")
    # Rows keep a number of their own from here on, as the table is stored with it.
    parts = keep_texts(_summed(flags, held).withColumn("_uid", F.monotonically_increasing_id()), "held-sums")
    rare = parts.select("_uid", F.inline("rare")).join(scores.select("gram", *names), "gram")
    added = rare.groupBy("_uid").agg(*[F.sum(F.col("n") * F.col(v)).alias(v) for v in names])
    totals = F.array(
        *[
            F.col("sums")[i] + F.coalesce(F.col(v), F.lit(0.0)) + float(prior[i])
            for i, v in enumerate(names)
        ]
    )
    best = F.array_max("totals")
    ratios = F.aggregate("totals", F.lit(0.0), lambda total, x: total + F.exp(x - best))
    found = parts.join(added, "_uid", "left").select("doc_id.*", "has_letter", totals.alias("totals"))
    name = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("totals", best).cast("int"))
    return found.select(
        "doc_id",
        "held_out",
        F.when(F.col("has_letter"), name).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("has_letter"), 1 / ratios).otherwise(0.0).alias("score"),
    )
