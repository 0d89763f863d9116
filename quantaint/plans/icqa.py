"""Answer-level scores: tuple measures weighted by the tuple's role in an answer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaint.operators.constraints import CONSTRAINTS
from quantaint.operators.components import general_gamma
from quantaint.operators.hitting import hub_gamma, several_hubs, tuple_counts, with_rho
from quantaint.operators.scenarios import Scenario, db_ids, split_db_id
from quantaint.operators.shapley import EXACT_TUPLES, SAMPLES, shapley_weights
from quantaint.operators.supports import ANSWER, QUERIES, QuerySpec, answers, answers_at_most
from quantaint.schema import MEASURES, SCENARIO_COLUMNS
from quantaint.sources.store import keep

AGGREGATIONS: dict[str, str] = {"prov": "cnt", "resp": "rho", "shap": "phi"}


def responsibility_weights(
    counts: DataFrame, supports: DataFrame, specs: Mapping[str, QuerySpec] = QUERIES
) -> DataFrame:
    """Per (answer, tuple): occurrences, gamma with its lower bound and status, rho = 1/(1+gamma).

    Answers whose supports have several hubs that not every tuple's key determines (two
    nations of one name) take the general method.
    """
    is_hub = F.lit(False)
    determined = F.lit(False)
    for spec in specs.values():
        here = F.col("qname") == spec.name
        is_hub = is_hub | (here & (F.col("relation") == spec.hub))
        determined = determined | (here & F.lit(spec.hub_is_determined))
    columns = [*ANSWER, "relation", "pk", "cnt", "gamma", "gamma_low", "status"]
    exact = {"gamma_low": F.col("gamma"), "status": F.lit("OPTIMAL")}
    most = answers_at_most(specs)
    odd = keep(several_hubs(counts, ANSWER, is_hub, determined), "several-hubs")
    if odd.isEmpty():
        return with_rho(hub_gamma(counts, ANSWER, is_hub, most, determined).withColumns(exact).select(*columns))
    plain = hub_gamma(counts.join(odd, ANSWER, "left_anti"), ANSWER, is_hub, most, determined)
    sets = supports.join(odd, ANSWER, "left_semi").withColumn(
        "mis_id", F.sha2(F.to_json(F.array_sort("tuples")), 256)
    )
    general = general_gamma(sets, ANSWER)
    return with_rho(plain.withColumns(exact).select(*columns).unionByName(general.select(*columns)))


def answer_weights(
    supports: DataFrame,
    specs: Mapping[str, QuerySpec] = QUERIES,
    aggregations: tuple[str, ...] = tuple(AGGREGATIONS),
    exact_tuples: int = EXACT_TUPLES,
    samples: int = SAMPLES,
) -> DataFrame:
    """(qname, answervalue, relation, pk) with the weights the scores need.

    The per-tuple counts feed every weight and are kept as a table.
    """
    counts = keep(tuple_counts(supports, ANSWER), "answer-tuples")
    tid = [*ANSWER, "relation", "pk"]
    weights = counts.select(*tid, "cnt")
    if "resp" in aggregations:
        weights = responsibility_weights(counts, supports, specs).select(*tid, "cnt", "gamma", "rho")
    if "shap" in aggregations:
        phi = shapley_weights(
            supports,
            counts,
            answers_at_most(specs),
            max(len(spec.relations) for spec in specs.values()),
            exact_tuples,
            samples,
            specs,
        )
        weights = weights.join(phi.select(*tid, "phi"), tid)
    return weights


def weighted_scores(
    weights: DataFrame,
    wide: DataFrame,
    aggregations: tuple[str, ...] = tuple(AGGREGATIONS),
    constraints=CONSTRAINTS,
) -> DataFrame:
    """Scores of the answers that contain a measured tuple, per scenario.

    Weights of relations no constraint mentions can never match and are dropped
    before the join. Partial sums leave one row per (scenario, answer) and task.
    """
    measured_relations = sorted({rel for dc in constraints.values() for rel in dc.relations})
    sums = [
        F.sum(F.col(AGGREGATIONS[agg]) * F.col(m.lower())).alias(f"icqa_{agg}_{m.lower()}")
        for agg in aggregations
        for m in MEASURES
    ]
    return (
        weights.filter(F.col("relation").isin(measured_relations))
        .join(wide, ["relation", "pk"])
        .groupBy("db_id", *ANSWER)
        .agg(*sums)
    )


def answer_scores(
    supports: DataFrame,
    wide: DataFrame,
    scenarios: list[Scenario],
    aggregations: tuple[str, ...] = tuple(AGGREGATIONS),
    rows: str = "all",
    specs: Mapping[str, QuerySpec] = QUERIES,
    samples: int = SAMPLES,
    weights: DataFrame | None = None,
) -> DataFrame:
    """One row per scenario and answer.

    ``rows="all"`` keeps every answer, with zeros and ``measured = false`` where
    no tuple of its supports has a score. ``rows="measured"`` keeps the others
    only. ``rows="stored"`` keeps, per query and scenario, the measured answers,
    or every answer with null scores when none is measured.
    """
    if rows not in ("all", "measured", "stored"):
        raise ValueError(f"unknown row choice: {rows}")
    if weights is None:
        weights = answer_weights(supports, specs, aggregations, samples=samples)
    scores = weighted_scores(weights, wide, aggregations)
    names = [f"icqa_{agg}_{m.lower()}" for agg in aggregations for m in MEASURES]
    listed = F.broadcast(answers(supports))
    if rows == "measured":
        full = scores.join(listed, ANSWER).withColumn("measured", F.lit(True))
    else:
        every = listed.select("*", F.explode(db_ids(scenarios)).alias("db_id"))
        full = every.join(scores, ["db_id", *ANSWER], "left").withColumn(
            "measured", F.col(names[0]).isNotNull()
        )
        if rows == "all":
            full = full.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
        else:
            some = scores.groupBy("db_id", "qname").agg(F.lit(True).alias("some"))
            full = full.join(some, ["db_id", "qname"], "left").filter(
                F.col("measured") | F.col("some").isNull()
            )
    return split_db_id(full).select(
        *SCENARIO_COLUMNS, "qname", "answer_id", "answervalue", *names, "measured"
    )


def scores_from_stored(flat_supports: DataFrame, measures: DataFrame) -> DataFrame:
    """Provenance scores from stored supports and stored long measures.

    A tuple counts once per support row it appears in.
    """
    key = [*SCENARIO_COLUMNS, "relation", "pk"]
    joined = flat_supports.withColumnRenamed("rel", "relation").join(measures, key)
    sums = joined.groupBy(*SCENARIO_COLUMNS, "qname", "answer_id", "answervalue").pivot(
        "measure", list(MEASURES)
    )
    wide = sums.agg(F.sum("value"))
    columns = [F.coalesce(m, F.lit(0.0)).alias(f"icqa_prov_{m.lower()}") for m in MEASURES]
    return wide.select(*SCENARIO_COLUMNS, "qname", "answer_id", "answervalue", *columns)
