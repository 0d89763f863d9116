"""Named queries over a directory of delivered tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaint.functions.labels import norm_scale, norm_seed
from quantaint.operators import constraints as dc
from quantaint.operators import inject, measures, supports, violations
from quantaint.operators.closed_shapley import closed_shapley
from quantaint.operators.components import general_gamma, hitting_bounds
from quantaint.operators.hitting import tuple_counts
from quantaint.operators.scenarios import Scenario, scenario_frame, sweep
from quantaint.operators.shapley import exact_shapley, sampled_shapley
from quantaint.operators.supports import ANSWER, QUERIES, answers_at_most
from quantaint.plans.icqa import answer_scores, responsibility_weights, scores_from_stored
from quantaint.plans.experiment import Experiment
from quantaint.schema import KEYS, MEASURES, SCENARIO_COLUMNS
from quantaint.sources import delimited, tables, violation_files
from quantaint.sources.results import ResultTable
from quantaint.sources.store import fresh_path, keep
from quantaint.sources.testdata import clean_database, raw_database

Query = Callable[[SparkSession, str], DataFrame]

SCALE = "sfdata"
SCENARIOS = [
    Scenario(SCALE, "subsetA", 0.001, 1),
    Scenario(SCALE, "subsetA", 0.2, 1),
    Scenario(SCALE, "subsetB", 0.2, 1),
    Scenario(SCALE, "subsetB", 0.2, 2),
]
MEMBERSHIP = ["db_id", "dc", "mis_id", "relation", "pk"]
GAMMA = ["db_id", "dc", "relation", "pk", "gamma", "n_edges", "n_nodes"]

_experiments: dict[tuple[str, str], Experiment] = {}
_registry: dict[str, Query] = {}


def experiment(spark: SparkSession, sf_dir: str) -> Experiment:
    """The stages shared by the queries of one directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _experiments:
        _experiments[key] = Experiment(clean_database(spark, sf_dir), SCENARIOS)
    return _experiments[key]


def queries() -> dict[str, Query]:
    return dict(_registry)


def query(name: str):
    def register(build: Query) -> Query:
        _registry[name] = build
        return build

    return register


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _score_names(*aggregations: str) -> list[str]:
    return [f"icqa_{agg}_{m.lower()}" for agg in aggregations for m in MEASURES]


# --- tables -----------------------------------------------------------------


def _typed(relation: str) -> Query:
    return lambda spark, sf_dir: clean_database(spark, sf_dir)[relation]


def _delimited(relation: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = clean_database(spark, sf_dir)[relation]
        path = fresh_path(spark, f"tbl-{relation}")
        delimited.write_relation(table, path, relation)
        return delimited.read_relation(spark, path, relation).select(*table.columns)

    return build


for _relation in KEYS:
    _registry[f"typed_{_relation}"] = _typed(_relation)
    _registry[f"load_tbl_{_relation}"] = _delimited(_relation)


# --- constraints --------------------------------------------------------------


@query("check_constraints")
def check_constraints(spark, sf_dir):
    return dc.check_constraints(clean_database(spark, sf_dir))


@query("check_all_ok")
def check_all_ok(spark, sf_dir):
    return dc.check_verdict(dc.check_constraints(clean_database(spark, sf_dir)))


def _violated_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    exp = experiment(spark, sf_dir)
    last = inject.narrowed(exp.overlay, SCENARIOS[-1:])
    return {
        **exp.database,
        **{rel: inject.violated_relation(last, rel).drop("db_id") for rel in dc.INJECTED},
    }


@query("check_constraints_violated")
def check_constraints_violated(spark, sf_dir):
    return dc.check_constraints(_violated_tables(spark, sf_dir))


@query("check_all_ok_violated")
def check_all_ok_violated(spark, sf_dir):
    return dc.check_verdict(dc.check_constraints(_violated_tables(spark, sf_dir)))


@query("check_constraints_scenarios")
def check_constraints_scenarios(spark, sf_dir):
    """``check_constraints_violated`` sees the last scenario only, this one all of them."""
    return violations.check_scenarios(experiment(spark, sf_dir).overlay)


@query("check_all_ok_scenarios")
def check_all_ok_scenarios(spark, sf_dir):
    return dc.check_verdict(check_constraints_scenarios(spark, sf_dir), ("db_id",))


@query("mis_dc3_raw")
def mis_dc3_raw(spark, sf_dir):
    """Delivered lines repeat keys, so equal key combinations are counted."""
    rows = dc.witness_rows(raw_database(spark, sf_dir), dc.DC3)
    return rows.groupBy(
        "o_orderkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")
    ).agg(F.count(F.lit(1)).alias("sets"))


# --- injection ----------------------------------------------------------------


@query("injection_targets")
def injection_targets(spark, sf_dir):
    return experiment(spark, sf_dir).overlay.targets


@query("candidates_dc4")
def candidates_dc4(spark, sf_dir):
    db = clean_database(spark, sf_dir)
    return inject.eligible_supplies(db, db["partsupp"]).select(*KEYS["partsupp"])


def _hits(overlay: inject.Overlay, name: str) -> DataFrame:
    relation = inject.INJECTIONS[name].relation
    return overlay.touched[relation].filter(f"hit_{name.lower()}")


def _sample(name: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _hits(experiment(spark, sf_dir).overlay, name)
        return rows.select("db_id", *KEYS[inject.INJECTIONS[name].relation])

    return build


def _injected(name: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        injection = inject.INJECTIONS[name]
        new = "new_" + injection.column.split("_", 1)[1]
        rows = _hits(experiment(spark, sf_dir).overlay, name)
        return rows.select(
            "db_id", *KEYS[injection.relation], F.col(injection.column).alias(new)
        )

    return build


for _name in inject.INJECTIONS:
    _registry[f"sample_{_name.lower()}"] = _sample(_name)
    _registry[f"inject_{_name.lower()}"] = _injected(_name)


@query("injection_log")
def injection_log(spark, sf_dir):
    return inject.injection_log(experiment(spark, sf_dir).overlay)


@query("violated_lineitem")
def violated_lineitem(spark, sf_dir):
    return inject.violated_relation(experiment(spark, sf_dir).overlay, "lineitem")


@query("violated_partsupp")
def violated_partsupp(spark, sf_dir):
    return inject.violated_relation(experiment(spark, sf_dir).overlay, "partsupp")


# --- violating sets -----------------------------------------------------------


def _violations(name: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        sets = violations.violation_sets(experiment(spark, sf_dir).overlay, (name,))
        return dc.membership(sets, ("db_id",))

    return build


for _name in dc.CONSTRAINTS:
    _registry[f"mis_{_name.lower()}"] = _violations(_name)


@query("mis_all")
def mis_all(spark, sf_dir):
    sets = violations.violation_sets(experiment(spark, sf_dir).overlay)
    return dc.membership(sets, ("db_id",))


@query("mis_membership")
def mis_membership(spark, sf_dir):
    return dc.membership(experiment(spark, sf_dir).violations, ("db_id",))


@query("mis_counts")
def mis_counts(spark, sf_dir):
    return violations.set_counts(experiment(spark, sf_dir).violations)


@query("mis_json_roundtrip")
def mis_json_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "sets-keyed")
    violation_files.write_sets(
        violation_files.keyed_layout(experiment(spark, sf_dir).violations), path
    )
    return violation_files.read_keyed(spark, path).select(*MEMBERSHIP)


@query("mis_jsonl_roundtrip")
def mis_jsonl_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "sets-listed")
    violation_files.write_sets(
        violation_files.listed_layout(experiment(spark, sf_dir).violations), path
    )
    return violation_files.read_listed(spark, path).select(*MEMBERSHIP)


@query("mis_export_shape")
def mis_export_shape(spark, sf_dir):
    records = violation_files.listed_layout(experiment(spark, sf_dir).violations)
    tuples = records.select(
        F.concat_ws("/", *SCENARIO_COLUMNS).alias("db_id"), "dc", F.inline("tuples")
    )
    # Keys are counted once per key first, so no group of equal keys is collected.
    keys = tuples.groupBy("db_id", "dc", "table", F.map_values("pk").alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return keys.groupBy("db_id", "dc", "table").agg(
        F.sum("n").alias("tuples"), F.count(F.lit(1)).alias("distinct_keys")
    )


# --- tuple measures -----------------------------------------------------------


@query("gamma_details")
def gamma_details(spark, sf_dir):
    sets = experiment(spark, sf_dir).violations
    return measures.gamma_details(sets, len(SCENARIOS)).select(*GAMMA)


@query("gamma_general")
def gamma_general(spark, sf_dir):
    sets = experiment(spark, sf_dir).violations
    return general_gamma(sets, ["db_id", "dc"]).select(*GAMMA)


@query("gamma_bounds")
def gamma_bounds(spark, sf_dir):
    """Least hitting sets of families without hubs: per supplier, the sets of orders shipped on one day."""
    lines = clean_database(spark, sf_dir)["lineitem"].select("l_suppkey", "l_shipdate", "l_orderkey").distinct()
    order = F.struct(F.lit("orders").alias("relation"), F.col("l_orderkey").cast("string").alias("pk"))
    sets = (
        lines.groupBy("l_suppkey", F.col("l_shipdate").cast("string").alias("mis_id"))
        .agg(F.array_sort(F.collect_list(order)).alias("tuples"))
        .filter(F.size("tuples") > 1)
    )
    return hitting_bounds(keep(sets, "shared-days"), ["l_suppkey"])


@query("hypergraph_stats")
def hypergraph_stats(spark, sf_dir):
    counts = tuple_counts(experiment(spark, sf_dir).violations, ["db_id", "dc"])
    hub = F.lit(False)
    for constraint in dc.CONSTRAINTS.values():
        hub = hub | ((F.col("dc") == constraint.name) & (F.col("relation") == constraint.hub))
    return counts.groupBy("db_id", "dc").agg(
        F.sum(F.when(hub, F.col("cnt"))).alias("n_sets"), F.count(F.lit(1)).alias("n_nodes")
    )


@query("rim_by_dc")
def rim_by_dc(spark, sf_dir):
    gamma = measures.gamma_details(experiment(spark, sf_dir).violations, len(SCENARIOS))
    rim = measures.rim_by_constraint(gamma)
    return _rounded(rim, "rim").select("db_id", "dc", "relation", "pk", "rim")


@query("measure_cbm")
def measure_cbm(spark, sf_dir):
    return measures.measure_cbm(experiment(spark, sf_dir).violations, scenarios=SCENARIOS)


@query("measure_cim")
def measure_cim(spark, sf_dir):
    return _rounded(measures.measure_cim(experiment(spark, sf_dir).violations), "value")


@query("measure_pim")
def measure_pim(spark, sf_dir):
    return _rounded(measures.measure_pim(experiment(spark, sf_dir).violations), "value")


@query("measure_rim")
def measure_rim(spark, sf_dir):
    sets = experiment(spark, sf_dir).violations
    return _rounded(measures.measure_rim(sets, len(SCENARIOS)), "value")


@query("tuple_measures")
def tuple_measures(spark, sf_dir):
    return _rounded(measures.long_measures(experiment(spark, sf_dir).wide_measures), "value")


@query("tuple_measures_selected")
def tuple_measures_selected(spark, sf_dir):
    """Two constraints, two measures, the first three scenarios by id."""
    overlay = experiment(spark, sf_dir).overlay
    first = inject.first_scenarios(overlay, 3)
    chosen = {name: dc.CONSTRAINTS[name] for name in ("DC1", "DC4")}
    sets = violations.violation_sets(first, tuple(chosen))
    wide = measures.wide_measures(sets, len(SCENARIOS), chosen)
    return _rounded(measures.long_measures(wide, ("CIM", "PIM")), "value")


@query("measure_nonzero")
def measure_nonzero(spark, sf_dir):
    return measures.measure_counts(experiment(spark, sf_dir).tuple_measures())


def _stored_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = experiment(spark, sf_dir).gathered_measures()
    path = fresh_path(spark, "stored-measures")
    tables.write_table(scores, path, gathered=True)
    return measures.normalise_measures(tables.read_table(spark, path, scores))


@query("measures_normalised")
def measures_normalised(spark, sf_dir):
    return _rounded(_stored_measures(spark, sf_dir), "value")


@query("scenario_index")
def scenario_index(spark, sf_dir):
    found = tables.scenario_index(experiment(spark, sf_dir).tuple_measures())
    return found.select(
        "*",
        F.concat_ws("/", *SCENARIO_COLUMNS).alias("db_id"),
        norm_scale(F.col("scale")).alias("scale_norm"),
        norm_seed(F.col("seed")).alias("seed_norm"),
    )


@query("pending_scenarios")
def pending_scenarios(spark, sf_dir):
    """Scenarios left after the first subset's scores were written."""
    exp = experiment(spark, sf_dir)
    done = exp.tuple_measures().filter("subset = 'subsetA'")
    return tables.pending_scenarios(exp.overlay.targets, done)


@query("pending_after_failure")
def pending_after_failure(spark, sf_dir):
    """What a stored table knows after one run that was published and one that was stopped before.

    Scores of partsupp tuples: the scenarios of the first subset have none and are finished.
    """
    exp = experiment(spark, sf_dir)
    scores = exp.tuple_measures().filter("relation = 'partsupp'")
    results = ResultTable(spark, fresh_path(spark, "stored-scores"), scores.schema)

    def of(chosen: list[Scenario]) -> DataFrame:
        return scores.join(F.broadcast(scenario_frame(spark, chosen).select("db_id")), "db_id", "left_semi").select(*scores.columns)

    results.commit(of(SCENARIOS[:3]), SCENARIOS[:3])
    results.stage(of(SCENARIOS[3:]), SCENARIOS[3:])
    wanted = scenario_frame(spark, SCENARIOS).select("db_id")
    found = wanted.join(results.manifest(), "db_id", "left")
    return found.select("db_id", F.col("version").isNotNull().alias("finished"), "n_rows")


@query("scenario_discovery")
def scenario_discovery(spark, sf_dir):
    """Cases found by the names of stored files alone, of one scale of two."""
    scores = experiment(spark, sf_dir).gathered_measures()
    path = fresh_path(spark, "stored-cases")
    other = F.when(F.col("subset") == "subsetB", F.lit("sfother"))
    scales = F.array_compact(F.array("scale", other))
    both = scores.withColumn("scale", F.explode(scales)).select(*scores.columns)
    tables.write_table(both, path, gathered=True)
    return tables.discover_cases(spark, path, [SCALE, "sfmissing"])


# --- the full sweep -----------------------------------------------------------


def sweep_experiment(spark: SparkSession, sf_dir: str) -> Experiment:
    """All 60 scenarios: two subsets, three ratios, ten seeds."""
    key = (spark.sparkContext.applicationId, f"sweep {sf_dir}")
    if key not in _experiments:
        _experiments[key] = Experiment(experiment(spark, sf_dir).database, sweep(SCALE))
    return _experiments[key]


@query("injection_log_sweep")
def injection_log_sweep(spark, sf_dir):
    return inject.injection_log(sweep_experiment(spark, sf_dir).overlay)


@query("check_constraints_sweep")
def check_constraints_sweep(spark, sf_dir):
    return violations.check_scenarios(sweep_experiment(spark, sf_dir).overlay)


@query("scenario_sweep")
def scenario_sweep(spark, sf_dir):
    """Per scenario and relation: tuples in violating sets and the sums of their four measures."""
    wide = sweep_experiment(spark, sf_dir).wide_measures
    sums = [F.sum(m.lower()).alias(m.lower()) for m in MEASURES]
    return _rounded(
        wide.groupBy("db_id", "relation").agg(F.count(F.lit(1)).alias("tuples"), *sums),
        *[m.lower() for m in MEASURES],
    )


# --- supports -----------------------------------------------------------------


def _support(spec: supports.QuerySpec) -> Query:
    return lambda spark, sf_dir: supports.numbered_supports(clean_database(spark, sf_dir), spec)


def _answers(spec: supports.QuerySpec) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = supports.support_rows(clean_database(spark, sf_dir), spec)
        return supports.answers(rows.select(F.lit(spec.name).alias("qname"), "answervalue"))

    return build


for _spec in QUERIES.values():
    _registry[f"support_{_spec.name.lower()}"] = _support(_spec)
    _registry[f"answers_{_spec.name.lower()}"] = _answers(_spec)


def _stored_supports(spark: SparkSession, sf_dir: str, scenario=None) -> DataFrame:
    """Every query's supports written per scenario and read back as one table."""
    db = clean_database(spark, sf_dir)
    path = fresh_path(spark, "stored-supports")
    merged = None
    for spec in QUERIES.values():
        rows = supports.numbered_supports(db, spec)
        merged = rows if merged is None else merged.unionByName(rows)
    labelled = tables.with_scenarios(merged, SCENARIOS)
    tables.write_table(labelled, path, ("qname",))
    return tables.read_table(spark, path, labelled, scenario)


@query("support_merged")
def support_merged(spark, sf_dir):
    return _stored_supports(spark, sf_dir)


@query("support_reading_order")
def support_reading_order(spark, sf_dir):
    """Supports written in reading order, read back with their positions."""
    db = clean_database(spark, sf_dir)
    flat = None
    for spec in QUERIES.values():
        rows = supports.numbered_supports(db, spec)
        flat = rows if flat is None else flat.unionByName(rows)
    path = fresh_path(spark, "ordered-supports")
    placed = supports.in_reading_order(flat)
    tables.write_in_order(placed, path, ["qname", "position"])
    return spark.read.schema(placed.schema).parquet(path)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuple_counts(experiment(spark, sf_dir).supports, ANSWER)


@query("support_size")
def support_size(spark, sf_dir):
    return supports.support_size(_counts(spark, sf_dir))


@query("support_stats")
def support_stats(spark, sf_dir):
    sizes = supports.support_size(_counts(spark, sf_dir))
    per_answer = experiment(spark, sf_dir).supports.groupBy(*ANSWER).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        per_answer.join(sizes, ANSWER)
        .groupBy("qname")
        .agg(
            F.count(F.lit(1)).alias("answers"),
            F.sum("n").alias("supports"),
            F.sum("support_size").alias("tuples"),
        )
    )


# --- answer scores ------------------------------------------------------------


@query("resp_weights")
def resp_weights(spark, sf_dir):
    weights = responsibility_weights(_counts(spark, sf_dir), experiment(spark, sf_dir).supports)
    return _rounded(weights, "rho").select(*ANSWER, "relation", "pk", "cnt", "gamma", "rho")


@query("shapley_exact")
def shapley_exact(spark, sf_dir):
    sets = experiment(spark, sf_dir).supports
    return _rounded(exact_shapley(sets, _counts(spark, sf_dir), answers_at_most()), "phi")


@query("shapley_closed")
def shapley_closed(spark, sf_dir):
    return _rounded(closed_shapley(experiment(spark, sf_dir).supports), "phi")


@query("shapley_mc")
def shapley_mc(spark, sf_dir):
    sets = experiment(spark, sf_dir).supports
    widest = max(len(spec.relations) for spec in QUERIES.values())
    phi = sampled_shapley(sets, _counts(spark, sf_dir), answers_at_most(), widest)
    return _rounded(phi, "phi")


def _scores(spark, sf_dir, aggregations: tuple[str, ...], rows: str = "all") -> DataFrame:
    exp = experiment(spark, sf_dir)
    # Counts alone need no weights; the sampled ones are computed once per scale.
    weights = None if aggregations == ("prov",) else exp.weights
    scores = answer_scores(
        exp.supports, exp.wide_measures, SCENARIOS, aggregations=aggregations, rows=rows, weights=weights
    )
    return _rounded(scores, *_score_names(*aggregations))


@query("icqa_prov")
def icqa_prov(spark, sf_dir):
    return _scores(spark, sf_dir, ("prov",))


@query("icqa_resp")
def icqa_resp(spark, sf_dir):
    return _scores(spark, sf_dir, ("resp",))


@query("icqa_shap")
def icqa_shap(spark, sf_dir):
    return _scores(spark, sf_dir, ("shap",))


@query("icqa_all")
def icqa_all(spark, sf_dir):
    return _scores(spark, sf_dir, ("prov", "resp", "shap"))


@query("icqa_stored")
def icqa_stored(spark, sf_dir):
    """All scores, committed in two runs and read back from the stored table."""
    exp = experiment(spark, sf_dir)

    def compute(chosen: list[Scenario]) -> DataFrame:
        return answer_scores(exp.supports, exp.wide_measures, chosen, weights=exp.weights)

    results = ResultTable(spark, fresh_path(spark, "stored-answers"), compute(SCENARIOS).schema)
    results.commit(compute(SCENARIOS[:1]), SCENARIOS[:1])
    results.resume(SCENARIOS, compute)
    return _rounded(results.read(), *_score_names("prov", "resp", "shap"))


@query("icqa_prov_stored")
def icqa_prov_stored(spark, sf_dir):
    return _scores(spark, sf_dir, ("prov",), rows="stored")


@query("icqa_shap_measured")
def icqa_shap_measured(spark, sf_dir):
    return _scores(spark, sf_dir, ("shap",), rows="measured")


@query("icqa_from_stored")
def icqa_from_stored(spark, sf_dir):
    scores = scores_from_stored(_stored_supports(spark, sf_dir), _stored_measures(spark, sf_dir))
    return _rounded(scores, *_score_names("prov"))


@query("shap_tasks")
def shap_tasks(spark, sf_dir):
    measured = _scores(spark, sf_dir, ("prov",), rows="measured")
    return measured.select(*SCENARIO_COLUMNS, "qname", "answer_id")


@query("icqa_all_from_stored")
def icqa_all_from_stored(spark, sf_dir):
    """All scores from written supports (one scenario's folder) and written measures."""
    first = SCENARIOS[0]
    folder = {"scale": first.scale, "subset": first.subset}
    flat = _stored_supports(spark, sf_dir, folder).filter(F.col("ratio") == "0p1pct")
    sets = keep(supports.nest_supports(flat), "nested-supports")
    wide = measures.widen_measures(_stored_measures(spark, sf_dir))
    return _rounded(answer_scores(sets, wide, SCENARIOS), *_score_names("prov", "resp", "shap"))
