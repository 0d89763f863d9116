"""Plain SQL statements with the results the registered queries must have.

Each statement is a chain of named subqueries over the delivered tables. It
builds full copies of every violated database and ranks whole tables, which the
Spark plans avoid, so the two sides share definitions but not methods.
"""

from __future__ import annotations

SCALE = "sfdata"
# (subset, ratio, ratio label, seed)
SCENARIOS = (
    ("subsetA", 0.001, "0p1pct", 1),
    ("subsetA", 0.2, "20pct", 1),
    ("subsetB", 0.2, "20pct", 1),
    ("subsetB", 0.2, "20pct", 2),
)
P = 2**31 - 1
SAMPLES = 10_000


def _words(text: str) -> str:
    halves = [f"('0x' || substr(md5({text}), {at}, 15))::BIGINT" for at in (1, 17)]
    return (
        f"{halves[0]} % {P} AS w1, {halves[0]} >> 31 AS w2, "
        f"{halves[1]} % {P} AS w3, {halves[1]} >> 31 AS w4"
    )


def _value(k: str) -> str:
    def stirred(a: str, b: str) -> str:
        x = f"(({a} * {k} + {b}) % {P})"
        return f"(xor({x}, {x} >> 16) * 73244475 % {P})"

    return f"{stirred('w1', 'w2')} * 2147483648 + {stirred('w3', 'w4')}"


# The full experiment.
SWEEP = tuple(
    (subset, ratio, tag, seed)
    for subset in ("subsetA", "subsetB")
    for ratio, tag in ((0.0001, "0p01pct"), (0.0005, "0p05pct"), (0.001, "0p1pct"))
    for seed in range(1, 11)
)


def _scenario_rows(scenarios: tuple) -> str:
    return ", ".join(
        f"('{SCALE}', '{subset}', '{tag}', 'seed{seed:02d}', "
        f"'{SCALE}/{subset}/{tag}/seed{seed:02d}', CAST({ratio} AS DOUBLE), {seed})"
        for subset, ratio, tag, seed in scenarios
    )


_SCENARIO_ROWS = _scenario_rows(SCENARIOS)

# Nation names by key.
_NATIONS = (
    "ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA",
    "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA",
    "SAUDI ARABIA", "VIETNAM", "RUSSIA", "UNITED KINGDOM", "UNITED STATES",
)
_NATION_LIST = ", ".join(f"'{name}'" for name in _NATIONS)

# Grouping column, joins and predicates of the five queries.
_SUPPORT_QUERIES = {
    "Q1": (
        "o.o_orderpriority",
        "c_orders o",
        "o.o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
        " AND o.o_orderdate >= DATE '1995-03-01' AND o.o_orderdate < DATE '1995-03-11'"
        " AND o.o_totalprice > 70000",
        ("orders",),
        "orders",
    ),
    "Q2": (
        "l.l_shipmode",
        "c_orders o JOIN c_lineitem l ON l.l_orderkey = o.o_orderkey",
        "l.l_shipmode IN ('AIR', 'SHIP', 'TRUCK', 'MAIL')"
        " AND o.o_orderdate >= DATE '1995-03-15' AND o.o_orderdate < DATE '1995-03-18'"
        " AND l.l_quantity > 30 AND l.l_discount BETWEEN 0.04 AND 0.08"
        " AND l.l_shipinstruct IN ('DELIVER IN PERSON', 'COLLECT COD')",
        ("orders", "lineitem"),
        "orders",
    ),
    "Q3": (
        "n.n_name",
        "c_customer c JOIN c_orders o ON o.o_custkey = c.c_custkey"
        " JOIN c_nation n ON n.n_nationkey = c.c_nationkey",
        "n.n_name IN ('FRANCE', 'GERMANY', 'BRAZIL', 'CANADA')"
        " AND c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')"
        " AND o.o_orderdate >= DATE '1995-01-01' AND o.o_orderdate < DATE '1995-01-11'",
        ("customer", "orders", "nation"),
        "nation",
    ),
    "Q4": (
        "n.n_name",
        "c_orders o JOIN c_lineitem l ON l.l_orderkey = o.o_orderkey"
        " JOIN c_supplier s ON s.s_suppkey = l.l_suppkey"
        " JOIN c_nation n ON n.n_nationkey = s.s_nationkey",
        "n.n_name IN ('FRANCE', 'GERMANY', 'BRAZIL')"
        " AND o.o_orderdate >= DATE '1995-02-01' AND o.o_orderdate < DATE '1995-02-06'"
        " AND l.l_quantity BETWEEN 25 AND 80 AND l.l_shipdate < DATE '1995-03-15'"
        " AND s.s_acctbal >= -500",
        ("orders", "lineitem", "supplier", "nation"),
        "nation",
    ),
    "Q5": (
        "r.r_name",
        "c_orders o JOIN c_lineitem l ON l.l_orderkey = o.o_orderkey"
        " JOIN c_supplier s ON s.s_suppkey = l.l_suppkey"
        " JOIN c_nation n ON n.n_nationkey = s.s_nationkey"
        " JOIN c_region r ON r.r_regionkey = n.n_regionkey",
        "r.r_name IN ('EUROPE', 'ASIA', 'AMERICA', 'AFRICA')"
        " AND o.o_orderdate >= DATE '1995-04-01' AND o.o_orderdate < DATE '1995-04-06'"
        " AND l.l_quantity > 25 AND l.l_discount BETWEEN 0.02 AND 0.08"
        " AND l.l_shipmode IN ('AIR', 'TRUCK', 'SHIP')",
        ("orders", "lineitem", "supplier", "nation", "region"),
        "region",
    ),
}
_KEY_COLUMNS = {
    "orders": ("o.o_orderkey",),
    "lineitem": ("l.l_orderkey", "l.l_linenumber"),
    "customer": ("c.c_custkey",),
    "supplier": ("s.s_suppkey",),
    "nation": ("n.n_nationkey",),
    "region": ("r.r_regionkey",),
}


def _product(p: str, q: str) -> str:
    """Coefficients of the product of two polynomials, lists from the constant up."""
    return (
        f"list_transform(range(0, len({p}) + len({q}) - 1), lambda s: list_sum(list_transform("
        f"range(greatest(0, s - len({q}) + 1), least(len({p}), s + 1)), lambda i: {p}[i + 1] * {q}[s - i + 1])))"
    )


def _chance(coalitions: str) -> str:
    """Share of the orders of n tuples in which a coalition counted by size comes just before a tuple."""
    return (
        f"list_sum(list_transform({coalitions}, lambda c, i: c * exp(lgamma(i) + lgamma(n - i + 1) - lgamma(n + 1))))"
    )


def _text(columns: tuple[str, ...]) -> str:
    return " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


def _flat_supports(name: str) -> str:
    answer, source, where, relations, hub = _SUPPORT_QUERIES[name]
    keys = [c for rel in relations for c in _KEY_COLUMNS[rel]]
    columns = ", ".join(f"{c} AS {c.replace('.', '_')}" for c in keys)
    order = ", ".join(c.replace(".", "_") for c in keys)
    branches = []
    for rel in relations:
        own = [c.replace(".", "_") for c in _KEY_COLUMNS[rel]]
        padded = own + ["NULL::BIGINT"] * (4 - len(own))
        listed = ", ".join(f"{c} AS key{i}" for i, c in enumerate(padded, 1))
        branches.append(
            f"SELECT '{name}' AS qname, answer_id, support_id, answervalue, '{rel}' AS rel, "
            f"{listed}, {_text(tuple(own))} AS pk, "
            f"{_text(tuple(c.replace('.', '_') for c in _KEY_COLUMNS[hub]))} AS comp FROM numbered"
        )
    return (
        f"WITH base AS (SELECT {answer} AS answervalue, {columns} FROM {source} WHERE {where}), "
        "ids AS (SELECT answervalue, ROW_NUMBER() OVER (ORDER BY answervalue) AS answer_id "
        "FROM (SELECT DISTINCT answervalue FROM base)), "
        f"numbered AS (SELECT answer_id, base.*, ROW_NUMBER() OVER "
        f"(PARTITION BY answer_id ORDER BY {order}) AS support_id "
        "FROM base JOIN ids USING (answervalue)) " + " UNION ALL ".join(branches)
    )


def _members(dc: str, hub: str, source: str, where: str, members: dict[str, tuple]) -> str:
    ids = " || '|' || ".join(f"'{rel}#' || {_text(cols)}" for rel, cols in members.items())
    tuples = ", ".join(
        f"{{'relation': '{rel}', 'pk': {_text(cols)}}}" for rel, cols in members.items()
    )
    return (
        f"SELECT db_id, '{dc}' AS dc, {ids} AS mis_id, {_text(members[hub])} AS comp, "
        f"UNNEST([{tuples}]) AS t FROM {source} WHERE {where}"
    )


_LINE = ("l_orderkey", "l_linenumber")
# Parts that several others use and that rank or number whole tables.
_MATERIALIZED = {"c_lineitem", "c_partsupp", "candidates_dc4", "picked", "picked_lines", "v_lineitem"}
_ORDERS_LINES = "c_orders JOIN v_lineitem ON l_orderkey = o_orderkey"

# name -> (names it uses, statement)
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "c_region": ((), "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "c_nation": (
        (),
        f"SELECT n_nationkey::BIGINT AS n_nationkey, ([{_NATION_LIST}])[n_nationkey + 1] AS n_name, "
        "n_regionkey::BIGINT AS n_regionkey FROM nation",
    ),
    "c_supplier": (
        (),
        "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, "
        "s_acctbal FROM supplier",
    ),
    "c_customer": (
        (),
        "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, "
        "c_acctbal, c_mktsegment FROM customer",
    ),
    "c_part": (
        (),
        "SELECT p_partkey::BIGINT AS p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, "
        "p_retailprice FROM part",
    ),
    "c_orders": (
        (),
        "SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, "
        "o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
    ),
    "c_partsupp": (
        (),
        "SELECT pk AS ps_partkey, sk AS ps_suppkey, 1 + (pk * 31 + sk * 17) % 9999 AS ps_availqty, "
        "CAST(1 + (pk * 13 + sk * 7) % 1000 AS DOUBLE) AS ps_supplycost FROM "
        "(SELECT DISTINCT l_partkey::BIGINT AS pk, l_suppkey::BIGINT AS sk FROM lineitem)",
    ),
    "numbered_lines": (
        (),
        "SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, "
        "l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, "
        "l_linestatus) AS ln FROM lineitem",
    ),
    "dated_lines": (
        ("numbered_lines", "c_orders"),
        "SELECT n.*, o_orderdate, o_orderstatus, o_orderdate + CAST(1 + (l_orderkey * 7 + ln * 13 + "
        "l_partkey) % 121 AS INTEGER) AS ship FROM numbered_lines n JOIN c_orders "
        "ON l_orderkey = o_orderkey",
    ),
    "c_lineitem": (
        ("dated_lines",),
        "SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, "
        "l_suppkey::BIGINT AS l_suppkey, ln::BIGINT AS l_linenumber, l_quantity, l_extendedprice, "
        "l_discount, l_tax, l_returnflag, "
        "CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE l_linestatus END AS l_linestatus, "
        "ship AS l_shipdate, o_orderdate + CAST(30 + (l_orderkey * 11 + ln * 5 + l_suppkey) % 61 "
        "AS INTEGER) AS l_commitdate, ship + CAST(1 + (l_orderkey * 3 + ln * 17) % 30 AS INTEGER) "
        "AS l_receiptdate, (['DELIVER IN PERSON', 'COLLECT COD', 'NONE', 'TAKE BACK RETURN'])"
        "[1 + (l_orderkey + ln * 7 + l_suppkey) % 4] AS l_shipinstruct, "
        "(['REG AIR', 'AIR', 'RAIL', 'SHIP', 'TRUCK', 'MAIL', 'FOB'])"
        "[1 + (l_orderkey * 5 + ln * 3 + l_partkey) % 7] AS l_shipmode FROM dated_lines",
    ),
    "scen": (
        (),
        "SELECT * FROM (VALUES "
        + _SCENARIO_ROWS
        + ") AS v(scale, subset, ratio, seed, db_id, ratio_value, seed_value)",
    ),
    "targets": (
        ("scen", "c_lineitem", "c_partsupp"),
        "SELECT db_id, dc, CAST(seed_value * 1000 + number AS BIGINT) AS draw, base_rows, "
        "CASE WHEN base_rows > 0 AND ratio_value > 0 THEN "
        "GREATEST(1, CAST(FLOOR(base_rows * ratio_value) AS BIGINT)) ELSE 0 END AS requested "
        "FROM scen JOIN (SELECT 'DC1' AS dc, 1 AS number, COUNT(*) AS base_rows FROM c_lineitem "
        "UNION ALL SELECT 'DC2', 2, COUNT(*) FROM c_lineitem "
        "UNION ALL SELECT 'DC3', 3, COUNT(*) FROM c_lineitem "
        "UNION ALL SELECT 'DC4', 4, COUNT(*) FROM c_partsupp) d "
        "ON subset = 'subsetB' OR dc IN ('DC1', 'DC2')",
    ),
    "candidates_dc4": (
        ("c_partsupp", "c_lineitem", "c_part"),
        "SELECT DISTINCT ps_partkey, ps_suppkey FROM c_partsupp JOIN c_lineitem "
        "ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey JOIN c_part "
        "ON p_partkey = ps_partkey WHERE ps_availqty >= 0",
    ),
    "candidates": (
        ("c_lineitem", "c_orders", "candidates_dc4"),
        "SELECT 'DC1' AS dc, l_orderkey AS k1, l_linenumber AS k2 FROM c_lineitem "
        "WHERE l_receiptdate >= l_shipdate UNION ALL "
        "SELECT 'DC2', l_orderkey, l_linenumber FROM c_lineitem JOIN c_orders "
        "ON l_orderkey = o_orderkey WHERE l_commitdate >= o_orderdate UNION ALL "
        "SELECT 'DC3', l_orderkey, l_linenumber FROM c_lineitem JOIN c_orders "
        "ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linestatus = 'F' UNION ALL "
        "SELECT 'DC4', ps_partkey, ps_suppkey FROM candidates_dc4",
    ),
    "picked": (
        ("candidates", "targets"),
        "SELECT db_id, dc, k1, k2 FROM (SELECT t.db_id, c.dc, k1, k2, requested, "
        "ROW_NUMBER() OVER (PARTITION BY t.db_id, c.dc ORDER BY "
        + _value("draw")
        + ", k1, k2) AS place FROM (SELECT *, "
        + _words("CAST(k1 AS VARCHAR) || ',' || CAST(k2 AS VARCHAR)")
        + " FROM candidates) c JOIN targets t ON t.dc = c.dc) WHERE place <= requested",
    ),
    "picked_lines": (
        ("picked",),
        "SELECT db_id, k1, k2, bool_or(dc = 'DC1') AS in1, bool_or(dc = 'DC2') AS in2, "
        "bool_or(dc = 'DC3') AS in3 FROM picked WHERE dc <> 'DC4' GROUP BY ALL",
    ),
    "v_lineitem": (
        ("c_lineitem", "c_orders", "scen", "picked_lines"),
        "SELECT s.db_id, l.* REPLACE ("
        "CASE WHEN p.in1 THEN CAST(l_shipdate - INTERVAL 1 DAY AS DATE) ELSE l_receiptdate END "
        "AS l_receiptdate, "
        "CASE WHEN p.in2 THEN CAST(o_orderdate - INTERVAL 1 DAY AS DATE) ELSE l_commitdate END "
        "AS l_commitdate, "
        "CASE WHEN p.in3 THEN 'O' ELSE l_linestatus END AS l_linestatus) "
        "FROM c_lineitem l JOIN c_orders ON o_orderkey = l_orderkey JOIN scen s ON TRUE "
        "LEFT JOIN picked_lines p ON p.db_id = s.db_id AND p.k1 = l_orderkey AND p.k2 = l_linenumber",
    ),
    "v_partsupp": (
        ("c_partsupp", "scen", "picked"),
        "SELECT s.db_id, ps.* REPLACE (CASE WHEN p.dc IS NULL THEN ps_availqty ELSE "
        "-ABS(ps_availqty) - 1 END AS ps_availqty) FROM c_partsupp ps JOIN scen s ON TRUE "
        "LEFT JOIN picked p ON p.db_id = s.db_id AND p.dc = 'DC4' AND p.k1 = ps_partkey "
        "AND p.k2 = ps_suppkey",
    ),
    "mis_dc1": (
        ("v_lineitem",),
        _members("DC1", "lineitem", "v_lineitem", "l_receiptdate < l_shipdate", {"lineitem": _LINE}),
    ),
    "mis_dc2": (
        ("v_lineitem", "c_orders"),
        _members(
            "DC2", "orders", _ORDERS_LINES, "l_commitdate < o_orderdate",
            {"orders": ("o_orderkey",), "lineitem": _LINE},
        ),
    ),
    "mis_dc3": (
        ("v_lineitem", "c_orders"),
        _members(
            "DC3", "orders", _ORDERS_LINES, "o_orderstatus = 'F' AND l_linestatus <> 'F'",
            {"orders": ("o_orderkey",), "lineitem": _LINE},
        ),
    ),
    "mis_dc4": (
        ("v_partsupp", "c_lineitem", "c_part"),
        _members(
            "DC4", "part",
            "c_lineitem JOIN v_partsupp ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey "
            "JOIN c_part ON ps_partkey = p_partkey",
            "ps_availqty < 0",
            {
                "lineitem": _LINE,
                "partsupp": ("ps_partkey", "ps_suppkey"),
                "part": ("p_partkey",),
            },
        ),
    ),
    "mis": (
        ("mis_dc1", "mis_dc2", "mis_dc3", "mis_dc4"),
        "SELECT db_id, dc, mis_id, comp, t.relation AS relation, t.pk AS pk FROM "
        "(SELECT * FROM mis_dc1 UNION ALL SELECT * FROM mis_dc2 UNION ALL "
        "SELECT * FROM mis_dc3 UNION ALL SELECT * FROM mis_dc4)",
    ),
    "members": (
        ("mis",),
        "SELECT db_id, dc, comp, relation, pk, COUNT(*) AS cnt FROM mis GROUP BY ALL",
    ),
    "gamma": (
        ("members", "mis"),
        "SELECT db_id, dc, relation, pk, cnt, parts - 1 + CASE WHEN cnt < part_sets THEN 1 ELSE 0 "
        "END AS gamma, n_sets - cnt AS n_edges, n_nodes, n_sets FROM members "
        "JOIN (SELECT db_id, dc, comp, COUNT(DISTINCT mis_id) AS part_sets FROM mis GROUP BY ALL) "
        "USING (db_id, dc, comp) "
        "JOIN (SELECT db_id, dc, COUNT(DISTINCT comp) AS parts, COUNT(DISTINCT mis_id) AS n_sets, "
        "COUNT(DISTINCT relation || '#' || pk) AS n_nodes FROM mis GROUP BY ALL) USING (db_id, dc)",
    ),
    "rim_dc": (
        ("gamma",),
        "SELECT *, n_sets * (1.0::DOUBLE / (1 + gamma)) / "
        "SUM(1.0::DOUBLE / (1 + gamma)) OVER (PARTITION BY db_id, dc) AS rim FROM gamma",
    ),
    # Weights of relations and constraints.
    "cim_weights": (
        (),
        "SELECT * FROM (VALUES ('DC1', 'lineitem', 1.0::DOUBLE), ('DC2', 'orders', 2.0), "
        "('DC2', 'lineitem', 2.0), ('DC3', 'orders', 2.0), ('DC3', 'lineitem', 2.0), "
        "('DC4', 'lineitem', 2.0), ('DC4', 'partsupp', 3.0), ('DC4', 'part', 1.0)) "
        "AS v(dc, relation, cim_w)",
    ),
    "pim_weights": (
        (),
        "SELECT * FROM (VALUES ('DC1', 1.0::DOUBLE), ('DC2', 0.5), ('DC3', 0.5), "
        "('DC4', 1.0::DOUBLE / 3)) AS v(dc, pim_w)",
    ),
    "wide": (
        ("rim_dc", "cim_weights", "pim_weights"),
        "SELECT db_id, relation, pk, CAST(COUNT(*) AS DOUBLE) AS cbm, SUM(cnt * cim_w) AS cim, "
        "SUM(cnt * pim_w) AS pim, SUM(rim) AS rim FROM rim_dc JOIN cim_weights USING (dc, relation) "
        "JOIN pim_weights USING (dc) GROUP BY ALL",
    ),
    "long": (
        ("wide", "scen"),
        "SELECT scale, subset, ratio, seed, db_id, relation, pk, measure, value FROM ("
        + " UNION ALL ".join(
            f"SELECT db_id, relation, pk, '{m.upper()}' AS measure, {m} AS value FROM wide"
            for m in ("cbm", "cim", "pim", "rim")
        )
        + ") JOIN scen USING (db_id)",
    ),
    **{
        f"flat_{q.lower()}": (
            ("c_orders", "c_lineitem", "c_customer", "c_supplier", "c_nation", "c_region"),
            _flat_supports(q),
        )
        for q in _SUPPORT_QUERIES
    },
    "flat": (
        tuple(f"flat_{q.lower()}" for q in _SUPPORT_QUERIES),
        " UNION ALL ".join(f"SELECT * FROM flat_{q.lower()}" for q in _SUPPORT_QUERIES),
    ),
    "listed": (("flat",), "SELECT DISTINCT qname, answer_id, answervalue FROM flat"),
    "tuples": (
        ("flat",),
        "SELECT qname, answervalue, comp, rel AS relation, pk, COUNT(*) AS cnt FROM flat "
        "GROUP BY ALL",
    ),
    "rho": (
        ("tuples", "flat"),
        "SELECT qname, answervalue, relation, pk, cnt, parts - 1 + CASE WHEN cnt < part_sets "
        "THEN 1 ELSE 0 END AS gamma FROM tuples "
        "JOIN (SELECT qname, answervalue, comp, COUNT(DISTINCT support_id) AS part_sets FROM flat "
        "GROUP BY ALL) USING (qname, answervalue, comp) "
        "JOIN (SELECT qname, answervalue, COUNT(DISTINCT comp) AS parts FROM flat GROUP BY ALL) "
        "USING (qname, answervalue)",
    ),
    "sizes": (
        ("tuples",),
        "SELECT qname, answervalue, COUNT(*) AS n FROM tuples GROUP BY ALL",
    ),
    "bits": (
        ("tuples", "sizes"),
        "SELECT qname, answervalue, relation, pk, n, ROW_NUMBER() OVER (PARTITION BY qname, "
        "answervalue ORDER BY relation, pk) - 1 AS bit FROM tuples JOIN sizes "
        "USING (qname, answervalue) WHERE n <= 14",
    ),
    "masks": (
        ("bits", "flat"),
        "SELECT DISTINCT qname, answervalue, mask FROM (SELECT f.qname, f.answervalue, support_id, "
        "CAST(SUM(1::BIGINT << bit) AS BIGINT) AS mask FROM flat f JOIN bits b ON "
        "f.qname = b.qname AND f.answervalue = b.answervalue AND f.rel = b.relation "
        "AND f.pk = b.pk GROUP BY ALL)",
    ),
    "games": (
        ("masks", "sizes"),
        "SELECT qname, answervalue, n, LIST(mask) AS masks FROM masks JOIN sizes "
        "USING (qname, answervalue) GROUP BY ALL",
    ),
    "coalitions": (
        ("games",),
        "SELECT * FROM (SELECT *, UNNEST(range(0, 1::BIGINT << n)) AS c FROM games) "
        "WHERE len(list_filter(masks, lambda m: (m & c) = 0)) > 0",
    ),
    "phi_exact": (
        ("coalitions", "bits"),
        "SELECT qname, answervalue, relation, pk, SUM(CASE WHEN c IS NOT NULL AND "
        "len(list_filter(masks, lambda m: (m & (c | (1::BIGINT << bit))) = 0)) = 0 THEN "
        "(factorial(bit_count(c)::INTEGER) * factorial((b.n - bit_count(c) - 1)::INTEGER))::DOUBLE "
        "/ factorial(b.n::INTEGER)::DOUBLE ELSE 0 END) AS phi "
        "FROM bits b LEFT JOIN coalitions x USING (qname, answervalue) "
        "WHERE c IS NULL OR (c & (1::BIGINT << bit)) = 0 GROUP BY ALL",
    ),
    "arrivals": (
        ("tuples", "sizes"),
        "SELECT qname, answervalue, relation, pk, sample, " + _value("sample") + " AS arrival FROM "
        "(SELECT *, UNNEST(range(1, " + str(SAMPLES + 1) + ")) AS sample FROM (SELECT *, "
        + _words("qname || '|' || answervalue || '|' || relation || '#' || pk")
        + " FROM tuples JOIN sizes USING (qname, answervalue) WHERE n > 14))",
    ),
    "pivots": (
        ("arrivals", "flat"),
        "SELECT qname, answervalue, sample, MAX(met) AS arrival FROM (SELECT f.qname, f.answervalue, "
        "sample, support_id, MIN(arrival) AS met FROM flat f JOIN arrivals a ON f.qname = a.qname AND "
        "f.answervalue = a.answervalue AND f.rel = a.relation AND f.pk = a.pk GROUP BY ALL) "
        "GROUP BY ALL",
    ),
    "phi_sampled": (
        ("arrivals", "pivots"),
        "SELECT a.qname, a.answervalue, relation, pk, COUNT(p.sample) / CAST("
        + str(SAMPLES)
        + " AS DOUBLE) AS phi FROM arrivals a LEFT JOIN pivots p ON p.qname = a.qname AND "
        "p.answervalue = a.answervalue AND p.sample = a.sample AND p.arrival = a.arrival GROUP BY ALL",
    ),
    # Stars of the forests of Q1 to Q3 (a centre and its leaves; Q1 has leaves alone), and the number of
    # coalitions by size that meet every support of all stars but one, by multiplying polynomials.
    "forest": (
        ("flat",),
        "SELECT qname, answervalue, "
        "MAX(CASE WHEN (qname, rel) IN (('Q3', 'nation')) THEN rel || '#' || pk END) AS root, "
        "MAX(CASE WHEN (qname, rel) IN (('Q2', 'orders'), ('Q3', 'customer')) THEN rel || '#' || pk END) AS centre, "
        "MAX(CASE WHEN (qname, rel) IN (('Q1', 'orders'), ('Q2', 'lineitem'), ('Q3', 'orders')) "
        "THEN rel || '#' || pk END) AS leaf "
        "FROM flat WHERE qname IN ('Q1', 'Q2', 'Q3') GROUP BY qname, answervalue, support_id",
    ),
    "stars": (
        ("forest",),
        "SELECT *, ROW_NUMBER() OVER (PARTITION BY qname, answervalue ORDER BY centre) AS i FROM ("
        "SELECT qname, answervalue, centre, COUNT(*) AS k, "
        "list_transform(range(0, COUNT(*) + 2), lambda j: CASE WHEN j = COUNT(*) THEN 1 ELSE 0 END + "
        "CASE WHEN j = 0 THEN 0 ELSE round(exp(lgamma(COUNT(*) + 1) - lgamma(j) - lgamma(COUNT(*) - j + 2))) END) "
        "AS held FROM forest WHERE qname <> 'Q1' GROUP BY qname, answervalue, centre)",
    ),
    "rest": (
        ("stars", "sizes"),
        "SELECT qname, answervalue, k, n, 0::BIGINT AS i, MIN(i) AS skipped, [1::DOUBLE] AS held "
        "FROM stars JOIN sizes USING (qname, answervalue) GROUP BY qname, answervalue, k, n "
        "UNION ALL SELECT r.qname, r.answervalue, r.k, r.n, s.i, skipped, CASE WHEN s.i = skipped THEN r.held ELSE "
        + _product("r.held", "s.held")
        + " END FROM rest r JOIN stars s ON s.qname = r.qname AND s.answervalue = r.answervalue AND s.i = r.i + 1",
    ),
    "others": (
        ("rest",),
        "SELECT * FROM rest QUALIFY i = MAX(i) OVER (PARTITION BY qname, answervalue)",
    ),
    "star_phi": (
        ("others",),
        "SELECT qname, answervalue, k, n, "
        + _chance(_product("held", "list_transform(range(0, k), lambda j: round(exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1))))"))
        + " AS centre_phi, "
        + _chance("list_concat(list_transform(range(0, k - 1), lambda j: 0::DOUBLE), held)")
        + " AS leaf_phi FROM others",
    ),
    "root_phi": (
        ("others", "stars"),
        "SELECT qname, answervalue, "
        + _chance(
            "list_transform(range(0, n), lambda j: exp(lgamma(n) - lgamma(j + 1) - lgamma(n - j)) - "
            "coalesce(everything[j + 1], 0))"
        )
        + " AS phi FROM (SELECT o.qname, o.answervalue, n, "
        + _product("o.held", "s.held")
        + " AS everything FROM others o JOIN stars s ON s.qname = o.qname AND s.answervalue = o.answervalue "
        "AND s.i = o.skipped WHERE o.qname = 'Q3' AND s.i = 1)",
    ),
    "phi_closed": (
        ("star_phi", "root_phi", "stars", "forest", "sizes"),
        "SELECT qname, answervalue, string_split(t, '#')[1] AS relation, string_split(t, '#')[2] AS pk, phi FROM ("
        "SELECT qname, answervalue, leaf AS t, 1.0::DOUBLE / n AS phi FROM forest JOIN sizes USING (qname, answervalue) "
        "WHERE qname = 'Q1' "
        "UNION ALL SELECT f.qname, f.answervalue, leaf, leaf_phi FROM forest f JOIN stars s ON s.qname = f.qname "
        "AND s.answervalue = f.answervalue AND s.centre = f.centre JOIN star_phi p ON p.qname = f.qname "
        "AND p.answervalue = f.answervalue AND p.k = s.k "
        "UNION ALL SELECT qname, answervalue, centre, centre_phi FROM stars JOIN star_phi USING (qname, answervalue, k) "
        "UNION ALL SELECT DISTINCT qname, answervalue, root, phi FROM forest JOIN root_phi USING (qname, answervalue))",
    ),
    "weights": (
        ("rho", "phi_exact", "phi_sampled", "phi_closed"),
        "SELECT qname, answervalue, relation, pk, cnt, 1.0::DOUBLE / (1 + gamma) AS rho, phi FROM "
        "rho JOIN (SELECT * FROM phi_exact WHERE qname IN ('Q4', 'Q5') UNION ALL SELECT * FROM phi_sampled "
        "WHERE qname IN ('Q4', 'Q5') UNION ALL SELECT * FROM phi_closed) "
        "USING (qname, answervalue, relation, pk)",
    ),
    "sums": (
        ("weights", "wide"),
        "SELECT db_id, qname, answervalue, "
        + ", ".join(
            f"SUM({w} * {m}) AS icqa_{agg}_{m}"
            for agg, w in (("prov", "cnt"), ("resp", "rho"), ("shap", "phi"))
            for m in ("cbm", "cim", "pim", "rim")
        )
        + " FROM weights JOIN wide USING (relation, pk) GROUP BY ALL",
    ),
}


def _score_columns(aggregations: tuple[str, ...], fill: bool) -> str:
    columns = []
    for agg in aggregations:
        for m in ("cbm", "cim", "pim", "rim"):
            name = f"icqa_{agg}_{m}"
            columns.append(f"ROUND({f'COALESCE({name}, 0)' if fill else name}, 6) AS {name}")
    return ", ".join(columns)


def _scores(aggregations: tuple[str, ...], fill: bool = True, where: str = "TRUE") -> str:
    return (
        "SELECT scale, subset, ratio, seed, qname, answer_id, answervalue, "
        + _score_columns(aggregations, fill)
        + ", icqa_prov_cbm IS NOT NULL AS measured FROM listed JOIN scen ON TRUE "
        f"LEFT JOIN sums USING (db_id, qname, answervalue) WHERE {where}"
    )


def statement(uses: tuple[str, ...], select: str) -> str:
    """``select`` preceded by every subquery it depends on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in _PARTS[name][0]:
                visit(needed)
            ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return select
    parts = ", ".join(
        f"{name} AS {'MATERIALIZED ' if name in _MATERIALIZED else ''}({_PARTS[name][1]})"
        for name in ordered
    )
    return f"WITH RECURSIVE {parts} {select}" if "rest" in ordered else f"WITH {parts} {select}"


_CHECKS = """
SELECT "constraint", violations, CASE WHEN violations = 0 THEN 'OK' ELSE 'VIOLATED' END AS status
FROM (
  SELECT 'DC1_receipt_before_ship' AS "constraint", COUNT(*) AS violations
  FROM {lineitem} WHERE l_receiptdate < l_shipdate
  UNION ALL SELECT 'DC2_commit_before_orderdate', COUNT(*) FROM c_orders JOIN {lineitem}
  ON l_orderkey = o_orderkey WHERE l_commitdate < o_orderdate
  UNION ALL SELECT 'DC3_order_F_but_line_not_F', COUNT(*) FROM c_orders JOIN {lineitem}
  ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linestatus <> 'F'
  UNION ALL SELECT 'DC4_customer_region_chain_invalid', COUNT(*) FROM c_customer JOIN c_nation
  ON c_nationkey = n_nationkey JOIN c_region ON n_regionkey = r_regionkey WHERE r_regionkey < 0
  UNION ALL SELECT 'DC5_negative_partsupp_availqty', COUNT(*) FROM {lineitem} JOIN {partsupp}
  ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE ps_availqty < 0
)
"""
# The same checks for every scenario at once.
_CHECKS_SWEEP = """
SELECT scen.db_id, "constraint", COALESCE(n, 0) AS violations,
  CASE WHEN COALESCE(n, 0) = 0 THEN 'OK' ELSE 'VIOLATED' END AS status
FROM scen CROSS JOIN (VALUES ('DC1_receipt_before_ship'), ('DC2_commit_before_orderdate'), ('DC3_order_F_but_line_not_F'),
  ('DC4_customer_region_chain_invalid'), ('DC5_negative_partsupp_availqty')) AS named("constraint")
LEFT JOIN (
  SELECT db_id, 'DC1_receipt_before_ship' AS "constraint", COUNT(*) AS n
  FROM v_lineitem WHERE l_receiptdate < l_shipdate GROUP BY db_id
  UNION ALL SELECT db_id, 'DC2_commit_before_orderdate', COUNT(*) FROM c_orders JOIN v_lineitem
  ON l_orderkey = o_orderkey WHERE l_commitdate < o_orderdate GROUP BY db_id
  UNION ALL SELECT db_id, 'DC3_order_F_but_line_not_F', COUNT(*) FROM c_orders JOIN v_lineitem
  ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linestatus <> 'F' GROUP BY db_id
  UNION ALL SELECT s.db_id, 'DC4_customer_region_chain_invalid', COUNT(*) FROM scen s, c_customer JOIN c_nation
  ON c_nationkey = n_nationkey JOIN c_region ON n_regionkey = r_regionkey WHERE r_regionkey < 0 GROUP BY s.db_id
  UNION ALL SELECT l.db_id, 'DC5_negative_partsupp_availqty', COUNT(*) FROM v_lineitem l JOIN v_partsupp p
  ON l.db_id = p.db_id AND l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE ps_availqty < 0 GROUP BY l.db_id
) found USING (db_id, "constraint")
"""
# By definition: the connected parts of each supplier's family, then the least number of orders of a part
# that meets all of its sets, over all choices of orders.
_LEAST_SETS = """
SELECT l_suppkey, SUM(n_sets)::BIGINT AS n_sets, SUM(n_nodes)::BIGINT AS n_nodes, SUM(least)::BIGINT AS hitting_low,
  SUM(least)::BIGINT AS hitting_high, 'OPTIMAL' AS status
FROM (
  WITH RECURSIVE pairs AS (SELECT DISTINCT l_suppkey, l_shipdate, l_orderkey FROM c_lineitem),
  members AS MATERIALIZED (
    SELECT * FROM pairs QUALIFY COUNT(*) OVER (PARTITION BY l_suppkey, l_shipdate) > 1
  ), reach(l_suppkey, o, p) AS (
    SELECT DISTINCT l_suppkey, l_orderkey, l_orderkey FROM members
    UNION
    SELECT r.l_suppkey, r.o, b.l_orderkey FROM reach r
    JOIN members a ON a.l_suppkey = r.l_suppkey AND a.l_orderkey = r.p
    JOIN members b ON b.l_suppkey = a.l_suppkey AND b.l_shipdate = a.l_shipdate
  ), rooted AS (SELECT l_suppkey, o, MIN(p) AS root FROM reach GROUP BY l_suppkey, o
  ), bits AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey, root ORDER BY o) - 1 AS bit FROM rooted
  ), masks AS (
    SELECT m.l_suppkey, root, l_shipdate, SUM(1::BIGINT << bit)::BIGINT AS mask
    FROM members m JOIN bits b ON b.l_suppkey = m.l_suppkey AND b.o = m.l_orderkey GROUP BY ALL
  ), games AS (
    SELECT l_suppkey, root, LIST(mask) AS masks, COUNT(*) AS n_sets, ANY_VALUE(n) AS n_nodes
    FROM masks JOIN (SELECT l_suppkey, root, COUNT(*) AS n FROM bits GROUP BY ALL) USING (l_suppkey, root) GROUP BY ALL
  )
  SELECT l_suppkey, n_sets, n_nodes, (
    SELECT MIN(bit_count(c)) FROM range(1::BIGINT << n_nodes) AS t(c)
    WHERE len(list_filter(masks, lambda m: (m & c) = 0)) = 0) AS least
  FROM games
) GROUP BY l_suppkey
"""
_CHECK_USES = ("c_lineitem", "c_orders", "c_customer", "c_nation", "c_region", "c_partsupp")
_LAST = f"'{SCALE}/subsetB/20pct/seed02'"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    def add(name: str, uses: tuple[str, ...], select: str) -> None:
        sql[name] = statement(uses, select)

    for rel in (
        "region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem",
    ):
        add(f"typed_{rel}", (f"c_{rel}",), f"SELECT * FROM c_{rel}")
        add(f"load_tbl_{rel}", (f"c_{rel}",), f"SELECT * FROM c_{rel}")
    clean = _CHECKS.format(lineitem="c_lineitem", partsupp="c_partsupp")
    dirty = _CHECKS.format(
        lineitem=f"(SELECT * FROM v_lineitem WHERE db_id = {_LAST}) li",
        partsupp=f"(SELECT * FROM v_partsupp WHERE db_id = {_LAST}) ps",
    )
    verdict = (
        "SELECT bool_and(violations = 0) AS all_ok, "
        "COUNT(*) FILTER (violations > 0) AS violated_constraints FROM ({}) checks"
    )
    add("check_constraints", _CHECK_USES, clean)
    add("check_all_ok", _CHECK_USES, verdict.format(clean))
    violated_uses = (*_CHECK_USES, "v_lineitem", "v_partsupp")
    add("check_constraints_violated", violated_uses, dirty)
    add("check_all_ok_violated", violated_uses, verdict.format(dirty))
    each = " UNION ALL ".join(
        f"SELECT {db_id} AS db_id, * FROM ("
        + _CHECKS.format(
            lineitem=f"(SELECT * FROM v_lineitem WHERE db_id = {db_id}) li",
            partsupp=f"(SELECT * FROM v_partsupp WHERE db_id = {db_id}) ps",
        )
        + ") checks"
        for db_id in (
            f"'{SCALE}/{subset}/{tag}/seed{seed:02d}'" for subset, _, tag, seed in SCENARIOS
        )
    )
    add("check_constraints_scenarios", violated_uses, each)
    add(
        "check_all_ok_scenarios", violated_uses,
        f"SELECT db_id, bool_and(violations = 0) AS all_ok, "
        f"COUNT(*) FILTER (violations > 0) AS violated_constraints FROM ({each}) GROUP BY db_id",
    )
    add(
        "mis_dc3_raw",
        (),
        "SELECT o_orderkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, COUNT(*) AS sets "
        "FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
        "WHERE o_orderstatus = 'F' AND l_linestatus <> 'F' GROUP BY ALL",
    )

    add("injection_targets", ("targets",), "SELECT * FROM targets")
    add("candidates_dc4", ("candidates_dc4",), "SELECT * FROM candidates_dc4")
    for i in (1, 2, 3):
        add(
            f"sample_dc{i}", ("picked",),
            f"SELECT db_id, k1 AS l_orderkey, k2 AS l_linenumber FROM picked WHERE dc = 'DC{i}'",
        )
    add(
        "sample_dc4", ("picked",),
        "SELECT db_id, k1 AS ps_partkey, k2 AS ps_suppkey FROM picked WHERE dc = 'DC4'",
    )
    for i, column in ((1, "l_receiptdate"), (2, "l_commitdate"), (3, "l_linestatus")):
        add(
            f"inject_dc{i}", ("picked", "v_lineitem"),
            f"SELECT db_id, l_orderkey, l_linenumber, {column} AS new_{column[2:]} FROM v_lineitem "
            f"JOIN (SELECT db_id, k1 AS l_orderkey, k2 AS l_linenumber FROM picked "
            f"WHERE dc = 'DC{i}') USING (db_id, l_orderkey, l_linenumber)",
        )
    add(
        "inject_dc4", ("picked", "v_partsupp"),
        "SELECT db_id, ps_partkey, ps_suppkey, ps_availqty AS new_availqty FROM v_partsupp "
        "JOIN (SELECT db_id, k1 AS ps_partkey, k2 AS ps_suppkey FROM picked WHERE dc = 'DC4') "
        "USING (db_id, ps_partkey, ps_suppkey)",
    )
    add(
        "injection_log", ("targets", "picked"),
        "SELECT db_id, dc, requested, applied FROM targets JOIN (SELECT db_id, dc, "
        "COUNT(*) AS applied FROM picked GROUP BY ALL) USING (db_id, dc)",
    )
    add("violated_lineitem", ("v_lineitem",), "SELECT * FROM v_lineitem")
    add("violated_partsupp", ("v_partsupp",), "SELECT * FROM v_partsupp")

    member = "SELECT db_id, dc, mis_id, relation, pk FROM mis"
    for i in (1, 2, 3, 4):
        add(
            f"mis_dc{i}", (f"mis_dc{i}",),
            f"SELECT db_id, dc, mis_id, t.relation AS relation, t.pk AS pk FROM mis_dc{i}",
        )
    for name in ("mis_all", "mis_membership", "mis_json_roundtrip", "mis_jsonl_roundtrip"):
        add(name, ("mis",), member)
    add(
        "mis_export_shape", ("mis",),
        "SELECT db_id, dc, relation AS \"table\", COUNT(*) AS tuples, "
        "COUNT(DISTINCT pk) AS distinct_keys FROM mis GROUP BY ALL",
    )
    add(
        "mis_counts", ("mis",),
        "SELECT db_id, dc, COUNT(DISTINCT mis_id) AS mis FROM mis GROUP BY ALL",
    )
    add(
        "hypergraph_stats", ("gamma",),
        "SELECT DISTINCT db_id, dc, n_sets, n_nodes FROM gamma",
    )
    for name in ("gamma_details", "gamma_general"):
        add(name, ("gamma",), "SELECT db_id, dc, relation, pk, gamma, n_edges, n_nodes FROM gamma")
    add(
        "rim_by_dc", ("rim_dc",),
        "SELECT db_id, dc, relation, pk, ROUND(rim, 6) AS rim FROM rim_dc",
    )
    for m in ("cbm", "cim", "pim", "rim"):
        add(
            f"measure_{m}", ("wide",),
            f"SELECT db_id, relation, pk, ROUND({m}, 6) AS value FROM wide",
        )
    rounded = (
        "SELECT scale, subset, ratio, seed, db_id, relation, pk, measure, "
        "ROUND(value, 6) AS value FROM long"
    )
    add("tuple_measures", ("long",), rounded)
    add(
        "measures_normalised", ("long",),
        "SELECT scale, subset, ratio, seed, relation, pk, measure, ROUND(value, 6) AS value "
        "FROM long",
    )
    add(
        "tuple_measures_selected", ("mis", "pim_weights", "cim_weights", "scen"),
        "SELECT scale, subset, ratio, seed, db_id, relation, pk, measure, ROUND(value, 6) AS value "
        "FROM (SELECT db_id, relation, pk, UNNEST(['CIM', 'PIM']) AS measure, "
        "UNNEST([SUM(cim_w), SUM(pim_w)]) AS value FROM mis "
        "JOIN cim_weights USING (dc, relation) JOIN pim_weights USING (dc) "
        "WHERE dc IN ('DC1', 'DC4') AND db_id IN (SELECT db_id FROM scen ORDER BY db_id LIMIT 3) "
        "GROUP BY db_id, relation, pk) JOIN scen USING (db_id)",
    )
    add(
        "measure_nonzero", ("long",),
        "SELECT db_id, measure, COUNT(*) AS nonzero FROM long GROUP BY ALL",
    )
    add(
        "scenario_index", ("mis", "scen"),
        "SELECT DISTINCT scale, subset, ratio, seed, db_id, regexp_replace(scale, '^sf', '') "
        "AS scale_norm, regexp_replace(seed, '^seed', '') AS seed_norm FROM mis "
        "JOIN scen USING (db_id)",
    )
    add(
        "scenario_discovery", ("mis", "scen"),
        "SELECT DISTINCT scale, subset, ratio, seed, db_id FROM mis JOIN scen USING (db_id)",
    )
    add(
        "pending_after_failure", ("long", "scen"),
        "SELECT db_id, seed_value = 1 AS finished, CASE WHEN seed_value = 1 THEN COUNT(value) END AS n_rows "
        "FROM scen LEFT JOIN (SELECT db_id, value FROM long WHERE relation = 'partsupp') USING (db_id) "
        "GROUP BY db_id, seed_value",
    )
    add(
        "gamma_bounds", ("c_lineitem",),
        _LEAST_SETS,
    )
    swept = [
        (
            "injection_log_sweep", ("targets", "picked"),
            "SELECT db_id, dc, requested, applied FROM targets JOIN (SELECT db_id, dc, "
            "COUNT(*) AS applied FROM picked GROUP BY ALL) USING (db_id, dc)",
        ),
        (
            "check_constraints_sweep", ("v_lineitem", "v_partsupp", "c_orders", "c_customer", "c_nation", "c_region", "scen"),
            _CHECKS_SWEEP,
        ),
        (
            "scenario_sweep", ("wide",),
            "SELECT db_id, relation, COUNT(*) AS tuples, "
            + ", ".join(f"ROUND(SUM({m}), 6) AS {m}" for m in ("cbm", "cim", "pim", "rim"))
            + " FROM wide GROUP BY db_id, relation",
        ),
    ]
    for name, uses, select in swept:
        add(name, uses, select)
        sql[name] = sql[name].replace(_SCENARIO_ROWS, _scenario_rows(SWEEP))
    add(
        "pending_scenarios", ("scen", "targets"),
        "SELECT DISTINCT db_id FROM targets JOIN scen USING (db_id) WHERE subset = 'subsetB'",
    )

    for q in _SUPPORT_QUERIES:
        low = q.lower()
        add(
            f"support_{low}", (f"flat_{low}",),
            f"SELECT * EXCLUDE (comp) FROM flat_{low}",
        )
        add(
            f"answers_{low}", (f"flat_{low}",),
            f"SELECT DISTINCT qname, answer_id, answervalue FROM flat_{low}",
        )
    add(
        "support_merged", ("flat", "scen"),
        "SELECT scale, subset, ratio, seed, f.* EXCLUDE (comp) FROM flat f JOIN scen ON TRUE",
    )
    add(
        "support_reading_order", ("flat",),
        "SELECT f.* EXCLUDE (comp), ROW_NUMBER() OVER (PARTITION BY qname ORDER BY answer_id, support_id, rel, "
        "key1, key2) AS position FROM flat f",
    )
    add(
        "support_size", ("sizes",),
        "SELECT qname, answervalue, n AS support_size FROM sizes",
    )
    add(
        "support_stats", ("flat",),
        "SELECT qname, COUNT(DISTINCT answervalue) AS answers, "
        "COUNT(DISTINCT answervalue || '|' || support_id) AS supports, "
        "COUNT(DISTINCT answervalue || '|' || rel || '#' || pk) AS tuples FROM flat GROUP BY ALL",
    )
    add(
        "resp_weights", ("rho",),
        "SELECT qname, answervalue, relation, pk, cnt, gamma, "
        "ROUND(1.0::DOUBLE / (1 + gamma), 6) AS rho FROM rho",
    )
    add(
        "shapley_exact", ("phi_exact",),
        "SELECT qname, answervalue, relation, pk, ROUND(phi, 6) AS phi FROM phi_exact",
    )
    add(
        "shapley_closed", ("phi_closed",),
        "SELECT qname, answervalue, relation, pk, ROUND(phi, 6) AS phi FROM phi_closed",
    )
    add(
        "shapley_mc", ("phi_sampled",),
        "SELECT qname, answervalue, relation, pk, ROUND(phi, 6) AS phi FROM phi_sampled",
    )
    add("icqa_prov", ("listed", "scen", "sums"), _scores(("prov",)))
    add("icqa_resp", ("listed", "scen", "sums"), _scores(("resp",)))
    add("icqa_shap", ("listed", "scen", "sums"), _scores(("shap",)))
    for name in ("icqa_all", "icqa_all_from_stored", "icqa_stored"):
        add(name, ("listed", "scen", "sums"), _scores(("prov", "resp", "shap")))
    add(
        "icqa_prov_stored", ("listed", "scen", "sums"),
        _scores(
            ("prov",),
            fill=False,
            where="icqa_prov_cbm IS NOT NULL OR (db_id, qname) NOT IN "
            "(SELECT (db_id, qname) FROM sums)",
        ),
    )
    add(
        "icqa_shap_measured", ("listed", "scen", "sums"),
        _scores(("shap",), where="icqa_prov_cbm IS NOT NULL"),
    )
    add(
        "icqa_from_stored", ("listed", "scen", "sums"),
        "SELECT scale, subset, ratio, seed, qname, answer_id, answervalue, "
        + _score_columns(("prov",), True)
        + " FROM listed JOIN scen ON TRUE JOIN sums USING (db_id, qname, answervalue)",
    )
    add(
        "shap_tasks", ("listed", "scen", "sums"),
        "SELECT scale, subset, ratio, seed, qname, answer_id FROM listed JOIN scen ON TRUE "
        "JOIN sums USING (db_id, qname, answervalue)",
    )
    return sql
