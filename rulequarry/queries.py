"""The engine's queries over the test tables, and SQL that computes the same without the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.catalog import Catalog, ForeignKey, star
from rulequarry.functions import text
from rulequarry.functions.relations import parse_dependency
from rulequarry.operators import audit, evidence, joinability, miner, triple_rules, triples
from rulequarry.operators.lattice import Graph, Names, candidates, edges, foreign_key_pairs, horn_splits
from rulequarry.plans.conjunctive import Planner, Query
from rulequarry.sources import rdf

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MINED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SMALL_STAR = ("region", "nation", "customer", "supplier", "orders")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("n").cast("long").alias(name))


def _planner(spark: SparkSession, sf_dir: str, *names: str) -> Planner:
    return Planner(star(spark, sf_dir, names))


def _metrics(spark: SparkSession, planner: Planner, rules: dict[str, str], disjoint: bool = False) -> DataFrame:
    """(rule, support, predictions, confidence): three scalar counts a rule, planned as one job."""
    parts = []
    for name, display in rules.items():
        s, p = (planner.count(q) for q in audit.evaluation_queries(parse_dependency(display), disjoint))
        parts.append(s.withColumnRenamed("n", "support").crossJoin(p.withColumnRenamed("n", "predictions")).select(F.lit(name).alias("rule"), "support", "predictions"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("confidence", F.round(F.when(F.col("predictions") > 0, F.col("support") / F.col("predictions")).otherwise(0.0), 12))


FK_RULES = {
    "nation": "nation_0(n_regionkey=x) ⇒ region_0(r_regionkey=x)",
    "orders": "orders_0(o_orderkey=x) ⇒ lineitem_0(l_orderkey=x)",
    "labels": "documents_0(doc_id=x) ⇒ labels_0(doc_id=x)",
    "customer": "customer_0(c_custkey=x) ⇒ orders_0(o_custkey=x)",
}


def _metrics_sql(*rules: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, s AS support, p AS predictions, CASE WHEN p > 0 THEN round(s / p, 12) ELSE 0 END AS confidence FROM (SELECT ({a}) AS s, ({b}) AS p)" for n, a, b in rules)


@query(
    _metrics_sql(
        ("nation", "SELECT count(DISTINCT n_regionkey) FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation)"),
        ("orders", "SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders)"),
        ("labels", "SELECT count(DISTINCT d.doc_id) FROM documents d JOIN labels l ON d.doc_id = l.doc_id", "SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents)"),
        ("customer", "SELECT count(DISTINCT c_custkey) FROM customer JOIN orders ON c_custkey = o_custkey", "SELECT count(*) FROM (SELECT DISTINCT c_custkey FROM customer)"),
    )
)
def rule_metrics_fk(spark, sf_dir):
    return _metrics(spark, _planner(spark, sf_dir, "nation", "region", "orders", "lineitem", "documents", "labels", "customer"), FK_RULES)


@query(
    _metrics_sql(
        (
            "chain",
            "SELECT count(*) FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)",
            "SELECT count(*) FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
        )
    )
)
def rule_metrics_chain3(spark, sf_dir):
    return _metrics(spark, _planner(spark, sf_dir, "orders", "lineitem", "customer"), {"chain": "orders_0(o_orderkey=x, o_custkey=y) ∧ lineitem_0(l_orderkey=x) ⇒ customer_0(c_custkey=y)"})


@query("SELECT count(DISTINCT o_orderkey) AS support FROM orders JOIN lineitem a ON o_orderkey = a.l_orderkey JOIN (SELECT DISTINCT l_suppkey FROM lineitem) b ON a.l_suppkey = b.l_suppkey")
def rule_repeated_relation(spark, sf_dir):
    q = Query((("orders", 0), ("lineitem", 0), ("lineitem", 1)), ((("orders", 0, "o_orderkey"), ("lineitem", 0, "l_orderkey")), (("lineitem", 0, "l_suppkey"), ("lineitem", 1, "l_suppkey"))), (("orders", 0, "o_orderkey"),))
    return _one(_planner(spark, sf_dir, "orders", "lineitem").count(q), "support")


@query("SELECT count(*) AS support FROM (SELECT DISTINCT a.c_nationkey FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey)")
def rule_disjoint_pk(spark, sf_dir):
    q = Query((("customer", 0), ("customer", 1)), ((("customer", 0, "c_nationkey"), ("customer", 1, "c_nationkey")),), (("customer", 0, "c_nationkey"),), True)
    return _one(_planner(spark, sf_dir, "customer").count(q), "support")


@query("SELECT CAST(0 AS BIGINT) AS support")
def rule_disjoint_no_pk(spark, sf_dir):
    q = Query((("lineitem", 0), ("lineitem", 1)), ((("lineitem", 0, "l_orderkey"), ("lineitem", 1, "l_orderkey")),), (("lineitem", 0, "l_orderkey"),), True)
    return _one(_planner(spark, sf_dir, "lineitem").count(q), "support")


@query("SELECT count(*) AS support FROM (SELECT DISTINCT a.conv_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (a.conv_id <> b.conv_id OR a.turn <> b.turn))")
def rule_disjoint_composite_pk(spark, sf_dir):
    q = Query((("conversations", 0), ("conversations", 1)), ((("conversations", 0, "conv_id"), ("conversations", 1, "conv_id")),), (("conversations", 0, "conv_id"),), True)
    return _one(_planner(spark, sf_dir, "conversations").count(q), "support")


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_row_count(spark, sf_dir):
    q = Query((("orders", 0), ("customer", 0), ("nation", 0)), ((("orders", 0, "o_custkey"), ("customer", 0, "c_custkey")), (("customer", 0, "c_nationkey"), ("nation", 0, "n_nationkey"))))
    return _one(_planner(spark, sf_dir, "orders", "customer", "nation").count(q, distinct=False), "n")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)")
def join_count_over(spark, sf_dir):
    q = Query((("orders", 0), ("customer", 0)), ((("orders", 0, "o_custkey"), ("customer", 0, "c_custkey")),), (("orders", 0, "o_custkey"), ("customer", 0, "c_nationkey")))
    return _one(_planner(spark, sf_dir, "orders", "customer").count(q), "n")


@query("SELECT threshold, CAST(n > threshold AS INTEGER) AS holds FROM (VALUES (0), (1), (24), (25), (1000)) t(threshold), (SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)")
def witness_threshold(spark, sf_dir):
    p = _planner(spark, sf_dir, "nation", "region")
    q = Query((("nation", 0), ("region", 0)), ((("nation", 0, "n_regionkey"), ("region", 0, "r_regionkey")),))
    return spark.createDataFrame([(k, int(p.exceeds(q, k))) for k in (0, 1, 24, 25, 1000)], "threshold int, holds int")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT n_nationkey FROM nation, region)")
def isolated_atom_count(spark, sf_dir):
    return _one(_planner(spark, sf_dir, "nation", "region").count(Query((("nation", 0), ("region", 0)), (), (("nation", 0, "n_nationkey"),))), "n")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT n_nationkey, r_regionkey FROM nation, region)")
def cross_join_count(spark, sf_dir):
    return _one(_planner(spark, sf_dir, "nation", "region").count(Query((("nation", 0), ("region", 0)), (), (("nation", 0, "n_nationkey"), ("region", 0, "r_regionkey")))), "n")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = l_suppkey)")
def intra_atom_selection(spark, sf_dir):
    q = Query((("lineitem", 0),), ((("lineitem", 0, "l_partkey"), ("lineitem", 0, "l_suppkey")),), (("lineitem", 0, "l_orderkey"),))
    return _one(_planner(spark, sf_dir, "lineitem").count(q), "n")


def _quirk(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    """nation and supplier imply customer: the class's smallest member is the head."""
    c = star(spark, sf_dir, ("customer", "nation", "supplier"))
    names = Names(c)
    graph = Graph(edges(names, foreign_key_pairs(c), 1))
    found = next(x for x in candidates(graph, 3, 3) if len(x.atoms) == 3)
    body, head = next((b, h) for b, h in horn_splits(found) if names.tables[h[0]] == "customer")
    queries = miner.metrics_queries(found, body, head, names, False)
    p = Planner(c)
    both, under = p.count(queries[1]), p.count(queries[which])
    return both.withColumnRenamed("n", "numerator").crossJoin(under.withColumnRenamed("n", "denominator")).withColumn("confidence", F.round(F.col("numerator") / F.col("denominator"), 12))


_QUIRK = "SELECT a AS numerator, b AS denominator, round(a / b, 12) AS confidence FROM (SELECT (SELECT count(DISTINCT n_nationkey) FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey) AS a, ({}) AS b)"


@query(_QUIRK.format("SELECT count(DISTINCT n_nationkey) FROM nation WHERE EXISTS (SELECT 1 FROM supplier)"))
def rule_confidence_star_quirk(spark, sf_dir):
    return _quirk(spark, sf_dir, 2)


@query(_QUIRK.format("SELECT count(DISTINCT n_nationkey) FROM nation JOIN supplier ON n_nationkey = s_nationkey"))
def rule_confidence_exact(spark, sf_dir):
    return _quirk(spark, sf_dir, 3)


@query("SELECT DISTINCT c_nationkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def projected_head_rows(spark, sf_dir):
    return audit.head_rows(_planner(spark, sf_dir, "customer", "nation", "orders"), parse_dependency("customer_0(c_custkey=y, c_nationkey=x) ∧ orders_0(o_custkey=y) ⇒ nation_0(n_nationkey=x)"))


@query("SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_nationkey IS NOT NULL AND n_nationkey <> 0")
def column_value_set(spark, sf_dir):
    return star(spark, sf_dir, ("nation",)).value_set("nation", "n_nationkey")


@query("SELECT CAST(c_custkey AS BIGINT) AS value FROM customer WHERE c_custkey IS NOT NULL")
def attribute_values(spark, sf_dir):
    return star(spark, sf_dir, ("customer",)).values("customer", "c_custkey")


_KEY_COLUMNS = {"customer": ("c_custkey", "c_nationkey"), "orders": ("o_custkey", "o_orderkey"), "nation": ("n_name", "n_nationkey", "n_regionkey"), "supplier": ("s_nationkey", "s_suppkey"), "events": ("event_id", "user_id")}


def _key_values(spark: SparkSession, sf_dir: str, falsy: bool = False) -> DataFrame:
    return joinability.attribute_values(star(spark, sf_dir, _KEY_COLUMNS), [(t, c) for t, cs in _KEY_COLUMNS.items() for c in cs], falsy)


def _values_sql(falsy: bool = False) -> str:
    keep = "v IS NOT NULL" if falsy else "v IS NOT NULL AND v NOT IN ('', '0')"
    return " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, v FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t}) WHERE {keep}" for t, cs in _KEY_COLUMNS.items() for c in cs)


_PAIRS = "WITH v AS ({}), s AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <= (b.t, b.c) GROUP BY ALL) SELECT ta AS table_a, ca AS column_a, tb AS table_b, cb AS column_b, shared, x.n AS size_a, y.n AS size_b{} FROM p JOIN s x ON x.t = ta AND x.c = ca JOIN s y ON y.t = tb AND y.c = cb{}"


@query(_PAIRS.format(_values_sql(), "", ""))
def joinable_overlap(spark, sf_dir):
    return joinability.overlaps(_key_values(spark, sf_dir))


@query(_PAIRS.format(_values_sql(), ", round(shared / (x.n + y.n - shared), 12) AS jaccard", ""))
def joinable_jaccard(spark, sf_dir):
    return joinability.jaccard(joinability.overlaps(_key_values(spark, sf_dir))).withColumn("jaccard", F.round("jaccard", 12))


@query(f"SELECT table_a, column_a, table_b, column_b FROM ({_PAIRS.format(_values_sql(), '', '')}) WHERE shared > 350")
def full_joinability_edges(spark, sf_dir):
    return joinability.overlaps(_key_values(spark, sf_dir)).where(F.col("shared") > joinability.OVERLAP).select("table_a", "column_a", "table_b", "column_b")


@query("SELECT * FROM (VALUES ('customer.c_custkey', 'orders.o_custkey'), ('customer.c_nationkey', 'nation.n_nationkey'), ('nation.n_nationkey', 'supplier.s_nationkey'), ('nation.n_regionkey', 'region.r_regionkey')) t(a, b)")
def fk_edges(spark, sf_dir):
    return spark.createDataFrame([tuple(".".join(x) for x in p) for p in foreign_key_pairs(star(spark, sf_dir, SMALL_STAR))], "a string, b string")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{u}' AS ref_table, '{d}' AS ref_column, (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {d} FROM {u})) AS orphans" for t, c, u, d in (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"))))
def fk_integrity(spark, sf_dir):
    return joinability.foreign_key_violations(star(spark, sf_dir, SMALL_STAR))


@query(f"WITH v AS ({_values_sql(True)}), s AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL) SELECT a.t AS table_dependant, a.c AS column_dependant, b.t AS table_referenced, b.c AS column_referenced FROM v a JOIN v b ON a.v = b.v AND (a.t <> b.t OR a.c <> b.c) JOIN s ON s.t = a.t AND s.c = a.c GROUP BY ALL HAVING count(*) = min(s.n)")
def inclusion_dependencies(spark, sf_dir):
    return joinability.inclusion_dependencies(_key_values(spark, sf_dir, True))


_STAR_COUNTS = {"region": (2, 0), "nation": (3, 1), "customer": (5, 1), "supplier": (4, 1), "orders": (6, 1)}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({c} AS BIGINT) AS n_columns, CAST({k} AS BIGINT) AS n_foreign_keys FROM {t}" for t, (c, k) in _STAR_COUNTS.items()))
def table_stats(spark, sf_dir):
    return star(spark, sf_dir, SMALL_STAR).statistics()


_NATION_TRIPLES = """SELECT 'nation_' || n_nationkey AS s, 'nation.n_name' AS p, '"' || n_name || '"' AS o FROM nation UNION ALL SELECT 'nation_' || n_nationkey, 'nation.n_regionkey', 'region_' || n_regionkey FROM nation"""


@query(_NATION_TRIPLES)
def triples_nation(spark, sf_dir):
    return triples.table_triples(star(spark, sf_dir, ("nation", "region")), "nation")


@query("""SELECT 'orders_' || o_orderkey AS s, 'orders.o_custkey' AS p, 'customer_' || o_custkey AS o FROM orders UNION ALL SELECT 'orders_' || o_orderkey, 'orders.o_orderstatus', '"' || o_orderstatus || '"' FROM orders""")
def triples_orders(spark, sf_dir):
    return triples.table_triples(star(spark, sf_dir, ("orders", "customer")), "orders").where("p IN ('orders.o_custkey', 'orders.o_orderstatus')")


@query("""SELECT 'conversations_' || conv_id || '_' || turn AS s, 'conversations.role' AS p, '"' || role || '"' AS o FROM conversations""")
def triples_composite_pk(spark, sf_dir):
    return triples.table_triples(star(spark, sf_dir, ("conversations",)), "conversations").where("p = 'conversations.role'")


@query(f"SELECT p, count(*) AS n FROM ({_NATION_TRIPLES} UNION ALL SELECT '', 'region.r_name', '' FROM region) GROUP BY p")
def triple_predicate_counts(spark, sf_dir):
    return triples.predicate_counts(triples.triples(star(spark, sf_dir, ("nation", "region"))))


_FACTS = "(SELECT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation UNION SELECT 'r' || n_regionkey, 'has', 'n' || n_nationkey FROM nation UNION SELECT 'c' || c_custkey, 'lives', 'n' || c_nationkey FROM customer UNION SELECT 'c' || c_custkey, 'region', 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts over the whole nation and customer tables, both ways between nations and regions."""
    c = star(spark, sf_dir, ("nation", "customer"))
    nation, customer = c.tables["nation"], c.tables["customer"]
    at = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    fact = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    n, r, who = name("n", "n_nationkey"), name("r", "n_regionkey"), name("c", "c_custkey")
    parts = (fact(nation, n, "in", r), fact(nation, r, "has", n), fact(customer, who, "lives", name("n", "c_nationkey")), fact(at, who, "region", r))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def _rules_sql(bodies: str, keys: str) -> str:
    return f"WITH f AS {_FACTS}, w AS (SELECT p, s AS x, o AS y FROM f UNION ALL SELECT p || '^-1', o, s FROM f), b AS ({bodies}), z AS (SELECT {keys}, count(*) AS n FROM b GROUP BY ALL), u AS (SELECT {keys}, f.p AS head, count(*) AS support FROM b JOIN f ON f.s = x AND f.o = y GROUP BY ALL), k AS (SELECT {keys}, h.p AS head, count(*) AS n FROM b JOIN (SELECT DISTINCT p, s FROM f) h ON h.s = x GROUP BY ALL), t AS (SELECT p AS head, count(*) AS n FROM f GROUP BY ALL) SELECT {keys}, head, support, round(support / t.n, 12) AS head_coverage, round(support / z.n, 12) AS std_confidence, round(support / k.n, 12) AS pca_confidence FROM u JOIN z USING ({keys}) JOIN k USING ({keys}, head) JOIN t USING (head)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 12) for c in ("head_coverage", "std_confidence", "pca_confidence")})


@query("SELECT * FROM (" + _rules_sql("SELECT DISTINCT p AS body, x, y FROM w", "body") + ") WHERE body <> head")
def triple_rule_implications(spark, sf_dir):
    return _rounded(triple_rules.implications(_facts(spark, sf_dir)))


@query(_rules_sql("SELECT DISTINCT a.p AS body_1, c.p AS body_2, a.x, c.y FROM w a JOIN w c ON a.y = c.x", "body_1, body_2"))
def triple_rule_chains(spark, sf_dir):
    return _rounded(triple_rules.chains(_facts(spark, sf_dir)))


# --- mined rules -------------------------------------------------------------------------------------------------


#: The key columns of the mined tables in the tables' own order, each with what it refers to.
_KEYS_OF = {
    "customer": {"c_custkey": "", "c_nationkey": "nation.n_nationkey"},
    "events": {"event_id": "", "user_id": "customer.c_custkey"},
    "lineitem": {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
    "nation": {"n_nationkey": "", "n_regionkey": "region.r_regionkey"},
    "orders": {"o_orderkey": "", "o_custkey": "customer.c_custkey"},
    "part": {"p_partkey": ""},
    "region": {"r_regionkey": ""},
    "supplier": {"s_suppkey": "", "s_nationkey": "nation.n_nationkey"},
}
_PRIMARY = {t: next((c for c, to in cs.items() if not to), None) for t, cs in _KEYS_OF.items()}


def _mined_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The whole star tables; the miner reads their joinable columns and keys."""
    return star(spark, sf_dir, MINED)


def _plain_patterns(occurrences: int, atoms: int, variables: int) -> dict[frozenset, list]:
    """Equality classes over uses of columns, each with its lexicographically first list of edges.

    Plain enumeration, apart from the engine's lattice: every list of edges, in order, whose every beginning is
    connected, numbers the uses of a table from 0 and joins two classes. A use is (table, use, position, column).
    """
    use = lambda t, k, c: (t, k, list(_KEYS_OF[t]).index(c), c)
    links = sorted(
        tuple(sorted((use(t, i, c), use(*to.split(".")[:1], j, to.split(".")[1])))) for t, cs in _KEYS_OF.items() for c, to in cs.items() if to for i in range(occurrences) for j in range(occurrences)
    )
    found: dict[frozenset, list] = {}

    def grow(edges: list, classes: list[set]) -> None:
        used = {u[:2] for c in classes for u in c}
        for link in links:
            if edges and not {u[:2] for u in link} & used:
                continue
            touched = [c for c in classes if c & set(link)]
            if any(set(link) <= c for c in touched):
                continue
            merged = [c for c in classes if c not in touched] + [set(link).union(*touched)]
            now = used | {u[:2] for u in link}
            gaps = any((t, k - 1) not in now for t, k in now if k)
            if gaps or len(now) > atoms or len(merged) > variables:
                continue
            found.setdefault(frozenset(map(frozenset, merged)), [*edges, link])
            grow([*edges, link], merged)

    grow([], [])
    return found


def _plain_text(classes: list[list], edges: list, head: tuple) -> str:
    """A rule as text: variables of both sides are x, of the body y, of the head z; uses in the order of the edges."""
    named, totals = {}, {"x": 0, "y": 0, "z": 0}
    for c in classes:
        sides = {u[:2] == head for u in c}
        kind = "x" if len(sides) == 2 else "z" if True in sides else "y"
        named |= {u: f"{kind}{totals[kind]}" for u in c}
        totals[kind] += 1
    args: dict[tuple, list[str]] = {}
    for u in (u for e in edges for u in e):
        own = args.setdefault(u[:2], [])
        if (x := f"{u[3]}={named[u]}") not in own:
            own.append(x)
    text = {a: f"{a[0]}_{a[1]}({', '.join(own)})" for a, own in args.items()}
    return f"∀ {', '.join(sorted({v for u, v in named.items() if u[:2] != head}))}: {' ∧ '.join(x for a, x in text.items() if a != head)} ⇒ {text[head]}"


def _plain_count(atoms: list[tuple], joins: list[tuple], project: list[tuple], disjoint: bool) -> str:
    """SQL for the number of distinct projected tuples; parts that nothing links are counted apart and multiplied."""
    apart = [(a, b) for i, a in enumerate(atoms) for b in atoms[i + 1 :] if disjoint and a[0] == b[0]]
    groups = [{a} for a in atoms]
    for a, b in [(x[:2], y[:2]) for x, y in joins] + apart:
        one, two = (next(g for g in groups if z in g) for z in (a, b))
        if one is not two:
            one |= two
            groups.remove(two)
    alias = lambda a: f"{a[0]}_{a[1]}"
    parts = []
    for g in groups:
        where = [f"{alias(x)}.{x[3]} = {alias(y)}.{y[3]}" for x, y in joins if x[:2] in g]
        where += [f"{alias(a)}.{_PRIMARY[a[0]]} <> {alias(b)}.{_PRIMARY[b[0]]}" if _PRIMARY[a[0]] else "FALSE" for a, b in apart if a in g]
        rows = f"FROM {', '.join(f'k_{a[0]} AS {alias(a)}' for a in sorted(g))} WHERE {' AND '.join(where) or 'TRUE'}"
        own = [f"{alias(u)}.{u[3]}" for u in project if u[:2] in g]
        parts.append(f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(own)} {rows}))" if own else f"(SELECT CAST(EXISTS (SELECT 1 {rows}) AS BIGINT))")
    return " * ".join(parts)


def _mined_sql(occurrences: int, disjoint: bool) -> str:
    """One SELECT for each possible rule over the whole tables: plain joins of its atoms, distinct tuples counted."""
    seen: set = set()
    parts = []
    for found, edges in sorted(_plain_patterns(occurrences, 3, 3).items(), key=lambda x: x[1]):
        classes = sorted(sorted(c) for c in found)
        atoms = sorted({u[:2] for c in classes for u in c})
        columns = {a: {u[3] for c in classes for u in c if u[:2] == a} for a in atoms}
        for head in atoms:
            body = [a for a in atoms if a != head]
            if any(a[0] == head[0] and a[1] > head[1] and columns[a] == columns[head] for a in body) or any(all(u[:2] == head for u in c) for c in classes):
                continue
            swapped = lambda a, t: (a[0], 1 - a[1]) if a[0] == t else a  # noqa: E731  of two uses of a table
            again = [t for t in {a[0] for a in atoms} if (t, 1) in atoms]
            forms = {(swapped(head, t), frozenset(frozenset((*swapped(u[:2], t), u[3]) for u in c) for c in classes)) for t in [None, *again]}
            if forms & seen:
                continue
            seen |= forms
            first = [next((u for u in c if u[:2] != head), None) for c in classes]
            whole = [(c[0], u) for c in classes for u in c[1:]]
            stars = [(c[0], u) for c in classes for u in c[1:] if c[0][:2] != head and u[:2] != head]
            inner = [(f, u) for c, f in zip(classes, first, strict=True) for u in c if f and u != f and u[:2] != head]
            of_head = [next(u for u in c if u[:2] == head) for c in classes if any(u[:2] == head for u in c)]
            of_body = [u for u in first if u]
            counts = [_plain_count(atoms, whole, of_head, disjoint), _plain_count(atoms, whole, of_body, disjoint), _plain_count(body, stars, of_body, disjoint), _plain_count(body, inner, of_body, disjoint)]
            shown = _plain_text(classes, edges, head)
            parts.append(f"SELECT '{shown}' AS display, {', '.join(f'{c} AS {n}' for n, c in zip(('support', 'b', 'star', 'exact'), counts, strict=True))}")
    keys = ", ".join(f"k_{t} AS MATERIALIZED (SELECT DISTINCT {', '.join(cs)} FROM {t})" for t, cs in _KEYS_OF.items())
    return f"WITH {keys} SELECT display, support, round(b / star, 12) AS confidence, round(b / exact, 12) AS confidence_exact FROM ({' UNION ALL '.join(parts)}) WHERE support >= 1"


def _mined(spark: SparkSession, sf_dir: str, occurrences: int, disjoint: bool) -> DataFrame:
    found = miner.discover(_mined_catalog(spark, sf_dir), miner.Settings(walk_length=occurrences, disjoint_semantics=disjoint))
    return miner.rules_frame(spark, found)


def _shown(rules: DataFrame) -> DataFrame:
    return rules.select("display", "support", F.round("confidence", 12).alias("confidence"), F.round("confidence_exact", 12).alias("confidence_exact"))


@query(_mined_sql(2, False))
def mined_rules(spark, sf_dir):
    return _shown(_mined(spark, sf_dir, 2, False))


@query(_mined_sql(2, True))
def mined_rules_disjoint(spark, sf_dir):
    return _shown(_mined(spark, sf_dir, 2, True))


_RULE_ROWS = "('a_0(x=x0) ⇒ h_0(x=x0)', 'h', 5, 0.5, 1), ('b_0(x=x0) ⇒ h_0(x=x0)', 'h', 5, 1.0, 2), ('c_0(x=x0) ⇒ h_0(x=x0)', 'h', 3, 0.25, 3), ('d_0(x=x0) ⇒ g_0(x=x0)', 'g', 1, 1.0, 4), ('e_0(x=x0) ⇒ g_0(x=x0)', 'g', NULL, 0.0, 5), ('f_0(x=x0) ⇒ k_0(x=x0)', 'k', 7, 0.125, 6), ('a_0(x=x0) ⇒ h_0(x=x0)', 'h', 5, 0.5, 7)"
_RULE_TABLE = f"(SELECT display, head_relation, CAST(support AS BIGINT) AS support, CAST(confidence AS DOUBLE) AS confidence, rule_id FROM (VALUES {_RULE_ROWS}) t(display, head_relation, support, confidence, rule_id))"


def _rule_rows(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_RULE_TABLE}")


@query(f"SELECT display, head_relation, support, confidence, rule_id FROM (SELECT *, rank() OVER (PARTITION BY head_relation ORDER BY support DESC NULLS LAST) AS r FROM {_RULE_TABLE}) WHERE r = 1")
def best_per_head(spark, sf_dir):
    return miner.best_per_head(_rule_rows(spark))


@query(f"SELECT * FROM {_RULE_TABLE} ORDER BY support DESC NULLS LAST, rule_id LIMIT 5")
def top5_rules(spark, sf_dir):
    return miner.top_rules(_rule_rows(spark))


@query(f"SELECT count(*) AS horn_rules, coalesce(avg(support), 0) AS average_support, coalesce(avg(confidence), 0) AS average_confidence FROM {_RULE_TABLE}")
def rule_statistics(spark, sf_dir):
    return miner.statistics(_rule_rows(spark))


@query(f"SELECT sha256(string_agg(display || CASE WHEN support IS NULL THEN '' ELSE '|' || support END, chr(10) ORDER BY display || CASE WHEN support IS NULL THEN '' ELSE '|' || support END)) AS digest, count(*) AS n_rules FROM {_RULE_TABLE}")
def ruleset_hash(spark, sf_dir):
    return miner.rule_set_digest(_rule_rows(spark))


@query(f"SELECT display, count(*) AS n FROM {_RULE_TABLE} GROUP BY display HAVING count(*) > 1")
def duplicate_rules(spark, sf_dir):
    return miner.duplicates(_rule_rows(spark))


# --- audit -------------------------------------------------------------------------------------------------------

AUDIT_RULES = {
    "same_tuple": "customer_0(c_custkey=x, c_nationkey=y) ⇒ customer_1(c_custkey=x)",
    "pair": "customer_0(c_nationkey=x) ∧ customer_1(c_nationkey=x) ⇒ nation_0(n_nationkey=x)",
    "some_name": "nation_0(n_regionkey=x) ⇒ ∃ y: region_0(r_regionkey=x, r_name=y)",
    "supplier": "supplier_0(s_nationkey=x) ⇒ customer_0(c_nationkey=x)",
}


@query(
    _metrics_sql(
        ("pair", "SELECT count(DISTINCT a.c_nationkey) FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey JOIN nation ON a.c_nationkey = n_nationkey", "SELECT count(DISTINCT a.c_nationkey) FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey"),
        ("some_name", "SELECT count(DISTINCT n_regionkey) FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT count(DISTINCT n_regionkey) FROM nation"),
        ("supplier", "SELECT count(DISTINCT s_nationkey) FROM supplier JOIN customer ON s_nationkey = c_nationkey", "SELECT count(DISTINCT s_nationkey) FROM supplier"),
    )
)
def audit_metrics(spark, sf_dir):
    return _metrics(spark, _planner(spark, sf_dir, "customer", "nation", "region", "supplier"), {k: v for k, v in AUDIT_RULES.items() if k != "same_tuple"}, True)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star(spark, sf_dir, SMALL_STAR)
    shown = [
        ("SPIDER", AUDIT_RULES["same_tuple"]),
        ("SPIDER", "nation_0(n_regionkey=x) ⇒ region_0(r_regionkey=x)"),
        ("SPIDER", AUDIT_RULES["supplier"]),
        ("SPIDER", "not a rule"),
        ("POPPER", "nation(A,B,C):- region(C,D)."),
        ("POPPER", "head(A):-"),
        ("AMIE3", "?a nation.n_name ?b => ?a nation.n_name ?b"),
        ("SPIDER", AUDIT_RULES["some_name"]),
        ("SPIDER", "customer_0(c_custkey=x) ⇒ orders_0(o_custkey=x)"),
        ("SPIDER", "orders_0(o_custkey=x) ∧ orders_1(o_custkey=x) ⇒ customer_0(c_custkey=x)"),
        ("SPIDER", "nation_0(n_nationkey=x, n_regionkey=y) ∧ customer_0(c_nationkey=x) ⇒ region_0(r_regionkey=y)"),
    ]
    sources = [audit.Source(a, "star", i, d) for i, (a, d) in enumerate(shown)]
    targets = [parse_dependency("nation_0(n_regionkey=x) ⇒ region_0(r_regionkey=x)"), parse_dependency("orders_0(o_custkey=x) ⇒ customer_0(c_custkey=x)")]
    return audit.records_frame(spark, audit.audit(c, sources, targets))


@query()
def audit_classification(spark, sf_dir):
    return _audited(spark, sf_dir)


_RECORD_ROWS = "('A', 'd', 'k1', 0, 'comparable_true', 'comparable_exact', 'recalled_alpha', true, true, true, true), ('A', 'd', 'k1', 1, 'comparable_true', 'comparable_exact', 'unmatched', true, true, true, true), ('A', 'e', 'k2', 2, 'comparable_true', 'comparable_exact', 'recalled_subsumed', true, true, true, true), ('A', 'e', 'k3', 3, 'vacuous', 'vacuous', 'not_applicable', true, true, true, true), ('B', 'd', 'k4', 0, 'parse_failed', 'technical_exclusion', 'not_applicable', false, false, false, false), ('B', 'd', 'k5', 1, 'approximate', 'non_exact', 'not_applicable', true, true, true, true), ('B', 'd', 'k6', 2, 'out_of_scope', 'other_out_of_scope', 'not_applicable', true, true, true, false), ('B', 'd', 'k7', 3, 'comparable_true', 'comparable_exact', 'unmatched', true, true, true, true)"
_RECORD_TABLE = f"(SELECT * FROM (VALUES {_RECORD_ROWS}) t(algorithm, database, canonical_dependency, rule_index, classification, paper_category, match_status, native_parseable, relationally_translatable, evaluable, structurally_eligible))"


def _record_rows(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_RECORD_TABLE}")


def _funnel_sql() -> str:
    c = {"total": "TRUE", "parseable": "native_parseable"}
    c["translatable"] = f"{c['parseable']} AND relationally_translatable"
    c["evaluable"] = f"{c['translatable']} AND evaluable"
    c["within_scope"] = f"{c['evaluable']} AND structurally_eligible"
    c["non_vacuous"] = f"{c['within_scope']} AND paper_category <> 'vacuous'"
    c["above_threshold"] = f"{c['non_vacuous']} AND classification = 'comparable_true'"
    for n, m in (("exactly_recovered", "recalled_alpha"), ("covered_by_more_general_rule", "recalled_subsumed"), ("unmatched_above_threshold", "unmatched")):
        c[n] = f"{c['above_threshold']} AND match_status = '{m}'"
    for n, m in (("parse_failed", "parse_failed"), ("out_of_scope", "out_of_scope"), ("vacuous", "vacuous"), ("below_threshold", "approximate")):
        c[n] = f"classification = '{m}'"
    for n in ("technical_exclusion", "exact_non_horn_tgd", "other_out_of_scope"):
        c[n] = f"paper_category = '{n}'"
    parts = ", ".join(f"count(*) FILTER (WHERE algorithm = name AND {x}) AS {n}" for n, x in c.items())
    return f"SELECT name AS algorithm, {parts} FROM (VALUES ('A'), ('B'), ('C')) n(name), {_RECORD_TABLE} GROUP BY name"


@query(_funnel_sql())
def audit_funnel(spark, sf_dir):
    return audit.funnel(_record_rows(spark), ("A", "B", "C"))


@query(f"SELECT algorithm, count(*) AS total, {', '.join(f'''count(*) FILTER (WHERE paper_category = '{n}') AS {n}''' for n in audit.CATEGORIES)}, count(*) FILTER (WHERE match_status = 'recalled_alpha') AS alpha_recovered, count(*) FILTER (WHERE match_status = 'recalled_subsumed') AS covered_by_more_general_rule, count(*) FILTER (WHERE match_status = 'unmatched') AS unmatched, TRUE AS categories_add_up, TRUE AS matches_add_up FROM {_RECORD_TABLE} GROUP BY algorithm")
def audit_exclusions(spark, sf_dir):
    return audit.exclusions(_record_rows(spark))


@query(
    f"WITH r AS (SELECT *, CASE match_status WHEN 'recalled_alpha' THEN 3 WHEN 'recalled_subsumed' THEN 2 WHEN 'covered_on_instance' THEN 1 ELSE 0 END AS p FROM {_RECORD_TABLE}), b AS (SELECT max(p) AS p FROM r WHERE paper_category = 'comparable_exact' GROUP BY database, canonical_dependency) "
    "SELECT (SELECT count(*) FROM r) AS audited_rules, (SELECT count(*) FROM r WHERE paper_category = 'comparable_exact') AS comparable_true_outputs, count(*) AS comparable_true, count(*) FILTER (p = 3) AS recalled_alpha, count(*) FILTER (p >= 2) AS recalled_alpha_or_subsumed, count(*) FILTER (p >= 1) AS recalled_alpha_subsumed_or_instance, count(*) FILTER (p = 0) AS unmatched, count(*) FILTER (p = 3) / count(*) AS alpha_recall, count(*) FILTER (p >= 2) / count(*) AS alpha_or_subsumed_recall, count(*) FILTER (p >= 1) / count(*) AS alpha_subsumed_or_instance_recall FROM b"
)
def audit_recall_totals(spark, sf_dir):
    return audit.totals(_record_rows(spark))


@query(f"SELECT 'algorithm' AS dimension, algorithm AS value, count(*) AS n FROM {_RECORD_TABLE} GROUP BY ALL UNION ALL SELECT 'database', database, count(*) FROM {_RECORD_TABLE} GROUP BY ALL")
def audit_counts(spark, sf_dir):
    return audit.counts_by(_record_rows(spark), "algorithm", "database")


# --- evidence ----------------------------------------------------------------------------------------------------

_RUNS = "(SELECT algorithm, database, status, CAST(rules_count AS BIGINT) AS rules_count, partial, CAST(updated_at AS TIMESTAMP) AS updated_at, priority, source_path FROM (VALUES ('own', 'dir/a.db', 'success', 4, false, '2024-01-01 00:00:00', 1, 'p1'), ('OWN', 'a', 'timeout', NULL, false, '2024-01-02 00:00:00', 0, 's1'), ('OWN', 'a', 'Success', 5, false, '2024-01-02 00:00:00', 1, 'p0'), ('OTHER', 'a', 'success', 9, NULL, '2023-01-01 00:00:00', 1, 'p2'), ('OTHER', 'b', 'partial', 1, false, '2023-01-01 00:00:00', 1, 'p3'), ('OWN', 'b', NULL, NULL, true, '2023-01-01 00:00:00', 0, 's2'), ('', 'c', 'success', 1, false, '2023-01-01 00:00:00', 0, 's3')) t(algorithm, database, status, rules_count, partial, updated_at, priority, source_path))"
_LATEST = f"(SELECT a AS algorithm, d AS database, s AS status, rules_count, coalesce(partial, false) OR s = 'partial' AS partial FROM (SELECT *, upper(trim(algorithm)) AS a, regexp_replace(database, '^.*/|\\.db$', '', 'g') AS d, lower(coalesce(status, 'missing')) AS s, row_number() OVER (PARTITION BY upper(trim(algorithm)), regexp_replace(database, '^.*/|\\.db$', '', 'g') ORDER BY updated_at DESC, priority DESC, source_path DESC) AS n FROM {_RUNS} WHERE algorithm <> '') WHERE n = 1)"


def _runs(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_RUNS}")


@query(f"SELECT algorithm, database, status, coalesce(rules_count, -1) AS rules_count, partial FROM {_LATEST}")
def latest_run_status(spark, sf_dir):
    return evidence.latest_statuses(_runs(spark)).na.fill(-1, ["rules_count"])


@query(f"SELECT status, count(*) AS n, round(100 * count(*) / 8, 2) AS percent FROM {_LATEST} GROUP BY status")
def run_outcome_counts(spark, sf_dir):
    return evidence.outcome_counts(evidence.latest_statuses(_runs(spark)), 8)


@query(f"WITH l AS (SELECT * FROM {_LATEST}), t AS (SELECT DISTINCT database FROM l WHERE algorithm = 'OWN' AND status = 'success' AND NOT partial) SELECT algorithm, (SELECT count(*) FROM t) AS target_successes, count(DISTINCT CASE WHEN status = 'success' AND NOT partial AND database IN (SELECT database FROM t) THEN database END) AS competitor_successes FROM l WHERE algorithm <> 'OWN' GROUP BY algorithm")
def run_coverage(spark, sf_dir):
    return audit.run_coverage(evidence.latest_statuses(_runs(spark)), "OWN")


_LOG = [
    ("logs/mesh/global.log", "2024-01-01 10:00:00,000 - Starting run"),
    ("logs/mesh/global.log", "2024-01-01 10:00:01,500 - Using sqlite:///data/db/mesh.db"),
    ("logs/mesh/global.log", "noise"),
    ("logs/mesh/global.log", "2024-01-01 10:00:09,000 - Discovered 12 rules in 8.5 s"),
    ("logs/mesh/global.log", "2024-01-01 10:00:09,100 - Process completed successfully"),
    ("logs/mesh/global.log", "2024-01-01 11:00:00,000 - Starting run"),
    ("logs/mesh/global.log", "2024-01-01 11:10:00,200 - Timeout after 600.2 s"),
    ("logs/mesh/global.log", "2024-01-01 11:10:00,300 - Received signal 15"),
    ("logs/sat/global.log", "2024-01-02 00:00:00,000 - before any start: 3 rules"),
]


@query("SELECT log_path, CAST(attempt AS BIGINT) AS attempt, database, CAST(started_at AS TIMESTAMP) AS started_at, CAST(ended_at AS TIMESTAMP) AS ended_at, status, CAST(runtime_seconds AS DOUBLE) AS runtime_seconds, CAST(rules_count AS BIGINT) AS rules_count, CAST(-1 AS DOUBLE) AS memory_event_gb FROM (VALUES ('logs/mesh/global.log', 1, 'mesh', '2024-01-01 10:00:00', '2024-01-01 10:00:09.1', 'success', 8.5, 12), ('logs/mesh/global.log', 2, 'mesh', '2024-01-01 11:00:00', '2024-01-01 11:10:00.3', 'timeout', 600.2, -1)) t(log_path, attempt, database, started_at, ended_at, status, runtime_seconds, rules_count)")
def log_attempts(spark, sf_dir):
    lines = spark.createDataFrame([(p, i, x) for i, (p, x) in enumerate(_LOG)], "log_path string, line_no int, line string")
    return evidence.log_attempts(lines).na.fill(-1, ["rules_count", "memory_event_gb"])


@query("SELECT o_orderstatus AS database, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def first_examples(spark, sf_dir):
    rows = star(spark, sf_dir, ("orders",)).tables["orders"].select(F.col("o_orderstatus").alias("database"), "o_orderpriority", "o_orderkey", "o_totalprice")
    return evidence.first_of_each(rows, "database", [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


_VARIANTS = "(SELECT * FROM (VALUES ('a', 'd1', true, 2.0), ('a', 'd2', true, 3.0), ('b', 'd1', true, 1.0), ('b', 'd2', true, 1.5), ('c', 'd1', true, 0.5), ('d', 'd1', false, 0.5), ('d', 'd2', true, 0.5)) t(variant, database, matches, s))"


@query(f"WITH v AS (SELECT variant, count(*) AS databases, sum(CAST(matches AS BIGINT)) AS m, sum(CAST(s AS DOUBLE)) AS seconds, bool_and(matches) AND count(*) = 2 AS complete FROM {_VARIANTS} GROUP BY variant) SELECT variant, databases, CAST(m AS BIGINT) AS matching, complete, seconds, CASE WHEN complete THEN CAST(rank() OVER (PARTITION BY complete ORDER BY seconds) AS INTEGER) ELSE 0 END AS position FROM v")
def variant_ranking(spark, sf_dir):
    return evidence.rank_variants(spark.sql(f"SELECT variant, database, matches, CAST(s AS DOUBLE) AS seconds FROM {_VARIANTS}")).na.fill(0, ["position"])


@query(f"WITH r AS (SELECT head_relation AS database, display FROM {_RULE_TABLE}), s AS (SELECT database, substr(sha256(string_agg(display, '' ORDER BY display)), 1, 12) || ' (' || count(*) || ' rules)' AS d FROM r GROUP BY database) SELECT database, d AS left_digest, CASE WHEN database = 'k' THEN 'MISSING' ELSE d END AS right_digest, CASE WHEN database = 'k' THEN 'DIFF' ELSE 'OK' END AS equivalent FROM s")
def rule_set_comparison(spark, sf_dir):
    rules = _rule_rows(spark).withColumnRenamed("head_relation", "database")
    return evidence.compare_rule_sets(rules, rules.where("database <> 'k'"))


@query("SELECT mode, CAST(n AS INTEGER) AS n, CASE WHEN mode = 'disjoint' AND n = 2 THEN '7' ELSE 'TIMEOUT_OR_MISSING' END AS rules, CASE WHEN mode = 'disjoint' AND n = 2 THEN '0.25' ELSE '-' END AS wall_s FROM range(1, 11) t(n), (VALUES ('disjoint'), ('nondisjoint')) m(mode)")
def sweep_coordinates(spark, sf_dir):
    return evidence.sweep(spark.createDataFrame([("disjoint", 2, 7, 0.25)], "mode string, n int, rules_count long, seconds double"))


@query("SELECT * FROM (VALUES ('d1', 'success', '4', '1.50', '2.00', 'missing', 'MISSING', '-', '-'), ('d2', 'oom', 'OOM', '9.00', '-', 'success', '3', '0.25', '-')) t(database, A_status, A_rules, A_time_s, \"A_rss_GB\", B_status, B_rules, B_time_s, \"B_rss_GB\")")
def results_pivot(spark, sf_dir):
    runs = spark.createDataFrame([("A", "d1", "success", 9.0, 2147483648), ("A", "d2", "oom", 9.0, None), ("B", "d2", "success", 1.0, None)], "algorithm string, database string, status string, duration_seconds double, peak_rss_bytes long")
    metrics = spark.createDataFrame([("A", "d1", "success", 4, 1.5), ("B", "d2", "success", 3, 0.25)], "algorithm string, database string, status string, rules_count long, execution_time_seconds double")
    return evidence.results_table(runs, metrics, ["A", "B"])


# --- RDF ---------------------------------------------------------------------------------------------------------

TURTLE = """@prefix ex: <http://example.org/> . @prefix s: <http://schema.org/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:PersonShape a sh:NodeShape ; sh:property ex:birth . ex:birth sh:path s:birthPlace ; sh:class s:Place ; sh:maxCount 1 .
s:Person rdfs:subClassOf s:Thing . ex:Alice a s:Person ; rdfs:label "Alice"@en ; s:birthDate "1990-01-01"^^xsd:date ; s:birthPlace ex:Paris . ex:Paris a s:Place .
"""


# The graph that the queries below read: every row of five tables as statements of all categories. Table names in braces.
_IRI = "'http://example.org/{0}/' || {1}"
_PARTS = (
    ("{nation}", _IRI.format("nation", "n_nationkey"), "iri", rdf.RDF + "type", "'http://schema.org/Country'", "iri", None),
    ("{nation}", _IRI.format("nation", "n_nationkey"), "iri", rdf.RDFS + "label", "n_name", "literal", rdf.XSD + "string"),
    ("{nation}", _IRI.format("nation", "n_nationkey"), "iri", rdf.SCHEMA + "containedInPlace", _IRI.format("region", "n_regionkey"), "iri", None),
    ("{region}", _IRI.format("region", "r_regionkey"), "iri", rdf.RDF + "type", "'http://www.w3.org/2002/07/owl#Class'", "iri", None),
    ("{region}", _IRI.format("region", "r_regionkey"), "iri", rdf.RDFS + "subClassOf", "'http://schema.org/Place'", "iri", None),
    ("{region}", _IRI.format("region", "r_regionkey"), "iri", rdf.OWL + "disjointWith", _IRI.format("region", "(r_regionkey + 1)"), "iri", None),
    ("{customer}", _IRI.format("customer", "c_custkey"), "iri", rdf.RDF + "type", "'http://schema.org/Person'", "iri", None),
    ("{customer}", _IRI.format("customer", "c_custkey"), "iri", rdf.SCHEMA + "homeLocation", _IRI.format("nation", "c_nationkey"), "iri", None),
    ("{customer}", _IRI.format("customer", "c_custkey"), "iri", "http://example.org/a/home-location", _IRI.format("nation", "c_nationkey"), "iri", None),
    ("{customer}", _IRI.format("customer", "c_custkey"), "iri", "http://example.org/b#home-location", _IRI.format("nation", "c_nationkey"), "iri", None),
    ("{customer}", _IRI.format("customer", "c_custkey"), "iri", "http://example.org/b#home-location", "'0' || c_nationkey", "literal", rdf.XSD + "integer"),
    ("{customer}", _IRI.format("customer", "c_custkey"), "iri", "http://example.org/vip", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE '0' END", "literal", rdf.XSD + "boolean"),
    ("{customer}", _IRI.format("customer", "c_custkey"), "iri", rdf.PROV + "wasDerivedFrom", "'http://example.org/table'", "iri", None),
    ("{supplier}", "'_:s' || s_suppkey", "blank", rdf.SHACL + "path", "'http://schema.org/homeLocation'", "iri", None),
    ("{supplier}", "'http://example.org/shape'", "iri", rdf.SHACL + "property", "'_:s' || s_suppkey", "blank", None),
    ("{supplier}", "'http://example.org/note'", "iri", rdf.SCHEMA + "about", "'_:s' || s_suppkey", "blank", None),
    ("{supplier}", "'_:b' || s_suppkey", "blank", rdf.SCHEMA + "about", "'_:b' || s_nationkey", "blank", None),
)


def _graph_sql() -> str:
    null = "CAST(NULL AS VARCHAR(100))"
    return " UNION ALL ".join(f"SELECT {s} AS s, '{sk}' AS s_kind, '{p}' AS p, {o} AS o, '{ok}' AS o_kind, {null if d is None else f"'{d}'"} AS datatype, {null} AS lang FROM {t}" for t, s, sk, p, o, ok, d in _PARTS)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star(spark, sf_dir, ("nation", "region", "customer", "supplier")).tables
    return spark.sql(_graph_sql(), **tables).selectExpr(*[x.split()[0] for x in rdf.STATEMENT.split(", ")])


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.classified(_graph(spark, sf_dir))


# Categories by lookups in sets of terms, numbers by row_number over all rows: no part of it is the engine's.
_RDF_SQL = """WITH g AS (SELECT DISTINCT * FROM (%s)),
shape AS (SELECT s AS t FROM g WHERE p LIKE '%%/ns/shacl#path' UNION SELECT s FROM g WHERE p LIKE '%%-ns#type' AND (o LIKE '%%/shacl#NodeShape' OR o LIKE '%%/shacl#PropertyShape') UNION SELECT o FROM g WHERE p LIKE '%%/ns/shacl#property'),
declared(t) AS (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#Property'), ('http://www.w3.org/2000/01/rdf-schema#Class'), ('http://www.w3.org/2002/07/owl#Class'), ('http://www.w3.org/2002/07/owl#DatatypeProperty'), ('http://www.w3.org/2002/07/owl#ObjectProperty')),
st AS (SELECT *, row_number() OVER (ORDER BY s_kind = 'iri', ltrim(s, '_:'), p, CASE o_kind WHEN 'blank' THEN 1 WHEN 'literal' THEN 2 ELSE 3 END, ltrim(o, '_:'), datatype) AS id,
CASE WHEN p LIKE '%%schema#subClassOf' THEN 'class_hierarchy' WHEN p LIKE '%%owl#disjointWith' THEN 'class_disjointness' WHEN p LIKE '%%-ns#type' AND o IN (FROM declared) THEN 'schema_declaration'
WHEN s IN (FROM shape) OR o IN (FROM shape) OR p LIKE '%%/ns/shacl#%%' THEN 'shacl_shape' WHEN p LIKE '%%/ns/prov#%%' THEN 'provenance_or_mapping' WHEN p LIKE '%%rdf-schema#label' THEN 'annotation'
WHEN p LIKE '%%-ns#type' THEN 'instance_type' WHEN o_kind = 'literal' THEN 'abox_datatype_fact' ELSE 'abox_object_fact' END AS category FROM g),
seen AS (SELECT s AS v, s_kind AS k, 3 * id AS pos FROM st UNION ALL SELECT p, 'iri', 3 * id + 1 FROM st UNION ALL SELECT o, o_kind, 3 * id + 2 FROM st WHERE o_kind <> 'literal'),
term AS (SELECT row_number() OVER (ORDER BY pos) AS term_id, v, k FROM (SELECT v, k, min(pos) AS pos FROM seen GROUP BY v, k)),
lit AS (SELECT row_number() OVER (ORDER BY pos) AS literal_id, o, datatype FROM (SELECT o, datatype, min(id) AS pos FROM st WHERE o_kind = 'literal' GROUP BY o, datatype)),
named(p, literal, table_name) AS (VALUES ('http://example.org/a/home-location', false, 'home_location'), ('http://example.org/b#home-location', false, 'home_location_' || left(sha256('http://example.org/b#home-location'), 8)), ('http://example.org/b#home-location', true, 'home_location_literal'),
('http://example.org/vip', true, 'vip'), ('http://schema.org/about', false, 'schema_about'), ('http://schema.org/containedInPlace', false, 'schema_containedInPlace'), ('http://schema.org/homeLocation', false, 'schema_homeLocation')) """ % _graph_sql().replace("{", "").replace("}", "")


@query(_RDF_SQL + "SELECT category, count(*) AS n FROM st GROUP BY category")
def rdf_statement_categories(spark, sf_dir):
    return _statements(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query(_RDF_SQL + "SELECT term_id, v AS value, CASE k WHEN 'blank' THEN 'blank_node' ELSE 'iri' END AS kind, v AS display FROM term")
def rdf_terms(spark, sf_dir):
    return rdf.archive(_statements(spark, sf_dir))["term"]


@query(_RDF_SQL + "SELECT literal_id, o AS lexical_form, datatype AS datatype_iri, CASE WHEN datatype LIKE '%#integer' THEN CAST(CAST(o AS BIGINT) AS VARCHAR) WHEN o = 'true' THEN 'True' WHEN datatype LIKE '%#boolean' THEN 'False' ELSE o END AS parsed_value FROM lit")
def rdf_literals(spark, sf_dir):
    return rdf.archive(_statements(spark, sf_dir))["literal"].drop("lang")


@query(
    _RDF_SQL + "SELECT st.id AS statement_id, a.term_id AS subject_id, b.term_id AS predicate_id, CASE o_kind WHEN 'literal' THEN 'literal' ELSE 'resource' END AS object_kind, coalesce(c.term_id, 0) AS object_id, coalesce(literal_id, 0) AS literal_id, category, "
    "sha256(CASE s_kind WHEN 'blank' THEN 'blank' ELSE 'resource' END || chr(0) || ltrim(s, '_:') || chr(31) || 'resource' || chr(0) || p || chr(31) || CASE o_kind WHEN 'blank' THEN 'blank' || chr(0) || ltrim(st.o, '_:') WHEN 'literal' THEN 'literal' || chr(0) || st.o || chr(0) || st.datatype || chr(0) ELSE 'resource' || chr(0) || st.o END) AS statement_hash "
    "FROM st JOIN term a ON a.v = s JOIN term b ON b.v = p LEFT JOIN term c ON c.v = st.o AND o_kind <> 'literal' LEFT JOIN lit ON lit.o = st.o AND lit.datatype = st.datatype AND o_kind = 'literal'"
)
def rdf_statement_ids(spark, sf_dir):
    return rdf.archive(_statements(spark, sf_dir))["statement"].na.fill(0, ["object_id", "literal_id"])


@query(_RDF_SQL + "SELECT * FROM named")
def rdf_predicate_tables(spark, sf_dir):
    return rdf.predicate_tables(_statements(spark, sf_dir))


@query(
    _RDF_SQL + "SELECT 'entity' AS part, term_id AS id, v AS a, '' AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d FROM term WHERE v IN (SELECT s FROM st WHERE category IN ('instance_type', 'abox_object_fact', 'abox_datatype_fact') UNION SELECT o FROM st WHERE category = 'abox_object_fact') "
    "UNION ALL SELECT 'class', term_id, v, '', 0, 0 FROM term WHERE v IN (SELECT o FROM st WHERE category = 'instance_type' UNION SELECT s FROM st WHERE category = 'class_hierarchy' UNION SELECT o FROM st WHERE category = 'class_hierarchy') "
    "UNION ALL SELECT CASE category WHEN 'instance_type' THEN 'rdf_type' ELSE 'rdfs_subClassOf' END, id, '', '', a.term_id, b.term_id FROM st JOIN term a ON a.v = s JOIN term b ON b.v = o WHERE category IN ('instance_type', 'class_hierarchy') "
    "UNION ALL SELECT 'object_fact', id, table_name, '', a.term_id, b.term_id FROM st JOIN named n ON n.p = st.p AND NOT n.literal JOIN term a ON a.v = s JOIN term b ON b.v = o WHERE category = 'abox_object_fact' "
    "UNION ALL SELECT 'literal_fact', id, table_name, st.o, a.term_id, literal_id FROM st JOIN named n ON n.p = st.p AND n.literal JOIN term a ON a.v = s JOIN lit ON lit.o = st.o AND lit.datatype = st.datatype WHERE category = 'abox_datatype_fact'"
)
def rdf_star(spark, sf_dir):
    """The ontology-lite variant's tables in one shape: entity, class, rdf_type, rdfs_subClassOf and the facts."""
    t = rdf.star_tables(_statements(spark, sf_dir), "ontology-lite")
    row = lambda part, id_, a="''", b="''", c="0L", d="0L": t[part].selectExpr(f"'{part}' AS part", f"{id_} AS id", f"{a} AS a", f"{b} AS b", f"{c} AS c", f"{d} AS d")
    parts = [row("entity", "entity_id", "iri"), row("class", "class_id", "iri"), row("rdf_type", "statement_id", c="subject_id", d="class_id"), row("rdfs_subClassOf", "statement_id", c="subclass_id", d="superclass_id")]
    parts += [row("object_fact", "statement_id", "predicate_table", c="subject_id", d="object_id"), row("literal_fact", "statement_id", "predicate_table", "raw_lexical", "subject_id", "literal_id")]
    return reduce(DataFrame.unionByName, parts)


@query(_RDF_SQL + "SELECT id AS statement_id, s || chr(9) || p || chr(9) || CASE o_kind WHEN 'literal' THEN 'literal:' || literal_id ELSE st.o END AS line FROM st LEFT JOIN lit ON lit.o = st.o AND lit.datatype = st.datatype WHERE category IN ('instance_type', 'abox_object_fact', 'abox_datatype_fact')")
def rdf_graph_lines(spark, sf_dir):
    return rdf.graph_lines(_statements(spark, sf_dir), "core")


@query("SELECT 'http://example.org/birth' AS shape_iri, 'http://schema.org/birthPlace' AS path_iri, 'http://schema.org/Place' AS classes, CAST(NULL AS INTEGER) AS min_count, CAST(1 AS INTEGER) AS max_count")
def rdf_shapes(spark, sf_dir):
    graph = spark.createDataFrame(list(rdf.parse_turtle(TURTLE)), rdf.STATEMENT)
    return rdf.shape_properties(graph).select("shape_iri", "path_iri", F.concat_ws(",", "class_iris").alias("classes"), "min_count", "max_count")


_FACT = "CASE WHEN {0} IS NULL OR lower({0}) = 'none' THEN '_' WHEN regexp_full_match({0}, '[0-9]+') THEN {0} WHEN regexp_matches({0}, '[A-Za-z]') THEN lower(regexp_replace({0}, '[^A-Za-z]', '', 'g')) ELSE '_' END"


@query("SELECT 'documents(' || doc_id || ',' || " + " || ',' || ".join(_FACT.format(c) for c in ("text", "lang", "source")) + " || ',' || n_chars || ').' AS value FROM documents")
def program_facts(spark, sf_dir):
    return text.program_facts(star(spark, sf_dir, ("documents",)).tables["documents"], "documents")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
