"""Registered queries work on whole tables: ids above any small bound count."""

import itertools
import re

import pytest

from rulequarry import queries as q
from rulequarry.catalog import Catalog, ForeignKey
from rulequarry.operators import miner
from rulequarry.plans.conjunctive import Planner, Query

ROWS = {
    "region": ([(0,), (1,)], "r_regionkey int"),
    "nation": ([(1, 0), (2, 1), (3, 1)], "n_nationkey int, n_regionkey int"),
    "customer": ([(7, 1), (50, 2), (1000, 1), (90000, 3)], "c_custkey int, c_nationkey int"),
    "supplier": ([(3, 1), (12, 2), (700, 2)], "s_suppkey int, s_nationkey int"),
    "part": ([(1,)], "p_partkey int"),
    "orders": ([(1, 50), (2, 50), (3, 90000)], "o_orderkey int, o_custkey int"),
    "lineitem": ([(1, 1, 700), (3, 1, 12)], "l_orderkey int, l_partkey int, l_suppkey int"),
    "events": ([(1, 7), (2, 90000)], "event_id int, user_id int"),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("star")
    for name, (rows, schema) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_mined_catalog_is_whole(spark, folder):
    c = q._mined_catalog(spark, folder)
    assert {t: c.tables[t].count() for t in c.tables} == {t: len(rows) for t, (rows, _) in ROWS.items()}
    assert len(c.foreign_keys) == 8


def test_mined_rules_equal_brute_force(spark, folder):
    some = ("region", "nation", "customer", "orders")
    c = q._mined_catalog(spark, folder)
    c = Catalog({t: c.tables[t] for t in some}, {t: c.primary_keys[t] for t in some}, tuple(k for k in c.foreign_keys if {k.table, k.ref_table} <= set(some)))
    tables = {t: [dict(zip([x.split()[0] for x in ROWS[t][1].split(", ")], r, strict=True)) for r in ROWS[t][0]] for t in some}
    found = list(miner.discover(c, miner.Settings(walk_length=2)))
    assert any("orders" in x.display for x in found)
    for x in found:
        atoms = [(t, dict(y.split("=") for y in args.split(", "))) for t, args in re.findall(r"(\w+)_\d+\(([^)]*)\)", x.display)]
        body, head = atoms[:-1], atoms[-1]

        def assignments(of):
            for rows in itertools.product(*(tables[t] for t, _ in of)):
                bound = {}
                if all(bound.setdefault(v, r[col]) == r[col] for (_, args), r in zip(of, rows, strict=True) for col, v in args.items()):
                    yield bound

        over = lambda rows, terms: {tuple(b[v] for v in sorted(terms)) for b in rows}
        in_body = {v for _, args in body for v in args.values()}
        both = list(assignments(atoms))
        assert x.support == len(over(both, set(head[1].values())))
        assert x.confidence_exact == len(over(both, in_body)) / len(over(assignments(body), in_body))


def test_unlinked_parts_are_counted_apart(spark, folder):
    p = Planner(q._mined_catalog(spark, folder))
    c, o, n = (("customer", 0), ("orders", 0), ("nation", 0))
    both = Query((c, o, n), ((("customer", 0, "c_nationkey"), ("nation", 0, "n_nationkey")),), (("customer", 0, "c_nationkey"), ("orders", 0, "o_custkey")))
    assert p.count_now(both) == 3 * 2
    only = Query((c, o), (), (("customer", 0, "c_nationkey"),))
    assert p.count_now(only) == 3
    empty = Planner(Catalog(p.catalog.tables | {"orders": p.catalog.tables["orders"].limit(0)}, p.catalog.primary_keys, p.catalog.foreign_keys))
    assert empty.count_now(only) == empty.count_now(both) == 0


def plain_facts():
    t = {k: v[0] for k, v in ROWS.items()}
    region = dict(t["nation"])
    facts = {(f"n{n}", "in", f"r{r}") for n, r in t["nation"]} | {(f"r{r}", "has", f"n{n}") for n, r in t["nation"]}
    return facts | {(f"c{c}", "lives", f"n{n}") for c, n in t["customer"]} | {(f"c{c}", "region", f"r{region[n]}") for c, n in t["customer"]}


def plain_rules(bodies, facts):
    out = {}
    for body, pairs in bodies.items():
        for head in {p for _, p, _ in facts}:
            of = {(s, o) for s, p, o in facts if p == head}
            if (n := len(pairs & of)) and body != (head,):
                known = [x for x in pairs if x[0] in {s for s, _ in of}]
                out[*body, head] = (n, *(round(n / d, 12) for d in (len(of), len(pairs), len(known))))
    return out


@pytest.mark.parametrize("name", ["triple_rule_implications", "triple_rule_chains"])
def test_triple_rules_are_of_all_facts(spark, folder, name):
    facts = plain_facts()
    ways = {}
    for s, p, o in facts:
        ways.setdefault(p, set()).add((s, o))
        ways.setdefault(p + "^-1", set()).add((o, s))
    if name == "triple_rule_chains":
        bodies = {(a, b): {(x, y) for x, z in ways[a] for w, y in ways[b] if z == w} for a in ways for b in ways}
    else:
        bodies = {(a,): pairs for a, pairs in ways.items()}
    got = q.QUERIES[name](spark, folder).collect()
    k = len(got[0]) - 4
    assert {tuple(r[:k]): tuple(r[k:]) for r in got} == plain_rules(bodies, facts)
    assert len(got) == len(plain_rules(bodies, facts))


def test_the_two_denominators_differ(spark, folder):
    got = {k: tuple(q.QUERIES[f"rule_confidence_{k}"](spark, folder).first())[:2] for k in ("star_quirk", "exact")}
    assert got == {"star_quirk": (2, 3), "exact": (2, 2)}
