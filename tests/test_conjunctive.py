import itertools
import random

import pytest

from rulequarry.catalog import Catalog, ForeignKey
from rulequarry.plans.conjunctive import Planner, Query, join_count


def catalog(spark, tables, keys=None, refs=()):
    return Catalog({n: spark.createDataFrame(rows, ddl) for n, (ddl, rows) in tables.items()}, keys or {}, tuple(ForeignKey(*r) for r in refs))


@pytest.fixture(scope="module")
def ab(spark):
    return catalog(spark, {"a": ("id int, val string, b_id int", [(10, "x", 1), (11, "z", 2), (12, None, None)]), "b": ("id int, val string", [(1, "x"), (2, "y")])}, {"a": ("id",), "b": ("id",)}, [("a", "b_id", "b", "id")])


def test_join_counts_and_thresholds(ab):
    p = Planner(ab)
    on = [("a", 0, "b_id", "b", 0, "id")]
    assert join_count(p, on) == join_count(p, on, disjoint=True) == 2
    assert join_count(p, on, count_over=[[("b", 0, "id")]]) == 2
    assert join_count(p, []) == 0
    q = Query((("a", 0), ("b", 0)), ((("a", 0, "b_id"), ("b", 0, "id")),))
    assert [p.exceeds(q, k) for k in (-1, 0, 1, 2)] == [True, True, True, False]
    assert not p.exceeds(Query(()), 0)
    assert p.count_now(Query((("b", 0), ("a", 0)), (), (("b", 0, "id"),))) == 2


def test_null_counts_as_a_value(ab):
    assert Planner(ab).count_now(Query((("a", 0),), (), (("a", 0, "val"),))) == 3


def test_value_set_drops_null_empty_and_zero(spark):
    c = catalog(spark, {"t": ("n int, s string, b boolean, d double", [(0, "", False, 0.0), (None, None, None, None), (3, "0", True, 2.5)])})
    assert [[r[0] for r in c.value_set("t", x).collect()] for x in "nsbd"] == [["3"], ["0"], ["True"], ["2.5"]]


def test_distinct_projection(spark):
    c = catalog(spark, {"projection": ("id int, kind string, value int", [(1, "x", 10), (2, "x", 10), (3, "x", 11)])}, {"projection": ("id",)})
    assert Planner(c).count_now(Query((("projection", 0),), (), (("projection", 0, "kind"), ("projection", 0, "value")))) == 2


def test_disjoint_composite_and_missing_keys(spark):
    c = catalog(spark, {"composite": ("left_id int, right_id int", [(1, 1), (1, 2)]), "no_key": ("value int", [(1,), (1,)])}, {"composite": ("left_id", "right_id")})
    q = lambda t, col: Query(((t, 0), (t, 1)), (((t, 0, col), (t, 1, col)),), (), True)
    p = Planner(c)
    assert p.count_now(q("composite", "left_id"), distinct=False) == 2
    assert p.count_now(q("no_key", "value"), distinct=False) == 0


def test_chain_in_any_order(spark):
    c = catalog(spark, {"d": ("id int", [(2,)]), "c": ("id int, d_id int", [(1, 99)]), "b_chain": ("id int, c_id int", [(1, 1)]), "a_chain": ("id int, b_id int", [(1, 1)])})
    on = [("c", 0, "d_id", "d", 0, "id"), ("a_chain", 0, "b_id", "b_chain", 0, "id"), ("b_chain", 0, "c_id", "c", 0, "id")]
    assert join_count(Planner(c), on) == 0
    assert join_count(Planner(c), on[1:]) == 1


def test_unlike_types_compare_as_text(spark):
    c = catalog(spark, {"n": ("i int", [(1,), (2,)]), "s": ("t string", [("1",), ("x",), (None,)])})
    assert join_count(Planner(c), [("n", 0, "i", "s", 0, "t")]) == 1


def test_keys_over_several_targets_and_unknown_columns(spark):
    c = catalog(spark, {"first": ("id int", [(1,)]), "second": ("id int", [(1,)]), "source": ("id int, value int", [(1, 1)])}, refs=[("source", "value", "first", "id"), ("source", "value", "second", "id")])
    assert c.references("source", "value") == (("first", "id"), ("second", "id"))
    assert c.are_foreign_keys("second", "id", "source", "value") and not c.are_foreign_keys("first", "id", "second", "id")
    c.check_foreign_keys()
    with pytest.raises(ValueError):
        Catalog(c.tables, {}, (ForeignKey("source", "nope", "first", "id"),)).check_foreign_keys()
    with pytest.raises(ValueError, match="unknown column"):
        Planner(c).count_now(Query((("first", 0),), (), (("first", 0, "nope"),)))


def test_semijoins_equal_joins_on_random_queries(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([None, 0, 1, 2, 3])
    tables = {n: ("k int, a int, b int", [(i, value(), value()) for i in range(12)]) for n in ("r", "s", "t")}
    c = catalog(spark, tables, {"r": ("k",), "s": ("a", "b")})
    naive, fast = Planner(c, semijoins=False), Planner(c)
    asked = []
    for _ in range(24):
        atoms = [(t, j) for t, n in zip("rst", (rng.randint(1, 2), rng.randint(0, 2), rng.randint(0, 1))) for j in range(n)]
        pick = lambda: (*rng.choice(atoms), rng.choice("kab"))
        pairs = tuple((pick(), pick()) for _ in range(rng.randint(0, len(atoms))))
        home = rng.choice(atoms)
        project = tuple({(*home, rng.choice("kab")) for _ in range(2)}) if rng.random() < 0.8 else tuple({pick(), pick()})
        asked.append(Query(tuple(atoms), pairs, project, rng.random() < 0.5))
    assert fast.counts(asked) == naive.counts(asked)
    semi = fast.rows(Query((("r", 0), ("s", 0)), ((("r", 0, "a"), ("s", 0, "a")),), (("r", 0, "k"),)))
    assert "LeftSemi" in semi._jdf.queryExecution().optimizedPlan().toString()


def brute_force(tables, keys, q):
    """Distinct projected tuples, over all combinations of rows."""
    found = set()
    for rows in itertools.product(*(tables[t] for t, _ in q.occurrences)):
        at = dict(zip(q.occurrences, rows, strict=True))
        get = lambda t: at[t[:2]][t[2]]
        pairs = [(at[o], at[u], keys[o[0]]) for o, u in itertools.combinations(q.occurrences, 2) if o[0] == u[0]]
        differ = all(any(None not in (x[c], y[c]) and x[c] != y[c] for c in key) for x, y, key in pairs)
        if (differ or not q.disjoint) and all(get(a) is not None and get(a) == get(b) for a, b in q.equalities):
            found.add(tuple(map(get, q.project)))
    return len(found)


def test_occurrences_that_must_differ_equal_brute_force(spark):
    rng = random.Random(11)
    value = lambda: rng.choice([None, 0, 1])
    keys = {"r": ("k",), "s": ("k", "a"), "t": ()}
    for rows in (0, 1, 2, 7):
        tables = {n: [(rng.choice([None, 1, 2, 3, 4]), value(), value()) for _ in range(rows)] for n in keys}
        p = Planner(catalog(spark, {n: ("k int, a int, b int", own) for n, own in tables.items()}, keys))
        plain = {n: [dict(zip("kab", r, strict=True)) for r in own] for n, own in tables.items()}
        asked = []
        for _ in range(12):
            atoms = [(t, j) for t, n in zip("rst", rng.choice([(2, 0, 1), (3, 0, 0), (2, 1, 0), (3, 1, 0), (1, 2, 0), (1, 0, 2)]), strict=True) for j in range(n)]
            pick = lambda: (*rng.choice(atoms), rng.choice("abk"))
            pairs = tuple((pick(), pick()) for _ in range(rng.randint(0, 2)))
            asked.append(Query(tuple(atoms), pairs, tuple({pick() for _ in range(rng.randint(1, 2))}), True))
        assert p.counts(asked) == [brute_force(plain, keys, q) for q in asked]


def test_no_pairs_of_rows_that_only_must_differ(spark):
    """200 million pairs otherwise; two keys of the other occurrence tell as much."""
    c = Catalog({"o": spark.range(20000).selectExpr("id AS k", "id % 100 AS c")}, {"o": ("k",)})
    p = Planner(c)
    q = Query((("o", 0), ("o", 1)), (), (("o", 0, "c"),), True)
    assert p._scan(q, ("o", 1), p._repeated(q), True).count() == 2
    linked = Query(q.occurrences, ((("o", 0, "c"), ("o", 1, "c")),), q.project, True)
    assert p._scan(linked, ("o", 1), p._repeated(linked), True).count() == 200
    assert p.counts([q, linked]) == [100, 100]


def test_what_cannot_differ_is_not_planned(spark, monkeypatch):
    c = catalog(spark, {"o": ("k int, c int", [(1, 1), (2, 1)]), "n": ("v int", [(1,), (1,)])}, {"o": ("k",)})
    p = Planner(c)
    monkeypatch.setattr(p, "count", lambda q: pytest.fail("planned"))
    two = lambda t, col: Query(((t, 0), (t, 1)), (((t, 0, col), (t, 1, col)),), ((t, 0, col),), True)
    assert p.counts([two("o", "k"), two("n", "v")]) == [0, 0]


def test_equal_counts_are_made_once(spark, monkeypatch):
    c = catalog(spark, {"o": ("k int, c int", [(1, 1), (2, 1), (3, 2)]), "u": ("k int", [(1,), (2,), (5,)])}, {"o": ("k",), "u": ("k",)})
    p, made = Planner(c), []
    count = p.count
    monkeypatch.setattr(p, "count", lambda q: made.append(q) or count(q))
    on = lambda i, j: ((("o", i, "c"), ("u", j, "k")),)
    asked = [Query((("o", i), ("u", j)), on(i, j), (t,)) for i, j in ((0, 0), (1, 0), (0, 1)) for t in (("o", i, "c"), ("u", j, "k"))]
    apart = Query((("o", 0), ("u", 0), ("o", 1)), on(0, 0), (("u", 0, "k"), ("o", 1, "k")))
    known = {}
    assert p.counts(asked, known=known) == [2] * 6 and len(made) == 1
    assert p.counts([*asked, apart], known=known) == [2] * 6 + [6] and len(made) == 2
