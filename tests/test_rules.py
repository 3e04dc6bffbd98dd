import pytest

from rulequarry.catalog import Catalog, ForeignKey
from rulequarry.functions import relations as r
from rulequarry.functions import text
from rulequarry.operators import audit, joinability, miner
from rulequarry.operators.lattice import Graph, Names, candidates, edges, foreign_key_pairs, horn_key, horn_splits
from rulequarry.plans.conjunctive import Planner


@pytest.fixture(scope="module")
def family(spark):
    return Catalog(
        {"parent": spark.createDataFrame([(1,), (2,)], "id int"), "child": spark.createDataFrame([(10, 1), (11, 1)], "id int, parent_id int")},
        {"parent": ("id",), "child": ("id",)},
        (ForeignKey("child", "parent_id", "parent", "id"),),
    )


@pytest.fixture(scope="module")
def tiny(spark):
    return Catalog(
        {"parent": spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string"), "child": spark.createDataFrame([(10, 1, "child")], "id int, parent_id int, label string")},
        {"parent": ("id",), "child": ("id",)},
        (ForeignKey("child", "parent_id", "parent", "id"),),
    )


def test_mined_rules_hold_when_evaluated_independently(family):
    s = miner.Settings.of(walk_length=2, max_tables=3, max_variables=2, disjoint_semantics="yes")
    rules = list(miner.discover(family, s))
    shown = [x.display for x in rules]
    assert "∀ x0: child_0(parent_id=x0) ∧ child_1(parent_id=x0) ⇒ parent_0(id=x0)" in shown and len(set(shown)) == len(shown)
    planner = Planner(family)
    for x in rules:
        rule = miner.parsed(x)
        assert not rule.existential() and len(rule.head) == 1
        support, predictions, confidence = audit.evaluate(planner, rule, disjoint=True)
        if rule.body_variables() == rule.head_variables():
            assert (support, confidence) == (x.support, x.confidence_exact)
        assert predictions


def test_lattice_is_canonical(family):
    names = Names(family)
    found = list(candidates(Graph(edges(names, foreign_key_pairs(family), 2)), 3, 3))
    assert len({c.classes for c in found}) == len(found)
    for c in found:
        for _, head in horn_splits(c):
            assert horn_key(c, head)[1] == (head[0], 0)


def test_synthetic_chain_graph(spark):
    names = [f"synthetic_{i:02d}" for i in range(8)]
    c = Catalog({n: spark.createDataFrame([(1, 1, 1)], "id int, parent_id int, payload int") for n in names}, {n: ("id",) for n in names}, tuple(ForeignKey(b, "parent_id", a, "id") for a, b in zip(names, names[1:])))
    assert Graph(edges(Names(c), foreign_key_pairs(c), 3)).size() == (63, 288)


def test_stop_timeout_and_settings(family):
    assert list(miner.discover(family, miner.Settings(), should_stop=lambda: True)) == []
    assert list(miner.discover(family, miner.Settings(timeout=-1.0))) == []
    s = miner.Settings.of(recursivity=2, full_joinability=True, nb_occurrence=None)
    assert (s.walk_length, s.joinability) == (3, "full")
    for bad in ({"support_threshold": 0}, {"support_threshold": 1.5}, {"split_mean_threshold": 1}, {"joinability": "some"}):
        with pytest.raises(ValueError):
            miner.Settings.of(**bad)


def test_no_key_no_rule_and_column_limits(spark, family):
    person = Catalog({"Person": spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string")}, {"Person": ("id",)})
    assert list(miner.discover(person)) == []
    names = Names(family)
    assert len(edges(names, foreign_key_pairs(family), 2, {"child": {"parent_id": 0}})) == 2


def test_overlap_mode_needs_many_shared_values(spark):
    c = Catalog({"a": spark.range(0, 500).toDF("x"), "b": spark.range(100, 600).toDF("y"), "c": spark.range(0, 351).toDF("z")})
    assert (("a", "x"), ("b", "y")) in joinability.overlapping_pairs(c) and (("a", "x"), ("c", "z")) not in joinability.overlapping_pairs(c)


@pytest.mark.parametrize("name", ["plain", "Order Details", "t_1", 'a"b', "a-b", "1st"])
def test_names_survive(name):
    assert r.parse_reference(r.reference(name, 7)) == (name, 7)
    d = r.parse_dependency(f"∀ x: {r.reference(name, 0)}(id=x) ⇒ ∃ y: parent_0(id=x, name=y)")
    assert d.body[0].table == name and d.existential() == {"y"} and d.kind() == "existential_tgd"


def test_broken_rules_are_refused():
    for bad in ("a_0(x=y)", "⇒ a_0(x=y)", "a_0(x=y) ⇒ b_0", "a_0(x) ⇒ b_0(x=y)", "a_0(x=y) ⇒ b_0(x=y) ⇒ c_0(x=y)"):
        with pytest.raises(ValueError):
            r.parse_dependency(bad)


def test_evaluation(tiny):
    p = Planner(tiny)
    assert audit.evaluate(p, r.parse_dependency("child_0(parent_id=x) ⇒ parent_0(id=x)")) == (1, 1, 1.0)
    assert audit.evaluate(p, r.parse_dependency("parent_0(id=x) ⇒ child_0(parent_id=x)")) == (1, 2, 0.5)
    assert audit.evaluate(p, r.parse_dependency("child_0(parent_id=x) ⇒ parent_0(id=x, name=y)")) == (1, 1, 1.0)


def test_funnel_of_four_rules(spark, tiny):
    shown = ["child_0(parent_id=x0) ⇒ parent_0(id=x0)", "parent_0(id=x0) ⇒ child_0(parent_id=x0)", "child_0(id=x) ⇒ child_1(id=x)", "child_0(label=x) ⇒ parent_0(name=x)"]
    records = audit.audit(tiny, [audit.Source("SPIDER", "tiny", i, d) for i, d in enumerate(shown)], [r.parse_dependency("child_0(parent_id=v) ⇒ parent_0(id=v)")])
    assert [x["classification"] for x in records] == ["comparable_true", "approximate", "vacuous", "out_of_scope"]
    assert records[0]["match_status"] == "recalled_alpha" and records[2]["reason"] == "head_entailed_by_body;forced_same_tuple"
    f = audit.funnel(audit.records_frame(spark, records), ("SPIDER", "AMIE3"))
    rows = {x["algorithm"]: x for x in f.collect()}
    assert {k: rows["SPIDER"][k] for k in ("total", "parseable", "translatable", "evaluable", "within_scope", "non_vacuous", "above_threshold", "exactly_recovered", "covered_by_more_general_rule")} == dict(total=4, parseable=4, translatable=4, evaluable=4, within_scope=2, non_vacuous=2, above_threshold=1, exactly_recovered=1, covered_by_more_general_rule=0)
    assert rows["AMIE3"]["total"] == 0


def test_matching_and_coverage(tiny):
    p = r.parse_dependency
    general, special = p("a_0(x=u) ⇒ b_0(y=u)"), p("a_0(x=v, z=w) ∧ c_0(k=w) ⇒ b_0(y=v)")
    assert audit.subsumes(general, special) and not audit.subsumes(special, general)
    assert audit.alpha_equivalent(p("a_0(x=u) ⇒ b_0(y=u)"), p("a_0(x=q) ⇒ b_0(y=q)"))
    planner = Planner(tiny)
    assert audit.covered(planner, p("child_0(parent_id=x) ⇒ parent_0(id=x)"), [p("child_0(parent_id=x, label=l) ⇒ parent_0(id=x)")])
    assert not audit.covered(planner, p("child_0(parent_id=x) ⇒ parent_0(id=x)"), [])


def test_clauses_and_inclusions(tiny):
    assert audit.parse(audit.Source("POPPER", "t", 0, "parent(A,B):- child(C,A,D)."), tiny).body[0].terms == (("id", "C"), ("parent_id", "A"), ("label", "D"))
    for bad, why in (("x", "popper_missing_implication"), ("parent(A):- child(A,B,C)", "popper_arity_mismatch:parent"), ("parent(a,B):- child(A,B,C)", "popper_constants_not_supported"), ("q(A):- child(A,B,C)", "popper_unknown_relation:q")):
        assert audit.parse(audit.Source("POPPER", "t", 0, bad), tiny) == why
    ind = {"table_dependant": "child", "columns_dependant": ["parent_id"], "table_referenced": "parent", "columns_referenced": ["id"]}
    assert audit.parse(audit.Source("SPIDER", "t", 0, "", ind), tiny).key() == "child(parent_id=v0) => parent(id=v0)"
    assert audit.parse(audit.Source("SPIDER", "t", 0, "", ind | {"columns_dependant": ["a", "b"]}), tiny) == "multi_column_inclusion_dependency"


def test_outputs_of_other_systems(spark):
    block = "******* SOLUTION *******\nPrecision:0.75 Recall:0.50\ntarget(V0,V1):- person(V0,V1).\n*****\n"
    assert text.clause_rules(block) == [("target(V0,V1):- person(V0,V1).", 0.75, 0.5)] and text.clause_rules("NO SOLUTION") == []
    lines = spark.createDataFrame([("Loaded 8 facts",), ("?a p ?b => ?a q ?b\t0.5\t2",), ("noise",)], "value string")
    assert [tuple(x) for x in text.triple_rules(lines).collect()] == [("?a p ?b", "?a q ?b", 0.5, 2.0, 0.25)]
    assert text.used_twice([("x", "p", "y"), ("y", "q", "x"), ("x", "r", "z")]) == [("x", "p", "y"), ("y", "q", "x")]
    assert [text.duration(s) for s in (0.5, 2, 125, 7300)] == ["500.00 ms", "2.000 seconds", "2m 5.0s", "2h 1m"]
