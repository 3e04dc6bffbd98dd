import pytest

from rulequarry.catalog import Catalog, ForeignKey
from rulequarry.functions import text
from rulequarry.operators import evidence, triples
from rulequarry.queries import TURTLE
from rulequarry.sources import rdf, rules


@pytest.fixture(scope="module")
def family(spark):
    return Catalog(
        {"parent": spark.createDataFrame([(1, "Alice")], "id int, name string"), "child": spark.createDataFrame([(10, 1, 'A "quoted" child'), (None, 1, "x"), (11, None, None)], "id int, parent_id int, label string"), "tab": spark.createDataFrame([("A-1", 5)], "id string, n int"), "keyless": spark.createDataFrame([(1, 2)], "a int, b int"), "lone": spark.createDataFrame([(1,)], "id int")},
        {"parent": ("id",), "child": ("id",), "tab": ("id",), "lone": ("id",)},
        (ForeignKey("child", "parent_id", "parent", "id"),),
    )


def test_triples(family):
    assert {tuple(x) for x in triples.triples(family).collect()} == {("parent_1", "parent.name", '"Alice"'), ("child_10", "child.label", '"A \\"quoted\\" child"'), ("child_10", "child.parent_id", "parent_1"), ("tab_A_1", "tab.n", '"5"')}


def test_mapping_and_translation(spark, family):
    known = triples.mapping(family)
    assert set(known["predicates"]) == {"child.label", "child.parent_id", "parent.name", "tab.n"} and known["skipped"] == ["keyless", "lone"]
    rule = triples.translate("?a child.parent_id ?b ?b parent.name ?c => ?a child.label ?c\t1\t0.5\t9", known)
    assert rule.key() == "child(id=v0,parent_id=v1) & parent(id=v1,name=v2) => child(id=v0,label=v2)"
    for bad, why in (("?a child.label x => ?a child.label ?b", "amie_constants_not_supported"), ("x", "amie_missing_implication"), ("=> ?a child.label ?b", "amie_empty_body"), ("?a b => ?a child.label ?b", "amie_malformed_body"), ("?a no.p ?b => ?a child.label ?b", "amie_unknown_predicate:no.p")):
        with pytest.raises(ValueError, match=why):
            triples.translate(bad, known)
    lines = spark.createDataFrame([("a\tchild.label\tb",), ("a\tother\tb",)], "value string")
    assert [tuple(x) for x in triples.unknown_predicates(lines, known).collect()] == [("other", 1)]


def test_turtle_and_ntriples_agree(spark, tmp_path):
    nt = '<http://e/a> <http://e/p> "x\\"y"@en .\n# note\n\n_:b <http://e/p> <http://e/c> .\n<http://e/a> <http://e/q> "1"^^<http://www.w3.org/2001/XMLSchema#int> .\n'
    (tmp_path / "g.nt").write_text(nt)
    (tmp_path / "g.ttl").write_text('@prefix e: <http://e/> . e:a e:p "x\\"y"@en ; e:q "1"^^<http://www.w3.org/2001/XMLSchema#int> . [] e:p e:c ; e:list (1 2.5 true) .')
    lines = {tuple(x) for x in rdf.read_ntriples(spark, str(tmp_path / "g.nt")).select("p", "o_kind", "datatype", "lang").collect()}
    turtle = {tuple(x) for x in rdf.read_turtle(spark, str(tmp_path / "g.ttl")).select("p", "o_kind", "datatype", "lang").collect()}
    assert lines <= turtle and (rdf.RDF + "first", "literal", rdf.XSD + "decimal", None) in turtle
    with pytest.raises(ValueError):
        list(rdf.parse_turtle("e:a e:b e:c ."))


def test_variants_and_archive(spark, tmp_path):
    graph = spark.createDataFrame(list(rdf.parse_turtle(TURTLE)), rdf.STATEMENT)
    s = rdf.classified(graph)
    archived = rdf.write_archive(s, graph, str(tmp_path / "a"), {"input_path": "x"})
    ids = sorted(x[0] for x in archived["statement"].select("statement_id").collect())
    assert ids == list(range(1, 12)) and archived["statement"].where("object_id IS NULL AND literal_id IS NULL").count() == 0
    assert spark.read.parquet(str(tmp_path / "a" / "transformation_decision")).count() == 20
    shape = spark.read.parquet(str(tmp_path / "a" / "shape_property")).first()
    assert (shape.class_iris, shape.max_count, shape.labels) == ('["http://schema.org/Place"]', 1, "[]")
    counts = rdf.write_variant(s, "core", str(tmp_path / "v"), archived)
    # birthPlace is the path of a shape, not a shape; both people and places are entities, their types are classes.
    assert counts == {"entity": 2, "literal": 1, "class": 2, "rdf_type": 2, "object_fact": 1, "literal_fact": 1}
    lines = [x.value for x in spark.read.text(str(tmp_path / "v" / "graph.tsv")).collect()]
    assert len(lines) == 4 and any(x.startswith("http://example.org/Alice\thttp://schema.org/birthDate\tliteral:") for x in lines)
    assert set(rdf.star_tables(s, "ontology-lite", archived)) - set(counts) == {"rdfs_subClassOf"}


def test_lists_that_run_in_a_circle_end(spark):
    sh, first, rest = rdf.SHACL, rdf.RDF + "first", rdf.RDF + "rest"
    rows = [("_:s", sh + "path", "p"), ("_:s", sh + "or", "_:c"), ("_:c", first, "_:x"), ("_:c", rest, "_:d"), ("_:d", first, "_:y"), ("_:d", rest, "_:c"), ("_:x", sh + "class", "K"), ("_:y", sh + "datatype", "D"), ("_:s", rdf.RDFS + "label", "shape")]
    graph = spark.createDataFrame([(s, "blank", p, o, "iri", None, None) for s, p, o in rows], rdf.STATEMENT)
    (got,) = rdf.shape_properties(graph).collect()
    assert (got.path_iri, got.class_iris, got.datatype_iris, got.labels, got.min_count) == ("p", ["K"], ["D"], ["shape"], None)


def test_values_of_logic_programs(spark):
    df = spark.createDataFrame([("a1-b",), ("é_x9",), ("None",), ("12",), ("--",), (None,), ("Ab C",)], "v string")
    assert [x[0] for x in df.select(text.program_value(df.v)).collect()] == ["ab", "x", "_", "12", "_", "_", "abc"]
    n = spark.createDataFrame([(-5,), (None,)], "v int")
    assert [x.value for x in text.program_facts(n, "t").collect()] == ["t(-5).", "t(_)."]


def test_rule_files(spark, tmp_path):
    folder = tmp_path / "SPIDER" / "SPIDER_tiny"
    folder.mkdir(parents=True)
    (folder / "SPIDER_tiny_results.json").write_text('[{"type":"TGDRule","display":"a","confidence":1.0,"body":[{"variable1":"x","relation":"r","variable2":"y"}]},{"type":"InclusionDependency","table_dependant":"c","columns_dependant":["p"],"table_referenced":"t","columns_referenced":["id"]}]')
    got = rules.read_results(spark, str(tmp_path))
    assert [(x.algorithm, x.database, x.rule_index, x.type) for x in got.orderBy("rule_index").collect()] == [("SPIDER", "tiny", 0, "TGDRule"), ("SPIDER", "tiny", 1, "InclusionDependency")]
    rules.write_rules(got.drop("algorithm", "database", "rule_index"), str(tmp_path / "out"))
    rules.write_rules(got.drop("algorithm", "database", "rule_index"), str(tmp_path / "out"), append=True)
    assert rules.read_rules(spark, str(tmp_path / "out")).count() == 4
    records = spark.createDataFrame([("A", "d", None, True), ("B", "e", "x", False)], "algorithm string, database string, note string, ok boolean")
    rules.write_csv(records, str(tmp_path / "csv"))
    assert sorted(map(tuple, rules.read_csv(spark, str(tmp_path / "csv"), "algorithm string, database string, note string, ok boolean").collect()), key=str) == [("A", "d", None, True), ("B", "e", "x", False)]


def test_statuses_and_logs_from_files(spark, tmp_path):
    (tmp_path / "progress").mkdir()
    (tmp_path / "progress" / "a.json").write_text('{"algorithm":"X","database":"d.db","status":"success","rules_count":3,"updated_at":"2024-01-02T00:00:00Z"}')
    (tmp_path / "summary1.json").write_text('{"runs":[{"algorithm":"x","database":"d","status":"timeout","updated_at":"2024-01-01T00:00:00Z"},{"algorithm":"Y","database":"d","status":"oom"}]}')
    got = {(x.algorithm, x.database): x.status for x in evidence.latest_statuses(rules.read_statuses(spark, str(tmp_path))).collect()}
    assert got == {("X", "d"): "success", ("Y", "d"): "oom"}
    (tmp_path / "global.log").write_text("2024-01-01 10:00:00,000 - Starting\n\x1b[31m2024-01-01 10:00:05,000 - memory limit exceeded: 10.01 GB\x1b[0m\n2024-01-01 10:00:06,000 - Received signal\n")
    (x,) = evidence.log_attempts(rules.read_log(spark, str(tmp_path / "global.log"))).collect()
    assert (x.status, x.memory_event_gb) == ("memory_limit", 10.01)
    assert {r.status: r.n for r in evidence.status_histogram(spark.createDataFrame([("success",)], "status string")).collect()}["timeout"] == 0


def test_reports(spark):
    runs = spark.createDataFrame([("A", "b", 5), ("A", "a", 5), ("B", "c", 9)], "algorithm string, database string, size_bytes long")
    assert evidence.job_order(runs).first().database == "c"
    assert [x.database for x in evidence.select_jobs(runs, ["A", "C"]).orderBy("database").collect()] == ["a", "c"]
    assert sum(evidence.select_jobs(runs, part=k, parts=2).count() for k in (0, 1)) == 3
    m = spark.createDataFrame([("d", 10.0, 0, 4), ("e", None, 5, 2)], "database string, runtime_seconds double, peak_rss_bytes long, query_count long")
    v = spark.createDataFrame([("d", 5.0, 1, 4)], "database string, runtime_seconds double, peak_rss_bytes long, query_count long")
    row = evidence.compare_metrics(m, v).where("database = 'd'").first()
    assert (row.improvement_runtime_seconds, row.improvement_peak_rss_bytes, row.improvement_query_count) == (50.0, None, 0.0)
    attempts = spark.createDataFrame([("l", 1, "d", "success"), ("l", 2, "d", "timeout")], "log_path string, attempt long, database string, status string")
    artifacts = spark.createDataFrame([("d", "complete", 3, 4, "success", 3), ("z", "partial", None, None, None, None)], "database string, state string, rule_count long, execution_rules long, execution_status string, report_rules long")
    got = {x.database: (x.latest_log_status, x.disagreements) for x in evidence.reconcile(attempts, artifacts).collect()}
    assert got == {"d": ("timeout", "rule_json_vs_execution_rules_count,execution_status_vs_latest_log_attempt"), "z": ("missing", "")}
