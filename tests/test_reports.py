import pytest

from rulequarry.catalog import Catalog
from rulequarry.operators import triple_rules, triples
from rulequarry.sources import reports


def test_text_forms(spark):
    df = spark.createDataFrame([("a|b", 1.5, None), ("c_d", 2.0, 3)], "name string, x double, n int")
    assert reports.markdown(df, ["name"]).splitlines()[2] == "| a\\|b | 1.5 |  |"
    assert r"c\_d & 2 & 3 \\" in reports.latex(df, "100%", ["name"])
    assert "Took 2.000 seconds." in reports.run_report("r", 2, {"t": df})


def test_mapping_is_checked(spark):
    c = Catalog({"t": spark.createDataFrame([(1, 2)], "id int, v int")}, {"t": ("id",)})
    m = triples.mapping(c)
    reports.check_mapping(m, c)
    with pytest.raises(ValueError):
        reports.check_mapping(m | {"signature": "x"}, c)
    with pytest.raises(ValueError):
        reports.check_mapping(m, c, b"lines")


def test_dump():
    dump = "-- head\nCREATE TABLE `t` (\n  `id` int(11) unsigned NOT NULL,\n  `s` enum('a','b') DEFAULT NULL,\n  PRIMARY KEY (`id`),\n  KEY `k` (`s`)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8;\nLOCK TABLES `t` WRITE;\nINSERT INTO `t` VALUES (1,'it\\'s');\n"
    out = reports.dump_to_ansi(dump)
    assert 'CREATE TABLE "t"' in out and "KEY \"k\"" not in out and "'it''s'" in out and "ENGINE" not in out and "LOCK" not in out and 'PRIMARY KEY ("id")\n);' in out


def test_rules_over_triples(spark):
    facts = [("a", "parent", "b"), ("b", "parent", "c"), ("a", "grand", "c"), ("b", "child", "a"), ("c", "child", "b"), ("x", "child", "y"), ("a", "parent", "b")]
    t = spark.createDataFrame(facts, "s string, p string, o string")
    two = {(r.body, r.head): (r.support, r.head_coverage, r.std_confidence, r.pca_confidence) for r in triple_rules.implications(t).collect()}
    assert two["child^-1", "parent"] == (2, 1.0, 2 / 3, 1.0) and two["parent^-1", "child"] == (2, 2 / 3, 1.0, 1.0)
    three = {(r.body_1, r.body_2, r.head): r.support for r in triple_rules.chains(t).collect()}
    assert three["parent", "parent", "grand"] == 1
