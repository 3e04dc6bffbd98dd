"""RDF graphs as relational tables: parsing, classification, dictionary encoding, variants, and their files.

N-Triples are read line by line by Spark. Turtle is tokenized by a small parser, a file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulequarry.plans.lineage import cut

# Names of the vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SHACL = "http://www.w3.org/ns/shacl#"
SCHEMA = "http://schema.org/"
YAGO = "http://yago-knowledge.org/schema#"
PROV = "http://www.w3.org/ns/prov#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "sh": SHACL, "schema": SCHEMA, "yago": YAGO}
ANNOTATIONS = (
    RDFS + "label",
    RDFS + "comment",
    SCHEMA + "alternateName",
    SCHEMA + "description",
    SCHEMA + "familyName",
    SCHEMA + "givenName",
    SCHEMA + "image",
    SCHEMA + "name",
    SCHEMA + "sameAs",
    SCHEMA + "url",
    YAGO + "demonym",
)
PROVENANCE = (YAGO + "fromClass", YAGO + "fromProperty")
SHAPES = (SHACL + "NodeShape", SHACL + "PropertyShape")
DECLARED = (RDF + "Property", RDFS + "Class", OWL + "Class", OWL + "DatatypeProperty", OWL + "ObjectProperty", *SHAPES)
VARIANTS = {"core": ("instance_type", "abox_object_fact", "abox_datatype_fact"), "ontology-lite": ("instance_type", "abox_object_fact", "abox_datatype_fact", "class_hierarchy")}
CATEGORIES = (
    "abox_datatype_fact",
    "abox_object_fact",
    "annotation",
    "class_disjointness",
    "class_hierarchy",
    "instance_type",
    "provenance_or_mapping",
    "schema_declaration",
    "shacl_shape",
    "unsupported_or_other",
)
#: Names that a predicate's table may not have.
RESERVED = ("namespace", "term", "literal", "statement", "shape_property", "transformation_decision", "import_metadata", "class", "entity", "rdf_type", "rdfs_subClassOf")
STATEMENT = "s string, s_kind string, p string, o string, o_kind string, datatype string, lang string"

_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?\s*\.\s*$'
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<at>@[A-Za-z][A-Za-z0-9-]*)|(?P<mark>\^\^|[;,.\[\]()](?![0-9])|[;,\[\]()])|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w.-]*\w)|(?P<name>[A-Za-z_][\w.-]*?:[\w.%-]*[\w%-]|[A-Za-z_][\w.-]*:|:[\w.%-]*[\w%-]|:|[A-Za-z]+)|(?P<dot>\.)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPE.get(m[1], m[1]), text)


def parse_turtle(text: str, document: str = "") -> Iterator[tuple]:
    """STATEMENT rows of a Turtle text; blank nodes are named after the document and their order."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes, base, made, out, k = {}, "", [0], [], 0

    def fresh() -> tuple:
        made[0] += 1
        return ("blank", f"_:{document}g{made[0]}", None, None)

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal k
        if k >= len(tokens) or value is not None and tokens[k][1] != value:
            raise ValueError(f"expected {value or 'a term'} at token {k}")
        k += 1
        return tokens[k - 1]

    def iri(kind: str, word: str) -> str:
        if kind == "iri":
            return word[1:-1] if ":" in word else base + word[1:-1]
        prefix, _, local = word.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix}")
        return prefixes[prefix] + local

    def term() -> tuple:
        kind, word = take()
        if word == "[":
            node = fresh()
            if tokens[k][1] != "]":
                predicates(node)
            take("]")
            return node
        if word == "(":
            items = []
            while tokens[k][1] != ")":
                items.append(term())
            take(")")
            nodes = [fresh() for _ in items]
            for i, x in enumerate(items):
                out.append((nodes[i], RDF + "first", x))
                out.append((nodes[i], RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else ("iri", RDF + "nil", None, None)))
            return nodes[0] if nodes else ("iri", RDF + "nil", None, None)
        if kind == "string":
            size = 3 if word[:3] in ('"""', "'''") else 1
            value = _unescape(word[size:-size])
            if k < len(tokens) and tokens[k][0] == "at":
                return ("literal", value, RDF + "langString", take()[1][1:].lower())
            if k < len(tokens) and tokens[k][1] == "^^":
                take()
                return ("literal", value, iri(*take()), None)
            return ("literal", value, XSD + "string", None)
        if kind == "number":
            return ("literal", word, XSD + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer"), None)
        if word in ("true", "false"):
            return ("literal", word, XSD + "boolean", None)
        if kind == "blank":
            return ("blank", f"_:{document}{word[2:]}", None, None)
        return ("iri", iri(kind, word), None, None)

    def predicates(node: tuple) -> None:
        while True:
            kind, word = take()
            p = RDF + "type" if word == "a" else iri(kind, word)
            while True:
                out.append((node, p, term()))
                if k < len(tokens) and tokens[k][1] == ",":
                    take()
                    continue
                break
            while k < len(tokens) and tokens[k][1] == ";":
                take()
            if k >= len(tokens) or tokens[k][1] in (".", "]") or tokens[k - 1][1] != ";":
                return

    while k < len(tokens):
        word = tokens[k][1]
        if word.lower() in ("@prefix", "prefix", "@base", "base"):
            take()
            if "prefix" in word.lower():
                name = take()[1]
                prefixes[name[:-1]] = iri(*take())
            else:
                base = take()[1][1:-1]
            if word.startswith("@"):
                take(".")
            continue
        node = term()
        if k < len(tokens) and tokens[k][1] != ".":
            predicates(node)
        take(".")
    for s, p, o in out:
        yield s[1], s[0], p, o[1], o[0], o[2], o[3]


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Statements of N-Triples files; a line that is neither one nor blank nor a comment fails."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda n: F.regexp_extract("value", _NT, n)
    bad = F.raise_error(F.concat(F.lit("no statement: "), F.col("value")))
    kind = lambda x: F.when(x.startswith("<"), "iri").when(x.startswith("_:"), "blank").otherwise("literal")
    bare = lambda x: F.when(x.startswith("<") | x.startswith('"'), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    s, o = F.when(F.col("value").rlike(_NT), part(1)).otherwise(bad), part(3)
    typed, lang = F.nullif(part(4), F.lit("")), F.nullif(part(5), F.lit(""))
    given = F.when(o.startswith('"'), F.coalesce(typed, F.when(lang.isNotNull(), F.lit(RDF + "langString")).otherwise(F.lit(XSD + "string"))))
    return lines.select(bare(s).alias("s"), kind(s).alias("s_kind"), part(2).alias("p"), bare(o).alias("o"), kind(o).alias("o_kind"), given.alias("datatype"), F.lower(lang).alias("lang"))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Statements of Turtle files, each parsed whole by one task."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.md5("value").alias("name"))

    def run(batches):
        for pdf in batches:
            for text, name in zip(pdf["value"], pdf["name"], strict=True):
                yield pd.DataFrame(list(parse_turtle(text, name[:8])), columns=[x.split()[0] for x in STATEMENT.split(", ")], dtype=object)

    return files.mapInPandas(run, STATEMENT)


def shape_nodes(graph: DataFrame) -> DataFrame:
    """The terms that name shapes: what has a path, is typed as a shape or is said to be a property of one."""
    p, o = F.col("p"), F.col("o")
    term = F.when((p == SHACL + "path") | (p == RDF + "type") & o.isin(*SHAPES), F.col("s")).when(p == SHACL + "property", o)
    return graph.select(term.alias("s")).where("s IS NOT NULL").distinct()


def category() -> Column:
    """The category of a statement (with `in_shape`: its subject or object names a shape); the first that applies."""
    p, o, kind = F.col("p"), F.col("o"), F.col("o_kind")
    typed = p == RDF + "type"
    cases = {
        "class_hierarchy": p == RDFS + "subClassOf",
        "class_disjointness": p == OWL + "disjointWith",
        "schema_declaration": typed & o.isin(*DECLARED),
        "shacl_shape": F.col("in_shape") | p.startswith(SHACL) | o.isin(*SHAPES),
        "provenance_or_mapping": p.isin(*PROVENANCE) | p.startswith(PROV),
        "annotation": p.isin(*ANNOTATIONS),
        "instance_type": typed,
        "abox_datatype_fact": kind == "literal",
        "abox_object_fact": kind.isin("iri", "blank"),
    }
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in cases.items()], F.lit("unsupported_or_other"))


def node_key(kind: Column, value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """Sorts literals, blank nodes and resources apart, each by its text."""
    none = F.lit("")
    whole = F.concat_ws("\0", F.lit("literal"), value, F.coalesce(datatype, none), F.coalesce(lang, none)) if datatype is not None else F.lit(None)
    return F.when(kind == "literal", whole).when(kind == "blank", F.concat_ws("\0", F.lit("blank"), F.regexp_replace(value, "^_:", ""))).otherwise(F.concat_ws("\0", F.lit("resource"), value))


def classified(graph: DataFrame) -> DataFrame:
    """Distinct statements with category, canonical sort key and hash."""
    shape = lambda name: shape_nodes(graph).select(F.col("s").alias(name))
    rows = graph.distinct().join(shape("_one"), F.col("s") == F.col("_one"), "left").join(shape("_two"), F.col("o") == F.col("_two"), "left")
    rows = rows.withColumn("in_shape", F.col("_one").isNotNull() | F.col("_two").isNotNull()).drop("_one", "_two")
    keys = F.array(node_key(F.col("s_kind"), F.col("s")), node_key(F.lit("iri"), F.col("p")), node_key(F.col("o_kind"), F.col("o"), F.col("datatype"), F.col("lang")))
    return rows.withColumn("category", category()).drop("in_shape").withColumn("sort_key", keys).withColumn("statement_hash", F.sha2(F.concat_ws("\x1f", keys), 256))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 1 in the order of columns, without bringing all rows to one task.

    Rows are dealt to ranges whose bounds, some keys of a sample, are written into the plan: a row's range is a function
    of its key, so a task that runs again deals alike. Each range is numbered by itself and starts after the counts of
    those before, of which there is one row a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    n = df.count()
    some = sorted(df.select(*order).sample(min(1.0, 64 * parts / n), 7).collect()) if n else []  # some 64 keys a range
    bounds = [F.struct(*[_constant(v).alias(c) for c, v in zip(order, some[k * len(some) // parts], strict=True)]) for k in range(1, parts) if some]
    part = F.size(F.filter(F.array(*bounds), lambda x: x <= key)) if bounds else F.lit(0)
    dealt = df.withColumn("_part", part)
    within = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_count")).select("_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    return within.join(counts, "_part").withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def _constant(value) -> Column:
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def archive(statements: DataFrame) -> dict[str, DataFrame]:
    """term, literal and statement tables: terms and literals numbered by first appearance in canonical order.

    The tables read each other, so each is written once (lineage.cut).
    """
    rows = cut(numbered(cut(statements), ["sort_key"], "statement_id").drop("sort_key"))
    at = F.col("statement_id") * 3
    kind = lambda k: F.when(F.col(k) == "blank", "blank_node").otherwise("iri")
    uses = rows.select(F.explode(F.array(F.struct(at.alias("at"), F.col("s").alias("value"), kind("s_kind").alias("kind")), F.struct((at + 1).alias("at"), F.col("p").alias("value"), F.lit("iri").alias("kind")), F.struct((at + 2).alias("at"), F.when(F.col("o_kind") != "literal", F.col("o")).alias("value"), kind("o_kind").alias("kind")))).alias("x")).select("x.*").where("value IS NOT NULL")
    term = cut(numbered(uses.groupBy("value", "kind").agg(F.min("at").alias("first")), ["first"], "term_id").select("term_id", "value", "kind", F.col("value").alias("display")))
    said = rows.where("o_kind = 'literal'").groupBy(F.col("o").alias("lexical_form"), "datatype", "lang").agg(F.min("statement_id").alias("first"))
    literal = cut(numbered(said, ["first"], "literal_id").select("literal_id", "lexical_form", F.col("datatype").alias("datatype_iri"), "lang", parsed_value(F.col("lexical_form"), F.col("datatype")).alias("parsed_value")))
    ids = lambda name: term.select(F.col("term_id").alias(f"{name}_id"), F.col("value").alias(f"_{name}"))
    linked = rows.join(ids("subject"), F.col("s") == F.col("_subject")).join(ids("predicate"), F.col("p") == F.col("_predicate")).join(ids("object"), (F.col("o") == F.col("_object")) & (F.col("o_kind") != "literal"), "left")
    own = literal.select("literal_id", F.col("lexical_form").alias("_form"), F.col("datatype_iri").alias("_type"), F.col("lang").alias("_lang"))
    same = (F.col("o_kind") == "literal") & (F.col("o") == F.col("_form")) & F.col("datatype").eqNullSafe(F.col("_type")) & F.col("lang").eqNullSafe(F.col("_lang"))
    statement = linked.join(own, same, "left").select("statement_id", "subject_id", "predicate_id", F.when(F.col("o_kind") == "literal", "literal").otherwise("resource").alias("object_kind"), "object_id", "literal_id", "category", "statement_hash")
    return {"term": term, "literal": literal, "statement": cut(statement)}


def compact(iri: Column) -> Column:
    """The part of an IRI after its last / and #; of the known vocabularies with their prefix before it."""
    out = F.regexp_replace(F.regexp_replace(iri, "^.*/", ""), "^.*#", "")
    for name, space in PREFIXES.items():
        out = F.when(iri.startswith(space), F.concat(F.lit(f"{name}_"), F.substr(iri, F.lit(len(space) + 1)))).otherwise(out)
    return out


def parsed_value(text: Column, datatype: Column) -> Column:
    """Integers without leading zeros, floating numbers in Java's form, truth values as True or False; other text as it stands."""
    whole = datatype.isin(*[XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")])
    real = datatype.isin(XSD + "double", XSD + "float")
    truth = F.when(text.isin("true", "1"), "True").when(text.isin("false", "0"), "False").otherwise(text)
    return F.when(whole, F.when(text.rlike(r"^[+-]?\d+$"), F.coalesce(text.try_cast("decimal(38,0)").cast("string"), text)).otherwise(text)).when(real, F.coalesce(text.try_cast("double").cast("string"), text)).when(datatype == XSD + "boolean", truth).otherwise(text)


def _identifier(name: Column) -> Column:
    """ASCII letters, digits and _ alone, none of the latter at the ends, no digit first, at most 110 characters."""
    plain = F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z_]", "_"), "^_+|_+$", "")
    return F.substr(F.when(plain == "", "predicate").when(plain.rlike("^[0-9]"), F.concat(F.lit("p_"), plain)).otherwise(plain), F.lit(1), F.lit(110))


def table_name(iri: Column) -> Column:
    """The name that a predicate's table has if no other has it."""
    return _identifier(compact(iri))


def predicate_tables(statements: DataFrame) -> DataFrame:
    """(p, literal, table_name): a table for each predicate and kind of object, named in the statements' order.

    Predicates of resources come first. The first of one name has it, unless it is reserved; later ones get the first 8
    digits of their hash behind it. A predicate of literals tries its name, then that with _literal, then the hash.
    """
    facts = statements.where(F.col("category").isin("abox_object_fact", "abox_datatype_fact"))
    kinds = facts.groupBy("p", (F.col("category") == "abox_datatype_fact").alias("literal")).agg(F.min("sort_key").alias("first")).withColumn("base", table_name(F.col("p")))
    taken = kinds.where("NOT literal").select("base").distinct().withColumn("taken", F.lit(1))
    kept = F.col("base").isin(*RESERVED)
    turn = F.row_number().over(Window.partitionBy("base", "literal").orderBy("first")) + F.when(kept | F.col("literal") & F.col("taken").isNotNull(), 1).otherwise(0)
    second = _identifier(F.concat("base", F.lit("_literal")))
    rest = taken.select(F.col("base").alias("other"), F.col("taken").alias("other_taken"))
    ranked = kinds.join(taken, "base", "left").withColumn("turn", turn).withColumn("second", second).join(rest, F.col("second") == F.col("other"), "left")
    behind = lambda name: F.concat(name, F.lit("_"), F.substr(F.sha2("p", 256), F.lit(1), F.lit(8)))
    name = F.when(F.col("turn") == 1, F.col("base")).when(~F.col("literal"), behind(F.col("base"))).when((F.col("turn") == 2) & F.col("other_taken").isNull(), F.col("second")).otherwise(behind(F.col("second")))
    return ranked.select("p", "literal", name.alias("table_name"))


def star_tables(statements: DataFrame, name: str, archived: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a variant, all by ids: entity, literal, class, rdf_type, rdfs_subClassOf, object_fact, literal_fact.

    The facts carry predicate_table, the name of the table of their predicate; rdfs_subClassOf is there if the variant
    has the hierarchy.
    """
    of = archived or archive(statements)
    rows = of["statement"].where(F.col("category").isin(*VARIANTS[name]))
    kind = lambda c: rows.where(F.col("category") == c)
    typed, objects, literals, above = (kind(c) for c in ("instance_type", "abox_object_fact", "abox_datatype_fact", "class_hierarchy"))
    ids = lambda *parts: reduce(DataFrame.union, [df.select(F.col(c).alias("id")) for df, c in parts]).where("id IS NOT NULL").distinct()
    term, literal = of["term"], of["literal"]
    entity = term.join(ids((typed, "subject_id"), (objects, "subject_id"), (literals, "subject_id"), (objects, "object_id")), F.col("term_id") == F.col("id")).select(F.col("term_id").alias("entity_id"), F.col("value").alias("iri"), F.col("kind").alias("term_kind"))
    classes = term.join(ids((typed, "object_id"), (above, "subject_id"), (above, "object_id")), F.col("term_id") == F.col("id")).select(F.col("term_id").alias("class_id"), F.col("value").alias("iri"))
    tables = predicate_tables(statements)
    named = tables.join(term.select(F.col("term_id").alias("predicate_id"), F.col("value").alias("p")), "p").select("predicate_id", "literal", F.col("table_name").alias("predicate_table"))
    fact = lambda df, is_literal: df.join(named.where(F.col("literal") == is_literal).drop("literal"), "predicate_id")
    out = {
        "entity": entity,
        "literal": literal.join(ids((literals, "literal_id")), F.col("literal_id") == F.col("id")).drop("id"),
        "class": classes,
        "rdf_type": typed.select("statement_id", "subject_id", F.col("object_id").alias("class_id")),
        "object_fact": fact(objects, False).select("predicate_table", "statement_id", "subject_id", "object_id"),
        "literal_fact": fact(literals, True).join(literal.select("literal_id", F.col("lexical_form").alias("raw_lexical"), "parsed_value"), "literal_id").select("predicate_table", "statement_id", "subject_id", "literal_id", "raw_lexical", "parsed_value"),
    }
    hierarchy = above.select("statement_id", F.col("subject_id").alias("subclass_id"), F.col("object_id").alias("superclass_id"))
    return out | ({"rdfs_subClassOf": hierarchy} if "class_hierarchy" in VARIANTS[name] else {})


def graph_lines(statements: DataFrame, name: str, archived: dict[str, DataFrame] | None = None) -> DataFrame:
    """(statement_id, line): the variant as tab-separated lines; a literal is named by its id, so no text breaks a line."""
    of = archived or archive(statements)
    term = lambda side: of["term"].select(F.col("term_id").alias(f"{side}_id"), F.col("value").alias(side))
    rows = of["statement"].where(F.col("category").isin(*VARIANTS[name])).join(term("subject"), "subject_id").join(term("predicate"), "predicate_id").join(term("object"), "object_id", "left")
    return rows.select("statement_id", F.concat_ws("\t", "subject", "predicate", F.coalesce("object", F.concat(F.lit("literal:"), F.col("literal_id").cast("string")))).alias("line"))


def decisions(variants: list[str] | None = None) -> list[tuple[str, str, int, str]]:
    """(variant, category, included, reason) of every variant and category."""
    return [(v, c, int(c in VARIANTS[v]), "selected for variant" if c in VARIANTS[v] else "preserved in archive only") for v in variants or VARIANTS for c in CATEGORIES]


def write_archive(statements: DataFrame, graph: DataFrame, path: str, metadata: dict[str, str] | None = None, namespaces: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The archive's seven tables as Parquet; returns term, literal and statement as they were written."""
    spark, of = statements.sparkSession, archive(statements)
    shapes = shape_properties(graph)
    as_json = lambda c: F.to_json(c).alias(c)
    rest = {
        "namespace": spark.createDataFrame(sorted((namespaces or PREFIXES).items()), "prefix string, iri string"),
        "shape_property": shapes.select("shape_iri", "path_iri", as_json("class_iris"), as_json("datatype_iris"), "min_count", "max_count", as_json("labels"), as_json("comments")),
        "transformation_decision": spark.createDataFrame(decisions(), "variant string, category string, included int, reason string"),
    }
    for name, df in (of | rest).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    written = {name: spark.read.parquet(f"{path}/{name}") for name in of}
    said = {"parser": "rulequarry", "statement_count": str(written["statement"].count())} | (metadata or {})
    spark.createDataFrame(sorted(said.items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/import_metadata")
    return written


def write_variant(statements: DataFrame, name: str, path: str, archived: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """The variant's tables as Parquet, facts in a folder for each predicate's table, and the graph as lines; rows by table."""
    counts = {}
    for table, df in star_tables(statements, name, archived).items():
        to = df.write.mode("overwrite")
        (to.partitionBy("predicate_table") if table.endswith("_fact") else to).parquet(f"{path}/tables/{table}")
        counts[table] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/tables/{table}").count()
    parts = int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graph_lines(statements, name, archived).repartitionByRange(parts, "statement_id").sortWithinPartitions("statement_id").select("line").write.mode("overwrite").text(f"{path}/graph.tsv")
    return counts


def shape_properties(graph: DataFrame) -> DataFrame:
    """(shape_iri, path_iri, class_iris, datatype_iris, min_count, max_count, labels, comments) of property shapes.

    The items of sh:or lists add their classes and datatypes. Each cell of a list is visited once, so a list that runs
    in a circle ends. Of several paths the smallest stands.
    """
    path = graph.where(F.col("p") == SHACL + "path").groupBy(F.col("s").alias("shape_iri")).agg(F.min("o").alias("path_iri"))
    options = graph.where(F.col("p") == SHACL + "or").select(F.col("s").alias("shape_iri"), F.col("o").alias("cell"))
    cells = graph.where(F.col("p") == RDF + "rest").select(F.col("s").alias("cell"), F.col("o").alias("next"))
    items = graph.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    reached, step = options, options
    while not (step := step.join(cells, "cell").where(F.col("next") != RDF + "nil").select("shape_iri", F.col("next").alias("cell")).distinct().join(reached, ["shape_iri", "cell"], "left_anti")).isEmpty():
        reached = reached.union(step)
    own = graph.select(F.col("s").alias("node"), "p", "o", F.lit(True).alias("own"))
    said = path.select("shape_iri", F.col("shape_iri").alias("node")).join(own, "node").union(reached.join(items, "cell").select("shape_iri", F.col("item").alias("node")).join(own.withColumn("own", F.lit(False)), "node").select("node", "shape_iri", "p", "o", "own"))
    pick = lambda n, where=F.lit(True): F.array_sort(F.collect_set(F.when((F.col("p") == n) & where, F.col("o"))))
    count = lambda n: F.max(F.when((F.col("p") == SHACL + n) & F.col("own"), F.col("o").try_cast("int")))
    found = said.groupBy("shape_iri").agg(pick(SHACL + "class").alias("class_iris"), pick(SHACL + "datatype").alias("datatype_iris"), count("minCount").alias("min_count"), count("maxCount").alias("max_count"), pick(RDFS + "label", F.col("own")).alias("labels"), pick(RDFS + "comment", F.col("own")).alias("comments"))
    return path.join(found, "shape_iri")
