"""Relational tables seen as triples, and the registered reasoning queries over them with their SQL.

Every query derives facts from whole tables, reasons with a small ontology and returns all it infers as (s, p, o), or the violations
found as (kind, a, b, c, d).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornloom.operators.dictionary import build, decode, encode
from hornloom.operators.equality import components
from hornloom.plans.reason import InconsistencyError, Options, Result, reason
from hornloom.sources.ofn import parse_functional
from hornloom.terms import RDFS, SAME_AS, TYPE

NS = "urn:t:"


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"<{NS}{kind}/"), F.col(key).cast("string") if isinstance(key, str) else key, F.lit(">"))


def name(x: str) -> str:
    return f"<{NS}{x}>"


def text(key: str) -> Column:
    return F.concat(F.lit('"'), F.col(key), F.lit('"'))


def _t(df: DataFrame, s: Column, p: str, o: Column | str) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p if p.startswith("<") else name(p)).alias("p"), (F.lit(name(o)) if isinstance(o, str) else o).alias("o"))


class Facts:
    """The triples of the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")

    def nations(self) -> DataFrame:
        return _t(self.read("nation"), node("nation", "n_nationkey"), "locatedIn", node("region", "n_regionkey"))

    def customers(self) -> DataFrame:
        return _t(self.read("customer"), node("customer", "c_custkey"), "locatedIn", node("nation", "c_nationkey"))

    def suppliers(self) -> DataFrame:
        return _t(self.read("supplier"), node("supplier", "s_suppkey"), "locatedIn", node("nation", "s_nationkey"))

    def segments(self) -> DataFrame:
        return _t(self.read("customer"), node("customer", "c_custkey"), TYPE, node("segment", F.regexp_replace("c_mktsegment", " ", "_")))

    def status(self) -> DataFrame:
        return _t(self.read("orders"), node("order", "o_orderkey"), TYPE, node("status", "o_orderstatus"))

    def placed(self) -> DataFrame:
        return _t(self.read("orders"), node("order", "o_orderkey"), "placedBy", node("customer", "o_custkey"))

    def contains(self) -> DataFrame:
        return _t(self.read("lineitem"), node("order", "l_orderkey"), "contains", node("part", "l_partkey"))

    def supplied(self) -> DataFrame:
        return _t(self.read("lineitem"), node("order", "l_orderkey"), "suppliedBy", node("supplier", "l_suppkey"))

    def brands(self) -> DataFrame:
        return _t(self.read("part"), node("part", "p_partkey"), "brand", text("p_brand"))

    def part_types(self) -> DataFrame:
        return _t(self.read("part"), node("part", "p_partkey"), "ptype", text("p_type"))

    def part_names(self) -> DataFrame:
        return _t(self.read("part"), node("part", "p_partkey"), "name", text("p_name"))

    def parts(self) -> DataFrame:
        return _t(self.read("part"), node("part", "p_partkey"), TYPE, "Part")

    def performed(self) -> DataFrame:
        return _t(self.read("events"), node("event", "event_id"), "performedBy", node("user", "user_id"))

    def hashes(self) -> DataFrame:
        return _t(self.read("documents"), node("document", "doc_id"), "contentHash", node("hash", F.md5("text")))

    def hash_of(self) -> DataFrame:
        return _t(self.read("documents"), node("hash", F.md5("text")), "hashOf", node("document", "doc_id"))


def ontology(axioms: str) -> list[tuple]:
    return parse_functional(f"Prefix(:=<{NS}>) Prefix(owl:=<http://www.w3.org/2002/07/owl#>) Ontology(<{NS}o> {axioms})")


@dataclass(frozen=True)
class Query:
    facts: tuple[str, ...]
    axioms: str
    sql: str | None
    what: str = "inferred"
    sound: bool = False

    def result(self, spark: SparkSession, sf_dir: str) -> Result:
        f = Facts(spark, sf_dir)
        triples = None
        for n in self.facts:
            part = getattr(f, n)()
            triples = part if triples is None else triples.unionByName(part)
        return reason(spark, triples, ontology(self.axioms), Options(sound=self.sound))

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        r = self.result(spark, sf_dir)
        return r.inferred() if self.what == "inferred" else r.closure() if self.what == "closure" else r.inconsistencies()


def _n(kind: str, key: str) -> str:
    return f"'<{NS}{kind}/' || {key} || '>'"


def _c(x: str) -> str:
    return f"'{x if x.startswith('<') else name(x)}'"


def _row(s: str, p: str, o: str, rest: str) -> str:
    return f"SELECT DISTINCT {s} AS s, {_c(p)} AS p, {o} AS o FROM {rest}"


_CUST, _ORDER, _NATION, _REGION = _n("customer", "c_custkey"), _n("order", "o_orderkey"), _n("nation", "n_nationkey"), _n("region", "n_regionkey")
_SEG = _n("segment", "replace(c_mktsegment, ' ', '_')")
_LOCATED = f"(SELECT {_CUST} AS s, {_n('nation', 'c_nationkey')} AS o FROM customer UNION SELECT {_n('supplier', 's_suppkey')}, {_n('nation', 's_nationkey')} FROM supplier UNION SELECT {_NATION}, {_REGION} FROM nation)"
_DOC, _HASH = _n("document", "doc_id"), _n("hash", "md5(text)")
_TWINS = "documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id <> b.doc_id"
_KEYED = "part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey"


def _violation(kind: str, rest: str, *ends: str) -> str:
    cols = [*ends, *["CAST(NULL AS VARCHAR)"] * (4 - len(ends))]
    return f"SELECT DISTINCT '{kind}' AS kind, {', '.join(f'{e} AS {c}' for e, c in zip(cols, 'abcd', strict=True))} FROM {rest}"


QUERIES: dict[str, Query] = {
    "r01_subclass": Query(("segments",), "SubClassOf(<urn:t:segment/BUILDING> :Business) SubClassOf(<urn:t:segment/MACHINERY> :Business) SubClassOf(:Business :Agent) SubClassOf(:Agent :Actor) SubClassOf(:Actor :Agent)",
        "SELECT s, p, unnest([" + ", ".join(_c(x) for x in ("Business", "Agent", "Actor")) + f"]) AS o FROM (SELECT {_CUST} AS s, {_c(TYPE)} AS p FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"),
    "r02_universal": Query(("nations", "customers"), "SubClassOf(owl:Thing :Entity)",
        f"SELECT s, {_c(TYPE)} AS p, {_c('Entity')} AS o FROM (SELECT {_CUST} AS s FROM customer UNION SELECT {_n('nation', 'c_nationkey')} FROM customer UNION SELECT {_NATION} FROM nation UNION SELECT {_REGION} FROM nation)"),
    "r03_subproperty": Query(("contains",), "SubObjectPropertyOf(:contains :involves) SubObjectPropertyOf(:involves :relates)",
        " UNION ALL ".join(_row(_n("order", "l_orderkey"), p, _n("part", "l_partkey"), "lineitem") for p in ("involves", "relates"))),
    "r04_domain_r05_range": Query(("placed",), "ObjectPropertyDomain(:placedBy :Order) ObjectPropertyRange(:placedBy :Buyer)",
        _row(_ORDER, TYPE, _c("Order"), "orders") + " UNION ALL " + _row(_n("customer", "o_custkey"), TYPE, _c("Buyer"), "orders")),
    "r06_inverse_r07_symmetric": Query(("nations", "customers"), "InverseObjectProperties(:locatedIn :locationOf) SubObjectPropertyOf(:locatedIn :near) SymmetricObjectProperty(:near)",
        f"WITH e AS (SELECT {_CUST} AS s, {_n('nation', 'c_nationkey')} AS o FROM customer UNION SELECT {_NATION}, {_REGION} FROM nation) SELECT o AS s, {_c('locationOf')} AS p, s AS o FROM e UNION ALL SELECT s, {_c('near')}, o FROM e UNION ALL SELECT o, {_c('near')}, s FROM e"),
    "r08_has_value_r10": Query(("brands", "segments"), 'SubClassOf(DataHasValue(:brand "Brand#11") :EliteBrand) SubClassOf(<urn:t:segment/BUILDING> ObjectHasValue(:handledBy :desk1))',
        _row(_n("part", "p_partkey"), TYPE, _c("EliteBrand"), "part WHERE p_brand = 'Brand#11'") + " UNION ALL " + _row(_CUST, "handledBy", _c("desk1"), "customer WHERE c_mktsegment = 'BUILDING'")),
    "r09_existence": Query(("performed",), "SubClassOf(ObjectSomeValuesFrom(:performedBy owl:Thing) :Action)", _row(_n("event", "event_id"), TYPE, _c("Action"), "events")),
    "r11_intersection_parts": Query(("segments",), "SubClassOf(<urn:t:segment/BUILDING> :Both) SubClassOf(ObjectIntersectionOf(:Left :Right) :Both)",
        f"SELECT s, p, unnest([{_c('Both')}, {_c('Left')}, {_c('Right')}]) AS o FROM (SELECT {_CUST} AS s, {_c(TYPE)} AS p FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "r12_intersection": Query(("placed", "status"), "InverseObjectProperties(:placedBy :placed) SubClassOf(ObjectSomeValuesFrom(:placed <urn:t:status/F>) :Finisher) SubClassOf(ObjectSomeValuesFrom(:placed <urn:t:status/O>) :Opener) SubClassOf(ObjectIntersectionOf(:Finisher :Opener) :Active)",
        f"WITH x AS (SELECT {_n('customer', 'o_custkey')} AS s, {_ORDER} AS o, o_orderstatus AS st FROM orders) SELECT DISTINCT s, {_c('placed')} AS p, o FROM x UNION ALL SELECT DISTINCT s, {_c(TYPE)}, {_c('Finisher')} FROM x WHERE st = 'F' UNION ALL SELECT DISTINCT s, {_c(TYPE)}, {_c('Opener')} FROM x WHERE st = 'O' UNION ALL SELECT s, {_c(TYPE)}, {_c('Active')} FROM x WHERE st IN ('F', 'O') GROUP BY s HAVING count(DISTINCT st) = 2", sound=True),
    "r13_all_values": Query(("placed", "segments"), "InverseObjectProperties(:placedBy :placed) SubClassOf(<urn:t:segment/BUILDING> ObjectAllValuesFrom(:placed :BuildingOrder))",
        f"SELECT {_n('customer', 'o_custkey')} AS s, {_c('placed')} AS p, {_ORDER} AS o FROM orders UNION ALL " + _row(_ORDER, TYPE, _c("BuildingOrder"), "orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")),
    "r14_some_values": Query(("placed", "segments"), "SubClassOf(ObjectSomeValuesFrom(:placedBy <urn:t:segment/MACHINERY>) :MachineOrder)", _row(_ORDER, TYPE, _c("MachineOrder"), "orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")),
    "r15_transitive": Query(("nations", "customers", "suppliers"), "TransitiveObjectProperty(:locatedIn)",
        f"WITH RECURSIVE e AS {_LOCATED}, t AS (SELECT s, o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, {_c('locatedIn')} AS p, o FROM (SELECT s, o FROM t EXCEPT SELECT s, o FROM e)"),
    "r16_chain_two": Query(("placed", "customers"), "SubObjectPropertyOf(ObjectPropertyChain(:placedBy :locatedIn) :originatesIn)", _row(_ORDER, "originatesIn", _n("nation", "c_nationkey"), "orders JOIN customer ON o_custkey = c_custkey")),
    "r16_chain_three": Query(("placed", "customers", "nations"), "SubObjectPropertyOf(ObjectPropertyChain(:placedBy :locatedIn :locatedIn) :regionOfOrder)", _row(_ORDER, "regionOfOrder", _REGION, "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")),
    "r16_chain_recursive": Query(("placed", "customers", "nations"), "SubObjectPropertyOf(ObjectPropertyChain(:placedBy :locatedIn) :placedBy)",
        f"SELECT {_ORDER} AS s, {_c('placedBy')} AS p, {_n('nation', 'c_nationkey')} AS o FROM orders JOIN customer ON o_custkey = c_custkey UNION " + _row(_ORDER, "placedBy", _REGION, "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")),
    "w1_swrl_join": Query(("placed", "customers", "segments"), "DLSafeRule(Body(ObjectPropertyAtom(:placedBy Variable(:o) Variable(:c)) ClassAtom(<urn:t:segment/BUILDING> Variable(:c)) ObjectPropertyAtom(:locatedIn Variable(:c) Variable(:n))) Head(ObjectPropertyAtom(:servesNation Variable(:o) Variable(:n)) ClassAtom(:BuildingOrder Variable(:o))))",
        _row(_ORDER, "servesNation", _n("nation", "c_nationkey"), "orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'") + " UNION ALL " + _row(_ORDER, TYPE, _c("BuildingOrder"), "orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")),
    "w5_swrl_same": Query(("hashes",), "InverseFunctionalObjectProperty(:contentHash) DLSafeRule(Body(SameIndividualAtom(Variable(:x) Variable(:y))) Head(ObjectPropertyAtom(:copyOf Variable(:x) Variable(:y))))",
        f"SELECT {_n('document', 'a.doc_id')} AS s, unnest([{_c(SAME_AS)}, {_c('copyOf')}]) AS p, {_n('document', 'b.doc_id')} AS o FROM {_TWINS} UNION ALL SELECT DISTINCT {_n('document', 'a.doc_id')}, {_c('copyOf')}, {_n('document', 'a.doc_id')} FROM {_TWINS}"),
    "e4_same_as": Query(("hashes",), "DLSafeRule(Body(ObjectPropertyAtom(:contentHash Variable(:x) Variable(:h)) ObjectPropertyAtom(:contentHash Variable(:y) Variable(:h))) Head(SameIndividualAtom(Variable(:x) Variable(:y))))",
        f"SELECT {_n('document', 'a.doc_id')} AS s, {_c(SAME_AS)} AS p, {_n('document', 'b.doc_id')} AS o FROM {_TWINS}", sound=True),
    "e5_functional": Query(("hash_of",), "FunctionalObjectProperty(:hashOf)", f"SELECT {_n('document', 'a.doc_id')} AS s, {_c(SAME_AS)} AS p, {_n('document', 'b.doc_id')} AS o FROM {_TWINS}"),
    "e6_inverse_functional_e10_e11": Query(("hashes",), "InverseFunctionalObjectProperty(:contentHash) ObjectPropertyDomain(:contentHash :Document)",
        f"SELECT {_n('document', 'a.doc_id')} AS s, {_c(SAME_AS)} AS p, {_n('document', 'b.doc_id')} AS o FROM {_TWINS} UNION ALL " + _row(_DOC, TYPE, _c("Document"), "documents")),
    "e7_max_cardinality": Query(("hash_of",), "ObjectPropertyDomain(:hashOf :Hash) SubClassOf(:Hash ObjectMaxCardinality(1 :hashOf))",
        f"SELECT {_n('document', 'a.doc_id')} AS s, {_c(SAME_AS)} AS p, {_n('document', 'b.doc_id')} AS o FROM {_TWINS} UNION ALL " + _row(_HASH, TYPE, _c("Hash"), "documents")),
    "e8_has_key": Query(("parts", "part_names", "brands", "part_types"), "HasKey(:Part () (:name :brand :ptype))", f"SELECT {_n('part', 'a.p_partkey')} AS s, {_c(SAME_AS)} AS p, {_n('part', 'b.p_partkey')} AS o FROM {_KEYED}"),
    "e12_i8_different": Query(("hashes",), "InverseFunctionalObjectProperty(:contentHash) DLSafeRule(Body(ObjectPropertyAtom(:contentHash Variable(:x) Variable(:h)) ObjectPropertyAtom(:contentHash Variable(:y) Variable(:h)) SameIndividualAtom(Variable(:x) Variable(:y))) Head(DifferentIndividualsAtom(Variable(:x) Variable(:y))))",
        _violation("DifferentIndividuals", _TWINS, f"least({_n('document', 'a.doc_id')}, {_n('document', 'b.doc_id')})", f"greatest({_n('document', 'a.doc_id')}, {_n('document', 'b.doc_id')})"), "violations"),
    "n04_equivalent_n06_disjoint_union": Query(("segments",), "EquivalentClasses(<urn:t:segment/BUILDING> :Builder) DisjointUnion(:Known <urn:t:segment/MACHINERY> <urn:t:segment/HOUSEHOLD>)",
        _row(_CUST, TYPE, _c("Builder"), "customer WHERE c_mktsegment = 'BUILDING'") + " UNION ALL " + _row(_CUST, TYPE, _c("Known"), "customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')")),
    "n09_n10_equivalent_properties": Query(("nations", "brands"), "EquivalentObjectProperties(:locatedIn :within) EquivalentDataProperties(:brand :make)",
        _row(_NATION, "within", _REGION, "nation") + " UNION ALL " + _row(_n("part", "p_partkey"), "make", "'\"' || p_brand || '\"'", "part")),
    "n19_n22_annotation_properties": Query(("brands",), "SubAnnotationPropertyOf(:brand :tag) AnnotationPropertyDomain(:tag :Tagged)",
        _row(_n("part", "p_partkey"), "tag", "'\"' || p_brand || '\"'", "part") + " UNION ALL " + _row(_n("part", "p_partkey"), TYPE, _c("Tagged"), "part")),
    "n20_data_domain_s24_literal_types": Query(("brands",), "DataPropertyDomain(:brand :Branded) SubClassOf(DataSomeValuesFrom(:brand <http://www.w3.org/2001/XMLSchema#string>) :Named) SubClassOf(DataSomeValuesFrom(:brand <http://www.w3.org/2001/XMLSchema#integer>) :Numbered)",
        " UNION ALL ".join(_row(_n("part", "p_partkey"), TYPE, _c(x), "part") for x in ("Branded", "Named"))),
    "n23_same_individual_e3": Query(("nations",), "SameIndividual(<urn:t:region/0> <urn:t:region/1>)",
        f"WITH e(a, b) AS (VALUES (0, 1), (1, 0)) SELECT {_n('region', 'a')} AS s, {_c(SAME_AS)} AS p, {_n('region', 'b')} AS o FROM e UNION ALL " + _row(_NATION, "locatedIn", _n("region", "b"), "nation JOIN e ON n_regionkey = a")),
    "n24_different_individuals": Query(("nations",), "SameIndividual(<urn:t:nation/0> <urn:t:nation/1>) DifferentIndividuals(<urn:t:nation/0> <urn:t:nation/1> <urn:t:nation/2>)",
        _violation("DifferentIndividuals", "nation a JOIN nation b ON a.n_nationkey = 0 AND b.n_nationkey = 1", _n("nation", "a.n_nationkey"), _n("nation", "b.n_nationkey")), "violations"),
    "n26_negative_data": Query(("brands",), " ".join(f'NegativeDataPropertyAssertion(:brand <urn:t:part/{k}> "Brand#{b}")' for k in range(8) for b in range(1, 18)),
        _violation("NegativeAssertion", "part WHERE p_partkey < 8 AND CAST(substr(p_brand, 7) AS INTEGER) < 18", _n("part", "p_partkey"), _c("brand"), "'\"' || p_brand || '\"'"), "violations"),
    "n27_n28_n29_own_assertions_s23": Query(("nations",), 'ClassAssertion(:Hub <urn:t:region/0>) ObjectPropertyAssertion(:locatedIn <urn:t:region/0> :World) DataPropertyAssertion(:note <urn:t:region/0> "first") SubClassOf(:Hub :Place) SubDataPropertyOf(:note :label) TransitiveObjectProperty(:locatedIn)',
        f"SELECT {_c('region/0')} AS s, {_c(TYPE)} AS p, {_c('Place')} AS o UNION ALL SELECT {_c('region/0')}, {_c('label')}, '\"first\"' UNION ALL " + _row(_NATION, "locatedIn", _c("World"), "nation WHERE n_regionkey = 0")),
    "n32_disjoint_data_properties": Query(("brands",), "SubDataPropertyOf(:brand :mark) DisjointDataProperties(:brand :mark)",
        _violation("DisjointProperties", "part", _n("part", "p_partkey"), "'\"' || p_brand || '\"'", _c("brand"), _c("mark")), "violations"),
    "n01_n02_n30_n36_n42_n44_no_effect": Query(("nations",), 'Import(<urn:t:elsewhere>) Declaration(Class(:Place)) AnnotationAssertion(:remark :Place "a place") ReflexiveObjectProperty(:locatedIn) SubClassOf(:Place ObjectMinCardinality(2 :locatedIn)) SubClassOf(ObjectAllValuesFrom(:locatedIn :Place) :Never) SubClassOf(:Place ObjectUnionOf(:Left :Right)) ObjectPropertyDomain(:locatedIn :Place)',
        _row(_NATION, TYPE, _c("Place"), "nation")),
    "n31_data_range_k5_literal_subjects": Query(("brands",), "DataPropertyRange(:brand :Tag) SubClassOf(DataSomeValuesFrom(:brand :Tag) :Tagged)", _row(_n("part", "p_partkey"), TYPE, _c("Tagged"), "part")),
    "n33_datatype_definition_n47_data_ranges": Query(("brands",), 'DatatypeDefinition(:Code <http://www.w3.org/2001/XMLSchema#string>) SubClassOf(DataSomeValuesFrom(:brand :Code) :Coded) SubClassOf(DataSomeValuesFrom(:brand DataIntersectionOf(<http://www.w3.org/2001/XMLSchema#string> :Code)) :Both) SubClassOf(DataSomeValuesFrom(:brand DataIntersectionOf(:Code <http://www.w3.org/2001/XMLSchema#integer>)) :Neither) SubClassOf(DataSomeValuesFrom(:brand DataOneOf("Brand#11")) :Never)',
        " UNION ALL ".join(_row(_n("part", "p_partkey"), TYPE, _c(x), "part") for x in ("Coded", "Both"))),
    "n37_nested_expressions_n46_k4_proxies": Query(("placed", "customers"), "SubClassOf(ObjectSomeValuesFrom(:placedBy ObjectIntersectionOf(ObjectHasValue(:locatedIn <urn:t:nation/3>) ObjectSomeValuesFrom(:locatedIn owl:Thing))) ObjectAllValuesFrom(:placedBy :Buyer)) SubClassOf(ObjectSomeValuesFrom(:placedBy ObjectComplementOf(:Buyer)) :Never)",
        _row(_n("customer", "o_custkey"), TYPE, _c("Buyer"), "orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"), "inferred", True),
    "n49_literal_spellings": Query(("brands",), 'SubClassOf(DataHasValue(:brand "Brand#11"^^<http://www.w3.org/2001/XMLSchema#string>) :Eleven) SubClassOf(DataHasValue(:brand "Brand#12"@en) :Never)',
        _row(_n("part", "p_partkey"), TYPE, _c("Eleven"), "part WHERE p_brand = 'Brand#11'")),
    "c3_top_classes": Query(("segments", "nations"), "SubClassOf(<urn:t:segment/BUILDING> owl:Thing) ObjectPropertyDomain(:locatedIn owl:Thing) ObjectPropertyRange(:locatedIn owl:Thing) SubClassOf(ObjectIntersectionOf(owl:Thing <urn:t:segment/BUILDING>) :Builder) SubClassOf(<urn:t:segment/MACHINERY> ObjectAllValuesFrom(:locatedIn owl:Thing))",
        _row(_CUST, TYPE, _c("Builder"), "customer WHERE c_mktsegment = 'BUILDING'"), "inferred", True),
    "n43_union_one_of": Query(("segments", "nations"), "SubClassOf(ObjectUnionOf(<urn:t:segment/BUILDING> <urn:t:segment/MACHINERY>) :Either) SubClassOf(ObjectSomeValuesFrom(:locatedIn ObjectOneOf(<urn:t:region/1> <urn:t:region/2>)) :Chosen)",
        _row(_CUST, TYPE, _c("Either"), "customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')") + " UNION ALL " + _row(_NATION, TYPE, _c("Chosen"), "nation WHERE n_regionkey IN (1, 2)")),
    "i6_asymmetric_n35": Query(("nations",), "SubObjectPropertyOf(:locatedIn :near) SymmetricObjectProperty(:near) AsymmetricObjectProperty(:near)", _violation("Asymmetric", "nation", f"least({_NATION}, {_REGION})", f"greatest({_NATION}, {_REGION})", _c("near")), "violations"),
    "e12_different_by_properties": Query(("hashes", "nations"), "SameIndividual(<urn:t:region/0> <urn:t:region/1>) ObjectPropertyAssertion(:avoids <urn:t:nation/0> <urn:t:region/0>) ObjectPropertyAssertion(:avoids <urn:t:nation/0> <urn:t:region/1>) DisjointObjectProperties(:locatedIn :avoids)",
        "SELECT * FROM (" + _violation("DifferentIndividuals", "nation WHERE n_nationkey = 0 AND n_regionkey IN (0, 1)", _c("region/0"), _c("region/1")) + ") UNION ALL SELECT * FROM ("
        + _violation("DisjointProperties", "nation, (VALUES (0), (1)) AS e(x) WHERE n_nationkey = 0 AND n_regionkey IN (0, 1)", _NATION, _n("region", "x"), _c("locatedIn"), _c("avoids")) + ")", "violations"),
    "i1_disjoint_classes": Query(("segments",), "SubClassOf(<urn:t:segment/BUILDING> :A) SubClassOf(<urn:t:segment/BUILDING> :B) DisjointClasses(:A :B :C)", _violation("DisjointClasses", "customer WHERE c_mktsegment = 'BUILDING'", _CUST, _c("A"), _c("B")), "violations"),
    "i2_complement": Query(("segments",), "SubClassOf(<urn:t:segment/BUILDING> :A) SubClassOf(:A ObjectComplementOf(<urn:t:segment/BUILDING>))", _violation("ComplementOf", "customer WHERE c_mktsegment = 'BUILDING'", _CUST, _c("A"), _c("segment/BUILDING")), "violations"),
    "i3_disjoint_properties": Query(("contains",), "SubObjectPropertyOf(:contains :has) DisjointObjectProperties(:contains :has)", _violation("DisjointProperties", "lineitem", _n("order", "l_orderkey"), _n("part", "l_partkey"), _c("contains"), _c("has")), "violations"),
    "i4_max_cardinality_zero": Query(("placed", "status"), "SubClassOf(<urn:t:status/P> ObjectMaxCardinality(0 :placedBy))", _violation("MaxCardinalityZero", "orders WHERE o_orderstatus = 'P'", _ORDER, _c("status/P"), _n("customer", "o_custkey"), _c("placedBy")), "violations"),
    "i5_irreflexive": Query(("placed",), "SubObjectPropertyOf(ObjectPropertyChain(:placedBy ObjectInverseOf(:placedBy)) :sameBuyer) IrreflexiveObjectProperty(:sameBuyer)", _violation("Irreflexive", "orders", _ORDER, _c("sameBuyer")), "violations"),
    "i7_negative": Query(("nations",), "NegativeObjectPropertyAssertion(:locatedIn <urn:t:nation/0> <urn:t:region/0>) NegativeObjectPropertyAssertion(:locatedIn <urn:t:nation/1> <urn:t:region/0>)",
        _violation("NegativeAssertion", "nation WHERE n_nationkey IN (0, 1) AND n_regionkey = 0", _NATION, _c("locatedIn"), _REGION), "violations"),
    "i9_literal_conflict": Query(("part_names", "brands"), "SubDataPropertyOf(:name :label) SubDataPropertyOf(:brand :label) FunctionalDataProperty(:label)",
        _violation("LiteralConflict", "part", _n("part", "p_partkey"), "least('\"' || p_name || '\"', '\"' || p_brand || '\"')", "greatest('\"' || p_name || '\"', '\"' || p_brand || '\"')", _c("label")), "violations"),
    "k3_closure": Query(("nations",), "TransitiveObjectProperty(:locatedIn) InverseObjectProperties(:locatedIn :locationOf)",
        f"SELECT {_NATION} AS s, {_c('locatedIn')} AS p, {_REGION} AS o FROM nation UNION ALL SELECT {_REGION}, {_c('locationOf')}, {_NATION} FROM nation", "closure"),
}


def s20_schema_in_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema comes out of the data: segments are subclasses of Business, and locatedIn has a domain."""
    f = Facts(spark, sf_dir)
    seg = f.segments().select("o").distinct().select(F.col("o").alias("s"), F.lit(f"<{RDFS}subClassOf>").alias("p"), F.lit(name("Business")).alias("o"))
    domain = spark.createDataFrame([(name("locatedIn"), f"<{RDFS}domain>", name("Place"))], "s string, p string, o string")
    return reason(spark, f.segments().unionByName(f.customers()).unionByName(seg).unionByName(domain)).inferred()


def d1_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding to ids and decoding gives the triples back."""
    triples = Facts(spark, sf_dir).placed().unionByName(Facts(spark, sf_dir).brands())
    return decode(encode(triples), build(triples))


def e1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of customers and their orders, by least key (orders count from a million million)."""
    edges = Facts(spark, sf_dir).read("orders").select((F.col("o_orderkey") + 10**12).alias("a"), F.col("o_custkey").alias("b"))
    return components(edges)


def r15_long_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitive closure of each user's order of events: the flagship for long paths."""
    from pyspark.sql import Window

    events = Facts(spark, sf_dir).read("events")
    after = events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n")).where("n is not null")
    triples = _t(after, node("event", "event_id"), "before", node("event", "n"))
    return reason(spark, triples, ontology("TransitiveObjectProperty(:before)")).inferred()


def i11_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations as readable text."""
    return QUERIES["i1_disjoint_classes"].result(spark, sf_dir).messages()


def _error(spark: SparkSession, run: Callable[[], object], kind: type[Exception]) -> DataFrame:
    """The message of the error that the run ends with; no row if it ends well."""
    try:
        run()
    except kind as e:
        return spark.createDataFrame([(str(e),)], "message string")
    return spark.createDataFrame([], "message string")


def i10_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that may not go on with violations ends with their kinds and numbers."""
    q = QUERIES["i1_disjoint_classes"]
    return _error(spark, lambda: reason(spark, Facts(spark, sf_dir).segments(), ontology(q.axioms), Options(inconsistency="halt")), InconsistencyError)


def f13_round_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of one round, where facts are derived from derived ones."""
    f = Facts(spark, sf_dir)
    triples = f.customers().unionByName(f.nations())
    return _error(spark, lambda: reason(spark, triples, ontology("TransitiveObjectProperty(:locatedIn) ObjectPropertyDomain(:locatedIn :Place) SubClassOf(:Place :Spot)"), Options(max_rounds=1)), RuntimeError)


def f14_firings_c16_counters_k8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, value: the report's counters that are not 0, without times and memory."""
    axioms = (
        "InverseObjectProperties(:locatedIn :locationOf) SubObjectPropertyOf(:locatedIn :near) SymmetricObjectProperty(:near) ObjectPropertyDomain(:locatedIn :Place) ObjectPropertyRange(:locatedIn :Region)"
        " SubClassOf(:Region :Area) SubClassOf(ObjectSomeValuesFrom(:locatedIn :Region) :Inner)"
    )
    report = reason(spark, Facts(spark, sf_dir).nations(), ontology(axioms), Options(count_candidates=True)).report
    rows = [(f"{part}.{k}", int(v)) for part in ("ontology", "compiled") for k, v in report[part].items() if v]
    rows += [(f"firings.{k}", int(v)) for k, v in report["reasoning"]["rule_firings"].items() if v]
    rows += [(f"rounds.{r['iteration']}.{k}", int(r[k])) for r in report["reasoning"]["iterations"] for k in ("new_types", "new_properties") if r[k]]
    rows += [(k, int(report["reasoning"][k])) for k in ("total_inferred", "total_iterations", "fixpoint_reached")]
    return spark.createDataFrame(rows, "name string, value long")


def u1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure after the nations came in one batch and the customers in a second, with the nations again."""
    from hornloom.streaming.incremental import IncrementalReasoner

    f = Facts(spark, sf_dir)
    r = IncrementalReasoner(spark, ontology("TransitiveObjectProperty(:locatedIn) ObjectPropertyRange(:locatedIn :Place)"))
    r.update(f.nations())
    r.update(f.customers().unionByName(f.nations()))
    return r.closure()


_TOTALS = "(SELECT count(*) AS n, count(DISTINCT n_regionkey) AS r FROM nation)"
#: What each counter of f14_firings_c16_counters_k8_report is, from n nations in r regions.
_REPORT = {
    "ontology.total_axioms": "7", "ontology.subclass_of": "1", "ontology.sub_property_of": "1", "ontology.domain": "1", "ontology.range": "1", "ontology.inverse_of": "2", "ontology.symmetric_property": "1", "ontology.some_values_from": "1",
    "compiled.subclass_closure_size": "1", "compiled.subproperty_closure_size": "1", "compiled.domain_entries": "1", "compiled.range_entries": "1", "compiled.inverse_entries": "2", "compiled.some_values_from_rules": "1",
    "compiled.indexed_predicates": "3", "compiled.indexed_classes": "1",
    "firings.subproperty": "n", "firings.inverse": "2 * n", "firings.domain": "n", "firings.range": "n", "firings.subclass": "r", "firings.some_values_from": "n", "firings.symmetric": "2 * n",
    "rounds.1.new_types": "n + r", "rounds.1.new_properties": "2 * n", "rounds.2.new_types": "n + r", "rounds.2.new_properties": "n", "total_inferred": "5 * n + 2 * r", "total_iterations": "3", "fixpoint_reached": "1",
}


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "s20_schema_in_data": (s20_schema_in_data, _row(_CUST, TYPE, _c("Business"), "customer") + " UNION ALL " + _row(_CUST, TYPE, _c("Place"), "customer")),
    "d1_dictionary": (d1_dictionary, f"SELECT {_ORDER} AS s, {_c('placedBy')} AS p, {_n('customer', 'o_custkey')} AS o FROM orders UNION ALL SELECT {_n('part', 'p_partkey')}, {_c('brand')}, '\"' || p_brand || '\"' FROM part"),
    "e1_components": (e1_components, "SELECT o_custkey AS id, o_custkey AS root FROM orders GROUP BY 1 UNION ALL SELECT o_orderkey + 1000000000000, o_custkey FROM orders"),
    "i11_messages": (i11_messages, f"SELECT 'DisjointClasses' AS kind, {_CUST} || ' is a member of the disjoint classes {name('A')} and {name('B')}' AS detail FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "i10_halt": (i10_halt, "SELECT 'the facts are inconsistent: DisjointClasses (' || count(*) || ')' AS message FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "f13_round_limit": (f13_round_limit, "SELECT 'maximum iterations (1) reached before fixpoint' AS message"),
    "f14_firings_c16_counters_k8_report": (f14_firings_c16_counters_k8_report, " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({v} AS BIGINT) AS value FROM {_TOTALS}" for k, v in _REPORT.items())),
    "u1_batches": (u1_batches, f"WITH e AS (SELECT {_CUST} AS s, {_n('nation', 'c_nationkey')} AS o FROM customer UNION SELECT {_NATION}, {_REGION} FROM nation), t AS (SELECT s, o FROM e UNION SELECT {_CUST}, {_REGION} FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT s, {_c('locatedIn')} AS p, o FROM t UNION ALL SELECT DISTINCT o, {_c(TYPE)}, {_c('Place')} FROM t"),
    "r15_long_chains": (r15_long_chains, f"WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT {_n('event', 'a.event_id')} AS s, {_c('before')} AS p, {_n('event', 'b.event_id')} AS o FROM n a JOIN n b ON a.user_id = b.user_id AND b.k > a.k + 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **{k: f for k, (f, _) in EXTRA.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: q.sql for k, q in QUERIES.items() if q.sql}, **{k: s for k, (_, s) in EXTRA.items()}}
