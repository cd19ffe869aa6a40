"""Readers of terms, data formats and ontology syntaxes; no Spark."""

import bz2
import gzip
import lzma
import os

import pytest

from hornloom.cli import memory_size, parser
from hornloom.plans.compile import closure, compile_schema
from hornloom.plans.lower import lower
from hornloom.sources.discovery import ONTOLOGY, classify, discover, read_bytes
from hornloom.sources.jsonld import parse as jsonld
from hornloom.sources.ofn import parse_functional, parse_xml
from hornloom.sources.ontology import load
from hornloom.sources.rdf_axioms import to_axioms
from hornloom.sources.rdfxml import parse as rdfxml
from hornloom.sources.turtle import Turtle
from hornloom.terms import FIRST, NIL, REST, TYPE, canonical, datatype_of, escape, literal, unescape

E = "http://e/"


def n(x):
    return f"<{E}{x}>"


def turtle(text, base="http://b/x"):
    return set(Turtle(text, base).triples())


def test_terms():
    assert escape('a"\\\n\t\x01\x7f') == 'a\\"\\\\\\n\\t\\u0001\\u007F'
    assert unescape(r"é\U0001F642\n") == "é🙂\n"
    assert canonical('"x"^^<http://www.w3.org/2001/XMLSchema#string>') == '"x"' and canonical('"\\u00e9"@fr') == '"é"@fr'
    assert literal("1", None, "http://www.w3.org/2001/XMLSchema#integer") != literal("01", None, "http://www.w3.org/2001/XMLSchema#integer")
    assert datatype_of('"x"').endswith("#string>") and datatype_of('"x"@en').endswith("#langString>") and datatype_of("<x>") is None


def test_turtle():
    got = turtle('@prefix : <http://e/> . PREFIX f: <http://f#>\n:a a :C ; :p "x"@en, "y"^^f:t, 1, 1.5, 1e3, true ;; :q [ :r (:x :y) ] .\n<#z> :p """long "q" text""" . # end\n_:b :p :a.b .')
    assert {(n("a"), TYPE, n("C")), (n("a"), n("p"), '"x"@en'), (n("a"), n("p"), '"y"^^<http://f#t>'), ("<http://b/x#z>", n("p"), '"long \\"q\\" text"'), ("_:b", n("p"), n("a.b"))} < got
    assert {o.rpartition("#")[2] for s, p, o in got if o.startswith('"1')} == {"integer>", "decimal>", "double>"}
    assert sum(p == FIRST for _, p, _ in got) == 2 and any(p == REST and o == NIL for _, p, o in got)
    with pytest.raises(ValueError, match="line 2"):
        turtle("\n  ^ bad")


def test_trig_nquads_and_n3():
    want = {(n("a"), n("p"), n("b"))}
    assert turtle("<http://g> { <http://e/a> <http://e/p> <http://e/b> }") == want
    assert turtle("@prefix : <http://e/> . GRAPH :g { :a :p :b . } { :a :p :b }") == want
    assert turtle("<http://e/a> <http://e/p> <http://e/b> <http://g> .") == want
    assert turtle("<http://e/a> = <http://e/b> .") == {(n("a"), "<http://www.w3.org/2002/07/owl#sameAs>", n("b"))}


def test_rdfxml():
    text = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://e/" xmlns:e="http://e/" xml:base="http://e/doc">
    <C rdf:about="a" e:p="lit"><q rdf:resource="b"/><r rdf:datatype="http://d">1</r><s><D rdf:ID="k"/></s><t rdf:parseType="Collection"><E rdf:about="x"/></t><u xml:lang="fr">v</u></C></rdf:RDF>"""
    got = set(rdfxml(text))
    assert {(n("a"), TYPE, n("C")), (n("a"), n("p"), '"lit"'), (n("a"), n("q"), n("b")), (n("a"), n("r"), '"1"^^<http://d>'), (n("a"), n("s"), n("doc#k")), (n("a"), n("u"), '"v"@fr')} < got
    assert sum(p == FIRST for _, p, _ in got) == 1


def test_jsonld():
    text = '{"@context": {"@vocab": "http://e/", "k": {"@id": "http://e/knows", "@type": "@id"}, "l": {"@container": "@list"}}, "@id": "http://e/a", "@type": "C", "k": ["http://e/b"], "name": {"@value": "x", "@language": "en"}, "n": 3, "l": [1], "sub": {"@id": "_:z", "ok": true}}'
    got = set(jsonld(text))
    assert {(n("a"), TYPE, n("C")), (n("a"), n("knows"), n("b")), (n("a"), n("name"), '"x"@en'), (n("a"), n("sub"), "_:z")} < got
    with pytest.raises(ValueError, match="remote"):
        list(jsonld('{"@context": "https://example.org/c", "a": 1}'))


def test_discovery(tmp_path):
    (tmp_path / "d").mkdir()
    for name, pack in (("a.nt", bytes), ("b.ttl.gz", gzip.compress), ("d/c.NQ.bz2", bz2.compress), ("e.rdf.xz", lzma.compress), ("skip.txt", bytes)):
        (tmp_path / name).write_bytes(pack(b"data"))
    got = discover(str(tmp_path))
    assert [(os.path.basename(s.path), s.format, s.codec) for s in got] == [("a.nt", "ntriples", None), ("b.ttl.gz", "turtle", "gz"), ("c.NQ.bz2", "nquads", "bz2"), ("e.rdf.xz", "rdfxml", "xz")]
    assert all(read_bytes(s) == b"data" for s in got)
    assert classify("x.owx") is None and classify("x.owx", ONTOLOGY).format == "owx"
    with pytest.raises(ValueError, match="unsupported"):
        discover(str(tmp_path / "skip.txt"))
    with pytest.raises(FileNotFoundError):
        discover(str(tmp_path / "none"))


OFN = """Prefix(:=<http://e/>) Prefix(xsd:=<http://www.w3.org/2001/XMLSchema#>)
Ontology(<http://e/o> Annotation(:note "x") Declaration(Class(:A)) # a remark
SubClassOf(Annotation(:note "y"@en) :A ObjectIntersectionOf(:B ObjectMaxCardinality(1 :p :C)))
SubClassOf(DataSomeValuesFrom(:d xsd:integer) :A) HasKey(:A (:p) (:d)) ObjectPropertyAssertion(ObjectInverseOf(:p) :x :y) )"""


def test_functional_syntax():
    ax = parse_functional(OFN)
    assert ax[0] == ("Declaration", ("Class", n("A"))) or ax[1] == ("Declaration", ("Class", n("A")))
    assert ("SubClassOf", n("A"), ("ObjectIntersectionOf", n("B"), ("ObjectMaxCardinality", 1, n("p"), n("C")))) in ax
    assert ("HasKey", n("A"), (n("p"),), (n("d"),)) in ax
    s = lower(ax)
    assert s.props == {(n("y"), n("p"), n("x"))} and s.mc1 == {(n("A"), n("p"), n("C"))} and s.sub == {(n("A"), n("B"))} and s.has_data_ranges


def test_xml_and_rdf_give_the_same_axioms(tmp_path):
    owx = b"""<Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://e/o"><Prefix name="" IRI="http://e/"/>
    <SubClassOf><ObjectSomeValuesFrom><ObjectProperty IRI="http://e/p"/><Class abbreviatedIRI=":D"/></ObjectSomeValuesFrom><Class IRI="http://e/C"/></SubClassOf>
    <TransitiveObjectProperty><ObjectProperty IRI="http://e/t"/></TransitiveObjectProperty>
    <SubObjectPropertyOf><ObjectPropertyChain><ObjectProperty IRI="http://e/p"/><ObjectProperty IRI="http://e/t"/></ObjectPropertyChain><ObjectProperty IRI="http://e/q"/></SubObjectPropertyOf></Ontology>"""
    ttl = """@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
    [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :D ] rdfs:subClassOf :C . :t a owl:TransitiveProperty . :q owl:propertyChainAxiom ( :p :t ) . :odd :stays :here ."""
    (tmp_path / "o.owx").write_bytes(owx)
    (tmp_path / "o.ttl").write_text(ttl)
    a, b = load(str(tmp_path / "o.owx")), load(str(tmp_path / "o.ttl"))
    assert set(a.axioms) == set(b.axioms) == {("SubClassOf", ("ObjectSomeValuesFrom", n("p"), n("D")), n("C")), ("TransitiveObjectProperty", n("t")), ("SubObjectPropertyOf", ("ObjectPropertyChain", n("p"), n("t")), n("q"))}
    assert a.residue == [] and b.residue == [(n("odd"), n("stays"), n("here"))]


def test_rdf_mapping_of_lists_and_restrictions():
    ttl = """@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    :C owl:equivalentClass [ owl:intersectionOf ( :A [ owl:onProperty :p ; owl:hasValue :v ; a owl:Restriction ] ) ; a owl:Class ] . [] a owl:AllDisjointClasses ; owl:members ( :A :B ) .
    :C owl:hasKey ( :k ) . :k a owl:DatatypeProperty ; rdfs:range xsd:int . :a owl:differentFrom :b . [] a owl:NegativePropertyAssertion ; owl:sourceIndividual :a ; owl:assertionProperty :p ; owl:targetIndividual :b .
    :M rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:maxQualifiedCardinality "0"^^xsd:nonNegativeInteger ; owl:onClass :A ] ."""
    ax, residue = to_axioms(Turtle(ttl).triples())
    assert residue == []
    want = {("EquivalentClasses", n("C"), ("ObjectIntersectionOf", n("A"), ("ObjectHasValue", n("p"), n("v")))), ("DisjointClasses", n("A"), n("B")), ("HasKey", n("C"), (), (n("k"),)), ("DataPropertyRange", n("k"), "<http://www.w3.org/2001/XMLSchema#int>"), ("DifferentIndividuals", n("a"), n("b")), ("NegativeObjectPropertyAssertion", n("p"), n("a"), n("b")), ("SubClassOf", n("M"), ("ObjectMaxCardinality", 0, n("p"), n("A")))}
    assert want <= set(ax)


def test_lowering_positions():
    def low(text):
        return lower(parse_functional(f"Prefix(:=<http://e/>) Prefix(owl:=<http://www.w3.org/2002/07/owl#>) Ontology({text})"))

    assert low("SubClassOf(:A ObjectSomeValuesFrom(:p :B)) SubClassOf(:A ObjectUnionOf(:B :C)) SubClassOf(ObjectAllValuesFrom(:p :B) :C)").sub == set()
    s = low("SubClassOf(ObjectIntersectionOf(:A ObjectHasSelf(:p)) :C)")
    assert s.conj == [] and s.display == {}
    s = low("SubClassOf(ObjectSomeValuesFrom(:p ObjectUnionOf(:A :B)) ObjectAllValuesFrom(:q ObjectHasValue(:r :v)))")
    assert len(s.svf) == len(s.avf) == len(s.hv_out) == 1 and len(s.sub) == 2 and len(s.display) == 3
    assert low("SubClassOf(:A DataMaxCardinality(1 :d DataOneOf(\"x\")))").mc1 == set()
    assert low("Import(<http://x>) ReflexiveObjectProperty(:p)").unsupported.total() == 2
    r = compile_schema(low("SubClassOf(:A owl:Thing) SubClassOf(owl:Thing :U) SubClassOf(ObjectSomeValuesFrom(:p owl:Thing) :C) SubObjectPropertyOf(ObjectPropertyChain(:t :t :t) :t)"))
    assert r.universal == [n("U")] and r.svf == [] and r.trans == [n("t")] and r.chains == [] and n("U") in {x[2] for x in r.by_class} | {n("U")}


def test_closure_with_cycles():
    assert closure({("a", "b"), ("b", "c"), ("c", "a")}) == {(x, y) for x in "abc" for y in "abc" if x != y}


def test_cli_arguments():
    assert (memory_size("4G"), memory_size("512mb"), memory_size("1024")) == (4 << 30, 512 << 20, 1024)
    a = parser().parse_args(["reason", "x", "y", "-o", "out", "--emit", "closure", "--max-iterations", "3"])
    assert a.data == ["x", "y"] and a.emit == "closure" and a.max_iterations == 3 and a.inconsistency_mode == "report"
    with pytest.raises(SystemExit):
        parser().parse_args(["reason", "x"])
