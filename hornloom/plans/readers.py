"""Registered queries of the readers and writers: tables of fixed size are written in a syntax to the shared folder, read again and reasoned over."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hornloom import cli
from hornloom.operators.tables import shared_dir
from hornloom.plans.reason import reason
from hornloom.plans.relational import NS, Facts, name, ontology
from hornloom.sources.ontology import load
from hornloom.sources.rdf import read_rdf
from hornloom.sources.sinks import write_ntriples
from hornloom.terms import RDF, RDFS, TYPE

AXIOMS = "InverseObjectProperties(:locatedIn :locationOf) ObjectPropertyRange(:locatedIn :Region)"
OWL = "http://www.w3.org/2002/07/owl#"
PACK: dict[str, Callable[[bytes], bytes]] = {"": lambda x: x, ".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress}


def _folder(spark: SparkSession, files: dict[str, str]) -> str:
    """A new folder below the shared one with these files, packed as their names say."""
    folder = f"{shared_dir(spark).removeprefix('file:').rstrip('/')}/written-{uuid.uuid4().hex}"
    for path, content in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "wb") as f:
            f.write(PACK[os.path.splitext(path)[1] if os.path.splitext(path)[1] in PACK else ""](content.encode()))
    return folder


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    """The nations' triples; `nation` has 25 rows at every size."""
    return [(r.s, r.p, r.o) for r in Facts(spark, sf_dir).nations().orderBy("s").collect()]


def _bare(term: str) -> str:
    return term[1:-1]


def _prefixed(rows: list[tuple[str, str, str]]) -> str:
    short = lambda t: f"t:{_bare(t).removeprefix(NS)}".replace("/", "\\/")
    return "".join(f"{s} {short(p)} {o} ;\n  a t:Nation .\n" for s, p, o in rows)


def _rdfxml(rows: list[tuple[str, str, str]]) -> str:
    inner = "".join(f'<rdf:Description rdf:about="{_bare(s)}"><t:{_bare(p).removeprefix(NS)} rdf:resource="{_bare(o)}"/></rdf:Description>\n' for s, p, o in rows)
    return f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}" xmlns:t="{NS}">\n{inner}</rdf:RDF>'


def _jsonld(rows: list[tuple[str, str, str]]) -> str:
    inner = ",\n".join(f'{{"@id": "{_bare(s)}", "t:{_bare(p).removeprefix(NS)}": {{"@id": "{_bare(o)}"}}}}' for s, p, o in rows)
    return f'{{"@context": {{"t": "{NS}"}}, "@graph": [{inner}]}}'


def _lines(rows: list[tuple[str, str, str]], graph: str = "") -> str:
    return "# nations\n" + "".join(f"{s} {p} {o} {graph}.\n" for s, p, o in rows)


def _half(rows: list, k: int) -> list:
    return rows[k::2]


#: File names and contents by query, from the nations' triples.
DATA: dict[str, Callable[[list[tuple[str, str, str]]], dict[str, str]]] = {
    "s05_ntriples": lambda r: {"a.nt": _lines(r)},
    "s06_nquads": lambda r: {"a.nq": _lines(r, "<urn:t:graph> ")},
    "s07_turtle": lambda r: {"a.ttl": f"@prefix t: <{NS}> .\n" + _prefixed(r)},
    "s08_trig": lambda r: {"a.trig": f"PREFIX t: <{NS}>\n{{ {_prefixed(_half(r, 0))} }}\nGRAPH <urn:t:graph> {{ {_prefixed(_half(r, 1))} }}"},
    "s09_rdfxml": lambda r: {"a.rdf": _rdfxml(r)},
    "s10_jsonld": lambda r: {"a.jsonld": _jsonld(r)},
    "s11_n3": lambda r: {"a.n3": f"@prefix t: <{NS}> .\n" + _prefixed(r)},
    "s01_s02_s03_s04_folder_of_packed_files": lambda r: {"a.nt.gz": _lines(r[0::4]), "deep/b.rdf.bz2": _rdfxml(r[1::4]), "deep/er/c.nq.xz": _lines(r[2::4], "<urn:t:graph> "), "deep/d.ttl.xz": f"@prefix t: <{NS}> .\n" + _prefixed(r[3::4]), "notes.txt": "not read"},
}

_OWX = f"""<?xml version="1.0"?>
<Ontology xmlns="{OWL}" ontologyIRI="urn:t:o">
<InverseObjectProperties><ObjectProperty IRI="{NS}locatedIn"/><ObjectProperty IRI="{NS}locationOf"/></InverseObjectProperties>
<ObjectPropertyRange><ObjectProperty IRI="{NS}locatedIn"/><Class IRI="{NS}Region"/></ObjectPropertyRange>
</Ontology>"""
_OFN = f"Prefix(:=<{NS}>)\nOntology(<urn:t:o>\n{AXIOMS})"
_TTL = f"""@prefix : <{NS}> . @prefix owl: <{OWL}> . @prefix rdfs: <{RDFS}> .
:locatedIn a owl:ObjectProperty ; owl:inverseOf :locationOf ; rdfs:range :Region . :locationOf a owl:ObjectProperty . :Region a owl:Class ."""
_RDF = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:rdfs="{RDFS}" xmlns:owl="{OWL}"><owl:ObjectProperty rdf:about="{NS}locatedIn"><owl:inverseOf rdf:resource="{NS}locationOf"/>
<rdfs:range rdf:resource="{NS}Region"/></owl:ObjectProperty><owl:ObjectProperty rdf:about="{NS}locationOf"/><owl:Class rdf:about="{NS}Region"/></rdf:RDF>"""
ONTOLOGIES = {
    "s16_functional_syntax": {"o.ofn": _OFN},
    "s17_owl_xml": {"o.owx": _OWX},
    "s18_rdf_mapping_turtle": {"o.ttl": _TTL},
    "s18_rdf_mapping_rdfxml": {"o.owl": _RDF},
    "s14_s15_folder_of_ontologies": {"a/range.ofn": f"Prefix(:=<{NS}>) Ontology(<urn:t:a> ObjectPropertyRange(:locatedIn :Region))", "b/inverse.owx.gz": _OWX.replace("<ObjectPropertyRange>", "<!--").replace("</ObjectPropertyRange>", "-->")},
}


def _read_data(make: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reason(spark, read_rdf(spark, _folder(spark, make(_nations(spark, sf_dir)))), ontology(AXIOMS)).inferred()

    return run


def _read_ontology(files: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reason(spark, Facts(spark, sf_dir).nations(), load(_folder(spark, files)).axioms).inferred()

    return run


def s12_blank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes of two files with equal names stay apart."""
    rows = _nations(spark, sf_dir)
    blank = lambda k: _lines([("_:n" + _bare(s).rpartition("/")[2], p, o) for s, p, o in rows if int(_bare(s).rpartition("/")[2]) <= 20 + k])
    return reason(spark, read_rdf(spark, _folder(spark, {"a.nt": blank(0), "b.nt": blank(1)})), ontology("ObjectPropertyDomain(:locatedIn :Place)")).inferred()


def k1_k6_written_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure, with literals that need escapes, written as N-Triples and read again."""
    f = Facts(spark, sf_dir)
    odd = spark.createDataFrame([(name("note"), name("says"), '"a \\"quoted\\" line\\nand \\\\ a tab\\t"')], "s string, p string, o string")
    r = reason(spark, f.nations().unionByName(f.brands()).unionByName(odd), ontology("DataPropertyDomain(:brand :Branded) TransitiveObjectProperty(:locatedIn)"))
    folder = _folder(spark, {"written/x": ""})
    os.remove(f"{folder}/written/x")
    write_ntriples(r.closure(), f"{folder}/written/closure.nt", True)
    return read_rdf(spark, f"{folder}/written/closure.nt")


def a1_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's run over written files, with its report: the triples written and the report's counts as triples."""
    folder = _folder(spark, {"in/a.nt": _lines(_nations(spark, sf_dir)), "in/o.ofn": _OFN})
    args = cli.parser().parse_args(["reason", f"{folder}/in/a.nt", "-O", f"{folder}/in/o.ofn", "-o", f"{folder}/out.nt", "--report", f"{folder}/report.json", "--emit", "closure", "-m", "2G", "--benchmark"])
    cli.run(args, spark)
    with open(f"{folder}/report.json", encoding="utf-8") as f:
        report = json.load(f)
    counts = [("input." + k, report["input"][k]) for k in ("triples", "output_triples", "memory_budget_bytes")] + [("inferred", report["reasoning"]["total_inferred"])]
    return read_rdf(spark, f"{folder}/out.nt").unionByName(spark.createDataFrame([("report", k, str(v)) for k, v in counts], "s string, p string, o string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{k: _read_data(m) for k, m in DATA.items()}, **{k: _read_ontology(f) for k, f in ONTOLOGIES.items()}, "s12_blank_nodes": s12_blank_nodes, "k1_k6_written_triples": k1_k6_written_triples, "a1_a2_a3_command_line": a1_command_line}


def oracle_sql() -> dict[str, str]:
    nation, region = f"'<{NS}nation/' || n_nationkey || '>'", f"'<{NS}region/' || n_regionkey || '>'"
    part = f"'<{NS}part/' || p_partkey || '>'"
    read = f"SELECT {region} AS s, '{name('locationOf')}' AS p, {nation} AS o FROM nation UNION ALL SELECT DISTINCT {region}, '{TYPE}', '{name('Region')}' FROM nation"
    blank = " UNION ALL ".join(f"SELECT '_:f{k}_n' || n_nationkey AS s, '{TYPE}' AS p, '{name('Place')}' AS o FROM nation WHERE n_nationkey <= {20 + k}" for k in (0, 1))
    written = f"""SELECT {nation} AS s, '{name('locatedIn')}' AS p, {region} AS o FROM nation UNION ALL SELECT {part}, '{name('brand')}', '"' || p_brand || '"' FROM part
        UNION ALL SELECT {part}, '{TYPE}', '{name('Branded')}' FROM part UNION ALL SELECT '{name('note')}', '{name('says')}', '"a \\"quoted\\" line\\nand \\\\ a tab\\t"'"""
    # n nations in r regions: n triples read; n inverses and r types derived.
    command = f"""SELECT {nation} AS s, '{name('locatedIn')}' AS p, {region} AS o FROM nation UNION ALL {read} UNION ALL
        SELECT 'report', k, CAST(v AS VARCHAR) FROM (SELECT unnest(['input.triples', 'input.output_triples', 'input.memory_budget_bytes', 'inferred']) AS k, unnest([n, 2 * n + r, 2147483648, n + r]) AS v
        FROM (SELECT count(*) AS n, count(DISTINCT n_regionkey) AS r FROM nation))"""
    return {**dict.fromkeys([*DATA, *ONTOLOGIES], read), "s12_blank_nodes": blank, "k1_k6_written_triples": written, "a1_a2_a3_command_line": command}
