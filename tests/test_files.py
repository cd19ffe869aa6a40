"""Data files through Spark, output files, the command line, streams and the registered queries."""

import bz2
import gzip
import json
import lzma

import pytest

import __spark_entry__
from hornloom import cli
from hornloom.operators.dictionary import build, decode, encode
from hornloom.operators.tables import id_of
from hornloom.sources.ofn import parse_functional
from hornloom.sources.rdf import read_rdf
from hornloom.sources.sinks import lines, write_ntriples
from hornloom.streaming.incremental import IncrementalReasoner

TRIPLES = "s string, p string, o string"


def n(x):
    return f"<http://e/{x}>"


def test_formats_codecs_and_blank_nodes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    line = "<http://e/{0}> <http://e/p> _:b0 ."
    files = {
        "a.nt": line.format("a").encode(), "b.nq.gz": gzip.compress((line[:-1] + "<http://g> .").format("b").encode()), "deep/c.ttl": b"@prefix : <http://e/> . :c :p _:b0 .", "deep/d.trig.bz2": bz2.compress(b"@prefix : <http://e/> . { :d :p _:b0 }"),
        "e.rdf": b'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://e/"><rdf:Description rdf:about="http://e/e"><p rdf:nodeID="b0"/></rdf:Description></rdf:RDF>',
        "f.jsonld": b'{"@id": "http://e/f", "http://e/p": {"@id": "_:b0"}}', "g.nt.xz": lzma.compress((line.format("g") + "\n# end\n").encode()), "h.n3": b"@prefix : <http://e/> . :h :p _:b0 .",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {(r.s, r.o) for r in read_rdf(spark, str(tmp_path)).collect()}
    assert {s for s, _ in got} == {n(x) for x in "abcdefgh"}
    assert len({o for _, o in got}) == 8 and all(o.startswith("_:f") and o.endswith("b0") for _, o in got)
    assert [r.o for r in read_rdf(spark, str(tmp_path / "a.nt")).collect()] == ["_:b0"]


def test_lines_are_read_in_canonical_form(spark, tmp_path):
    text = '<http://e/a> <http://e/p> "x\\u00e9\\n\\"q\\""@en .\n\n# note\n<http://e/a> <http://e/p> "s"^^<http://www.w3.org/2001/XMLSchema#string> . # end\n<http://e/\\u00e9> <http://e/p> _:x .\n'
    (tmp_path / "a.nt").write_text(text)
    df = read_rdf(spark, str(tmp_path / "a.nt"))
    got = {tuple(r) for r in df.collect()}
    assert got == {(n("a"), n("p"), '"xé\\n\\"q\\""@en'), (n("a"), n("p"), '"s"'), (n("é"), n("p"), "_:x")}
    (tmp_path / "out.nt").write_text("\n".join(r.value for r in lines(df).collect()))
    assert {tuple(r) for r in read_rdf(spark, str(tmp_path / "out.nt")).collect()} == got
    (tmp_path / "bad.nt").write_text("<http://e/a> oops .\n")
    with pytest.raises(Exception, match="not a statement"):
        read_rdf(spark, str(tmp_path / "bad.nt")).collect()
    with pytest.raises(Exception, match="no IRI"):
        lines(spark.createDataFrame([("<a>", "_:b", "<c>")], TRIPLES)).collect()


def test_dictionary(spark):
    df = spark.createDataFrame([(n("a"), n("p"), '"l"'), ("_:b", n("p"), n("a"))], TRIPLES)
    ids = encode(df)
    assert {r.o & 1 for r in ids.collect()} == {0, 1} and {r.s for r in ids.collect()} == {id_of(n("a")), id_of("_:b")}
    assert {tuple(r) for r in decode(ids, build(df)).collect()} == {tuple(r) for r in df.collect()}


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "d.nt").write_text("<http://e/x> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/A> .\n")
    (tmp_path / "o.ofn").write_text("Prefix(:=<http://e/>) Ontology(SubClassOf(:A :B) DisjointClasses(:A :B))")
    out, report = tmp_path / "out.nt", tmp_path / "report.json"
    assert cli.main(["reason", str(tmp_path / "d.nt"), "-O", str(tmp_path / "o.ofn"), "-o", str(out), "--report", str(report), "-q"]) == 0
    assert out.read_text() == "<http://e/x> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/B> .\n"
    r = json.loads(report.read_text())
    assert (r["input"]["triples"], r["input"]["output_triples"], r["export_time_ms"] >= 0, len(r["ontology"]), len(r["compiled"])) == (1, 1, True, 28, 19)
    assert r["version"] == 2 and r["reasoning"]["total_inferred"] == 1 and [x["kind"] for x in r["inconsistencies"]] == ["DisjointClasses"]
    halted = tmp_path / "halted.nt"
    assert cli.main(["reason", str(tmp_path / "d.nt"), "-O", str(tmp_path / "o.ofn"), "-o", str(halted), "--inconsistency-mode", "halt", "-q"]) == 1
    assert not halted.exists()


def test_written_triples_are_counted(spark, tmp_path):
    rows = [(n(f"a{i}"), n("p"), n("b")) for i in range(50)]
    df = spark.createDataFrame(rows, TRIPLES).repartition(4)
    assert write_ntriples(df, str(tmp_path / "folder")) == 50 and write_ntriples(df, str(tmp_path / "one.nt"), True) == 50
    assert sorted((tmp_path / "one.nt").read_text().splitlines()) == sorted(f"{s} {p} {o} ." for s, p, o in rows)
    assert write_ntriples(df.limit(0), str(tmp_path / "none.nt"), True) == 0 and (tmp_path / "none.nt").read_text() == ""
    assert write_ntriples(df.where("false"), str(tmp_path / "empty")) == 0
    with pytest.raises(Exception, match="the predicate is no IRI"):
        write_ntriples(spark.createDataFrame([(n("a"), '"p"', n("b"))], TRIPLES), str(tmp_path / "bad.nt"), True)
    assert not (tmp_path / "bad.nt").exists()


def test_report_has_every_inconsistency(spark, tmp_path, caplog):
    (tmp_path / "d.nt").write_text("".join(f"<http://e/x{i}> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/A> .\n" for i in range(1200)))
    (tmp_path / "o.ofn").write_text("Prefix(:=<http://e/>) Ontology(SubClassOf(:A :B) DisjointClasses(:A :B))")
    report = tmp_path / "report.json"
    args = cli.parser().parse_args(["reason", str(tmp_path / "d.nt"), "-O", str(tmp_path / "o.ofn"), "-o", str(tmp_path / "out.nt"), "--report", str(report)])
    with caplog.at_level("WARNING", logger="hornloom"):
        cli.run(args, spark)
    listed = [x["detail"] for x in json.loads(report.read_text())["inconsistencies"]]
    assert len(set(listed)) == 1200 and listed == sorted(listed)
    assert [x.getMessage() for x in caplog.records if x.name == "hornloom" and x.levelname == "WARNING"] == [f"DisjointClasses: {x}" for x in listed]


def test_stream_equals_batch(spark, tmp_path):
    ax = parse_functional("Prefix(:=<http://e/>) Ontology(TransitiveObjectProperty(:p) ObjectPropertyDomain(:p :C))")
    source = tmp_path / "in"
    data = [(n(f"a{i}"), n("p"), n(f"a{i + 1}")) for i in range(4)]
    for i in (2, 0, 3):
        spark.createDataFrame(data[i : i + 1], TRIPLES).coalesce(1).write.mode("append").parquet(str(source))
    r = IncrementalReasoner(spark, ax)
    stream = spark.readStream.schema(TRIPLES).option("maxFilesPerTrigger", 2).parquet(str(source))
    q = r.start(stream, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    r.update(spark.createDataFrame(data[1:3], TRIPLES))  # one is new, one is delivered again
    got = {tuple(x) for x in r.closure().collect() if x.p == n("p")}
    assert got == {(n(f"a{i}"), n("p"), n(f"a{j}")) for i in range(5) for j in range(i + 1, 5)}


def test_entry(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    df = __spark_entry__.entry(spark)
    assert df.columns == ["s", "p", "o"] and df.count() > 0
