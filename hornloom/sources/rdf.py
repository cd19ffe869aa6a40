"""RDF data files as a DataFrame of canonical terms (s, p, o).

N-Triples and N-Quads are read line by line (splittable where the codec is); the other formats are documents, each parsed by one task.
Blank nodes are set apart by file where there is more than one file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornloom.sources.discovery import Source, discover, unpack
from hornloom.sources.jsonld import parse as parse_jsonld
from hornloom.sources.rdfxml import parse as parse_rdfxml
from hornloom.sources.turtle import Turtle
from hornloom.terms import XSD, canonical

SCHEMA = "s string, p string, o string"
#: An N-Triples or N-Quads line: subject, predicate, object, perhaps a graph.
LINE = r'^\s*(<[^<>\s]*>|_:[^\s<"]+)\s*(<[^<>\s]*>)\s*(<[^<>\s]*>|_:[^\s<"]+|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?)\s*(?:(?:<[^<>\s]*>|_:[^\s<"]+?)\s*)?\.\s*(?:#.*)?$'


def _respell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({c: f[c].map(canonical) for c in ("s", "p", "o")})


def _lines(spark: SparkSession, sources: list[Source], tags: dict[str, str]) -> DataFrame:
    plain = [s.path for s in sources if s.codec != "xz"]
    parts = []
    if plain:
        parts.append(spark.read.text(plain).select("value", F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path")))
    if packed := [s.path for s in sources if s.codec == "xz"]:

        def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for path, content in zip(f["path"], f["content"], strict=True):
                    text = unpack(content, "xz").decode("utf-8").split("\n")
                    yield pd.DataFrame({"value": text, "path": path})

        files = spark.read.format("binaryFile").load(packed).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        parts.append(files.mapInPandas(lines, "value string, path string"))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    df = df.where(~F.col("value").rlike(r"^\s*(#|$)"))
    group = lambda i: F.regexp_extract("value", LINE, i)
    bad = F.raise_error(F.concat(F.lit("not a statement: "), F.substring("value", 1, 200)))
    df = df.select(F.when(F.col("value").rlike(LINE), group(1)).otherwise(bad).alias("s"), group(2).alias("p"), group(3).alias("o"), "path")
    if tags:
        of = F.create_map(*(F.lit(x) for kv in tags.items() for x in kv))
        tagged = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:"), F.element_at(of, F.col("path")), F.substring(c, 3, 1 << 30))).otherwise(F.col(c))
        df = df.select(tagged("s").alias("s"), "p", tagged("o").alias("o"))
    df = df.select("s", "p", F.regexp_replace("o", rf'\^\^<{XSD.replace(".", "[.]")}string>$', "").alias("o"))
    # Only lines with escapes need their text respelt.
    escaped = F.contains(F.concat("s", "p", "o"), F.lit("\\"))
    return df.where(~escaped).unionByName(df.where(escaped).mapInPandas(_respell, SCHEMA))


def parse_document(data: bytes, kind: str, base: str, tag: str) -> Iterator[tuple[str, str, str]]:
    if kind == "rdfxml":
        return parse_rdfxml(data, base, tag)
    text = data.decode("utf-8-sig")
    return parse_jsonld(text, base, tag) if kind == "jsonld" else Turtle(text, base, tag).triples()


def _documents(spark: SparkSession, sources: list[Source], tags: dict[str, str]) -> DataFrame:
    by_path = {s.path: s for s in sources}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                s, rows = by_path[path], []
                for t in parse_document(unpack(content, s.codec), s.format, "file://" + path, tags.get(path, "")):
                    rows.append(t)
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=["s", "p", "o"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["s", "p", "o"])

    files = spark.read.format("binaryFile").load(list(by_path)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return files.repartition(len(by_path), "path").mapInPandas(parse, SCHEMA)


def read_rdf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The triples of all files at the paths."""
    sources = [s for p in ([paths] if isinstance(paths, str) else paths) for s in discover(p)]
    tags = {s.path: f"f{i}_" for i, s in enumerate(sources)} if len(sources) > 1 else {}
    parts = []
    for lines, reader in ((True, _lines), (False, _documents)):
        if own := [s for s in sources if (s.format in ("ntriples", "nquads")) == lines]:
            parts.append(reader(spark, own, tags))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
