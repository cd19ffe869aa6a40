"""Reading ontology files of any supported syntax into axioms."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from hornloom.sources.discovery import ONTOLOGY, discover, read_bytes
from hornloom.sources.ofn import Axiom, parse_functional, parse_xml
from hornloom.sources.rdf_axioms import to_axioms
from hornloom.sources.rdfxml import parse as parse_rdfxml
from hornloom.sources.turtle import Turtle


@dataclass
class Ontology:
    axioms: list[Axiom] = field(default_factory=list)
    residue: list[tuple[str, str, str]] = field(default_factory=list)


def load(path: str) -> Ontology:
    out = Ontology()
    sources = discover(path, ONTOLOGY)
    for n, s in enumerate(sources):
        data, base, tag = read_bytes(s), "file://" + os.path.realpath(s.path), f"o{n}_"
        if s.format == "ofn":
            out.axioms += parse_functional(data.decode("utf-8-sig"))
            continue
        if s.format == "owx":
            out.axioms += parse_xml(data)
            continue
        triples = parse_rdfxml(data, base, tag) if s.format == "rdfxml" else Turtle(data.decode("utf-8-sig"), base, tag).triples()
        axioms, residue = to_axioms(triples)
        out.axioms += axioms
        out.residue += residue
    return out
