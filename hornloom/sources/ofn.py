"""Ontology axioms as nested tuples, and the readers of the functional and the XML syntax.

An axiom is (name, argument...), as in the functional syntax: ("SubClassOf", "<C>", ("ObjectSomeValuesFrom", "<p>", "<D>")). IRIs, blank nodes and literals are
canonical terms, variables ("Variable", iri), cardinalities integers, HasKey's and the rule parts' lists plain tuples of tuples.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from hornloom.terms import OWL, PREFIXES, iri, literal, unescape

Axiom = tuple

_TOKENS = re.compile(r'(?P<skip>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>\s]*>)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<mark>[()=])|(?P<bnode>_:[^\s()<>"=]+)|(?P<name>[^\s()<>"=@^]*:[^\s()<>"=@^]*)|(?P<int>[0-9]+(?![^\s()]))|(?P<word>[A-Za-z]\w*)', re.S)
_ANNOTATION = "Annotation"


def parse_functional(text: str) -> list[Axiom]:
    at, prefixes = 0, dict(PREFIXES)
    tokens: list[tuple[str, str]] = []
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: cannot read {text[at : at + 30]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def take(kind: str | None = None, value: str | None = None) -> str:
        nonlocal i
        if (kind and tokens[i][0] != kind) or (value and tokens[i][1] != value):
            raise ValueError(f"expected {value or kind}, found {tokens[i][1]!r}")
        i += 1
        return tokens[i - 1][1]

    def full(name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix}:")
        return iri(prefixes[prefix] + local)

    def item():
        nonlocal i
        kind, value = tokens[i]
        if kind == "mark" and value == "(":
            return tuple(arguments())
        i += 1
        if kind == "iri":
            return iri(value[1:-1])
        if kind == "name":
            return full(value)
        if kind == "bnode":
            return value
        if kind == "int":
            return int(value)
        if kind == "string":
            body = unescape(value[1:-1])
            if tokens[i][0] == "lang":
                return literal(body, take("lang")[1:])
            if tokens[i][0] == "type":
                i += 1
                return literal(body, None, item()[1:-1])
            return literal(body)
        if kind == "word":
            return (value, *arguments())
        raise ValueError(f"unexpected {value!r}")

    def arguments() -> list:
        nonlocal i
        take("mark", "(")
        out = []
        while tokens[i] != ("mark", ")"):
            x = item()
            if not (isinstance(x, tuple) and x[:1] == (_ANNOTATION,)):
                out.append(x)
        i += 1
        return out

    axioms: list[Axiom] = []
    while tokens[i][0] != "end":
        if tokens[i][1] == "Prefix":
            i += 1
            take("mark", "(")
            name = take("name")
            take("mark", "=")
            prefixes[name[:-1]] = take("iri")[1:-1]
            take("mark", ")")
        elif tokens[i][1] == "Ontology":
            i += 1
            for x in arguments():
                if isinstance(x, tuple):
                    axioms.append(x)
        else:
            raise ValueError(f"expected Prefix or Ontology, found {tokens[i][1]!r}")
    return axioms


_X = f"{{{OWL}}}"


def parse_xml(data: bytes) -> list[Axiom]:
    """OWL/XML: element names are those of the functional syntax."""
    root = ET.fromstring(data)
    prefixes = dict(PREFIXES)
    for p in root.iter(_X + "Prefix"):
        prefixes[p.get("name")] = p.get("IRI")
    base = root.get("{http://www.w3.org/XML/1998/namespace}base") or root.get("ontologyIRI") or ""

    def name_of(n: ET.Element) -> str | None:
        if (short := n.get("abbreviatedIRI")) is not None:
            prefix, _, local = short.partition(":")
            return iri(prefixes[prefix] + local)
        if (text := n.get("IRI")) is not None:
            return iri(text if re.match("[A-Za-z][A-Za-z0-9+.-]*:", text) else base.partition("#")[0] + text if text.startswith("#") else base + text)
        return None

    def convert(n: ET.Element):
        tag = n.tag.removeprefix(_X)
        if tag in ("Class", "ObjectProperty", "DataProperty", "AnnotationProperty", "NamedIndividual", "Datatype") and name_of(n):
            return name_of(n)
        if tag == "Variable":
            return ("Variable", name_of(n) or iri(n.text or ""))
        if tag == "AnonymousIndividual":
            return n.get("nodeID") if (n.get("nodeID") or "").startswith("_:") else "_:" + (n.get("nodeID") or "")
        if tag == "Literal":
            return literal(n.text or "", n.get("{http://www.w3.org/XML/1998/namespace}lang"), n.get("datatypeIRI"))
        if tag in ("IRI", "AbbreviatedIRI"):
            t = (n.text or "").strip()
            return iri(prefixes[t.partition(":")[0]] + t.partition(":")[2]) if tag == "AbbreviatedIRI" else iri(t if ":" in t else base + t)
        children = [convert(c) for c in n if c.tag != _X + _ANNOTATION]
        if n.get("cardinality") is not None:
            children.insert(0, int(n.get("cardinality")))
        if tag == "Declaration" and len(n):
            return (tag, (n[-1].tag.removeprefix(_X), children[-1]))
        if tag == "InverseObjectProperty":
            tag = "ObjectInverseOf"
        if tag == "HasKey":
            data = [c for c, e in zip(children, [e for e in n if e.tag != _X + _ANNOTATION], strict=True) if e.tag == _X + "DataProperty"]
            return (tag, children[0], tuple(c for c in children[1:] if c not in data), tuple(data))
        return (tag, *children)

    skip = {_X + x for x in ("Prefix", "Annotation")}
    return [convert(c) for c in root if c.tag not in skip]
