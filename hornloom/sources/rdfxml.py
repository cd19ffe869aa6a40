"""A parser of RDF/XML: bytes -> triples of canonical terms."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from hornloom.terms import FIRST, NIL, RDF, REST, TYPE, iri, literal

_R = f"{{{RDF}}}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
#: Attributes that are syntax, not properties.
_SYNTAX = {_R + x for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID", "aboutEach")}


def parse(data: bytes, base: str = "", tag: str = "") -> Iterator[tuple[str, str, str]]:
    fresh = 0
    out: list[tuple[str, str, str]] = []

    def blank() -> str:
        nonlocal fresh
        fresh += 1
        return f"_:{tag}x{fresh}"

    def name(qualified: str) -> str:
        return qualified[1:].replace("}", "", 1)

    def full(text: str, at: str) -> str:
        return urljoin(at, text) if text else at.partition("#")[0]

    def add(s: str, p: str, o: str) -> None:
        out.append((s, p, o))

    def attributes(node: ET.Element, subject: str, lang: str | None, at: str) -> None:
        for k, v in node.attrib.items():
            if k in _SYNTAX or k.startswith(_XML) or not k.startswith("{"):
                continue
            add(subject, iri(name(k)), iri(full(v, at)) if k == _R + "type" else literal(v, lang))

    def subject_of(node: ET.Element, at: str) -> str:
        a = node.attrib
        if _R + "about" in a:
            return iri(full(a[_R + "about"], at))
        if _R + "ID" in a:
            return iri(full("#" + a[_R + "ID"], at))
        return f"_:{tag}{a[_R + 'nodeID']}" if _R + "nodeID" in a else blank()

    def description(node: ET.Element, lang: str | None, at: str) -> str:
        lang, at = node.get(_XML + "lang", lang), full(node.get(_XML + "base", ""), at) if _XML + "base" in node.attrib else at
        s = subject_of(node, at)
        if node.tag != _R + "Description":
            add(s, TYPE, iri(name(node.tag)))
        attributes(node, s, lang, at)
        n = 0
        for child in node:
            if child.tag == _R + "li":
                n += 1
                child.tag = f"{_R}_{n}"
            prop(child, s, lang, at)
        return s

    def prop(node: ET.Element, s: str, lang: str | None, at: str) -> None:
        lang, at = node.get(_XML + "lang", lang), full(node.get(_XML + "base", ""), at) if _XML + "base" in node.attrib else at
        a, p = node.attrib, iri(name(node.tag))
        kind = a.get(_R + "parseType")
        if kind == "Resource":
            o = blank()
            for child in node:
                prop(child, o, lang, at)
        elif kind == "Collection":
            items = [description(c, lang, at) for c in node]
            nodes = [blank() for _ in items] + [NIL]
            for item, x, rest in zip(items, nodes, nodes[1:], strict=False):
                add(x, FIRST, item)
                add(x, REST, rest)
            o = nodes[0]
        elif kind is not None:
            inner = (node.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in node)
            o = literal(inner, None, RDF + "XMLLiteral")
        elif _R + "resource" in a or _R + "nodeID" in a:
            o = iri(full(a[_R + "resource"], at)) if _R + "resource" in a else f"_:{tag}{a[_R + 'nodeID']}"
            attributes(node, o, lang, at)
        elif len(node):
            o = description(node[0], lang, at)
        elif any(not k.startswith(_XML) and k not in _SYNTAX for k in a):
            o = blank()
            attributes(node, o, lang, at)
        else:
            kind = a.get(_R + "datatype")
            o = literal(node.text or "", None, full(kind, at)) if kind else literal(node.text or "", lang)
        add(s, p, o)
        if _R + "ID" in a:
            r = iri(full("#" + a[_R + "ID"], at))
            for q, x in (("type", iri(RDF + "Statement")), ("subject", s), ("predicate", p), ("object", o)):
                add(r, iri(RDF + q), x)

    root = ET.fromstring(data)
    lang, at = root.get(_XML + "lang"), full(root.get(_XML + "base", ""), base) if _XML + "base" in root.attrib else base
    for node in root if root.tag == _R + "RDF" else [root]:
        description(node, lang, at)
        yield from out
        out.clear()

