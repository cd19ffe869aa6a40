"""A parser of Turtle, TriG and the RDF part of N3 (also fit for N-Triples and N-Quads): text -> triples of canonical terms.

Graph names are read and dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from hornloom.terms import FIRST, NIL, PREFIXES, REST, TYPE, XSD, iri, literal, unescape

_TOKENS = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)
      |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
      |(?P<long>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
      |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<directive>@prefix\b|@base\b)
      |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      |(?P<type>\^\^)
      |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)(?![\w:]))
      |(?P<bnode>_:[\w](?:[\w.\-·]*[\w\-·])?)
      |(?P<mark>=>|<=|[.;,\[\](){}=])
      |(?P<name>(?:[^\W\d_][\w.\-]*)?:(?:(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-·]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%]))?)?)
      |(?P<word>[A-Za-z][\w-]*)""",
    re.X | re.S,
)


class Turtle:
    """One document; iterate over triples()."""

    def __init__(self, text: str, base: str = "", tag: str = ""):
        self.text, self.at, self.base, self.tag = text, 0, base, tag
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple[str, str, str]] = []
        self.fresh = 0
        self.kind, self.value = "", ""
        self.step()

    def step(self) -> tuple[str, str]:
        old = self.kind, self.value
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return old
            m = _TOKENS.match(self.text, self.at)
            if not m:
                line = self.text.count("\n", 0, self.at) + 1
                raise ValueError(f"line {line}: cannot read {self.text[self.at : self.at + 30]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return old

    def mark(self, value: str) -> bool:
        if self.kind == "mark" and self.value == value:
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.mark(value):
            raise ValueError(f"expected {value!r}, found {self.value!r}")

    def word(self, *values: str) -> str | None:
        if self.kind == "word" and self.value.lower() in values:
            return self.step()[1].lower()
        return None

    def resolve(self, text: str) -> str:
        text = unescape(text)
        return text if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) else urljoin(self.base, text) if text else self.base

    def named(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            if prefix not in PREFIXES:
                raise ValueError(f"unknown prefix {prefix}:")
            self.prefixes[prefix] = PREFIXES[prefix]
        return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.tag}g{self.fresh}"

    def triples(self) -> Iterator[tuple[str, str, str]]:
        while self.kind != "end":
            self.statement()
            yield from self.out
            self.out.clear()

    def statement(self) -> None:
        dotted = self.kind == "directive"
        directive = self.step()[1][1:] if dotted else self.word("prefix", "base")
        if directive == "prefix":
            name = self.step()[1]
            self.prefixes[name.partition(":")[0]] = self.resolve(self.step()[1][1:-1])
        elif directive == "base":
            self.base = self.resolve(self.step()[1][1:-1])
        if directive:
            if dotted:
                self.need(".")
            return
        if self.word("graph"):
            self.term()
            return self.graph()
        if self.kind == "mark" and self.value == "{":
            return self.graph()
        listed = self.kind == "mark" and self.value == "["
        subject = self.term()
        if self.kind == "mark" and self.value == "{":
            return self.graph()
        if not (listed and self.kind == "mark" and self.value == "."):
            self.predicates(subject)
        if self.kind != "mark" or self.value != ".":  # N-Quads: a graph name before the dot
            self.term()
        self.need(".")

    def graph(self) -> None:
        self.need("{")
        while not self.mark("}"):
            listed = self.kind == "mark" and self.value == "["
            subject = self.term()
            if not (listed and self.kind == "mark" and self.value in ".}"):
                self.predicates(subject)
            if not self.mark(".") and self.value != "}":
                raise ValueError(f"expected '.' or '}}', found {self.value!r}")
        self.mark(".")

    def predicates(self, subject: str) -> None:
        while True:
            if self.word("a"):
                predicate = TYPE
            elif self.mark("="):
                predicate = "<http://www.w3.org/2002/07/owl#sameAs>"
            else:
                predicate = self.term()
                if predicate[0] != "<":
                    raise ValueError(f"a predicate must be an IRI, not {predicate}")
            while True:
                self.out.append((subject, predicate, self.term()))
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.kind == "end" or self.kind == "mark" and self.value in ".]}":
                return

    def term(self) -> str:
        kind, value = self.step()
        if kind == "iri":
            return iri(self.resolve(value[1:-1]))
        if kind == "name":
            return self.named(value)
        if kind == "bnode":
            return f"_:{self.tag}{value[2:]}"
        if kind in ("string", "long"):
            cut = 3 if kind == "long" else 1
            text = unescape(value[cut:-cut])
            if self.kind == "lang":
                return literal(text, self.step()[1][1:])
            if self.kind == "type":
                self.step()
                return literal(text, None, self.term()[1:-1])
            return literal(text)
        if kind == "number":
            return literal(value, None, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "word" and value in ("true", "false"):
            return literal(value, None, XSD + "boolean")
        if kind == "mark" and value == "[":
            node = self.blank()
            if not self.mark("]"):
                self.predicates(node)
                self.need("]")
            return node
        if kind == "mark" and value == "(":
            items = []
            while not self.mark(")"):
                items.append(self.term())
            nodes = [self.blank() for _ in items] + [NIL]
            for item, node, rest in zip(items, nodes, nodes[1:], strict=False):
                self.out += [(node, FIRST, item), (node, REST, rest)]
            return nodes[0]
        raise ValueError(f"unexpected {value!r}")
