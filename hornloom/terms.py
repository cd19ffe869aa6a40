"""RDF terms as N-Triples text: one string column per term.

An IRI is `<...>`, a blank node `_:...`, a literal `"..."`, `"..."@lang` or `"..."^^<datatype>`; the first character tells the kind. The text is
canonical (plain and xsd:string literals have no datatype, a language tag stands alone, escapes are minimal), so equal terms are equal strings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary IRIs.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SWRL = "http://www.w3.org/2003/11/swrl#"
TYPE, FIRST, REST, NIL = (f"<{RDF}{x}>" for x in ("type", "first", "rest", "nil"))
SAME_AS, THING, NOTHING = (f"<{OWL}{x}>" for x in ("sameAs", "Thing", "Nothing"))
LITERAL = f"<{RDFS}Literal>"
PROXY = "<urn:hornloom:proxy/"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "swrl": SWRL, "xml": "http://www.w3.org/XML/1998/namespace"}

_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPED = re.compile(r'[\x00-\x1f\x7f-\x9f"\\]')
_UNESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_NAMED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04X}", text)


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        if len(code) > 1:
            return chr(int(code[1:], 16))
        if code not in _NAMED:
            raise ValueError(f"bad escape \\{code}")
        return _NAMED[code]

    return _UNESCAPE.sub(one, text) if "\\" in text else text


def iri(text: str) -> str:
    return f"<{text}>"


def literal(text: str, lang: str | None = None, datatype: str | None = None) -> str:
    """datatype: an IRI without brackets."""
    body = f'"{escape(text)}"'
    if lang:
        return f"{body}@{lang}"
    return body if datatype in (None, XSD + "string", RDF + "langString") else f"{body}^^<{datatype}>"


def is_literal(term: str) -> bool:
    return term[:1] == '"'


def datatype_of(term: str) -> str | None:
    """The bracketed datatype of a literal: also for plain and tagged ones."""
    if not is_literal(term):
        return None
    if term.endswith(">"):
        return term[term.rindex("^^") + 2 :]
    return f"<{RDF}langString>" if re.search(r'"@[A-Za-z0-9-]+$', term) else f"<{XSD}string>"


def datatype_column(term: Column) -> Column:
    return F.when(~term.startswith('"'), F.lit(None)).when(term.endswith(">"), F.regexp_extract(term, r"\^\^(<[^<>]*>)$", 1)).when(term.rlike(r'"@[A-Za-z0-9-]+$'), F.lit(f"<{RDF}langString>")).otherwise(F.lit(f"<{XSD}string>"))


def canonical(term: str) -> str:
    """The canonical text of a term in any N-Triples spelling."""
    if not is_literal(term):
        return "<" + unescape(term[1:-1]) + ">" if term[:1] == "<" else term
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?', term, re.S)
    if not m:
        raise ValueError(f"not a literal: {term[:80]}")
    return literal(unescape(m[1]), m[2], m[3] and unescape(m[3]))
