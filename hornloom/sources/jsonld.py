"""A parser of JSON-LD: the common subset (contexts inline or in local files, no network) -> triples of canonical terms."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import unquote, urljoin, urlparse

from hornloom.terms import FIRST, NIL, REST, TYPE, XSD, iri, literal

_WORDS = {"@id", "@type", "@value", "@language", "@graph", "@list", "@set", "@reverse", "@context", "@index", "@vocab", "@base", "@container", "@included"}


def parse(text: str, base: str = "", tag: str = "") -> Iterator[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    fresh = 0

    def blank() -> str:
        nonlocal fresh
        fresh += 1
        return f"_:{tag}j{fresh}"

    def extend(active: dict, local, at: str) -> dict:
        for c in local if isinstance(local, list) else [local]:
            if c is None:
                active = {}
            elif isinstance(c, str):
                place = urlparse(urljoin(at, c))
                if place.scheme not in ("file", ""):
                    raise ValueError(f"remote contexts are not fetched: {c}")
                with open(unquote(place.path) if place.scheme else os.path.abspath(c), encoding="utf-8") as f:
                    active = extend(active, json.load(f).get("@context", {}), at)
            else:
                active = {**active, **c}
        return active

    def expand(ctx: dict, key: str, vocab: bool, seen: frozenset = frozenset()) -> str | None:
        if key in _WORDS:
            return key
        if vocab and key in ctx and key not in seen:
            d = ctx[key]
            target = d.get("@id", d.get("@reverse", key)) if isinstance(d, dict) else d
            return None if target is None else key_of(ctx, key) if target == key else expand(ctx, target, True, seen | {key})
        return key_of(ctx, key) if vocab else reference(ctx, key)

    def key_of(ctx: dict, key: str) -> str | None:
        prefix, colon, rest = key.partition(":")
        if colon:
            if prefix == "_":
                return f"_:{tag}{rest}"
            if not rest.startswith("//") and prefix in ctx:
                return expand(ctx, prefix, True) + rest
            return key
        return ctx["@vocab"] + key if ctx.get("@vocab") is not None else None

    def reference(ctx: dict, value: str) -> str:
        prefix, colon, rest = value.partition(":")
        if colon:
            return key_of(ctx, value)
        return urljoin(ctx.get("@base") or base, value)

    def node_term(text: str) -> str:
        return text if text.startswith("_:") else iri(text)

    def scalar(ctx: dict, key: str, v) -> str:
        d = ctx.get(key) if isinstance(ctx.get(key), dict) else {}
        kind = d.get("@type")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return node_term(expand(ctx, v, kind == "@vocab") or v)
        if isinstance(v, bool):
            return literal("true" if v else "false", None, XSD + "boolean")
        if isinstance(v, int):
            return literal(str(v), None, expand(ctx, kind, True) if kind else XSD + "integer")
        if isinstance(v, float):
            if v.is_integer() and abs(v) < 1e21 and not kind:
                return literal(str(int(v)), None, XSD + "integer")
            mantissa, _, power = f"{v:.15E}".partition("E")
            return literal(f"{mantissa.rstrip('0')}{'0' if mantissa.rstrip('0').endswith('.') else ''}E{int(power)}", None, expand(ctx, kind, True) if kind else XSD + "double")
        if kind and kind not in ("@id", "@vocab", "@none"):
            return literal(v, None, expand(ctx, kind, True))
        return literal(v, d["@language"] if "@language" in d else ctx.get("@language"))

    def value(ctx: dict, key: str, v) -> list[str]:
        d = ctx.get(key) if isinstance(ctx.get(key), dict) else {}
        if isinstance(v, list):
            items = [x for e in v for x in value(ctx, key, e) if e is not None] if d.get("@container") != "@list" else [x for e in v for x in value({**ctx, key: {k: y for k, y in d.items() if k != "@container"}}, key, e)]
            return [chain(items)] if d.get("@container") == "@list" else items
        if v is None:
            return []
        if not isinstance(v, dict):
            return [scalar(ctx, key, v)]
        if "@context" in v:
            ctx = extend(ctx, v["@context"], base)
        short = {expand(ctx, k, True) or k: x for k, x in v.items()}
        if "@list" in short:
            inner = short["@list"]
            return [chain([x for e in (inner if isinstance(inner, list) else [inner]) for x in value(ctx, key, e)])]
        if "@set" in short:
            inner = short["@set"]
            return [x for e in (inner if isinstance(inner, list) else [inner]) for x in value(ctx, key, e)]
        if "@value" in short:
            x = short["@value"]
            if x is None:
                return []
            if "@type" in short and short["@type"]:
                return [literal(x if isinstance(x, str) else json.dumps(x), None, expand(ctx, short["@type"], True))]
            return [literal(x, short.get("@language"))] if isinstance(x, str) else [scalar({}, "", x)]
        if d.get("@container") == "@language":
            return [literal(t, None if lang == "@none" else lang) for lang, ts in v.items() for t in (ts if isinstance(ts, list) else [ts])]
        if d.get("@container") == "@index":
            return [x for e in v.values() for x in value({**ctx, key: {}}, key, e)]
        return [node(ctx, v)]

    def chain(items: list[str]) -> str:
        cells = [blank() for _ in items] + [NIL]
        for item, cell, rest in zip(items, cells, cells[1:], strict=False):
            out.extend([(cell, FIRST, item), (cell, REST, rest)])
        return cells[0]

    def node(ctx: dict, n: dict) -> str:
        if "@context" in n:
            ctx = extend(ctx, n["@context"], base)
        keys = {k: expand(ctx, k, True) for k in n}
        ident = next((n[k] for k, e in keys.items() if e == "@id"), None)
        s = node_term(reference(ctx, ident)) if ident is not None else blank()
        for k, e in keys.items():
            v = n[k]
            if e == "@type":
                for t in v if isinstance(v, list) else [v]:
                    out.append((s, TYPE, node_term(expand(ctx, t, True) or reference(ctx, t))))
            elif e in ("@graph", "@included"):
                for x in v if isinstance(v, list) else [v]:
                    node(ctx, x)
            elif e == "@reverse":
                for rk, rv in v.items():
                    for x in rv if isinstance(rv, list) else [rv]:
                        out.append((node(ctx, x) if isinstance(x, dict) else node_term(reference(ctx, x)), iri(expand(ctx, rk, True)), s))
            elif e and not e.startswith("@") and not e.startswith("_:") and ":" in e:
                back = isinstance(ctx.get(k), dict) and "@reverse" in ctx[k]
                for o in value(ctx, k, v):
                    out.append((o, iri(e), s) if back else (s, iri(e), o))
        return s

    top = json.loads(text)
    for n in top if isinstance(top, list) else [top]:
        node({}, n)
        yield from out
        out.clear()
