"""Schema rows to rule tables.

Every family of one-premise rules is folded into two tables, so that a round needs one broadcast join for all property rules and one for all type
rules, however large the ontology is.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from itertools import combinations

from hornloom.plans.lower import Schema
from hornloom.terms import LITERAL, THING, TYPE


@dataclass
class Rules:
    #: (p, v or None, subject from, new p, object from or "", class or value or ""): see operators.rules.
    by_property: list[tuple] = field(default_factory=list)
    #: (c, new p, new o)
    by_class: list[tuple[str, str, str]] = field(default_factory=list)
    universal: list[str] = field(default_factory=list)
    trans: list[str] = field(default_factory=list)
    chains: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    svf: list[tuple[str, str, str]] = field(default_factory=list)
    avf: list[tuple[str, str, str]] = field(default_factory=list)
    conj: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    #: The families that a row of by_property or by_class stands for.
    families: dict[tuple, list[str]] = field(default_factory=dict)
    swrl: list[tuple[tuple, tuple]] = field(default_factory=list)
    fp: list[str] = field(default_factory=list)
    ifp: list[str] = field(default_factory=list)
    mc1: list[tuple[str, str, str | None]] = field(default_factory=list)
    mc0: list[tuple[str, str, str | None]] = field(default_factory=list)
    keys: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    same: list[tuple[str, str]] = field(default_factory=list)
    different: list[tuple[str, str]] = field(default_factory=list)
    disjoint: list[tuple[str, str]] = field(default_factory=list)
    compl: list[tuple[str, str]] = field(default_factory=list)
    pdisjoint: list[tuple[str, str]] = field(default_factory=list)
    irr: list[str] = field(default_factory=list)
    asym: list[str] = field(default_factory=list)
    neg: list[tuple[str, str, str]] = field(default_factory=list)
    active: list[str] = field(default_factory=list)
    stats: dict[str, int] = field(default_factory=dict)


def closure(pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """All pairs of different nodes that a path joins; cycles are fine."""
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    out = set()
    for a in list(after):
        seen, todo = set(), list(after[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after.get(b, ())
        out |= {(a, b) for b in seen if b != a}
    return out


def pairs(groups: list[tuple[str, ...]]) -> list[tuple[str, str]]:
    return sorted({(a, b) for g in groups for a, b in combinations(g, 2)})


def compile_schema(s: Schema, sound: bool = False) -> Rules:
    top = {THING, LITERAL}
    r = Rules()
    sub, subp = closure(s.sub), closure(s.subp)
    r.universal = sorted({b for a, b in sub if a == THING and b not in top})
    sub = {(a, b) for a, b in sub if a not in top and b not in top}

    def add(rows, family, *row):
        rows.append(row)
        if family not in r.families.setdefault(row, []):
            r.families[row].append(family)

    def action(family, *row):
        add(r.by_property, family, *row)

    for p, q in sorted(subp):
        action("subproperty", p, None, "s", q, "o", "")
    for p, q in sorted(s.inv):
        action("inverse", p, None, "o", q, "s", "")
    for p in sorted(s.sym):
        action("symmetric", p, None, "o", p, "s", "")
    for p, c in sorted(s.dom):
        if c not in top:
            action("domain", p, None, "s", TYPE, "", c)
    for p, c in sorted(s.rng):
        if c not in top:
            action("range", p, None, "o", TYPE, "", c)
    for p, v, c in sorted(s.hv_in):
        if c not in top:
            action("has-value", p, v, "s", TYPE, "", c)
    for p, d, c in sorted(s.svf):
        if c in top:
            continue
        if d in top:
            action("some-values-from", p, None, "s", TYPE, "", c)
        else:
            r.svf.append((p, d, c))
    for a, b in sorted(sub):
        add(r.by_class, "subclass", a, TYPE, b)
    avf_top = []
    for c, p, v in sorted(s.hv_out):
        if c not in top:
            add(r.by_class, "has-value", c, p, v)
    for c, p, f in sorted(s.avf):
        if f not in top:
            (avf_top if c in top else r.avf).append((c, p, f))
    if sound:  # everything is a thing
        for _, p, f in avf_top:
            action("all-values-from", p, None, "o", TYPE, "", f)
    for parts, c, is_range in s.conj:
        rest = tuple(sorted({x for x in parts if x not in top}))
        if c not in top:
            if len(rest) == 1:
                add(r.by_class, "intersection", rest[0], TYPE, c)
            elif rest:
                r.conj.append((rest, c))
            elif parts:
                r.universal.append(c)
        # The reverse direction: right for data ranges; for classes only the compatible profile draws it.
        if (is_range or not sound) and c not in top:
            for x in rest:
                add(r.by_class, "intersection", c, TYPE, x)
    # A chain of the property itself makes it transitive, whatever its length.
    r.chains = [(q, chain) for q, chain in sorted(s.chains) if set(chain) != {q}]
    r.trans = sorted(s.trans | {q for q, chain in s.chains if set(chain) == {q}})
    plain = lambda rows: sorted({(c, p, None if f in top else f) for c, p, f in rows}, key=str)
    r.mc0, r.mc1 = plain(s.mc0), plain(s.mc1)
    r.fp, r.ifp = sorted(s.fp), sorted(s.ifp)
    if sound:
        r.fp = sorted({*r.fp, *(p for c, p, f in r.mc1 if c in top and f is None)})
    r.keys = list(dict.fromkeys(s.keys))
    r.same, r.different, r.disjoint, r.pdisjoint = (pairs(x) for x in (s.same, s.different, s.disjoint, s.pdisjoint))
    r.compl, r.neg, r.irr, r.asym = sorted(s.compl), sorted(s.neg), sorted(s.irr), sorted(s.asym)
    r.by_class, r.by_property = list(dict.fromkeys(r.by_class)), list(dict.fromkeys(r.by_property))
    for body, head in s.swrl:
        bound = {a[1] for atom in body for a in atom[1:] if isinstance(a, tuple)}
        for h in head:
            if all(a[1] in bound for a in h[1:] if isinstance(a, tuple)):
                r.swrl.append((body, h))
    predicates = {x[0] for x in r.by_property} | {x[0] for x in r.svf} | {x[1] for x in r.avf} | {p for _, chain in r.chains for p in chain} | {*r.trans, *r.fp, *r.ifp} | {x[1] for x in r.mc0 + r.mc1}
    classes = {x[0] for x in r.by_class} | {x[1] for x in r.svf} | {x[0] for x in r.avf + r.mc0 + r.mc1} | {c for parts, _ in r.conj for c in parts}
    names = {
        "subclass-propagation": sub, "universal-type": r.universal, "subproperty-propagation": subp, "domain": s.dom, "range": s.rng, "inverse": s.inv, "symmetric": s.sym, "transitive": r.trans, "property-chain": r.chains, "has-value": s.hv_in | s.hv_out,
        "some-values-from": s.svf, "all-values-from": r.avf, "intersection": r.conj, "functional-property": r.fp, "inverse-functional-property": r.ifp, "max-cardinality": r.mc1, "has-key": r.keys, "swrl": r.swrl,
    }
    r.active = [k for k, v in names.items() if v]
    # The names of the report's counters. The schema is closed by graph search, not in rounds.
    r.stats = {
        "subclass_closure_size": len(sub), "subproperty_closure_size": len(subp), "domain_entries": len(s.dom), "range_entries": len(s.rng), "inverse_entries": len(s.inv), "property_chains": len(r.chains),
        "chain_trigger_entries": len({(p, q, chain) for q, chain in r.chains for p in chain}), "universal_types": len(r.universal), "has_value_rules": len(s.hv_in | s.hv_out), "some_values_from_rules": len(s.svf),
        "all_values_from_rules": len(r.avf), "intersection_rules": len(r.conj), "max_cardinality_one_rules": len(r.mc1), "swrl_rules_compiled": len(r.swrl), "indexed_predicates": len(predicates), "indexed_classes": len(classes),
        "proxy_terms": len(s.display), "schema_closure_iterations": 0, "schema_closure_inferred": 0,
    }
    return r
