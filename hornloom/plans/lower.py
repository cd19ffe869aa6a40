"""Axioms to normalized schema rows: one list per rule family, all terms as canonical text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import permutations

from hornloom.terms import PROXY

#: Constructors that a position can use.
_SUPER = {"ObjectIntersectionOf", "ObjectAllValuesFrom", "ObjectHasValue", "ObjectMaxCardinality", "ObjectComplementOf", "DataAllValuesFrom", "DataHasValue", "DataMaxCardinality"}
_SUB = {"ObjectIntersectionOf", "ObjectUnionOf", "ObjectSomeValuesFrom", "ObjectHasValue", "ObjectOneOf", "DataSomeValuesFrom", "DataHasValue"}


@dataclass
class Schema:
    classes: set[str] = field(default_factory=set)
    properties: set[str] = field(default_factory=set)
    sub: set[tuple[str, str]] = field(default_factory=set)
    subp: set[tuple[str, str]] = field(default_factory=set)
    dom: set[tuple[str, str]] = field(default_factory=set)
    rng: set[tuple[str, str]] = field(default_factory=set)
    inv: set[tuple[str, str]] = field(default_factory=set)
    sym: set[str] = field(default_factory=set)
    trans: set[str] = field(default_factory=set)
    fp: set[str] = field(default_factory=set)
    ifp: set[str] = field(default_factory=set)
    irr: set[str] = field(default_factory=set)
    asym: set[str] = field(default_factory=set)
    hv_in: set[tuple[str, str, str]] = field(default_factory=set)  # (p, v, c): p v makes c
    hv_out: set[tuple[str, str, str]] = field(default_factory=set)  # (c, p, v): c makes p v
    svf: set[tuple[str, str, str]] = field(default_factory=set)  # (p, filler, c)
    avf: set[tuple[str, str, str]] = field(default_factory=set)  # (c, p, filler)
    conj: list[tuple[tuple[str, ...], str, bool]] = field(default_factory=list)  # (conjuncts, class, is a data range)
    chains: set[tuple[str, tuple[str, ...]]] = field(default_factory=set)
    mc0: set[tuple[str, str, str | None]] = field(default_factory=set)
    mc1: set[tuple[str, str, str | None]] = field(default_factory=set)
    keys: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    disjoint: list[tuple[str, ...]] = field(default_factory=list)
    compl: set[tuple[str, str]] = field(default_factory=set)
    pdisjoint: list[tuple[str, ...]] = field(default_factory=list)
    same: list[tuple[str, ...]] = field(default_factory=list)
    different: list[tuple[str, ...]] = field(default_factory=list)
    neg: set[tuple[str, str, str]] = field(default_factory=set)
    types: set[tuple[str, str]] = field(default_factory=set)
    props: set[tuple[str, str, str]] = field(default_factory=set)
    swrl: list[tuple[tuple, tuple]] = field(default_factory=list)
    has_data_ranges: bool = False
    unsupported: Counter = field(default_factory=Counter)
    display: dict[str, str] = field(default_factory=dict)


def show(x) -> str:
    return x if isinstance(x, str) else str(x) if isinstance(x, int) else f"{x[0]}({' '.join(map(show, x[1:]))})" if x and isinstance(x[0], str) and not x[0].startswith(("<", "_", '"')) else " ".join(map(show, x))


class Lowering:
    def __init__(self, ignore_annotations: bool = False):
        self.s, self.ignore_annotations = Schema(), ignore_annotations
        self.cache: dict[tuple, str] = {}

    # -- helpers --

    def proxy(self, kind: str, x) -> str:
        key = (kind, x)
        if key not in self.cache:
            self.cache[key] = f"{PROXY}{kind}{len(self.cache)}>"
            self.s.display[self.cache[key]] = show(x)
        return self.cache[key]

    def prop(self, p) -> str:
        if isinstance(p, str):
            return p
        inner = p[1]
        if not isinstance(inner, str):
            return self.prop(inner[1])
        name = self.proxy("inverse", inner)
        self.s.inv |= {(name, inner), (inner, name)}
        return name

    def useful_sub(self, x) -> bool:
        """Can anything be concluded from membership in x."""
        if isinstance(x, str):
            return True
        name, *args = x
        if name not in _SUB:
            return name == "DataIntersectionOf" and all(map(self.useful_sub, args))
        if name == "ObjectIntersectionOf":
            return len(args) >= 2 and all(map(self.useful_sub, args))
        if name == "ObjectUnionOf":
            return any(map(self.useful_sub, args))
        return self.useful_sub(args[1]) if name == "ObjectSomeValuesFrom" else self.range_ok(args[1]) if name == "DataSomeValuesFrom" else True

    def useful_super(self, x) -> bool:
        """Does membership in x make any conclusion."""
        if isinstance(x, str):
            return True
        name, *args = x
        if name not in _SUPER:
            return False
        if name == "ObjectIntersectionOf":
            return any(map(self.useful_super, args))
        if name == "ObjectAllValuesFrom":
            return self.useful_super(args[1])
        if name == "DataAllValuesFrom":
            return self.range_ok(args[1])
        if name.endswith("MaxCardinality"):
            filler = args[2] if len(args) > 2 else None
            return args[0] <= 1 and (filler is None or (self.range_ok(filler) if name[0] == "D" else self.useful_sub(filler)))
        return self.useful_sub(args[0]) if name == "ObjectComplementOf" else True

    def range_ok(self, x) -> bool:
        return isinstance(x, str) or (x[0] == "DataIntersectionOf" and all(map(self.range_ok, x[1:])))

    def data_range(self, x) -> str | None:
        if not self.range_ok(x):
            return None
        if isinstance(x, str):
            return x
        if ("range", x) in self.cache:
            return self.cache["range", x]
        name = self.proxy("range", x)
        self.s.conj.append((tuple(self.data_range(a) for a in x[1:]), name, True))
        return name

    def as_sub(self, x) -> str | None:
        """A class that holds all members of x."""
        if isinstance(x, str):
            return x
        if not self.useful_sub(x):
            return None
        new = ("sub", x) not in self.cache
        name = self.proxy("sub", x)
        if new:
            self.sub(x, name)
        return name

    def as_super(self, x) -> str | None:
        """A class whose members are all in x."""
        if isinstance(x, str):
            return x
        if not self.useful_super(x):
            return None
        new = ("super", x) not in self.cache
        name = self.proxy("super", x)
        if new:
            self.super(name, x)
        return name

    # -- positions --

    def super(self, c: str, x) -> None:
        s = self.s
        if isinstance(x, str):
            s.sub.add((c, x))
            return
        name, *args = x
        if name == "ObjectIntersectionOf":
            for a in args:
                self.super(c, a)
        elif name == "ObjectAllValuesFrom":
            if (f := self.as_super(args[1])) is not None:
                s.avf.add((c, self.prop(args[0]), f))
        elif name == "DataAllValuesFrom":
            if (f := self.data_range(args[1])) is not None:
                s.avf.add((c, args[0], f))
                s.has_data_ranges = True
        elif name in ("ObjectHasValue", "DataHasValue"):
            s.hv_out.add((c, self.prop(args[0]), args[1]))
        elif name == "ObjectComplementOf":
            if (f := self.as_sub(args[0])) is not None:
                s.compl.add((c, f))
        elif name in ("ObjectMaxCardinality", "DataMaxCardinality") and args[0] <= 1:
            filler = None
            if len(args) > 2:
                filler = self.data_range(args[2]) if name[0] == "D" else self.as_sub(args[2])
                if filler is None:
                    s.unsupported[f"{name} with an unusable filler"] += 1
                    return
                s.has_data_ranges |= name[0] == "D"
            (s.mc1 if args[0] else s.mc0).add((c, self.prop(args[1]), filler))

    def sub(self, x, c: str) -> None:
        s = self.s
        if isinstance(x, str):
            s.sub.add((x, c))
            return
        name, *args = x
        if name == "ObjectIntersectionOf":
            parts = tuple(dict.fromkeys(self.as_sub(a) for a in args)) if self.useful_sub(x) else ()
            if parts:
                s.conj.append((parts, c, False))
        elif name == "ObjectUnionOf":
            for a in args:
                self.sub(a, c)
        elif name == "ObjectSomeValuesFrom":
            if (f := self.as_sub(args[1])) is not None:
                s.svf.add((self.prop(args[0]), f, c))
        elif name == "DataSomeValuesFrom":
            if (f := self.data_range(args[1])) is not None:
                s.svf.add((args[0], f, c))
                s.has_data_ranges = True
        elif name in ("ObjectHasValue", "DataHasValue"):
            s.hv_in.add((self.prop(args[0]), args[1], c))
        elif name == "ObjectOneOf":
            s.types |= {(a, c) for a in args}

    def subclass(self, a, b) -> None:
        if isinstance(a, str):
            self.super(a, b)
        elif isinstance(b, str):
            self.sub(a, b)
        elif self.useful_sub(a) and self.useful_super(b):
            self.super(self.as_sub(a), b)

    # -- axioms --

    def axiom(self, ax: tuple) -> None:
        name, *args = ax
        s = self.s
        if name == "Declaration":
            kind, x = args[0]
            if kind == "Class":
                s.classes.add(x)
            elif kind.endswith("Property"):
                s.properties.add(x)
        elif name == "SubClassOf":
            self.subclass(*args)
        elif name == "EquivalentClasses":
            for a, b in permutations(args, 2):
                self.subclass(a, b)
        elif name in ("DisjointClasses", "DisjointUnion"):
            parts = args[1:] if name == "DisjointUnion" else args
            if name == "DisjointUnion":
                for a in parts:
                    self.subclass(a, args[0])
            group = tuple(c for c in map(self.as_sub, parts) if c is not None)
            if len(group) >= 2:
                s.disjoint.append(group)
        elif name == "SubObjectPropertyOf":
            a, b = args
            if isinstance(a, tuple) and a[0] == "ObjectPropertyChain":
                if len(a) >= 3:
                    s.chains.add((self.prop(b), tuple(map(self.prop, a[1:]))))
            else:
                s.subp.add((self.prop(a), self.prop(b)))
        elif name == "SubDataPropertyOf":
            s.subp.add((args[0], args[1]))
        elif name in ("EquivalentObjectProperties", "EquivalentDataProperties"):
            s.subp |= set(permutations(map(self.prop, args), 2))
        elif name in ("DisjointObjectProperties", "DisjointDataProperties"):
            if len(args) >= 2:
                s.pdisjoint.append(tuple(map(self.prop, args)))
        elif name == "InverseObjectProperties":
            a, b = map(self.prop, args)
            s.inv |= {(a, b), (b, a)}
        elif name in ("FunctionalObjectProperty", "FunctionalDataProperty"):
            s.fp.add(self.prop(args[0]))
        elif name == "InverseFunctionalObjectProperty":
            s.ifp.add(self.prop(args[0]))
        elif name == "SymmetricObjectProperty":
            s.sym.add(self.prop(args[0]))
        elif name == "TransitiveObjectProperty":
            s.trans.add(self.prop(args[0]))
        elif name == "IrreflexiveObjectProperty":
            s.irr.add(self.prop(args[0]))
        elif name == "AsymmetricObjectProperty":
            s.asym.add(self.prop(args[0]))
        elif name in ("ObjectPropertyDomain", "DataPropertyDomain"):
            if (c := self.as_super(args[1])) is not None:
                s.dom.add((self.prop(args[0]), c))
        elif name == "ObjectPropertyRange":
            if (c := self.as_super(args[1])) is not None:
                s.rng.add((self.prop(args[0]), c))
        elif name == "DataPropertyRange":
            if (c := self.data_range(args[1])) is not None:
                s.rng.add((args[0], c))
                s.has_data_ranges = True
        elif name in ("SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange"):
            if not self.ignore_annotations:
                {"S": s.subp, "D": s.dom, "R": s.rng}[name[0] if name[0] == "S" else name[18]].add((args[0], args[1]))
        elif name == "SameIndividual":
            named = tuple(a for a in args if a[0] == "<")
            if len(named) >= 2:
                s.same.append(named)
        elif name == "DifferentIndividuals":
            named = tuple(a for a in args if a[0] == "<")
            if len(named) >= 2:
                s.different.append(named)
        elif name in ("NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion"):
            p, a, b = args
            if isinstance(p, tuple):  # the inverse swaps the two
                p, a, b = p[1], b, a
            s.neg.add((p, a, b))
        elif name == "ClassAssertion":
            if args[1][0] == "<" and (c := self.as_super(args[0])) is not None:
                s.types.add((args[1], c))
        elif name == "ObjectPropertyAssertion":
            p, a, b = args
            if a[0] == "<" and b[0] == "<":
                s.props.add((b, p[1], a) if isinstance(p, tuple) else (a, p, b))
        elif name == "DataPropertyAssertion":
            p, a, b = args
            if a[0] == "<":
                s.props.add((a, p, b))
        elif name == "DatatypeDefinition":
            if (c := self.data_range(args[1])) is not None:
                s.sub |= {(args[0], c), (c, args[0])}
        elif name == "HasKey":
            c = self.as_sub(args[0])
            props = tuple(self.prop(p) for group in args[1:] for p in group)
            if c is not None and props:
                s.keys.append((c, props))
        elif name in ("DLSafeRule", "Rule"):
            self.rule(args)
        elif name in ("Import", "ReflexiveObjectProperty"):
            s.unsupported[name] += 1
        elif name not in ("AnnotationAssertion", "Annotation", "DGRule", "DescriptionGraph"):
            s.unsupported[name] += 1

    def rule(self, args: list) -> None:
        parts = {a[0]: a[1:] for a in args if isinstance(a, tuple) and a and a[0] in ("Body", "Head")}
        body, head = (self.atoms(parts.get(k, ()), k) for k in ("Body", "Head"))
        if body and head:
            self.s.swrl.append((body, head))
        else:
            self.s.unsupported["DLSafeRule"] += 1

    def atoms(self, atoms: tuple, part: str) -> tuple | None:
        out = []
        for name, *args in atoms:
            if any(isinstance(a, str) and a.startswith("_:") for a in args):
                return None
            if name == "ClassAtom":
                c = self.as_sub(args[0]) if part == "Body" else self.as_super(args[0])
                if c is None:
                    return None
                out.append(("type", args[1], c))
            elif name in ("ObjectPropertyAtom", "DataPropertyAtom"):
                p, a, b = args
                out.append(("prop", a, p, b) if isinstance(p, str) else ("prop", b, p[1], a))
            elif name in ("SameIndividualAtom", "DifferentIndividualsAtom"):
                out.append((name[0:4].lower().replace("diff", "diff"), *args))
            else:
                return None
        return tuple(out) or None


def lower(axioms: list[tuple], ignore_annotations: bool = False) -> Schema:
    low = Lowering(ignore_annotations)
    for ax in axioms:
        low.axiom(ax)
    return low.s
