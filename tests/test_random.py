"""Random facts and ontologies against a naive evaluator; many small worlds with names of their own go through one run."""

import random
from collections import defaultdict
from itertools import product

from hornloom.plans.compile import compile_schema
from hornloom.plans.lower import lower
from hornloom.plans.reason import Options, reason
from hornloom.terms import PROXY, TYPE, is_literal


def naive(facts, r):
    """Applies every rule to all facts until nothing is new."""
    known = set(facts)
    while True:
        new = set()
        by_p = defaultdict(set)
        for s, p, o in known:
            by_p[p].add((s, o))
        types = by_p[TYPE]
        for p, v, side, q, end, const in r.by_property:
            for s, o in by_p[p] if p != TYPE else ():
                if v is None or v == o:
                    new.add((s if side == "s" else o, q, {"s": s, "o": o, "": const}[end]))
        for c, q, x in r.by_class:
            new |= {(s, q, x) for s, d in types if d == c}
        for p, d, c in r.svf:
            new |= {(s, TYPE, c) for s, o in by_p[p] if (o, d) in types}
        for a, p, b in r.avf:
            new |= {(o, TYPE, b) for s, o in by_p[p] if (s, a) in types}
        for parts, c in r.conj:
            new |= {(s, TYPE, c) for s, _ in types if all((s, x) in types for x in parts)}
        for q, chain in [*((t, (t, t)) for t in r.trans), *r.chains]:
            paths = by_p[chain[0]]
            for p in chain[1:]:
                paths = {(a, d) for (a, b), (c, d) in product(paths, by_p[p]) if b == c}
            new |= {(a, q, b) for a, b in paths}
        if new <= known:
            return known
        known |= new


def world(seed):
    r = random.Random(seed)
    n = lambda kind, i: f"<w{seed}:{kind}{i}>"
    cls, prop, ind = lambda: n("C", r.randrange(6)), lambda: n("p", r.randrange(4)), lambda: n("i", r.randrange(7))
    facts = {(ind(), prop(), ind()) for _ in range(9)} | {(ind(), TYPE, cls()) for _ in range(4)}

    def sub(depth=1):
        k = r.randrange(6) if depth else 0
        return [cls, cls, lambda: ("ObjectSomeValuesFrom", prop(), sub(0)), lambda: ("ObjectIntersectionOf", sub(0), sub(0)), lambda: ("ObjectUnionOf", sub(0), sub(0)), lambda: ("ObjectHasValue", prop(), ind())][k]()

    def sup(depth=1):
        k = r.randrange(5) if depth else 0
        return [cls, cls, lambda: ("ObjectAllValuesFrom", prop(), sup(0)), lambda: ("ObjectIntersectionOf", sup(0), sup(0)), lambda: ("ObjectHasValue", prop(), ind())][k]()

    axioms = [("SubClassOf", sub(), sup()) for _ in range(5)]
    for _ in range(3):
        axioms.append(r.choice([
            lambda: ("SubObjectPropertyOf", prop(), prop()), lambda: ("ObjectPropertyDomain", prop(), sup()), lambda: ("ObjectPropertyRange", prop(), sup()), lambda: ("InverseObjectProperties", prop(), prop()), lambda: ("SymmetricObjectProperty", prop()),
            lambda: ("TransitiveObjectProperty", prop()), lambda: ("SubObjectPropertyOf", ("ObjectPropertyChain", prop(), prop()), prop()), lambda: ("SubObjectPropertyOf", ("ObjectPropertyChain", prop(), prop(), prop()), prop()), lambda: ("EquivalentClasses", cls(), sub()),
        ])())
    return facts, axioms


def test_random_worlds(spark):
    worlds = [world(seed) for seed in range(60)]
    facts = [t for f, _ in worlds for t in sorted(f)]
    axioms = [a for _, ax in worlds for a in ax]
    result = reason(spark, spark.createDataFrame(facts, "s string, p string, o string"), axioms, Options(sound=True))
    got = {tuple(r) for r in result.closure().collect()}
    want = set()
    for f, ax in worlds:
        want |= {t for t in naive(f, compile_schema(lower(ax), sound=True)) if not any(x.startswith(PROXY) for x in t) and not is_literal(t[0])}
    assert got == want
