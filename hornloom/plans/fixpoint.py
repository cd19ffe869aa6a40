"""The fixpoint: rounds of new facts only (semi-naive), with equality as an outer loop.

A round makes candidates from the last round's new facts, drops repeated and known ones, and writes what is new. Known facts are only scanned
for the test (candidates are the side that Spark may broadcast after measuring them), not shuffled, unless a round's candidates are large.
Every round's facts are a Parquet table in the shared folder, so a lost executor never costs more than the round at work; tables are merged every COMPACT rounds.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornloom.operators import equality, paths, swrl
from hornloom.operators.rules import TYPE_ID, RuleTables, candidates, firings
from hornloom.operators.swrl import DIFFERENT_ID
from hornloom.operators.tables import FACT, id_of, settle
from hornloom.plans.compile import Rules
from hornloom.terms import SAME_AS, TYPE

log = logging.getLogger("hornloom")

COMPACT = 8
#: Up to this many candidates Spark broadcasts them to the known facts (24 bytes each); beyond, the known facts are shuffled once.
FEW = 400_000
#: Properties and classes that the driver keeps a list of, at most.
KINDS = 500


@dataclass
class Outcome:
    asserted: DataFrame
    known: DataFrame
    label: DataFrame | None
    #: The known facts that are not asserted, where the run started from all facts; None if there are none.
    derived: DataFrame | None = None
    #: Places by the term of the property, where they stand for pairs of known facts that are two steps or more apart.
    paths: dict[str, DataFrame] = field(default_factory=dict)
    rounds: list[dict] = field(default_factory=list)
    equality_rounds: int = 0
    merges: int = 0
    #: Candidates by rule family, and rounds that had candidates (known ones count too).
    candidates: dict[str, int] = field(default_factory=dict)
    tries: int = 0
    reached: bool = False
    seconds: float = 0.0


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _mentioned(rules: Rules) -> set[str]:
    """All terms of rules and checks but the list of transitive properties."""
    out: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, str):
            out.add(x)
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)

    for k, value in vars(rules).items():
        if k not in ("trans", "active", "stats", "families"):
            walk(value)
    return out


def _class() -> Column:
    return F.when(F.col("p") == TYPE_ID, F.col("o")).otherwise(0)


def _is_kind(kinds: set[tuple[int, int]], prefix: str = "") -> Column:
    """Whether a fact is of one of these properties or classes."""
    p, o = F.col(f"{prefix}p"), F.col(f"{prefix}o")
    return ((p != TYPE_ID) & p.isin([k for k, _ in kinds if k != TYPE_ID])) | ((p == TYPE_ID) & o.isin([c for k, c in kinds if k == TYPE_ID]))


class _Store:
    def __init__(self, asserted: DataFrame, work_dir: str | None):
        self.work_dir, self.parts = work_dir, [asserted]
        #: (property, class or 0) of all known facts, if they are few.
        rows = asserted.select("p", _class().alias("c")).distinct().limit(KINDS + 1).collect()
        self.kinds: set[tuple[int, int]] | None = {(r["p"], r["c"]) for r in rows} if len(rows) <= KINDS else None

    @property
    def known(self) -> DataFrame:
        return _union(self.parts)

    def fresh(self, cand: DataFrame, distinct: bool = False) -> tuple[DataFrame, int, int]:
        """The candidates (distinct: none comes twice) that are new, kept; their number, and how many of them are types.

        Candidates of a property or class of which nothing is known are new, so they are neither tested nor written again.
        """
        cand = settle(cand if distinct else cand.distinct(), "candidates", self.work_dir)
        counts = cand.groupBy("p", _class().alias("c")).count().limit(KINDS + 1).collect()
        made = {(r["p"], r["c"]): r["count"] for r in counts} if len(counts) <= KINDS else None
        common = None if made is None or self.kinds is None else set(made) & self.kinds
        if common and sum(made.values()) <= FEW:
            common = None  # a cheap test of all keeps the plans small
        k = self.known.select(*(F.col(c).alias(f"k{c}") for c in "spo"))
        on = (F.col("ks") == F.col("s")) & (F.col("kp") == F.col("p")) & (F.col("ko") == F.col("o"))
        parts = [] if common is None else [cand.where(~_is_kind(common))] if len(common) < len(made) else []
        kept = [] if common is None else [n for x, n in made.items() if x not in common]
        n, types = sum(kept), 0 if common is None else sum(n for (p, c), n in made.items() if p == TYPE_ID and (p, c) not in common)
        if common is None or common:
            rest = cand if common is None else cand.where(_is_kind(common))
            if (cand.count() if made is None else sum(made.values()) - n) <= FEW:
                k = k.join(rest, on, "left_semi")
            elif common is not None:
                k = k.where(_is_kind(common, "k"))
            new = settle(rest.join(k, on, "left_anti"), "delta", self.work_dir)
            m, t = new.agg(F.count("*"), F.count_if(F.col("p") == TYPE_ID)).first()
            n, types = n + m, types + t
            parts.append(new)
        delta = _union(parts) if parts else cand
        self.kinds = None if made is None or self.kinds is None or len(self.kinds | set(made)) > KINDS else self.kinds | set(made)
        if n:
            self.parts.append(delta)
            if len(self.parts) > COMPACT:
                # The parts are disjoint: merging them needs no distinct. The first stays, it is told from what is derived.
                self.parts = [self.parts[0], settle(_union(self.parts[1:]).hint("rebalance"), "facts", self.work_dir)]
        return delta, n, types


def materialize(spark: SparkSession, facts: DataFrame, rules: Rules, max_rounds: int | None = None, work_dir: str | None = None, count_candidates: bool = False, before: DataFrame | None = None, lazy: bool = False) -> Outcome:
    """facts: (s, p, o) ids of the asserted triples; before: facts that are complete already, to which these are added.

    lazy: a transitive property that nothing else reads or derives and whose facts are separate paths may be left to `Outcome.paths`.
    """
    began = time.perf_counter()
    extra = [(id_of(a), DIFFERENT_ID, id_of(b)) for x, y in rules.different for a, b in ((x, y), (y, x))]
    if extra:
        facts = facts.unionByName(spark.createDataFrame(extra, FACT))
    if before is None:
        asserted = settle(facts.distinct(), "asserted", work_dir)
        store = _Store(asserted, work_dir)
    else:
        store = _Store(before, work_dir)
        asserted, _, _ = store.fresh(facts)
    tables = RuleTables(spark, rules)
    out = Outcome(asserted, asserted, None)
    with_equality = bool(rules.same or rules.fp or rules.ifp or rules.mc1 or rules.keys) or any(h[0] == "same" for _, h in rules.swrl) or not store.known.where(F.col("p") == swrl.SAME_ID).isEmpty()
    if before is None and not with_equality and not rules.swrl:
        heads = {r[3] for r in rules.by_property} | {r[1] for r in rules.by_class} | {q for q, _ in rules.chains}
        if max_rounds is None and not count_candidates:
            tables.leave_repeats()
        tables.pure = sorted(id_of(p) for p in rules.trans if p not in heads)
        if lazy and max_rounds is None and not count_candidates:
            for p in sorted(set(rules.trans) - _mentioned(rules) - {TYPE, SAME_AS}):
                if (at := paths.places(asserted.where(F.col("p") == id_of(p)).select("s", "o"), work_dir)) is not None:
                    out.paths[p] = at
                    tables.trans.remove(id_of(p))
    same: DataFrame | None = None
    merged = 0

    def step(made: DataFrame) -> tuple[DataFrame, int]:
        """One round; past the cap any candidate, new or known, is an error."""
        if max_rounds is not None and out.tries >= max_rounds and not made.isEmpty():
            raise RuntimeError(f"maximum iterations ({max_rounds}) reached before fixpoint")
        delta, n, types = store.fresh(made)
        out.tries += 1
        if n:
            out.rounds.append({"iteration": len(out.rounds) + 1, "new": n, "new_types": types, "new_properties": n - types})
            log.debug("round %d: %d new facts, %d of them types", len(out.rounds), n, types)
        return delta, n

    def inner(delta: DataFrame, whole: bool) -> None:
        """Rounds until nothing is new. whole: rules with equality atoms start over all facts."""
        n, first = 1, delta is asserted
        while n:
            known = store.known
            made = candidates(delta, known, tables, first)
            first = False
            for body, head in rules.swrl:
                restart = whole and any(a[0] == "same" for a in body)
                made += [("swrl", x) for x in swrl.apply(body, head, None if restart else delta, known, same)]
            whole = False
            if not made:
                return
            if count_candidates:
                for name, x in made:
                    for family, count in firings(name, x, delta, tables):
                        out.candidates[family] = out.candidates.get(family, 0) + count
            delta, n = step(_union([x for _, x in made]))

    delta = asserted
    while True:
        inner(delta, same is not None)
        if not with_equality:
            break
        label = equality.components(equality.edges(store.known, rules), work_dir)
        ends, roots = label.count(), label.select("root").distinct().count()
        changed, merged = ends - roots != merged, ends - roots
        out.label = label
        out.equality_rounds += 1
        out.merges = merged
        if not merged:
            break
        same = equality.couples(label).where("id <> other").select(F.col("id").alias("s"), F.col("other").alias("o"))
        delta, n, types = store.fresh(equality.expand(store.known, label), distinct=True)
        if not n and not changed:
            break
        if n:
            out.rounds.append({"iteration": len(out.rounds) + 1, "new": n, "new_types": types, "new_properties": n - types})
    if out.paths:
        # The rounds in which the pairs would have been found.
        for i, n in enumerate(paths.news(x for at in out.paths.values() for x in paths.lengths(at))):
            if i == len(out.rounds):
                out.rounds.append({"iteration": i + 1, "new": 0, "new_types": 0, "new_properties": 0})
            out.rounds[i]["new"] += n
            out.rounds[i]["new_properties"] += n
        out.tries = len(out.rounds) + 1
    if before is None and len(store.parts) > 1:
        out.derived = _union(store.parts[1:])
    out.known, out.reached = store.known, True
    out.seconds = time.perf_counter() - began
    return out

