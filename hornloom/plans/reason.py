"""The whole run: facts and ontology in, entailed triples, inconsistencies and a report out."""

from __future__ import annotations

import resource
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornloom.operators import checks, equality, paths
from hornloom.operators.dictionary import build, decode, encode
from hornloom.operators.swrl import DIFFERENT, DIFFERENT_ID, SAME_ID
from hornloom.operators.tables import id_of, is_literal_id, settle, small
from hornloom.plans.compile import Rules, compile_schema
from hornloom.plans.fixpoint import Outcome, materialize
from hornloom.plans.lower import Schema, lower
from hornloom.sources.rdf_axioms import to_axioms
from hornloom.terms import OWL, PROXY, RDF, RDFS, SAME_AS, TYPE, datatype_column

#: The triples of a data file that state a schema.
SCHEMA_PREDICATES = [f"<{RDFS}{x}>" for x in ("subClassOf", "subPropertyOf", "domain", "range")]
SCHEMA_CLASSES = [f"<{RDFS}Class>", f"<{RDF}Property>", f"<{OWL}Class>", f"<{OWL}ObjectProperty>", f"<{OWL}DatatypeProperty>"]


class InconsistencyError(RuntimeError):
    pass


@dataclass
class Options:
    """sound: leave out what does not follow (reverse intersections, reflexive sameAs), and let owl:Thing hold everything."""

    extract_schema: bool = False
    ignore_annotations: bool = False
    sound: bool = False
    max_rounds: int | None = None
    inconsistency: str = "report"
    work_dir: str | None = None
    count_candidates: bool = False


@dataclass
class Result:
    spark: SparkSession
    outcome: Outcome
    dictionary: DataFrame
    schema: Schema
    rules: Rules
    options: Options
    violations: DataFrame | None = None
    report: dict = field(default_factory=dict)
    #: Triples read, ontology and literal types included; repeated ones count.
    triples: int = 0

    def _fit(self, x: DataFrame, columns: str) -> DataFrame:
        """No proxies."""
        if self.schema.display:
            hidden = small(self.spark, [(id_of(t),) for t in self.schema.display], "hidden long")
            for c in columns.split():
                x = x.join(hidden, F.col(c) == F.col("hidden"), "left_anti")
        return x

    def _shown(self, facts: DataFrame) -> DataFrame:
        """Facts fit for output as text: no proxies, no literal subjects, no internal predicates."""
        return decode(self._fit(facts.where(~is_literal_id(F.col("s")) & (F.col("p") != DIFFERENT_ID)), "s p o"), self.dictionary)

    def _pairs(self, but: DataFrame | None = None) -> DataFrame:
        """Every pair of equals as text, but for these facts. Members get their terms before they are paired, so that the pairs, of which there may be many, need no join of their own."""
        terms = decode(self._fit(self.outcome.label, "id").withColumn("term", F.col("id")), self.dictionary, ("term",))
        x = equality.couples(terms, ("term",)).where((F.col("id") != F.col("other")) & ~is_literal_id(F.col("id")))
        if but is not None:
            stated = but.where(F.col("p") == SAME_ID).select(F.col("s").alias("ks"), F.col("o").alias("ko"))
            if not stated.isEmpty():
                x = x.join(stated, (F.col("id") == F.col("ks")) & (F.col("other") == F.col("ko")), "left_anti")
        return x.select(F.col("term").alias("s"), F.lit(SAME_AS).alias("p"), F.col("other_term").alias("o"))

    def _with_more(self, facts: DataFrame, but: DataFrame | None = None) -> DataFrame:
        """The facts, pairs of equals and pairs of paths as text."""
        if self.outcome.label is not None:
            facts = facts.unionByName(self._pairs(but))
        for p, at in self.outcome.paths.items():
            x = paths.distant(decode(at.withColumn("term", F.col("id")), self.dictionary, ("term",)), "term").where(~is_literal_id(F.col("id")))
            facts = facts.unionByName(x.select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o")))
        return facts

    def _clean(self, facts: DataFrame) -> DataFrame:
        """Without reflexive sameAs in the sound profile, and without what _pairs() states."""
        x = facts.where((F.col("p") != SAME_ID) | (F.col("s") != F.col("o"))) if self.options.sound else facts
        return x if self.outcome.label is None else x.where((F.col("p") != SAME_ID) | (F.col("s") == F.col("o")))

    def _derived(self) -> DataFrame:
        if self.outcome.derived is not None:
            return self.outcome.derived
        k = self.outcome.asserted.select(*(F.col(c).alias(f"k{c}") for c in "spo"))
        return self.outcome.known.join(k, (F.col("s") == F.col("ks")) & (F.col("p") == F.col("kp")) & (F.col("o") == F.col("ko")), "left_anti")

    def inferred(self) -> DataFrame:
        # Every pair of equals is stated, also those that were asserted; the sound profile leaves those out again.
        return self._with_more(self._shown(self._clean(self._derived())), self.outcome.asserted if self.options.sound else None)

    def closure(self) -> DataFrame:
        return self._with_more(self._shown(self._clean(self.outcome.known)))

    def inconsistencies(self) -> DataFrame:
        """(kind, a, b, c, d) as text; proxies are shown as the expressions they stand for."""
        x = decode(self.violations, self.dictionary, ("a", "b", "c", "d"))
        if self.schema.display:
            shown = F.create_map(*(F.lit(t) for kv in self.schema.display.items() for t in kv))
            for c in "abcd":
                x = x.withColumn(c, F.when(F.col(c).startswith(PROXY), F.coalesce(F.element_at(shown, F.col(c)), F.col(c))).otherwise(F.col(c)))
        return self._pair_order(x)

    def _pair_order(self, x: DataFrame) -> DataFrame:
        """Pairs without a direction are shown in the order of their text."""
        for kinds, (i, j) in ((("DifferentIndividuals", "Asymmetric"), "ab"), (("LiteralConflict",), "bc")):
            swap = F.col("kind").isin(*kinds) & (F.col(i) > F.col(j))
            x = x.withColumns({i: F.when(swap, F.col(j)).otherwise(F.col(i)), j: F.when(swap, F.col(i)).otherwise(F.col(j))})
        return x

    def messages(self) -> DataFrame:
        """(kind, detail)."""
        x = self.inconsistencies()
        detail = F.lit(None).cast("string")
        for kind, text in checks.MESSAGES.items():
            detail = F.when(F.col("kind") == kind, F.format_string(text, *(F.col(c) for c in "abcd"[: text.count("%s")]))).otherwise(detail)
        return x.select("kind", detail.alias("detail"))


#: The names of the report's counters with the fields of the schema that they count, and those of rule families with ours.
COUNTERS = {
    "subclass_of": "sub", "sub_property_of": "subp", "domain": "dom", "range": "rng", "inverse_of": "inv", "symmetric_property": "sym", "transitive_property": "trans", "functional_property": "fp",
    "inverse_functional_property": "ifp", "property_chain": "chains", "has_value": "hv_in hv_out", "some_values_from": "svf", "all_values_from": "avf", "intersection_of": "conj", "complement_of": "compl",
    "one_of": "types", "max_cardinality_zero": "mc0", "max_cardinality_one": "mc1", "disjoint_classes": "disjoint", "disjoint_properties": "pdisjoint", "irreflexive_property": "irr", "asymmetric_property": "asym",
    "has_key": "keys", "same_individual": "same", "different_individuals": "different", "negative_property_assertion": "neg", "swrl_rules": "swrl",
}
FIRINGS = {
    "subclass": "subclass", "subproperty": "subproperty", "domain": "domain", "range": "range", "inverse": "inverse", "symmetric": "symmetric", "transitive": "transitive", "has_value": "has-value",
    "some_values_from": "some-values-from", "all_values_from": "all-values-from", "intersection": "intersection", "universal_type": "universal", "property_chain": "property-chain", "swrl": "swrl",
}


def split_schema(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schema triples, the others)."""
    is_schema = F.col("p").isin(SCHEMA_PREDICATES) | ((F.col("p") == TYPE) & F.col("o").isin(SCHEMA_CLASSES))
    return triples.where(is_schema), triples.where(~is_schema)


def terms_of(schema: Schema, rules: Rules) -> set[str]:
    """All terms that the ontology brings in."""
    out = {TYPE, SAME_AS, DIFFERENT, *schema.display}

    def walk(x) -> None:
        if isinstance(x, str):
            if x[:1] in ("<", "_", '"'):
                out.add(x)
        elif isinstance(x, (tuple, list, set)):
            for y in x:
                walk(y)

    for value in (*vars(schema).values(), *vars(rules).values()):
        if not isinstance(value, dict):
            walk(value)
    return out


def asserted(triples: DataFrame, schema: Schema, own: bool = True) -> DataFrame:
    """The triples, the datatypes of their literals where data ranges need them, and (own) the ontology's own assertions."""
    every = triples.select("s", "p", "o")
    if own and (schema.types or schema.props):
        every = every.unionByName(triples.sparkSession.createDataFrame([(s, TYPE, c) for s, c in sorted(schema.types)] + sorted(schema.props), "s string, p string, o string"))
    if schema.has_data_ranges:
        literals = every.where((F.col("p") != TYPE) & F.col("o").startswith('"')).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), datatype_column(F.col("o")).alias("o")).distinct()
        every = every.unionByName(literals)
    return every


def reason(spark: SparkSession, triples: DataFrame, axioms: list[tuple] | None = None, options: Options | None = None, residue: int = 0) -> Result:
    """triples: (s, p, o) as canonical text. Without axioms, or on request, the schema is taken out of the triples."""
    o, began = options or Options(), time.perf_counter()
    axioms = list(axioms or [])
    if o.extract_schema or not axioms:
        stated, triples = split_schema(triples)
        # Schema triples are the ontology's size, which the driver holds anyway.
        own, rest = to_axioms((r["s"], r["p"], r["o"]) for r in stated.collect())
        axioms += own
        residue += len(rest)
    schema = lower(axioms, o.ignore_annotations)
    rules = compile_schema(schema, o.sound)
    every = asserted(triples, schema)
    dictionary = settle(build(every, terms_of(schema, rules)), "dictionary", o.work_dir)
    ingested = time.perf_counter()
    outcome = materialize(spark, encode(every), rules, o.max_rounds, o.work_dir, o.count_candidates, lazy=not schema.display)
    result = Result(spark, outcome, dictionary, schema, rules, o)
    result.violations = settle(checks.violations(outcome.known, rules, outcome.label), "violations", o.work_dir)
    counts = {r["kind"]: r["count"] for r in result.violations.groupBy("kind").count().collect()}
    result.report = {
        "version": 2,
        "ontology": {"total_axioms": len(axioms)} | {shown: sum(len(getattr(schema, k)) for k in of.split()) for shown, of in COUNTERS.items()},
        "compiled": rules.stats,
        "rules": {"active": rules.active, "unsupported_encountered": dict(schema.unsupported), "residue": residue},
        "reasoning": {
            "strata": [{"name": "schema-closure", "iterations": 0, "inferred": 0, "time_ms": 0}, {"name": "abox-materialization", "iterations": len(outcome.rounds), "inferred": sum(r["new"] for r in outcome.rounds), "time_ms": int(outcome.seconds * 1000)}],
            "iterations": [{k: r[k] for k in ("iteration", "new_types", "new_properties")} for r in outcome.rounds], "total_inferred": sum(r["new"] for r in outcome.rounds), "total_iterations": outcome.tries, "fixpoint_reached": outcome.reached,
            "equality_merges": outcome.merges, "equality_iterations": outcome.equality_rounds, "rule_firings": {k: outcome.candidates.get(own, 0) for k, own in FIRINGS.items()} if o.count_candidates else {}, "inconsistencies": counts,
        },
        "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
        "ingest_time_ms": int((ingested - began) * 1000),
        "wall_time_ms": int((time.perf_counter() - began) * 1000),
    }
    if o.inconsistency == "halt" and counts:
        raise InconsistencyError("the facts are inconsistent: " + ", ".join(f"{k} ({n})" for k, n in sorted(counts.items())))
    return result
