"""Reasoning over a stream of triples: each micro-batch is added to the facts and only its consequences are derived.

A batch is added as a set, so a batch that is delivered again changes nothing; facts are never withdrawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hornloom.operators import checks
from hornloom.operators.dictionary import build, encode
from hornloom.operators.tables import settle
from hornloom.plans.compile import compile_schema
from hornloom.plans.fixpoint import Outcome, materialize
from hornloom.plans.lower import lower
from hornloom.plans.reason import Options, Result, asserted, terms_of


class IncrementalReasoner:
    def __init__(self, spark: SparkSession, axioms: list[tuple], options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.schema = lower(axioms, self.options.ignore_annotations)
        self.rules = compile_schema(self.schema, self.options.sound)
        self.given = sorted(terms_of(self.schema, self.rules))
        self.outcome: Outcome | None = None
        self.dictionary: DataFrame | None = None

    def update(self, triples: DataFrame) -> Outcome:
        """Adds (s, p, o) text triples and derives what follows from them; the first update also adds the ontology's own assertions."""
        o = self.options
        triples = asserted(triples, self.schema, own=self.outcome is None)
        new = build(triples, self.given)
        if self.dictionary is not None:
            both = new.unionByName(self.dictionary).groupBy("id").agg(F.min("term").alias("term"), F.max("term").alias("other"))
            clash = F.raise_error(F.concat(F.lit("two terms of different batches share an id: "), F.col("term"), F.lit(" "), F.col("other")))
            new = both.select("id", F.when(F.col("term") == F.col("other"), F.col("term")).otherwise(clash).alias("term"))
        self.dictionary = settle(new, "dictionary", o.work_dir)
        before = self.outcome.known if self.outcome else None
        self.outcome = materialize(self.spark, encode(triples), self.rules, o.max_rounds, o.work_dir, before=before)
        return self.outcome

    def _result(self) -> Result:
        return Result(self.spark, self.outcome, self.dictionary, self.schema, self.rules, self.options)

    def closure(self) -> DataFrame:
        """All triples so far, as text, as reason() gives them."""
        return self._result().closure()

    def inconsistencies(self) -> DataFrame:
        """All violations so far, as text, as reason() gives them."""
        result = self._result()
        result.violations = settle(checks.violations(self.outcome.known, self.rules, self.outcome.label), "violations", self.options.work_dir)
        return result.inconsistencies()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs over a streaming frame of (s, p, o)."""
        writer = stream.writeStream.foreachBatch(lambda df, _: self.update(df) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
