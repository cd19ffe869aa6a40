"""Consistency checks: one query per kind of violation, run once over all facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornloom.operators import equality
from hornloom.operators.rules import _types
from hornloom.operators.tables import among, id_of, small
from hornloom.plans.compile import Rules

#: Message templates; %s take the terms a, b, c, d in order.
MESSAGES = {
    "DisjointClasses": "%s is a member of the disjoint classes %s and %s", "ComplementOf": "%s is a member of %s and of its complement %s", "DisjointProperties": "%s and %s are linked by the disjoint properties %s and %s",
    "MaxCardinalityZero": "%s, a member of %s, has the value %s for %s, of which it may have none", "Irreflexive": "%s is linked with itself by the irreflexive property %s", "Asymmetric": "%s and %s are linked both ways by the asymmetric property %s",
    "NegativeAssertion": "the triple %s %s %s is stated to be false", "DifferentIndividuals": "%s and %s are the same and different", "LiteralConflict": "%s has the different literals %s and %s for %s, of which it may have one",
}
RESULT = "kind string, a long, b long, c long, d long"


def violations(known: DataFrame, rules: Rules, label: DataFrame | None) -> DataFrame:
    """(kind, a, b, c, d) of ids."""
    spark, out = known.sparkSession, []
    ids = lambda rows: sorted({id_of(t) for r in rows for t in r})

    def add(kind: str, df: DataFrame, *columns: str) -> None:
        cols = [F.col(c) for c in columns] + [F.lit(None).cast("long")] * (4 - len(columns))
        out.append(df.select(F.lit(kind).alias("kind"), *(c.alias(n) for c, n in zip(cols, "abcd", strict=True))))

    for kind, rows in (("DisjointClasses", rules.disjoint), ("ComplementOf", rules.compl)):
        if rows:
            table = small(spark, [(id_of(a), id_of(b)) for a, b in rows], "ra long, rb long")
            left = among(_types(known, "x", "ca"), "ca", ids(rows)).join(table, F.col("ca") == F.col("ra"))
            right = among(_types(known, "y", "cb"), "cb", ids(rows))
            add(kind, left.join(right, (F.col("x") == F.col("y")) & (F.col("rb") == F.col("cb"))), "x", "ca", "cb")
    if rules.pdisjoint:
        table = small(spark, [(id_of(a), id_of(b)) for a, b in rules.pdisjoint], "ra long, rb long")
        left = among(known, "p", ids(rules.pdisjoint)).join(table, F.col("p") == F.col("ra")).select("s", "p", "o", "rb")
        right = among(known, "p", ids(rules.pdisjoint)).select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
        add("DisjointProperties", left.join(right, (F.col("s") == F.col("s2")) & (F.col("o") == F.col("o2")) & (F.col("rb") == F.col("p2"))), "s", "o", "p", "p2")
    for filled in (False, True):
        rows = [(id_of(c), id_of(p), id_of(f) if f else 0) for c, p, f in rules.mc0 if (f is not None) == filled]
        if rows:
            table = small(spark, rows, "rc long, rp long, rf long")
            x = among(known, "p", sorted({r[1] for r in rows})).join(table, F.col("p") == F.col("rp"))
            x = x.join(_types(known, "ts", "tc"), (F.col("s") == F.col("ts")) & (F.col("rc") == F.col("tc")), "left_semi")
            if filled:
                x = x.join(_types(known, "ts", "tc"), (F.col("o") == F.col("ts")) & (F.col("rf") == F.col("tc")), "left_semi")
            add("MaxCardinalityZero", x, "s", "rc", "o", "p")
    if rules.irr:
        add("Irreflexive", among(known, "p", [id_of(p) for p in rules.irr]).where("s = o"), "s", "p")
    if rules.asym:
        x = among(known, "p", [id_of(p) for p in rules.asym]).where("s <> o")
        back = x.select(F.col("s").alias("o2"), F.col("p").alias("p2"), F.col("o").alias("s2"))
        add("Asymmetric", x.where("s < o").join(back, (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")) & (F.col("o") == F.col("o2"))), "s", "o", "p")
    if rules.neg:
        table = small(spark, [tuple(map(id_of, t)) for t in rules.neg], "rp long, rs long, ro long")
        add("NegativeAssertion", known.join(table, (F.col("s") == F.col("rs")) & (F.col("p") == F.col("rp")) & (F.col("o") == F.col("ro")), "left_semi"), "s", "p", "o")
    if label is not None:
        roots = label.select(F.col("id").alias("i"), "root")
        x = equality.different(known, rules).join(roots, F.col("a") == F.col("i")).select("a", "b", F.col("root").alias("ra"))
        x = x.join(roots, F.col("b") == F.col("i")).where(F.col("ra") == F.col("root"))
        add("DifferentIndividuals", x, "a", "b")
    if rules.fp or rules.mc1:
        add("LiteralConflict", equality.conflicts(known, rules), "s", "l1", "l2", "p")
    if not out:
        return spark.createDataFrame([], RESULT)
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.distinct()
