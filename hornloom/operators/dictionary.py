"""Encoding of terms to ids and back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornloom.operators.tables import id_column, id_of

#: Frequent terms of a column that are broadcast, at most; ids with so many rows are frequent in any case.
FEW, OFTEN = 1000, 10_000


def encode(triples: DataFrame) -> DataFrame:
    """(s, p, o) as text to ids."""
    return triples.select(*(id_column(F.col(c)).alias(c) for c in ("s", "p", "o")))


def build(triples: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    """(id, term) of all terms of the triples and the given ones. Reading it fails if two terms have one id."""
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()
    extra = triples.sparkSession.createDataFrame([(t,) for t in more], "term string")
    terms = terms.unionByName(extra).distinct()
    both = terms.select(id_column(F.col("term")).alias("id"), "term").groupBy("id").agg(F.min("term").alias("term"), F.max("term").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two terms share an id: "), F.col("term"), F.lit(" "), F.col("other")))
    return both.select("id", F.when(F.col("term") == F.col("other"), F.col("term")).otherwise(clash).alias("term"))


def _frequent(facts: DataFrame, columns: tuple[str, ...]) -> dict[str, tuple[list[int], bool]]:
    """For each column the ids that fill many of its rows, FEW at most, and whether there are no others."""
    top = facts.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in columns), *(F.expr(f"approx_top_k({c}, {FEW}, {10 * FEW})").alias(c) for c in columns)).first()
    out = {c: [x["item"] for x in top[c] or () if x["item"] is not None and x["count"] >= min(OFTEN, 1 + top["n"] // FEW)] for c in columns}
    # The counts are estimates, so whether that is all is looked up.
    likely = [c for c in columns if len(out[c]) < FEW and sum(x["count"] for x in top[c] or () if x["item"] in set(out[c])) >= top[f"n_{c}"]]
    others = facts.agg(*(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(out[c]) if out[c] else F.col(c).isNotNull()).alias(c) for c in likely)).first() if likely else {}
    return {c: (out[c], c in likely and not others[c]) for c in columns}


def decode(facts: DataFrame, dictionary: DataFrame, columns: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """The ids of the columns as terms.

    Terms of frequent ids are broadcast: joined by a shuffle, all rows of a property, class or country would meet in one task, and so would empty cells.
    """
    often, out = _frequent(facts, columns), facts
    for c in sorted(columns, key=lambda c: often[c][1]):
        ids, all_ = often[c]
        names = dictionary.select(F.col("id").alias(f"_{c}"), F.col("term").alias(f"_{c}_term"))
        text = F.lit(None).cast("string")
        if ids:
            hot = F.broadcast(dictionary.where(F.col("id").isin(ids)).select(F.col("id").alias(f"_{c}_hot"), F.col("term").alias(f"_{c}_hot_term")))
            out, text = out.join(hot, F.col(c) == F.col(f"_{c}_hot"), "left"), F.col(f"_{c}_hot_term")
        if not all_:
            # Rows that have their term, or no id, are dealt by their other columns and find nothing.
            rest = F.col(c).isNotNull() & text.isNull()
            out = out.withColumn(f"_{c}_rest", rest).withColumn(f"_{c}_key", F.when(rest, F.col(c)).otherwise(F.xxhash64(*facts.columns)))
            out = out.join(names, (F.col(f"_{c}_key") == F.col(f"_{c}")) & F.col(f"_{c}_rest"), "left")
            text = F.coalesce(text, f"_{c}_term")
        out = out.withColumn(c, text).select(*facts.columns)
    return out


__all__ = ["build", "decode", "encode", "id_of"]
