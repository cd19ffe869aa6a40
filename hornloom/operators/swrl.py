"""Rules with a body of any atoms (SWRL) as joins: one variant per body atom that new facts can match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornloom.operators.rules import TYPE_ID
from hornloom.operators.tables import id_of
from hornloom.terms import SAME_AS

#: The predicate under which different individuals are kept among the facts; it never leaves the engine.
DIFFERENT = "<urn:hornloom:different>"
SAME_ID, DIFFERENT_ID = id_of(SAME_AS), id_of(DIFFERENT)


def _atom(facts: DataFrame, atom: tuple, same: DataFrame | None) -> DataFrame:
    """The bindings of an atom's variables: columns are named by the variables."""
    kind, *args = atom
    if kind == "type":
        rows, ends = facts.where((F.col("p") == TYPE_ID) & (F.col("o") == id_of(args[1]))).select("s"), [("s", args[0])]
    elif kind == "prop":
        rows, ends = facts.where(F.col("p") == id_of(args[1])).select("s", "o"), [("s", args[0]), ("o", args[2])]
    elif kind == "diff":
        rows, ends = facts.where(F.col("p") == DIFFERENT_ID).select("s", "o"), [("s", args[0]), ("o", args[1])]
    else:
        rows, ends = same, [("s", args[0]), ("o", args[1])]
        for a in args:
            if isinstance(a, str):  # a constant is the same as itself
                rows = rows.unionByName(facts.sparkSession.createDataFrame([(id_of(a), id_of(a))], "s long, o long"))
    names: dict[str, str] = {}
    for column, a in ends:
        if isinstance(a, str):
            rows = rows.where(F.col(column) == id_of(a))
        elif a[1] in names:
            rows = rows.where(F.col(column) == F.col(names[a[1]]))
        else:
            names[a[1]] = column
    if not names:
        return rows.select(F.lit(1).alias("_one")).limit(1)
    # Facts and pairs of equals are distinct, and every column that is left out is fixed.
    return rows.select(*(F.col(c).alias(v) for v, c in names.items()))


def _variables(atom: tuple) -> set[str]:
    return {a[1] for a in atom[1:] if isinstance(a, tuple)}


def _join(parts: list[tuple[tuple, DataFrame]]) -> DataFrame:
    """Joins the atoms' bindings, always next to what is bound where possible."""
    atom, out = parts[0]
    bound, left = _variables(atom), parts[1:]
    while left:
        k = next((i for i, (a, _) in enumerate(left) if _variables(a) & bound), 0)
        atom, rows = left.pop(k)
        shared = sorted(_variables(atom) & bound)
        renamed = rows.select(*(F.col(c).alias(f"_r_{c}" if c in shared else c) for c in rows.columns if c != "_one")) if _variables(atom) else rows.select(F.col("_one").alias(f"_one{len(left)}"))
        if shared:
            on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_r_{c}") for c in shared))
            out = out.join(renamed, on).drop(*(f"_r_{c}" for c in shared))
        else:  # the rule itself asks for all combinations of unrelated atoms
            out = out.crossJoin(renamed)
        bound |= _variables(atom)
    return out


def _head(rows: DataFrame, head: tuple) -> DataFrame:
    kind, *args = head
    value = lambda a: F.lit(id_of(a)) if isinstance(a, str) else F.col(a[1])
    if kind == "type":
        return rows.select(value(args[0]).alias("s"), F.lit(TYPE_ID).alias("p"), F.lit(id_of(args[1])).alias("o"))
    if kind == "prop":
        return rows.select(value(args[0]).alias("s"), F.lit(id_of(args[1])).alias("p"), value(args[2]).alias("o"))
    a, b = map(value, args)
    if kind == "same":
        return rows.select(a.alias("s"), F.lit(SAME_ID).alias("p"), b.alias("o")).where("s <> o")
    ends = F.explode(F.array(F.struct(a.alias("s"), b.alias("o")), F.struct(b.alias("s"), a.alias("o"))))
    return rows.select(ends.alias("e")).select("e.s", F.lit(DIFFERENT_ID).alias("p"), "e.o")


def apply(body: tuple, head: tuple, delta: DataFrame | None, known: DataFrame, same: DataFrame | None) -> list[DataFrame]:
    """The candidates of a rule: one frame per atom that takes new facts, or (delta None) one over all facts."""
    if any(a[0] == "same" for a in body) and same is None:
        return []
    if delta is None:
        return [_head(_join([(a, _atom(known, a, same)) for a in body]), head)]
    out = []
    for i, atom in enumerate(body):
        if atom[0] != "same":
            parts = [(atom, _atom(delta, atom, same)), *((a, _atom(known, a, same)) for j, a in enumerate(body) if j != i)]
            out.append(_head(_join(parts), head))
    return out
