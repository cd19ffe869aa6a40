"""Equality: edges between individuals, their connected components, and the expansion of facts over components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornloom.operators.rules import TYPE_ID, _types
from hornloom.operators.swrl import DIFFERENT_ID, SAME_ID
from hornloom.operators.tables import among, id_of, is_literal_id, settle, small
from hornloom.plans.compile import Rules

EDGE = "a long, b long"
#: Members of a component that one task meets at a time, about; the others go on in parts of their own.
PART = 1000


def components(edges: DataFrame, work_dir: str | None = None) -> DataFrame:
    """(id, root) of every end of the edges: root is the least id that can be reached.

    Every node takes the least label around it, then the label of its label; long paths shrink by half a round.
    """
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", work_dir)
    label = settle(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"), "labels", work_dir)
    while True:
        around = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        stepped = label.join(around, F.col("id") == F.col("a")).select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = label.select(F.col("id").alias("j"), F.col("root").alias("jr"))
        after = settle(stepped.join(jump, F.col("root") == F.col("j"), "left").select("id", F.least("root", "jr").alias("root"), "was"), "labels", work_dir)
        label = after.select("id", "root")
        if after.where("root <> was").isEmpty():
            return label


def _stars(groups: DataFrame, by: list[str], member: str) -> DataFrame:
    """Edges from every member of a group to the group's least."""
    least = groups.groupBy(*by).agg(F.min(member).alias("b")).select(*(F.col(c).alias(f"_{c}") for c in by), "b")
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    return groups.join(least, on).where(F.col(member) != F.col("b")).select(F.col(member).alias("a"), "b")


def _capped(known: DataFrame, rules: Rules) -> DataFrame:
    """(rule, p, s, o) of values that a functional property or a maximum of one holds equal."""
    spark = known.sparkSession
    parts = []
    if rules.fp:
        parts.append(among(known, "p", [id_of(p) for p in rules.fp]).select(F.lit(-1).alias("rule"), "p", "s", "o"))
    for filled in (False, True):
        rows = [(i, id_of(c), id_of(p), id_of(f) if f else 0) for i, (c, p, f) in enumerate(rules.mc1) if (f is not None) == filled]
        if not rows:
            continue
        table = small(spark, rows, "rule int, rc long, rp long, rf long")
        x = among(known, "p", sorted({r[2] for r in rows})).join(table, F.col("p") == F.col("rp"))
        x = x.join(_types(known, "ts", "tc"), (F.col("s") == F.col("ts")) & (F.col("rc") == F.col("tc")), "left_semi")
        if filled:
            x = x.join(_types(known, "ts", "tc"), (F.col("o") == F.col("ts")) & (F.col("rf") == F.col("tc")), "left_semi")
        parts.append(x.select("rule", "p", "s", "o"))
    if not parts:
        return spark.createDataFrame([], "rule int, p long, s long, o long")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0].unionByName(parts[1]).unionByName(parts[2])


def edges(known: DataFrame, rules: Rules) -> DataFrame:
    """(a, b) of individuals that must be equal."""
    spark = known.sparkSession
    out = known.where(F.col("p") == SAME_ID).select(F.col("s").alias("a"), F.col("o").alias("b"))
    if rules.same:
        out = out.unionByName(spark.createDataFrame([(id_of(a), id_of(b)) for a, b in rules.same], EDGE))
    if rules.fp or rules.mc1:
        out = out.unionByName(_stars(_capped(known, rules).where(~is_literal_id(F.col("o"))), ["rule", "p", "s"], "o"))
    if rules.ifp:
        out = out.unionByName(_stars(among(known, "p", [id_of(p) for p in rules.ifp]).where(~is_literal_id(F.col("s"))), ["p", "o"], "s"))
    for c, props in rules.keys:
        x = known.where((F.col("p") == TYPE_ID) & (F.col("o") == id_of(c))).select("s").distinct()
        for i, p in enumerate(props):
            x = x.join(known.where(F.col("p") == id_of(p)).select(F.col("s").alias(f"s{i}"), F.col("o").alias(f"k{i}")).distinct(), F.col("s") == F.col(f"s{i}")).drop(f"s{i}")
        out = out.unionByName(_stars(x, [f"k{i}" for i in range(len(props))], "s"))
    return out.where("a <> b").distinct()


def conflicts(known: DataFrame, rules: Rules) -> DataFrame:
    """(p, s, l1, l2): two different literals where one value is allowed (the two least of each group)."""
    x = _capped(known, rules).where(is_literal_id(F.col("o"))).groupBy("rule", "p", "s").agg(F.sort_array(F.collect_set("o")).alias("ls"))
    return x.where(F.size("ls") > 1).select("p", "s", F.get("ls", F.lit(0)).alias("l1"), F.get("ls", F.lit(1)).alias("l2")).distinct()


def _sized(label: DataFrame) -> DataFrame:
    """(id, root, n, part, parts): n is the size of the component, which is cut by id into parts of about PART members."""
    sizes = label.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "_root")
    parts = F.ceil(F.col("n") / PART).cast("int")
    return label.join(sizes, F.col("root") == F.col("_root")).drop("_root").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def _each_part(df: DataFrame, parts: str, part: str) -> DataFrame:
    """Every row once for each part of a component, so that the members of a large one are met by many tasks."""
    return df.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))


def couples(label: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, other): every ordered pair of a component, each with itself too; carried columns of label come for both, those of the other as other_*."""
    x = _sized(label)
    right = x.select(F.col("root").alias("r2"), F.col("part").alias("p2"), F.col("id").alias("other"), *(F.col(c).alias(f"other_{c}") for c in carried))
    left = _each_part(x.select("id", "root", "parts", *carried), "parts", "part")
    return left.join(right, (F.col("root") == F.col("r2")) & (F.col("part") == F.col("p2"))).select("id", "other", *carried, *(f"other_{c}" for c in carried))


def expand(facts: DataFrame, label: DataFrame) -> DataFrame:
    """The facts with subjects and objects replaced by all their equals; predicates and classes stay.

    Facts that differ only by equals are one group, told by its roots. A group that holds all its combinations already is left out, any other is made once:
    so the result has no row twice and no more rows than the closure.
    """
    x = _sized(label)
    of = lambda c: x.select(F.col("id").alias(f"{c}i"), F.col("root").alias(f"{c}r"), F.col("n").alias(f"{c}n"), F.col("parts").alias(f"{c}parts"))
    g = facts.join(of("s"), F.col("s") == F.col("si"), "left").join(of("o"), (F.col("o") == F.col("oi")) & (F.col("p") != TYPE_ID), "left").where("si is not null or oi is not null")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    g = g.select(F.coalesce("sr", "s").alias("gs"), "p", F.coalesce("or", "o").alias("go"), "sr", "or", one("sn").alias("sn"), one("on").alias("on"), one("sparts").alias("sparts"), one("oparts").alias("oparts"))
    g = g.groupBy("gs", "p", "go").agg(F.count("*").alias("have"), *(F.max(c).alias(c) for c in ("sr", "or", "sn", "on", "sparts", "oparts"))).where(F.col("have") < F.col("sn") * F.col("on"))
    for c in "so":
        m = x.select(F.col("root").alias("mr"), F.col("part").alias("mp"), F.col("id").alias(f"{c}m"))
        g = _each_part(g, f"{c}parts", "at").join(m, (F.col(f"{c}r") == F.col("mr")) & (F.col("at") == F.col("mp")), "left").where(f"{c}r is null or {c}m is not null").drop("mr", "mp", "at")
    return g.select(F.coalesce("sm", "gs").alias("s"), "p", F.coalesce("om", "go").alias("o"))


def different(known: DataFrame, rules: Rules) -> DataFrame:
    """(a, b) of individuals known to differ: stated, derived, and values of disjoint properties of one subject."""
    out = known.where(F.col("p") == DIFFERENT_ID).select(F.col("s").alias("a"), F.col("o").alias("b"))
    if rules.pdisjoint:
        table = small(known.sparkSession, [(id_of(p), id_of(q)) for p, q in rules.pdisjoint], "rp long, rq long")
        ids = sorted({id_of(p) for x in rules.pdisjoint for p in x})
        left = among(known, "p", ids).join(table, F.col("p") == F.col("rp")).select("s", "rq", F.col("o").alias("a"))
        right = among(known, "p", ids).select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("b"))
        out = out.unionByName(left.join(right, (F.col("s") == F.col("s2")) & (F.col("rq") == F.col("p2"))).select("a", "b"))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

