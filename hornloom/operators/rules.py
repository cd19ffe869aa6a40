"""The inference rules over facts (s, p, o) of ids; class membership is a fact with rdf:type.

Each function takes this round's new facts (`delta`) and all facts including them (`known`) and returns candidates, perhaps known ones.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornloom.operators.tables import among, id_of, small
from hornloom.plans.compile import Rules
from hornloom.terms import TYPE

TYPE_ID = id_of(TYPE)


class RuleTables:
    """The rule tables as DataFrames of ids, made once."""

    def __init__(self, spark: SparkSession, rules: Rules):
        self.rules, self.spark = rules, spark
        self.by_property = self.later = self._by_property(rules.by_property)
        self.property_ids = sorted({id_of(r[0]) for r in rules.by_property})
        self.by_class = small(spark, [(*map(id_of, r), rules.families[r]) for r in rules.by_class], "rc long, np long, no long, families array<string>")
        self.class_ids = sorted({id_of(r[0]) for r in rules.by_class})
        self.svf = small(spark, [tuple(map(id_of, r)) for r in rules.svf], "rp long, rd long, rc long")
        self.avf = small(spark, [tuple(map(id_of, r)) for r in rules.avf], "ra long, rp long, rb long")
        self.conj = small(spark, [(i, id_of(c)) for i, (parts, _) in enumerate(rules.conj) for c in parts], "rule int, rc long")
        self.conj_heads = small(spark, [(i, len(parts), id_of(c)) for i, (parts, c) in enumerate(rules.conj)], "rule int, n long, head long")
        by_length = defaultdict(list)
        for q, chain in rules.chains:
            by_length[len(chain)].append((id_of(q), *map(id_of, chain)))
        self.chains = {n: small(spark, rows, "q long, " + ", ".join(f"p{i} long" for i in range(n))) for n, rows in by_length.items()}
        self.chain_ids = {n: [sorted({r[1 + i] for r in rows}) for i in range(n)] for n, rows in by_length.items()}
        self.trans = sorted(map(id_of, rules.trans))
        #: Transitive properties whose facts no other rule derives; filled by the fixpoint where it starts from all facts.
        self.pure: list[int] = []
        self.universal = sorted(map(id_of, rules.universal))

    def _by_property(self, rows: list[tuple]) -> DataFrame:
        opt = lambda t: None if t is None else id_of(t)
        rows = [(id_of(p), opt(v), s == "s", id_of(q), {"": 0, "s": 1, "o": 2}[o], id_of(c) if c else 0, self.rules.families[p, v, s, q, o, c]) for p, v, s, q, o, c in rows]
        return small(self.spark, rows, "rp long, rv long, same_side boolean, np long, from_ int, const long, families array<string>")

    def leave_repeats(self) -> None:
        """After the first round, facts of a property that only subproperties give have given its superproperties theirs: the rows are closed. Only right without equality and SWRL."""
        rules = self.rules
        plain = lambda r: rules.families[r] == ["subproperty"]
        others = {r[3] for r in rules.by_property if not plain(r)} | {r[1] for r in rules.by_class} | {q for q, _ in rules.chains} | {*rules.trans}
        rows = [r for r in rules.by_property if not plain(r) or r[0] in others]
        if len(rows) < len(rules.by_property):
            self.later = self._by_property(rows)


def _property_matches(delta: DataFrame, t: RuleTables, first: bool = True) -> DataFrame:
    d = among(delta.where(F.col("p") != TYPE_ID), "p", t.property_ids)
    return d.join(t.by_property if first else t.later, F.col("p") == F.col("rp")).where(F.col("rv").isNull() | (F.col("rv") == F.col("o")))


def property_rules(delta: DataFrame, t: RuleTables, first: bool = True) -> DataFrame:
    """Subproperty, domain, range, inverse, symmetric, has-value and existence: one broadcast join."""
    return _property_matches(delta, t, first).select(F.when(F.col("same_side"), F.col("s")).otherwise(F.col("o")).alias("s"), F.col("np").alias("p"), F.when(F.col("from_") == 0, F.col("const")).when(F.col("from_") == 1, F.col("s")).otherwise(F.col("o")).alias("o"))


def _class_matches(delta: DataFrame, t: RuleTables) -> DataFrame:
    d = among(delta.where(F.col("p") == TYPE_ID), "o", t.class_ids)
    return d.join(t.by_class, d["o"] == F.col("rc"))


def class_rules(delta: DataFrame, t: RuleTables) -> DataFrame:
    """Subclass, has-value from a class, and intersection parts: one broadcast join."""
    return _class_matches(delta, t).select("s", F.col("np").alias("p"), F.col("no").alias("o"))


def universal_rule(delta: DataFrame, t: RuleTables) -> DataFrame:
    ends = F.when(F.col("p") == TYPE_ID, F.array("s")).otherwise(F.array("s", "o"))
    x = delta.select(F.explode(ends).alias("s")).distinct()
    return x.select("s", F.lit(TYPE_ID).alias("p"), F.explode(F.array(*map(F.lit, t.universal))).alias("o"))


def _types(df: DataFrame, s: str, c: str) -> DataFrame:
    return df.where(F.col("p") == TYPE_ID).select(F.col("s").alias(s), F.col("o").alias(c))


def _props(df: DataFrame, ids: list[int], s: str, p: str, o: str) -> DataFrame:
    return among(df.where(F.col("p") != TYPE_ID), "p", ids).select(F.col("s").alias(s), F.col("p").alias(p), F.col("o").alias(o))


def some_values_rule(delta: DataFrame, known: DataFrame, t: RuleTables) -> DataFrame:
    ids = sorted({id_of(p) for p, _, _ in t.rules.svf})
    by_type = _types(delta, "y", "d").join(t.svf, F.col("d") == F.col("rd")).join(_props(known, ids, "x", "kp", "ko"), (F.col("y") == F.col("ko")) & (F.col("rp") == F.col("kp"))).select("x", "rc")
    by_prop = _props(delta, ids, "x", "dp", "y").join(t.svf, F.col("dp") == F.col("rp")).join(_types(known, "ky", "kd"), (F.col("y") == F.col("ky")) & (F.col("rd") == F.col("kd"))).select("x", "rc")
    return by_type.unionByName(by_prop).select(F.col("x").alias("s"), F.lit(TYPE_ID).alias("p"), F.col("rc").alias("o"))


def all_values_rule(delta: DataFrame, known: DataFrame, t: RuleTables) -> DataFrame:
    ids = sorted({id_of(p) for _, p, _ in t.rules.avf})
    by_type = _types(delta, "x", "a").join(t.avf, F.col("a") == F.col("ra")).join(_props(known, ids, "kx", "kp", "y"), (F.col("x") == F.col("kx")) & (F.col("rp") == F.col("kp"))).select("y", "rb")
    by_prop = _props(delta, ids, "x", "dp", "y").join(t.avf, F.col("dp") == F.col("rp")).join(_types(known, "kx", "ka"), (F.col("x") == F.col("kx")) & (F.col("ra") == F.col("ka"))).select("y", "rb")
    return by_type.unionByName(by_prop).select(F.col("y").alias("s"), F.lit(TYPE_ID).alias("p"), F.col("rb").alias("o"))


def intersection_rule(delta: DataFrame, known: DataFrame, t: RuleTables) -> DataFrame:
    ids = sorted({id_of(c) for parts, _ in t.rules.conj for c in parts})
    fresh = among(_types(delta, "ds", "c"), "c", ids).join(t.conj, F.col("c") == F.col("rc")).select("ds", F.col("rule").alias("drule")).distinct()
    held = among(_types(known, "s", "c"), "c", ids).join(t.conj, F.col("c") == F.col("rc")).select("s", "rule", "c")
    counted = held.join(fresh, (F.col("s") == F.col("ds")) & (F.col("rule") == F.col("drule")), "left_semi").groupBy("s", "rule").agg(F.count_distinct("c").alias("have"))
    heads = t.conj_heads.withColumnRenamed("rule", "hrule")
    return counted.join(heads, (F.col("rule") == F.col("hrule")) & (F.col("have") == F.col("n"))).select("s", F.lit(TYPE_ID).alias("p"), F.col("head").alias("o"))


def transitive_rule(delta: DataFrame, known: DataFrame, t: RuleTables) -> DataFrame:
    """New facts joined with all facts, so path lengths double each round.

    Of a pure property, the new facts are the pairs at the last round's distances, L at most, and all nearer pairs are known. A pair at a distance up to
    2 L has a shortest path, and the beginning of length L of that path is new: so joining at its end finds every pair. Facts of other properties may be new at any
    distance, so they join on both sides.
    """
    d, k = _props(delta, t.trans, "ds", "dp", "do_"), _props(known, t.trans, "ks", "kp", "ko")
    ahead = d.join(k, (F.col("do_") == F.col("ks")) & (F.col("dp") == F.col("kp"))).select(F.col("ds").alias("s"), F.col("dp").alias("p"), F.col("ko").alias("o"))
    mixed = sorted(set(t.trans) - set(t.pure))
    if not mixed:
        return ahead
    d = _props(delta, mixed, "ds", "dp", "do_")
    back = d.join(k, (F.col("ds") == F.col("ko")) & (F.col("dp") == F.col("kp"))).select(F.col("ks").alias("s"), F.col("dp").alias("p"), F.col("do_").alias("o"))
    return ahead.unionByName(back)


def chain_rule(delta: DataFrame, known: DataFrame, t: RuleTables) -> DataFrame:
    """All chains of one length in one plan for each place of the new fact."""
    out = None
    for n, table in t.chains.items():
        ids = t.chain_ids[n]
        for i in range(n):
            w = _props(delta, ids[i], "left_", "dp", "right_").join(table, F.col("dp") == F.col(f"p{i}")).drop("dp")
            for j in range(i + 1, n):
                k = _props(known, ids[j], "ks", "kp", "ko")
                w = w.join(k, (F.col("right_") == F.col("ks")) & (F.col(f"p{j}") == F.col("kp"))).withColumn("right_", F.col("ko")).drop("ks", "kp", "ko")
            for j in range(i - 1, -1, -1):
                k = _props(known, ids[j], "ks", "kp", "ko")
                w = w.join(k, (F.col("left_") == F.col("ko")) & (F.col(f"p{j}") == F.col("kp"))).withColumn("left_", F.col("ks")).drop("ks", "kp", "ko")
            found = w.select(F.col("left_").alias("s"), F.col("q").alias("p"), F.col("right_").alias("o"))
            out = found if out is None else out.unionByName(found)
    return out


def firings(name: str, made: DataFrame, delta: DataFrame, t: RuleTables) -> list[tuple[str, int]]:
    """(family, candidates) of what candidates() made under this name; the two folded tables are told apart by their rows' families."""
    if name not in ("property", "class"):
        return [(name, made.count())]
    matches = _property_matches(delta, t) if name == "property" else _class_matches(delta, t)
    return [(r["family"], r["count"]) for r in matches.select(F.explode("families").alias("family")).groupBy("family").count().collect()]


def candidates(delta: DataFrame, known: DataFrame, t: RuleTables, first: bool = True) -> list[tuple[str, DataFrame]]:
    """(family, candidates) of every family that has rules; others are not even planned. first: delta may hold asserted facts."""
    r, out = t.rules, []
    if r.by_property:
        out.append(("property", property_rules(delta, t, first)))
    if r.by_class:
        out.append(("class", class_rules(delta, t)))
    if r.universal:
        out.append(("universal", universal_rule(delta, t)))
    for name, rows, rule in (("some-values-from", r.svf, some_values_rule), ("all-values-from", r.avf, all_values_rule), ("intersection", r.conj, intersection_rule), ("transitive", t.trans, transitive_rule), ("property-chain", r.chains, chain_rule)):
        if rows:
            out.append((name, rule(delta, known, t)))
    return out
