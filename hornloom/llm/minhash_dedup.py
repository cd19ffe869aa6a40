"""Near-duplicate groups: bottom-k sketches from one hash function, inverted lists, union-sketch estimate, exact Jaccard.

1. Each text gives its set of distinct w-word shingles, hashed to 63 bits; the SKETCH smallest hashes are its sketch (small sets are whole in it).
   Texts with equal sets form a class at once (fingerprint of the whole set), and only one member of a class goes on, so groups of exact
   copies cost nothing more.
2. Inverted lists of the retained values. Linked texts share at least `least` retained values: for sets up to about twice SKETCH that follows
   from the threshold and the size; beyond, a link over the threshold has a chance under MISS to share fewer. So each class is listed only under its
   (retained - least + 1) rarest values by global counts, and two linked classes meet in a list at least once. That keeps passages that many texts
   share out of the lists.
3. Overlaps are found over the lists in two passes. First every member of a list meets the list's hubs alone (linear): classes whose retained
   values are the most common ones, as those of the text are from which copies were made. Confirmed links give labels. Then only members whose label differs from that of their list's hub meet the members of other labels. Members of one label are connected already, so leaving out pairs among them loses no component; a group of
   near copies is never expanded into all its pairs. A bitmap of the MAPPED smallest hashes bounds from above what two members can share, inside the
   join, and a pair is made once, in the list of the rarest value that both are listed under. Long lists are salted over tasks.
4. A pair passes the estimate from the union sketch (of the SKETCH smallest values of both, enough must be in both) before its texts are fetched and
   their full sets compared. Two sets that are whole in their sketches are compared exactly there.
5. Components come from alternating large and small stars, all in distributed tables.

Tables that only the next step reads are deleted once that is written.

Defined cases: a null, empty or blank text has no shingles, n_shingles 0, and is linked with nothing. A text with fewer than w words is one shingle: the
whole sequence. Null ids are left out of links but keep their row. Repeated rows are copies of each other. Rows with an equal id and different
texts are judged each by its own text. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornloom.llm._shared import WORD_SPACE, Scratch, slices

#: Production parameters: size of a sketch, chance that a link over the threshold is not proposed, smallest hashes in a bitmap and its longs, pair tests of
#: one task's list part.
SKETCH, MISS, MAPPED, LONGS, SALT_PAIRS = 64, 1e-9, 512, 16, 4_000_000
#: Hubs of a list where several classes are as common.
HUBS = 4
#: A set of ids is broadcast up to this many (at most 60 bytes each); a set that so many pairs need is salted over tasks.
BROADCAST_IDS, HOT_PAIRS = 300_000, 4096

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 63-bit hashes of the text's shingles; words are hashed by a polynomial over their bytes."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    if not len(data):
        return np.empty(0, np.int64)
    word = np.diff(np.concatenate([[False], ~_SPACE[data], [False]]).astype(np.int8))
    start, end = np.flatnonzero(word == 1), np.flatnonzero(word == -1)
    if not len(start):
        return np.empty(0, np.int64)
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, n)[:n], dtype=np.uint64)])
    h = _mix((total[end] - total[start]) * _powers(_BACK, n)[start] + (end - start).astype(np.uint64))
    w = min(width, len(h))
    out = np.full(len(h) - w + 1, np.uint64(w if len(h) < width else width))
    for i in range(w):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - w + 1 + i])
    return np.unique(out >> np.uint64(1)).view(np.int64)


def _bitmap(x: np.ndarray) -> np.ndarray:
    """LONGS longs with a bit set for each value."""
    out = np.zeros(LONGS * 64, np.uint8)
    out[_mix(x.view(np.uint64)) % np.uint64(LONGS * 64)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _sketches(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_hashes(t, width) for t in b.column("_text").to_pylist()]
            whole = [x.view(np.uint64) for x in sets]
            # Two independent sums over the whole set.
            fp1 = np.array([_mix(u + np.uint64(1)).sum(dtype=np.uint64) for u in whole], np.uint64).view(np.int64)
            fp2 = np.array([_mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for u in whole], np.uint64).view(np.int64)
            kept = [x[:SKETCH] for x in sets]
            more = {"n": pa.array([len(x) for x in sets], pa.int64()), "fp1": pa.array(fp1), "fp2": pa.array(fp2), "sketch": _lists(kept), "bits": _lists([_bitmap(x[:MAPPED]) for x in sets])}
            names = [c for c in b.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more.values()], [*names, *more])

    return run


def _equal_enough(width: int, num: int, den: int):
    """Of rows (a, b, ta, tb) the (a, b) whose texts' sets have a Jaccard share of at least num / den."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in slices(batches):
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                # Rows come sorted by a.
                if a != last:
                    last, x = a, shingle_hashes(ta, width)
                y = shingle_hashes(tb, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def needed(k: int, share: float, miss: float = MISS) -> int:
    """The most shared values that a pair with this Jaccard share falls short of with a chance of at most `miss`."""
    below, m = 0.0, 0
    while (below := below + comb(k, m) * share**m * (1 - share) ** (k - m)) <= miss:
        m += 1
    return m


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """id, component of every end of links (a, b): the smallest id that can be reached."""
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    # Every round links each node and its larger neighbours to its smallest neighbour, until each node hangs on its root alone.
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: the larger neighbours of a node go to the node's minimum.
        star = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to their minimum.
        low = star.groupBy("b").agg(F.min("a").alias("m"))
        small = star.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        old = scratch.paths.pop("edges")
        edges = scratch.settle(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        scratch.paths["old edges"] = old
        scratch.drop("old edges")
        # Done when every edge starts at a root: no node is both a child and a parent, and no child has two parents.
        state = edges.groupBy("b").agg(F.count("*").alias("n")).join(edges.select(F.col("a").alias("b")).distinct().withColumn("parent", F.lit(1)), "b", "left")
        if state.where("n > 1 or parent = 1").limit(1).count() == 0:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


class _Join:
    """The links among the classes of one run."""

    def __init__(self, source: DataFrame, by: list[str], width: int, num: int, den: int, spread: int) -> None:
        self.by, self.width, self.num, self.den, self.spread = by, width, num, den, spread
        self.scratch = Scratch(source.sparkSession)
        # Key and text hash find a class's text again, also where rows with an equal key have different texts.
        self.source = source.withColumn("_t", F.xxhash64("_text"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.source.schema if f.name != "_text")
        hashed = self.source.mapInArrow(_sketches(width), f"{kinds}, n long, fp1 long, fp2 long, sketch array<long>, bits array<long>")
        self.rows = self.scratch.settle(hashed, "sketches")
        of_class = self.rows.where((F.col("n") > 0) & F.col(by[0]).isNotNull()).groupBy("n", "fp1", "fp2")
        classes = of_class.agg(F.min(F.struct(*by, "_t")).alias("rep"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
        # Written once, so every later read sees the same numbers.
        self.classes = self.scratch.settle(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def fits(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num

    def lists(self) -> DataFrame:
        """v, id, n, common (how common all its retained values are): the inverted lists of each class's rarest retained values."""
        need = needed(SKETCH, self.num / self.den)
        values = self.classes.select("id", F.explode("sketch").alias("v"))
        shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
        rarest = values.join(shared, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("common"))  # SKETCH at most
        share = F.ceil(F.col("n") * self.num / self.den)
        # A union of fewer than SKETCH values is whole in both sketches, and `share` of them are shared. Of a larger one, at most as many as
        # `unshared` of the SKETCH smallest are in one set only: the union has at most n * den / num values.
        unshared = F.floor(F.col("n") * (self.den - self.num) / self.num)
        least = F.greatest(F.least(F.lit(need), share), F.least(SKETCH - unshared, share))
        # Values of one class only come first in the order of rarity: they use up places without a list.
        places = (F.size("vs") - least + 1).cast("int")
        listed = rarest.join(self.classes.select("id", "n"), "id").withColumn("places", places).where("places > 0")
        prefix = F.transform(F.slice("vs", F.lit(1), F.col("places")), lambda x: x.v)
        self.prefixes = self.scratch.settle(listed.select("id", "n", "common", prefix.alias("prefix")), "prefixes")
        return self.prefixes.select("id", "n", "common", F.explode("prefix").alias("v"))

    def confirmed(self, pairs: DataFrame, what: str) -> DataFrame:
        """The pairs (a, b) that are links."""
        need = needed(SKETCH, self.num / self.den)
        side = lambda c: self.classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        common = F.size(F.array_intersect("sa", "sb"))
        whole = F.greatest("na", "nb") <= SKETCH
        exact = self.den * common >= self.num * (F.col("na") + F.col("nb") - common)
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
        likely = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) >= need
        judged = pairs.join(side("b"), "b").join(side("a"), "a").where(F.when(whole, exact).otherwise(likely)).select("a", "b", whole.alias("sure"))
        judged = self.scratch.settle(judged, f"{what}-judged")
        open_ = judged.where("not sure").select("a", "b")
        many = open_.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > HOT_PAIRS).select("a", F.ceil(F.col("m") / HOT_PAIRS).cast("int").alias("salts"))
        salted = open_.join(many, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        left = self.texts(open_, "a").join(many, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        both = salted.join(self.texts(open_, "b"), "b").join(left, ["a", "salt"]).sortWithinPartitions("a").select("a", "b", "ta", "tb")
        links = both.mapInArrow(_equal_enough(self.width, self.num, self.den), "a long, b long")
        links = self.scratch.settle(judged.where("sure").select("a", "b").unionByName(links), f"{what}-links")
        self.scratch.drop(f"{what}-judged")
        return links

    def texts(self, pairs: DataFrame, end: str) -> DataFrame:
        """end, t<end>: the texts of the classes at this end of the pairs, whole."""
        ends = pairs.select(F.col(end).alias("id")).distinct().join(self.classes.select("id", "rep"), "id").select("id", "rep.*")
        if ends.count() <= BROADCAST_IDS:  # beyond that many, Spark shuffles both sides
            ends = F.broadcast(ends)
        found = self.source.join(ends, [*self.by, "_t"]).select(F.col("id").alias(end), F.col("_text").alias(f"t{end}"))
        return found.dropDuplicates([end])

    def links(self) -> DataFrame:
        """id, component of all classes that are linked."""
        lists = self.lists()
        # Near the text from which copies were made, many are as common; several of them, chosen by hash, reach more members.
        best = [F.max(F.struct("common", F.xxhash64("id", F.lit(i)).alias("tie"), "id", "n")) for i in range(HUBS)]
        hubs = lists.groupBy("v").agg(F.array(*best).alias("best"), F.count("*").alias("size")).where("size > 1")
        hubs = hubs.select("v", F.explode(F.array_distinct(F.transform("best", lambda x: F.struct(x.id.alias("a"), x.n.alias("an"))))).alias("hub")).select("v", "hub.*")
        met = lists.join(hubs, "v").where((F.col("id") != F.col("a")) & self.fits(F.col("n"), F.col("an"))).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        near = self.scratch.settle(met, "near")
        links = self.confirmed(near, "near")
        label = self.scratch.settle(components(links, self.scratch), "label")
        self.scratch.drop("edges")
        rest = self.scratch.settle(self.apart(lists, label, near), "rest")
        self.scratch.drop("prefixes", "open-lists")
        more = self.confirmed(rest, "rest")
        if not more.isEmpty():
            label = components(links.unionByName(more), self.scratch)
        self.scratch.drop("rest", "near")
        return label

    def apart(self, lists: DataFrame, label: DataFrame, done: DataFrame) -> DataFrame:
        """The pairs (a, b) of different labels that meet in a list, share enough by their bitmaps and were not compared."""
        named = lists.join(label, "id", "left").select("id", "n", "v", "common", F.coalesce("component", "id").alias("label"))
        of_list = named.groupBy("v").agg(F.max(F.struct("common", "id", "label")).alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
        named = named.join(of_list.where("lo < hi").select("v", F.col("f.label").alias("head"), "size"), "v")
        others = named.where("label <> head").groupBy("v").agg(F.count("*").alias("others"))
        named = named.join(others, "v").withColumn("salts", F.ceil(F.col("others") * F.col("size") / self.spread).cast("int"))
        # Only members of open lists carry their bitmaps and all values that they are listed under, rarest first. Separate columns without
        # nulls keep the pair test short enough for the JVM to compile. `spare`: bits less values.
        words = [f"w{i}" for i in range(LONGS)]
        bits = self.classes.select("id", *(F.get("bits", F.lit(i)).alias(w) for i, w in enumerate(words)), (F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x)) - F.least("n", F.lit(MAPPED))).alias("spare"))
        named = self.scratch.settle(named.join(bits, "id").join(self.prefixes.select("id", "prefix"), "id"), "open-lists")
        side = lambda df, c, *more: df.select("v", "salt", *more, *(F.col(x).alias(c + x) for x in ("id", "n", "label", "spare", "prefix")), *(F.coalesce(w, F.lit(0)).alias(c + w) for w in words))
        left = side(named.where("label <> head").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")), "a_")
        right = side(named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("main", F.col("label") == F.col("head")), "b_", "main")
        a, b = F.col("a_n"), F.col("b_n")
        # A share t of the union is t / (1 + t) of both sizes together.
        least = F.when(F.greatest(a, b) <= MAPPED, F.ceil((a + b) * self.num / (self.num + self.den))).otherwise(needed(MAPPED, self.num / self.den))
        # Bits of one that the other lacks are values that they don't share: at most the values beyond `least`.
        both = sum((F.bit_count(F.col(f"a_{w}").bitwiseAND(F.col(f"b_{w}"))) for w in words[1:]), F.bit_count(F.col("a_w0").bitwiseAND(F.col("b_w0"))))
        bound = both >= least + F.greatest("a_spare", "b_spare")
        # Pairs of two that are not of the hub's label are taken once.
        once = (F.col("a_label") != F.col("b_label")) & (F.col("main") | (F.col("a_id") < F.col("b_id")))
        # Values stand in one order everywhere.
        first = F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)) == F.col("v")
        pairs = left.join(right, ["v", "salt"]).where(once & self.fits(a, b) & bound & first).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
        return pairs.join(done, ["a", "b"], "left_anti")

    def result(self) -> DataFrame:
        """by, n and `least`, the smallest key of the row's component (null without words or key), for each row."""
        label = self.links()
        linked = self.classes.select("id", "n", "fp1", "fp2", F.struct(*(F.col(f"rep.{c}") for c in self.by)).alias("key")).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = linked.groupBy("component").agg(F.min("key").alias("least"))
        of_class = linked.join(least, "component").select("n", "fp1", "fp2", "least")
        keyed = F.when(F.col(self.by[0]).isNotNull(), F.col("least")).alias("least")
        return self.rows.join(of_class, ["n", "fp1", "fp2"], "left").select(*self.by, "n", keyed)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", spread: int = SALT_PAIRS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; links have a Jaccard share of at least num / den."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    found = _Join(source, ["doc_id"], width, num, den, spread).result()
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100, spread: int = SALT_PAIRS) -> DataFrame:
    """docs with one row of each near-duplicate group, with all columns: that with the smallest id, null ids last.

    Each row counts as a document of its own, whatever its id. Rows without words stay all.
    """
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_SPACE)) == ""
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(":"), F.col(text))
    filled = docs.where(~bare).withColumn("_dedup_row", F.md5(name))
    by = [F.col(key).isNull().alias("_null"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_id"), F.col("_dedup_row").alias("_row")]
    found = _Join(filled.select(*by, F.col(text).alias("_text")), ["_null", "_id", "_row"], width, num, den, spread).result()
    first = found.where(F.col("_row") == F.col("least._row")).select(F.col("_row").alias("_dedup_row")).distinct()
    return filled.dropDuplicates(["_dedup_row"]).join(first, "_dedup_row", "left_semi").select(docs.columns).unionByName(docs.where(bare))
