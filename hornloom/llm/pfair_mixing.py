"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. With share w (its weight over the sum of all), its j-th block (from 1) is released at slot
floor((j - 1) / w) and due at slot ceil(j / w); each slot goes to the released block with the earliest deadline. So after
any number of slots, while no source has run out, each source is less than one block away from its share.

Weights are whole numbers, so the schedule repeats every `sum(weights)` slots and one period decides all: the period is computed
once from the few sources (a table of at most MAX_PERIOD rows), and each block finds its slot by arithmetic. Rows are numbered within
their source by salted buckets (counts first, then a rank inside each bucket), so no task sorts a whole source.

Once a source has run out, its slots stay empty; the others keep theirs, so no row is lost. `in_mix` marks the slots before the
first empty one: there the promise above holds.

Defined cases: a null source is a source of its own, named by NULL_SOURCE. Null ids are numbered like others. A source without a
given weight has weight 1. Repeated rows are separate rows; rows that are equal in every ordering column take their numbers in any order. An empty table
gives no rows; all other columns pass through, and helper columns have names with a leading `_mix_`.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from heapq import heappop, heappush
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NULL_SOURCE = "\x00null"
MAX_PERIOD = 1_000_000

#: Production parameters: rows of a block, ranking buckets of a source, and target weights (others: 1).
BLOCK_ROWS = 16
BUCKETS = 4096
WEIGHTS: Mapping[str, int] = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2}


def period(weights: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, number of its block within the period) for each slot of one period."""
    total = sum(weights.values())
    if total > MAX_PERIOD or any(w < 1 for w in weights.values()):
        raise ValueError("weights must be positive whole numbers whose sum, without common factors, is at most MAX_PERIOD")
    release = lambda s, j: (j - 1) * total // weights[s]
    due = lambda s, j: -(-j * total // weights[s])
    waiting = [(0, s, 1) for s in sorted(weights)]
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int]] = []
    waiting.sort()
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heappop(waiting)
            heappush(ready, (due(s, j), s, j))
        deadline, s, j = heappop(ready)
        assert deadline > slot
        out.append((s, j - 1))
        if j < weights[s]:
            heappush(waiting, (release(s, j + 1), s, j + 1))
    return out


def _ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds _mix_rank (long, gapless from 0 within _mix_source) to rows that have _mix_source, _mix_bucket and _mix_order."""
    sizes = rows.groupBy("_mix_source", "_mix_bucket").agg(F.count("*").alias("_mix_n"))
    before = F.sum("_mix_n").over(Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_mix_source", "_mix_bucket", F.coalesce(before, F.lit(0)).alias("_mix_before"))
    within = F.row_number().over(Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_order"))
    ranked = rows.withColumn("_mix_in", within)
    return ranked.join(offsets, ["_mix_source", "_mix_bucket"]).withColumn("_mix_rank", F.col("_mix_before") + F.col("_mix_in") - 1).drop("_mix_before", "_mix_in")


def _schedule(counts: Mapping[str, int], weights: Mapping[str, int], block_rows: int) -> tuple[int, dict[str, list[int]], int]:
    """Slots of a period, slots of each source within it, and the first slot that finds its source empty; of rows by source."""
    shares = {s: int(weights.get(s, 1)) for s in counts}
    # A common factor only repeats the same period.
    common = gcd(*shares.values())
    shares = {s: w // max(1, common) for s, w in shares.items()}
    slots = period(shares)
    total = len(slots)
    places: dict[str, list[int]] = {s: [0] * w for s, w in shares.items()}
    for slot, (s, j) in enumerate(slots):
        places[s][j] = slot
    # The first slot that finds its source empty ends the mix.
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    end = min((blocks[s] // shares[s] * total + places[s][blocks[s] % shares[s]] for s in counts), default=0)
    return total, places, end


def _counts(rows: DataFrame) -> dict[str, int]:
    """Rows by _mix_source. One row for each source comes to the driver; period() refuses more sources than a period may have slots."""
    return {r["_mix_source"]: r["n"] for r in rows.groupBy("_mix_source").agg(F.count("*").alias("n")).collect()}


def _placed(docs: DataFrame, weights: Mapping[str, int], block_rows: int, source: str, key: str, buckets: int, columns: list[str]) -> DataFrame:
    """The columns with _mix_source_rank, _mix_block, _mix_slot, _mix_position and _mix_in_mix."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(*columns, F.coalesce(F.col(source), F.lit(NULL_SOURCE)).alias("_mix_source"), digest.alias("_mix_order"))
    rows = rows.withColumn("_mix_bucket", F.pmod(F.conv(F.substring("_mix_order", 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    total, places, end = _schedule(_counts(rows), weights, block_rows)
    spark = docs.sparkSession
    table = spark.createDataFrame([(s, len(at), at) for s, at in places.items()], "_mix_source string, _mix_weight int, _mix_places array<int>")
    out = _ranked(rows, buckets).join(F.broadcast(table), "_mix_source")  # at most MAX_PERIOD numbers
    block = F.floor(F.col("_mix_rank") / block_rows)
    slot = F.floor(block / F.col("_mix_weight")) * total + F.get("_mix_places", F.pmod(block, F.col("_mix_weight")).cast("int"))
    return out.select(
        *columns, F.col("_mix_rank").alias("_mix_source_rank"), block.alias("_mix_block"), slot.alias("_mix_slot"),
        (slot * block_rows + F.pmod(F.col("_mix_rank"), F.lit(block_rows))).alias("_mix_position"), (slot < end).alias("_mix_in_mix"),
    )


OUTPUT = ("source_rank", "block", "slot", "position", "in_mix")


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, source: str = "source", key: str = "doc_id", buckets: int = BUCKETS, columns: list[str] | None = None) -> DataFrame:
    """docs (or the given columns of it) with source_rank, block, slot, position and in_mix; columns of docs with these names are left out.

    position = slot * block_rows + place in the block: the row's place in the mixed order; in_mix as above.
    """
    columns = [c for c in columns or docs.columns if c not in OUTPUT]
    placed = _placed(docs, weights, block_rows, source, key, buckets, columns)
    return placed.select(*columns, *(F.col(f"_mix_{c}").alias(c) for c in OUTPUT))


def in_order(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, source: str = "source", key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """docs with all their columns, sorted by their place in the mixed order over all partitions."""
    return _placed(docs, weights, block_rows, source, key, buckets, docs.columns).orderBy("_mix_position").select(docs.columns)


def read_in_order(mixed: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, source: str = "source", columns: list[str] | None = None) -> DataFrame:
    """Of the Parquet files that in_order's rows were written to, read again: all (or the given) columns, position and in_mix.

    position: the row's number in the order of the files (by part, from 0 without gaps), whatever order Spark reads them in. `mixed` must be a
    scan of the files. in_mix as above, for the weights that the files were written with.
    """
    columns = [c for c in columns or mixed.columns if c not in ("position", "in_mix")]
    at = mixed.metadataColumn("_metadata")
    counts = _counts(mixed.select(F.coalesce(F.col(source), F.lit(NULL_SOURCE)).alias("_mix_source")))
    total, places, end = _schedule(counts, weights, block_rows)
    blocks = {s: end // total * len(x) + sum(slot < end % total for slot in x) for s, x in places.items()}
    head = sum(min(n, blocks[s] * block_rows) for s, n in counts.items())
    # The driver's listing of the files has a row for each as well.
    files = mixed.select(at["file_name"].alias("_mix_file")).groupBy("_mix_file").agg(F.count("*").alias("n")).collect()
    before, offsets = 0, []
    for _, name, n in sorted((_part(r["_mix_file"]), r["_mix_file"], r["n"]) for r in files):
        offsets.append((name, before))
        before += n
    table = mixed.sparkSession.createDataFrame(offsets, "_mix_file string, _mix_before long")
    rows = mixed.select(*columns, at["file_name"].alias("_mix_file"), at["row_index"].alias("_mix_row")).join(F.broadcast(table), "_mix_file")
    position = F.col("_mix_before") + F.col("_mix_row")
    return rows.select(*columns, position.alias("position"), (position < head).alias("in_mix"))


def _part(name: str) -> tuple[int, int]:
    """The numbers of the partition, and of its file, in the name of a file that Spark wrote."""
    found = re.match(r"part-(\d+)-.*?(?:-c(\d+))?(?:\.|$)", name)
    if not found:
        raise ValueError(f"{name}: not a part file of Spark, so its place in the order is unknown")
    return int(found[1]), int(found[2] or 0)


def sql(block_rows: int = BLOCK_ROWS, weights: Mapping[str, int] = WEIGHTS, buckets: int = BUCKETS) -> str:
    """The same over `documents` as DuckDB SQL; a recursive query plays the slots of one period one by one."""
    case = " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items())
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '_null') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
    r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY CAST('0x' || substr(m, 1, 8) AS BIGINT) % {buckets}, m) - 1 AS source_rank FROM d),
    w AS (SELECT s, count(*) AS n, CAST(CASE s {case} ELSE 1 END AS BIGINT) AS w FROM d GROUP BY s),
    t AS (SELECT CAST(sum(w) AS BIGINT) AS total FROM w),
    j AS (SELECT s, w, unnest(range(1, w + 1)) AS j FROM w),
    k AS (SELECT s, j, ((j - 1) * total) // w AS released, (j * total + w - 1) // w AS due, row_number() OVER (ORDER BY (j * total + w - 1) // w, s, j) AS prio FROM j, t),
    play(slot, prio, done) AS (
      SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[])
      UNION ALL
      SELECT p.slot + 1, (SELECT min(k.prio) FROM k WHERE k.released <= p.slot + 1 AND NOT list_contains(p.done, k.prio)),
             list_append(p.done, (SELECT min(k.prio) FROM k WHERE k.released <= p.slot + 1 AND NOT list_contains(p.done, k.prio)))
      FROM play p, t WHERE p.slot + 1 < t.total),
    place AS (SELECT k.s, k.j - 1 AS j, play.slot AS spot FROM play JOIN k USING (prio) WHERE play.slot >= 0),
    b AS (SELECT r.*, source_rank // {block_rows} AS block, w.w FROM r JOIN w USING (s)),
    x AS (SELECT b.*, (block // w) * total + spot AS slot FROM b JOIN place ON b.s = place.s AND block % w = place.j, t),
    e AS (SELECT min((((n + {block_rows} - 1) // {block_rows}) // w) * total + spot) AS stop FROM w JOIN place ON w.s = place.s AND ((n + {block_rows} - 1) // {block_rows}) % w = place.j, t)
    SELECT doc_id, source, source_rank, block, slot, slot * {block_rows} + source_rank % {block_rows} AS position, slot < stop AS in_mix FROM x, e"""
