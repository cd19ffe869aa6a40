"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard stands on the ring at `virtual_nodes` points. A row's key is the hash of its text, so equal texts start at the
same point and stay together as long as their shard has room. Keys go to the first shard clockwise; a full shard passes its surplus on
clockwise. The bounds are whole row counts that differ by at most one and add up to the number of rows, so every shard ends
exactly full (law `rows`), and a group of copies of any size is spread along the ring instead of overloading a shard.

The ring is read at CELLS equal cells. One aggregation counts the rows of each cell; the walk around the ring then needs only
these CELLS counts, and gives for each cell the pieces (first rank, end rank, shard, first slot) into which its rows fall: at most CELLS + the number of
times that a shard fills. Rows are ranked within their cell by salted buckets, so a cell with a third of all rows is ranked by many tasks.
Everything on the executors is DataFrame expressions.

Defined cases: a null text counts as empty (size 8, crc 0). Null ids and repeated rows are placed like others; rows with equal text and id
take neighbouring slots in any order. With fewer rows than shards, later shards stay empty. Extra columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Production parameters.
SHARDS, VIRTUAL_NODES, CELLS, BUCKETS = 24, 128, 1 << 14, 1024


def ring(shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in clockwise order."""
    at = lambda s, v: int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def walk(counts: dict[int, int], shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, lo, hi, shard, slot): the rows of the cell with ranks in [lo, hi) go to the shard, from that slot on."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    nodes = ring(shards, virtual_nodes, cells)
    places = [c for c, _ in nodes]
    pieces = []
    for cell in sorted(counts):
        lo, at = 0, bisect_left(places, cell)
        while lo < counts[cell]:
            shard = nodes[at % len(nodes)][1]
            n = min(counts[cell] - lo, room[shard] - used[shard])
            if n:
                pieces.append((cell, lo, lo + n, shard, used[shard]))
                lo, used[shard] = lo + n, used[shard] + n
            at += 1
    return pieces


def _values(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from a constant, without a Python RDD."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def keys(docs: DataFrame, cells: int, buckets: int, key: str, text: str) -> DataFrame:
    t: Column = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("_point"))
    # The cell is the top of the hash; the bucket within a cell mixes in the id, so that copies spread over buckets.
    rows = rows.withColumn("_cell", F.shiftrightunsigned(F.col("_point"), 64 - (cells.bit_length() - 1)))
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("_point", key), F.lit(buckets)))


def place(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row."""
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    # The counts of the cells come first: CELLS rows at most reach the driver.
    light = docs.select(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - (cells.bit_length() - 1)).alias("cell"))
    counts = {r["cell"]: r["n"] for r in light.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    pieces = _values(docs, walk(counts, shards, virtual_nodes, cells), "_cell long, _lo long, _hi long, shard int, _slot long")
    rows = keys(docs, cells, buckets, key, text)
    sizes = rows.groupBy("_cell", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_cell").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_cell", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_cell", "_bucket").orderBy("_point", key)) - 1)
    ranked = ranked.join(offsets, ["_cell", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    p = F.broadcast(pieces)  # at most CELLS plus the fillings of shards
    placed = ranked.join(p, (ranked["_cell"] == p["_cell"]) & (ranked["_rank"] >= p["_lo"]) & (ranked["_rank"] < p["_hi"]))
    return placed.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
