"""Exact top-k inner-product search: tiled matrix products, partial selection per tile, tree merge of the lists.

Vectors are packed into blocks where they are read, with no shuffle. A tile is one query block times one candidate block; it
keeps only k entries for each query. The tiles of a query block meet by an equi-join on its number, so nothing is
broadcast and no task holds more than a tile; lists are merged FAN_IN tiles at a time until one list is left for a query.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a null id. Only vectors
of equal length are compared. A query is never its own candidate, by id. Equal (query, candidate, score) entries, as from
repeated rows, count once. Ties go to the smaller candidate id. Scores are exact: the product runs in float64 only where
all partial sums stay below 2**53, else in int64; components whose products could pass 2**63 raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, FAN_IN = 1024, 4096, 64
_PACKED = "dim int, block long, kind string, ids binary, vectors binary"


def quantised(df: DataFrame, vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as an array of longs, null for a vector that takes no part."""
    x = F.col(vector)
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(ok, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def _blocks(rows: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        # Block numbers: the partition in the high bits, a counter in the low ones.
        number, held = TaskContext.get().partitionId() << 32, {}

        def out(dim: int, ids: list, vectors: list) -> pd.DataFrame:
            nonlocal number
            number += 1
            m = np.asarray(vectors, np.int64).reshape(len(ids), dim)
            kind = np.int16 if np.abs(m).max(initial=0) < 2**15 else np.int64
            return pd.DataFrame({"dim": [dim], "block": [number], "kind": [np.dtype(kind).name], "ids": [np.asarray(ids, np.int64).tobytes()], "vectors": [m.astype(kind).tobytes()]})

        for frame in frames:
            for i, v in zip(frame["id"], frame["v"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield out(len(v), *held.pop(len(v)))
        for dim, (ids, vectors) in held.items():
            yield out(dim, ids, vectors)

    return pack


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top >= 2**63:
        raise ValueError("the components are too large for exact 64-bit scores")
    return q @ c.T


def _tiles(k: int):
    def tile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                qi, ci = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, c = (np.frombuffer(b, kind).astype(np.int64).reshape(n, r.dim) for b, kind, n in ((r.q_vectors, r.q_kind, len(qi)), (r.vectors, r.kind, len(ci))))
                both = np.unique(np.column_stack([ci, c]), axis=0)  # ascending ids: a stable sort then prefers the smaller
                ci, c = both[:, 0], both[:, 1:]
                s = _product(q, c)
                own = qi[:, None] == ci[None, :]
                s = np.where(own, np.iinfo(np.int64).min, s)
                m = min(k, s.shape[1])
                # The k-th best score bounds the selection; all its ties stay until the final order.
                kth = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m, None]
                row, col = np.nonzero((s >= kth) & ~own)
                if len(row):
                    at = np.lexsort((ci[col], -s[row, col], row))
                    row, col = row[at], col[at]
                    starts = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
                    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
                    row, col = row[place < k], col[place < k]
                    yield pd.DataFrame({"query_id": qi[row], "vec_id": ci[col], "score": s[row, col], "tile": r.tile})

    return tile


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, its k best other rows."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vectors, vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    queries = v.where("q").select("id", "v").mapInPandas(_blocks(QUERY_BLOCK), _PACKED)
    shards = v.select("id", "v").mapInPandas(_blocks(CANDIDATE_BLOCK), _PACKED)
    queries = queries.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("kind").alias("q_kind"))
    # As many columns as candidate blocks, so a column holds about one; every query block visits every column once.
    columns = max(1, -(-vectors.count() // CANDIDATE_BLOCK))
    queries = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<long>")))
    shards = shards.withColumn("tile", F.pmod(F.xxhash64("block"), F.lit(columns)))
    tiles = queries.join(shards, ["dim", "tile"])
    lists = tiles.mapInPandas(_tiles(k), "query_id long, vec_id long, score long, tile long")
    lists = lists.select("query_id", "tile", (-F.col("score")).alias("s"), F.col("vec_id").alias("c"))
    best = lambda: F.slice(F.sort_array(F.collect_set(F.struct("s", "c"))), 1, k).alias("best")
    nodes = columns
    while nodes > FAN_IN:
        lists = lists.groupBy("query_id", F.floor(F.col("tile") / FAN_IN).alias("tile")).agg(best()).select("query_id", "tile", F.inline("best"))
        nodes = -(-nodes // FAN_IN)
    root = lists.groupBy("query_id").agg(best())
    return root.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.c").alias("vec_id"), (-F.col("b.s")).alias("score"))
