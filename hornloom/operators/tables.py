"""Tables that cut lineage, and term ids.

An id is the 64-bit hash of the term's text with its lowest bit telling literals, so encoding is a projection with no join and no shuffle; collisions are
looked for when the dictionary is built (see `dictionary`).
"""

from __future__ import annotations

import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornloom.terms import is_literal

FACT = "s long, p long, o long"
#: A rule table is broadcast up to this many rows; larger ones leave the join to Spark.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"


def settle(df: DataFrame, what: str, work_dir: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{(work_dir or shared_dir(spark)).rstrip('/')}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_of(term: str) -> int:
    h = xxhash.xxh64_intdigest(term.encode(), seed=42)
    h = (h - (1 << 64) if h >> 63 else h) & ~1
    return h | is_literal(term)


def id_column(term: Column) -> Column:
    return F.xxhash64(term).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(term.startswith('"'), F.lit(1)).otherwise(F.lit(0)).cast("long"))


def is_literal_id(c: Column) -> Column:
    return c.bitwiseAND(F.lit(1)) == 1


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def among(df: DataFrame, column: str, ids: list[int]) -> DataFrame:
    """The rows whose column is one of the ids: a pushed filter, or a semi join for long lists."""
    if len(ids) <= 1000:
        return df.where(F.col(column).isin(ids)) if ids else df.limit(0)
    return df.join(small(df.sparkSession, [(i,) for i in ids], f"{column} long"), column, "left_semi")
