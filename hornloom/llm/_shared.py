"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every operator (space, 0x09 to 0x0D).
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a default where it is unset (tests, one machine)."""
    return spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables of one run, written as Parquet in the shared folder.

    settle() cuts the lineage, and the files outlive a lost executor; readers push filters and columns down to them. The shuffle files of the
    write go at once (they can't be read again), Python workers get few rows at a time, and drop() removes a table when all that follows from it is written.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
        self.paths: dict[str, str] = {}

    def settle(self, df: DataFrame, what: str) -> DataFrame:
        self.paths[what] = path = f"{self.folder}/{what}-{uuid.uuid4().hex}"
        conf, during = self.spark.conf, {CLEANUP: "true", BATCH: "1000"}
        before = {name: conf.get(name) for name in during}
        if 0 < int(before[BATCH]) < int(during[BATCH]):
            during[BATCH] = before[BATCH]
        for name, value in during.items():
            conf.set(name, value)
        try:
            df.write.parquet(path)
        finally:
            for name, value in before.items():
                conf.set(name, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes df in the shared folder and returns a scan of it (see Scratch)."""
    return Scratch(df.sparkSession).settle(df, what)


def light_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Python workers of this session take at most so many rows at once. For whole applications (queries, the pipeline); operators leave the session alone."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def slices(batches: Iterable, rows: int = 1000) -> Iterator:
    """Arrow batches or pandas frames in parts of at most so many rows: bounds what a Python worker makes of them at once."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows) if hasattr(b, "num_rows") else b.iloc[i : i + rows]


def words(text: Column) -> Column:
    """The words of a text as an array of strings; null and blank texts have none."""
    bare = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPLIT))
