"""Writing triples as N-Triples text, and reports as JSON."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hornloom.operators.tables import shared_dir


def lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line for each (s, p, o); fails on a predicate that is no IRI."""
    bad = F.raise_error(F.concat(F.lit("the predicate is no IRI: "), F.coalesce("p", F.lit("null"))))
    p = F.when(F.col("p").startswith("<"), F.col("p")).otherwise(bad)
    return triples.select(F.concat(F.col("s"), F.lit(" "), p, F.lit(" "), F.col("o"), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, single_file: bool = False) -> int:
    """Writes a folder of part files, or one local file. Returns the number of triples.

    Executors write the parts either way; for a single file the driver's JVM appends them byte by byte from the shared folder and deletes them. Nothing is
    left at the path if the parts fail.
    """
    written = Observation()
    text = lines(triples).observe(written, F.count(F.lit(1)).alias("n"))
    if not single_file:
        text.write.mode("overwrite").text(path)
        return written.get["n"]
    spark = triples.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex}"
    text.write.text(folder)
    hadoop = spark._jvm.org.apache.hadoop
    source = hadoop.fs.Path(folder)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    out = spark._jvm.java.io.FileOutputStream(os.path.abspath(path))
    try:
        for part in sorted(x.getPath().toString() for x in files.listStatus(source) if x.getPath().getName().startswith("part-")):
            stream = files.open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    finally:
        out.close()
        files.delete(source, True)
    return written.get["n"]


def write_report(report: dict, path: str, inconsistencies: Iterable[dict] = ()) -> None:
    """The report with all inconsistencies as its last entry; these are written one by one, so they may be many."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(report, indent=2, default=str).removesuffix("\n}") + ',\n  "inconsistencies": [')
        i = -1
        for i, x in enumerate(inconsistencies):
            f.write((",\n    " if i else "\n    ") + json.dumps(x, default=str))
        f.write("\n  ]\n}" if i >= 0 else "]\n}")
