"""python -m hornloom reason DATA... -o OUT [-O ONTOLOGY]"""

from __future__ import annotations

import argparse
import logging
import re
import sys
import time

from pyspark.sql import SparkSession

log = logging.getLogger("hornloom")
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def memory_size(text: str) -> int:
    """Bytes of 4G, 512mb, 2048K or 1024."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([kmgt]?)i?b?\s*", text.lower())
    if not m or int(m[1]) == 0:
        raise argparse.ArgumentTypeError(f"not a memory size: {text}")
    return int(m[1]) * _UNITS[m[2]]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hornloom")
    p = top.add_subparsers(dest="command", required=True).add_parser("reason", help="derive all entailed triples")
    p.add_argument("data", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-O", "--ontology")
    p.add_argument("--extract-ontology", action="store_true")
    p.add_argument("--ignore-annotation-axioms", action="store_true")
    p.add_argument("--emit", choices=["inferred", "closure"], default="inferred")
    p.add_argument("--output-format", choices=["ntriples"], default="ntriples")
    p.add_argument("--folder", action="store_true", help="write a folder of part files in place of one file")
    p.add_argument("-w", "--work-dir")
    p.add_argument("-m", "--memory-budget", type=memory_size, default=memory_size("4G"), help="kept for scripts; Spark's own settings rule")
    p.add_argument("--report")
    p.add_argument("--max-iterations", type=int)
    p.add_argument("--inconsistency-mode", choices=["report", "halt"], default="report")
    p.add_argument("--profile", choices=["compat", "sound"], default="compat")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--benchmark", action="store_true", help="the report also counts the candidates of each rule family, which costs a job for each")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    """Returns the report without its list of inconsistencies, which goes to the log and the report file alone."""
    from hornloom.plans.reason import Options, reason
    from hornloom.sources.ontology import load
    from hornloom.sources.rdf import read_rdf
    from hornloom.sources.sinks import write_ntriples, write_report

    ontology = load(args.ontology) if args.ontology else None
    options = Options(args.extract_ontology, args.ignore_annotation_axioms, args.profile == "sound", args.max_iterations, args.inconsistency_mode, args.work_dir, args.benchmark)
    triples = read_rdf(spark, args.data)
    read = triples.count() if args.report else None
    result = reason(spark, triples, ontology.axioms if ontology else None, options, len(ontology.residue) if ontology else 0)
    # All of them, in one order, partition by partition through the driver.
    messages = result.messages().orderBy("kind", "detail")
    if log.isEnabledFor(logging.WARNING):
        for r in messages.toLocalIterator():
            log.warning("%s: %s", r["kind"], r["detail"])
    began = time.perf_counter()
    written = write_ntriples(result.inferred() if args.emit == "inferred" else result.closure(), args.output, not args.folder)
    report = result.report | {
        "input": {"paths": args.data, "triples": read, "dictionary_terms": result.dictionary.count(), "output_triples": written, "memory_budget_bytes": args.memory_budget},
        "export_time_ms": int((time.perf_counter() - began) * 1000),
    }
    if args.report:
        write_report(report, args.report, ({"kind": r["kind"], "detail": r["detail"]} for r in messages.toLocalIterator()))
    return report


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.ERROR if args.quiet else [logging.INFO, logging.DEBUG][min(1, args.verbose)])
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("hornloom").getOrCreate()
    try:
        run(args, spark)
    except (ValueError, OSError, RuntimeError) as e:
        log.error("%s", e)
        return 1
    return 0
