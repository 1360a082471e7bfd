"""Command line: ``python -m factweave.cli FACTS.tsv [options]`` compresses a file of facts."""

from __future__ import annotations

import argparse
import sys
import threading
import time

from pyspark.sql import SparkSession

from .functions.scores import Metric
from .operators import compress
from .operators.candidates import specialisations, symmetric_specialisations
from .operators.search import MinerConfig
from .operators.studies import write_observed
from .sources.datasets import Registry
from .sources.facts import read_facts, write_result
from .sources.store import write_bundle, write_graph


# Short names of models.  They differ in what they cache, which is one search here, but for the symmetric one.
MODELS = {"full": "full", "T": "full", "M": "full", "C": "full", "To": "observed", "symmetric": "symmetric", "Y": "symmetric"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factweave", description="Compress relational facts by rules.")
    p.add_argument("facts", nargs="?", help="tab-separated facts: relation, arguments")
    p.add_argument("-d", "--data-path", help="the same as FACTS")
    p.add_argument("-D", "--dataset", help="name of a data set in the file of --datasets")
    p.add_argument("--datasets", help="lines of name, path and short name, tab-separated")
    p.add_argument("-o", "--out", help="folder for the compressed bundle")
    p.add_argument("-r", "--result-path", help="folder for the result as text")
    p.add_argument("-l", "--log-path", help="file for the report, beside the output")
    p.add_argument("--observe", help="folder for what the search cut as duplicate or tabu")
    p.add_argument("--graph", help="folder for the dependency graph")
    p.add_argument("-b", "--beam", "--beam-width", type=int, default=3)
    p.add_argument("-f", "--fact-coverage", type=float, default=0.05)
    p.add_argument("-c", "--constant-coverage", "--const-coverage", type=float, default=0.25)
    p.add_argument("-s", "--column-similarity", type=float, default=0.1)
    p.add_argument("-p", "--stop-ratio", "--stop-comp-rate", type=float, default=0.9)
    p.add_argument("-e", "--metric", "--eval-metric", choices=[m.value for m in Metric], default=Metric.CAPACITY.value)
    p.add_argument("-m", "--model", choices=list(MODELS), default="full", help="T, M and C are full, To is full and observes, Y is symmetric")
    p.add_argument("-n", "--most-rules", type=int)
    p.add_argument("-g", "--generalise", action="store_true", help="also try to drop arguments of rules")
    p.add_argument("-t", "--threads", type=int, default=4, help="relations searched side by side")
    p.add_argument("-i", "--interactive", action="store_true", help="the line 'stop' on the input ends the search with what it has")
    p.add_argument("-v", "--validate", action="store_true", help="recover and compare")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.dataset:
        if not args.datasets:
            raise SystemExit("--dataset needs --datasets")
        found = Registry.from_file(args.datasets)[args.dataset]
        path, name = found.path, found.name
    else:
        path, name = args.data_path or args.facts, "kb"
    if not path:
        raise SystemExit("no facts are given: FACTS, -d or -D")
    spark = spark or SparkSession.builder.appName("factweave").getOrCreate()
    config = MinerConfig(
        beam=args.beam, fact_coverage=args.fact_coverage, constant_coverage=args.constant_coverage, strict_constants=True, column_similarity=args.column_similarity,
        stop_ratio=args.stop_ratio, metric=Metric(args.metric), generalise=args.generalise, most_rules=args.most_rules, threads=args.threads, observe=bool(args.observe) or MODELS[args.model] == "observed",
        specialise=symmetric_specialisations if MODELS[args.model] == "symmetric" else specialisations,
    )
    times, said = {}, []
    began = last = time.time()

    def lap(what: str) -> None:
        nonlocal last
        times[f"{what}_s"], last = round(time.time() - last, 3), time.time()

    kb = read_facts(spark, path, name).persist()
    lap("load")
    stop = threading.Event()
    if args.interactive:
        threading.Thread(target=lambda: any(x.strip() == "stop" for x in sys.stdin) and stop.set(), daemon=True).start()
    run = compress.Compressor(kb, config, stop.is_set)
    result = run.run()
    last = time.time()
    said += [str(r) for r in result.rules]
    ok = True
    if args.validate:
        ok = result.valid()
        said.append("recovered" if ok else "recovery differs")
        lap("validate")
    if args.out:
        write_bundle(result, args.out)
    if args.result_path:
        write_result(result, args.result_path)
    if args.observe:
        write_observed(spark, run.observed, args.observe)
    if args.graph and result.edges is not None:
        write_graph(result.edges, args.graph)
    lap("dump")
    times["total_s"] = round(time.time() - began, 3)
    result.monitor |= times
    said.append(compress.monitor_json(result))
    print("\n".join(said))
    if args.log_path:
        with open(args.log_path, "w", encoding="utf-8") as f:
            f.write("\n".join(said) + "\n")
    return 0 if ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
