"""python -m ropewalk.cli --input "type=path;n=100000" --algorithm doubling"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import SparkSession

from .functions.scalars import RULERS
from .operators import stats
from .operators.prefix import partition_sizes, rebalance, size_stats
from .plans.fixpoint import Metrics
from .plans.ranking import OPTIONS, Strategy, timed
from .plans.report import row_of, spread, write_report
from .plans.tables import keep
from .sources.generators import from_spec


@dataclass(frozen=True)
class Options:
    input: str
    input_processing: str = "none"
    algorithm: str = "doubling"
    iterations: int = 1
    output_file: str = "stdout"
    verify_level: int = 1
    verify_continue_on_mismatch: bool = False
    statistics_level: str = "basic"
    result: str | None = None
    tail: int | None = None
    block_rows: int | None = None
    most_rows: int | None = None
    degree: int | None = None
    every: int | None = None
    ruler: str | None = None
    factor: float | None = None
    rounds: int | None = None
    levels: int | None = None
    base: str | None = None

    @property
    def of_algorithm(self) -> dict[str, Any]:
        return {o: v for o in OPTIONS if (v := getattr(self, o)) is not None}


def parse(args: list[str] | None = None) -> Options:
    p = argparse.ArgumentParser(prog="ropewalk")
    p.add_argument("--input", required=True, help="option string of a generated structure, or a Parquet folder with id, succ[, weight]")
    p.add_argument("--input-processing", default="none", choices=["none", "bfs", "eulertour", "eulertour-break-high-degree"])
    p.add_argument("--algorithm", default="doubling", choices=[s.value for s in Strategy])
    p.add_argument("--iterations", type=int, default=1)
    p.add_argument("--output-file", default="stdout", help="of the JSON report: stdout, stderr or a path")
    p.add_argument("--verify-level", type=int, default=1, help="0: none, 1: the local recurrence, 2: against a ranking in one task")
    p.add_argument("--verify-continue-on-mismatch", action="store_true")
    p.add_argument("--statistics-level", default="basic", choices=["none", "basic", "extensive", "extensive-reduced-output"])
    p.add_argument("--result", help="Parquet folder for the ranking")
    p.add_argument("--tail", type=int, help="doubling: elements still active that one task finishes; 0: rounds to the end")
    p.add_argument("--block-rows", type=int, help="contracted, ruling-set: rows of a range that is contracted first")
    p.add_argument("--most-rows", type=int, help="gather: rows that one task may hold")
    p.add_argument("--degree", type=int, help="high-degree, euler-tour: predecessors from which an element is split off or gets proxies")
    p.add_argument("--every", type=int, help="ruling sets: one element in so many is a ruler")
    p.add_argument("--ruler", choices=RULERS, help="ruling-set: the formula for the number of rulers, instead of --every")
    p.add_argument("--factor", type=float, help="ruling-set: scales the formula")
    p.add_argument("--rounds", type=int, help="ruling sets: rounds of the walks")
    p.add_argument("--levels", type=int, help="ruling sets: rulings of rulers")
    p.add_argument("--base", choices=[s.value for s in Strategy], help="ruling sets, contracted, euler-tour: the ranking of what is left")
    return Options(**vars(p.parse_args(args)))


def run(spark: SparkSession, o: Options) -> dict:
    """Generates or reads, ranks, verifies and reports; raises on a mismatch unless told to go on."""
    raw = from_spec(spark, o.input, o.input_processing) if "type=" in o.input else spark.read.parquet(o.input)
    succ = keep(rebalance(raw, spark.sparkContext.defaultParallelism))
    rounds = Metrics()
    ranked, seconds = timed(succ, o.algorithm, o.iterations, rounds, **o.of_algorithm)
    ranked = keep(ranked)
    wrong = 0
    if o.verify_level > 0:
        wrong = stats.violations(succ, ranked).count()
    if o.verify_level > 1:
        wrong += stats.mismatches(ranked, timed(succ, Strategy.GATHER)[0]).count()
    report = {
        "config": asdict(o),
        "input": row_of(size_stats(partition_sizes(succ))),
        "seconds": seconds,
        "ranking": spread(seconds),
        "rounds": {"number": rounds.rounds, "active": rounds.active, "seconds": spread(rounds.seconds), **rounds.more},
        "wrong": wrong,
        "stats": row_of(stats.stats(ranked, o.statistics_level)),
    }
    write_report(report, o.output_file)
    if o.result:
        ranked.write.mode("overwrite").parquet(o.result)
    if wrong and not o.verify_continue_on_mismatch:
        raise SystemExit(f"{wrong} elements are ranked wrongly: {json.dumps(asdict(o))}")
    return report


def main() -> None:
    run(SparkSession.builder.appName("ropewalk").getOrCreate(), parse())


if __name__ == "__main__":
    main()
