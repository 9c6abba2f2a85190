"""JSON reports of runs."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import Any, TextIO

from pyspark.sql import DataFrame


def spread(values: Iterable[float]) -> dict[str, float]:
    own = list(values)
    return {"min": min(own), "max": max(own), "sum": sum(own)} if own else {}


def row_of(df: DataFrame | None) -> dict[str, Any]:
    """The one row of a statistics table."""
    first = None if df is None else df.first()
    return {} if first is None else first.asDict(recursive=True)


def write_report(report: dict[str, Any], target: str = "stdout") -> None:
    """target: stdout, stderr or a file's path."""
    streams: dict[str, TextIO] = {"stdout": sys.stdout, "stderr": sys.stderr}
    text = json.dumps(report, indent=1, default=str)
    if target in streams:
        print(text, file=streams[target])
    else:
        with open(target, "w") as f:
            f.write(text + "\n")
