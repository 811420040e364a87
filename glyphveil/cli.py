"""python -m glyphveil.cli [PATH | --from=stdin] [--pretty] [--show-samples]: what a text holds, as JSON.

Ends with 0, with 1 for wrong arguments, with 2 if the input can't be read.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphveil.operators.engine import Engine
from glyphveil.operators.reports import safe
from glyphveil.sources.config import build_engine, from_environment
from glyphveil.sources.text import from_strings


class _Parser(argparse.ArgumentParser):
    """Wrong arguments end with 1."""

    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{message}\n")


def main(args: list[str] | None = None, spark: SparkSession | None = None, engine: Engine | None = None, stdin=None, out=None) -> int:
    p = _Parser(description=__doc__)
    p.add_argument("path", nargs="?")
    p.add_argument("--from", dest="source")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--show-samples", action="store_true")
    a = p.parse_args(args)
    if (a.source == "stdin") == (a.path is not None):
        print("give either a path or --from=stdin", file=sys.stderr)
        return 1
    try:
        if a.source == "stdin":
            text = (stdin or sys.stdin).read()
        elif os.path.isfile(a.path):
            with open(a.path, encoding="utf-8", errors="replace") as f:
                text = f.read()
        else:
            raise OSError("no such file")
    except (OSError, UnicodeDecodeError) as e:
        print(f"{a.path or 'stdin'} can't be read: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    e = engine or build_engine(from_environment())
    row = from_strings(spark, [text]).select(safe(e.scan(F.col("text")), a.show_samples).alias("r")).first()["r"]
    got = {"total": row["total"], "counts": dict(row["counts"]), "samples": {k: list(v) for k, v in row["samples"].items()}}
    print(json.dumps(got, ensure_ascii=False, indent=4 if a.pretty else None, separators=None if a.pretty else (",", ":")), file=out or sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
