"""Statements from standard input, one a line: a message, then tab-separated names and rows."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lodestone.session import Result, Session


def render(result: Result) -> str:
    lines = [result.message]
    if result.columns:
        lines.append("\t".join(result.columns))
        lines += ["\t".join("NULL" if v is None else str(v) for v in row) for row in result.rows]
    return "\n".join(lines)


def main(root: str = "data", source=sys.stdin, out=sys.stdout, errors=sys.stderr, spark: SparkSession | None = None) -> int:
    session = Session(spark or SparkSession.builder.appName("lodestone").getOrCreate(), root)
    for line in source:
        if not line.strip() or line.lstrip().startswith("--"):
            continue
        result = session.execute(line)
        print(render(result) if result.success else f"error: {result.message}", file=out if result.success else errors)
        if session.exited:
            break
    return 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:2]))
