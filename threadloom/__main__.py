"""python -m threadloom list | run QUERY FOLDER [--out FOLDER]: the queries of this package over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from threadloom.plans import driver_queries


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="threadloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(driver_queries.queries()))
    run.add_argument("folder", help="folder of <table>.parquet")
    run.add_argument("--out", help="write Parquet there, else show 20 rows")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(driver_queries.queries())))
        return 0
    found = driver_queries.queries()[given.query](SparkSession.builder.getOrCreate(), given.folder)
    if given.out:
        found.write.parquet(given.out)
    else:
        found.show(20, truncate=100)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
