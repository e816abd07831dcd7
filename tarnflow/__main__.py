"""Command line: list the queries over a folder of tables, print their SQL, run one and show or write its result."""

from __future__ import annotations

import argparse

from tarnflow.plans import more
from tarnflow.session import session, ship


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnflow", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    sql = commands.add_parser("sql", help="the SQL of a query")
    run = commands.add_parser("run", help="run a query")
    for p in (sql, run):
        p.add_argument("name", choices=sorted(more.QUERIES))
    run.add_argument("folder", help="folder with one Parquet file or folder for each table")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    args = parser.parse_args(argv)
    if args.command == "list":
        print(*sorted(more.QUERIES), sep="\n")
    elif args.command == "sql":
        print(more.SQL.get(args.name, "SQL cannot express this query"))
    else:
        spark = session()
        ship(spark)
        found = more.QUERIES[args.name](spark, args.folder)
        if args.out:
            found.write.parquet(args.out)
        else:
            found.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
