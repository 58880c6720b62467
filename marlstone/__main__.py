"""Command line: conversions and canned queries.

    python -m marlstone csv-to-store data.csv schema.csv out.parquet [--sep ,] [--crlf] [--header]
    python -m marlstone store-to-csv table.parquet out_folder [--columns a,b]
    python -m marlstone export-column table.parquet UserID out_folder
    python -m marlstone column-file-to-store data.col out.parquet
    python -m marlstone store-to-column-file table.parquet out.col [--rows 500000]
    python -m marlstone run-query 6 hits.parquet [--out folder]
"""

from __future__ import annotations

import argparse

from marlstone.operators.relational import scan
from marlstone.plans.canned import run_query
from marlstone.session import get_session
from marlstone.sources.column_file import read_column_file, write_column_file
from marlstone.sources.csv_io import write_csv
from marlstone.sources.store import csv_to_store, export_column, store_to_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description="Convert tables and run canned queries.")
    p.add_argument("--master", help="Spark master; left to spark-submit if not given")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        return c

    c = command("csv-to-store", "csv", "schema", "out")
    c.add_argument("--sep", default=",")
    c.add_argument("--crlf", action="store_true")
    c.add_argument("--header", action="store_true")
    command("store-to-csv", "store", "out").add_argument("--columns", default="")
    command("export-column", "store", "column", "out")
    command("column-file-to-store", "file", "out")
    command("store-to-column-file", "store", "out").add_argument("--rows", type=int, default=500_000)
    c = sub.add_parser("run-query")
    c.add_argument("number", type=int)
    c.add_argument("store")
    c.add_argument("--out", help="write the result as CSV there instead of showing it")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = get_session(master=a.master)
    if a.command == "csv-to-store":
        csv_to_store(spark, a.csv, a.schema, a.out, a.sep, "\r\n" if a.crlf else "\n", header=a.header)
    elif a.command == "store-to-csv":
        store_to_csv(spark, a.store, a.out, [c for c in a.columns.split(",") if c])
    elif a.command == "export-column":
        export_column(spark, a.store, a.column, a.out)
    elif a.command == "column-file-to-store":
        read_column_file(spark, a.file).write.parquet(a.out)
    elif a.command == "store-to-column-file":
        write_column_file(scan(spark, a.store), a.out, a.rows)
    else:
        result = run_query(spark, a.number, a.store)
        if a.out:
            write_csv(result, a.out)
        else:
            result.show(1000, truncate=False)


if __name__ == "__main__":
    main()
