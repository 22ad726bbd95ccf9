"""Command line: python -m tidemark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from tidemark import errors
from tidemark.sql.planner import COMPAT, TYPED

EXIT_CODES = {errors.ParseError: 2, errors.SchemaError: 3, errors.ConstraintViolation: 3, errors.ValidationError: 4, errors.StorageError: 5}
CELL = 50


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Run SQL against a database folder.")
    p.add_argument("--compat", action="store_true", help="compare texts without case, as texts")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in (("create-db", ["name"]), ("build-sample-wiki", []), ("exec", ["sql"]), ("query", ["sql"]), ("script", ["file"]), ("inspect", []), ("rebalance", ["table"]), ("vacuum", ["table"])):
        c = sub.add_parser(name)
        c.add_argument("--db", required=True, help="folder of the database, or of the new one's parent")
        for x in extra:
            c.add_argument(x)
    return p


def run(args: argparse.Namespace, engine) -> None:
    if args.command == "create-db":
        engine.execute(f"CREATE DATABASE {args.name}", args.db)
    elif args.command == "build-sample-wiki":
        print(f"{engine.build_sample(args.db).executed} statements")
    elif args.command == "query":
        engine.query(args.sql, args.db).show(1000, truncate=CELL)
    elif args.command == "exec":
        result = engine.execute(args.sql, args.db)
        print(*result.warnings, sep="\n", end="")
        result.rows.show(1000, truncate=CELL) if result.rows is not None else print(f"{result.affected} rows affected")
    elif args.command == "script":
        text = "\n".join(r[0] for r in engine.spark.read.text(args.file, wholetext=True).collect())
        result = engine.script(text, args.db)
        for rows in result.results:
            rows.show(1000, truncate=CELL)
        print(f"{result.executed} statements")
    elif args.command == "inspect":
        engine.inspect(args.db).show(10_000, truncate=CELL)
    elif args.command == "rebalance":
        print(f"{engine.rebalance(args.db, args.table)} rows")
    else:
        print(f"{engine.vacuum(args.db, args.table)} row versions dropped")


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = arguments().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    from pyspark.sql import SparkSession

    from tidemark.engine import Engine

    try:
        run(args, Engine(spark or SparkSession.builder.appName("tidemark").getOrCreate(), COMPAT if args.compat else TYPED))
    except errors.EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return EXIT_CODES.get(type(e), 99)
    return 0


if __name__ == "__main__":
    sys.exit(main())
