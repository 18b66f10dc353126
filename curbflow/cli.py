"""Command line: version, modules and doctor."""

from __future__ import annotations

import argparse
import importlib
import sys

from curbflow import __version__

MODULES = (
    "config", "schemas", "session", "report", "functions.geo", "functions.ids", "functions.sites", "functions.tickets", "functions.times", "operators.dayview", "operators.layers",
    "operators.patterns", "operators.ranking", "operators.runs", "operators.sites", "operators.spatial", "operators.tickets", "operators.timeline", "operators.vehicle_days",
    "plans.registry", "sources.gps", "sources.layers", "sources.sheets", "sources.wkb", "streaming.pings",
)
NEEDED = ("pyspark", "pyarrow", "pandas", "numpy")
OPTIONAL = ("duckdb",)


def missing(names: tuple[str, ...]) -> list[str]:
    found = []
    for name in names:
        try:
            importlib.import_module(name)
        except ImportError:
            found.append(name)
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="curbflow")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    commands.add_parser("modules", help="list the modules")
    doctor = commands.add_parser("doctor", help="check imports")
    doctor.add_argument("--strict", action="store_true", help="optional packages count too")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    own = tuple(f"curbflow.{m}" for m in MODULES)
    if args.command == "modules":
        print("\n".join(own))
        return 0
    broken, absent = missing(own + NEEDED), missing(OPTIONAL)
    for name in own + NEEDED + OPTIONAL:
        print(("missing " if name in broken + absent else "ok      ") + name)
    return int(bool(broken or (args.strict and absent)))


if __name__ == "__main__":
    sys.exit(main())
