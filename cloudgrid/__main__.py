"""python -m cloudgrid convert SOURCE... [-d TARGET] [--importance] [--overwrite]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .sources.formats import convert


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cloudgrid")
    command = parser.add_subparsers(dest="command", required=True).add_parser("convert", help="files of known formats to Parquet")
    command.add_argument("sources", nargs="+")
    command.add_argument("-d", "--dst")
    command.add_argument("--importance", action="store_true")
    command.add_argument("--overwrite", action="store_true")
    found = parser.parse_args(args)
    target = convert(SparkSession.builder.getOrCreate(), found.sources, found.dst, found.importance, found.overwrite)
    print(f"wrote {target}" if target else "the target exists; give --overwrite to replace it")
    return 0 if target else 1


if __name__ == "__main__":
    sys.exit(main())
