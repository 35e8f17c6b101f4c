"""python -m lodestone.cli CONFIG COMMAND ...: create-database, drop-database, drop-index, vacuum-index, import, pull, search."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .engine import Engine
from .errors import LodestoneError
from .session import session
from .sources import images, lists


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create-database", "drop-database", "drop-index", "vacuum-index", "pull"):
        sub.add_parser(name)
    sub.add_parser("import").add_argument("list", help="a file with a path, or a number and a path, on each line")
    find = sub.add_parser("search")
    find.add_argument("file")
    find.add_argument("-n", type=int, default=10)
    args = p.parse_args(argv)
    spark = session()
    try:
        engine = Engine.open(spark, args.config)
        if args.command == "import":
            paths = [r.path for r in lists.read_list(spark, args.list).toLocalIterator()]
            engine.insert(images.read_files(spark, paths).select("item_id", "image"))
        elif args.command == "search":
            for r in engine.search(args.n, {"file": args.file}).select(lists.result_json(F.col("item_id"), F.col("similarity")).alias("j")).collect():
                print(r.j)
        else:
            getattr(engine, args.command.replace("-", "_"))()
    except LodestoneError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
