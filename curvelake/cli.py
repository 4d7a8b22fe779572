"""python -m curvelake.cli FOLDER [--query NAME | --sql TEXT] [--out PATH] [--format parquet|csv] [--list] [--share S]"""

from __future__ import annotations

import argparse
import sys

from curvelake import plans
from curvelake.engine import Engine
from curvelake.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="curvelake")
    p.add_argument("folder")
    p.add_argument("--query")
    p.add_argument("--sql")
    p.add_argument("--out")
    p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    p.add_argument("--list", action="store_true")
    p.add_argument("--share", type=float)
    p.add_argument("--cores", default="*")
    a = p.parse_args(argv)
    if a.list:
        print(*sorted(plans.all_queries()), sep="\n")
        return 0
    if not a.query and not a.sql:
        p.error("--query, --sql or --list")
    engine = Engine(local_session(a.cores), a.folder, a.share)
    df = engine.run(a.query) if a.query else engine.sql(a.sql)
    if a.out:
        writer = df.write.mode("overwrite").option("header", True)
        writer.csv(a.out) if a.format == "csv" else writer.parquet(a.out)
    else:
        df.show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
