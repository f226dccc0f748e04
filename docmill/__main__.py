"""python -m docmill query|stats|info|search DIR [QUESTION]: a collection of files on this machine."""

from __future__ import annotations

import argparse
import json

from docmill.engine import Engine
from docmill.session import local_session
from docmill.sources import files


def main() -> None:
    p = argparse.ArgumentParser(prog="docmill", description=__doc__)
    p.add_argument("command", choices=("query", "search", "stats", "info"))
    p.add_argument("folder")
    p.add_argument("question", nargs="?", default="")
    a = p.parse_args()
    spark = local_session()
    if a.command == "stats":
        rows = files.count_by_extension(files.scan(spark, a.folder)).collect()
        print(json.dumps({r["extension"]: r["files"] for r in rows}, indent=2))
        return
    engine = Engine.from_files(spark, a.folder)
    if a.command == "info":
        print(json.dumps(engine.info(), indent=2))
    else:
        df = engine.ask(a.question) if a.command == "query" else engine.exhaustive(a.question)
        for r in df.limit(20).collect():
            print(json.dumps(r.asDict(), indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
